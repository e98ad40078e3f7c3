import corpus_pipeline
import pytest
from oracle import connection, differences
from pyspark.sql import functions as F
from texts import ODD, SF_DIR

import __spark_entry__ as entry
from hindcast.llm import oracles, queries
from hindcast.sources.shared import settle


HEX = "0123456789abcdef" * 3


@pytest.fixture
def planted(spark, tmp_path):
    """The smallest tables, and documents with copies, benchmark passages and secrets among them."""
    docs = queries.table(spark, SF_DIR, "documents")
    first = docs.filter("lang IS NOT NULL AND n_chars > 1500").orderBy("doc_id").first()
    item = queries.table(spark, SF_DIR, "benchmark").orderBy(F.desc(F.length("text"))).first().text
    texts = [first.text + " one more word", first.text, f"{first.text[:700]} {item}", f"{first.text[300:1400]} token = {HEX} and AKIA{'Q7' * 8} end"]
    rows = [(10_000 + i, t, first.lang, first.source, len(t)) for i, t in enumerate(texts)]
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("benchmark", "labels"):
        queries.table(spark, SF_DIR, name).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path), first.doc_id


def test_stages(spark, planted):
    sf_dir, original = planted
    docs = queries.table(spark, sf_dir, "documents")
    columns, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, settle(stage(spark, docs, sf_dir), name)
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and ids[name] and docs.count() == len(ids[name]) <= before.count(), name
    assert original in ids["jaccard_join"] and not ids["jaccard_join"] & {10_000, 10_001}
    assert 10_002 in ids["jaccard_join"] and 10_002 not in ids["decontamination"]
    assert 10_003 in ids["secret_scan"]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in last.select("doc_id").collect()} == ids["secret_scan"] and last.filter("NOT lossless").count() == 0
    assert ids["secret_scan"] == {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()}
    found = queries.op8_decontamination(spark, sf_dir).join(docs.select("doc_id"), "doc_id")
    assert found.filter("contaminated").count() == 0
    assert queries.op9_secret_scan(spark, sf_dir).filter("n_assign + n_access + n_hex > 0").count() > 0
    assert docs.filter("text rlike 'AKIA[A-Z0-9]{12}' or text rlike '[0-9a-f]{32}'").count() == 0


CLASHING = ["_id", "_hash", "_new", "_spans", "_times", "name", "n", "words", "spans", "verdict"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_a_stage_takes_any_rows(spark, documents, name):
    """Null, empty, very long, tied and repeated rows, columns with the operators' own names, and no row."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = documents(ODD).withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    for rows in (docs, docs.limit(0)):
        out = stage(spark, rows, SF_DIR)
        got = out.collect()
        assert len(got) <= len(ODD)
        if name != "sentencepiece":
            assert out.columns == docs.columns
            assert all(r[c] == f"own {c}" for r in got for c in CLASHING)
    assert got == []


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_oracle(spark, name):
    rows, diff = differences(queries.QUERIES[name](spark, SF_DIR), connection(SF_DIR), oracles.ORACLES[name])
    assert rows > 0 and not diff


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(names) == sorted([*queries.QUERIES, "pipeline"])
    assert len(corpus_pipeline.STAGES) == 5
