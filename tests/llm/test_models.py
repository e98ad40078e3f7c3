"""Operators that learn: languages, toxicity, quality rules."""

import random
import zlib

import numpy as np
import pytest
from texts import ODD, SF_DIR, prose

from hindcast.llm import anomalies, languages, queries, toxicity
from hindcast.llm.blocks import WordHashes, window_hashes


def test_held_out_languages(spark):
    docs = queries.table(spark, SF_DIR.replace("sf0.001", "sf0.01"), "documents").select("doc_id", "lang")
    rows = queries.op6_language_id(spark, SF_DIR.replace("sf0.001", "sf0.01")).join(docs, "doc_id").collect()
    test = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert len(test) > 250 and np.mean([r.lang == r.lang_pred for r in test]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_texts_have_a_language(documents):
    train = documents([(i, "the cat and the dog", "en") for i in range(5)] + [(9, "le chat et le chien", "fr"), (8, None, "fr"), (7, "x", None)])
    filters = languages.learn_languages(train)
    assert filters.names == ["en", "fr"]
    docs = documents([*ODD, (20, "THE DOG"), (21, "Chien!"), (22, "123 !?"), (23, "日本")])
    got = {r.doc_id: (r.lang_pred, r.score) for r in languages.predict_languages(docs, filters).collect()}
    assert got[20][0] == "en" and got[21][0] == "fr"
    assert got[1] == got[2] == got[3] == got[22] == ("und", 0.0)
    assert got[23] == ("en", 0.0)
    assert languages.predict_languages(docs, filters).columns == [*docs.columns, "lang_pred", "score"]
    empty = languages.learn_languages(train.limit(0))
    assert {r.lang_pred for r in languages.predict_languages(docs, empty, ["doc_id"]).collect()} == {"und"}
    assert languages.predict_languages(docs.limit(0), filters).count() == 0


def test_more_languages_than_bits(documents):
    rng = random.Random(3)
    letters = [chr(0x4E00 + i) for i in range(2000)]
    words = {f"l{i:03}": ["".join(rng.sample(letters[i * 20 : i * 20 + 20], 4)) for _ in range(30)] for i in range(70)}
    train = [(i, " ".join(w), lang) for i, (lang, w) in enumerate(words.items())]
    filters = languages.learn_languages(documents(train))
    assert filters.slices.shape[1] == 2
    got = languages.predict_languages(documents(train), filters, ["lang"]).collect()
    assert all(r.lang == r.lang_pred for r in got)


def test_toxicity_of_unseen_documents(spark):
    sf_dir = SF_DIR.replace("sf0.001", "sf0.1")
    docs, labels = queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "labels")
    labels = labels.withColumn("low_quality", 1 - labels["quality"])
    seen, unseen = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    chain = toxicity.fit_chain(docs, seen, ["low_quality", "toxic"])
    rows = toxicity.predict_toxicity(docs, chain).join(unseen, "doc_id").collect()
    hit = [r.is_toxic for r in rows if r.toxic]
    false = [r.is_toxic for r in rows if not r.toxic]
    assert len(hit) > 100 and np.mean(hit) >= 0.85 and np.mean(false) <= 0.02


def test_chain_sees_earlier_probabilities():
    rng = np.random.default_rng(0)
    earlier = rng.random((400, 1))
    target = (earlier[:, 0] > 0.5).astype(float)
    none, zero = np.empty(0, np.int64), np.zeros(400, np.int64)
    model = toxicity.fit_linear(none, zero, earlier, target, np.zeros(0, bool))
    prob = model.prob(none, zero, earlier)
    assert np.mean((prob > 0.5) == (target == 1)) > 0.9


def test_toxicity_of_odd_texts(spark, documents):
    docs = documents([*ODD, *[(100 + i, f"you are a moron {prose(i, 5)}" if i % 3 == 0 else prose(i, 9)) for i in range(60)]])
    rows = [(100 + i, int(i % 3 == 0), 0) for i in range(60)] + [(None, 1, 1), (100, 1, 0), (999, 1, 1), (101, None, None)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int, rude int")
    chain = toxicity.fit_chain(docs, labels, ["rude", "toxic"])
    out = toxicity.predict_toxicity(docs, chain)
    assert out.columns == ["doc_id", "p_rude", "p_toxic", "is_rude", "is_toxic"]
    got = {r.doc_id: r.is_toxic for r in out.collect()}
    assert out.count() == 70 and got[100] and got[103] and not got[101] and not got[1]
    nothing = toxicity.fit_chain(docs, labels.limit(0), ["rude", "toxic"])
    assert not any(r.is_toxic for r in toxicity.predict_toxicity(docs, nothing).collect())
    assert toxicity.predict_toxicity(docs.limit(0), chain).count() == 0


def plain_statistics(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if x.strip("\x20\x09\x0a\x0b\x0c\x0d")]
    seen: dict = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    again = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)]


QUALITY = [*ODD, (50, "l one\nl one\n \n\nl one | é# x\n"), (51, prose(3, 12) + " " + prose(3, 12)), (52, "a b c d e f g h " * 3), (53, prose(8, 40, 2))]


def test_statistics(documents):
    rules = anomalies.QualityRules(anomalies.grow_forest(np.zeros((0, 2))), float("inf"))
    rows = anomalies.apply_rules(documents(QUALITY), rules).collect()
    got = sorted(([r.doc_id, *[r[c] for c in anomalies.STATS], r.base_failed] for r in rows), key=str)
    want = []
    for i, t in QUALITY:
        s = plain_statistics(t)
        want.append([i, *s, s[0] < 20 or 100 * s[4] > 30 * s[0]])
    assert got == sorted(want, key=str)
    assert all(r.kept == (not r.base_failed) for r in rows)


def test_rules_part_good_from_bad(spark):
    sf_dir = SF_DIR.replace("sf0.001", "sf0.01")
    docs, labels = queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "labels")
    rules = anomalies.fit_rules(docs, labels.filter("doc_id % 2 = 0"))
    rows = anomalies.apply_rules(docs, rules).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("NOT base_failed").collect()
    assert np.mean([r.kept for r in rows if r.quality]) >= 0.95
    assert np.mean([r.kept for r in rows if not r.quality]) <= 0.3


def test_rules_without_labels(spark, documents):
    docs = documents(QUALITY)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rules = anomalies.fit_rules(docs, labels)
    rows = anomalies.apply_rules(docs, rules).collect()
    assert len(rows) == len(QUALITY) and all(r.kept == (not r.base_failed) for r in rows)
    assert anomalies.apply_rules(docs.limit(0), rules).count() == 0
    assert anomalies.fit_rules(docs.limit(0), labels).threshold == float("inf")


def test_forest_finds_what_lies_apart():
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(size=(500, 2)), [[9.0, 9.0]]]
    score = anomalies.grow_forest(x).score(x)
    assert score.argmax() == 500


@pytest.mark.parametrize("width", [1, 2, 3, 5, 7, 8, 16, 35])
def test_window_hashes(width):
    words = WordHashes().sequence([str(i % 7).encode() for i in range(60)])
    found = window_hashes(words, width)
    assert len(found) == 61 - width
    same = {}
    for i, h in enumerate(found.tolist()):
        assert same.setdefault(h, tuple(words[i : i + width])) == tuple(words[i : i + width])
    assert len(same) == len({tuple(words[i : i + width]) for i in range(len(found))})
    assert len(window_hashes(words[:0], width)) == 0
