from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from texts import ODD, prose

from hindcast.llm import crossing, similar
from hindcast.llm.blocks import WordHashes, shingle_sets
from hindcast.llm.similar import components, most_differing, one_of_each, signatures, similar_documents


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    lead = list(range(len(rows)))

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for j, shared in Counter(j for g in s for j in holders[g]).items():
            if 100 * shared >= 75 * (len(s) + len(sets[j]) - shared):
                lead[find(i)] = find(j)
        for g in s:
            holders[g].append(i)
    ids = defaultdict(list)
    for i, (name, _) in enumerate(rows):
        if name is not None:
            ids[find(i)].append(name)
    return sorted(((name, len(sets[i]), min(ids[find(i)], default=None)) for i, (name, _) in enumerate(rows)), key=str)


def edited(text, step, word="edited"):
    words = text.split()
    words[::step] = [word] * len(words[::step])
    return " ".join(words)


BASE, SMALL = prose(1, 300), prose(2, 24)
ROWS = [
    *ODD,
    *[(100 + i, edited(BASE, 97 + i)) for i in range(12)],
    *[(200 + i, f"{prose(50 + i, 20)} {SMALL} {prose(90 + i, 3)}") for i in range(12)],
    (300, BASE.upper()),
    (301, "one two"),
    (302, "ONE  two"),
    *[(400 + i, " ".join(prose(9, 60).split()[i : i + 50])) for i in range(10)],
]


@pytest.mark.parametrize("frequent, block", [(32, 1024), (2, 2)])
def test_against_brute_force(documents, monkeypatch, frequent, block):
    monkeypatch.setattr(similar, "FREQUENT_LEAST", frequent)
    monkeypatch.setattr(crossing, "BLOCK_ROWS", block)
    docs = documents(ROWS, 3)
    found = similar_documents(docs)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=str)
    assert got == brute(ROWS)
    kept = one_of_each(docs, found).collect()
    words = [r for r in kept if (r.text or "").encode().split()]
    assert len(words) == found.filter("n_shingles > 0").select("component_id").distinct().count()
    assert len(kept) - len(words) == sum(not (t or "").encode().split() for _, t in ROWS)


def across_blocks():
    """Rows of two blocks, each four times: dissimilar texts that share one signature, more than
    four of them in the first block; one that is not its lead links to one of the second, by that
    signature only. All shingles are frequent, so sets enumerate their lowest shingles."""
    for turn in range(10_000):
        part = [prose(1000 * turn + i, 8).split() for i in range(3)]
        one, two = " ".join(part[0][1:]), " ".join(part[0])
        few = [one, two]
        for i in range(5):
            rest = [prose(1000 * turn + 10 + 2 * i + j, 1) + str(i) for j in range(2)]
            few.append(" ".join([rest[0], *part[0][1:6], rest[1]]))
        grams, sizes = shingle_sets([t.encode() for t in few], WordHashes(), 5)
        sig, own = signatures(grams, sizes, np.unique(grams))
        of = [set(sig[own == i]) for i in range(len(few))]
        names = similar._set_hashes(grams, sizes).view(np.int64)
        if all(len(of[i] & of[j]) == 1 for i in range(len(few)) for j in range(i)) and names[0] > min(names[2:]):
            first, second = [one, *few[2:]] * 4, [two] * 4 + [prose(7 + i, 30) for i in range(20)]
            return list(enumerate(first + second))
    raise AssertionError("no such texts")


def test_large_group_of_one_block_meets_small_one_of_another(spark, monkeypatch):
    monkeypatch.setattr(similar, "FREQUENT_LEAST", 4)
    rows = across_blocks()
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similar_documents(docs).collect()), key=str)
    assert got == brute(rows)
    assert {c for i, _, c in got if i in (0, 24)} == {0}


def test_no_rows(documents):
    docs = documents(ODD[:1]).limit(0)
    assert one_of_each(docs, similar_documents(docs)).count() == 0


def test_linked_sets_share_a_signature():
    """Pairs at the threshold, of all sizes, with and without frequent shingles left out."""
    rng = np.random.default_rng(5)
    tried = 0
    for turn in range(1500):
        a = int(rng.integers(1, [3, 8, 30, 200, 900][turn % 5] + 1))
        b = max(1, a + int(rng.integers(-a // 4 - 1, a // 3 + 2)))
        shared = -(-3 * (a + b) // 7)
        if shared > min(a, b):
            continue
        tried += 1
        pool = rng.integers(0, 2**63, a + b - shared).astype(np.uint64)
        one, two = np.sort(pool[:a]), np.sort(np.r_[pool[:shared], pool[a:]])
        left_out = np.sort(rng.choice(pool, len(pool) * (turn % 4) // 4, replace=False))
        sig, own = signatures(np.r_[one, two], np.array([a, b]), left_out)
        assert set(sig[own == 0]) & set(sig[own == 1])
        assert a + b - 2 * shared <= most_differing(np.array([a]))[0]
    assert tried > 500


def test_linked_sets_pass_by_profile():
    rng = np.random.default_rng(6)
    for _ in range(300):
        a = int(rng.integers(1, 3000))
        b = max(1, a + int(rng.integers(-a // 4 - 1, a // 3 + 2)))
        shared = -(-3 * (a + b) // 7)
        if shared <= min(a, b):
            pool = rng.integers(0, 2**63, a + b - shared).astype(np.uint64)
            sizes = np.array([a, b])
            one, two = similar.profiles(np.r_[pool[:a], pool[:shared], pool[a:]], sizes)
            assert similar.may_link(sizes[:1], sizes[1:], [one], [two])[0]
    sets = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    one, two = similar.profiles(sets, np.array([10_000, 10_000]))
    assert not similar.may_link(np.array([10_000]), np.array([10_000]), [one], [two])[0]


def test_bit_maps_find_all_that_link():
    rng = np.random.default_rng(8)
    for turn in range(60):
        pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
        sets = [np.unique(rng.choice(pool[: 3000 // (turn % 5 + 1)], int(rng.integers(1, 900)))) for _ in range(6)]
        sets += [np.unique(np.r_[rng.permutation(s)[: max(1, len(s) * 7 // 8)], pool[:1]]) for s in sets] * 2
        n = np.array([len(s) for s in sets])
        maps = crossing.Maps(n, crossing.bit_maps(np.concatenate(sets), n), 75)
        for i, one in enumerate(sets):
            at, _ = maps.near(i, np.arange(len(sets)) != i)
            shared = [len(np.intersect1d(one, s)) for s in sets]
            linked = {j for j, k in enumerate(shared) if j != i and 100 * k >= 75 * (len(one) + n[j] - k)}
            assert linked <= set(at.tolist())


def test_shingles_of_short_texts():
    grams, sizes = shingle_sets([b"", b"a b", b"A b", b"a b c d e f", b"x"], WordHashes(), 5)
    assert sizes.tolist() == [0, 1, 1, 2, 1]
    assert grams[0] == grams[1]


def test_shards_of_one_set_grow_with_its_partners(spark, monkeypatch):
    monkeypatch.setattr(similar, "SALT_BYTES", 200, raising=False)
    monkeypatch.setattr(similar, "SHARD_BYTES", 2000, raising=False)
    wide = 2**63 // 5000
    rows = [(i * wide, f"{i:020d}", 20) for i in range(5000)]
    texts = spark.createDataFrame(rows, "name long, text string, bytes long")
    pairs = texts.filter("name > 0").selectExpr("0L AS x", "name AS y")

    def gathered(left, right):
        return pa.table({"x": [len(left)], "y": [len(right)]})

    monkeypatch.setattr(similar, "_linked", gathered)
    got = similar.verified(pairs, texts, 4).collect()
    assert sum(r.y for r in got) == 4999
    assert max(r.x for r in got) == 1 and 20 * max(r.y for r in got) <= 5 * 2000


def test_texts_without_pairs_do_not_move(spark, monkeypatch):
    monkeypatch.setattr(similar, "is_small", lambda table: True, raising=False)
    texts = spark.createDataFrame([(i, f"a b c d e f {i // 2 * 2}", 20) for i in range(40)], "name long, text string, bytes long")
    pairs = spark.createDataFrame([(2, 3), (2, 4), (6, 7)], "x long, y long")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = similar.verified(pairs, texts, 2)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
        assert sorted(map(tuple, found.collect())) == [(2, 3), (6, 7)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(50, 51), (50, 52), (60, 50)]
    rows = components(spark.createDataFrame(chain, "x long, y long")).collect()
    assert {r.name: r.label for r in rows} == {i: 1 for i in range(1, 41)} | {i: 50 for i in (50, 51, 52, 60)}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_classes_are_joined_by_links_between_them(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (8, 8), (9, 8)], "name long, label long")
    links = spark.createDataFrame([(2, 4), (1, 2), (0, 9), (20, 21), (21, 4)], "x long, y long")
    got = {r.name: r.label for r in similar.merged(labels, links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 20: 1, 21: 1, 0: 0, 8: 0, 9: 0}
    assert similar.merged(labels, links.limit(0)).count() == 6
