import random
import re

import numpy as np
import pyarrow as pa
import pytest
from texts import ODD, SF_DIR, prose

from hindcast.llm import chosen_paths, queries
from hindcast.llm.chosen_paths import near_duplicates
from hindcast.operators import spread

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def brute(rows):
    """``{row number: (n_shingles, component_id, kept)}`` by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(d, len(s), least.get(find(i)) if s else d, d == (least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def key(row):
    return tuple((v is not None, v if v is not None else 0) for v in row)


def check(documents, rows):
    found = near_duplicates(documents(rows)).drop("text_hash").collect()
    assert sorted(map(tuple, found), key=key) == sorted(brute(rows), key=key)


def edited(text, rng, changes):
    words = text.split()
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_odd_texts(documents):
    check(documents, [*ODD, (9, "again AND again"), (10, "a"), (11, None), (12, "a b c"), (13, "a b c d")])


def test_nothing(documents):
    check(documents, [])
    check(documents, [(1, None), (2, "")])


def test_copies_at_all_distances(documents):
    rng = random.Random(3)
    rows, at = [], 0
    for seed in range(40):
        text = prose(seed, 200)
        for changes in (0, 0, 2, 5, 8, 11, 14):
            rows.append((at, edited(text, rng, changes)))
            at += 1
    rng.shuffle(rows)
    check(documents, rows)


def test_short_sets_about_the_threshold(documents):
    words = [f"t{i}" for i in range(30)]
    rows = [(i, " ".join(words[i % 5 : i % 5 + 8 + i // 5])) for i in range(60)]
    check(documents, rows)


@pytest.mark.parametrize("limits", [(1, 1, 3, 4), (2, 4, 2, 8), (1, 100, 2, 8)])
def test_deep_trees_and_blocks(documents, monkeypatch, limits):
    """Texts that share much and do not link, with nodes of hardly any sets and few levels."""
    for name, value in zip(("SMALL", "PAIRS", "DEPTH", "BLOCK"), limits, strict=True):
        monkeypatch.setattr(chosen_paths, name, value)
    monkeypatch.setattr(spread, "KEY_ROWS", 3)
    rng = random.Random(5)
    shared = prose(1, 150)
    rows = [(i, shared + " " + prose(100 + i, 40)) for i in range(60)]
    rows += [(100 + i, edited(shared, rng, 3 + i % 6)) for i in range(40)]
    rows += [(200 + i, rows[i][1]) for i in range(20)]
    rng.shuffle(rows)
    check(documents, rows)


def test_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    both = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
    one, two = np.r_[both, rng.integers(0, 1 << 63, 100, dtype=np.uint64)], np.r_[both, rng.integers(0, 1 << 63, 100, dtype=np.uint64)]
    rates = []
    for _ in range(50):
        salt = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
        sig = chosen_paths.minwise(np.r_[one ^ salt, two ^ salt], np.array([900, 900]))
        rates.append((sig[0] == sig[1]).sum())
    assert abs(np.mean(rates) - chosen_paths.COORDINATES * 0.8) < 2 and min(rates) >= chosen_paths.AGREE


def test_dropping_copies(documents):
    rows = [(3, "one two three four five"), (1, "One two three four five"), (2, "other words are in this one"), (None, "")]
    docs = documents(rows)
    kept = chosen_paths.drop_near_duplicates(docs, near_duplicates(docs))
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "2", "None"]


def test_query_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, SF_DIR, "documents").select("doc_id", "text").collect()]
    found = queries.op12_minhash_near_dedup(spark, SF_DIR).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, found)) == sorted(brute(rows))


def test_a_group_gives_fewer_pairs_than_sets():
    """However many of its sets may link, and such that classes stay joined."""
    rng, n = np.random.default_rng(5), 300
    base = rng.integers(0, 256, chosen_paths.COORDINATES, np.uint8)
    sketches = np.where(rng.random((n, chosen_paths.COORDINATES)) < 0.1, rng.integers(0, 256, (n, chosen_paths.COORDINATES), np.uint8), base)
    bucket = pa.table(
        {
            "part": np.zeros(n, np.int64),
            "few": np.ones(n, bool),
            "own": np.ones(n, bool),
            "name": np.arange(n) * 7,
            "label": np.arange(n) * 7,
            "n": np.full(n, 100),
            "sketch": [s.tobytes() for s in sketches],
        }
    )
    found = chosen_paths._compared(True)(bucket)
    assert len(found) == n - 1
    reached, pairs = {0}, set(zip(found["one"].to_pylist(), found["two"].to_pylist()))
    for _ in range(n):
        reached |= {x for a, b in pairs if a in reached or b in reached for x in (a, b)}
    assert reached == set(range(0, 7 * n, 7))
    one = chosen_paths._compared(False)(bucket)
    assert len(set(one["one"].to_pylist())) == len(one) == n - 1
