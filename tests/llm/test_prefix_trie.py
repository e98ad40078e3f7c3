import hashlib
import random
import zlib

import numpy as np
import pytest
from texts import SF_DIR, prose

from hindcast.llm import prefix_trie, queries

NAMES = "conv_id long, turn long, role string, text string, place long, depth long, k0 string"


def rebuilt(rows):
    """``{conv_id: [(role, text), ...]}``; rows with equal turns keep the order given."""
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in convs.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        block = (abs(c) - abs(c) % 100) * (1 if c > 0 else -1)
        out[c] = own.get(block, [])[:h] + turns[h:]
    return out


def brute(rows):
    convs = {c: tuple(t) for c, t in rebuilt(rows).items()}
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    children = {}
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        ends = ",".join(str(c) for c in sorted(c for c in members if len(convs[c]) == len(path)))
        out.append((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children.get(path, [])),
            sum(p not in children for p in below), sum((len(nodes[p]) - 1) * len(p[-1][1]) if p else 0 for p in below),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=lambda r: r[:2])


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, None, None, "x") for r in rows], NAMES).repartition(parts)
    found = prefix_trie.prefix_trie(df).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in found) == brute(rows)
    # The tour enters and leaves every node once; subtrees lie within those above them.
    places = sorted(p for r in found for p in (r.enter_at, r.exit_at))
    assert places == list(range(1, 2 * len(found) + 1))
    spans = {(r.conv_id, r.depth): (r.enter_at, r.exit_at) for r in found}
    for r in found:
        if r.depth:
            low, high = spans[r.parent_conv_id, r.depth - 1]
            assert low < r.enter_at < r.exit_at < high


def some(rng, convs, first=0, step=1):
    texts = ["", "a", "bb", "😀é", "same again"]
    rows = []
    for c in range(first, first + convs * step, step):
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(texts)) for t in range(rng.randrange(1, 9))]
    return rows


def test_random(spark):
    rng = random.Random(1)
    rows = some(rng, 230) + some(rng, 30, 1050, 7) + some(rng, 20, -630, 13)
    rng.shuffle(rows)
    check(spark, rows)


@pytest.mark.parametrize("task_nodes", [3, 20])
def test_small_tasks(spark, monkeypatch, task_nodes):
    """Chains that run through many blocks, contracted several times and doubled at last."""
    rng = random.Random(2)
    monkeypatch.setattr(prefix_trie, "TASK_NODES", task_nodes)
    monkeypatch.setattr(prefix_trie, "CHUNK_BYTES", 64)
    rows = some(rng, 60) + [(500, t, "user", f"long {t}") for t in range(200)] + [(c, 0, "user", "x") for c in range(600, 640)]
    rng.shuffle(rows)
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (3, None, None, None), (3, 5, "user", None), (3, 2, "", "b"), (100, 1, "user", prose(1, 30_000))]
    rows += [(101, 1, "user", "first"), (102, None, "user", "only"), (199, 1, "user", "z" * 5000), (2**62, 1, "user", "far"), (-5, 1, "user", "below")]
    check(spark, rows)
    check(spark, [])
    check(spark, [(None, None, None, None)])
    check(spark, [(7, 0, "user", "alone")])


def test_repeated_rows_and_equal_turns(spark):
    rows = [(100, 1, "user", "same")] * 40 + [(c, t, "user", "same") for c in range(100, 140) for t in range(6)]
    check(spark, rows, 5)


def test_one_conversation_in_all_tasks(spark):
    rows = [(200, t, "user", f"turn {t}") for t in range(300)] + [(c, t, "user", f"turn {t}") for c in range(201, 230) for t in range(5)]
    check(spark, rows, 7)


def test_contraction():
    arc = np.array([1, 4, 6, 9])
    head, sums, last = prefix_trie.contracted(arc, np.array([9, 77, 1, 5]), np.ones((4, 1), np.int64))
    assert arc[head].tolist() == [6, 4, 6, 6] and sums[:, 0].tolist() == [2, 1, 1, 3] and arc[last].tolist() == [4, 9]


def test_query(spark):
    rows = [tuple(r) for r in queries.table(spark, SF_DIR, "conversations").select("conv_id", "turn", "role", "text").collect()]
    found = queries.op11_conversation_trie(spark, SF_DIR).select(*COLUMNS).collect()
    assert sorted(map(tuple, found)) == brute(rows)
