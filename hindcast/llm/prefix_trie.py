"""The prefix trie of conversations, measured along its Euler tour."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.operators.spread import in_order, ranked, spread_join, task_of
from hindcast.sources.shared import settle

BLOCK, HEADS = 100, 6
# A prefix has two names: sums of its turns' hashes times powers of an odd base, in 64-bit arithmetic.
# Bases are odd, so that powers have inverses and a prefix can be moved along its conversation.
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES)
# Nodes whose arcs are ranked in one task.
TASK_NODES = 50_000
CHUNK_BYTES = 1 << 16


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _unsigned(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return _column(batch, name).view(np.uint64)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place and prefix names of each turn among those of its conversation in this task."""
    last, count, sums = None, 0, [np.uint64(0), np.uint64(0)]
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = _column(batch, "conv_id")
        starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        goes_on = last is not None and conv[0] == last
        segment = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(conv)]))
        place = np.arange(len(conv)) - starts[segment] + np.where(segment == 0, count if goes_on else 0, 0)
        out = [batch.column("conv_id"), _longs(place)]
        for lane in (0, 1):
            terms = _unsigned(batch, f"t{lane}") * np.power(_BASES[lane], place.astype(np.uint64))
            total = np.cumsum(terms, dtype=np.uint64)
            upto = total - (total[starts] - terms[starts])[segment]
            upto[segment == 0] += sums[lane] if goes_on else np.uint64(0)
            out += [_longs(upto - terms), _longs(upto)]
            sums[lane] = upto[-1]
        last, count = conv[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*out, batch.column("chars"), batch.column("_at")], _TURN)


_TURN = ["conv_id", "place", "q0", "p0", "q1", "p1", "chars", "_at"]


def ordered_turns(table: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv_id, place, q0, p0, q1, p1, chars`` of all turns: place from 0, prefix names before and after.

    Turns are put in order by ranges, so that one conversation may lie in many tasks. Each
    task sums up its own; what conversations bring along from the tasks before is one
    row a task, worked out from the last rows of the tasks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = table.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        *[F.xxhash64(F.lit(lane), role, text).alias(f"t{lane}") for lane in (0, 1)],
        F.char_length(text).cast("long").alias("chars"),
    )
    # Equal rows may go in any order, but not all to one task.
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    kinds = ", ".join(f"{c} long" for c in _TURN)
    placed = in_order(rows, "conv_id", F.col("turn").asc_nulls_first(), "t0", "t1", "row").drop("row", "turn")
    placed = settle(placed.mapInArrow(_prefixes, kinds).withColumn("task", task_of(F.col("_at"))), "turns")
    ends = placed.groupBy("task").agg(F.min("conv_id").alias("first"), F.max(F.struct("_at", "conv_id", "place", "p0", "p1")).alias("last"))
    brought = _brought(ends.orderBy("task").collect())

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: batch.column(c) for c in _TURN[:-1]}
            task, conv, place = (_column(batch, c) for c in ("task", "conv_id", "place"))
            for t in np.unique(task).tolist():
                if t in brought:
                    of, count, before = brought[t]
                    rows = np.flatnonzero((task == t) & (conv == of))
                    place = place.copy()
                    place[rows] += count
                    out["place"] = _longs(place)
                    for lane in (0, 1):
                        power = np.power(_BASES[lane], np.uint64(count))
                        for end in "qp":
                            name = f"{end}{lane}"
                            values = out[name].to_numpy().view(np.uint64).copy()
                            values[rows] = before[lane] + power * values[rows]
                            out[name] = _longs(values)
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return placed.mapInArrow(complete, ", ".join(f"{c} long" for c in _TURN[:-1]))


def _brought(ends: list) -> dict[int, tuple]:
    """By task: the conversation that goes on in it, its turns before, and their prefix names."""
    out, open_ = {}, None
    for row in ends:
        last = row["last"]
        count = last["place"] + 1
        names = [np.array([last[f"p{lane}"]], np.int64).view(np.uint64) for lane in (0, 1)]
        if open_ is not None and row["first"] == open_[0]:
            out[row["task"]] = open_
            if last["conv_id"] == open_[0]:
                names = [open_[2][lane] + np.power(_BASES[lane], np.uint64(open_[1])) * names[lane] for lane in (0, 1)]
                count += open_[1]
        open_ = (last["conv_id"], count, names)
    return out


def _heads(conv: Column) -> Column:
    """How many turns a conversation takes from the first one of its block."""
    return (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("long")


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Own turns after the head, at their new depth, with the names of their prefixes there."""
    for batch in batches:
        conv, place, head, taken, size = (_column(batch, c) for c in ("conv_id", "place", "head", "taken", "size"))
        names = []
        for lane in (0, 1):
            # A conversation whose block's first one is short moves up by as many turns.
            factor = np.power(_INVERSES[lane], (head - taken).astype(np.uint64))
            for end in "pq":
                names.append(_longs(_unsigned(batch, f"b{lane}") + factor * (_unsigned(batch, f"{end}{lane}") - _unsigned(batch, f"h{lane}"))))
        yield pa.RecordBatch.from_arrays(
            [_longs(conv), _longs(taken + place - head + 1), names[0], names[2], names[1], names[3], batch.column("chars"), _longs(place == size - 1)], _PREFIX
        )


_PREFIX = ["conv_id", "depth", "k0", "k1", "up0", "up1", "chars", "ends"]


def rebuilt_prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All prefixes of the rebuilt conversations, and the conversations themselves.

    A prefix has ``conv_id, depth``, its names ``k0, k1`` and its parent's, the code points
    of its last text, and whether the conversation ends there. Conversations have ``total`` turns.
    """
    head = _heads(F.col("conv_id"))
    at_head = [F.coalesce(F.max(F.when(F.col("place") == head - 1, F.col(f"p{lane}"))), F.lit(0)).alias(f"h{lane}") for lane in (0, 1)]
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("size"), *at_head)
    firsts = turns.filter((F.col("conv_id") % BLOCK == 0) & (F.col("place") < HEADS - 1))
    firsts = firsts.groupBy(F.col("conv_id").alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "p0", "p1", "chars"))).alias("first"))
    convs = convs.withColumn("head", head).withColumn("block", F.col("conv_id") - F.col("conv_id") % BLOCK).join(firsts, "block", "left")
    convs = convs.withColumn("first", F.when(F.col("head") > 0, F.slice("first", 1, F.col("head").cast("int"))))
    convs = convs.withColumn("taken", F.when(F.col("first").isNull(), 0).otherwise(F.size("first")).cast("long"))
    convs = convs.withColumn("total", F.col("taken") + F.greatest(F.col("size") - F.col("head"), F.lit(0)))
    names = [F.coalesce(F.element_at("first", -1)[f"p{lane}"], F.lit(0).cast("long")).alias(f"b{lane}") for lane in (0, 1)]
    convs = settle(convs.select("conv_id", "size", "head", "h0", "h1", "first", "taken", "total", *names), "convs")

    own = turns.filter(F.col("place") >= head)
    own = spread_join(own, convs.drop("first", "total"), "conv_id", F.col("place"))
    own = own.mapInArrow(_shifted, ", ".join(f"{c} long" for c in _PREFIX))
    before = F.when(F.col("i") > 0, F.get("first", F.col("i") - 1))
    given = convs.filter("taken > 0").select("conv_id", "first", "taken", "total", F.posexplode("first").alias("i", "turn"))
    given = given.select(
        "conv_id",
        (F.col("i") + 1).cast("long").alias("depth"),
        F.col("turn.p0").alias("k0"),
        F.col("turn.p1").alias("k1"),
        *[F.coalesce(before[f"p{lane}"], F.lit(0).cast("long")).alias(f"up{lane}") for lane in (0, 1)],
        F.col("turn.chars").alias("chars"),
        (F.col("i") + 1 == F.col("total")).cast("long").alias("ends"),
    )
    return settle(own.unionByName(given), "prefixes"), convs


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one node's ids as text, in pieces of bounded size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [_column(batch, c) for c in ("depth", "k0", "k1")]
        conv = _column(batch, "conv_id")
        new = np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]
        # Twenty signs and a comma a number, at most.
        starts = np.flatnonzero(new)
        pieces = [p for a, b in zip(starts, np.r_[starts[1:], len(conv)], strict=True) for p in range(a, b, CHUNK_BYTES // 21)]
        ends = [*pieces[1:], len(conv)]
        texts = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(pieces, ends, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*[_longs(k[pieces]) for k in keys], _longs(conv[pieces]), pa.array(texts, pa.string())], ["depth", "k0", "k1", "first", "ids"]
        )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, joined by commas; a node's pieces follow each other."""
    key, state = None, None

    def done(key, state) -> pa.RecordBatch:
        arrays = [pa.array([k], pa.int64()) for k in key]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([state.hexdigest()])], ["depth", "k0", "k1", "ends_sha256"])

    for batch in batches:
        for *new, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "k0", "k1", "ids")), strict=True):
            if new != key:
                if state is not None:
                    yield done(key, state)
                key, state = new, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if state is not None:
        yield done(key, state)


def hashes_of_ends(ends: DataFrame) -> DataFrame:
    """``depth, k0, k1, ends_sha256``: SHA-256 of each node's ids in order, joined by commas.

    A hash reads its input in one go, so one task hashes all ids of a node; before, the ids are
    put in order by ranges and joined to pieces of ``CHUNK_BYTES``, which that task reads as a stream.
    """
    key = ["depth", "k0", "k1"]
    rows = ends.select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
    pieces = rows.mapInArrow(_chunks, "depth long, k0 long, k1 long, first long, ids string")
    pieces = pieces.repartition(*key).sortWithinPartitions(*key, "first")
    return pieces.mapInArrow(_hashed, "depth long, k0 long, k1 long, ends_sha256 string")


def contracted(arc: np.ndarray, after: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains that arcs form among themselves, by pointer doubling.

    Gives for each arc the place of its chain's first arc and the sums of the weights from there
    to it, and the places of the chains' last arcs. ``arc`` is sorted.
    """
    at = np.minimum(np.searchsorted(arc, after), len(arc) - 1)
    inside = arc[at] == after
    before = np.full(len(arc), -1)
    before[at[inside]] = np.flatnonzero(inside)
    head, sums = np.arange(len(arc)), weights.copy()
    while True:
        rows = np.flatnonzero(before >= 0)
        if not len(rows):
            return head, sums, np.flatnonzero(~inside)
        back = before[rows]
        sums[rows] += sums[back]
        head[rows] = head[back]
        before[rows] = before[back]


_SUMS = ["pos", "leaves", "saved"]
_CHAINS = "head long, after long, " + ", ".join(f"{c} long" for c in _SUMS)
_NODE_ARCS = [f"{end}_{c}" for end in ("enter", "exit") for c in ("head", *_SUMS)]


def _nulls(names: list[str], rows: int) -> dict[str, pa.Array]:
    return {n: pa.nulls(rows, pa.int64()) for n in names}


def _tour_chains(block: pa.Table) -> pa.Table:
    """Enter and exit arcs of the nodes of one block, contracted: a row for each node, then one for each chain."""
    block = block.sort_by("id")
    node, child, sibling, parent, own = (block[c].to_numpy() for c in ("id", "child", "sibling", "parent", "own"))
    arc = np.empty(2 * len(node), np.int64)
    arc[0::2], arc[1::2] = 2 * node, 2 * node + 1
    after = np.empty(len(arc), np.int64)
    leaf = child < 0
    after[0::2] = np.where(leaf, 2 * node + 1, 2 * child)
    after[1::2] = np.where(sibling >= 0, 2 * sibling, np.where(parent >= 0, 2 * parent + 1, -1))
    weights = np.zeros((len(arc), 3), np.int64)
    weights[:, 0] = 1
    weights[0::2, 1], weights[0::2, 2] = leaf, own
    head, sums, last = contracted(arc, after, weights)
    nodes = {"id": _longs(node), **{n: _longs(v) for n, v in zip(_NODE_ARCS, [
        arc[head[0::2]], *sums[0::2].T, arc[head[1::2]], *sums[1::2].T,
    ], strict=True)}}
    chains = {"head": _longs(arc[head[last]]), "after": _longs(after[last]), **{c: _longs(sums[last, i]) for i, c in enumerate(_SUMS)}}
    first = pa.table(nodes | _nulls(list(chains), len(node)))
    return pa.concat_tables([first, pa.table(_nulls(list(nodes), len(last)) | chains).select(first.column_names)])


def _chain_chains(block: pa.Table) -> pa.Table:
    """Chains of one block, contracted again: a row for each (with ``of``), then one for each longer chain."""
    block = block.sort_by("head")
    arc, after = block["head"].to_numpy(), block["after"].to_numpy()
    weights = np.column_stack([block[c].to_numpy() for c in _SUMS])
    head, sums, last = contracted(arc, after, weights)
    # Of each chain, what lies before it in the longer one.
    own = {"of": _longs(arc), "head": _longs(arc[head]), "after": pa.nulls(len(arc), pa.int64())}
    own |= {c: _longs((sums - weights)[:, i]) for i, c in enumerate(_SUMS)}
    chains = {"of": pa.nulls(len(last), pa.int64()), "head": _longs(arc[head[last]]), "after": _longs(after[last])}
    chains |= {c: _longs(sums[last, i]) for i, c in enumerate(_SUMS)}
    return pa.concat_tables([pa.table(own), pa.table(chains)])


def _doubled(chains: DataFrame) -> DataFrame:
    """``head, pos, leaves, saved``: what lies before each chain, by pointer doubling over all of them."""
    rows = chains.select("head", F.when(F.col("after") >= 0, F.col("after")).alias("after"), *_SUMS)
    while not rows.filter("after IS NOT NULL").isEmpty():
        ahead = rows.select(F.col("head").alias("after"), F.col("after").alias("next"), *[F.col(c).alias(f"more_{c}") for c in _SUMS])
        rows = rows.join(ahead, "after", "left")
        rows = settle(rows.select("head", F.col("next").alias("after"), *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in _SUMS]), "doubled")
    # Each row now has the sums from its chain to the end; the first chain has the whole tour's.
    whole = rows.agg(F.max(F.struct(*_SUMS)).alias("most")).first()["most"]
    return rows.select("head", *[(F.lit(whole[c]) - F.col(c)).alias(c) for c in _SUMS])


def _before(chains: DataFrame) -> DataFrame:
    """``head, pos, leaves, saved``: what lies before each chain on the tour.

    Chains of neighbouring blocks are contracted together, as many as fit a task, until one
    task has all that are left; where that stops to shrink them, by pointer doubling.
    """
    counts = chains.groupBy(F.floor(F.col("head") / (2 * TASK_NODES)).alias("block")).agg(F.count("*").alias("n")).orderBy("block").collect()
    groups, group, filled = [], 0, 0
    for row in counts:
        if filled and filled + row["n"] > 2 * TASK_NODES:
            group, filled = group + 1, 0
        groups.append((row["block"], group))
        filled += row["n"]
    total = sum(row["n"] for row in counts)
    block = F.floor(F.col("head") / (2 * TASK_NODES)).alias("block")
    of = chains.sparkSession.createDataFrame(groups, "block long, part long")
    dealt = chains.withColumn("block", block).join(F.broadcast(of), "block").drop("block")
    out = settle(dealt.groupBy("part").applyInArrow(_chain_chains, f"of long, {_CHAINS}"), "chains")
    longer = out.filter("of IS NULL").drop("of")
    inside = out.filter("of IS NOT NULL")
    if group == 0:
        return inside.select(F.col("of").alias("head"), *_SUMS)
    left = longer.count()
    above = _before(longer) if 2 * left <= total else _doubled(longer)
    above = above.select("head", *[F.col(c).alias(f"more_{c}") for c in _SUMS])
    joined = inside.join(above, "head")
    return settle(joined.select(F.col("of").alias("head"), *[(F.col(c) + F.col(f"more_{c}")).alias(c) for c in _SUMS]), "before")


def toured(nodes: DataFrame) -> DataFrame:
    """Measures of subtrees from prefix sums along the Euler tour.

    ``nodes`` has ``id`` (0 to n - 1, so that nodes near each other on the tour mostly have ids near
    each other), ``parent`` (null for the root) and ``own`` (a node's saving). Returns ``id,
    n_children, n_leaves, saved, enter_at, exit_at``, the last two being positions on the tour.
    Children follow each other by id.
    """
    children = nodes.filter("parent IS NOT NULL").groupBy("parent").agg(F.min("id").alias("child"), F.count("*").alias("n_children"))
    children = children.withColumnRenamed("parent", "id")
    order = ranked(nodes.filter("parent IS NOT NULL").select("parent", "id"), "rank", "parent", "id")
    following = order.select((F.col("rank") - 1).alias("rank"), F.col("parent").alias("of"), F.col("id").alias("sibling"))
    siblings = order.join(following, "rank").filter("parent = of").select("id", "sibling")
    rows = nodes.join(children, "id", "left").join(siblings, "id", "left")
    none = F.lit(-1).cast("long")
    rows = rows.select("id", "own", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), *[F.coalesce(c, none).alias(c) for c in ("parent", "child", "sibling")])
    rows = settle(rows, "tour")
    parts = ", ".join(f"{c} long" for c in ("id", *_NODE_ARCS))
    dealt = rows.drop("n_children").withColumn("block", F.floor(F.col("id") / TASK_NODES))
    out = settle(dealt.groupBy("block").applyInArrow(_tour_chains, f"{parts}, {_CHAINS}"), "arcs")
    before = _before(out.filter("id IS NULL").select("head", "after", *_SUMS))
    arcs = out.filter("id IS NOT NULL").select("id", *_NODE_ARCS)
    for end in ("enter", "exit"):
        above = before.select(F.col("head").alias(f"{end}_head"), *[F.col(c).alias(f"{end}_more_{c}") for c in _SUMS])
        arcs = arcs.join(above, f"{end}_head")

    def total(end: str, what: str) -> Column:
        return F.col(f"{end}_{what}") + F.col(f"{end}_more_{what}")

    measured = arcs.join(rows.select("id", "own", "n_children"), "id")
    leaf = (F.col("n_children") == 0).cast("long")
    return measured.select(
        "id",
        "n_children",
        (total("exit", "leaves") - total("enter", "leaves") + leaf).alias("n_leaves"),
        (total("exit", "saved") - total("enter", "saved") + F.col("own")).alias("saved"),
        total("enter", "pos").alias("enter_at"),
        total("exit", "pos").alias("exit_at"),
    )


def prefix_trie(
    table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """The trie of the rebuilt conversations, a row for each node.

    A conversation c takes the first h turns of conversation c - c % 100 (h = crc32 of c in decimal
    % 6), then its own turns after its first h; remainders have the sign of c. Returns ``conv_id`` (the node's smallest member), ``depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, enter_at, exit_at``.

    Turns go by ``turn`` (null first), equal turns by hash of role and text, so their order is always
    the same; null roles and texts are empty texts; repeated rows are turns of their own; rows
    without a conversation are left out; other columns are not read; an empty table has
    no node. Texts of any length are hashed where they are read and do not move. Prefixes are
    told apart by 128-bit names.

    Arcs that enter and leave the nodes form the Euler tour. Nodes are numbered along smallest member and
    depth, so that a task's block of them holds long chains of the tour; each block
    contracts its chains, what is left is ranked likewise, and positions and sums come from there.
    """
    turns = ordered_turns(table, conv_col, turn_col, role_col, text_col)
    prefixes, convs = rebuilt_prefixes(turns)
    key = ["depth", "k0", "k1"]
    zero = F.lit(0).cast("long")
    inner = prefixes.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"), F.min("up0").alias("up0"), F.min("up1").alias("up1")
    )
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select("*", *[zero.alias(c) for c in (*key, "chars")], *[F.lit(None).cast("long").alias(c) for c in ("up0", "up1")])
    nodes = settle(ranked(inner.unionByName(root), "id", "conv_id", "depth"), "nodes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k0").alias("up0"), F.col("k1").alias("up1"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    family = spread_join(nodes, parents, ["depth", "up0", "up1"], F.col("id"), "left")
    family = settle(family.drop("up0", "up1").withColumn("own", (F.col("n_convs") - 1) * F.col("chars")), "family")
    measured = toured(family.select("id", "parent", "own"))
    ends = prefixes.filter("ends = 1").select(*key, "conv_id")
    ends = ends.unionByName(convs.filter("total = 0").select(*[zero.alias(c) for c in key], "conv_id"))
    out = family.join(measured, "id").join(hashes_of_ends(ends), key, "left")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        "enter_at",
        "exit_at",
    )
