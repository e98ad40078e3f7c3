"""N-gram Jaccard join by PartEnum signatures, and the classes of linked documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.blocks import WordHashes, blocks, mixed, raw_texts, shingle_sets
from hindcast.llm.crossing import Crossing, labelled
from hindcast.operators.spread import broadcast_small, is_small
from hindcast.sources.shared import settle

SHINGLE = 5
# A pair links if 100 * shared >= SHARE * union.
SHARE = 75
# Two sets of sizes a and b have a Jaccard similarity of 3/4 or more exactly if they differ in
# at most (a + b) / 7 elements.
# A set's profile counts its elements by class; there are as many classes as give each four to
# eight elements, within these bounds, so that unrelated sets of any size differ by profile.
CLASS_BITS = (4, 14)
# Mean features in a partition for the largest sets of a level.
FILL = 2.3
SIGNATURES_PER_BUCKET = 1_000_000
# Groups up to this size are compared in full at once.
SMALL_GROUP = 4
PAIRS_AT_ONCE = 1024
# Turns in which each set of a larger group is compared with the nearest one of another class.
MERGE_TURNS = 1
# A shingle that comes this often in one block of texts may be a frequent one.
OFTEN_IN_BLOCK = 4
FREQUENT_SHARE, FREQUENT_LEAST, FREQUENT_MOST = 1 / 2000, 32, 4_000_000
# Texts are compared in shards of so many bytes on average. The partners of one set are dealt over
# 16 salts, or over more so that those under one salt have so many bytes on average.
SHARD_BYTES, SALT_BYTES, SALTS = 16 << 20, 1 << 20, 16
_HALF = np.uint64(32)
_FLAG = 1 << 15


def most_differing(n: np.ndarray) -> np.ndarray:
    """In how many elements a set of size ``n`` can differ from any set it links to."""
    return (n + 4 * n // 3) // 7


def _set_hashes(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for empty ones."""
    out = np.zeros(len(sizes), np.uint64)
    full = sizes > 0
    if full.any():
        starts = (np.cumsum(sizes) - sizes)[full]
        out[full] = mixed(np.add.reduceat(mixed(mixed(grams ^ np.uint64(0x5851F42D4C957F2D))), starts) + sizes[full].astype(np.uint64))
    return out


def profiles(grams: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """How many elements of each set fall into each of its classes, as 16-bit numbers."""
    classes = 1 << np.clip(np.log2(np.maximum(sizes, 1)).astype(np.int64) - 2, *CLASS_BITS)
    ends = np.cumsum(classes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = (ends - classes)[owner] + (mixed(grams) & (classes[owner] - 1).astype(np.uint64)).astype(np.int64)
    counts = np.minimum(np.bincount(at, minlength=int(classes.sum())), 65535).astype(np.uint16)
    return [counts[e - c : e].tobytes() for e, c in zip(ends.tolist(), classes.tolist(), strict=True)]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text, and one for each shingle that many texts of a block have."""
    words_of = WordHashes()
    for batch in blocks(batches):
        grams, sizes = shingle_sets(raw_texts(batch), words_of, SHINGLE)
        value, times = np.unique(grams, return_counts=True)
        value, times = value[times >= OFTEN_IN_BLOCK], times[times >= OFTEN_IN_BLOCK]
        n, more = len(sizes), len(value)
        none = pa.nulls(more, pa.int64())
        profile = profiles(grams, sizes)
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([batch.column("doc_id"), none]),
                pa.concat_arrays([batch.column("text_hash"), none]),
                pa.concat_arrays([pa.array(sizes.astype(np.int64)), none]),
                pa.concat_arrays([pa.array(_set_hashes(grams, sizes).view(np.int64)), none]),
                pa.array(profile + [None] * more, pa.binary()),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(value.view(np.int64))]),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(times.astype(np.int64))]),
            ],
            ["doc_id", "text_hash", "n", "set_hash", "profile", "shingle", "times"],
        )


def signatures(grams: np.ndarray, sizes: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures: (signature, place of its set).

    A level has sets of up to twice its smallest size and a number of partitions of the shingle
    domain; pairs meet at the level of their larger set, so a set also takes part in the next
    level if a set it links to can lie there. Of the partitions in order, a set enumerates as
    many non-empty ones as it can differ in plus one: of two linked sets, the one that goes less
    far then has a partition where both agree. Frequent shingles are left out, which only brings
    sets nearer to each other. Sets left with too few partitions enumerate all of them, and in
    addition single shingles of the whole set, lowest hashes first, by which they meet each other.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    need = most_differing(sizes) + 1
    rare = np.ones(len(grams), bool)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
        rare = frequent[at] != grams
    level = np.log2(np.maximum(sizes, 1)).astype(np.int64)
    upper = np.log2(np.maximum(4 * sizes // 3, 1)).astype(np.int64)
    spread = mixed(grams ^ np.uint64(0x2545F4914F6CDD1D))
    out, of, poor = [], [], np.zeros(len(sizes), bool)
    for step in (0, 1):
        part = rare & (level + step <= upper)[owner]
        at, own = np.flatnonzero(part), owner[part]
        lev = level[own] + step
        count = np.maximum((2.0 ** (lev + 1) / FILL).astype(np.uint64), np.uint64(1))
        slot = (spread[at] >> _HALF) * count >> _HALF
        key = own.astype(np.uint64) << _HALF | slot
        order = np.argsort(key, kind="stable")
        key, own, lev, at = key[order], own[order], lev[order], at[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        content = np.add.reduceat(mixed(grams[at]), starts) if len(key) else np.zeros(0, np.uint64)
        own, lev, slot = own[starts], lev[starts], key[starts] & np.uint64(0xFFFFFFFF)
        filled = np.bincount(own, minlength=len(sizes))
        rank = np.arange(len(own)) - (np.cumsum(filled) - filled)[own]
        kept = rank < need[own]
        out.append(mixed(content[kept] + mixed(lev[kept].astype(np.uint64) << _HALF | slot[kept])))
        of.append(own[kept])
        poor |= (filled < need) & (level + step <= upper) & (sizes > 0)
    at = np.flatnonzero(poor[owner])
    order = at[np.lexsort((spread[at], owner[at]))]
    number = np.where(poor, sizes, 0)
    rank = np.arange(len(order)) - (np.cumsum(number) - number)[owner[order]]
    order = order[rank < need[owner[order]]]
    out.append(mixed(spread[order]))
    of.append(owner[order])
    return np.concatenate(out), np.concatenate(of)


def _group_names(kept: np.ndarray, bucket: np.ndarray | int, n_buckets: int) -> np.ndarray:
    """Names of the groups of signatures, from the five bytes that are packed of each and its bucket."""
    kept = kept & np.uint64((1 << 40) - 1)
    return (kept * np.uint64(n_buckets) + np.asarray(bucket).astype(np.uint64)).view(np.int64)


def _buckets(shared, n_buckets: int):
    """Signatures of each block's different sets, packed for each bucket: five bytes of signature
    and two that name the set. Where a block has many sets under one signature, one stands for
    them (marked); the others are told apart at once, so no signature is a large group."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, frequent = WordHashes(), shared.value
        for batch in blocks(batches):
            for start in range(0, batch.num_rows, _FLAG):
                yield from packed(raw_texts(batch.slice(start, _FLAG)), words_of, frequent)

    def packed(texts: list[bytes], words_of: WordHashes, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
        grams, sizes = shingle_sets(texts, words_of, SHINGLE)
        name = _set_hashes(grams, sizes)
        _, one = np.unique(name, return_index=True)
        one = one[sizes[one] > 0]
        chosen = np.zeros(len(sizes), bool)
        chosen[one] = True
        grams, sizes, name = grams[np.repeat(chosen, sizes)], sizes[chosen], name[chosen].view(np.int64)
        sig, own = signatures(grams, sizes, frequent)
        order = np.lexsort((name[own], sig))
        sig, own = sig[order], own[order]
        starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, np.int64)
        members = np.diff(np.r_[starts, len(sig)])
        large = members > SMALL_GROUP
        tag = own.astype(np.uint16)
        tag[starts[large]] |= np.uint16(_FLAG)
        spill = np.repeat(large, members)
        group = sig[starts[large]]
        group = _group_names(group // np.uint64(n_buckets), group % np.uint64(n_buckets), n_buckets)
        x, y = np.repeat(group, members[large]), name[own[spill]]
        lead = np.repeat(name[own[starts[large]]], members[large])
        stay = ~spill
        stay[starts] = True
        x, y, is_group = np.r_[x, lead[lead != y]], np.r_[y, y[lead != y]], np.r_[np.ones(len(x), bool), np.zeros((lead != y).sum(), bool)]
        if len(x):
            yield _found(x, y, is_group)
        sig, tag = sig[stay], tag[stay]
        bucket = (sig % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, sig, tag = bucket[order], sig[order] // np.uint64(n_buckets), tag[order]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
        ends = np.r_[cuts[1:], len(bucket)][: len(cuts)]
        body = sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        rows = [[], [], [], []]
        for a, b in zip(cuts, ends, strict=True):
            used, place = np.unique(tag[a:b] & np.uint16(_FLAG - 1), return_inverse=True)
            rows[0].append(int(bucket[a]))
            rows[1].append(np.ascontiguousarray(body[a:b]).tobytes())
            rows[2].append((place.astype(np.uint16) | (tag[a:b] & np.uint16(_FLAG))).tobytes())
            rows[3].append(name[used].tobytes())
        nulls = [pa.nulls(len(rows[0]), t) for t in (pa.int64(), pa.int64(), pa.bool_())]
        arrays = [pa.array(rows[0], pa.int64()), *(pa.array(r, pa.binary()) for r in rows[1:])]
        yield pa.RecordBatch.from_arrays([*arrays, *nulls], ["bucket", "sigs", "tags", "names", "x", "y", "is_group"])

    def _found(x, y, is_group) -> pa.RecordBatch:
        n = len(x)
        low, high = np.where(is_group, x, np.minimum(x, y)), np.where(is_group, y, np.maximum(x, y))
        # By the set, not by its group, so that members of a large group lie in all buckets.
        bucket = pa.array((high.view(np.uint64) % np.uint64(n_buckets)).astype(np.int64))
        nulls = [pa.nulls(n, pa.binary()) for _ in range(3)]
        return pa.RecordBatch.from_arrays(
            [bucket, *nulls, pa.array(low), pa.array(high), pa.array(is_group)], ["bucket", "sigs", "tags", "names", "x", "y", "is_group"]
        )

    return pack


def _meet(n_buckets: int):
    """Sets that share a signature of one bucket: pairs (x < y), and members y of larger groups x."""

    def meet(bucket: pa.Table) -> pa.Table:
        known = bucket.filter(pc.is_valid(bucket["is_group"])).select(["x", "y", "is_group"])
        bucket = bucket.filter(pc.is_null(bucket["is_group"]))
        if not len(bucket):
            return known
        sigs = np.frombuffer(b"".join(bucket["sigs"].to_pylist()), np.uint8).reshape(-1, 5)
        wide = np.zeros((len(sigs), 8), np.uint8)
        wide[:, :5] = sigs
        sig = wide.view("<u8").ravel()
        tags = [np.frombuffer(t, np.uint16) for t in bucket["tags"].to_pylist()]
        name = np.concatenate([np.frombuffer(n, np.int64)[t & np.uint16(_FLAG - 1)] for n, t in zip(bucket["names"].to_pylist(), tags, strict=True)])
        flag = np.concatenate(tags) >= _FLAG
        order = np.lexsort((~flag, name, sig))
        sig, name, flag = sig[order], name[order], flag[order]
        fresh = np.r_[True, (sig[1:] != sig[:-1]) | (name[1:] != name[:-1])]
        sig, name, flag = sig[fresh], name[fresh], flag[fresh]
        starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        members = np.diff(np.r_[starts, len(sig)])
        many = members > 1
        marked = np.logical_or.reduceat(flag, starts)
        group = many & ((members > SMALL_GROUP) | marked)
        xs, ys, kinds = [], [], []
        # Groups from blocks and from here have the same names, so that a set that one block
        # has in a large group meets all those that other blocks have in a small one.
        inside = np.repeat(group, members)
        xs.append(_group_names(sig[inside], bucket["bucket"][0].as_py(), n_buckets))
        ys.append(name[inside])
        kinds.append(np.ones(len(ys[-1]), bool))
        for size in range(2, SMALL_GROUP + 1):
            for i in range(size):
                for j in range(i + 1, size):
                    at = starts[many & ~group & (members == size)]
                    xs.append(name[at + i])
                    ys.append(name[at + j])
                    kinds.append(np.zeros(len(at), bool))
        lead = np.repeat(name[starts[group]], members[group])
        other = name[inside]
        xs.append(lead[lead != other])
        ys.append(other[lead != other])
        kinds.append(np.zeros(len(ys[-1]), bool))
        x, y, kind = np.concatenate(xs), np.concatenate(ys), np.concatenate(kinds)
        low, high = np.where(kind, x, np.minimum(x, y)), np.where(kind, y, np.maximum(x, y))
        kept = np.unique(np.column_stack([low, high, kind]), axis=0) if len(low) else np.zeros((0, 3), np.int64)
        found = pa.table({"x": kept[:, 0], "y": kept[:, 1], "is_group": kept[:, 2].astype(bool)})
        return pa.concat_tables([known, found])

    return meet


def may_link(n_a: np.ndarray, n_b: np.ndarray, a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Whether sets of these sizes and profiles can link: profiles differ no more than sets do.

    Classes are the lowest bits of a hash, so a longer profile folds onto a shorter one.
    """
    out = np.zeros(len(a), bool)
    shape = np.array([len(x) for x in a], np.int64) << 32 | np.array([len(x) for x in b], np.int64)
    for s in np.unique(shape):
        rows = np.flatnonzero(shape == s)
        for start in range(0, len(rows), PAIRS_AT_ONCE):
            part = rows[start : start + PAIRS_AT_ONCE]
            one, two = (
                np.frombuffer(b"".join([side[i] for i in part]), np.uint16).reshape(len(part), -1).astype(np.int64) for side in (a, b)
            )
            least = min(one.shape[1], two.shape[1])
            one, two = (x.reshape(len(part), -1, least).sum(axis=1) for x in (one, two))
            out[part] = 7 * np.abs(one - two).sum(axis=1) <= n_a[part] + n_b[part]
    return out


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            n_x, n_y = batch.column("n_x").to_numpy(), batch.column("n_y").to_numpy()
            can = may_link(n_x, n_y, batch.column("p_x").to_pylist(), batch.column("p_y").to_pylist())
            yield batch.select(["x", "y"]).filter(pa.array(can))


def _linked(left: pa.Table, right: pa.Table) -> pa.Table:
    """Pairs of one shard that link: ``left`` has the texts of x, ``right`` the pairs and texts of y."""
    words_of = WordHashes()
    texts = dict(zip(left["name"].to_pylist(), left["text"].to_pylist(), strict=True))
    right = right.sort_by("x")
    xs, ys = [], []
    last, base = None, np.zeros(0, np.uint64)
    for x, y, text in zip(right["x"].to_pylist(), right["y"].to_pylist(), right["y_text"].to_pylist(), strict=True):
        if x not in texts:
            continue
        if x != last:
            last, base = x, shingle_sets([texts[x].encode()], words_of, SHINGLE)[0]
        other = shingle_sets([text.encode()], words_of, SHINGLE)[0]
        shared = len(np.intersect1d(base, other, assume_unique=True))
        if 100 * shared >= SHARE * (len(base) + len(other) - shared):
            xs.append(x)
            ys.append(y)
    return pa.table({"x": pa.array(xs, pa.int64()), "y": pa.array(ys, pa.int64())})


def verified(pairs: DataFrame, texts: DataFrame, shards: int) -> DataFrame:
    """The pairs whose texts link. Each text of x goes to each shard that has pairs of it once.

    There are at least ``shards`` shards. Their number grows with the bytes of text to compare,
    and the number of those over which one x is spread with the bytes of its partners. Texts
    without a pair do not move, unless the pairs are too many to be broadcast.
    """
    salted = settle(_salted(pairs, texts, shards), "salted")
    of_y = texts.select(F.col("name").alias("y"), F.col("text").alias("y_text"))
    needed = salted.select(F.col("x").alias("name"), "shard").distinct()
    if is_small(salted):
        salted, needed = F.broadcast(salted), F.broadcast(needed)
    with_y = of_y.join(salted, "y").select(F.col("shard").alias("y_shard"), "x", "y", "y_text")
    with_x = texts.select("name", "text").join(needed, "name")
    return with_x.groupBy("shard").cogroup(with_y.groupBy("y_shard")).applyInArrow(_linked, "x long, y long")


def _salted(pairs: DataFrame, texts: DataFrame, shards: int) -> DataFrame:
    """``x, y, shard`` of all pairs."""
    sizes = texts.select(F.col("name").alias("y"), "bytes")
    loads = settle(pairs.join(sizes, "y").groupBy("x").agg(F.sum("bytes").alias("bytes")), "loads")
    total = loads.agg(F.sum("bytes")).first()[0] or 0
    shards = max(shards, -(-total // SHARD_BYTES))
    salts = F.ceil(F.col("bytes") / SALT_BYTES)
    # At most one in SALTS * SALT_BYTES of text, so they are few.
    hot = loads.filter(salts > SALTS).select("x", salts.alias("salts"))
    spread = pairs.join(F.broadcast(hot), "x", "left")
    salt = F.pmod("y", F.coalesce("salts", F.lit(SALTS)))
    return spread.select("x", "y", F.pmod(F.xxhash64("x", salt), F.lit(shards)).alias("shard"))


def components(edges: DataFrame) -> DataFrame:
    """``name, label`` for every end of an edge: the smallest name that links reach.

    Alternates between hanging larger and smaller neighbours of each node under its smallest
    one until nothing moves; each round is written to the shared folder. A node's neighbours are
    never gathered: each edge is joined with the node's smallest one.
    """

    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    edges = settle(edges.select(F.col("x").alias("u"), F.col("y").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = smallest(both).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = smallest(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = settle(small, "edges")
        before, seen = seen, edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20)"))).first()
        if before == seen:
            break
    own = edges.select(F.col("v").alias("name")).distinct().withColumn("label", F.col("name"))
    return edges.select(F.col("u").alias("name"), F.col("v").alias("label")).unionByName(own)


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The classes that ``links`` make of the classes ``labels``: only links between classes are followed."""
    ends = labelled(labelled(links, "x", labels), "y", labels).filter("of_x <> of_y")
    moved = settle(components(ends.select(F.col("of_x").alias("x"), F.col("of_y").alias("y"))), "moved")
    now = moved.select(F.col("name").alias("label"), F.col("label").alias("now"))
    kept = labels.join(now, "label", "left").select("name", F.coalesce("now", "label").alias("label"))
    return settle(kept.unionByName(moved.join(labels, "name", "left_anti")), "labels")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents linked by a Jaccard similarity of 3/4 or more of five-word shingles.

    Returns ``doc_id, text_hash, n_shingles, component_id, is_lead``, one row for each input row;
    the component is named by its smallest id, and the row that has it leads. Words are split at ASCII white space, A-Z lowered; a
    text of fewer than five words is one shingle; null and empty texts link with nothing, not
    even each other. Texts with equal sets are one set from the start, so exact copies never
    form a group. Null ids are never the smallest; a component of such only has none. Repeated
    rows stay repeated. Other columns are not read.

    Every link is found: sets that link share a PartEnum signature (:func:`signatures`). Pairs
    of small groups, and each larger group's first set with all others, are held against size
    and profile, then compared exactly, for each set first with its smallest partner only. Where
    a larger group then still lies in several classes, the sets beside its main class are held
    against all others by bit maps, inside tasks, and each is compared with the nearest one of another
    class, some times over, which leaves near copies in one class. At last the sets that may still link to another
    class by their bit maps meet as whole sets. Groups with one main class are one unit, so
    that near copies, which share hundreds of signatures, meet once. Frequent shingles, which
    signatures leave out, are looked for by block; missing one costs time and no link.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
        F.col(text_col).cast("string").alias("text"),
    )
    kinds = "doc_id long, text_hash long, n long, set_hash long, profile binary, shingle long, times long"
    facts = settle(rows.mapInArrow(_summaries, kinds), "sets")
    of_docs = facts.filter("n IS NOT NULL").drop("shingle", "times")
    total = of_docs.agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")).first()
    least = max(FREQUENT_LEAST, int(total["docs"] * FREQUENT_SHARE))
    frequent = facts.filter("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("times").alias("times")).filter(F.col("times") >= least)
    # At least `least` of all shingles each; the bound on their number holds for sets of up to
    # 2000 shingles on average, and more than that are simply not left out.
    frequent = frequent.orderBy(F.desc("times"), "shingle").limit(FREQUENT_MOST).select("shingle").toArrow()
    frequent = np.sort(frequent["shingle"].to_numpy().view(np.uint64))
    n_buckets = max((total["shingles"] or 0) // 2 // SIGNATURES_PER_BUCKET, int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    shards = n_buckets

    packed = rows.select("text").mapInArrow(
        _buckets(spark.sparkContext.broadcast(frequent), n_buckets),
        "bucket long, sigs binary, tags binary, names binary, x long, y long, is_group boolean",
    )
    met = packed.groupBy("bucket").applyInArrow(_meet(n_buckets), "x long, y long, is_group boolean")
    met = settle(met, "met")

    sets = of_docs.filter("n > 0").groupBy("set_hash").agg(
        F.first("n").alias("n"), F.first("profile").alias("profile"), F.min(F.struct("doc_id", "text_hash")).alias("at")
    )
    sets = settle(sets.withColumnRenamed("set_hash", "name"), "names")

    def with_sides(pairs: DataFrame) -> DataFrame:
        for end in ("x", "y"):
            side = sets.select(F.col("name").alias(end), F.col("n").alias(f"n_{end}"), F.col("profile").alias(f"p_{end}"))
            pairs = pairs.join(side, end)
            if end == "y":
                pairs = pairs.filter("4 * least(n_x, n_y) >= 3 * greatest(n_x, n_y)")
        return pairs.select("x", "y", "n_x", "n_y", "p_x", "p_y")

    near = with_sides(met.filter("NOT is_group").select("x", "y").distinct()).mapInArrow(_near, "x long, y long")
    near = settle(near, "near")

    # Texts that may be needed: both ends of such pairs, and the sets of larger groups.
    wanted = near.select(F.col("x").alias("name")).union(near.select("y")).union(met.filter("is_group").select("y")).distinct()
    wanted = settle(wanted.join(sets.select("name", "at.*"), "name"), "wanted")
    keys = broadcast_small(wanted.select("name", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    texts = settle(rows.join(keys, same).select("name", "text", F.octet_length("text").alias("bytes")), "texts")

    first = near.groupBy("y").agg(F.min("x").alias("x")).select("x", "y")
    labels = components(verified(first, texts, shards))

    groups_of = met.filter("is_group").select(F.col("x").alias("sig"), F.col("y").alias("name")).distinct()

    in_groups = texts.join(broadcast_small(settle(groups_of.select("name").distinct(), "grouped")), "name")
    crossing = Crossing(in_groups, shards, SHINGLE, SHARE)
    tested = first
    for _ in range(MERGE_TURNS):
        some = crossing.nearest(crossing.parts(groups_of, labels))
        some = settle(some.join(tested, ["x", "y"], "left_anti"), "some")
        if some.isEmpty():
            break
        tested = tested.unionByName(some)
        labels = merged(labels, settle(verified(some, texts, shards), "links"))
    labels = merged(labels, crossing.links(crossing.parts(groups_of, labels)))
    rest = labelled(labelled(near, "x", labels), "y", labels).filter("of_x <> of_y").select("x", "y")
    rest = settle(rest.join(tested, ["x", "y"], "left_anti"), "rest")
    if not rest.isEmpty():
        labels = merged(labels, settle(verified(rest, texts, shards), "links"))

    members = labelled(of_docs.select("doc_id", "text_hash", "n", F.col("set_hash").alias("name")), "name", labels)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    leads = members.filter("n > 0").groupBy("of_name").agg(F.min(first).alias("lead")).withColumnRenamed("of_name", "_of")
    out = members.join(leads, (F.col("of_name") == F.col("_of")) & (F.col("n") > 0), "left")
    alone = F.col("lead").isNull()
    is_lead = F.col("lead.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("lead.text_hash") == F.col("text_hash"))
    return out.select(
        "doc_id",
        "text_hash",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("lead.doc_id")).alias("component_id"),
        (alone | is_lead).alias("is_lead"),
    )


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, its lead; texts without words all stay.

    ``found`` is what :func:`similar_documents` gave for ``docs``. Of rows that repeat the lead's
    id and text, any one stays; null ids and texts are equal to each other. All columns stay.
    """
    id_, hash_, times = (f"__{c}_of_lead" for c in ("id", "hash", "times"))
    leads = found.filter("is_lead").groupBy(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_))
    leads = leads.agg(F.when(F.max("n_shingles") > 0, F.count("*")).otherwise(1).alias(times))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(F.col(text_col)) == F.col(hash_))
    kept = docs.join(leads, same)
    once = kept.filter(F.col(times) == 1).select(*docs.columns)
    return once.unionByName(kept.filter(F.col(times) > 1).dropDuplicates([id_, hash_]).select(*docs.columns))
