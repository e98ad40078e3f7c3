"""Near-duplicates by a chosen-path join of minwise signatures, and the classes of linked documents."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.blocks import WordHashes, blocks, mixed, raw_texts, shingle_sets
from hindcast.llm.crossing import Crossing
from hindcast.llm.similar import components, merged
from hindcast.operators.spread import broadcast_small, spread_join
from hindcast.sources.shared import settle

WIDTH = 4
# A pair links if 100 * shared >= SHARE * union.
SHARE = 80
# Minwise values of each set, 32 bits each; the trees branch on the first ROOTS of them at their
# roots and on the others further down.
COORDINATES, TREES, ROOTS = 72, 24, 30
# Chance that a branching takes a second coordinate: 1 / 0.8 of them on average, so that a pair of
# similarity 0.8 is expected in one child of each node it is in.
SECOND = 1 / 4
# Sets that agree in fewer coordinates than this are not compared: a pair of similarity 0.8 agrees in
# 58 on average, and in fewer than 43 with a chance of 2e-5.
AGREE = 43
# A node is compared exhaustively if it has this many sets at most beside those of its largest class,
# or if all comparisons of those with all others are this many at most.
SMALL, PAIRS = 128, 4_000_000
BLOCK = 1024
PAIRS_AT_ONCE = 65_536
# Nodes that are still larger after so many levels are compared exhaustively in blocks.
DEPTH = 30
# Before, each set is held against the others of as large a random part of its nodes, so many times.
SAMPLE, SAMPLES = 64, 1
BUCKET_ROWS = 100_000
BLOCK_BYTES = 2 << 20
_HALF = np.uint64(32)
_SEEDS = mixed(mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)))
_FACTORS = mixed(_SEEDS ^ np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)


def minwise(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Minwise values, a row for each set; sets have at least one element."""
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), COORDINATES), np.uint32)
    for j in range(COORDINATES if len(sizes) else 0):
        out[:, j] = np.minimum.reduceat((grams ^ _SEEDS[j]) * _FACTORS[j], starts) >> _HALF
    return out


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and name of each text's set; its minwise values, and their lowest bytes, once in each block."""
    words_of = WordHashes()
    for batch in blocks(batches, BLOCK_BYTES):
        grams, sizes = shingle_sets(raw_texts(batch), words_of, WIDTH)
        ends = np.cumsum(sizes)
        name = np.zeros(len(sizes), np.uint64)
        full = np.flatnonzero(sizes)
        if len(full):
            # Sums of mixed elements, mixed with the size: equal sets have equal names.
            sums = np.add.reduceat(mixed(mixed(grams ^ _SEEDS[0])), (ends - sizes)[full])
            name[full] = mixed(sums + sizes[full].astype(np.uint64))
        _, one = np.unique(name[full], return_index=True)
        one = np.sort(full[one])
        chosen = np.zeros(len(sizes), bool)
        chosen[one] = True
        values = minwise(grams[np.repeat(chosen, sizes)], sizes[one])
        sig, sketch = [None] * len(sizes), [None] * len(sizes)
        for row, value in zip(one.tolist(), values, strict=True):
            sig[row], sketch[row] = value.tobytes(), value.astype(np.uint8).tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("text_hash"),
                pa.array(sizes.astype(np.int64)),
                pa.array(name.view(np.int64)),
                pa.array(sig, pa.binary()),
                pa.array(sketch, pa.binary()),
            ],
            ["doc_id", "text_hash", "n", "name", "sig", "sketch"],
        )


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole sets of some texts, as sorted 64-bit hashes."""
    words_of = WordHashes()
    for batch in blocks(batches, BLOCK_BYTES):
        grams, sizes = shingle_sets(raw_texts(batch), words_of, WIDTH)
        ends = np.cumsum(sizes).tolist()
        sets = [grams[end - size : end].tobytes() for end, size in zip(ends, sizes.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(sets, pa.binary())], ["name", "shingles"])


def _signatures(column: pa.Array, kind: type = np.uint32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, COORDINATES)


def _node(parent: np.ndarray, coordinate: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Name of the child of a node that takes the sets with this value."""
    return mixed(mixed(parent ^ (value.astype(np.uint64) << _HALF) + coordinate.astype(np.uint64) + np.uint64(1)))


def _rows(node: np.ndarray, name: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), name], ["node", "name"])


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes below the roots of all trees: TREES roots take ROOTS coordinates between them."""
    for batch in batches:
        if batch.num_rows:
            sig, root = _signatures(batch.column("sig")), np.zeros(batch.num_rows, np.uint64)
            for c in range(ROOTS):
                yield _rows(_node(root, np.full(len(root), c), sig[:, c]), batch.column("name"))


def _branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The children of nodes: each node draws, by its name, one coordinate or two."""
    below = np.uint64(COORDINATES - ROOTS)
    for batch in batches:
        if batch.num_rows:
            sig, node = _signatures(batch.column("sig")), batch.column("node").to_numpy().view(np.uint64)
            draw = mixed(mixed(node ^ np.uint64(0x5851F42D4C957F2D)))
            first = draw % below
            second = (first + np.uint64(1) + (draw >> _HALF) % (below - np.uint64(1))) % below
            two = (mixed(draw) >> np.uint64(40)).astype(np.float64) < SECOND * (1 << 24)
            for coordinate, rows in ((first, np.arange(len(node))), (second, np.flatnonzero(two))):
                at = (coordinate[rows] + np.uint64(ROOTS)).astype(np.int64)
                yield _rows(_node(node[rows], at, sig[rows, at]), batch.column("name").take(pa.array(rows)))


def may_link(n: np.ndarray, sig: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many coordinates the sets at ``one`` and ``two`` share; 0 if they can't link."""
    agree = (sig[one] == sig[two]).sum(axis=1)
    small, large = np.minimum(n[one], n[two]), np.maximum(n[one], n[two])
    return np.where((agree >= AGREE) & (100 * small >= SHARE * large), agree, 0)


def _forest(one: np.ndarray, two: np.ndarray, agree: np.ndarray, label: np.ndarray, classes: int) -> np.ndarray:
    """Of pairs of sets, the likeliest ones that join as many of the ``classes`` as all of them do."""
    lead, kept = list(range(classes)), []

    def top(c: int) -> int:
        while lead[c] != c:
            lead[c] = c = lead[lead[c]]
        return c

    order = np.argsort(-agree, kind="stable")
    for at, a, b in zip(order.tolist(), label[one[order]].tolist(), label[two[order]].tolist(), strict=True):
        a, b = top(a), top(b)
        if a != b:
            lead[a] = b
            kept.append(at)
            if len(kept) == classes - 1:
                break
    return np.array(kept, np.int64)


def _compared(forest: bool):
    """How the groups of a bucket are compared: each set keeps its likeliest pair, or with ``forest`` each group those that join its classes."""

    def compare(bucket: pa.Table) -> pa.Table:
        """Pairs of the bucket's groups that lie in different classes and may link, no more than a group has sets.

        Rows with ``few`` meet all others of their group, and each other if the group says ``own``.
        """
        group, few, own = (bucket[c].to_numpy() for c in ("part", "few", "own"))
        name, label, n = (bucket[c].to_numpy() for c in ("name", "label", "n"))
        sig, classes = _signatures(bucket["sketch"], np.uint8), np.zeros(len(name), np.int64)
        order = np.lexsort((~few, group))
        edges = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1], True])
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            rows = order[low:high]
            count = int(few[rows].sum())
            names, classes[rows] = np.unique(label[rows], return_inverse=True)
            pairs, waiting = found[:1], 0
            for i in range(count):
                others = rows[i + 1 :] if own[rows[0]] else rows[count:]
                others = others[classes[others] != classes[rows[i]]]
                agree = may_link(n, sig, np.full(len(others), rows[i]), others)
                others, agree = others[agree > 0], agree[agree > 0]
                if len(others) > 1:
                    along = np.lexsort((-agree, classes[others])) if forest else np.lexsort((name[others], agree))[-1:]
                    if forest:
                        along = along[np.r_[True, classes[others][along][1:] != classes[others][along][:-1]]]
                    others, agree = others[along], agree[along]
                pairs.append((np.full(len(others), rows[i]), others, agree))
                waiting += len(others)
                if forest and (waiting >= max(PAIRS_AT_ONCE, 4 * len(names)) or i == count - 1):
                    # The forest of all pairs lies in that of some of them and the others.
                    one, two, agree = (np.concatenate(c) for c in zip(*pairs, strict=True))
                    kept = _forest(one, two, agree, classes, len(names))
                    pairs, waiting = [(one[kept], two[kept], agree[kept])], len(kept)
            found.extend(pairs)
        one, two, agree = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"one": name[one], "two": name[two], "label_two": label[two], "agree": agree.astype(np.int64)})

    return compare


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            rows = batch.num_rows
            sig = np.concatenate([_signatures(batch.column(c), np.uint8) for c in ("sig_x", "sig_y")])
            n = np.concatenate([batch.column(c).to_numpy() for c in ("n_x", "n_y")])
            fit = may_link(n, sig, np.arange(rows), np.arange(rows, 2 * rows)) > 0
            yield batch.select(["x", "y"]).filter(pa.array(fit))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both sets, those that link."""
    for batch in batches:
        fit = np.zeros(batch.num_rows, bool)
        for i, (a, b) in enumerate(zip(batch.column("of_x"), batch.column("of_y"), strict=True)):
            one, two = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            shared = len(np.intersect1d(one, two, assume_unique=True))
            fit[i] = 100 * shared >= SHARE * (len(one) + len(two) - shared)
        yield batch.select(["x", "y"]).filter(pa.array(fit))


class _Sets:
    """The corpus's different sets: ``facts`` of all documents, and one row for each set with a document that has it."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        self.rows = docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.xxhash64(F.col(text_col)).alias("text_hash"),
            F.col(text_col).cast("string").alias("text"),
        )
        kinds = "doc_id long, text_hash long, n long, name long, sig binary, sketch binary"
        self.facts = settle(self.rows.mapInArrow(_facts, kinds), "facts")
        self.sets = settle(self.facts.filter("sig IS NOT NULL").dropDuplicates(["name"]), "sets")

    def agreeing(self, pairs: DataFrame) -> DataFrame:
        """Pairs ``x, y`` that may link by size and minwise values."""
        for end in ("y", "x"):
            side = self.sets.select(F.col("name").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"sig_{end}"))
            pairs = spread_join(pairs, side, end, F.col("x" if end == "y" else "y"))
        return settle(pairs.mapInArrow(_agreeing, "x long, y long"), "agreeing")

    def texts(self, names: DataFrame) -> DataFrame:
        """``name, text`` of some sets; a repeated row's set comes more than once."""
        known = self.sets.select("name", F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_text"))
        wanted = broadcast_small(settle(names.join(known, "name"), "wanted"))
        same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_text"))
        return self.rows.join(wanted, same).select("name", "text")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Those of the (settled) pairs ``x, y`` whose whole sets link."""
        ends = pairs.select(F.col("x").alias("name")).union(pairs.select("y")).distinct()
        elements = self.texts(ends).mapInArrow(_elements, "name long, shingles binary")
        elements = settle(elements.dropDuplicates(["name"]), "elements")
        for end in ("y", "x"):
            side = elements.select(F.col("name").alias(end), F.col("shingles").alias(f"of_{end}"))
            pairs = spread_join(pairs, side, end, F.col("x" if end == "y" else "y"))
        return pairs.mapInArrow(_linked, "x long, y long")


def _met(rows: DataFrame) -> DataFrame:
    """``node, name`` for all sets of nodes with two sets or more."""
    nodes = rows.groupBy("node").agg(F.count("*").alias("members")).filter("members > 1").select("node")
    return settle(rows.join(nodes, "node"), "members")


def _classed(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``node, name, label, main, most, others`` for nodes whose sets lie in several classes."""
    classed = members.select("node", "name")
    if labels is None:
        classed = classed.withColumn("label", F.col("name"))
    else:
        classed = classed.join(labels, "name", "left").withColumn("label", F.coalesce("label", "name"))
    of_classes = classed.groupBy("node", "label").agg(F.count("*").alias("n"))
    open_ = of_classes.groupBy("node").agg(F.sum("n").alias("all"), F.max(F.struct("n", "label")).alias("top")).filter("all > top.n")
    open_ = open_.select("node", F.col("top.label").alias("main"), F.col("top.n").alias("most"), (F.col("all") - F.col("top.n")).alias("others"))
    return settle(classed.join(open_, "node"), "open")


def _with_leads(nodes: DataFrame) -> DataFrame:
    """For each set the lead (the least set) of another class that it meets in most nodes."""
    leads = nodes.groupBy("node").agg(F.min(F.struct("name", "label")).alias("lead")).select("node", F.col("lead.name").alias("lead"), F.col("lead.label").alias("of_lead"))
    often = nodes.join(leads, "node").filter("label <> of_lead").groupBy("name", "lead").agg(F.count("*").alias("n"))
    top = often.groupBy("name").agg(F.max(F.struct("n", "lead")).alias("top"))
    return top.select(F.col("top.lead").alias("x"), F.col("name").alias("y"))


def _sampled(nodes: DataFrame, turn: int) -> DataFrame:
    """Each node's rows dealt into small groups."""
    last = F.floor((F.col("most") + F.col("others") - 1) / SAMPLE)
    part = F.xxhash64("node", F.pmod(F.xxhash64("name", "node", F.lit(turn)), last + 1))
    return nodes.select(part.alias("part"), (F.col("label") != F.col("main")).alias("few"), F.lit(True).alias("own"), "name", "label")


def _likely(found: DataFrame, *of: str) -> DataFrame:
    """For each set (and each class beside its own) the set that it agrees with most."""
    return found.groupBy("one", *of).agg(F.max(F.struct("agree", "two")).alias("top")).select("one", F.col("top.two").alias("two"))


def _apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs ``x, y`` of different classes."""
    if labels is None:
        return pairs
    for end in ("x", "y"):
        of = labels.select(F.col("name").alias(end), F.col("label").alias(f"of_{end}"))
        pairs = pairs.join(of, end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
    return pairs.filter("of_x <> of_y").select("x", "y")


def _groups(nodes: DataFrame, whole: bool) -> DataFrame:
    """Rows of the nodes dealt into groups of bounded size, so that each pair of classes meets.

    The few sets beside the largest class go to each block of that class. With ``whole``, all
    sets are dealt into blocks and each block meets each.
    """
    few = F.col("label") != F.col("main")
    if whole:
        last = F.floor((F.col("most") + F.col("others") - 1) / BLOCK)
        block = F.pmod(F.xxhash64("name", "node"), last + 1)
        dealt = nodes.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        low, high = F.least("block", "other"), F.greatest("block", "other")
        few, own = F.col("block") == low, low == high
        part = F.xxhash64("node", low, high)
    else:
        last = F.floor((F.col("most") - 1) / BLOCK)
        all_blocks = F.sequence(F.lit(0).cast("long"), last)
        one = F.array(F.pmod(F.xxhash64("name", "node"), last + 1))
        dealt = nodes.withColumn("block", F.explode(F.when(few, all_blocks).otherwise(one)))
        own, part = F.col("block") == 0, F.xxhash64("node", "block")
    return dealt.select(part.alias("part"), few.alias("few"), own.alias("own"), "name", "label")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents linked by a Jaccard similarity of 0.8 or more of four-word shingles.

    Returns ``doc_id, text_hash, n_shingles, component_id, kept``, a row for each input row. Words
    are split at ASCII white space, A-Z lowered; a text of fewer than four words is one shingle;
    null and empty texts link with nothing and are kept. Very long texts are read whole. The
    component is named by its smallest id; null ids are never that, and a component of such only
    has none. ``kept`` tells whether the row has the component's id, so repeated rows of that id are all kept.
    Other columns are not read. Texts with equal sets (by a 64-bit hash) are one set from the start.

    The trees of the chosen-path join are grown level by level for all sets at once: a node passes its
    sets on by their minwise values at coordinates that it draws. Nodes of few sets are compared
    exhaustively and grow no further. Sets of one class need no comparison, so each set is first
    compared with the least set of the nodes that it meets most often, then with the likeliest one of
    random parts of its nodes, and a node counts as small if few of its sets
    lie outside its largest class. Links are confirmed on whole sets. A pair of similarity 0.8
    is together in a small node below some root with a chance of 1 - 1e-21 if that is the first
    level, and of 1 - 3e-5 after ten more; other links of a class only add to it.
    """
    sets = _Sets(docs, id_col, text_col)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = _met(sets.sets.select("name", "sig").mapInArrow(_roots, "node long, name long"))
    tested = links = labels = None

    def compare(pairs: DataFrame) -> None:
        """Hold pairs against each other in full and join the classes of those that link."""
        nonlocal tested, links, labels
        if tested is not None:
            pairs = pairs.join(tested, ["x", "y"], "left_anti")
        pairs = settle(_apart(pairs, labels), "pairs")
        if pairs.isEmpty():
            return
        tested = pairs if tested is None else tested.unionByName(pairs)
        more = settle(sets.linked(pairs), "links")
        if not more.isEmpty():
            links = more if links is None else links.unionByName(more)
            labels = components(links)

    def may_links(groups: DataFrame, rows: int, forest: bool) -> DataFrame:
        """Pairs of the groups' sets that lie in different classes and may link, by minwise values: fewer than sets."""
        rows_of = groups.join(sets.sets.select("name", "n", "sketch"), "name")
        buckets = max(rows // BUCKET_ROWS, partitions)
        dealt = rows_of.withColumn("bucket", F.pmod("part", F.lit(buckets))).groupBy("bucket")
        return settle(dealt.applyInArrow(_compared(forest), "one long, two long, label_two long, agree long"), "found")

    def ends(found: DataFrame) -> DataFrame:
        return found.select(F.least("one", "two").alias("x"), F.greatest("one", "two").alias("y")).distinct()

    members = _classed(members, labels)
    compare(sets.agreeing(_with_leads(members)))
    for turn in range(SAMPLES):
        members = _classed(members, labels)
        compare(ends(_likely(may_links(_sampled(members, turn), members.count(), False))))
    compared, likely = [], []
    for level in range(DEPTH + 1):
        nodes = _classed(members, labels)
        small = (F.col("others") <= SMALL) | (F.col("others") * (F.col("others") + F.col("most")) <= PAIRS)
        groups = _groups(nodes.filter(small), False)
        if level == DEPTH:
            groups, small = groups.unionByName(_groups(nodes.filter(~small), True)), F.lit(True)
        rows = nodes.count()
        compared.append(groups)
        likely.append(may_links(groups, rows, True))
        large = nodes.filter(~small)
        if large.isEmpty():
            break
        rows = large.select("node", "name").join(sets.sets.select("name", "sig"), "name")
        members = _met(rows.select("node", "name", "sig").mapInArrow(_branches, "node long, name long"))
    # The likeliest pairs that join each group's classes first, then whole sets of groups that still lie apart.
    compare(ends(_likely(reduce(DataFrame.unionByName, likely), "label_two")))
    groups = reduce(DataFrame.unionByName, compared)
    if labels is not None:
        now = labels.withColumnRenamed("label", "now")
        groups = groups.join(now, "name", "left").withColumn("label", F.coalesce("now", "label")).drop("now")
    open_ = groups.groupBy("part").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("part")
    groups = settle(groups.join(open_, "part").select(F.col("part").alias("sig"), "name").distinct(), "apart")
    if not groups.isEmpty():
        texts = settle(sets.texts(groups.select("name").distinct()).dropDuplicates(["name"]), "texts")
        crossing = Crossing(texts, partitions, WIDTH, SHARE)
        known = docs.sparkSession.createDataFrame([], "name long, label long") if labels is None else labels
        labels = merged(known, crossing.links(crossing.parts(groups, known)))

    return _classes(sets.facts, labels)


def _classes(facts: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Every document with its component, by the class of its set."""
    of_docs = facts.select("doc_id", "text_hash", "n", "name")
    of_sets = of_docs.filter("n > 0").groupBy("name").agg(F.min("doc_id").alias("least"))
    if labels is None:
        of_sets = of_sets.withColumn("label", F.col("name"))
    else:
        of_sets = of_sets.join(labels, "name", "left").withColumn("label", F.coalesce("label", "name"))
    of_sets = settle(of_sets, "least")
    leads = of_sets.groupBy("label").agg(F.min("least").alias("component_id"))
    of_sets = spread_join(of_sets.select("name", "label"), leads, "label", F.col("name")).drop("label")
    full = spread_join(of_docs.filter("n > 0"), of_sets, "name", F.xxhash64("text_hash", "doc_id"))
    empty = of_docs.filter("n = 0").withColumn("component_id", F.col("doc_id"))
    both = full.select(*of_docs.columns, "component_id").unionByName(empty)
    return both.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, with all their columns."""
    id_, hash_ = (f"__{c}_of_kept" for c in ("id", "hash"))
    kept = found.filter("kept").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct()
    same = F.col(id_col).cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(F.col(text_col)) == F.col(hash_))
    return docs.join(kept, same, "left_semi")
