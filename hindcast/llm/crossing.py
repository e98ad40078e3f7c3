"""Links between classes of sets that meet in groups, found inside tasks by bit maps and whole sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.blocks import WordHashes, blocks, mixed, raw_texts, shingle_sets
from hindcast.operators.spread import broadcast_small, spread_join
from hindcast.sources.shared import settle

# Groups are compared in blocks of so many sets and bytes at most.
BLOCK_ROWS, BLOCK_BYTES = 4096, 32 << 20
BUCKET_BYTES = 64 << 20
# Bits of a set's bit map for each of its elements, at least.
BITS = 8


def labelled(pairs: DataFrame, end: str, labels: DataFrame) -> DataFrame:
    """``pairs`` with the class ``of_<end>`` of one of their columns; a set without a label is its own class."""
    of = labels.select(F.col("name").alias(end), F.col("label").alias(f"of_{end}"))
    return pairs.join(of, end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))


def bit_maps(grams: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Bit maps of sets: of ``BITS`` bits or more for each element, a power of two, those that elements hit.

    Maps of two sets differ in no more bits than the sets differ in elements. Bits are the lowest
    ones of a hash, so a longer map folds onto a shorter one.
    """
    width = 1 << np.ceil(np.log2(np.maximum(BITS * sizes, 64))).astype(np.int64)
    ends = np.cumsum(width)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    flat = np.zeros(int(width.sum()), bool)
    flat[(ends - width)[owner] + (mixed(grams) & (width[owner] - 1).astype(np.uint64)).astype(np.int64)] = True
    packed = np.packbits(flat, bitorder="little")
    return [packed[(e - w) // 8 : e // 8].tobytes() for e, w in zip(ends.tolist(), width.tolist(), strict=True)]


def _maps(width: int):
    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = WordHashes()
        for batch in blocks(batches):
            grams, sizes = shingle_sets(raw_texts(batch), words_of, width)
            bits = pa.array(bit_maps(grams, sizes), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(sizes.astype(np.int64)), bits], ["name", "n", "bits"])

    return maps


def _elements(width: int):
    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = WordHashes()
        for batch in blocks(batches):
            grams, sizes = shingle_sets(raw_texts(batch), words_of, width)
            ends = np.cumsum(sizes).tolist()
            sets = [grams[end - size : end].tobytes() for end, size in zip(ends, sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(sets, pa.binary())], ["name", "shingles"])

    return elements


class Maps:
    """The bit maps of one part's sets, by length and size of set."""

    def __init__(self, n: np.ndarray, bits: list[bytes], share: int):
        self.share = share
        self.n, self.by_width, self.at = n, {}, np.zeros(len(n), np.int64)
        self.width = np.fromiter(map(len, bits), np.int64, len(bits))
        for width in np.unique(self.width).tolist():
            rows = np.flatnonzero(self.width == width)
            rows = rows[np.argsort(n[rows], kind="stable")]
            self.at[rows] = np.arange(len(rows))
            maps = np.frombuffer(b"".join([bits[i] for i in rows]), np.uint64).reshape(len(rows), -1)
            folded = maps[:, : maps.shape[1] // 2] | maps[:, maps.shape[1] // 2 :] if width > 8 else None
            self.by_width[width] = rows, n[rows], maps, folded

    def near(self, i: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The wanted sets that set ``i`` may link to, and the share that they differ in at least."""
        width, size, found = int(self.width[i]), int(self.n[i]), []
        _, _, maps, folded = self.by_width[width]
        one = maps[self.at[i]]
        for other, mine, column in ((width // 2, folded, 2), (width, maps, 2), (2 * width, maps, 3)):
            if other in self.by_width and mine is not None:
                rows, n = self.by_width[other][:2]
                low, high = np.searchsorted(n, -(-self.share * size // 100)), np.searchsorted(n, 100 * size // self.share, "right")
                at = low + np.flatnonzero(wanted[rows[low:high]])
                if len(at):
                    one = mine[self.at[i]]
                    differ = np.bitwise_count(self.by_width[other][column][at] ^ one).sum(axis=1, dtype=np.int64)
                    fit = (100 + self.share) * differ <= (100 - self.share) * (n[at] + size)
                    found.append((rows[at[fit]], differ[fit] / (n[at[fit]] + size)))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        rows, share = (np.concatenate(c) for c in zip(*found, strict=True))
        return rows, share


def _parts(bucket: pa.Table, share: int) -> Iterator[tuple[np.ndarray, Iterator[tuple[int, np.ndarray, np.ndarray]]]]:
    """For each part of a bucket its rows, and for each ``few`` set the sets of other classes that it may link to."""
    part, few, own = (bucket[c].to_numpy() for c in ("part", "few", "own"))
    label, n, bits = bucket["label"].to_numpy(), bucket["n"].to_numpy(), bucket["bits"].to_pylist()
    order = np.lexsort((~few, part))
    edges = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1], True])

    def of(rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        maps, classes = Maps(n[rows], [bits[i] for i in rows], share), label[rows]
        count, both = int(few[rows].sum()), own[rows[0]]
        for i in range(count):
            wanted = classes != classes[i]
            if not both:
                wanted[:count] = False
            at, differ = maps.near(i, wanted)
            if len(at):
                yield rows[i], rows[at], differ

    for low, high in zip(edges[:-1], edges[1:], strict=True):
        yield order[low:high], of(order[low:high])


def _nearest(share: int):
    def nearest(bucket: pa.Table) -> pa.Table:
        """For each ``few`` set of a part the nearest set of another class that it may link to."""
        name, found = bucket["name"].to_numpy(), []
        for _, pairs in _parts(bucket, share):
            for one, others, differ in pairs:
                at = np.lexsort((name[others], differ))[0]
                found.append((name[one], name[others[at]], differ[at]))
        one, two, differ = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"one": pa.array(one, pa.int64()), "two": pa.array(two, pa.int64()), "differ": pa.array(differ, pa.float64())})

    return nearest


def _doubtful(share: int):
    def doubtful(bucket: pa.Table) -> pa.Table:
        """The sets of each part that may link to one of another class."""
        chosen = np.zeros(len(bucket), bool)
        for _, pairs in _parts(bucket, share):
            for one, others, _ in pairs:
                chosen[one] = chosen[others] = True
        return bucket.select(["part", "few", "own", "name", "label"]).filter(pa.array(chosen))

    return doubtful


def _settled(share: int):
    def settled(bucket: pa.Table) -> pa.Table:
        """Links between classes of each part, by whole sets: as many as join all classes that links join there."""
        name, label, sets = bucket["name"].to_numpy(), bucket["label"].to_numpy(), bucket["shingles"].to_pylist()
        xs, ys = [], []
        for _, pairs in _parts(bucket, share):
            lead: dict[int, int] = {}

            def top(c: int, lead: dict[int, int] = lead) -> int:
                while lead.get(c, c) != c:
                    c = lead[c]
                return c

            for one, others, _ in pairs:
                mine = np.frombuffer(sets[one], np.uint64)
                for two in others.tolist():
                    a, b = top(int(label[one])), top(int(label[two]))
                    if a != b:
                        other = np.frombuffer(sets[two], np.uint64)
                        shared = len(np.intersect1d(mine, other, assume_unique=True))
                        if 100 * shared >= share * (len(mine) + len(other) - shared):
                            lead[max(a, b)] = min(a, b)
                            xs.append(min(name[one], name[two]))
                            ys.append(max(name[one], name[two]))
        return pa.table({"x": pa.array(xs, pa.int64()), "y": pa.array(ys, pa.int64())})

    return settled


class Crossing:
    """Sets by name with their (written) texts, and the links that join classes of them in groups.

    A set has the shingles of ``width`` words of its text; two link if their Jaccard similarity is
    ``share`` percent or more.
    """

    def __init__(self, texts: DataFrame, shards: int, width: int, share: int):
        self.texts, self.shards, self.width, self.share = texts.select("name", "text"), shards, width, share
        self.maps = settle(self.texts.mapInArrow(_maps(width), "name long, n long, bits binary"), "maps")

    def parts(self, groups_of: DataFrame, labels: DataFrame) -> DataFrame:
        """Parts in which sets of groups (``sig, name``) meet those of other classes.

        Groups with one main class (the largest) are one unit, in which each set comes once, unless
        they have fewer pairs one by one. The few sets beside the main class meet all others
        of their unit; if they are many, or the unit is large, in blocks.
        """
        groups = labelled(groups_of, "name", labels).select("sig", "name", F.col("of_name").alias("label"))
        of_classes = groups.groupBy("sig", "label").agg(F.count("*").alias("n"))
        open_ = of_classes.groupBy("sig").agg(F.sum("n").alias("all"), F.max(F.struct("n", "label")).alias("top")).filter("all > top.n")
        open_ = open_.select("sig", F.col("top.label").alias("main"), (F.col("all") * (F.col("all") - F.col("top.n"))).alias("pairs"))
        rows = settle(spread_join(groups, open_, "sig", F.col("name")), "open")
        few = F.col("label") != F.col("main")
        once = rows.select("main", "name", "label").distinct()
        alone = rows.select("sig", "main", "pairs").distinct().groupBy("main").agg(F.sum("pairs").alias("alone"))
        whole = once.groupBy("main").agg((F.count("*") * F.count_if(few)).alias("whole")).join(alone, "main")
        whole = settle(whole.filter("whole <= alone").select("main"), "whole")
        rows = once.join(whole, "main").select(F.col("main").alias("unit"), "main", "name", "label").unionByName(
            rows.join(whole, "main", "left_anti").select(F.xxhash64("sig", "main").alias("unit"), "main", "name", "label")
        )
        rows = settle(rows.join(self.maps.select("name", F.octet_length("bits").alias("bytes")), "name"), "units")
        sizes = rows.groupBy("unit").agg(
            *(F.greatest(F.floor((F.count_if(c) - 1) / BLOCK_ROWS), F.floor(F.sum(F.when(c, F.col("bytes"))) / BLOCK_BYTES)).alias(a) for c, a in ((few, "of_few"), (~few, "of_main"))),
        )
        rows = rows.join(sizes, "unit")
        by_main = rows.filter("of_few = 0")
        one = F.array(F.pmod(F.xxhash64("name"), F.col("of_main") + 1))
        all_ = F.sequence(F.lit(0).cast("long"), "of_main")
        by_main = by_main.withColumn("block", F.explode(F.when(few, all_).otherwise(one)))
        by_main = by_main.select(F.xxhash64("unit", "block").alias("part"), few.alias("few"), (F.col("block") == 0).alias("own"), "name", "label", "bytes")
        last = F.col("of_few") + F.col("of_main") + 1
        by_all = rows.filter("of_few > 0").withColumn("block", F.pmod(F.xxhash64("name"), last + 1))
        by_all = by_all.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        low, high = F.least("block", "other"), F.greatest("block", "other")
        part = F.xxhash64("unit", low, high)
        by_all = by_all.select(part.alias("part"), (F.col("block") == low).alias("few"), (low == high).alias("own"), "name", "label", "bytes")
        return settle(by_main.unionByName(by_all), "parts")

    def _in(self, parts: DataFrame, each, kinds: str, wide: DataFrame) -> DataFrame:
        total = parts.agg(F.sum("bytes")).first()[0] or 0
        bucket = F.pmod("part", F.lit(max(total // BUCKET_BYTES, self.shards)))
        return parts.join(wide, "name").withColumn("bucket", bucket).groupBy("bucket").applyInArrow(each, kinds)

    def nearest(self, parts: DataFrame) -> DataFrame:
        """Pairs ``x, y``: each set beside a main class with the nearest of another class that it may link to."""
        found = self._in(parts, _nearest(self.share), "one long, two long, differ double", self.maps)
        found = found.groupBy("one").agg(F.min(F.struct("differ", "two")).alias("top")).select("one", F.col("top.two").alias("two"))
        return found.select(F.least("one", "two").alias("x"), F.greatest("one", "two").alias("y")).distinct()

    def links(self, parts: DataFrame) -> DataFrame:
        """Links ``x, y`` by whole sets, as many as join all classes that links join in a part."""
        kinds = "part long, few boolean, own boolean, name long, label long"
        doubtful = settle(self._in(parts, _doubtful(self.share), kinds, self.maps), "doubtful")
        names = broadcast_small(settle(doubtful.select("name").distinct(), "names"))
        wide = self.texts.join(names, "name").select("name", "text")
        wide = settle(wide.mapInArrow(_elements(self.width), "name long, shingles binary"), "elements").join(self.maps, "name")
        sized = doubtful.join(wide.select("name", (F.octet_length("bits") + F.octet_length("shingles")).alias("bytes")), "name")
        return settle(self._in(sized, _settled(self.share), "x long, y long", wide), "links")
