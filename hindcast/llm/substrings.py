"""Removal of repeated passages with suffix automata of reference shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.blocks import WordHashes, blocks, mixed, raw_texts, window_hashes
from hindcast.sources.shared import settle

WIDTH = 35
# Words in the run whose hash decides under which anchor a window falls.
ANCHOR = 8
# Places of one anchor that one task may hold, and words of one automaton. An anchor with more
# words still stays in its task, but as hashes of its windows, which take a tenth of the memory.
MOST_PLACES = 200_000
AUTOMATON_WORDS = 100_000
# Anchored stretches for each shard, on average.
PLACES_PER_SHARD = 5_000
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
_NO_WINDOW = np.uint64(0xFFFFFFFFFFFFFFFF)


class SuffixAutomaton:
    """All substrings of the sequences added, and how often each occurs."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.link) - 1

    def _copy(self, p: int, q: int, symbol: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, sequence: Iterable[int], times: int = 1) -> None:
        after, link, length = self.next, self.link, self.length
        last = 0
        for symbol in sequence:
            q = after[last].get(symbol)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._copy(last, q, symbol)
            else:
                p, last = last, self._state(length[last] + 1, 0, {})
                while p >= 0 and symbol not in after[p]:
                    after[p][symbol] = last
                    p = link[p]
                if p >= 0:
                    q = after[p][symbol]
                    link[last] = q if length[q] == length[p] + 1 else self._copy(p, q, symbol)
            self.count[last] += times

    def close(self) -> None:
        """Pass the counts on to shorter substrings; after the last :meth:`add`."""
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]

    def matches(self, sequence: Iterable[int]) -> Iterator[tuple[int, int]]:
        """For each end in ``sequence``, the longest match that ends there and its state."""
        state = matched = 0
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                matched += 1
            yield matched, state

    def occurrences(self, matched: int, state: int, width: int) -> int:
        """How often the last ``width`` symbols of a match occur; 0 if the match is shorter."""
        if matched < width:
            return 0
        while self.length[self.link[state]] >= width:
            state = self.link[state]
        return self.count[state]


def anchored(words: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows under one anchor: anchor, first window, number of windows.

    The anchor of a window is the run of ``ANCHOR`` words in it that hashes lowest (the first of
    equal ones), so equal windows have equal anchors. ``owner`` tells the text of each word;
    windows across texts do not count.
    """
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    grams = window_hashes(words, ANCHOR)
    low = (grams & _HIGH) | np.arange(len(grams), dtype=np.uint64)
    span, size, done = width - ANCHOR + 1, 1, low
    while size * 2 <= span:
        done = np.minimum(done[: len(done) - size], done[size:])
        size *= 2
    done = np.minimum(done[:n], done[span - size : span - size + n])
    inside = owner[:n] == owner[width - 1 :]
    place = np.where(inside, done & _LOW, _NO_WINDOW)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    sizes = np.diff(np.r_[first, n])
    first, sizes = first[inside[first]], sizes[inside[first]]
    return grams[place[first].astype(np.int64)], first, sizes


def _sequences(batch: pa.RecordBatch, words_of: WordHashes) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    words = [t.split() for t in raw_texts(batch)]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return words, words_of.sequence([w for x in words for w in x]), sizes


def _marks(width: int):
    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = WordHashes()
        for batch in blocks(batches):
            _, words, sizes = _sequences(batch, words_of)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            anchor, first, n = anchored(words, owner, width)
            row = owner[first] if len(first) else np.empty(0, np.int64)
            base = np.cumsum(sizes) - sizes
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)),
                    batch.column("text_hash").take(pa.array(row)),
                    pa.array(anchor.view(np.int64)),
                    pa.array((first - base[row]).astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                ],
                ["doc_id", "text_hash", "anchor", "start", "n"],
            )

    return marks


def _split_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finish texts without suspect stretches; the others keep their text for the next step."""
    for batch in blocks(batches):
        words = [t.split() for t in raw_texts(batch)]
        clear = batch.column("places").is_null().to_pylist()
        digest = [hashlib.sha256(b" ".join(w)).hexdigest() if c else None for w, c in zip(words, clear, strict=True)]
        text = [None if c else t for c, t in zip(clear, batch.column("text").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("text_hash"),
                pa.array(text, pa.string()),
                batch.column("places"),
                pa.array(list(map(len, words)), pa.int64()),
                pa.array(digest, pa.string()),
            ],
            ["doc_id", "text_hash", "text", "places", "n_words", "kept_sha256"],
        )


def _stretches(width: int):
    """The words of suspect stretches as hashes, one row for each stretch."""

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = WordHashes()
        for batch in blocks(batches, 1 << 20):
            _, words, sizes = _sequences(batch, words_of)
            base = np.cumsum(sizes) - sizes
            rows: list[int] = []
            out: list[tuple[int, int, bytes]] = []
            for i, places in enumerate(batch.column("places").to_pylist()):
                for p in places:
                    if not p["hot"]:
                        at = base[i] + p["start"]
                        rows.append(i)
                        out.append((p["anchor"], p["start"], words[at : at + p["n"] + width - 1].tobytes()))
            take = pa.array(rows, pa.int64())
            anchor, start, piece = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(take),
                    batch.column("text_hash").take(take),
                    pa.array(anchor, pa.int64()),
                    pa.array(start, pa.int32()),
                    pa.array(piece, pa.binary()),
                ],
                ["doc_id", "text_hash", "anchor", "start", "piece"],
            )

    return stretches


def repeated_windows(pieces: list[bytes], width: int) -> dict[bytes, int]:
    """For each different piece, the bits of its windows that occur at least twice in all pieces."""
    times: dict[bytes, int] = {}
    for piece in pieces:
        times[piece] = times.get(piece, 0) + 1
    if sum(map(len, times)) > 8 * AUTOMATON_WORDS:
        return _counted_windows(times, width)
    words = {piece: np.frombuffer(piece, np.uint64).tolist() for piece in times}
    shard = SuffixAutomaton()
    for piece, n in times.items():
        shard.add(words[piece], n)
    shard.close()
    out = {}
    for piece, sequence in words.items():
        bits = 0
        for end, (matched, state) in enumerate(shard.matches(sequence)):
            if end + 1 >= width and shard.occurrences(matched, state, width) > 1:
                bits |= 1 << (end + 1 - width)
        out[piece] = bits
    return out


def _counted_windows(times: dict[bytes, int], width: int) -> dict[bytes, int]:
    """The same for many words: windows by two hashes each, counted in arrays."""
    pieces = list(times)
    sizes = np.fromiter((len(p) // 8 for p in pieces), np.int64, len(pieces))
    words, owner = np.frombuffer(b"".join(pieces), np.uint64), np.repeat(np.arange(len(pieces)), sizes)
    one, two = window_hashes(words, width), window_hashes(mixed(words ^ _LOW), width)
    inside = np.flatnonzero(owner[: len(one)] == owner[width - 1 :])
    one, two, owner = one[inside], two[inside], owner[inside]
    order = np.lexsort((two, one))
    fresh = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(fresh) - 1
    number = np.bincount(kind, weights=np.fromiter(times.values(), float, len(times))[owner])
    hit = number[kind] > 1
    place = inside - (np.cumsum(sizes) - sizes)[owner]
    bits = np.zeros(len(pieces), np.int64)
    np.bitwise_or.at(bits, owner[hit], np.int64(1) << place[hit])
    return dict(zip(pieces, bits.tolist(), strict=True))


def _judge(width: int):
    """One shard: an automaton for each anchor in it, through which its stretches stream."""

    def judge(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("anchor").combine_chunks()
        anchor = shard["anchor"].to_numpy()
        piece = shard["piece"].to_pylist()
        edges = np.r_[np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]), len(anchor)]
        bits = np.zeros(len(anchor), np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a > 1:
                found = repeated_windows(piece[a:b], width)
                bits[a:b] = [found[p] for p in piece[a:b]]
        hit = np.flatnonzero(bits)
        kept = shard.select(["doc_id", "text_hash", "start"]).take(pa.array(hit))
        return kept.append_column("bits", pa.array(bits[hit]))

    return judge


def _hot_windows(width: int):
    """Windows under anchors with too many places for one task, by two hashes of their words."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = WordHashes()
        for batch in blocks(batches, 1 << 20):
            _, words, sizes = _sequences(batch, words_of)
            base = np.cumsum(sizes) - sizes
            one, two = window_hashes(words, width), window_hashes(mixed(words ^ _LOW), width)
            row, start = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, places in enumerate(batch.column("places").to_pylist()):
                for p in places:
                    if p["hot"]:
                        start.append(np.arange(p["start"], p["start"] + p["n"]))
                        row.append(np.full(p["n"], i))
            row, start = np.concatenate(row), np.concatenate(start)
            at = base[row] + start
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)),
                    batch.column("text_hash").take(pa.array(row)),
                    pa.array(start.astype(np.int32)),
                    pa.array(one[at].view(np.int64)),
                    pa.array(two[at].view(np.int64)),
                ],
                ["doc_id", "text_hash", "start", "one", "two"],
            )

    return windows


def _cut(width: int, with_text: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            removed, digest, kept = [], [], []
            for text, hits in zip(raw_texts(batch), batch.column("hits").to_pylist(), strict=True):
                words = text.split()
                edges = np.zeros(len(words) + 1, np.int64)
                for hit in hits or ():
                    bits, start = hit["bits"], hit["start"]
                    while bits:
                        low = (bits & -bits).bit_length() - 1
                        edges[start + low] += 1
                        edges[start + low + width] -= 1
                        bits &= bits - 1
                gone = np.cumsum(edges[:-1]) > 0
                rest = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                removed.append(int(gone.sum()))
                digest.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("n_words"),
                    pa.array(removed, pa.int64()),
                    pa.array(digest, pa.string()),
                    pa.array(kept, pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return cut


def cut_repeats(
    docs: DataFrame, width: int = WIDTH, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Remove every word inside a window of ``width`` words that also starts anywhere else.

    Returns ``doc_id, n_words, n_removed, kept_sha256, kept``, one row for each input row; ``kept``
    is null unless asked for. Windows are judged on the input, the same document included.

    The corpus is its own reference, so its automata have no bound under which they could be
    broadcast; instead each reference shard goes to one task, with the stretches to be streamed
    through it. A window falls under its lowest-hashing run of ``ANCHOR`` words. Anchors are
    counted over all texts, and only stretches under an anchor that comes twice are looked at
    again: all stretches of an anchor meet in one shard, whose suffix automaton tells by
    matching statistics which windows occur twice; if the different stretches of an anchor hold
    over ``AUTOMATON_WORDS`` words, hashes of their windows are counted instead. Anchors with over
    ``MOST_PLACES`` places are not put into one task at all: Spark counts their windows by two
    64-bit hashes, which combine before they move. Words are compared by a 64-bit hash each.

    Null and empty texts have no words and nothing to remove. Rows with the same id and text are
    separate documents, so their windows repeat each other. Null ids stay. Other columns are not
    read.
    """
    if not ANCHOR < width <= ANCHOR + 62:
        raise ValueError(f"width is from {ANCHOR + 1} to {ANCHOR + 62}")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
        F.col(text_col).cast("string").alias("text"),
    )
    marks = rows.mapInArrow(_marks(width), "doc_id long, text_hash long, anchor long, start int, n int")
    marks = settle(marks, "anchors")
    often = marks.groupBy("anchor").agg(F.count("*").alias("times")).filter("times > 1")
    places = marks.join(often, "anchor").groupBy("doc_id", "text_hash")
    place = F.struct("anchor", "start", "n", (F.col("times") > MOST_PLACES).alias("hot"))
    places = places.agg(F.collect_set(place).alias("places"))
    places = places.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "places")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    suspect = rows.join(places, same, "left").drop("_id", "_hash")
    kind = dict(suspect.dtypes)["places"]
    split = suspect.mapInArrow(
        _split_off, f"doc_id long, text_hash long, text string, places {kind}, n_words long, kept_sha256 string"
    )
    split = settle(split, "suspects")
    clear = split.filter("places IS NULL").withColumns({"n_removed": F.lit(0).cast("long"), "kept": F.lit(None).cast("string")})
    if with_text:
        words = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
        clear = suspect.filter("places IS NULL").withColumn("kept", F.trim(words)).select(
            "doc_id",
            F.when(F.col("kept") == "", 0).otherwise(F.size(F.split("kept", " "))).cast("long").alias("n_words"),
            F.lit(0).cast("long").alias("n_removed"),
            F.sha2("kept", 256).alias("kept_sha256"),
            "kept",
        )
    rest = split.filter("places IS NOT NULL")
    shards = marks.count() // PLACES_PER_SHARD + 1
    cold = rest.filter(F.exists("places", lambda p: ~p["hot"])).mapInArrow(
        _stretches(width), "doc_id long, text_hash long, anchor long, start int, piece binary"
    )
    cold = cold.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    cold = cold.groupBy("shard").applyInArrow(_judge(width), "doc_id long, text_hash long, start int, bits long")
    hot = rest.filter(F.exists("places", lambda p: p["hot"])).mapInArrow(
        _hot_windows(width), "doc_id long, text_hash long, start int, one long, two long"
    )
    twice = hot.groupBy("one", "two").agg(F.count("*").alias("times")).filter("times > 1").drop("times")
    hot = hot.join(twice, ["one", "two"]).select("doc_id", "text_hash", "start", F.lit(1).cast("long").alias("bits"))
    hits = cold.unionByName(hot).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "bits")).alias("hits"))
    hits = hits.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "hits")
    cut = rest.select("doc_id", "text_hash", "text", "n_words").join(hits, same, "left").select("doc_id", "n_words", "text", "hits")
    cut = cut.mapInArrow(_cut(width, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return clear.select(*cut.columns).unionByName(cut)
