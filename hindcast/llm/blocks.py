"""Bounded blocks of text inside tasks, and word sequences as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 4 << 20
WORD_CACHE = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``limit`` bytes of ``text`` (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw_texts(batch: pa.RecordBatch) -> list[bytes]:
    """The texts as UTF-8; null reads as empty."""
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """64-bit hash of each word seen; forgets all of them when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def sequence(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (wraps silently)."""
    values = values * _MIX
    return values ^ (values >> _SHIFT)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` values, by doubling; empty if there are fewer."""
    if len(words) < width:
        return np.empty(0, np.uint64)
    out, done = None, 0
    power, size = mixed(words), 1
    while size <= width:
        if width & size:
            left = len(words) - done - size + 1
            out = power if out is None else mixed(out[:left] * _MIX + power[done : done + left])
            done += size
        if size * 2 <= width:
            power = mixed(mixed(power[: len(power) - size]) + power[size:])
        size *= 2
    return out


def shingle_sets(texts: list[bytes], words_of: WordHashes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of shingles of ``width`` words of each text, sorted, one text after another; and their numbers."""
    words = [t.lower().split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    hashes = words_of.sequence([w for x in words for w in x])
    owner = np.repeat(np.arange(len(words)), sizes)
    grams = window_hashes(hashes, width)
    inside = owner[: len(grams)] == owner[width - 1 :] if len(grams) else np.zeros(0, bool)
    grams, owner = grams[inside], owner[: len(inside)][inside]
    ends = np.cumsum(sizes)
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    whole = [window_hashes(hashes[ends[i] - sizes[i] : ends[i]], int(sizes[i]))[0] ^ np.uint64(sizes[i]) for i in short]
    grams = np.r_[grams, np.array(whole, np.uint64)]
    owner = np.r_[owner, short]
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    first = np.r_[True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])] if len(grams) else np.zeros(0, bool)
    grams, owner = grams[first], owner[first]
    return grams, np.bincount(owner, minlength=len(texts))
