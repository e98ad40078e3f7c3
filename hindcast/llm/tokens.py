"""Token counts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from hindcast.llm.blocks import blocks, raw_texts

CACHE = 400_000
NO_MERGE = np.iinfo(np.int64).max
# Fixed value: the pre-tokenizer's pattern. White space is named by its property, as the
# pattern language's own class also takes the four separators U+001C to U+001F.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
# The same for texts without those separators and without numerals other than 0 to 9.
PLAIN_WORDS = r" ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"


def _byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary writes each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    other = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [letters[b] for b in range(256)]


class MergeTable:
    """Merges of a byte-level BPE file as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.size = max(vocab.values()) + 1
        self.of_byte = np.array([vocab[c] for c in _byte_letters()], np.int64)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.words, self.plain_words = regex.compile(WORDS), re.compile(PLAIN_WORDS)
        self.unusual = frozenset(
            c
            for c in map(chr, range(sys.maxunicode + 1))
            if "\x1c" <= c <= "\x1f" or unicodedata.category(c)[0] == "N" and not "0" <= c <= "9"
        )
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def pre_tokens(self, text: str) -> list[str]:
        return (self.plain_words if self.unusual.isdisjoint(text) else self.words).findall(text)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_MERGE)

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token when no pair can merge any more.

        All sequences lie in one array. In each round every sequence applies its own
        lowest-rank pair at all its places (of overlapping places, every other one);
        sequences without a pair leave the array.
        """
        result = np.zeros(len(tokens), np.int64)
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ids = self.of_byte[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), lengths)
        rank = self._pair_ranks(ids, owner)
        while len(ids):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(ids)])
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == NO_MERGE
            if done.any():
                result[owner[starts[done]]] = sizes[done]
                stay = np.repeat(~done, sizes)
                ids, owner, rank = ids[stay], owner[stay], rank[stay]
                sizes, lowest = sizes[~done], lowest[~done]
                if not len(ids):
                    break
            hits = np.flatnonzero(rank == np.repeat(lowest, sizes))
            first = np.r_[True, np.diff(hits) != 1]
            run = np.maximum.accumulate(np.where(first, hits, 0))
            hits = hits[(hits - run) % 2 == 0]
            ids[hits] = self.merged[rank[hits]]
            stay = np.ones(len(ids), bool)
            stay[hits + 1] = False
            place = np.cumsum(stay) - 1
            ids, owner, rank = ids[stay], owner[stay], rank[stay]
            near = np.zeros(len(ids) + 1, bool)
            near[place[hits]] = near[place[hits] - 1] = True
            changed = np.flatnonzero(near[:-1])
            rank[changed] = NO_MERGE
            changed = changed[changed + 1 < len(ids)]
            changed = changed[owner[changed] == owner[changed + 1]]
            rank[changed] = self.rank(ids[changed], ids[changed + 1])
        return result

    def _pair_ranks(self, ids: np.ndarray, owner: np.ndarray) -> np.ndarray:
        rank = np.full(len(ids), NO_MERGE)
        if len(ids) > 1:
            same = owner[1:] == owner[:-1]
            rank[:-1][same] = self.rank(ids[:-1][same], ids[1:][same])
        return rank


@lru_cache(maxsize=2)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


def text_counts(texts: list[str], table: MergeTable, known: dict[str, int]) -> list[int]:
    """Tokens of each text; ``known`` keeps the counts of pre-tokens between calls."""
    find, split = table.pre_tokens, table.split
    parts = []
    for text in texts:
        if split is not None and split.search(text):
            pieces = split.split(text)
            parts.append((len(pieces) - 1, [w for p in pieces for w in find(p)]))
        else:
            parts.append((0, find(text)))
    fresh = list(set().union(*(words for _, words in parts)) - known.keys())
    if len(known) + len(fresh) > CACHE:
        known.clear()
        fresh = list(set().union(*(words for _, words in parts)))
    known.update(zip(fresh, table.counts([w.encode() for w in fresh]).tolist(), strict=True))
    return [special + sum(map(known.__getitem__, words)) for special, words in parts]


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every text under the byte-level BPE file at ``path``.

    Returns ``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens), one row
    for each input row. A null or empty text has no bytes and no tokens; repeated rows stay
    repeated; other columns are not read. The file must be at ``path`` on every executor.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = merge_table(path), {}
        for batch in blocks(batches):
            raw = raw_texts(batch)
            n = np.array(text_counts([x.decode() for x in raw], table, known), np.int64)
            sizes = np.fromiter(map(len, raw), np.int64, len(raw))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(n), pa.array(n > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
