"""Rule statistics of texts, and an isolation forest over them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.blocks import WordHashes, blocks, raw_texts, window_hashes

REPEAT_WINDOW = 8
TREES, SUBSAMPLE, DEPTH = 100, 256, 8
BINS = 1000
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOLS = b"#*$%&|<>"
_CONTINUED = bytes(range(0x80, 0xC0))
_NOT_SYMBOL = bytes(b for b in range(256) if b not in _SYMBOLS)
_HAS_WORD = re.compile(rb"[^\x20\x09-\x0D]").search


def repeated_words(hashes: np.ndarray, starts: np.ndarray, width: int = REPEAT_WINDOW) -> np.ndarray:
    """Words of each text that lie in a ``width``-word window found at least twice in that text.

    ``hashes`` holds the words of all texts one after another, text i from ``starts[i]`` on.
    """
    counts = np.zeros(len(starts) - 1, np.int64)
    window = window_hashes(hashes, width)
    if not len(window):
        return counts
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inside = np.flatnonzero(owner[: len(window)] == owner[width - 1 :])
    order = inside[np.lexsort((window[inside], owner[inside]))]
    same = (window[order][1:] == window[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    again = order[np.r_[False, same] | np.r_[same, False]] if len(order) else order
    edges = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + width, -1)
    return np.bincount(owner[np.cumsum(edges[:-1]) > 0], minlength=len(counts))


def statistics(texts: list[bytes], words_of: WordHashes) -> np.ndarray:
    """One row of :data:`STATS` for each text."""
    words = [t.split() for t in texts]
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    hashes = words_of.sequence([w for x in words for w in x])
    out = np.empty((len(texts), len(STATS)), np.int64)
    out[:, 0] = n_words
    out[:, 1] = [len(b"".join(w).translate(None, _CONTINUED)) for w in words]
    out[:, 2] = [len(t.translate(None, _NOT_SYMBOL)) for t in texts]
    lines = ([line for line in t.split(b"\n") if _HAS_WORD(line)] for t in texts)
    out[:, 3] = [len(x) - len(set(x)) for x in lines]
    out[:, 4] = repeated_words(hashes, np.r_[0, np.cumsum(n_words)])
    return out


def features(stats: np.ndarray) -> np.ndarray:
    """What the forest sees: letters and symbols for each word, whatever a text's length.

    Repeats are left to the base rule: they spread widely among good texts too, so that a
    forest would set apart good texts with a few of them before any others.
    """
    n_words, chars, symbols = stats[:, :3].astype(float).T
    size = np.maximum(n_words, 1)
    return np.column_stack([chars / size, symbols / size])


@dataclass
class IsolationForest:
    """Trees of random splits, each as arrays over its nodes (node i has children 2i+1 and 2i+2)."""

    feature: np.ndarray
    cut: np.ndarray
    depth: np.ndarray
    norm: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the shorter the mean path to a row's leaf, the nearer to 1."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, depth in zip(self.feature, self.cut, self.depth, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                inner = feature[node] >= 0
                step = 2 * node + 1 + (x[rows, np.maximum(feature[node], 0)] >= cut[node])
                node = np.where(inner, step, node)
            total += depth[node]
        return 2.0 ** (-total / len(self.depth) / self.norm)


def _mean_path(n: int) -> float:
    """Mean depth of a search that fails in a tree of n points."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow_forest(x: np.ndarray, seed: int = 0) -> IsolationForest:
    """A forest on rows ``x``; each tree takes up to :data:`SUBSAMPLE` of them."""
    rng = np.random.default_rng(seed)
    nodes = 2 ** (DEPTH + 1) - 1
    shape = (TREES, nodes)
    feature, cut, depth = np.full(shape, -1), np.zeros(shape), np.zeros(shape)
    size = min(SUBSAMPLE, len(x))
    for tree in range(TREES):
        todo = [(0, 0, x[rng.choice(len(x), size, replace=False)])] if size else []
        while todo:
            node, level, rows = todo.pop()
            low, high = rows.min(axis=0), rows.max(axis=0)
            wide = np.flatnonzero(high > low)
            if level == DEPTH or len(rows) < 2 or not len(wide):
                depth[tree, node] = level + _mean_path(len(rows))
                continue
            feature[tree, node] = f = rng.choice(wide)
            cut[tree, node] = c = rng.uniform(low[f], high[f])
            right = rows[:, f] >= c
            todo += [(2 * node + 1, level + 1, rows[~right]), (2 * node + 2, level + 1, rows[right])]
    return IsolationForest(feature, cut, depth, max(_mean_path(size), 1e-9))


def base_failed(n_words, n_repeat):
    return (n_words < 20) | (100 * n_repeat > 30 * n_words)


@dataclass
class QualityRules:
    forest: IsolationForest
    threshold: float


def _scored(docs: DataFrame, rules: QualityRules | None, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, the statistics, ``base_failed`` and, with rules, ``anomaly`` of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(rules)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = WordHashes()
        for batch in blocks(batches):
            stats = statistics(raw_texts(batch), words_of)
            failed = base_failed(stats[:, 0], stats[:, 4])
            score = shared.value.forest.score(features(stats)) if shared.value else np.zeros(len(stats))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c) for c in stats.T), pa.array(failed), pa.array(score)],
                ["doc_id", *STATS, "base_failed", "anomaly"],
            )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    longs = ", ".join(f"{c} long" for c in STATS)
    return rows.mapInArrow(measure, f"doc_id long, {longs}, base_failed boolean, anomaly double")


def fit_rules(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 8192,
    keep_share: float = 0.99,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> QualityRules:
    """Forest and threshold from labelled rows.

    The forest sees ``max_rows`` labelled rows at most, those whose ids hash lowest. The
    threshold then comes from the scores of *all* labelled rows that pass the base rules, counted
    by score and label: it is the score that best parts good (label 1) from bad rows, by the sum
    of both shares, among those that keep ``keep_share`` of the good rows. Without labelled rows
    nothing is an anomaly. Labels that are null, or given for other ids, do not count.
    """
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("good"))
    marks = marks.filter("id IS NOT NULL AND good IS NOT NULL").groupBy("id").agg(F.max("good").alias("good"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    stats = _scored(ids, None, "doc_id", "text").filter("NOT base_failed")
    labelled = stats.join(marks, stats["doc_id"] == marks["id"]).drop("id").persist()
    try:
        sample = labelled.orderBy(F.xxhash64("doc_id"), *STATS).limit(max_rows).select(*STATS).toArrow()
        x = features(np.column_stack([c.to_numpy() for c in sample.columns]) if len(sample) else np.zeros((0, len(STATS))))
        forest = grow_forest(x, seed)
        if not len(x):
            return QualityRules(forest, float("inf"))
        shared = docs.sparkSession.sparkContext.broadcast(forest)

        def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = np.column_stack([batch.column(c).to_numpy() for c in STATS])
                score = shared.value.score(features(rows)) if len(rows) else np.zeros(0)
                at = np.minimum((score * BINS).astype(np.int32), BINS - 1)
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("good")], ["bin", "good"])

        counted = labelled.select(*STATS, "good").mapInArrow(bins, "bin int, good int").groupBy("bin", "good").count().collect()
    finally:
        labelled.unpersist()
    good, bad = np.zeros(BINS), np.zeros(BINS)
    for row in counted:
        (good if row["good"] else bad)[row["bin"]] += row["count"]
    kept_good = np.cumsum(good) / max(good.sum(), 1)
    kept_bad = np.cumsum(bad) / max(bad.sum(), 1)
    gain = np.where(kept_good >= keep_share, kept_good - kept_bad, -np.inf)
    if not bad.sum() or not good.sum():
        return QualityRules(forest, float("inf"))
    return QualityRules(forest, (int(np.argmax(gain)) + 1) / BINS)


def apply_rules(docs: DataFrame, rules: QualityRules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics and verdict of every text, one row for each input row.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, anomaly``. ``base_failed``: under 20 words, or over 30 % of the words in 8-word windows
    found twice or more in the text. ``kept`` is false for these and for texts whose isolation
    score reaches the threshold. A null or empty text has no words and so fails; repeated rows
    stay repeated; other columns are not read.
    """
    scored = _scored(docs, rules, id_col, text_col)
    kept = ~F.col("base_failed") & (F.col("anomaly") < F.lit(rules.threshold))
    return scored.select("doc_id", *STATS, "base_failed", kept.alias("kept"), "anomaly")
