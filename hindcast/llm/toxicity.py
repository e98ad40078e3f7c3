"""Toxicity by a chain of linear classifiers over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.blocks import blocks, raw_texts

FOLDS = 5
STEPS = 150
_EDGES = bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F))
_CLEAN = bytes(32 if b in _EDGES or b < 32 else b for b in range(256))


def distinct_words(text: bytes) -> set[bytes]:
    """The words of a text: runs of ASCII letters, digits and other bytes, A-Z lowered."""
    return set(text.lower().translate(_CLEAN).split())


@dataclass
class Linear:
    weights: np.ndarray
    bias: float
    earlier: np.ndarray

    def prob(self, index: np.ndarray, sizes: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        sums = np.r_[0.0, np.cumsum(self.weights[index])]
        ends = np.cumsum(sizes)
        z = self.bias + sums[ends] - sums[ends - sizes] + earlier @ self.earlier
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(index, sizes, earlier, target, used: np.ndarray, penalty: float = 1e-3) -> Linear:
    """Logistic regression on sparse 0/1 rows and the ``earlier`` columns, by accelerated descent.

    Only features marked in ``used`` get a weight. Both labels weigh the same in total, so that
    rare categories are learned too.
    """
    n_features = len(used)
    n = len(target)
    model = Linear(np.zeros(n_features), 0.0, np.zeros(earlier.shape[1]))
    positive = target.sum()
    if not n or not positive or positive == n:
        model.bias = -30.0 if not positive else 30.0
        return model
    weight = np.where(target == 1, 0.5 / positive, 0.5 / (n - positive))
    row = np.repeat(np.arange(n), sizes)
    state = np.zeros(n_features + 1 + earlier.shape[1])
    m, v = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, STEPS + 1):
        model = Linear(state[:n_features], state[n_features], state[n_features + 1 :])
        error = (model.prob(index, sizes, earlier) - target) * weight
        grad = np.r_[np.bincount(index, weights=error[row], minlength=n_features), error.sum(), error @ earlier]
        grad[:n_features] = (grad[:n_features] + penalty * state[:n_features]) * used
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        state = state - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Linear(state[:n_features], float(state[n_features]), state[n_features + 1 :])


@dataclass
class Chain:
    """Models of the categories in order; each sees the probabilities of those before it."""

    categories: list[str]
    place: dict[bytes, int]
    models: list[Linear]
    cuts: list[float]

    def rows(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the known words of each text, and how many each has."""
        known = self.place.keys()
        found = [sorted(map(self.place.__getitem__, known & distinct_words(t))) for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.int64, int(sizes.sum())), sizes

    def prob(self, index: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        earlier = np.zeros((len(sizes), 0))
        for model in self.models:
            earlier = np.column_stack([earlier, model.prob(index, sizes, earlier)])
        return earlier


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def fit_chain(
    docs: DataFrame,
    labels: DataFrame,
    categories: list[str],
    max_rows: int = 20_000,
    max_words: int = 1000,
    min_docs: int = 3,
    min_strength: float = 3.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Chain:
    """Train the chain on ``max_rows`` labelled documents at most, those whose ids hash lowest.

    Words are counted by category in Spark; each category brings the ``max_words`` words whose
    presence tells most about it: in ``min_docs`` documents at least, and ``min_strength``
    standard deviations from what chance would give, so that words that say nothing are not
    learned by heart. A later model is trained on
    earlier probabilities that come from models which did not see the row (``FOLDS`` folds by
    row order), so it does not trust them more than it may. The cut of a category is the one
    with the best F1 of such out-of-fold probabilities. Null labels count as 0; ids that are
    null, unknown or labelled twice are used once at most. Without rows, every probability is 0.
    """
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
    marks = marks.agg(*[F.max(F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(f"y{i}") for i, c in enumerate(categories)])
    # The bound on labelled rows applies before the join, so they can be broadcast and no text moves.
    marks = marks.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    sample = _rows(docs, id_col, text_col).join(F.broadcast(marks), F.col("doc_id") == F.col("id")).drop("id")
    sample = sample.dropDuplicates(["doc_id"])
    targets = [f"y{i}" for i in range(len(categories))]

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            found = [list(distinct_words(t)) for t in raw_texts(batch)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            out = [pa.array([w for x in found for w in x], pa.binary())]
            for c in targets:
                out.append(pa.array(np.repeat(batch.column(c).to_numpy().astype(np.int64), sizes)))
            yield pa.RecordBatch.from_arrays(out, ["word", *targets])

    longs = ", ".join(f"{c} long" for c in targets)
    sample = sample.persist()
    try:
        totals = sample.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in targets]).first()
        per_word = sample.mapInArrow(words, f"word binary, {longs}").groupBy("word")
        per_word = per_word.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in targets]).filter(F.col("n") >= min_docs)
        chosen: list[set[bytes]] = []
        for c in targets:
            y, n = F.lit(float(totals[c] or 0)), F.lit(float(max(totals["n"], 1)))
            expected = F.col("n") * y / n
            spread = F.sqrt(expected * (1 - y / n) * (1 - F.col("n") / n)) + 0.5
            told = per_word.select("word", (F.abs(F.col(c) - expected) / spread).alias("z"))
            told = told.filter(F.col("z") >= min_strength)
            chosen.append({bytes(r["word"]) for r in told.orderBy(F.desc("z"), "word").limit(max_words).collect()})
        place = {w: i for i, w in enumerate(sorted(set().union(*chosen)))}
        chain = Chain(list(categories), place, [], [])
        shared = docs.sparkSession.sparkContext.broadcast(chain)

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in blocks(batches):
                index, sizes = shared.value.rows(raw_texts(batch))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(index.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), lists, *(batch.column(c) for c in targets)], ["doc_id", "at", *targets]
                )

        kinds = ", ".join(f"{c} int" for c in targets)
        table = sample.mapInArrow(places, f"doc_id long, at array<int>, {kinds}").toArrow().sort_by("doc_id").combine_chunks()
    finally:
        sample.unpersist()
    n = len(table)
    lists = table["at"].combine_chunks() if n else pa.array([], pa.list_(pa.int32()))
    sizes = np.asarray(lists.value_lengths()).astype(np.int64)
    index = np.asarray(lists.flatten()).astype(np.int64)
    fold = np.arange(n) % FOLDS
    unseen, fitted = np.zeros((n, 0)), np.zeros((n, 0))
    for c, words_of in zip(targets, chosen, strict=True):
        used = np.array([w in words_of for w in place], bool)
        y = table[c].to_numpy().astype(float)
        out = np.zeros(n)
        for k in range(FOLDS):
            inside = fold != k
            model = fit_linear(index[np.repeat(inside, sizes)], sizes[inside], unseen[inside], y[inside], used)
            out[~inside] = model.prob(index[np.repeat(~inside, sizes)], sizes[~inside], unseen[~inside])
        chain.models.append(fit_linear(index, sizes, unseen, y, used))
        chain.cuts.append(_best_cut(out, y))
        unseen = np.column_stack([unseen, out])
    return chain


def _best_cut(prob: np.ndarray, target: np.ndarray) -> float:
    """The probability from which on a row is positive, for the best F1; ties to the middle."""
    if not target.sum():
        return 1.1
    order = np.argsort(-prob, kind="stable")
    p, y = prob[order], target[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    ends = np.r_[p[1:] != p[:-1], True]
    best = int(np.argmax(np.where(ends, f1, -1)))
    return float((p[best] + (p[best + 1] if best + 1 < len(p) else 0.0)) / 2)


def predict_toxicity(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, and for each category ``p_<category>`` and ``is_<category>``; one row per input row.

    A null or empty text has no words and gets what the biases say. Repeated rows stay repeated;
    other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    probs = [f"p_{c}" for c in chain.categories]
    flags = [f"is_{c}" for c in chain.categories]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            p = shared.value.prob(*shared.value.rows(raw_texts(batch)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x) for x in p.T), *(pa.array(x >= c) for x, c in zip(p.T, shared.value.cuts, strict=True))],
                ["doc_id", *probs, *flags],
            )

    schema = ", ".join(["doc_id long", *(f"`{c}` double" for c in probs), *(f"`{c}` boolean" for c in flags)])
    return _rows(docs, id_col, text_col).mapInArrow(predict, schema)
