"""Language identification with bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.blocks import blocks, mixed, raw_texts

SLOTS = 1 << 20
HASHES = 4
WORD_BITS = 62
LETTERS_AT_ONCE = 1 << 20
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the letter trigrams of lower-case texts, the text of each, and which have letters.

    A run of other signs counts as one word end, which a trigram has at its ends only; a
    single letter still gives one trigram.
    """
    lowered = [t.lower() for t in texts]
    points = np.frombuffer(" ".join(lowered).encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
    letter = _letter_table()[points]
    owner = np.repeat(np.arange(len(texts)), lengths + 1)[: len(points)]
    has = np.zeros(len(texts), bool)
    has[owner[letter]] = True
    keep = letter | np.r_[True, letter[:-1]] if len(letter) else letter
    points = np.where(letter, points, np.uint32(32))[keep]
    owner = owner[keep]
    # One word end before the first and after the last sign closes every word.
    points = np.r_[np.uint32(32), points, np.uint32(32)].astype(np.uint64)
    owner = np.r_[owner[:1], owner, owner[-1:]]
    a, b, c = points[:-2], points[1:-1], points[2:]
    middle = b != 32
    grams = mixed(mixed((a << np.uint64(42)) ^ (b << np.uint64(21)) ^ c))[middle]
    return grams, owner[1:-1][middle], has


@dataclass
class LanguageFilters:
    """For each slot the languages that set it, as bits; and how full each language's filter is."""

    names: list[str]
    slices: np.ndarray
    full: np.ndarray
    prior: int

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; :data:`UNKNOWN` with score 0 where it has no letter.

        The score is the share of the text's n-grams that its language knows, after taking off
        those that its filter would find by chance. The language with the largest one wins.
        """
        n, langs = len(texts), len(self.names)
        grams, owner, has = _grams(texts) if texts else (np.empty(0, np.uint64), np.empty(0, int), np.empty(0, bool))
        total = np.bincount(owner, minlength=n).astype(float)
        found = np.zeros((n, langs))
        for start in range(0, len(grams), LETTERS_AT_ONCE):
            part, own = grams[start : start + LETTERS_AT_ONCE], owner[start : start + LETTERS_AT_ONCE]
            for word in range(self.slices.shape[1]):
                mask = np.bitwise_and.reduce([self.slices[s, word] for s in slots(part)])
                for lang in range(word * WORD_BITS, min(langs, (word + 1) * WORD_BITS)):
                    hit = mask >> np.int64(lang - word * WORD_BITS) & np.int64(1)
                    found[:, lang] += np.bincount(own, weights=hit, minlength=n)
        if not langs:
            return [UNKNOWN] * n, np.zeros(n)
        false = self.full**HASHES
        true = np.maximum(0, (found - total[:, None] * false) / np.maximum(1 - false, 1e-9))
        best = np.where(true.max(axis=1) > 0, true.argmax(axis=1), self.prior)
        score = np.clip(true[np.arange(n), best] / np.maximum(total, 1), 0, 1)
        return [self.names[i] if h else UNKNOWN for i, h in zip(best, has, strict=True)], np.where(has, score, 0.0)


def slots(grams: np.ndarray) -> list[np.ndarray]:
    """The places of each n-gram in the filters."""
    step = mixed(grams) | np.uint64(1)
    return [((grams + np.uint64(i) * step) >> np.uint64(13)) % np.uint64(SLOTS) for i in range(HASHES)]


def learn_languages(docs: DataFrame, min_share: float = 1e-5, text_col: str = "text", lang_col: str = "lang") -> LanguageFilters:
    """Filters from every text with a language.

    N-grams that make up ``min_share`` of a language's n-grams enter its filter, so a language
    has 1 / ``min_share`` of them at most. Spark counts the n-grams and joins their bits; only
    the slots come to the driver, of which there are ``SLOTS`` for each 62 languages.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = [x.decode() for x in raw_texts(batch)]
            for lang in sorted(set(langs)):
                grams, _, _ = _grams([t for t, l in zip(texts, langs, strict=True) if l == lang])
                gram, n = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)],
                    ["lang", "gram", "n"],
                )

    rows = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = counts.persist()
    try:
        totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).orderBy("lang").collect()
        names = [r["lang"] for r in totals]
        words = max(1, -(-len(names) // WORD_BITS))
        slices = np.zeros((SLOTS, words), np.int64)
        if not names:
            return LanguageFilters([], slices, np.zeros(0), 0)
        place = F.create_map(*[x for i, r in enumerate(totals) for x in (F.lit(r["lang"]), F.struct(F.lit(i).alias("i"), F.lit(r["total"]).alias("total")))])
        common = counts.withColumn("of", place[F.col("lang")]).filter(F.col("n") >= min_share * F.col("of.total"))
        bits = common.select("gram", F.col("of.i").alias("i")).mapInArrow(_slot_bits, "slot int, word int, bits long")
        joined = bits.groupBy("slot", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
        slices[joined["slot"].to_numpy(), joined["word"].to_numpy()] = joined["bits"].to_numpy()
    finally:
        counts.unpersist()
    full = np.array([(slices[:, i // WORD_BITS] >> np.int64(i % WORD_BITS) & 1).mean() for i in range(len(names))])
    return LanguageFilters(names, slices, full, int(np.argmax([r["total"] for r in totals])))


def _slot_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gram = batch.column("gram").to_numpy().view(np.uint64)
        lang = batch.column("i").to_numpy().astype(np.int64)
        for slot in slots(gram):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(slot.astype(np.int32)),
                    pa.array((lang // WORD_BITS).astype(np.int32)),
                    pa.array(np.int64(1) << (lang % WORD_BITS)),
                ],
                ["slot", "word", "bits"],
            )


def predict_languages(
    docs: DataFrame, filters: LanguageFilters, keep: list[str] | None = None, text_col: str = "text"
) -> DataFrame:
    """``keep`` columns (all, if not given) with ``lang_pred`` and ``score`` (0 to 1) added.

    Null texts and texts without a letter give :data:`UNKNOWN` and 0, as does everything if
    nothing was learned. Ties go to the language whose name sorts first; a text with no known
    n-gram gets the language with most text and score 0. Columns named like the two new ones
    are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    names = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*[docs[c].alias(n) for c, n in zip(keep, names, strict=True)], docs[text_col].cast("string").alias("text"))
    schema = ", ".join(f"{n} {kind}" for n, kind in rows.dtypes if n != "text")
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            lang, score = shared.value.predict([x.decode() for x in raw_texts(batch)])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(lang, pa.string()), pa.array(score)],
                [*names, "lang_pred", "score"],
            )

    out = rows.mapInArrow(predict, f"{schema}{', ' * bool(schema)}lang_pred string, score double")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "lang_pred", "score")


def held_out(doc_id: str = "doc_id"):
    """Whether a document's id puts it into the third that nothing is learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1
