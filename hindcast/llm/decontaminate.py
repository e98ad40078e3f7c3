"""Benchmark decontamination with DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions.text import let
from hindcast.operators.spread import broadcast_small
from hindcast.sources.shared import settle

WIDTH = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# The screen: one bit for each hash value, 2^20 in all, whatever the benchmark's size.
SCREEN_BITS = 20
# Windows that a broadcast may hold; with more, Spark joins by shuffle.
BROADCAST_WINDOWS = 500_000


def ascii_lower(text: Column) -> Column:
    """A-Z lowered and nothing else."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def item_words(text: Column) -> Column:
    """Normalised words; none for null."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def _starts(words: Column, width: int | Column) -> Column:
    """1-based starts of the windows of ``width`` words."""
    last = F.size(words) - width + 1
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def run_of(words: Column, start: Column, width: int) -> list[Column]:
    """The ``width`` elements from 1-based ``start`` on, each by place (a slice would copy the whole array)."""
    return [F.get(words, start + (k - 1)) for k in range(width)]


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows of the items: ``window``, their ``width``, and ``items`` that have them.

    An item of fewer than ``width`` words is one window; one without words has none. Items
    with a null id count as windows but are not listed.
    """
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), item_words(F.col(text_col)).alias("words"))
    items = items.withColumn("width", F.least(F.size("words"), F.lit(width))).filter("width > 0")
    cut = F.transform(_starts(F.col("words"), F.col("width")), lambda i: F.slice("words", i, F.col("width")))
    windows = items.select("item", "width", F.explode(cut).alias("window"))
    return windows.groupBy("window", "width").agg(F.collect_set("item").alias("items"))


def _screen(windows: DataFrame) -> Column:
    """A bitmap of the windows' hashes as an array of 64-bit numbers, as one literal."""
    slot = F.xxhash64("window").bitwiseAND(F.lit((1 << SCREEN_BITS) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    bits = windows.select(F.shiftright(slot, 6).alias("at"), bit.alias("bit"))
    filled = {r["at"]: r["bits"] for r in bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect()}
    longs = ",".join(str(filled.get(i, 0)) for i in range(1 << (SCREEN_BITS - 6)))
    return F.split(F.lit(longs), ",").cast("array<bigint>")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Where the documents repeat windows of the benchmark; one row for each input row.

    Returns ``doc_id, text_hash, n_words, n_hit, items, spans``: words inside any occurring
    window, ids of the items with such windows (as strings, sorted), and the windows found as
    (first word, words), counted from 1. Every window of every document is held against a
    bitmap of the benchmark's hashes; those that pass carry their words into a join with the
    windows, which therefore decides exactly. The windows are broadcast if they are at most
    ``BROADCAST_WINDOWS``. What passed is written to the shared folder once, so that texts are
    read once. Null texts have no words; rows with the same id and text get the same result;
    an empty benchmark hits nothing; other columns are not read.
    """
    windows = settle(benchmark_windows(benchmark, width, item_col, item_text_col), "windows")
    widths = [r["width"] for r in windows.select("width").distinct().orderBy("width").collect()]
    screen = _screen(windows)

    def passing(length: int) -> Column:
        def seen(i: Column) -> Column:
            slot = F.xxhash64(F.array(*run_of(F.col("words"), i, length))).bitwiseAND(F.lit((1 << SCREEN_BITS) - 1))
            word = F.get(screen, F.shiftright(slot, 6).cast("int"))
            return F.getbit(word, slot.bitwiseAND(F.lit(63)).cast("int")) == 1

        found = F.filter(_starts(F.col("words"), length), seen)
        return F.transform(found, lambda i: F.struct(i.alias("start"), F.array(*run_of(F.col("words"), i, length)).alias("window")))

    none = F.array().cast("array<struct<start:int,window:array<string>>>")
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
        item_words(F.col(text_col)).alias("words"),
    )
    scanned = texts.select(
        "doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), F.concat(none, *map(passing, widths)).alias("found")
    )
    scanned = settle(scanned, "scanned")
    small = windows.count() <= BROADCAST_WINDOWS
    windows = F.broadcast(windows) if small else windows
    hits = scanned.select("doc_id", "text_hash", F.inline("found")).join(windows, "window")
    hits = hits.groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("start", "width")).alias("spans"), F.collect_set("items").alias("items")
    )
    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["width"] - 1)))
    hits = hits.select(
        F.col("doc_id").alias("id"),
        F.col("text_hash").alias("hash"),
        F.size(F.array_distinct(covered)).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"),
        F.array_sort("spans").alias("spans"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    return scanned.join(hits, same, "left").select(
        "doc_id",
        "text_hash",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,width:int>>")).alias("spans"),
    )


_ID, _HASH, _SPANS = (f"__{c}_of_hits" for c in ("id", "hash", "spans"))


def _with_result(docs: DataFrame, found: DataFrame, how: str, id_col: str, text_col: str) -> DataFrame:
    """Join each document with the spans found for its id and text (one row however often it is there).

    What was found is written and its size measured: while it is small, texts stay where they are.
    """
    found = found.filter("n_hit > 0").groupBy(F.col("doc_id").alias(_ID), F.col("text_hash").alias(_HASH)).agg(F.first("spans").alias(_SPANS))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(_ID)) & (F.xxhash64(F.col(text_col)) == F.col(_HASH))
    return docs.join(broadcast_small(settle(found, "hits")), same, how)


def drop_contaminated(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without any hit, with all their columns. ``found`` is what ``contamination`` gave.

    Null and empty texts hold no hit and stay; null ids are equal to each other; repeated rows go or
    stay together.
    """
    return _with_result(docs, found, "left_anti", id_col, text_col)


def remove_spans(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents, with the words of hits cut out of their texts; what stood between words stays.

    Rows as in :func:`drop_contaminated`; null texts stay null.
    """
    gaps = F.split(F.col(text_col), ANY_CASE_WORD, -1)
    words = F.regexp_extract_all(F.col(text_col), F.lit(ANY_CASE_WORD), F.lit(0))
    hit = F.array_distinct(F.flatten(F.transform(_SPANS, lambda s: F.sequence(s["start"], s["start"] + s["width"] - 1))))

    def cut(held: Column) -> Column:
        kept = F.transform(words, lambda w, i: F.when(F.array_contains(held, i + 1), F.lit("")).otherwise(w))
        return F.array_join(F.zip_with(gaps, kept, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")

    text = F.when(F.col(_SPANS).isNull(), F.col(text_col)).otherwise(let(hit, cut))
    joined = _with_result(docs, found, "left", id_col, text_col)
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
