"""Sheets exported as CSV, cut into chunks by byte ranges of their files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hindcast.operators.spread import broadcast_small, spread_join
from hindcast.sources.shared import settle

# A record that holds nothing but separators, quotes and white space is empty.
_FILLED = re.compile(r'[^,"\s]')
_FIELD = r',((?:[^",]++|"[^"]*+")*+)'
_PIECES = "path string, split long, piece int, first long, records array<string>, head string, closed boolean, tail string, n_records long"
_ARROW = pa.schema(
    [
        ("path", pa.string()), ("split", pa.int64()), ("piece", pa.int32()), ("first", pa.int64()), ("records", pa.list_(pa.string())),
        ("head", pa.string()), ("closed", pa.bool_()), ("tail", pa.string()), ("n_records", pa.int64()),
    ]
)


class _Split:
    """Records of the lines of one byte range, as they come."""

    def __init__(self, path: str, split: int, open_: bool, most: int):
        self.path, self.split, self.most = path, split, most
        # Lines before the first border belong to a record of an earlier range.
        self.in_head, self.open = open_, open_
        self.head: list[str] = []
        self.lines: list[str] = []
        self.records: list[str] = []
        self.piece = self.count = 0

    def add(self, line: str) -> Iterator[dict]:
        if line.count('"') % 2:
            self.open = not self.open
        (self.head if self.in_head else self.lines).append(line)
        if self.open:
            return
        if self.in_head:
            self.in_head = False
            return
        yield from self._record("\n".join(self.lines))
        self.lines = []

    def _record(self, record: str) -> Iterator[dict]:
        record = record.removesuffix("\r")
        if _FILLED.search(record):
            self.records.append(record)
        if len(self.records) == self.most:
            yield self._cut()

    def _cut(self, **ends) -> dict:
        row = {"path": self.path, "split": self.split, "piece": self.piece, "first": self.count, "records": self.records, **ends}
        self.count, self.piece, self.records = self.count + len(self.records), self.piece + 1, []
        return row

    def end(self) -> dict:
        """What is left, with the ends of records that other ranges have parts of, and the range's number of records."""
        head = "\n".join(self.head) if self.head else None
        row = self._cut(head=head, closed=not self.in_head, tail="\n".join(self.lines) if self.lines else None)
        return row | {"n_records": self.count}


def _assembled(most: int):
    """Records of each range, at most ``most`` in a piece."""

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Split | None = None
        for batch in batches:
            for path, split, open_, line in zip(*(batch.column(c).to_pylist() for c in ("path", "split", "open", "value")), strict=True):
                if now is None or (now.path, now.split) != (path, split):
                    if now is not None:
                        yield pa.RecordBatch.from_pylist([now.end()], _ARROW)
                    now = _Split(path, split, open_, most)
                for row in now.add(line):
                    yield pa.RecordBatch.from_pylist([row], _ARROW)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.end()], _ARROW)

    return assemble


def _cells(record: Column) -> Column:
    def unquoted(cell: Column) -> Column:
        bare = F.when(
            cell.startswith('"') & cell.endswith('"') & (F.length(cell) >= 2),
            F.replace(F.substr(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"')),
        ).otherwise(cell)
        return F.nullif(bare, F.lit(""))

    return F.transform(F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_FIELD)), unquoted)


def _openness(lines: DataFrame) -> DataFrame:
    """``path, split, open``: whether a range starts inside quotes; a row for each range of a file."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    ranges = settle(lines.groupBy("path", "split").agg(F.sum(quotes).alias("quotes")), "ranges")
    upto = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.coalesce(F.sum("quotes").over(upto), F.lit(0)) % 2 == 1
    uneven = F.sum("quotes").over(Window.partitionBy("path")) % 2 == 1
    message = F.concat(F.col("path"), F.lit(": a quote is never closed"))
    checked = F.when(uneven, F.raise_error(message).cast("boolean")).otherwise(open_)
    return settle(ranges.select("path", "split", checked.alias("open")), "ranges")


def _over_borders(pieces: DataFrame) -> DataFrame:
    """Records that run over borders of ranges: ``path, split, record``, the split being where they start.

    A range has two ends at most, each a part of one record, so a file's ends are few.
    """
    ends = pieces.filter("head IS NOT NULL OR tail IS NOT NULL")
    parts = F.array(
        F.when(F.col("head").isNotNull(), F.struct(F.lit(0).alias("place"), F.col("head").alias("text"))),
        F.when(F.col("tail").isNotNull(), F.struct(F.lit(1).alias("place"), F.col("tail").alias("text"))),
    )
    parts = ends.select("path", "split", F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("p")).select("path", "split", "p.*")
    along = Window.partitionBy("path").orderBy("split", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("record_no", F.sum("place").over(along))
    whole = parts.groupBy("path", "record_no").agg(
        F.min("split").alias("split"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "place", "text"))), lambda p: p["text"]), "\n").alias("record")
    )
    return whole.select("path", "split", F.regexp_replace("record", r"\r$", "").alias("record")).filter(F.col("record").rlike(_FILLED.pattern))


def csv_chunks(spark: SparkSession, path: str, pattern: str, head_rows: int, most: int) -> DataFrame:
    """``path, chunk, head, rows`` of all CSV files below ``path``; a chunk has ``most`` rows at most.

    Files are read by byte ranges. A first pass counts the quotes of each range; whether those
    before it are even tells if it starts inside a quoted cell. A second pass puts the lines of each range
    together to records, which are written as pieces of ``most``; what a range has of a record that
    another range began or ends is joined from the ends. Records are numbered by the ranges' counts. No
    row is shuffled, except the records over borders; a record has to fit a task, a file does not.
    A file with an odd number of quotes raises an error; one without any record is one
    chunk without rows, unless it has no byte.
    """
    lines = spark.read.option("pathGlobFilter", pattern).option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), "value")
    opened = broadcast_small(_openness(lines))
    # A broadcast join leaves lines in their order; beyond it, they are put in order again.
    marked = lines.withColumn("at", F.monotonically_increasing_id()).join(opened, ["path", "split"])
    if not _is_broadcast(opened):
        marked = marked.repartition("path", "split").sortWithinPartitions("path", "split", "at")
    pieces = settle(marked.select("path", "split", "open", "value").mapInArrow(_assembled(most), _PIECES), "pieces")

    # At most one record over its end for each range, which comes after the range's own.
    over = settle(_over_borders(pieces), "over-borders")
    counts = pieces.filter("n_records IS NOT NULL").select("path", "split", (F.col("piece") + 1).alias("pieces"), "n_records")
    counts = counts.join(over.select("path", "split", F.lit(1).alias("more")), ["path", "split"], "left").na.fill(0, ["more"])
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "path", "split", "pieces", "n_records",
        F.coalesce(F.sum(F.col("n_records") + F.col("more")).over(before), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum(F.col("pieces") + F.col("more")).over(before), F.lit(0)).alias("chunks_before"),
    )
    counts = broadcast_small(settle(counts, "counts"))
    own = pieces.select("path", "split", "piece", "first", "records").join(counts, ["path", "split"])
    own = own.select("path", (F.col("chunks_before") + F.col("piece")).alias("chunk"), (F.col("rows_before") + F.col("first")).alias("first"), "records")
    late = over.join(counts, ["path", "split"])
    late = late.select("path", (F.col("chunks_before") + F.col("pieces")).alias("chunk"), (F.col("rows_before") + F.col("n_records")).alias("first"), F.array("record").alias("records"))
    rows = F.transform("records", lambda r, i: F.struct((F.col("first") + i).cast("int").alias("row_idx"), _cells(r).alias("cells")))
    chunks = own.unionByName(late).filter("chunk = 0 OR size(records) > 0").select("path", F.col("chunk").cast("int").alias("chunk"), "first", rows.alias("rows"))
    heads = chunks.filter(F.col("first") < head_rows).select("path", F.inline("rows")).filter(F.col("row_idx") < head_rows)
    heads = heads.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("row_idx", "cells"))).alias("head"))
    joined = spread_join(chunks, heads, "path", F.col("chunk"), "left")
    none = F.array().cast("array<struct<row_idx:int,cells:array<string>>>")
    return joined.select("path", "chunk", F.coalesce("head", none).alias("head"), "rows")


def _is_broadcast(df: DataFrame) -> bool:
    return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
