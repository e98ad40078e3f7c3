"""Sheets as one table of chunks: (file, chunk, head, rows).

A chunk is a bounded run of rows of one sheet. Each carries the first rows of its sheet,
so whatever the header decides can be worked out inside the chunk: no row of a sheet has
to be shuffled to meet its header, and a sheet with many rows is just many chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.functions.text import normal_name_col
from hindcast.sources.csv_sheets import csv_chunks
from hindcast.sources.workbook import sheet_rows

_ROWS = "array<struct<row_idx:int,cells:array<string>>>"
SHEET_CHUNKS = f"file string, chunk int, head {_ROWS}, rows {_ROWS}"
SHEET_ROWS = "file string, row_idx int, cells array<string>"
_ARROW_ROWS = pa.list_(pa.struct([("row_idx", pa.int32()), ("cells", pa.list_(pa.string()))]))
_ARROW_CHUNKS = pa.schema([("file", pa.string()), ("chunk", pa.int32()), ("head", _ARROW_ROWS), ("rows", _ARROW_ROWS)])
# Fixed value: the sheet that holds the planning grid.
GRID_SHEET = "full_s&op"
# Fixed value: rows of a sheet that may hold its header.
HEADER_ROWS = 6
ROWS_PER_CHUNK = 1000


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def list_files(spark: SparkSession, folder: str, pattern: str = "*.xlsx") -> DataFrame:
    """Name, size in KB and time of change of the files of a folder, by name.

    The file content is not selected, so it is not read either.
    """
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select(
            base_name(F.col("path")).alias("file"),
            F.bround(F.col("length") / 1024, 1).alias("size_kb"),
            F.col("modificationTime").alias("modified"),
        )
        .orderBy("file")
    )


def _chunks(content: bytes, file: str, sheet: str | None, drop_empty: bool, head_rows: int) -> Iterator[dict]:
    """Chunks of one sheet; one without rows when the sheet is absent or empty."""
    head: list[dict] = []
    held: list[dict] = []
    chunk = 0
    for row_idx, cells in sheet_rows(content, sheet, drop_empty):
        row = {"row_idx": row_idx, "cells": cells}
        if row_idx < head_rows:
            head.append(row)
        held.append(row)
        if len(held) == ROWS_PER_CHUNK:
            yield {"file": file, "chunk": chunk, "head": head, "rows": held}
            chunk, held = chunk + 1, []
    if held or chunk == 0:
        yield {"file": file, "chunk": chunk, "head": head, "rows": held}


def read_workbooks(
    spark: SparkSession,
    path: str,
    sheet: str | None = GRID_SHEET,
    pattern: str = "*.xlsx",
    drop_empty: bool = True,
    head_rows: int = HEADER_ROWS,
) -> DataFrame:
    """Chunks of one sheet of every workbook below ``path``, each with the first ``head_rows``.

    One task decodes whole workbooks, which the format bounds at 1,048,576 rows each.
    A workbook without the sheet, or with an empty one, gives one chunk without rows,
    so that later checks still see the file.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"]):
                for chunk in _chunks(content.as_py(), file.as_py(), sheet, drop_empty, head_rows):
                    yield pa.RecordBatch.from_pylist([chunk], _ARROW_CHUNKS)

    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(path)
        .select(base_name(F.col("path")).alias("file"), "content")
        .mapInArrow(decode, SHEET_CHUNKS)
    )


def heads_of_chunks(chunks: DataFrame) -> DataFrame:
    """File and first rows, one row per file."""
    return chunks.filter(F.col("chunk") == 0).select("file", "head")


def heads_of_rows(rows: DataFrame) -> DataFrame:
    """The same from a table of `SHEET_ROWS`, such as grids stored by another job.

    The first cells of each index are kept before rows are gathered, so that a file has six
    of them at most, whatever its indices are.
    """
    return (
        rows.filter(F.col("row_idx") < HEADER_ROWS)
        .groupBy("file", "row_idx")
        .agg(F.min("cells").alias("cells"))
        .groupBy("file")
        .agg(F.array_sort(F.collect_list(F.struct("row_idx", "cells"))).alias("head"))
    )


def read_csv_sheets(spark: SparkSession, path: str, pattern: str = "*.csv", head_rows: int = HEADER_ROWS) -> DataFrame:
    """Chunks of sheets exported as CSV: quoted commas, doubled quotes and line breaks included.

    A file is read by as many tasks as it has byte ranges (:func:`hindcast.sources.csv_sheets.csv_chunks`).
    Empty rows are dropped before rows are numbered, and empty cells are null.
    """
    chunks = csv_chunks(spark, path, pattern, head_rows, ROWS_PER_CHUNK)
    name = base_name(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))))
    return chunks.select(name.alias("file"), "chunk", "head", "rows")


def named_columns(chunks: DataFrame, header_row: int, names: list[str]) -> DataFrame:
    """Columns picked by normalised header name from sheets with a header row.

    Each file is read by its own header; a header that lacks one of ``names`` raises.
    """
    header = F.get(F.filter("head", lambda h: h["row_idx"] == header_row), F.lit(0))["cells"]

    def picked(name: str) -> Column:
        place = F.array_position("header", name).cast("int")
        return F.when(place > 0, F.get("row.cells", place - 1)).otherwise(
            F.raise_error(F.concat(F.col("file"), F.lit(f": no header row with a column {name}"))).cast("string")
        )

    return (
        chunks.select("file", F.transform(header, normal_name_col).alias("header"), F.explode("rows").alias("row"))
        .filter(F.col("row.row_idx") > header_row)
        .select("file", *[picked(name).alias(name) for name in names])
    )
