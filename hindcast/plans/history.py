"""Folder of planning grids to checked forecast history."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from hindcast.operators import grid, quality, waterfall
from hindcast.operators.spread import is_small
from hindcast.sources.history import STAGING, read_history_csv, read_history_parquet, staged, write_history_csv, write_history_parquet
from hindcast.sources.shared import passing_tables, settle
from hindcast.sources.sheets import heads_of_chunks, heads_of_rows, read_workbooks

FORMS = {"csv": (write_history_csv, read_history_csv), "parquet": (write_history_parquet, read_history_parquet)}


class GridFolder:
    """What a folder of grids holds, all files parsed at once.

    Grids are given as chunks or as single rows. For one result the plan may run straight
    through. With ``settled`` each part that several results share is written when first
    asked for: decoded chunks, the layout, the melt and the facts. Rows are a stored table
    already and are not copied; the layout that they are joined to is written in any case, and
    broadcast while it measures little.
    """

    def __init__(
        self, chunks: DataFrame | None = None, rows: DataFrame | None = None, settled: bool = False
    ) -> None:
        if (chunks is None) == (rows is None):
            raise ValueError("give chunks or rows")
        self._settled = settled
        self._chunks = chunks
        self._rows = rows

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        return settle(df, name) if self._settled else df

    @cached_property
    def source(self) -> DataFrame:
        return self._rows if self._chunks is None else self._keep(self._chunks, "grid-source")

    @cached_property
    def layout(self) -> DataFrame:
        heads = heads_of_rows(self.source) if self._chunks is None else heads_of_chunks(self.source)
        return self._keep(grid.grid_layout(heads), "grid-layout")

    @cached_property
    def bound(self) -> DataFrame:
        if self._chunks is not None:
            return grid.bound_chunks(self.source)
        layout = self.layout if self._settled else settle(self.layout, "grid-layout")
        return grid.bound_rows(self.source, layout, small=is_small(layout))

    @cached_property
    def long(self) -> DataFrame:
        return self._keep(grid.melt(self.bound, strict=False), "grid-long")

    @cached_property
    def facts(self) -> DataFrame:
        return self._keep(grid.file_facts(self.bound, self.layout), "grid-facts")

    @cached_property
    def totals(self) -> DataFrame:
        return grid.grand_totals(self.bound)

    @cached_property
    def checked(self) -> DataFrame:
        return quality.reconcile(self.long, self.totals)

    def violations(self, expected_files: int = quality.EXPECTED_FILES, tolerance: float = quality.TOLERANCE) -> DataFrame:
        return quality.violations(self.facts, self.checked, expected_files, tolerance)

    def profile(self) -> DataFrame:
        return grid.profile(self.facts)

    def validation(self) -> DataFrame:
        return quality.validation(self.facts, self.checked)

    def history(self) -> DataFrame:
        return waterfall.waterfall(self.long)


def write_history(
    folder: GridFolder,
    output: str,
    expected_files: int = quality.EXPECTED_FILES,
    tolerance: float = quality.TOLERANCE,
    form: str = "csv",
) -> DataFrame:
    """Check every file, and only if all pass, write the history; returns what was written.

    ``form`` is ``csv`` or ``parquet``, the latter with a folder for each calculation month.
    Each run writes a folder of its own below ``output``, so the history before it stays whole
    until the new one is, and readers of a folder never see half of one. It is written to a
    hidden folder first and read back to check it for malformed month keys; only if it passes does it
    get its name, by one rename. If it does not, nothing is left.
    """
    if form not in FORMS:
        raise ValueError(f"form is one of {sorted(FORMS)}")
    write, read = FORMS[form]
    quality.enforce(folder.violations(expected_files, tolerance))
    spark, name = folder.long.sparkSession, f"history-{uuid.uuid4().hex}"
    output = output.rstrip("/")
    with staged(spark, f"{output}/{STAGING}/{name}", f"{output}/{name}") as path:
        write(folder.history(), path)
        quality.enforce(quality.month_key_violations(read(spark, path)))
    return read(spark, f"{output}/{name}")


def build_history(
    spark: SparkSession, folder: str, output: str, expected_files: int = quality.EXPECTED_FILES
) -> DataFrame:
    """`write_history` for a folder of workbooks; leaves no other tables behind."""
    with passing_tables(spark):
        return write_history(GridFolder(read_workbooks(spark, folder), settled=True), output, expected_files)
