"""Typed readers of the three inputs of the matched frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.operators.matched import ACTUALS_HEADER, brand_of_product, monthly_actuals, typed_forecasts
from hindcast.sources.sheets import named_columns, read_workbooks

FORECASTS_CSV = T.StructType(
    [
        T.StructField("parent_code", T.LongType()),
        T.StructField("calculation_month", T.StringType()),
        T.StructField("snop_month", T.StringType()),
        T.StructField("fc_kl", T.DoubleType()),
    ]
)
# Header names of the hierarchy after normalisation, and each sheet's header row.
ACTUALS_HEADER_ROW = 5
HIERARCHY_HEADER = ["material_code", "material_desc", "material_group_code"]
HIERARCHY_HEADER_ROW = 0


def read_forecasts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Forecast CSV files of a folder, or those whose name matches ``pattern`` (``forec*``).

    The schema is given, so nothing is read to infer it; a malformed row raises, and so
    does a header that names other columns.
    """
    raw = (
        spark.read.schema(FORECASTS_CSV)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("pathGlobFilter", pattern)
        .csv(path)
    )
    return typed_forecasts(raw)


def read_actuals(spark: SparkSession, path: str) -> DataFrame:
    """Actual-sales workbooks, whose header is the sixth sheet row, as monthly volumes."""
    chunks = read_workbooks(spark, path, sheet=None, drop_empty=False)
    return monthly_actuals(named_columns(chunks, ACTUALS_HEADER_ROW, ACTUALS_HEADER).drop("file"))


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """Product-hierarchy workbooks, header in the first row, as one brand per product."""
    chunks = read_workbooks(spark, path, sheet=None, drop_empty=False)
    named = named_columns(chunks, HIERARCHY_HEADER_ROW, HIERARCHY_HEADER).drop("file")
    return brand_of_product(named.filter(F.col("material_code").isNotNull()))
