"""Writers and reader of the consolidated forecast history."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from hindcast.operators.waterfall import WATERFALL_ORDER

WATERFALL = T.StructType(
    [
        T.StructField("calculation_month", T.StringType()),
        T.StructField("snop_month", T.StringType()),
        T.StructField("parent_code", T.LongType()),
        T.StructField("parent_description", T.StringType()),
        T.StructField("qty", T.DoubleType()),
    ]
)


# Readers of a folder pass over names that begin with an underscore.
STAGING = "_staging"


@contextmanager
def staged(spark: SparkSession, aside: str, place: str) -> Iterator[str]:
    """A path to write to, which gets its place when the block ends well and is removed when it raises.

    The rename is one step on a file system that has folders; readers see nothing of ``place`` before.
    """
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (aside, place))
    files = source.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        yield aside
        if not files.rename(source, target):
            raise OSError(f"{aside} could not be renamed to {place}")
        _remove_if_empty(files, source.getParent())
    except BaseException:
        files.delete(source, True)
        if files.exists(source.getParent()):
            _remove_if_empty(files, source.getParent())
        raise


def _remove_if_empty(files, folder) -> None:
    if not files.listStatus(folder):
        files.delete(folder, False)


def write_history_csv(history: DataFrame, path: str) -> None:
    """CSV files with a header, in output order over the whole folder, into a folder that is new."""
    history.orderBy(*WATERFALL_ORDER).write.option("header", True).csv(path)


def read_history_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WATERFALL).option("header", True).option("mode", "FAILFAST").csv(path)


def read_history_parquet(spark: SparkSession, path: str) -> DataFrame:
    """The month keys stay text, though they stand in folder names."""
    return spark.read.schema(WATERFALL).parquet(path).select(*WATERFALL.names)


def write_history_parquet(history: DataFrame, path: str) -> None:
    """Parquet by calculation month, into a new folder; readers of some months skip the others.

    Rebalancing puts a month into few files and splits one that outgrows them.
    """
    (
        history.hint("rebalance", "calculation_month")
        .sortWithinPartitions("calculation_month", *WATERFALL_ORDER[:2])
        .write.partitionBy("calculation_month")
        .parquet(path)
    )
