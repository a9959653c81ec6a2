"""Reading stored tables that are partitioned by day."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``, or no rows if nothing was ever written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def of_day(df: DataFrame, day: str | None, column: str = "dt") -> DataFrame:
    """One day's rows (all days if None). A day never written simply has no rows."""
    return df if day is None else df.where(F.col(column) == day)


def read_field(df: DataFrame, field: str, day: str | None = None) -> DataFrame:
    """One field of every row of a day."""
    return of_day(df, day).select(field)


def get_by_id(df: DataFrame, value, key: str = "id") -> DataFrame:
    return df.where(F.col(key) == value)


def write_by_key(df: DataFrame, path: str, key: str, files: int, values: int | None = None) -> None:
    """A table for look-ups by ``key``: files hold ranges of it, sorted, with a Bloom filter of its values in each row group.

    A look-up reads the row groups whose range has the key, and of these those whose filter does not rule it out; others
    are passed over by their footers. ``values`` is about how many values a row group has.
    """
    writer = df.repartitionByRange(files, key).sortWithinPartitions(key).write.option(f"parquet.bloom.filter.enabled#{key}", "true")
    if values:
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{key}", str(values))
    writer.parquet(path)
