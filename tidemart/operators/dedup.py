"""One row per key, chosen by order.

All of these are aggregates, not windows: rows of one key are reduced inside each task
before the shuffle, so a key holding a third of all rows sends one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemart.functions.scalars import day_start, ts_to_dt


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """What is left of repeated writes under one id: the last."""
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def session_first_page(pages: DataFrame) -> DataFrame:
    """Pages that open a visit: no page came before."""
    return pages.where("last_page_id IS NULL")


def dau_dedup(pages: DataFrame, order: list[str] | None = None, zone: str = "UTC") -> DataFrame:
    """One row per device and day, the earliest. Each row counts for its own day."""
    with_day = pages.withColumn("dt", ts_to_dt(F.col("ts"), zone))
    return first_per_key(with_day, ["mid", "dt"], order or ["ts"])


def arrival(at: Column | None = None) -> Column:
    """When a row arrived: the start of its micro-batch, or ``at`` where the source knows better."""
    return F.current_timestamp() if at is None else F.coalesce(at, F.current_timestamp())


def dau_dedup_stream(pages: DataFrame, keep: str = "2 days", salts: int = 8, zone: str = "UTC",
                     at: Column | None = None) -> DataFrame:
    """The same on a stream: the first row of a device to arrive on a day.

    A device and day stay known for ``keep`` after their first row arrived, whatever the rows'
    own times are; so a row is never too late, and state does not depend on the order of rows.
    Two steps: rows of one device are spread over ``salts`` tasks that drop repeats, and
    what is left of it, ``salts`` rows a day at most, meets in one.
    """
    keyed = (pages.withColumn("day_ts", day_start(F.col("ts"), zone))
             .withColumn("_salt", F.pmod(F.col("ts"), F.lit(salts)).cast("int"))
             .withColumn("_at", arrival(at)).withWatermark("_at", keep))
    first = keyed.dropDuplicatesWithinWatermark(["mid", "day_ts", "_salt"])
    return first.dropDuplicatesWithinWatermark(["mid", "day_ts"]).drop("_salt", "_at")


def not_stored(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in ``stored`` yet: what a restarted job must still write."""
    known = stored.select(*keys).distinct()
    return rows.join(known, keys, "left_anti")

