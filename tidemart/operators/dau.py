"""The daily-active-devices table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemart import schemas as S
from tidemart.functions.scalars import ts_to_dt, ts_to_hr
from tidemart.operators.dedup import dau_dedup, session_first_page
from tidemart.operators.dims import lookup_province, lookup_user


def dau_wide(devices: DataFrame, users: DataFrame, provinces: DataFrame, as_of: Column,
             zone: str = "UTC") -> DataFrame:
    """Deduplicated page rows -> rows of ``DAU_WIDE``."""
    dated = (devices.withColumn("dt", ts_to_dt(F.col("ts"), zone))
             .withColumn("hr", ts_to_hr(F.col("ts"), zone)))
    wide = lookup_province(lookup_user(dated, users, as_of), provinces)
    return wide.select(*(F.col(c).cast(kind).alias(c) for c, kind in S.DAU_WIDE))


def dau_table(pages: DataFrame, users: DataFrame, provinces: DataFrame, as_of: Column,
              order: list[str] | None = None, zone: str = "UTC") -> DataFrame:
    """Page rows -> daily-active table: few rows are left before anything is looked up."""
    return dau_wide(dau_dedup(session_first_page(pages), order, zone), users, provinces, as_of, zone)


def first_seen(pages: DataFrame, zone: str = "UTC") -> DataFrame:
    """``mid, dt, hr, ts`` of the daily-active table, for questions that need no more of it.

    Only the time is carried along, so it is a hash aggregate of a number: no sort, and no
    lookups.
    """
    openers = session_first_page(pages).select("mid", "ts")
    first = openers.groupBy("mid", ts_to_dt(F.col("ts"), zone).alias("dt")).agg(F.min("ts").alias("ts"))
    return first.select("mid", "dt", ts_to_hr(F.col("ts"), zone).alias("hr"), "ts")
