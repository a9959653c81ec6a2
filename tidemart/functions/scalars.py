"""Dates, numbers, keys and JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
HOUR_MS = 3_600_000


def age_years(birthday: Column, as_of: Column) -> Column:
    """Whole calendar years from ``birthday`` to ``as_of`` (both dates)."""
    before_birthday = (F.month(as_of) * 100 + F.day(as_of)
                       < F.month(birthday) * 100 + F.day(birthday))
    return F.year(as_of) - F.year(birthday) - F.when(before_birthday, 1).otherwise(0)


def ts_to_dt(ts_ms: Column, zone: str = "UTC") -> Column:
    """Epoch milliseconds -> ``yyyy-MM-dd``. Does not depend on the session time zone."""
    if zone == "UTC":
        return F.date_from_unix_date(_days(ts_ms).cast("int")).cast("string")
    return _wall_clock(ts_ms, zone).cast("date").cast("string")


def ts_to_hr(ts_ms: Column, zone: str = "UTC") -> Column:
    """Epoch milliseconds -> two-digit hour."""
    if zone == "UTC":
        hour = F.floor(F.pmod(ts_ms, F.lit(DAY_MS)) / HOUR_MS)
    else:
        hour = F.hour(_wall_clock(ts_ms, zone))
    return F.lpad(hour.cast("string"), 2, "0")


def day_start(ts_ms: Column, zone: str = "UTC") -> Column:
    """The instant at which the day of ``ts_ms`` begins, as TIMESTAMP; by the zone's clock, read as UTC."""
    if zone != "UTC":
        return F.timestamp_seconds(F.unix_date(_wall_clock(ts_ms, zone).cast("date")).cast("bigint") * 86_400)
    return F.timestamp_millis(ts_ms - F.pmod(ts_ms, F.lit(DAY_MS)))


def _days(ts_ms: Column) -> Column:
    return ((ts_ms - F.pmod(ts_ms, F.lit(DAY_MS))) / DAY_MS)


def _wall_clock(ts_ms: Column, zone: str) -> Column:
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    utc = epoch + F.make_dt_interval(secs=(ts_ms / 1000).cast("decimal(18,6)"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def create_date(create_time: Column) -> Column:
    """``yyyy-MM-dd`` part of ``yyyy-MM-dd HH:mm:ss``."""
    return F.split_part(create_time, F.lit(" "), F.lit(1))


def create_hour(create_time: Column) -> Column:
    """``HH`` part of ``yyyy-MM-dd HH:mm:ss``."""
    return F.split_part(F.split_part(create_time, F.lit(" "), F.lit(2)), F.lit(":"), F.lit(1))


def event_time(create_time: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` read as UTC, as TIMESTAMP; NULL if it is not a time."""
    return F.concat(create_time, F.lit("Z")).try_cast("timestamp")


def str_to_long(text: Column) -> Column:
    """NULL where the text is no whole number."""
    return text.try_cast("bigint")


def day_shift(day: Column, days: int) -> Column:
    """The date text ``days`` after ``day``."""
    return F.date_add(F.to_date(day), days).cast("string")


def fact_topic(table: Column, op: Column, suffix: str) -> Column:
    # fixed value: topic names read DWD_<TABLE>_<I|U|D>_<suffix>
    return F.concat(F.lit("DWD_"), F.upper(table), F.lit("_"), op, F.lit(f"_{suffix}"))


def dim_key(table: Column, row_id: Column) -> Column:
    # fixed value: dimension keys read DIM:<TABLE>:<id>
    return F.concat(F.lit("DIM:"), F.upper(table), F.lit(":"), row_id.cast("string"))


def record_to_json(*columns: str | Column) -> Column:
    """The named columns as one JSON object; NULL columns are left out."""
    return F.to_json(F.struct(*columns))

