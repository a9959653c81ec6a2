"""Dashboard questions over the two wide tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemart.functions.scalars import day_shift
from tidemart.functions.text import match_all_terms
from tidemart.sources.tables import of_day

# fixed values: names of the gender and age groups, in order of output
MALE, FEMALE = "男", "女"
UNDER_20, FROM_20_TO_29, FROM_30 = "20岁以下", "20岁至29岁", "30岁以上"


def dau_total(dau: DataFrame, day: str) -> DataFrame:
    """Active devices of a day; 0 if there is nothing for it."""
    return of_day(dau, day).agg(F.count("*").alias("total"))


def dau_totals(dau: DataFrame) -> DataFrame:
    return dau.groupBy("dt").agg(F.count("*").alias("total"))


def dau_by_hour(dau: DataFrame, day: str | None = None) -> DataFrame:
    return of_day(dau, day).groupBy("dt", "hr").agg(F.count("*").alias("n"))


def dau_realtime(dau: DataFrame, day: str | None = None) -> DataFrame:
    """``dt, series, hr, n``: a day's total, its hours and the hours of the day before.

    Without ``day``, for every day in the table. The table is read once: each hour's count
    is used for its own day and the day after.
    """
    return realtime_of_hours(dau_by_hour(_day_and_before(dau, day)), day)


def _day_and_before(rows: DataFrame, day: str | None) -> DataFrame:
    return rows if day is None else rows.where(F.col("dt").isin(day) | (F.col("dt") == day_shift(F.lit(day), -1)))


def realtime_of_hours(hours: DataFrame, day: str | None = None) -> DataFrame:
    """``dau_realtime`` from ``dt, hr, n``, such as the stored counts that a stream keeps up; devices are not read."""
    hours = _day_and_before(hours, day).where("n <> 0")

    def entry(day_column: Column, series: str, hr: Column) -> Column:
        return F.struct(day_column.alias("dt"), F.lit(series).alias("series"),
                        hr.alias("hr"), F.col("n").alias("n"))
    own, dt = F.col("hr"), F.col("dt")
    entries = hours.select(F.inline(F.array(
        entry(dt, "total", F.lit(None).cast("string")), entry(dt, "today", own),
        entry(day_shift(dt, 1), "yesterday", own))))
    if day is not None:
        entries = entries.where(F.col("dt") == day)
    return entries.groupBy("dt", "series", "hr").agg(F.sum("n").alias("n"))


def fill_hours(by_hour: DataFrame) -> DataFrame:
    """All 24 hours of each day in ``by_hour``, 0 where there was nothing."""
    every = by_hour.select("dt").distinct().select(
        "dt", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("_h")).select(
        "dt", F.lpad(F.col("_h").cast("string"), 2, "0").alias("hr"))
    return every.join(by_hour, ["dt", "hr"], "left").select(
        "dt", "hr", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def _matching(order_wide: DataFrame, keyword: str, day: str | None) -> DataFrame:
    hits = order_wide.where(match_all_terms(F.col("sku_name"), keyword))
    return hits if day is None else hits.where(F.col("create_date") == day)


def sales_by_field(order_wide: DataFrame, keyword: str, field: str, day: str | None = None,
                   groups: int = 100) -> DataFrame:
    """``name, total_amount, doc_count``: sales of a keyword per value, most lines first.

    Rows without a value form no group.
    """
    return (_matching(order_wide, keyword, day).where(F.col(field).isNotNull())
            .groupBy(F.col(field).cast("string").alias("name"))
            .agg(F.sum("split_total_amount").cast("double").alias("total_amount"),
                 F.count("*").alias("doc_count"))
            .orderBy(F.desc("doc_count"), "name").limit(groups))


def _banded(order_wide: DataFrame, keyword: str, day: str | None, field: str,
            bands: list[tuple[str, Column]]) -> DataFrame:
    """One total per band, all bands or, without any row, none."""
    hits = _matching(order_wide, keyword, day).where(F.col(field).isNotNull())
    amount = F.col("split_total_amount")
    sums = hits.agg(F.count("*").alias("_rows"), *(
        F.coalesce(F.sum(F.when(test, amount)), F.lit(0)).cast("double").alias(f"_{i}")
        for i, (_, test) in enumerate(bands)))
    pairs = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(name).alias("name"), F.col(f"_{i}").alias("value"))
                      for i, (name, _) in enumerate(bands)))
    return sums.where("_rows > 0").select(F.inline(pairs))


def sales_by_gender(order_wide: DataFrame, keyword: str, day: str | None = None) -> DataFrame:
    """``pos, name, value``: male then female; whatever is not F counts as male."""
    female = F.col("user_gender") == "F"
    return _banded(order_wide, keyword, day, "user_gender", [(MALE, ~female), (FEMALE, female)])


def sales_by_age_band(order_wide: DataFrame, keyword: str, day: str | None = None) -> DataFrame:
    """``pos, name, value``: under 20, 20 to 29, 30 and over."""
    age = F.col("user_age")
    return _banded(order_wide, keyword, day, "user_age", [
        (UNDER_20, age < 20), (FROM_20_TO_29, (age >= 20) & (age < 30)), (FROM_30, age >= 30)])


def stats_by_item(order_wide: DataFrame, keyword: str, day: str | None, kind: str) -> DataFrame:
    if kind == "gender":
        return sales_by_gender(order_wide, keyword, day)
    if kind == "age":
        return sales_by_age_band(order_wide, keyword, day)
    raise ValueError(f"statistics are by 'gender' or 'age', not {kind!r}")
