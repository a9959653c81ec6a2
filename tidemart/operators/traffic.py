"""Traffic, user and order reports of the dashboard's further screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemart.functions.scalars import create_date, ts_to_dt


def last_days(rows: DataFrame, day: str | Column, until: str | None, days: int | None) -> DataFrame:
    """Rows of the ``days`` days that end with ``until``; all rows if either is None."""
    if until is None or days is None:
        return rows
    column = F.col(day) if isinstance(day, str) else day
    first = F.date_sub(F.lit(until).cast("date"), days - 1).cast("string")
    return rows.where((column >= first) & (column <= F.lit(until)))


def with_dt(pages: DataFrame, zone: str = "UTC") -> DataFrame:
    return pages.withColumn("dt", ts_to_dt(F.col("ts"), zone))


def page_days(pages: DataFrame, until: str | None, days: int | None, zone: str = "UTC") -> DataFrame:
    """Pages of the ``days`` days that end with ``until``, by the clock of ``zone``."""
    return last_days(pages, ts_to_dt(F.col("ts"), zone), until, days)


def order_days(orders: DataFrame, until: str | None, days: int | None) -> DataFrame:
    """Order headers or lines of the ``days`` days that end with ``until``."""
    return last_days(orders, create_date(F.col("create_time")), until, days)


def pv_by_day(pages: DataFrame, until: str | None = None, days: int | None = None) -> DataFrame:
    return last_days(with_dt(pages), "dt", until, days).groupBy("dt").agg(F.count("*").alias("pv"))


def uv_by_day(pages: DataFrame, until: str | None = None, days: int | None = None) -> DataFrame:
    return last_days(with_dt(pages), "dt", until, days).groupBy("dt").agg(F.countDistinct("mid").alias("uv"))


def visit_total(pages: DataFrame, until: str | None = None, days: int | None = None) -> DataFrame:
    """Views, devices and new devices. One row per device is made first, then counted."""
    new = (F.col("is_new") == "1").cast("int")
    device = last_days(with_dt(pages), "dt", until, days).groupBy("mid").agg(
        F.count("*").alias("_views"), F.max(new).alias("_new"))
    return device.agg(
        F.coalesce(F.sum("_views"), F.lit(0)).alias("pv_count"), F.count("mid").alias("uv_count"),
        F.coalesce(F.sum(F.when(F.col("mid").isNotNull(), F.col("_new"))), F.lit(0)).cast("bigint")
        .alias("new_count"))


def mark_visits(pages: DataFrame, order: list[str], slice_ms: int = 600_000) -> DataFrame:
    """Adds ``opens`` (first page of a visit) and ``bounces`` (only page of a visit).

    A visit of a device starts at its first page and at every page without a predecessor.
    What is needed of a page's neighbours is found inside slices of ``slice_ms`` of a
    device's time line, so that a device with very many pages is spread over many tasks.
    Only the first and last page of each slice then meet in one ordered list per device.
    """
    starts = F.col("last_page_id").isNull()
    in_slice = Window.partitionBy("mid", "_slice").orderBy(*order)
    sliced = (pages.withColumn("_starts", starts)
              .withColumn("_slice", F.floor(F.col("ts") / slice_ms))
              .withColumn("_next", F.lead("_starts").over(in_slice))
              .withColumn("_first", F.lag("_starts").over(in_slice).isNull()))
    on_edge = F.col("_first") | F.col("_next").isNull()
    inside = sliced.where(~on_edge).withColumn("opens", F.col("_starts"))
    by_device = Window.partitionBy("mid").orderBy(*order)
    edges = (sliced.where(on_edge)
             .withColumn("opens", F.col("_starts") | F.lag("_starts").over(by_device).isNull())
             .withColumn("_next", F.coalesce("_next", F.lead("_starts").over(by_device), F.lit(True))))
    return (inside.unionByName(edges)
            .withColumn("bounces", F.col("opens") & F.col("_next"))
            .drop("_starts", "_slice", "_next", "_first"))


def visit_stats(pages: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Per value of ``by``: views, devices, visits, one-page visits and time on pages.

    A view counts for its own value, a visit for that of its first page.
    """
    needed = pages.select("mid", "ts", "last_page_id", "during_time", by,
                          *(c for c in order if c not in ("ts", by)))
    # Pages without a device are views, but nobody's visit: they must not meet as one device.
    unknown = needed.where("mid IS NULL").withColumns({"opens": F.lit(False), "bounces": F.lit(False)})
    marked = mark_visits(needed.where("mid IS NOT NULL"), order).unionByName(unknown)
    device = marked.groupBy("mid", by).agg(
        F.count("*").alias("_pv"), F.sum(F.col("opens").cast("int")).alias("_visits"),
        F.sum(F.col("bounces").cast("int")).alias("_bounces"), F.sum("during_time").alias("_time"))
    return device.groupBy(by).agg(
        F.sum("_pv").alias("pv"), F.count("mid").alias("uv"), F.sum("_visits").alias("visits"),
        F.sum("_bounces").alias("bounces"), F.sum("_time").alias("total_time"))


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part.cast("double") / whole.cast("double"))


def new_vs_returning(pages: DataFrame, order: list[str], until: str | None = None,
                     days: int | None = None) -> DataFrame:
    """``field, old, new``: five measures of returning and of new devices."""
    stats = visit_stats(page_days(pages, until, days).where("is_new IS NOT NULL"), "is_new", order)
    measures = {
        "views": F.col("pv").cast("double"), "visitors": F.col("uv").cast("double"),
        "bounce_pct": _rate(F.col("bounces") * 100, F.col("visits")),
        "mean_visit_time": _rate(F.col("total_time"), F.col("visits")),
        "mean_pages": _rate(F.col("pv"), F.col("visits")),
    }
    new = F.col("is_new") == "1"
    # There are two rows at most, one per flag; `max` just picks the one there is.
    sides = stats.agg(*(F.max(F.when(side, value)).alias(f"{label}_{name}")
                        for name, value in measures.items()
                        for label, side in (("new", new), ("old", ~new))))
    rows = F.array(*(F.struct(F.lit(name).alias("field"), F.col(f"old_{name}").alias("old"),
                              F.col(f"new_{name}").alias("new")) for name in measures))
    return sides.select(F.inline(rows))


def channel_pv(pages: DataFrame, until: str | None = None, days: int | None = None) -> DataFrame:
    return page_days(pages, until, days).groupBy("channel").agg(F.count("*").alias("pv"))


def channel_bounce(pages: DataFrame, order: list[str], until: str | None = None,
                   days: int | None = None) -> DataFrame:
    stats = visit_stats(page_days(pages, until, days), "channel", order)
    return stats.select("channel", "visits", "bounces",
                        _rate(F.col("bounces") * 100, F.col("visits")).alias("bounce_pct"))


def page_path(pages: DataFrame, until: str | None = None, days: int | None = None) -> DataFrame:
    """How often each page led to each other page."""
    return (page_days(pages, until, days).where("last_page_id IS NOT NULL")
            .groupBy(F.col("last_page_id").alias("source"), F.col("page_id").alias("target"))
            .agg(F.count("*").alias("value")))


def user_total(users: DataFrame, pages: DataFrame, headers: DataFrame, until: str, days: int = 7) -> DataFrame:
    """Users, buyers, those first seen or first buying in the range, and spend per buyer."""
    def in_range(first: str) -> Column:
        end = F.lit(until).cast("date")
        return (F.col(first).cast("date") > F.date_sub(end, days)) & (F.col(first).cast("date") <= end)

    seen = with_dt(pages).where("user_id IS NOT NULL").groupBy("user_id").agg(F.min("dt").alias("_seen"))
    buyer = headers.where("user_id IS NOT NULL").groupBy("user_id").agg(
        F.min(F.split_part("create_time", F.lit(" "), F.lit(1))).alias("_bought"),
        F.sum("total_amount").alias("_spent"))
    new_users = seen.agg(F.count_if(in_range("_seen"))).scalar()
    all_users = users.agg(F.count("*")).scalar()
    return buyer.agg(
        F.count("*").alias("order_user_total"), F.count_if(in_range("_bought")).alias("new_order_user_count"),
        F.sum("_spent").cast("double").alias("_all")).select(
        all_users.alias("user_total"), "order_user_total", new_users.alias("new_user_count"),
        "new_order_user_count", _rate(F.col("_all"), F.col("order_user_total")).alias("pct"))


def user_paid(pages: DataFrame, headers: DataFrame, until: str | None = None, days: int | None = None) -> DataFrame:
    """Users active in the range, with and without an order in it."""
    pages, headers = page_days(pages, until, days), order_days(headers, until, days)
    active = pages.select(F.col("user_id").try_cast("bigint").alias("user_id")).where("user_id IS NOT NULL").distinct()
    buyers = headers.select("user_id", F.lit(True).alias("_paid")).distinct()
    return active.join(buyers, "user_id", "left").agg(
        F.count_if("_paid").alias("paid"), F.count_if(F.col("_paid").isNull()).alias("unpaid"))


def action_funnel(pages: DataFrame, steps: dict[str, str], until: str | None = None,
                  days: int | None = None) -> DataFrame:
    """``pos, step, users``: distinct users that saw each step's page, in the order of ``steps``.

    One row per user with a flag per step is made first: users are told apart once, not per step.
    """
    user = page_days(pages, until, days).where("user_id IS NOT NULL").groupBy("user_id").agg(*(
        F.max((F.col("page_id") == page).cast("int")).alias(f"_{i}") for i, page in enumerate(steps.values())))
    sums = user.agg(*(F.coalesce(F.sum(f"_{i}"), F.lit(0)).alias(f"_{i}") for i in range(len(steps))))
    return sums.select(F.inline(F.array(*(
        F.struct(F.lit(i).alias("pos"), F.lit(step).alias("step"), F.col(f"_{i}").alias("users"))
        for i, step in enumerate(steps)))))


def order_total(headers: DataFrame, until: str | None = None, days: int | None = None) -> DataFrame:
    """Orders, amount and buyers. One row per buyer is made first, then added up."""
    buyer = order_days(headers, until, days).groupBy("user_id").agg(F.count("*").alias("_n"), F.sum("total_amount").alias("_spent"))
    return buyer.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("order_count"),
        F.coalesce(F.sum("_spent"), F.lit(0)).cast("double").alias("order_amount"),
        F.count("user_id").alias("order_user"))


def orders_by_area(headers: DataFrame, provinces: DataFrame, until: str | None = None,
                   days: int | None = None) -> DataFrame:
    """Orders per province. Counted by id first; names are looked up for the counts."""
    counts = order_days(headers, until, days).groupBy("province_id").agg(F.count("*").alias("value"))
    named = provinces.select(F.col("id").alias("province_id"), "name")
    return counts.join(named, "province_id", "left").groupBy("name").agg(F.sum("value").alias("value"))


def _lines_per_product(lines: DataFrame) -> DataFrame:
    return lines.groupBy("sku_id").agg(F.count("*").alias("_lines"))


def _lines_by(lines: DataFrame, skus: DataFrame, field: str) -> DataFrame:
    """Lines per product attribute. Lines shrink to one row per product before the join."""
    attribute = skus.select(F.col("id").alias("sku_id"), F.col(field).alias("name"))
    return (_lines_per_product(lines).join(attribute, "sku_id", "left")
            .groupBy("name").agg(F.sum("_lines").alias("value")))


def orders_by_category(lines: DataFrame, skus: DataFrame, num: int = 7, rest: str = "other",
                       until: str | None = None, days: int | None = None) -> DataFrame:
    """The ``num`` categories with most lines, and all the rest as one."""
    counts = _lines_by(order_days(lines, until, days), skus, "category")
    top = counts.where("name IS NOT NULL").orderBy(F.desc("value"), "name").limit(num).select(
        "name", F.lit(True).alias("_top"))
    label = F.when(F.col("_top"), F.col("name")).otherwise(F.lit(rest))
    return (counts.join(top, "name", "left").groupBy(label.alias("name"))
            .agg(F.sum("value").alias("value")))


def top_products(lines: DataFrame, num: int = 7, until: str | None = None, days: int | None = None) -> DataFrame:
    names = order_days(lines, until, days).groupBy("sku_name").agg(F.count("*").alias("value"))
    return names.orderBy(F.desc("value"), "sku_name").limit(num).withColumnRenamed("sku_name", "name")


def top_brands(lines: DataFrame, skus: DataFrame, num: int = 7, until: str | None = None,
               days: int | None = None) -> DataFrame:
    return (_lines_by(order_days(lines, until, days), skus, "brand").where("name IS NOT NULL")
            .orderBy(F.desc("value"), "name").limit(num))
