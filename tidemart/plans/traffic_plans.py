"""Traffic, user and order reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart.functions import scalars
from tidemart.operators import heavy_hitters, traffic
from tidemart.plans import inputs as I
from tidemart.plans.registry import query
from tidemart.plans.views_sql import with_views
from tidemart.session import scratch_dir
from tidemart.sources import driver_tables as D

STEPS = {"home": "p0", "detail": "p1", "cart": "p2", "order": "p3", "payment": "p4"}


@query("pv_by_day", with_views("select dt, count(*) pv from day_page group by dt"))
def pv_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.pv_by_day(I.pages(spark, sf_dir))


@query("uv_by_day", with_views("select dt, count(distinct mid) uv from day_page group by dt"))
def uv_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.uv_by_day(I.pages(spark, sf_dir))


@query("visit_total", with_views("""
    select count(*) pv_count, count(distinct mid) uv_count,
           count(distinct case when is_new = '1' then mid end) new_count from page"""))
def visit_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.visit_total(I.pages(spark, sf_dir))


_STATS = """select {by}, count(*) pv, count(distinct mid) uv, count(*) filter (opens) visits,
    count(*) filter (opens and next_opens) bounces, sum(during_time) total_time
    from visit_page group by {by}"""


_MEASURES = {
    "views": "cast(pv as double)", "visitors": "cast(uv as double)",
    "bounce_pct": "case when visits <> 0 then cast(bounces * 100 as double) / visits end",
    "mean_visit_time": "case when visits <> 0 then cast(total_time as double) / visits end",
    "mean_pages": "case when visits <> 0 then cast(pv as double) / visits end",
}


@query("new_vs_returning", with_views(" union all ".join(
    f"""select '{name}' field, max({measure}) filter (is_new <> '1') as old,
        max({measure}) filter (is_new = '1') as new from ({_STATS.format(by="is_new")})"""
    for name, measure in _MEASURES.items())))
def new_vs_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.new_vs_returning(I.pages(spark, sf_dir), I.ORDER)


@query("channel_pv", with_views("select channel, count(*) pv from page group by channel"))
def channel_pv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.channel_pv(I.pages(spark, sf_dir))


@query("channel_bounce", with_views(
    "select channel, visits, bounces, case when visits <> 0 then cast(bounces * 100 as double) / visits end bounce_pct"
    f" from ({_STATS.format(by='channel')})"))
def channel_bounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.channel_bounce(I.pages(spark, sf_dir), I.ORDER)


@query("page_path", with_views("""
    select last_page_id source, page_id target, count(*) as value from page
    where last_page_id is not null group by 1, 2"""))
def page_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.page_path(I.pages(spark, sf_dir))


_UNTIL, _DAYS = "2001-08-01", 365


_BUYERS = """select user_id, min(split_part(create_time, ' ', 1)) first_day, sum(total_amount) spent
    from order_info group by user_id"""
_SEEN = "select user_id, min(dt) first_day from day_page group by user_id"
_NEW = f"cast(first_day as date) > date '{_UNTIL}' - {_DAYS} and cast(first_day as date) <= date '{_UNTIL}'"


@query("user_total", with_views(f"""
    select (select count(*) from user_info) user_total, count(*) order_user_total,
           (select count(*) from ({_SEEN}) where {_NEW}) new_user_count,
           count(*) filter ({_NEW}) new_order_user_count, cast(sum(spent) as double) / count(*) pct
    from ({_BUYERS})"""))
def user_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.user_total(D.user_info(spark, sf_dir), I.pages(spark, sf_dir),
                              D.order_info(spark, sf_dir), _UNTIL, _DAYS)


@query("user_paid", with_views("""
    select count(*) filter (paid) paid, count(*) filter (not paid) unpaid
    from (select user_id, cast(user_id as bigint) in (select user_id from order_info) paid
          from (select distinct user_id from page))"""))
def user_paid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.user_paid(I.pages(spark, sf_dir), D.order_info(spark, sf_dir))


@query("action_funnel", with_views(" union all ".join(
    f"select {i} pos, '{step}' step, count(distinct user_id) users from page where page_id = '{page}'"
    for i, (step, page) in enumerate(STEPS.items()))))
def action_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.action_funnel(I.pages(spark, sf_dir), STEPS)


@query("order_total", with_views("""
    select count(*) order_count, cast(sum(total_amount) as double) order_amount,
           count(distinct user_id) order_user from order_info"""))
def order_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.order_total(D.order_info(spark, sf_dir))


@query("orders_by_area", with_views("select province_name as name, count(*) as value from header group by 1"))
def orders_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.orders_by_area(D.order_info(spark, sf_dir), D.base_province(spark, sf_dir))


_BY_CATEGORY = """select category as name, count(*) as value from order_detail d
    join sku_info s on d.sku_id = s.id group by 1"""


@query("orders_by_category", with_views(f"""
    select case when place <= 3 then name else 'other' end as name, cast(sum(value) as bigint) as value
    from (select *, row_number() over (order by value desc, name) place from ({_BY_CATEGORY})) group by 1"""))
def orders_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.orders_by_category(D.order_detail(spark, sf_dir), D.sku_info(spark, sf_dir), num=3)


@query("top_products", with_views("""
    select sku_name as name, count(*) as value from order_detail group by 1 order by value desc, name limit 7"""))
def top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.top_products(D.order_detail(spark, sf_dir))


@query("top_products_sketched", with_views("""
    select sku_name as name, count(*) as value from order_detail group by 1 order by value desc, name limit 7"""))
def top_products_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days' stored sketches name the products that are counted."""
    path = scratch_dir(spark, "sketches")
    lines = D.order_detail(spark, sf_dir).withColumn("dt", scalars.create_date(F.col("create_time")))
    heavy_hitters.day_sketches(lines, "dt", "sku_name", 256).write.parquet(path)
    return heavy_hitters.top_values(lines, spark.read.parquet(path), "sku_name", 7, 256)


@query("top_brands", with_views("""
    select brand as name, count(*) as value from order_detail d join sku_info s on d.sku_id = s.id
    group by 1 order by value desc, name limit 7"""))
def top_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.top_brands(D.order_detail(spark, sf_dir), D.sku_info(spark, sf_dir))


# The dashboard's ranges: all reports over the days that end with a given one.
_PAGE_UNTIL, _PAGE_DAYS = "2024-01-15", 7
_PAGE_RANGE = (f"cast(dt as date) > date '{_PAGE_UNTIL}' - {_PAGE_DAYS} and cast(dt as date) <= date '{_PAGE_UNTIL}'")
_ORDER_RANGE = ("cast(split_part(create_time, ' ', 1) as date) > date '{0}' - {1} and "
                "cast(split_part(create_time, ' ', 1) as date) <= date '{0}'").format(_UNTIL, _DAYS)


@query("page_reports_in_range", with_views(f"""
    select 'channel' report, channel as name, count(*) as value from day_page where {_PAGE_RANGE} group by 2
    union all select 'path', last_page_id || '>' || page_id, count(*) from day_page
        where {_PAGE_RANGE} and last_page_id is not null group by 2
    union all select 'step', step, users from ({" union all ".join(
        f"select '{step}' step, count(distinct user_id) users from day_page where page_id = '{page}' and {_PAGE_RANGE}"
        for step, page in STEPS.items())})"""))
def page_reports_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views by channel, page paths and the funnel over seven days."""
    page, days = I.pages(spark, sf_dir), {"until": _PAGE_UNTIL, "days": _PAGE_DAYS}
    return (traffic.channel_pv(page, **days).select(F.lit("channel").alias("report"), F.col("channel").alias("name"),
                                                    F.col("pv").alias("value"))
            .union(traffic.page_path(page, **days).select(F.lit("path"), F.concat_ws(">", "source", "target"), "value"))
            .union(traffic.action_funnel(page, STEPS, **days).select(F.lit("step"), "step", "users")))


@query("order_reports_in_range", with_views(f"""
    select 'total' report, 'orders' as name, count(*) as value from order_info where {_ORDER_RANGE}
    union all select 'area', province_name, count(*) from header where {_ORDER_RANGE} group by 2
    union all (select 'product', sku_name, count(*) n from order_detail where {_ORDER_RANGE}
               group by 2 order by n desc, sku_name limit 7)"""))
def order_reports_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order count, orders by area and top products over a year."""
    header, days = D.order_info(spark, sf_dir), {"until": _UNTIL, "days": _DAYS}
    return (traffic.order_total(header, **days).select(F.lit("total").alias("report"), F.lit("orders").alias("name"),
                                                       F.col("order_count").alias("value"))
            .union(traffic.orders_by_area(header, D.base_province(spark, sf_dir), **days)
                   .select(F.lit("area"), "name", "value"))
            .union(traffic.top_products(D.order_detail(spark, sf_dir), **days).select(F.lit("product"), "name", "value")))
