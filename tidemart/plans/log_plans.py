"""Behaviour logs: decoding, routing and daily actives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart import schemas as S
from tidemart.functions import scalars
from tidemart.operators import dau, dedup, dims, reports, routing
from tidemart.plans import inputs as I
from tidemart.plans.registry import query
from tidemart.plans.views_sql import with_views
from tidemart.session import scratch_dir
from tidemart.sinks.topics import file_sink
from tidemart.sources import decode, driver_tables as D

_COMMON = ", ".join(S.names(S.COMMON))


@query("parse_log_json", with_views("""
    select seq, mid, case when kind <> 'signup' then 'p' || (seq % 5) end page_id,
           case when kind <> 'signup' and k % 4 > 0 then cast(k % 4 as int) else 0 end n_displays,
           cast(kind in ('click', 'purchase') as int) n_actions, kind = 'error' has_err,
           case when kind = 'signup' then 'icon' end entry, cast(ts as varchar) ts
    from logs"""))
def parse_log_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = decode.parse_log(D.raw_log(spark, sf_dir))
    return log.select(
        "seq", "common.mid", "page.page_id",
        F.when(F.col("displays").isNotNull(), F.size("displays")).otherwise(0).alias("n_displays"),
        F.when(F.col("actions").isNotNull(), F.size("actions")).otherwise(0).alias("n_actions"),
        F.col("err").isNotNull().alias("has_err"), "start.entry", "ts")


@query("parse_typed", with_views("select * from page"))
def parse_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = I.pages(spark, sf_dir)
    topic = page.select("seq", scalars.record_to_json(*S.names(S.PAGE_LOG)).alias("value"))
    return decode.parse_typed(topic, S.PAGE_LOG)


@query("quarantine", with_views("""
    select seq, case when seq % 50 = 0 then 'bad_json'
                     when seq % 50 = 1 then 'during_time'
                     when kind = 'signup' then 'loading_time' else 'displays.pos_id' end reason
    from logs where seq % 50 = 0
       or (seq % 50 = 1 and kind not in ('signup', 'error'))
       or (seq % 50 = 2 and (kind = 'signup' or (kind <> 'error' and k % 4 > 0)))"""))
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.quarantine(decode.parse_log(D.damaged_log(spark, sf_dir)), "seq").select("seq", "reason")


@query("log_error_route", with_views("select seq, err from err"))
def log_error_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.error_rows(I.logs(spark, sf_dir), "seq")


@query("log_common", with_views(f"select seq, {_COMMON}, ts from logs where kind <> 'error'"))
def log_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.common_rows(I.logs(spark, sf_dir), "seq")


@query("log_page", with_views("select * from page"))
def log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.pages(spark, sf_dir)


@query("log_start", with_views("select * from start_log"))
def log_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.start_rows(I.logs(spark, sf_dir), "seq")


@query("log_displays", with_views("select * from display"))
def log_displays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.display_rows(I.logs(spark, sf_dir), "seq")


@query("log_actions", with_views("select * from action"))
def log_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.action_rows(I.logs(spark, sf_dir), "seq")


@query("log_route_counts", with_views(f"select topic, count(*) n from ({I.ROUTED_SQL}) group by topic"))
def log_route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route_log(I.logs(spark, sf_dir)).groupBy("topic").agg(F.count("*").alias("n"))


@query("topic_sink", with_views(I.ROUTED_SQL))
def topic_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all topics in one go and reads every message back."""
    path = scratch_dir(spark, "topics")
    file_sink(path)(routing.route_log(I.logs(spark, sf_dir)), 0)
    return I.routed_rows(spark.read.schema("value STRING, topic STRING, batch_id BIGINT").text(path))


_PAGE_JSON = " || ',' || ".join(
    f"'\"{c}\":\"' || {c} || '\"'" if kind == "STRING" else f"'\"{c}\":' || {c}"
    for c, kind in S.PAGE_LOG if c != "last_page_id")


@query("record_to_json", with_views(f"""
    select seq, '{{' || {_PAGE_JSON.replace("'\"page_item\":", "case when last_page_id is null then '' else '\"last_page_id\":\"' || last_page_id || '\",' end || '\"page_item\":")}
           || '}}' as value from page"""))
def record_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.pages(spark, sf_dir).select(
        "seq", scalars.record_to_json(*S.names(S.PAGE_LOG)).alias("value"))


@query("str_to_long", with_views("""
    select seq, case when seq % 50 = 1 then null else seq % 10000 end during_time
    from logs where kind not in ('signup', 'error') and seq % 50 <> 0"""))
def str_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = decode.parse_log(D.damaged_log(spark, sf_dir)).where("err IS NULL AND page IS NOT NULL")
    return log.select("seq", scalars.str_to_long(F.col("page.during_time")).alias("during_time"))


@query("ts_to_dt_hr", with_views("select seq, dt, hr from day_page"))
def ts_to_dt_hr(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return I.pages(spark, sf_dir).select(
        "seq", scalars.ts_to_dt(ts).alias("dt"), scalars.ts_to_hr(ts).alias("hr"))


@query("day_minus", with_views("""
    select distinct dt, strftime(cast(dt as date) - 1, '%Y-%m-%d') day_before from day_page"""))
def day_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = I.pages(spark, sf_dir).select(scalars.ts_to_dt(F.col("ts")).alias("dt")).distinct()
    return days.select("dt", scalars.day_shift(F.col("dt"), -1).alias("day_before"))


@query("session_first_page", with_views("select * from page where last_page_id is null"))
def session_first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.session_first_page(I.pages(spark, sf_dir))


_DAU_OF_PAGE = [c for c in S.names(S.DAU_WIDE) if c in S.names(S.PAGE_LOG)]


@query("project_by_name", with_views(f"select {', '.join(_DAU_OF_PAGE)} from page"))
def project_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.project_by_name(I.pages(spark, sf_dir), S.DAU_WIDE)


@query("dau_dedup", with_views("select mid, dt, seq, page_id, ts from first_page"))
def dau_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = dedup.dau_dedup(dedup.session_first_page(I.pages(spark, sf_dir)), I.ORDER)
    return first.select("mid", "dt", "seq", "page_id", "ts")


@query("dedup_recover", with_views("""
    select mid, dt, seq from first_page f where not exists (
        select 1 from day_page d join action a on d.seq = a.seq
        where d.last_page_id is null and d.mid = f.mid and d.dt = f.dt)"""))
def dedup_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices of the day that are not stored yet, where those with a click or purchase are."""
    log = I.logs(spark, sf_dir)
    stored = dedup.dau_dedup(dedup.session_first_page(routing.action_rows(log, "seq")), I.ORDER)
    today = dedup.dau_dedup(dedup.session_first_page(routing.page_rows(log, "seq")), I.ORDER)
    return dedup.not_stored(today, stored, ["mid", "dt"]).select("mid", "dt", "seq")


@query("dau_wide", with_views(f"select {', '.join(S.names(S.DAU_WIDE))} from dau"))
def dau_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.dau_table(spark, sf_dir)


@query("lookup_user", with_views(
    "select seq, mid, user_gender, cast(user_age as int) user_age from dau join first_page using (mid, dt)"))
def lookup_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = dedup.dau_dedup(dedup.session_first_page(I.pages(spark, sf_dir)), I.ORDER)
    return dims.lookup_user(first, D.user_info(spark, sf_dir), I.as_of()).select(
        "seq", "mid", "user_gender", "user_age")


@query("lookup_province", with_views("""
    select p.seq, p.province_id, b.name province_name, b.area_code province_area_code,
           b.iso_code province_iso_code, b.iso_3166_2 province_3166_2
    from page p left join base_province b on cast(p.province_id as bigint) = b.id"""))
def lookup_province(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = I.pages(spark, sf_dir).select("seq", "province_id")
    return dims.lookup_province(page, D.base_province(spark, sf_dir))


@query("read_field", with_views("select dt, mid from first_page"))
def read_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores the daily-active table by day and reads one field back."""
    path = scratch_dir(spark, "dau")
    first = dedup.dau_dedup(dedup.session_first_page(I.pages(spark, sf_dir)), I.ORDER)
    first.hint("rebalance", "dt").write.partitionBy("dt").parquet(path)
    stored = spark.read.schema(first.schema).parquet(path)
    return stored.select("dt", "mid")


@query("missing_day_is_empty", with_views("select count(*) total from first_page where dt = '1999-12-31'"))
def missing_day_is_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dau_total(I.first_seen(spark, sf_dir), "1999-12-31")


@query("dau_total", with_views("select dt, count(*) total from first_page group by dt"))
def dau_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dau_totals(I.first_seen(spark, sf_dir))


_BY_HOUR = "select dt, hr, count(*) n from first_page group by dt, hr"


@query("dau_by_hour", with_views(_BY_HOUR))
def dau_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dau_by_hour(I.first_seen(spark, sf_dir))


REALTIME_SQL = f"""
    select dt, 'total' series, null hr, count(*) n from first_page group by dt
    union all select dt, 'today', hr, count(*) from first_page group by dt, hr
    union all select strftime(cast(dt as date) + 1, '%Y-%m-%d'), 'yesterday', hr, n from ({_BY_HOUR})"""


@query("dau_realtime", with_views(REALTIME_SQL))
def dau_realtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dau_realtime(I.first_seen(spark, sf_dir))


@query("dau_hours_filled", with_views(f"""
    select d.dt, lpad(cast(h as varchar), 2, '0') hr, coalesce(b.n, 0) n
    from (select dt, unnest(range(24)) h from (select distinct dt from first_page)) d
    left join ({_BY_HOUR}) b on b.dt = d.dt and b.hr = lpad(cast(h as varchar), 2, '0')"""))
def dau_hours_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.fill_hours(reports.dau_by_hour(I.first_seen(spark, sf_dir)))
