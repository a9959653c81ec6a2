"""Streaming queries: each runs over all of its input, then its output table is read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart import schemas as S
from tidemart.functions.scalars import HOUR_MS, record_to_json, ts_to_dt
from tidemart.operators import dedup, device_state, reports, visitor_sets
from tidemart.plans import inputs as I
from tidemart.plans.change_plans import TOPIC_SQL
from tidemart.plans.log_plans import REALTIME_SQL
from tidemart.plans.order_plans import UNMATCHED_SQL, WIDE_SQL
from tidemart.plans.registry import query
from tidemart.plans.traffic_plans import STEPS
from tidemart.plans.views_sql import with_views
from tidemart.session import FREE_SHUFFLES, ROCKSDB, scratch_dir, settings
from tidemart.sinks import keyed
from tidemart.sinks.topics import OPEN_FILES, file_sink
from tidemart.sources import decode, driver_tables as D, topics
from tidemart.streaming import accounts, jobs

_EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
_HEADER_TOPIC, _LINE_TOPIC = f"DWD_ORDER_INFO_I_{I.SUFFIX}", f"DWD_ORDER_DETAIL_I_{I.SUFFIX}"


#: A replay is read in at least so many micro-batches.
BATCHES = 5


def _run_to_files(stream: DataFrame, work: str) -> int:
    accounts.keep(stream.sparkSession)
    with settings(stream.sparkSession, ROCKSDB):
        query = (stream.writeStream.format("parquet").option("path", f"{work}/out")
                 .option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start())
    return jobs.run_to_end(query)


def _log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.log_messages(topics.parquet_stream(spark, f"{sf_dir}/events.parquet", _EVENTS))


def _send(rows: DataFrame, topic: str, path: str, number: int = 0) -> None:
    """Rows as JSON messages of a topic, dealt to ``BATCHES`` folders with no regard to their time."""
    with settings(rows.sparkSession, OPEN_FILES | FREE_SHUFFLES):
        (rows.select(F.lit(topic).alias("topic"), record_to_json(*rows.columns).alias("value"))
         .withColumn("batch_id", F.pmod(F.xxhash64("value"), F.lit(BATCHES)) + number * BATCHES)
         .write.mode("append").option("compression", "gzip").partitionBy("topic", "batch_id").text(path))


def _topic(spark: SparkSession, path: str, topic: str) -> DataFrame:
    """A stored topic as a stream whose first start takes at least ``BATCHES`` micro-batches."""
    folder = f"{path}/topic={topic}"
    files = len(spark.read.schema("value STRING").text(folder).inputFiles())
    return topics.file_topic(spark, folder, max(1, files // BATCHES))


def _pages(spark: SparkSession, work: str) -> DataFrame:
    return decode.parse_typed(_topic(spark, f"{work}/topics", "pages"), S.PAGE_LOG, S.REQUIRED["page"])


@query("dau_dedup_stream", with_views("select distinct mid, dt from first_page"))
def dau_dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices per day; which of a device's first rows arrives first is not fixed."""
    work = scratch_dir(spark, "dau-stream")
    _send(I.pages(spark, sf_dir).select(*S.names(S.PAGE_LOG)), "pages", f"{work}/topics")
    first = dedup.dau_dedup_stream(dedup.session_first_page(_pages(spark, work)))
    assert _run_to_files(first.select("mid", ts_to_dt(F.col("ts")).alias("dt")), work) >= BATCHES
    return spark.read.schema("mid STRING, dt STRING").parquet(f"{work}/out")


@query("state_expiry", with_views("select mid, dt, cast(2 as bigint) n from (select distinct mid, dt from first_page)"))
def state_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages come, and once more nine days on, after one row on that day: by then no device is known.

    Within either arrival a device counts once a day.
    """
    work = scratch_dir(spark, "expiry")
    page = I.pages(spark, sf_dir).select(*S.names(S.PAGE_LOG))
    batches = 0
    later = page.limit(1).withColumn("mid", F.lit("later")).withColumn("last_page_id", F.lit(None).cast("string"))
    for number, (rows, day) in enumerate(((page, "01"), (later, "10"), (page, "10"))):
        _send(rows, "pages", f"{work}/topics", number)
        at = F.lit(f"2001-01-{day} 00:00:0{number}").cast("timestamp")
        first = dedup.dau_dedup_stream(dedup.session_first_page(_pages(spark, work)), at=at)
        batches += _run_to_files(first.select("mid", ts_to_dt(F.col("ts")).alias("dt")), work)
    assert batches >= BATCHES
    out = spark.read.schema("mid STRING, dt STRING").parquet(f"{work}/out").where("mid <> 'later'")
    return out.groupBy("mid", "dt").agg(F.count("*").alias("n"))


#: A device of ``state_renewed`` is forgotten when it has no page for so long.
_LIFE_MS = 2 * HOUR_MS


def _replay_in_turn(spark: SparkSession, sf_dir: str, work: str, run) -> int:
    """Pages come in ``BATCHES`` parts, in the order of their time, each followed by a start of the job; its batches."""
    # Written once: every part would parse all logs again.
    I.pages(spark, sf_dir).select(*S.names(S.PAGE_LOG)).write.parquet(f"{work}/pages")
    page = spark.read.schema(S.ddl(S.PAGE_LOG)).parquet(f"{work}/pages")
    first, last = page.agg(F.min("ts"), F.max("ts")).first()
    step = (last - first) // BATCHES + 1
    batches = 0
    for number in range(BATCHES):
        part = page.where(F.col("ts").between(first + number * step, first + (number + 1) * step - 1))
        _send(part, "pages", f"{work}/topics", number)
        batches += run(decode.parse_typed(topics.file_topic(spark, f"{work}/topics/topic=pages/batch_id=*"),
                                          S.PAGE_LOG, S.REQUIRED["page"]))
    return batches


@query("state_renewed", with_views(f"""
    select mid, dt, count(*) n
    from (select mid, dt, ts - lag(ts) over (partition by mid, dt order by ts) gap from day_page where last_page_id is null)
    where gap is null or gap >= {_LIFE_MS} group by mid, dt"""))
def state_renewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a device is new on a day if it is forgotten after two hours without a page. It stays known as
    long as it is used; arrival is the pages' own time, and the job is started anew for each part of it.
    """
    work = scratch_dir(spark, "renewed")

    def run(pages: DataFrame) -> int:
        first = device_state.dau_renewed_stream(dedup.session_first_page(pages), _LIFE_MS,
                                                at=F.timestamp_millis("ts"))
        return _run_to_files(first.select("mid", ts_to_dt(F.col("ts")).alias("dt")), work)
    assert _replay_in_turn(spark, sf_dir, work, run) >= BATCHES
    out = spark.read.schema("mid STRING, dt STRING").parquet(f"{work}/out")
    return out.groupBy("mid", "dt").agg(F.count("*").alias("n"))


@query("dau_live", with_views(REALTIME_SQL))
def dau_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dau_realtime`` from counts that two streams keep up, pages coming in any order; no device is read for it."""
    work = scratch_dir(spark, "live")
    _send(I.pages(spark, sf_dir).select(*S.names(S.PAGE_LOG)), "pages", f"{work}/topics")
    for name, wanted in (("changes", BATCHES), ("counts", 1)):
        query = (jobs.hour_changes_job(_pages(spark, work), f"{work}/changes", f"{work}/changes-checkpoint", every=None)
                 if name == "changes" else
                 jobs.hour_counts_job(spark, f"{work}/changes", f"{work}/counts", f"{work}/counts-checkpoint", every=None))
        assert jobs.run_to_end(query) >= wanted
    return reports.realtime_of_hours(jobs.read_hours(spark, f"{work}/counts"))


_RANGES = (1, 7, 30)
_IN_RANGE = ("cast(dt as date) > (select max(cast(dt as date)) from day_page) - {days} "
             "and cast(dt as date) <= (select max(cast(dt as date)) from day_page)")


def _stored_visitors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, str]:
    """Sets and views of the days, stored by a job that takes the pages in several batches; the last day."""
    work = scratch_dir(spark, "visitors")
    _send(I.pages(spark, sf_dir).select(*S.names(S.PAGE_LOG)), "pages", f"{work}/topics")
    sets = visitor_sets.visit_sets(STEPS)
    assert jobs.run_to_end(jobs.visitor_sets_job(_pages(spark, work), f"{work}/visitors", f"{work}/checkpoint", sets,
                                                 every=None)) >= BATCHES
    views = visitor_sets.stored_views(spark, f"{work}/visitors")
    return visitor_sets.stored_sets(spark, f"{work}/visitors"), views, views.agg(F.max("dt")).first()[0]


def _each_range(answer) -> DataFrame:
    return reduce(DataFrame.union, (answer(days).withColumn("days", F.lit(days)) for days in _RANGES))


@query("uv_by_day_stored", with_views("select dt, count(distinct mid) uv from day_page group by dt"))
def uv_by_day_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visitor_sets.uv_by_day(_stored_visitors(spark, sf_dir)[0])


@query("visit_total_ranges", with_views(" union all ".join(f"""
    select {days} as days, count(*) pv_count, count(distinct mid) uv_count,
           count(distinct case when is_new = '1' then mid end) new_count
    from day_page where {_IN_RANGE.format(days=days)}""" for days in _RANGES)))
def visit_total_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1, 7 and 30 days from the days' bitmaps; pages are not read again."""
    sets, views, until = _stored_visitors(spark, sf_dir)
    return _each_range(lambda days: visitor_sets.visit_total(sets, views, until, days))


@query("action_funnel_ranges", with_views(" union all ".join(
    f"select {days} as days, {i} pos, '{step}' step, count(distinct user_id) users from day_page "
    f"where page_id = '{page}' and {_IN_RANGE.format(days=days)}"
    for days in _RANGES for i, (step, page) in enumerate(STEPS.items()))))
def action_funnel_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets, _, until = _stored_visitors(spark, sf_dir)
    return _each_range(lambda days: visitor_sets.action_funnel(sets, STEPS, until, days))


#: Changes in a stored file, and bytes of such files that a batch takes: what a batch keeps does not grow with the replay.
_FILE_CHANGES, _BATCH_BYTES = 250_000, 128 << 20


def _messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("value STRING, topic STRING, batch_id BIGINT").text(path)


@query("multi_topic_fanout", with_views(I.ROUTED_SQL))
def multi_topic_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = scratch_dir(spark, "fanout")
    jobs.run_to_end(jobs.log_router(_log_stream(spark, sf_dir), file_sink(f"{work}/topics"),
                                    f"{work}/checkpoint", every=None))
    return I.routed_rows(_messages(spark, f"{work}/topics"))


@query("micro_batch_loop", with_views(I.ROUTED_SQL))
def micro_batch_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same job as it runs in production, a batch every so often, until it is stopped."""
    work = scratch_dir(spark, "loop")
    running = jobs.log_router(_log_stream(spark, sf_dir), file_sink(f"{work}/topics"),
                              f"{work}/checkpoint", every="1 second")
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return I.routed_rows(_messages(spark, f"{work}/topics"))


@query("commit_after_output", with_views(I.ROUTED_SQL))
def commit_after_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job is started a second time on its checkpoint: what was written counts as done, nothing comes twice."""
    work = scratch_dir(spark, "commit")
    for _ in range(2):
        jobs.run_to_end(jobs.log_router(_log_stream(spark, sf_dir), file_sink(f"{work}/topics"),
                                        f"{work}/checkpoint", every=None))
    return I.routed_rows(_messages(spark, f"{work}/topics"))


_PAGE_ROWS = with_views("select mid, user_id, page_id, last_page_id, page_item, during_time, ts from page")


def _read_pages(spark: SparkSession, work: str) -> DataFrame:
    rows = _pages(spark, work).select("mid", "user_id", "page_id", "last_page_id", "page_item", "during_time", "ts")
    assert _run_to_files(rows, work) >= BATCHES
    return spark.read.schema(rows.schema).parquet(f"{work}/out")


@query("topic_source", _PAGE_ROWS)
def topic_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = scratch_dir(spark, "source")
    _send(I.pages(spark, sf_dir).select(*S.names(S.PAGE_LOG)), "pages", f"{work}/topics")
    return _read_pages(spark, work)


@query("resume_or_latest", _PAGE_ROWS)
def resume_or_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader starts, stops, and goes on where it was when the other half has come."""
    work = scratch_dir(spark, "resume")
    page = I.pages(spark, sf_dir).select(*S.names(S.PAGE_LOG))
    for number, half in enumerate(("last_page_id IS NULL", "last_page_id IS NOT NULL")):
        _send(page.where(half), "pages", f"{work}/topics", number)
        rows = _pages(spark, work).select("mid", "user_id", "page_id", "last_page_id", "page_item", "during_time", "ts")
        _run_to_files(rows, work)
    return spark.read.schema(rows.schema).parquet(f"{work}/out")


@query("dynamic_table_list", with_views(f"""
    select {TOPIC_SQL} target, id, data from fact_change where "table" <> 'order_detail' or id % 3 <> 0
    union all select "table", id, data from (
        select *, row_number() over (partition by "table", id order by seq desc) rn from dim_change) where rn = 1
        and ("table" <> 'base_province' or id % 3 <> 0)"""))
def dynamic_table_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change router over all changes; both table lists are stored and read for each batch.

    Every third row's changes come first, when either list still lacks a table; then the lists change and the rest comes.
    """
    work = scratch_dir(spark, "lists")
    early = F.coalesce(F.get_json_object("value", "$.data.id").cast("bigint") % 3 == 0, F.lit(False))
    # Written once: making all messages is most of the work, and a part that is filtered out has been made too.
    with settings(spark, I.SMALL_TASKS | OPEN_FILES | FREE_SHUFFLES):
        (D.change_log(spark, sf_dir).withColumn("early", early).write.option("maxRecordsPerFile", _FILE_CHANGES)
         .partitionBy("early").parquet(f"{work}/changes"))

    def listed(name: str) -> jobs.Tables:
        return lambda session: session.read.schema("table STRING").parquet(f"{work}/{name}")
    for parts, missing in (("early=true", {"order_detail", "base_province"}), ("early=true,early=false", set())):
        for name, tables in (("fact", D.FACT_TABLES), ("dim", D.DIM_TABLES)):
            D.table_list(spark, [t for t in tables if t not in missing]).write.mode("overwrite").parquet(f"{work}/{name}")
        # The second start sees both folders; its checkpoint knows the files it has read.
        raw = topics.parquet_stream(spark, f"{work}/changes/{parts}", "seq BIGINT, value STRING", max_bytes=_BATCH_BYTES)
        jobs.run_to_end(jobs.change_router(raw, listed("fact"), listed("dim"), file_sink(f"{work}/topics"),
                                           f"{work}/dims", f"{work}/checkpoint", I.SUFFIX, every=None))
    stored = keyed.read_latest(spark, f"{work}/dims", jobs.DIM_LAYOUT, ["id"], "table")
    facts = _messages(spark, f"{work}/topics").select(
        F.col("topic").alias("target"), F.get_json_object("value", "$.id").cast("bigint").alias("id"),
        F.col("value").alias("data"))
    return facts.unionByName(stored.select(F.col("table").alias("target"), "id", "data"))


def _store_dims(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The dimension rows as the change router would have stored them."""
    for name, rows in (("user_info", D.user_info(spark, sf_dir)), ("base_province", D.base_province(spark, sf_dir))):
        jobs.write_dims(rows.select(
            F.lit(name).alias("table"), "id", F.concat(F.lit(f"DIM:{name.upper()}:"), F.col("id")).alias("key"),
            F.lit("I").alias("op"), record_to_json(*rows.columns).alias("data"), F.col("id").alias("seq")), 0, path)


def _order_topics(spark: SparkSession, work: str) -> tuple[DataFrame, DataFrame]:
    return (decode.parse_typed(_topic(spark, f"{work}/topics", _HEADER_TOPIC), S.ORDER_HEADER, S.REQUIRED["header"]),
            decode.parse_typed(_topic(spark, f"{work}/topics", _LINE_TOPIC), S.ORDER_LINE, S.REQUIRED["line"]))


def _run_orders(spark: SparkSession, work: str, **how) -> int:
    return jobs.run_to_end(jobs.order_job(*_order_topics(spark, work), f"{work}/dims", f"{work}/wide",
                                          f"{work}/checkpoint", I.as_of(),
                                          partition=F.substring("create_date", 1, 7), every=None, **how))


def _stored_orders(spark: SparkSession, work: str) -> DataFrame:
    wide = keyed.read_latest(spark, f"{work}/wide", jobs.ORDER_WIDE_STORED, ["order_id", "detail_id"])
    return I.result(wide.select(*S.names(S.ORDER_WIDE)))


@query("order_wide_stream", with_views(WIDE_SQL))
def order_wide_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers and lines from their topics, joined as streams, looked up and stored."""
    work = scratch_dir(spark, "orders")
    _store_dims(spark, sf_dir, f"{work}/dims")
    _send(D.order_info(spark, sf_dir), _HEADER_TOPIC, f"{work}/topics")
    _send(D.order_detail(spark, sf_dir), _LINE_TOPIC, f"{work}/topics")
    assert _run_orders(spark, work) >= BATCHES
    return _stored_orders(spark, work)


@query("late_partner", with_views(WIDE_SQL))
def late_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job runs when only lines are there, stops, and runs again when the headers are."""
    work = scratch_dir(spark, "late")
    _store_dims(spark, sf_dir, f"{work}/dims")
    _send(D.order_detail(spark, sf_dir), _LINE_TOPIC, f"{work}/topics")
    spark.createDataFrame([], "value STRING").write.text(f"{work}/topics/topic={_HEADER_TOPIC}/batch_id=0")
    batches = _run_orders(spark, work)
    _send(D.order_info(spark, sf_dir), _HEADER_TOPIC, f"{work}/topics", 1)
    assert batches + _run_orders(spark, work) >= BATCHES
    return _stored_orders(spark, work)


@query("dual_commit", with_views("select order_id, detail_id, cast(1 as bigint) n from order_wide"))
def dual_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both topics' progress is kept together: after a stop in between, no line is stored twice or left out."""
    work = scratch_dir(spark, "dual")
    _store_dims(spark, sf_dir, f"{work}/dims")
    headers, lines, batches = D.order_info(spark, sf_dir), D.order_detail(spark, sf_dir), 0
    for number in range(2):
        _send(headers.where(F.col("id") % 2 == number), _HEADER_TOPIC, f"{work}/topics", number)
        _send(lines.where(F.col("id") % 3 == number if number == 0 else F.col("id") % 3 > 0), _LINE_TOPIC,
              f"{work}/topics", number)
        batches += _run_orders(spark, work)
    assert batches >= BATCHES
    stored = keyed.layers(spark, f"{work}/wide", jobs.ORDER_WIDE_STORED)
    return stored.groupBy("order_id", "detail_id").agg(F.count("*").alias("n"))


@query("unmatched_orders_stream", UNMATCHED_SQL)
def unmatched_orders_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers and lines that are still alone when nine days later one more of each comes; one job finds both."""
    work = scratch_dir(spark, "orphans")
    _store_dims(spark, sf_dir, f"{work}/dims")
    stored = I.stored_topics(spark, sf_dir, "order_info", "order_detail")
    now = {"header": I.inserted(spark, stored, "order_info", S.ORDER_HEADER),
           "line": I.inserted(spark, stored, "order_detail", S.ORDER_LINE)}
    later = {"header": now["header"].limit(1).withColumn("id", F.lit(-1).cast("bigint")),
             "line": now["line"].limit(1).withColumns({"id": F.lit(-2).cast("bigint"), "order_id": F.lit(-2).cast("bigint")})}
    for number, (sent, day) in enumerate(((now, "01"), (later, "10"))):
        _send(sent["header"], _HEADER_TOPIC, f"{work}/topics", number)
        _send(sent["line"], _LINE_TOPIC, f"{work}/topics", number)
        at = F.lit(f"2001-01-{day} 00:00:00").cast("timestamp")
        _run_orders(spark, work, line_orphans=f"{work}/lines", header_orphans=f"{work}/headers",
                    header_at=at, line_at=at, late="1 second")
    headers = keyed.read_latest(spark, f"{work}/headers", jobs.HEADER_ORPHANS, ["id"])
    lines = keyed.read_latest(spark, f"{work}/lines", jobs.LINE_ORPHANS, ["id"])
    return (headers.select(F.lit("header").alias("side"), "id", F.col("id").alias("order_id"))
            .union(lines.select(F.lit("line").alias("side"), "id", "order_id")))
