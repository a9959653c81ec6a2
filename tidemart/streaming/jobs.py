"""The streaming jobs: sources, transforms and sinks put together.

Each job is one query with one checkpoint, which holds the progress of all its sources
and moves on only after the output of a batch is written. A batch that is run again
leaves the same tables, so a job may stop at any point. Each start of a job numbers its
layers from after those already stored: a new checkpoint, whose batches begin at 0 again,
does not touch them. Tables that may change (dimensions, table lists) are read anew in
every batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tidemart import schemas as S
from tidemart.functions.scalars import create_date, ts_to_dt
from tidemart.operators import dau, dedup, device_state, dims, orders, routing, visitor_sets
from tidemart.session import FREE_SHUFFLES, ROCKSDB, settings
from tidemart.sinks import keyed
from tidemart.sinks.topics import TopicSink
from tidemart.sources import decode
from tidemart.streaming import accounts

DIM_LAYOUT: S.Layout = [("table", "STRING"), ("id", "BIGINT"), ("key", "STRING"),
                        ("data", "STRING"), ("is_deleted", "BOOLEAN"), ("seq", "BIGINT")]
HEADER_ORPHANS: S.Layout = S.ORDER_HEADER + [("dt", "STRING")]
LINE_ORPHANS: S.Layout = S.ORDER_LINE + [("dt", "STRING")]
HOURS: S.Layout = [("hr", "STRING"), ("n", "BIGINT"), ("dt", "STRING")]
ORDER_WIDE_STORED: S.Layout = S.ORDER_WIDE + [("dt", "STRING")]

Tables = Callable[[SparkSession], DataFrame]

_ADAPTIVE = "spark.sql.adaptive.enabled"


def start(stream: DataFrame, each_batch, checkpoint: str, name: str | None = None,
          every: str | None = "5 seconds", keep: bool = True, mode: str = "append") -> StreamingQuery:
    """Runs until stopped with a batch ``every`` so often; with None, to the end of what is there.

    With ``keep`` a batch's rows are kept while it is handled: stateful steps and parsing before
    it must run once only, however often the rows are used. What is done with them is planned at
    run time, like any other query, so that a hot key is split; a stateful stream has that
    switched off. What a batch shuffles for its tables is freed with each of its writes.
    """
    def handle(rows: DataFrame, batch_id: int) -> None:
        if keep:
            rows.persist()
        try:
            with settings(rows.sparkSession, {_ADAPTIVE: "true", **FREE_SHUFFLES}):
                each_batch(rows, batch_id)
        finally:
            if keep:
                rows.unpersist()
    return _begin(stream.sparkSession, stream.writeStream.outputMode(mode).foreachBatch(handle), checkpoint, name, every)


def _begin(spark: SparkSession, writer: DataStreamWriter, checkpoint: str, name: str | None,
           every: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    accounts.keep(spark)
    # A query takes over the settings it is started with: its state is to be off-heap in any session.
    with settings(spark, ROCKSDB):
        return writer.start()


def run_to_end(query: StreamingQuery, timeout: int | None = None) -> int:
    """Waits for a query that reads what is there and returns how many batches it made.

    Its failure is raised here, and so are the loss of rows that came too late and a batch whose accounts do not
    add up, in whichever batch that was.
    """
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"stream not finished after {timeout} s")
    return accounts.settled(query).batches


def log_router(raw: DataFrame, sink: TopicSink, checkpoint: str, suffix: str = "",
               bad_records: str | None = None, first: int = 0, **how) -> StreamingQuery:
    """Raw logs -> error, page, display, action and start topics; bad records set aside.

    ``first`` is for a new checkpoint, as in ``file_sink``.
    """
    def batch(parsed: DataFrame, batch_id: int) -> None:
        sink(routing.route_log(decode.usable(parsed), suffix), batch_id)
        if bad_records:
            set_aside(parsed, first + batch_id, bad_records)
    return start(accounts.judged(decode.parse_log(accounts.read(raw))), batch, checkpoint, keep=bool(bad_records), **how)


def set_aside(checked: DataFrame, number: int, path: str) -> None:
    """The unusable records of a batch; one that is run again replaces them."""
    (decode.quarantine(checked).withColumn("batch_id", F.lit(number))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))


def write_dims(changes: DataFrame, batch_id: int, path: str) -> None:
    """Latest images of ``dim_route`` rows -> a keyed table, partitioned by dimension."""
    keyed.upsert(dims.latest_dims(changes), batch_id, path, ["id"], ["seq"], partition="table")


def read_dims(spark: SparkSession, path: str, name: str, ids: DataFrame | None = None) -> DataFrame:
    """Current rows of one dimension, if ``ids`` is given only those (column ``id``).

    The wanted ids are picked out of the stored layers before the last image of each is
    worked out, so a micro-batch does not go over every image of a large dimension.
    """
    def narrow(stored: DataFrame) -> DataFrame:
        stored = stored.where(F.col("table") == name)
        return stored if ids is None else stored.join(ids.distinct(), "id", "left_semi")
    return keyed.read_latest(spark, path, DIM_LAYOUT, ["id"], "table", narrow)


def change_router(raw: DataFrame, fact_tables: Tables, dim_tables: Tables, sink: TopicSink,
                  dim_path: str, checkpoint: str, suffix: str, bad_records: str | None = None,
                  **how) -> StreamingQuery:
    """Change records -> fact topics and the dimension table. ``raw`` has ``value`` and ``seq``.

    Records that cannot be used go to ``bad_records`` if that is given; they never go on. A
    record is parsed once: what a batch keeps are parsed rows.
    """
    base = keyed.next_layer(raw.sparkSession, dim_path, DIM_LAYOUT)

    def batch(checked: DataFrame, batch_id: int) -> None:
        spark = checked.sparkSession
        changes = decode.usable(checked).drop("value", "fault")
        if bad_records:
            set_aside(checked, base + batch_id, bad_records)
        sink(routing.fact_route(changes, fact_tables(spark), suffix), batch_id)
        write_dims(routing.dim_route(changes, dim_tables(spark), "seq"), base + batch_id, dim_path)
    checked = accounts.judged(decode.check_change(accounts.read(raw)))
    # A batch keeps the messages only if some may be set aside.
    return start(checked if bad_records else checked.drop("value"), batch, checkpoint, **how)


def _ids(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.col(column).try_cast("bigint").alias("id")).where("id IS NOT NULL")


def dau_job(pages: DataFrame, dim_path: str, dau_path: str, checkpoint: str, as_of: Column,
            delay: str = "2 days", salts: int = 8, recover: bool = False, zone: str = "UTC",
            renewed_ms: int | None = None, **how) -> StreamingQuery:
    """Page rows -> daily-active table, a device once a day; days are those of ``zone``.

    A device stays known for ``delay`` after its first page came, or, with ``renewed_ms``, for so long after its last.
    A restart goes on with the dedup state of the checkpoint. ``recover`` is for a start
    without one: devices that are stored already for the days of a batch are left out.
    """
    base = keyed.next_layer(pages.sparkSession, dau_path, S.DAU_WIDE)
    openers = dedup.session_first_page(pages)
    first = (dedup.dau_dedup_stream(openers, delay, salts, zone) if renewed_ms is None
             else device_state.dau_renewed_stream(openers, renewed_ms, zone))

    def batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        devices = rows.drop("day_ts")
        if recover:
            # The days of a batch are few; naming them keeps other partitions from being read.
            devices = devices.withColumn("dt", ts_to_dt(F.col("ts"), zone))
            days = [r.dt for r in devices.select("dt").distinct().collect()]
            stored = keyed.layers(spark, dau_path, S.DAU_WIDE).where(F.col("dt").isin(days))
            devices = dedup.not_stored(devices, stored, ["mid", "dt"]).drop("dt")
        users = dims.user_dim(read_dims(spark, dim_path, "user_info", _ids(devices, "user_id")))
        provinces = dims.province_dim(read_dims(spark, dim_path, "base_province"))
        wide = dau.dau_wide(devices, users, provinces, as_of, zone)
        keyed.upsert(wide, base + batch_id, dau_path, ["mid"], ["ts"])
    return start(first, batch, checkpoint, **how)


def hour_changes_job(pages: DataFrame, path: str, checkpoint: str, name: str | None = None,
                     every: str | None = "5 seconds", **how) -> StreamingQuery:
    """Page rows -> a stored stream of changes of the hourly device counts; each change is stored once.

    ``how`` is for ``hour_changes_stream``.
    """
    changes = device_state.hour_changes_stream(dedup.session_first_page(pages), **how)
    return _begin(changes.sparkSession, changes.writeStream.format("parquet").option("path", path), checkpoint, name, every)


def hour_counts_job(spark: SparkSession, path: str, counts_path: str, checkpoint: str, **how) -> StreamingQuery:
    """Changes stored by ``hour_changes_job`` -> devices per day and hour, a table that each batch brings up to date.

    The running sums are the query's state, one per day and hour; a batch writes only those it changed.
    """
    base = keyed.next_layer(spark, counts_path, HOURS)
    changes = spark.readStream.schema("dt STRING, hr STRING, change BIGINT").parquet(path)
    sums = changes.groupBy("dt", "hr").agg(F.sum("change").alias("n"))

    def batch(rows: DataFrame, batch_id: int) -> None:
        keyed.upsert(rows, base + batch_id, counts_path, ["hr"], ["hr"])
    return start(sums, batch, checkpoint, keep=False, mode="update", **how)


def read_hours(spark: SparkSession, counts_path: str) -> DataFrame:
    """``dt, hr, n`` as of the last batch; a handful of rows a day, whatever the number of devices."""
    return keyed.read_latest(spark, counts_path, HOURS, ["hr"]).where("n <> 0")


def visitor_sets_job(pages: DataFrame, path: str, checkpoint: str, sets: visitor_sets.Sets, zone: str = "UTC",
                     **how) -> StreamingQuery:
    """Page rows -> bitmaps of each day's visitors and its views, from which ranges of days are answered."""
    newest = visitor_sets.stored_views(pages.sparkSession, path).agg(F.max("batch_id")).first()[0]
    base = 0 if newest is None else newest + 1
    return start(pages, lambda rows, batch_id: visitor_sets.store(rows, base + batch_id, path, sets, zone), checkpoint,
                 keep=False, **how)


def order_job(headers: DataFrame, lines: DataFrame, dim_path: str, wide_path: str, checkpoint: str,
              as_of: Column, within: str = "24 hours", salts: int = 1, line_orphans: str | None = None,
              header_orphans: str | None = None, partition: Column | None = None, header_at: Column | None = None,
              line_at: Column | None = None, late: str = "0 seconds", **how) -> StreamingQuery:
    """Order headers and lines -> order-wide table, one row per line.

    Tables are partitioned by day of the order (column ``dt``) unless ``partition``, made of ``create_date``, says
    otherwise: a replay of many years, where each batch has rows of each day, wants months. With tables
    ``line_orphans`` and ``header_orphans``, lines for which no header came in time go to the one, headers
    without a line to the other. All three come from one join, so either side is in its state once and one
    checkpoint keeps them in step. ``header_at``, ``line_at`` and ``late`` are those of ``join_order_streams``.
    """
    spark = headers.sparkSession
    base = max(keyed.next_layer(spark, path, layout) for path, layout in (
        (wide_path, ORDER_WIDE_STORED), (line_orphans, LINE_ORPHANS), (header_orphans, HEADER_ORPHANS)) if path)
    kind = "full_outer" if header_orphans or line_orphans else "inner"
    joined = orders.join_order_streams(headers, lines, within, salts, kind, header_at, line_at, late)

    def dated(rows: DataFrame) -> DataFrame:
        return rows.withColumn("dt", F.col("create_date") if partition is None else partition)

    def batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        if kind == "full_outer":
            # Orphans come out with the batches in which their time is past; most batches have none.
            rows, *alone = orders.split_joined(rows, salts)
            for some, path in zip(alone, (line_orphans, header_orphans)):
                if path and not some.isEmpty():
                    some = dated(some.withColumn("create_date", create_date(F.col("create_time")))).drop("create_date")
                    keyed.upsert(some, base + batch_id, path, ["id"], ["create_time"])
        users = dims.user_dim(read_dims(spark, dim_path, "user_info", _ids(rows, "h_user_id")))
        provinces = dims.province_dim(read_dims(spark, dim_path, "base_province"))
        line_columns = [c for c in rows.columns if c.startswith("d_")]
        header = rows.withColumnsRenamed({c: c[2:] for c in rows.columns if c.startswith("h_")})
        enriched = orders.enrich_headers(header, users, provinces, as_of)
        back = enriched.withColumnsRenamed(
            {c: f"h_{c}" for c in enriched.columns if c not in line_columns})
        wide = dated(orders.merge_order_wide(back))
        keyed.upsert(wide, base + batch_id, wide_path, ["order_id", "detail_id"], ["create_time"])
    return start(joined, batch, checkpoint, **how)
