"""Change records: operations, fact topics and dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart import schemas as S
from tidemart.functions import scalars
from tidemart.operators import dedup, dims, routing
from tidemart.plans import inputs as I
from tidemart.plans.registry import query
from tidemart.plans.views_sql import with_views
from tidemart.session import scratch_dir
from tidemart.sinks import keyed
from tidemart.sources import archive, decode, driver_tables as D, topics
from tidemart.streaming import jobs

TOPIC_SQL = f"'DWD_' || upper(\"table\") || '_' || op || '_{I.SUFFIX}'"
_KEY = "'DIM:' || upper(\"table\") || ':' || id"


@query("parse_change_json", with_views("""select seq, type, "table", data from change"""))
def parse_change_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.changes(spark, sf_dir).withColumn("data", decode.json_text("data"))


_CUT = """case when seq % 20 = 3 then 'bad_json' when seq % 20 = 7 then 'id' when seq % 20 = 11 then 'data' end"""


@query("topic_source_from_offsets", with_views("""
    select seq, type, "table" from change where seq % 3 = 0 and seq // 3 >= 40 or seq % 3 = 1"""))
def topic_source_from_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three partitions: one from its offset 40, one from its beginning, one without offset, so from its newest."""
    log = D.change_log(spark, sf_dir).withColumns({"partition": (F.col("seq") % 3).cast("int"), "offset": F.expr("seq div 3")})
    return decode.parse_change(topics.from_offsets(log, {0: 40, 1: 0})).select("seq", "type", "table")


@query("topic_stream_from_offsets", with_views("""
    select cast(id % 3 as integer) as partition, id // 3 as offset, type from change
    where "table" = 'order_info' and (id % 3 = 0 and id // 3 >= 40 or id % 3 = 1 or id % 3 = 2 and id // 3 >= 100)"""))
def topic_stream_from_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three partitions again, as a stream. It starts when messages up to offset 99 are there, at 40, at 0, and behind
    those of the partition without an offset; the second start is given other offsets and goes on from its checkpoint.
    """
    work = scratch_dir(spark, "archive")
    row_id = F.get_json_object("value", "$.data.id").cast("bigint")
    log = (D.change_log(spark, sf_dir).where(F.get_json_object("value", "$.table") == "order_info")
           .select((row_id % 3).cast("int").alias("partition"), F.floor(row_id / 3).alias("offset"), "value"))
    for part, offsets in (("offset < 100", {0: 40, 1: 0}), ("offset >= 100", {0: 0, 1: 1_000_000, 2: 0})):
        archive.archive(log.where(part), f"{work}/topic")
        stream = archive.archive_stream(spark, f"{work}/topic", offsets)
        jobs.run_to_end(jobs.start(stream, lambda rows, n: rows.write.mode("append").parquet(f"{work}/out"),
                                   f"{work}/checkpoint", every=None))
    read = spark.read.schema(archive.SCHEMA).parquet(f"{work}/out")
    return decode.parse_change(read).select("partition", "offset", "type")


@query("quarantine_change", with_views(f"""
    select seq, reason from (select seq, {_CUT} reason from change) where reason is not null"""))
def quarantine_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change records that are cut off or lack their image or its id are set aside."""
    checked = decode.check_change(D.cut_short(D.change_log(spark, sf_dir)))
    return decode.quarantine(checked, "seq").select("seq", "reason")


@query("quarantine_typed", with_views("""
    select id seq, reason from (select id, case id % 20 when 3 then 'bad_json' when 7 then 'id' when 11 then 'id' end reason
                                from order_info) where reason is not null"""))
def quarantine_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the order topic that are cut off or have no id are set aside."""
    rows = D.order_info(spark, sf_dir)
    messages = rows.select(F.col("id").alias("seq"), scalars.record_to_json(*rows.columns).alias("value"))
    checked = decode.check_typed(D.cut_short(messages), S.ORDER_HEADER, S.REQUIRED["header"])
    return decode.quarantine(checked, "seq").select("seq", "reason")


@query("cdc_op_map", with_views("""select seq, "table", type, op from op_change"""))
def cdc_op_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.with_change_op(I.changes(spark, sf_dir)).select("seq", "table", "type", "op")


@query("cdc_fact_route", with_views(f"select seq, {TOPIC_SQL} topic, data as value from fact_change"))
def cdc_fact_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.fact_topic_rows(spark, sf_dir)


@query("cdc_dim_route", with_views(f'select seq, "table", id, {_KEY} "key", op, data from dim_change'))
def cdc_dim_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.dim_changes(spark, sf_dir)


@query("upper_concat_key", with_views(f'select seq, {_KEY} dim_key, {TOPIC_SQL} topic from op_change'))
def upper_concat_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = routing.with_change_op(I.changes(spark, sf_dir))
    return changes.select("seq", scalars.dim_key(F.col("table"), routing.change_id()).alias("dim_key"),
                          scalars.fact_topic(F.col("table"), F.col("op"), I.SUFFIX).alias("topic"))


_LAST_DIM = """select "table", id, 'DIM:' || upper("table") || ':' || id "key", data, op = 'D' is_deleted, seq
    from (select *, row_number() over (partition by "table", id order by seq desc) rn from dim_change)
    where rn = 1"""


@query("latest_dims", with_views(_LAST_DIM))
def latest_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.latest_dims(I.dim_changes(spark, sf_dir))


@query("dim_upsert", with_views("""
    select "table", id, 'DIM:' || upper("table") || ':' || id "key", data, op = 'D' is_deleted, seq
    from (select *, row_number() over (partition by "table", id order by op <> 'I' desc, seq desc) rn
          from dim_change) where rn = 1"""))
def dim_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts as one batch, updates and deletes as a later one that is run twice; then what is current."""
    path = scratch_dir(spark, "dims")
    I.dim_changes(spark, sf_dir).write.parquet(f"{path}-changes")
    changes = spark.read.parquet(f"{path}-changes")
    jobs.write_dims(changes.where("op = 'I'"), 0, path)
    for _ in range(2):
        jobs.write_dims(changes.where("op <> 'I'"), 1, path)
    return keyed.read_latest(spark, path, jobs.DIM_LAYOUT, ["id"], "table").select(
        *S.names(jobs.DIM_LAYOUT))


@query("last_per_key", with_views("""
    select l_orderkey, l_linenumber, id, sku_id, cast(split_total_amount as double) split_total_amount
    from (select *, row_number() over (partition by l_orderkey, l_linenumber
                                       order by l_shipdate desc, id desc) rn from order_detail)
    where rn = 1"""))
def last_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = D.order_detail(spark, sf_dir, "l_orderkey", "l_linenumber", "l_shipdate")
    last = dedup.last_per_key(lines, ["l_orderkey", "l_linenumber"], ["l_shipdate", "id"])
    return I.result(last.select("l_orderkey", "l_linenumber", "id", "sku_id", "split_total_amount"))


_UPSERT_LAYOUT: S.Layout = [
    ("l_orderkey", "BIGINT"), ("l_linenumber", "INT"), ("id", "BIGINT"), ("sku_id", "BIGINT"),
    ("split_total_amount", S.MONEY), ("month", "STRING")]


@query("keyed_daily_upsert", with_views("""
    select l_orderkey, l_linenumber, id, sku_id, cast(split_total_amount as double) split_total_amount, "month"
    from (select *, substr(create_time, 1, 7) "month", row_number() over (
              partition by l_orderkey, l_linenumber
              order by year(l_shipdate) >= 1998 desc, l_shipdate desc, id desc) rn from order_detail)
    where rn = 1"""))
def keyed_daily_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by order and line number, a key that repeats: two batches, the second one twice."""
    path = scratch_dir(spark, "upsert")
    lines = (D.order_detail(spark, sf_dir, "l_orderkey", "l_linenumber", "l_shipdate")
             .withColumn("month", F.substring("create_time", 1, 7)))
    later = F.year("l_shipdate") >= 1998
    keys, order = ["l_orderkey", "l_linenumber"], ["l_shipdate", "id"]
    wanted = S.names(_UPSERT_LAYOUT) + ["l_shipdate"]
    for batch_id, rows in ((0, lines.where(~later)), (1, lines.where(later)), (1, lines.where(later))):
        keyed.upsert(rows.select(*wanted), batch_id, path, keys, order, "month")
    return I.result(keyed.read_latest(spark, path, _UPSERT_LAYOUT, keys, "month").select(*S.names(_UPSERT_LAYOUT)))
