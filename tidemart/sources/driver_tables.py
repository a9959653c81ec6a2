"""Mart inputs derived from the driver tables: logs, changes, orders, dimensions.

All of it is row-by-row or an equi-join on a table's own key, so it grows with the
tables and needs no window over a key that may be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart import schemas as S

AS_OF = "2001-08-02"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many tasks as there are cores.

    For tables whose rows are turned into JSON and back, which is much work per row: one
    small file would be a single task. A table read by enough tasks is left as it is, so
    large tables are not shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: So many rows are made into messages, parsed and printed by a task: some seconds of work.
ROWS_PER_TASK = 200_000


def dealt(joined: DataFrame, source: DataFrame) -> DataFrame:
    """``joined``, about as many rows as ``source`` has, dealt evenly over tasks whose number grows with them.

    For rows that are turned into JSON and back: adaptive execution packs a join's tasks by bytes, and few bytes of
    a join are very much work here. ``source`` is a stored table, so its count reads no column.
    """
    tasks = max(joined.sparkSession.sparkContext.defaultParallelism, -(-source.count() // ROWS_PER_TASK))
    return joined.repartition(tasks)


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, value``: one behaviour-log message per event."""
    return log_messages(spread(table(spark, sf_dir, "events")))


def log_messages(events: DataFrame) -> DataFrame:
    # The zone-less timestamp is read as UTC and rounded down to milliseconds.
    event = events.selectExpr(
        "event_id AS i", "user_id AS u", "event_type AS kind",
        """unix_date(CAST(ts AS DATE)) * 86400000L + hour(ts) * 3600000L + minute(ts) * 60000L
           + CAST(floor(extract(SECOND FROM ts) * 1000) AS BIGINT) AS ms""",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS k")
    return event.selectExpr("i AS seq", """to_json(struct(
        struct(CAST(u % 25 AS STRING) AS ar, CAST(u AS STRING) AS uid, 'os' || k % 2 AS os,
               'ch' || k % 3 AS ch, CAST(k % 2 AS STRING) AS is_new, 'md' || k % 7 AS md,
               'mid_' || u AS mid, 'v2.1' AS vc, 'ba' || k % 5 AS ba) AS common,
        CASE WHEN kind <> 'signup' THEN
            struct('p' || i % 5 AS page_id, CAST(i % 100 AS STRING) AS item,
                   CAST(i % 10000 AS STRING) AS during_time, 'sku_id' AS item_type,
                   CASE WHEN i % 3 <> 0 THEN 'p' || (i + 1) % 5 END AS last_page_id,
                   'query' AS source_type) END AS page,
        CASE WHEN kind <> 'signup' AND k % 4 > 0 THEN transform(sequence(1L, k % 4), n ->
            struct('promo' AS display_type, CAST((i + n) % 100 AS STRING) AS item,
                   'sku_id' AS item_type, CAST(n % 5 AS STRING) AS pos_id,
                   CAST(n AS STRING) AS `order`)) END AS displays,
        CASE WHEN kind IN ('click', 'purchase') THEN array(
            struct(CAST(i % 100 AS STRING) AS item, kind AS action_id, 'sku_id' AS item_type,
                   CAST(ms + 500 AS STRING) AS ts)) END AS actions,
        CASE WHEN kind = 'signup' THEN
            struct('icon' AS entry, '0' AS open_ad_skip_ms, CAST(k * 3 AS STRING) AS open_ad_ms,
                   CAST(k * 10 AS STRING) AS loading_time, CAST(k AS STRING) AS open_ad_id) END AS start,
        CASE WHEN kind = 'error' THEN struct(k AS error_code, 'boom' AS msg) END AS err,
        ms AS ts)) AS value""")


def damaged_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same messages, of which some are cut short and some hold bad numbers."""
    value = F.col("value")
    broken = (F.when(F.col("seq") % 50 == 0, F.expr("left(value, 40)"))
              .when(F.col("seq") % 50 == 1,
                    F.regexp_replace(value, '"during_time":"', '"during_time":"x'))
              .when(F.col("seq") % 50 == 2,
                    F.regexp_replace(value, '"(loading_time|pos_id)":"', '"$1":"1.5')))
    return raw_log(spark, sf_dir).withColumn("value", F.coalesce(broken, value))


def cut_short(messages: DataFrame) -> DataFrame:
    """Messages of which some are cut off or emptied, by their number ``seq``."""
    value = F.col("value")
    broken = (F.when(F.col("seq") % 20 == 3, F.expr("left(value, length(value) - 5)"))
              .when(F.col("seq") % 20 == 7, F.regexp_replace(value, '"id":', '"no":'))
              .when(F.col("seq") % 20 == 11, F.lit('{"type":"insert","table":"order_info"}')))
    return messages.withColumn("value", F.coalesce(broken, value))


def _money(column: str, scale: int = 2) -> Column:
    return F.col(column).cast(f"decimal(12,{scale})")


def _clock(day: str, key: str, minute: Column) -> Column:
    def two(n: Column) -> Column:
        return F.lpad(n.cast("string"), 2, "0")
    return F.concat(F.col(day).cast("date").cast("string"), F.lit(" "), two(F.col(key) % 24),
                    F.lit(":"), two(minute % 60), F.lit(":00"))


def _laid_out(df: DataFrame, layout: S.Layout) -> DataFrame:
    return df.select(*(F.col(c).cast(kind).alias(c) for c, kind in layout))


def order_info(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    """Order headers; ``deal`` deals them evenly over tasks behind the join, not before it."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    none, zero = F.lit(None).cast("string"), F.lit(0)
    joined = (orders if deal else spread(orders)).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return _laid_out((dealt(joined, orders) if deal else joined).select(
        F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("province_id"),
        F.col("o_orderstatus").alias("order_status"), F.col("o_custkey").alias("user_id"),
        _money("o_totalprice").alias("total_amount"),
        zero.alias("activity_reduce_amount"), zero.alias("coupon_reduce_amount"),
        zero.alias("original_total_amount"), zero.alias("feight_fee"),
        zero.alias("feight_fee_reduce"), none.alias("expire_time"), none.alias("refundable_time"),
        _clock("o_orderdate", "o_orderkey", F.col("o_orderkey")).alias("create_time"),
        none.alias("operate_time")), S.ORDER_HEADER)


def _line_id() -> Column:
    """A 60-bit digest of the line's own columns: the tables give lines no unique number."""
    parts = F.concat_ws(
        "|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
        F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
        _money("l_extendedprice").cast("string"), F.col("l_shipdate").cast("date").cast("string"))
    return F.conv(F.substring(F.md5(parts), 1, 15), 16, 10).cast("bigint")


def order_detail(spark: SparkSession, sf_dir: str, *extra: str, deal: bool = False) -> DataFrame:
    """Order lines; ``extra`` names further lineitem columns to keep, ``deal`` as for ``order_info``."""
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    # Products first: the result then lies by order, as the join with the headers wants it.
    joined = ((line if deal else spread(line)).join(part, F.col("l_partkey") == F.col("p_partkey"))
              .join(orders, F.col("l_orderkey") == F.col("o_orderkey")))
    joined = dealt(joined, line) if deal else joined
    discount = F.col("l_discount").cast("decimal(4,2)")
    paid = F.lit(1).cast("decimal(4,2)") - discount
    laid_out = joined.select(
        _line_id().alias("id"), F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("sku_id"), _money("p_retailprice").alias("order_price"),
        F.col("l_quantity").alias("sku_num"), F.col("p_name").alias("sku_name"),
        _clock("o_orderdate", "o_orderkey", F.col("o_orderkey") + F.col("l_linenumber")).alias("create_time"),
        (_money("l_extendedprice") * paid).alias("split_total_amount"),
        F.lit(0).alias("split_activity_amount"),
        (_money("l_extendedprice") * discount).alias("split_coupon_amount"), *extra)
    return laid_out.select(*(F.col(c).cast(kind).alias(c) for c, kind in S.ORDER_LINE), *extra)


def user_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    born = F.date_add(F.lit("1965-01-01").cast("date"), (key * 397 % 11000).cast("int"))
    return table(spark, sf_dir, "customer").select(
        key.alias("id"), F.when(key % 2 == 0, "F").otherwise("M").alias("gender"),
        born.cast("string").alias("birthday"))


def base_province(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, region = F.col("n_nationkey"), F.col("n_regionkey").cast("string")
    return table(spark, sf_dir, "nation").select(
        key.cast("bigint").alias("id"), F.col("n_name").alias("name"),
        (110000 + key * 1000).cast("string").alias("area_code"),
        F.concat(F.lit("CN-"), F.lpad(key.cast("string"), 2, "0")).alias("iso_code"),
        F.concat(F.lit("R"), region, F.lit("-"), key.cast("string")).alias("iso_3166_2"))


def sku_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("sku_name"),
        F.col("p_brand").alias("brand"), F.col("p_type").alias("category"))


def movie(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")

    def actor(n: int) -> Column:
        return F.struct(F.concat(F.lit("actor_"), (key % n).cast("string")).alias("name"))
    return table(spark, sf_dir, "part").select(
        key.alias("id"), F.col("p_name").alias("name"),
        (F.col("p_size").cast("double") / 5).alias("score"),
        F.array(actor(7), actor(11), actor(7)).alias("actors"))


# fixed values: which tables are facts and which are dimensions
FACT_TABLES = ["order_info", "order_detail", "sku_info"]
DIM_TABLES = ["user_info", "base_province", "sku_info"]


def table_list(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "table STRING")


def change_log(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    """``seq, value``: one change record per row of six tables; users change twice.

    ``deal`` deals orders and lines evenly over tasks, for readers with much work per message.
    """
    last = F.col("id") % 10
    kind = (F.when(last == 0, "delete").when(last <= 2, "update").when(last == 3, "bootstrap-insert")
            .when(last == 4, "bootstrap-start").otherwise("insert"))

    def changes(name: str, rows: DataFrame, kind: Column = kind, occurrence: int = 0) -> DataFrame:
        message = F.to_json(F.struct(
            kind.alias("type"), F.lit(name).alias("table"), F.struct(*rows.columns).alias("data")))
        return rows.select((F.col("id") * 2 + occurrence).alias("seq"), message.alias("value"))

    users = spread(user_info(spark, sf_dir))
    other = F.when(F.col("gender") == "F", "M").otherwise("F")
    changed = users.withColumn("gender", F.when(last == 1, other).otherwise(F.col("gender")))
    noise = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("id"), "r_name")
    parts = [
        changes("order_info", order_info(spark, sf_dir, deal)),
        changes("order_detail", order_detail(spark, sf_dir, deal=deal)),
        changes("user_info", users),
        changes("user_info", changed, F.lit("update"), 1),
        changes("base_province", base_province(spark, sf_dir)),
        changes("sku_info", spread(sku_info(spark, sf_dir))),
        changes("noise", noise),
    ]
    log = parts[0]
    for part in parts[1:]:
        log = log.unionByName(part)
    return log
