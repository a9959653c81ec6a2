"""The mart's tables as the plans use them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart import schemas as S
from tidemart.operators import dau, orders, routing
from tidemart.session import FREE_SHUFFLES, scratch_dir, settings
from tidemart.sinks.topics import file_sink
from tidemart.sources import decode, driver_tables as D
from tidemart.sources.driver_tables import AS_OF

SUFFIX = "live"
ORDER = ["ts", "seq"]

#: Adaptive execution packs a join's tasks by bytes; rows made into JSON and parsed are much work for theirs.
SMALL_TASKS = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m"}


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def result(df: DataFrame) -> DataFrame:
    """Decimals leave the mart as DOUBLE."""
    return df.select(*(F.col(f.name).cast("double").alias(f.name) if f.dataType.typeName() == "decimal"
                       else F.col(f.name) for f in df.schema.fields))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.usable(decode.parse_log(D.raw_log(spark, sf_dir)))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.page_rows(logs(spark, sf_dir), "seq")


def changes(spark: SparkSession, sf_dir: str, kinds: Iterable[str] = ()) -> DataFrame:
    """All changes, or those that may be of these types; see ``decode.parse_change``."""
    return decode.parse_change(D.change_log(spark, sf_dir, deal=True), kinds=kinds)


def fact_topic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.fact_route(changes(spark, sf_dir, routing.CHANGE_OPS), D.table_list(spark, D.FACT_TABLES), SUFFIX, "seq")


def dim_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.dim_route(changes(spark, sf_dir), D.table_list(spark, D.DIM_TABLES), "seq")


def stored_topics(spark: SparkSession, sf_dir: str, *tables: str) -> str:
    """Writes the topics of new rows of these fact tables, as the change router does, and returns their folder."""
    path = scratch_dir(spark, "facts")
    new = [kind for kind, op in routing.CHANGE_OPS.items() if op == "I"]
    parsed = decode.parse_change(D.change_log(spark, sf_dir), kinds=new)
    routed = routing.fact_route(parsed, D.table_list(spark, list(tables)), SUFFIX)
    with settings(spark, SMALL_TASKS | FREE_SHUFFLES):
        file_sink(path, compression="gzip")(routed.where(F.col("topic").endswith(f"_I_{SUFFIX}")), 0)
    return path


def inserted(spark: SparkSession, path: str, table: str, layout: S.Layout) -> DataFrame:
    """Rows of the topic of new rows of a fact table; other topics' files are not read."""
    topic = f"DWD_{table.upper()}_I_{SUFFIX}"
    stored = spark.read.schema("value STRING, topic STRING, batch_id BIGINT").text(path)
    return decode.parse_typed(stored.where(F.col("topic") == topic).select("value"), layout)


def parsed_topics(spark: SparkSession, sf_dir: str, header: list[str], line: list[str]) -> tuple[DataFrame, DataFrame]:
    """These columns of new headers and new lines, parsed from their topics once and stored: their readers take both twice."""
    path, stored = stored_topics(spark, sf_dir, "order_info", "order_detail"), scratch_dir(spark, "parsed")
    inserted(spark, path, "order_info", S.ORDER_HEADER).select(*header).write.parquet(f"{stored}/headers")
    inserted(spark, path, "order_detail", S.ORDER_LINE).select(*line).write.parquet(f"{stored}/lines")
    return spark.read.parquet(f"{stored}/headers"), spark.read.parquet(f"{stored}/lines")


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order headers with their derived columns."""
    return orders.enrich_headers(D.order_info(spark, sf_dir), D.user_info(spark, sf_dir),
                                 D.base_province(spark, sf_dir), as_of())


def order_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders.order_wide(headers(spark, sf_dir), D.order_detail(spark, sf_dir))


def dau_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dau.dau_table(pages(spark, sf_dir), D.user_info(spark, sf_dir),
                         D.base_province(spark, sf_dir), as_of(), ORDER)


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dau.first_seen(pages(spark, sf_dir))


# What tells messages of the five log topics apart, and the same from the SQL views.
ROUTED_SQL = """
    select 'DWD_ERROR_LOG' topic, null mid, null page_id, regexp_extract(err, ':([0-9]+)', 1) part, 'boom' detail,
           null ts from err
    union all select 'DWD_PAGE_LOG', mid, page_id, page_item, cast(during_time as varchar), ts from page
    union all select 'DWD_PAGE_DISPLAY_LOG', mid, page_id, display_item, cast(display_order as varchar), ts from display
    union all select 'DWD_PAGE_ACTION_LOG', mid, page_id, action_item, cast(action_ts as varchar), ts from action
    union all select 'DWD_START_LOG', mid, null, entry, cast(open_ad_id as varchar), ts from start_log"""


def routed_rows(messages: DataFrame) -> DataFrame:
    """``topic, value`` of the log topics as rows."""
    def first(*names: str) -> Column:
        return F.coalesce(*(F.get_json_object("value", f"$.{n}") for n in names))
    return messages.select(
        "topic", first("mid").alias("mid"), first("page_id").alias("page_id"),
        first("display_item", "action_item", "entry", "error_code", "page_item").alias("part"),
        first("display_order", "action_ts", "open_ad_id", "msg", "during_time").alias("detail"),
        first("ts").cast("bigint").alias("ts"))
