"""Split raw logs and change records into typed rows and topics.

The inputs are the outputs of ``decode``; fields besides the message's own (such as
``seq``) are carried along by the typed splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemart import schemas as S
from tidemart.functions.scalars import dim_key, fact_topic
from tidemart.sources.decode import json_text

# fixed values: where each part of a log goes
LOG_TOPICS = {
    "error": "DWD_ERROR_LOG",
    "page": "DWD_PAGE_LOG",
    "display": "DWD_PAGE_DISPLAY_LOG",
    "action": "DWD_PAGE_ACTION_LOG",
    "start": "DWD_START_LOG",
}

# fixed values: short names in a log's `common` part -> columns
COMMON_FIELDS = {
    "mid": "mid", "uid": "user_id", "ar": "province_id", "ch": "channel", "is_new": "is_new",
    "md": "model", "os": "operate_system", "vc": "version_code", "ba": "brand",
}

# fixed values: change types that count, and the operation each stands for
CHANGE_OPS = {"insert": "I", "bootstrap-insert": "I", "update": "U", "delete": "D"}


# Columns of the typed rows as SQL. `item` is one element of `displays` or `actions`.
COMMON_COLUMNS = [f"common.{short} AS {name}" for short, name in COMMON_FIELDS.items()]
PAGE_COLUMNS = [
    "page.page_id AS page_id", "page.last_page_id AS last_page_id", "page.item AS page_item",
    "page.item_type AS page_item_type", "try_cast(page.during_time AS BIGINT) AS during_time",
    "page.source_type AS source_type"]
DISPLAY_COLUMNS = [
    "item.display_type AS display_type", "item.item AS display_item",
    "item.item_type AS display_item_type", "try_cast(item.`order` AS BIGINT) AS display_order",
    "try_cast(item.pos_id AS BIGINT) AS display_pos_id"]
ACTION_COLUMNS = [
    "item.action_id AS action_id", "item.item AS action_item",
    "item.item_type AS action_item_type", "try_cast(item.ts AS BIGINT) AS action_ts"]
START_COLUMNS = [
    "start.entry AS entry", "try_cast(start.open_ad_id AS BIGINT) AS open_ad_id",
    "try_cast(start.loading_time AS BIGINT) AS loading_time_ms",
    "try_cast(start.open_ad_ms AS BIGINT) AS open_ad_ms",
    "try_cast(start.open_ad_skip_ms AS BIGINT) AS open_ad_skip_ms"]
TS_COLUMN = ["try_cast(ts AS BIGINT) AS ts"]


def common_rows(log: DataFrame, *keep: str) -> DataFrame:
    """What every record that is no failure has: who, where, with what, when."""
    return log.where("err IS NULL").selectExpr(*keep, *COMMON_COLUMNS, *TS_COLUMN)


def error_rows(log: DataFrame, *keep: str) -> DataFrame:
    """The ``err`` object of a failing record; nothing else of that record goes anywhere."""
    return log.where("err IS NOT NULL").select(*keep, "err")


def page_rows(log: DataFrame, *keep: str) -> DataFrame:
    return _pages(log).selectExpr(*keep, *COMMON_COLUMNS, *PAGE_COLUMNS, *TS_COLUMN)


def start_rows(log: DataFrame, *keep: str) -> DataFrame:
    """Independent of ``page_rows``: one record may have both parts."""
    return (log.where("err IS NULL AND start IS NOT NULL")
            .selectExpr(*keep, *COMMON_COLUMNS, *START_COLUMNS, *TS_COLUMN))


def display_rows(log: DataFrame, *keep: str) -> DataFrame:
    """A row per display of a page; no displays, no rows."""
    items = _pages(log).selectExpr(*keep, "common", "page", "ts", "explode(displays) AS item")
    return items.selectExpr(*keep, *COMMON_COLUMNS, *PAGE_COLUMNS, *DISPLAY_COLUMNS, *TS_COLUMN)


def action_rows(log: DataFrame, *keep: str) -> DataFrame:
    """A row per action on a page; no actions, no rows."""
    items = _pages(log).selectExpr(*keep, "common", "page", "ts", "explode(actions) AS item")
    return items.selectExpr(*keep, *COMMON_COLUMNS, *PAGE_COLUMNS, *ACTION_COLUMNS, *TS_COLUMN)


def _pages(log: DataFrame) -> DataFrame:
    return log.where("err IS NULL AND page IS NOT NULL")


def route_log(log: DataFrame, suffix: str = "") -> DataFrame:
    """All five outputs at once as ``topic, value``: each record is read one time only.

    A record becomes an array of messages which is then unfolded, so nothing has to be
    cached and re-read per output.
    """
    tail = f"_{suffix}" if suffix else ""

    def message(route: str, *columns: str) -> str:
        record = ", ".join([*COMMON_COLUMNS, *columns, *TS_COLUMN])
        return f"struct('{LOG_TOPICS[route]}{tail}' AS topic, to_json(struct({record})) AS value)"

    page = message("page", *PAGE_COLUMNS)
    display = message("display", *PAGE_COLUMNS, *DISPLAY_COLUMNS)
    action = message("action", *PAGE_COLUMNS, *ACTION_COLUMNS)
    start = message("start", *START_COLUMNS)
    return log.selectExpr(f"""inline(
        CASE WHEN err IS NOT NULL THEN array(struct('{LOG_TOPICS["error"]}{tail}' AS topic, err AS value))
        ELSE concat(
            CASE WHEN page IS NULL THEN array() ELSE concat(
                array({page}),
                transform(coalesce(displays, array()), item -> {display}),
                transform(coalesce(actions, array()), item -> {action})) END,
            CASE WHEN start IS NULL THEN array() ELSE array({start}) END) END)""")


def change_op(kind: Column) -> Column:
    """I, U or D; NULL for a change type that does not count."""
    return F.create_map(*(F.lit(x) for pair in CHANGE_OPS.items() for x in pair))[kind]


def change_id() -> Column:
    """The id in a change's row image."""
    return F.try_variant_get("data", "$.id", "bigint")


def with_change_op(changes: DataFrame) -> DataFrame:
    return changes.withColumn("op", change_op(F.col("type"))).where("op IS NOT NULL")


def fact_route(changes: DataFrame, fact_tables: DataFrame, suffix: str, *keep: str) -> DataFrame:
    """Changes of fact tables as ``topic, value``. The list has a row per table of the source: it is broadcast."""
    return (with_change_op(changes).join(F.broadcast(fact_tables), "table", "left_semi")
            .select(*keep, fact_topic(F.col("table"), F.col("op"), suffix).alias("topic"),
                    json_text("data").alias("value")))


def dim_route(changes: DataFrame, dim_tables: DataFrame, *keep: str) -> DataFrame:
    """Changes of dimension tables as ``table, id, key, op, data``; a table may be in both lists."""
    row_id = change_id()
    return (with_change_op(changes).join(F.broadcast(dim_tables), "table", "left_semi")
            .select(*keep, "table", row_id.alias("id"),
                    dim_key(F.col("table"), row_id).alias("key"), "op", json_text("data").alias("data")))


def project_by_name(df: DataFrame, target: S.Layout) -> DataFrame:
    """The columns of ``target`` that ``df`` has, NULLs included; others are dropped."""
    return df.select(*(c for c in S.names(target) if c in df.columns))
