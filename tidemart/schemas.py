"""Record layouts. Each is a list of ``(column, type)`` pairs.

Money is an exact decimal inside the mart and becomes DOUBLE only in results.
"""

from __future__ import annotations

MONEY = "DECIMAL(18,4)"

Layout = list[tuple[str, str]]


def ddl(layout: Layout) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in layout)


def text_ddl(layout: Layout) -> str:
    """The same columns as text, save decimals: a JSON number may or may not be quoted."""
    return ", ".join(f"`{name}` {kind if kind.startswith('DECIMAL') else 'STRING'}" for name, kind in layout)


def names(layout: Layout) -> list[str]:
    return [name for name, _ in layout]


# Raw behaviour log. Every leaf is text; `err` is opaque.
RAW_LOG_DDL = """
    common STRUCT<ar STRING, uid STRING, os STRING, ch STRING, is_new STRING,
                  md STRING, mid STRING, vc STRING, ba STRING>,
    page STRUCT<page_id STRING, item STRING, during_time STRING, item_type STRING,
                last_page_id STRING, source_type STRING>,
    displays ARRAY<STRUCT<display_type STRING, item STRING, item_type STRING,
                          pos_id STRING, `order` STRING>>,
    actions ARRAY<STRUCT<item STRING, action_id STRING, item_type STRING, ts STRING>>,
    start STRUCT<entry STRING, open_ad_skip_ms STRING, open_ad_ms STRING,
                 loading_time STRING, open_ad_id STRING>,
    err VARIANT, ts STRING, _corrupt_record STRING
"""

COMMON: Layout = [(c, "STRING") for c in (
    "mid", "user_id", "province_id", "channel", "is_new", "model",
    "operate_system", "version_code", "brand")]

PAGE_PART: Layout = [
    ("page_id", "STRING"), ("last_page_id", "STRING"), ("page_item", "STRING"),
    ("page_item_type", "STRING"), ("during_time", "BIGINT"), ("source_type", "STRING")]

PAGE_LOG: Layout = COMMON + PAGE_PART + [("ts", "BIGINT")]

DISPLAY_LOG: Layout = COMMON + PAGE_PART + [
    ("display_type", "STRING"), ("display_item", "STRING"), ("display_item_type", "STRING"),
    ("display_order", "BIGINT"), ("display_pos_id", "BIGINT"), ("ts", "BIGINT")]

ACTION_LOG: Layout = COMMON + PAGE_PART + [
    ("action_id", "STRING"), ("action_item", "STRING"), ("action_item_type", "STRING"),
    ("action_ts", "BIGINT"), ("ts", "BIGINT")]

START_LOG: Layout = COMMON + [
    ("entry", "STRING"), ("open_ad_id", "BIGINT"), ("loading_time_ms", "BIGINT"),
    ("open_ad_ms", "BIGINT"), ("open_ad_skip_ms", "BIGINT"), ("ts", "BIGINT")]

DAU_WIDE: Layout = COMMON + [
    ("page_id", "STRING"), ("page_item", "STRING"), ("page_item_type", "STRING"),
    ("source_type", "STRING"), ("during_time", "BIGINT"),
    ("user_gender", "STRING"), ("user_age", "STRING"),
    ("province_name", "STRING"), ("province_iso_code", "STRING"),
    ("province_3166_2", "STRING"), ("province_area_code", "STRING"),
    ("dt", "STRING"), ("hr", "STRING"), ("ts", "BIGINT")]

ORDER_HEADER: Layout = [
    ("id", "BIGINT"), ("province_id", "BIGINT"), ("order_status", "STRING"),
    ("user_id", "BIGINT"), ("total_amount", MONEY), ("activity_reduce_amount", MONEY),
    ("coupon_reduce_amount", MONEY), ("original_total_amount", MONEY),
    ("feight_fee", MONEY), ("feight_fee_reduce", MONEY), ("expire_time", "STRING"),
    ("refundable_time", "STRING"), ("create_time", "STRING"), ("operate_time", "STRING")]

ORDER_HEADER_ADDED: Layout = [
    ("create_date", "STRING"), ("create_hour", "STRING"), ("province_name", "STRING"),
    ("province_area_code", "STRING"), ("province_3166_2_code", "STRING"),
    ("province_iso_code", "STRING"), ("user_age", "INT"), ("user_gender", "STRING")]

ORDER_LINE: Layout = [
    ("id", "BIGINT"), ("order_id", "BIGINT"), ("sku_id", "BIGINT"), ("order_price", MONEY),
    ("sku_num", "BIGINT"), ("sku_name", "STRING"), ("create_time", "STRING"),
    ("split_total_amount", MONEY), ("split_activity_amount", MONEY),
    ("split_coupon_amount", MONEY)]

# What a record of a topic must have to be used.
REQUIRED = {"page": ("mid", "ts"), "header": ("id",), "line": ("id", "order_id")}

# One row per order line: the line's columns, then the header's; a shared name is the line's.
ORDER_WIDE: Layout = (
    [("detail_id", "BIGINT"), ("order_id", "BIGINT")]
    + [c for c in ORDER_LINE if c[0] not in ("id", "order_id", "create_time")]
    + [c for c in ORDER_HEADER if c[0] != "id"]
    + ORDER_HEADER_ADDED)

USER_DIM: Layout = [("id", "BIGINT"), ("gender", "STRING"), ("birthday", "STRING")]
PROVINCE_DIM: Layout = [
    ("id", "BIGINT"), ("name", "STRING"), ("area_code", "STRING"),
    ("iso_code", "STRING"), ("iso_3166_2", "STRING")]
