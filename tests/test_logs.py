import json

import pytest
from pyspark.sql import functions as F
from tidemart import schemas as S
from tidemart.operators import routing
from tidemart.sources import decode, topics

COMMON = {"mid": "m1", "uid": "7", "ar": "3", "os": "os1", "ch": "c", "is_new": "1", "md": "x", "vc": "v", "ba": "b"}
PAGE = {"page_id": "home", "item": "1", "item_type": "sku", "during_time": "12", "source_type": "query"}
START = {"entry": "icon", "open_ad_id": 1, "loading_time": "20", "open_ad_ms": 3, "open_ad_skip_ms": "0"}
SHOWN = {"display_type": "promo", "item": "5", "item_type": "sku", "pos_id": "2", "order": 1}
ACTION = {"item": "5", "action_id": "cart", "item_type": "sku", "ts": "99"}


def parsed(spark, *records):
    rows = [(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(records)]
    return decode.parse_log(spark.createDataFrame(rows, "seq bigint, value string"))


def record(**parts):
    return {"common": COMMON, "ts": 5, **parts}


def counts(log):
    log = decode.usable(log)
    return tuple(f(log).count() for f in (routing.error_rows, routing.page_rows, routing.display_rows,
                                          routing.action_rows, routing.start_rows))


@pytest.mark.parametrize("made,expected", [
    (record(page=PAGE, err={"code": 1}), (1, 0, 0, 0, 0)),
    (record(page=PAGE, start=START), (0, 1, 0, 0, 1)),
    (record(page=PAGE, displays=None), (0, 1, 0, 0, 0)),
    (record(page=PAGE, displays=[], actions=[]), (0, 1, 0, 0, 0)),
    (record(page=PAGE, displays=[SHOWN, SHOWN], actions=[ACTION]), (0, 1, 2, 1, 0)),
    (record(displays=[SHOWN]), (0, 0, 0, 0, 0)),
    (record(page=PAGE, err=None), (0, 1, 0, 0, 0)),
    ({"err": {}}, (1, 0, 0, 0, 0)),
])
def test_routes(spark, made, expected):
    log = parsed(spark, made)
    assert counts(log) == expected
    routed = dict(routing.route_log(decode.usable(log)).groupBy("topic").count().collect())
    assert tuple(routed.get(t, 0) for t in (
        "DWD_ERROR_LOG", "DWD_PAGE_LOG", "DWD_PAGE_DISPLAY_LOG", "DWD_PAGE_ACTION_LOG", "DWD_START_LOG")) == expected


def test_numbers_may_be_quoted_or_bare(spark):
    log = parsed(spark, record(page={**PAGE, "during_time": "12"}), record(page={**PAGE, "during_time": 12}))
    assert [r.during_time for r in routing.page_rows(decode.usable(log)).collect()] == [12, 12]


@pytest.mark.parametrize("made,reason", [
    ('{"a":', "bad_json"), (None, "bad_json"), ("[1]", "bad_json"),
    (record(page={**PAGE, "during_time": "x"}), "during_time"),
    (record(page={k: v for k, v in PAGE.items() if k != "during_time"}), "during_time"),
    (record(page=PAGE, displays=[SHOWN, {**SHOWN, "pos_id": "1.5"}]), "displays.pos_id"),
    (record(page=PAGE, actions=[{**ACTION, "ts": None}]), "actions.ts"),
    (record(start={**START, "open_ad_id": "?"}), "open_ad_id"),
    ({"common": COMMON, "page": PAGE}, "ts"),
    ({"ts": 1, "page": PAGE}, "common"),
    ({"common": COMMON, "ts": "z", "page": {**PAGE, "during_time": "x"}}, "ts,during_time"),
])
def test_quarantine(spark, made, reason):
    log = parsed(spark, made, record(page=PAGE))
    bad = decode.quarantine(log, "seq").collect()
    assert [(r.seq, r.reason) for r in bad] == [(0, reason)]
    assert counts(log) == (0, 1, 0, 0, 0)


def test_a_record_is_parsed_once(spark):
    plan = routing.page_rows(decode.usable(parsed(spark, record(page=PAGE))))._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("from_json") == 1


def test_routed_message_holds_all_columns_but_nulls(spark):
    message = routing.route_log(parsed(spark, record(page=PAGE)), "x").first()
    assert message.topic == "DWD_PAGE_LOG_x"
    body = json.loads(message.value)
    assert body["during_time"] == 12 and body["ts"] == 5 and "last_page_id" not in body
    assert set(body) == set(S.names(S.PAGE_LOG)) - {"last_page_id"}


def change(kind, table, **data):
    return json.dumps({"type": kind, "table": table, "data": data})


def test_change_records(spark):
    raw = spark.createDataFrame([(i, c) for i, c in enumerate([
        change("insert", "order_info", id=1), change("update", "order_info", id=1),
        change("delete", "both", id=2), change("bootstrap-insert", "both", id=3),
        change("bootstrap-start", "both", id=4), change("insert", "other", id=5), "{broken"])],
        "seq bigint, value string")
    changes = decode.parse_change(raw)
    facts = spark.createDataFrame([("order_info",), ("both",)], "table string")
    dims = spark.createDataFrame([("both",)], "table string")
    assert sorted(r.topic for r in routing.fact_route(changes, facts, "s").collect()) == [
        "DWD_BOTH_D_s", "DWD_BOTH_I_s", "DWD_ORDER_INFO_I_s", "DWD_ORDER_INFO_U_s"]
    assert sorted((r.key, r.op) for r in routing.dim_route(changes, dims).collect()) == [
        ("DIM:BOTH:2", "D"), ("DIM:BOTH:3", "I")]


def test_payload_numbers_keep_all_digits(spark):
    body = '{"type":"insert","table":"t","data":{"total_amount":12345678901234.5678,"id":912345678901234567}}'
    changes = decode.parse_change(spark.createDataFrame([(body,)], "value string"))
    row = decode.parse_typed(changes.select(decode.json_text("data").alias("value")), S.ORDER_HEADER).first()
    assert str(row.total_amount) == "12345678901234.5678" and row.id == 912345678901234567


def test_parse_typed_takes_both_forms_of_numbers(spark):
    raw = spark.createDataFrame([('{"id":"5","order_price":"1.50","sku_num":2}',), ('{"id":6,"order_price":1.5,"sku_num":"x"}',)],
                                "value string")
    rows = decode.parse_typed(raw, S.ORDER_LINE).select("id", F.col("order_price").cast("double"), "sku_num").collect()
    assert [tuple(r) for r in rows] == [(5, 1.5, 2), (6, 1.5, None)]


def test_project_by_name(spark):
    df = spark.createDataFrame([("m", None, 1)], "mid string, page_id string, nonsense int")
    assert routing.project_by_name(df, S.DAU_WIDE).columns == ["mid", "page_id"]


def test_kafka_options():
    fresh = topics.kafka_source_options("h:1", "t", "g")
    assert fresh["startingOffsets"] == "latest" and fresh["subscribe"] == "t" and fresh["kafka.group.id"] == "g"
    resumed = topics.kafka_source_options("h:1", "t", "g", {1: 5, 0: 3}, 100)
    assert json.loads(resumed["startingOffsets"]) == {"t": {"0": 3, "1": 5}}
    assert resumed["maxOffsetsPerTrigger"] == "100"
    some = topics.kafka_source_options("h:1", "t", "g", {1: 5}, partitions=3)
    assert json.loads(some["startingOffsets"]) == {"t": {"0": -1, "1": 5, "2": -1}}
    sink = topics.kafka_sink_options("h:1")
    assert sink["kafka.acks"] == "all" and sink["kafka.enable.idempotence"] == "true"
