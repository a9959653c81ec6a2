"""Change records at size: who is parsed, how often, and over how many tasks."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemart.operators import routing
from tidemart.plans import change_plans, order_plans
from tidemart.sources import decode, driver_tables as D

DAY = datetime.datetime(1995, 3, 4)


@pytest.fixture
def tables(spark, path):
    """40 orders; those from 30 on have no lines, and lines of the orders from 100 on have no header."""
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    ids = list(range(40))
    write("region", [(0, "r")], "r_regionkey INT, r_name STRING")
    write("nation", [(0, "n", 0)], "n_nationkey INT, n_name STRING, n_regionkey INT")
    write("customer", [(i, 0) for i in ids], "c_custkey BIGINT, c_nationkey INT")
    write("part", [(i, f"part \\ {i}", "b", "t", 1, 1.5) for i in ids],
          "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE")
    orders = [(i, i, "O", 10.25, DAY) for i in ids] + [(i, 999, "O", 10.25, DAY) for i in range(100, 110)]
    write("orders", orders, "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ")
    write("lineitem", [(o, o % 40, 1, n, 2.0, 10.5, 0.05, DAY) for o in (*range(30), *range(100, 110)) for n in (1, 2)],
          "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, "
          "l_discount DOUBLE, l_shipdate TIMESTAMP_NTZ")
    return path


def tasks_of(messages):
    """How many tasks make the messages of each table."""
    table = F.get_json_object("value", "$.table").alias("table")
    made = messages.select(table, F.spark_partition_id().alias("task")).groupBy("table").agg(F.count_distinct("task").alias("n"))
    return {r.table: r.n for r in made.collect()}


def test_users_and_products_of_one_file_are_changes_of_many_tasks(spark, tables):
    made = tasks_of(D.change_log(spark, tables))
    assert made["user_info"] > 4 and made["sku_info"] > 2


def test_tasks_of_orders_and_lines_grow_with_them(spark, tables, monkeypatch):
    monkeypatch.setattr(D, "ROWS_PER_TASK", 2)
    dealt = D.change_log(spark, tables, deal=True)
    plain = D.change_log(spark, tables)
    made = tasks_of(dealt)
    assert made["order_info"] > 12 and made["order_detail"] > 25
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, plain.collect()))
    assert len(change_plans.parse_change_json(spark, tables).collect()) == 40 + 80 + 2 * 40 + 1 + 40 + 1


def test_changes_of_other_kinds_are_not_parsed(spark):
    def change(kind):
        return f'{{"type":{kind},"table":"t","data":{{"id":1}}}}'
    escaped = '"\\u0069nsert"'
    raw = spark.createDataFrame([(i, v) for i, v in enumerate([
        change('"insert"'), change('"bootstrap-insert"'), change(escaped), change('"update"'), change('"bootstrap-start"'),
        change("null"), change("7"), '{"type":"insert', None, "'insert'"])], "seq BIGINT, value STRING")
    everything, some = decode.parse_change(raw), decode.parse_change(raw, kinds=["insert", "bootstrap-insert"])
    assert sorted(r.seq for r in some.collect()) == [0, 1, 2]
    assert sorted(r.seq for r in everything.collect()) == [0, 1, 2, 3, 4, 6]
    kept = [sorted((r.seq, r.op) for r in routing.with_change_op(c).where("op = 'I'").collect()) for c in (everything, some)]
    assert kept[0] == kept[1] == [(0, "I"), (1, "I"), (2, "I")]


def test_ids_of_any_form_and_reasons(spark):
    def change(data):
        return f'{{"type":"insert","table":"t","data":{data}}}'
    cases = {
        change('{"id":7}'): None, change('{"id":"7"}'): None, change('{"id":7.0}'): None, change('{"id":-9223372036854775808}'): None,
        change('{"id":92233720368547758070}'): "id", change('{"id":"x"}'): "id", change('{"id":null}'): "id",
        change('{"id":{"id":1}}'): "id", change('{"no":1}'): "id", change("[1]"): "id", change("5"): "id", change("null"): "data",
        '{"table":"t","data":{"id":1}}': "type", '{"type":"insert","data":{"id":1}}': "table", "{broken": "bad_json", None: "bad_json"}
    raw = spark.createDataFrame([(v,) for v in cases], "value STRING")
    assert {r.value: r.fault for r in decode.check_change(raw).collect()} == cases
    plan = decode.parse_change(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert "isnull(value" not in plan  # so a usable record does not carry its message behind the parse


def test_topics_of_orders_are_parsed_once(spark, tables):
    def new(key):
        return key % 10 == 3 or key % 10 > 4
    lines = [(r.id, r.order_id) for r in D.order_detail(spark, tables).collect() if new(r.id)]
    headers = [i for i in range(40) if new(i)]
    joined, alone = order_plans.order_detail_full_outer(spark, tables), order_plans.unmatched_orders(spark, tables)
    for result in (joined, alone):
        assert "from_json" not in result._jdf.queryExecution().optimizedPlan().toString()
    with_lines = {o for _, o in lines}
    assert sorted(((r.order_id, r.header_id, r.detail_id) for r in joined.collect()), key=str) == sorted(
        [(o, o if o in headers else None, i) for i, o in lines] + [(h, h, None) for h in headers if h not in with_lines], key=str)
    assert sorted(map(tuple, alone.collect())) == sorted(
        [("header", h, h) for h in headers if h not in with_lines] + [("line", i, o) for i, o in lines if o not in headers])
