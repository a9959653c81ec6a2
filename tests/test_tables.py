import random

import pytest
from pyspark.sql import functions as F

from tidemart.operators import dedup, documents, orders, reports, search, traffic
from tidemart.operators.dims import latest_dims, lookup_province, lookup_user
from tidemart.sinks import keyed
from tidemart.sources.tables import read_or_empty

DAY = 86_400_000


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def pages(spark, *items):
    """(mid, ts, last_page_id) -> page rows."""
    return spark.createDataFrame([(m, t, last, i) for i, (m, t, last) in enumerate(items)],
                                 "mid string, ts bigint, last_page_id string, seq bigint")


def test_dau_dedup_counts_each_row_for_its_own_day(spark):
    df = pages(spark, ("a", DAY - 60_000, None), ("a", DAY + 60_000, None), ("a", DAY + 5, None), ("b", 7, None))
    assert rows(dedup.dau_dedup(df, ["ts", "seq"]), "mid", "dt", "ts") == [
        ("a", "1970-01-01", DAY - 60_000), ("a", "1970-01-02", DAY + 5), ("b", "1970-01-01", 7)]


def test_dedup_reduces_before_the_shuffle(spark):
    plan = dedup.dau_dedup(pages(spark, ("a", 1, None)), ["ts"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan


def test_last_per_key_and_dims(spark):
    df = spark.createDataFrame([("t", 1, "k", "I", "old", 1), ("t", 1, "k", "D", "last", 3), ("t", 1, "k", "U", "mid", 2),
                                ("t", 2, "k2", "I", "x", 1)],
                               "table string, id bigint, key string, op string, data string, seq bigint")
    assert rows(latest_dims(df), "id", "data", "is_deleted") == [(1, "last", True), (2, "x", False)]
    assert rows(dedup.last_per_key(df, ["id"], ["seq"]), "id", "data") == [(1, "last"), (2, "x")]


def test_unknown_dimensions_keep_the_row(spark):
    fact = spark.createDataFrame([("1", "9"), ("2", None), (None, "1")], "user_id string, province_id string")
    users = spark.createDataFrame([(1, "F", "2000-02-29")], "id bigint, gender string, birthday string")
    provinces = spark.createDataFrame([(1, "n", "a", "i", "3")],
                                      "id bigint, name string, area_code string, iso_code string, iso_3166_2 string")
    wide = lookup_province(lookup_user(fact, users, F.lit("2023-02-28").cast("date")), provinces)
    got = {(r.user_id, r.user_gender, r.user_age, r.province_name) for r in wide.collect()}
    assert got == {("1", "F", 22, None), ("2", None, None, None), (None, None, None, "n")}


HEADER = "id bigint, province_id bigint, order_status string, user_id bigint, create_time string"
LINE = "id bigint, order_id bigint, sku_name string, create_time string"


def headers_and_lines(spark):
    headers = spark.createDataFrame([(1, 1, "s", 1, "2001-01-01 10:00:00"), (2, 1, "s", 1, "2001-01-01 11:00:00")], HEADER)
    lines = spark.createDataFrame([(10, 1, "x", "2001-01-01 10:05:00"), (11, 1, "y", None), (30, 3, "z", "2001-01-01 09:00:00")], LINE)
    return headers, lines


def test_full_outer_and_unmatched(spark):
    headers, lines = headers_and_lines(spark)
    assert rows(orders.full_outer(headers, lines).na.fill(-1), "order_id", "h_id", "d_id") == [
        (1, 1, 10), (1, 1, 11), (2, 2, -1), (3, -1, 30)]
    assert rows(orders.unmatched_headers(headers, lines), "id") == [(2,)]
    assert rows(orders.unmatched_lines(headers, lines), "id") == [(30,)]


def test_the_lines_create_time_wins_even_if_null(spark):
    headers, lines = headers_and_lines(spark)
    joined = orders.join_order_lines(headers, lines)
    missing = [c for c in ("sku_id", "order_price", "sku_num", "split_total_amount", "split_activity_amount", "split_coupon_amount")]
    joined = joined.select("*", *(F.lit(None).alias(f"d_{c}") for c in missing))
    for c in ("total_amount", "activity_reduce_amount", "coupon_reduce_amount", "original_total_amount", "feight_fee",
              "feight_fee_reduce", "expire_time", "refundable_time", "operate_time", "create_date", "create_hour",
              "province_name", "province_area_code", "province_3166_2_code", "province_iso_code", "user_age", "user_gender"):
        joined = joined.withColumn(f"h_{c}", F.lit(None))
    wide = orders.merge_order_wide(joined)
    assert len(wide.columns) == 30
    assert sorted((r.detail_id, r.order_id, r.create_time) for r in wide.collect()) == [
        (10, 1, "2001-01-01 10:05:00"), (11, 1, None)]


def test_a_hot_order_is_split_at_run_time(spark):
    """One order holds most lines: adaptive execution splits its lines over tasks."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        headers = spark.range(200).selectExpr("id", "'2001-01-01 10:00:00' AS create_time")
        lines = spark.range(0, 60_000, numPartitions=8).selectExpr(
            "id", "CASE WHEN id % 3 > 0 THEN 7 ELSE id % 200 END AS order_id", "uuid() AS sku_name")
        for how in ("inner", "left"):
            joined = orders.join_order_lines(headers, lines, how)
            plan = joined.groupBy().agg(F.count("*").alias("n"), F.sum(F.length("d_sku_name")).alias("m"))
            assert [tuple(r) for r in plan.collect()] == [(60_000, 60_000 * 36)]
            assert "skew=true" in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sales(spark, *items):
    """(gender, age, amount) -> order lines of 'red ring'."""
    return spark.createDataFrame([("Red ring", g, a, m, "2001-01-01") for g, a, m in items],
                                 "sku_name string, user_gender string, user_age int, split_total_amount decimal(18,4), create_date string")


def D(x):
    from decimal import Decimal
    return Decimal(x)


def test_age_bands(spark):
    df = sales(spark, *(("F", age, D(1)) for age in (19, 20, 21, 29, 30)), ("F", None, D(100)))
    assert rows(reports.sales_by_age_band(df, "ring"), "pos", "name", "value") == [
        (0, "20岁以下", 1.0), (1, "20岁至29岁", 3.0), (2, "30岁以上", 1.0)]


def test_gender(spark):
    df = sales(spark, ("F", 1, D(1)), ("M", 1, D(2)), ("?", 1, D(4)), (None, 1, D(8)))
    assert rows(reports.sales_by_gender(df, "RED"), "pos", "name", "value") == [(0, "男", 6.0), (1, "女", 1.0)]
    only = sales(spark, ("F", 1, D(1)))
    assert rows(reports.sales_by_gender(only, "red"), "name", "value") == [("女", 1.0), ("男", 0.0)]


def test_no_hits_no_rows(spark):
    df = sales(spark, ("F", 1, D(1)))
    for keyword, day in (("blue", None), ("", None), ("red", "1999-01-01")):
        assert reports.sales_by_gender(df, keyword, day).count() == 0
        assert reports.sales_by_age_band(df, keyword, day).count() == 0
        assert reports.sales_by_field(df, keyword, "user_gender", day).count() == 0


def test_stats_by_item(spark):
    df = sales(spark, ("F", 25, D(1)))
    assert reports.stats_by_item(df, "red", None, "gender").count() == 2
    assert reports.stats_by_item(df, "red", "2001-01-01", "age").count() == 3
    with pytest.raises(ValueError):
        reports.stats_by_item(df, "red", None, "province")


def test_dau_questions_of_one_day(spark):
    dau = spark.createDataFrame([("2024-01-01", "05", "a"), ("2024-01-01", "05", "b"), ("2024-01-02", "07", "a"),
                                 ("2024-01-03", "01", "a")], "dt string, hr string, mid string")
    assert rows(reports.dau_realtime(dau, "2024-01-02"), "series", "hr", "n") == sorted(
        [("total", None, 1), ("today", "07", 1), ("yesterday", "05", 2)], key=lambda r: r[0])
    assert rows(reports.dau_total(dau, "2024-01-01"), "total") == [(2,)]
    assert rows(reports.dau_total(dau, "2030-01-01"), "total") == [(0,)]
    filled = rows(reports.fill_hours(reports.dau_by_hour(dau, "2024-01-01")), "hr", "n")
    assert len(filled) == 24 and ("05", 2) in filled and ("23", 0) in filled


def test_pages_near_and_far(spark):
    random.seed(3)
    items = [(random.choice([i, -i << 20, i << 40, i << 55]),
              f"2001-01-0{random.randint(1, 4)} 0{random.randint(0, 3)}:00:0{random.randint(0, 2)}",
              random.choice(["red ring", "blue ring"])) for i in range(1, 255)]
    items += [(i << 50, "2001-01-02 00:00:00", "red ring") for i in range(300, 330)]
    items += [(900, None, "red ring"), (-7, None, "red ring")]
    wide = spark.createDataFrame(items, "detail_id bigint, create_time string, sku_name string").selectExpr(
        "*", "1 order_price", "'p' province_name", "1 sku_num", "1 total_amount", "20 user_age", "'F' user_gender",
        "split_part(create_time, ' ', 1) create_date").persist()
    ordered = sorted(((i[1] is not None, i[1] or "", i[0]) for i in items if i[2] == "red ring"))
    size = 25
    for page in (1, 3, len(ordered) // size + 1, len(ordered) // size + 2):
        expected = [r[2] for r in ordered[(page - 1) * size:page * size]]
        got = search.detail_page(wide, "red", page=page, page_size=size, near=0 if page > 1 else 100).collect()
        assert sorted(r.detail_id for r in got) == sorted(expected)
        assert all(r.total == len(ordered) and r.sku_name == "<em>red</em> ring" for r in got)
    assert search.detail_page(wide, "red", page=1, page_size=7).count() == 7
    assert search.detail_page(wide, "", page=1).count() == 0
    unknown = wide.withColumn("detail_id", F.when(F.col("detail_id") % 3 > 0, F.col("detail_id")))
    seen = [r for page in range(1, len(ordered) // size + 2)
            for r in search.detail_page(unknown, "red", page=page, page_size=size, near=50).collect()]
    assert len(seen) == len(ordered) and any(r.detail_id is None for r in seen)


def test_a_large_partition_is_written_by_many_tasks(spark, path):
    rows = spark.range(200_000).selectExpr("id k", "uuid() v", "'d1' dt", "id n")
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        keyed.upsert(rows, 0, path, ["k"], ["n"])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    assert len(spark.read.parquet(path).inputFiles()) > 4


def test_visits_against_brute_force(spark):
    random.seed(5)
    made = []
    for i in range(1500):
        mid = "hot" if random.random() < 0.5 else f"m{random.randint(0, 20)}"
        made.append((mid, random.randint(0, 5_000), random.choice([None, "p"]), i, random.choice(["0", "1"]), 3))
    df = spark.createDataFrame(made, "mid string, ts bigint, last_page_id string, seq bigint, is_new string, during_time bigint")
    expected = {}
    by_mid = {}
    for r in sorted(made, key=lambda r: (r[1], r[3])):
        by_mid.setdefault(r[0], []).append(r)
    for visits in by_mid.values():
        for i, r in enumerate(visits):
            opens = i == 0 or r[2] is None
            bounces = opens and (i + 1 == len(visits) or visits[i + 1][2] is None)
            expected[r[3]] = (opens, bounces)
    for slice_ms in (1, 40, 700, 10_000):
        got = {r.seq: (r.opens, r.bounces) for r in traffic.mark_visits(df, ["ts", "seq"], slice_ms).collect()}
        assert got == expected
    stats = {r.is_new: r for r in traffic.visit_stats(df, "is_new", ["ts", "seq"]).collect()}
    for flag in "01":
        own = [r for r in made if r[4] == flag]
        assert (stats[flag].pv, stats[flag].uv) == (len(own), len({r[0] for r in own}))
        assert stats[flag].visits == sum(expected[r[3]][0] for r in own)
        assert stats[flag].bounces == sum(expected[r[3]][1] for r in own)


def test_last_days(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), ("2024-01-03",)], "dt string")
    assert rows(traffic.last_days(df, "dt", "2024-01-02", 2), "dt") == [("2024-01-01",), ("2024-01-02",)]
    assert traffic.last_days(df, "dt", None, 7).count() == 3


DOCS = "id bigint, name string, score double"


def test_documents(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, None, 3.0)], DOCS)
    put = documents.doc_put(base, spark.createDataFrame([(2, "B", 9.0), (4, "d", 4.0)], DOCS))
    assert {r.id: r.name for r in put.collect()} == {1: "a", 2: "B", 3: None, 4: "d"}
    again = documents.doc_put(put, spark.createDataFrame([(2, "B", 9.0)], DOCS))
    assert again.count() == 4
    patch = spark.createDataFrame([(1, "A"), (3, "C"), (8, "no")], "id bigint, name string")
    assert {r.id: (r.name, r.score) for r in documents.doc_update(base, patch).collect()} == {
        1: ("A", 1.0), 2: ("b", 2.0), 3: ("C", 3.0)}
    named = documents.doc_update_where(base, documents.term("name", "a"), "name", "it's \"new\"")
    assert {r.id: r.name for r in named.collect()} == {1: "it's \"new\"", 2: "b", 3: None}
    assert rows(documents.doc_delete(base, base.where("id > 1")), "id") == [(1,)]
    twice = documents.doc_append(base).unionByName(documents.doc_append(base))
    assert twice.select("doc_id").distinct().count() == 6
    assert base.where(documents.bool_query(filters=[documents.in_range("score", 2, 3)],
                                           must=[documents.term("name", "b")])).count() == 1
    assert base.where(documents.in_range("score")).count() == 3
    assert base.where(documents.bool_query()).count() == 3


def test_a_repeated_actor_counts_once_per_document(spark):
    movies = spark.createDataFrame(
        [(1, 4.0, [("x",), ("x",), ("y",)]), (2, 8.0, [("x",)]), (3, 1.0, []), (4, 1.0, None)],
        "id bigint, score double, actors array<struct<name:string>>")
    best = documents.avg_by_actor(movies).collect()
    assert [(r.name, r.doc_count, r.avg_score) for r in best] == [("x", 2, 6.0), ("y", 1, 4.0)]
    assert [r.name for r in documents.avg_by_actor(movies, 1).collect()] == ["x"]


LAYOUT = [("k", "BIGINT"), ("v", "STRING"), ("dt", "STRING")]


def test_keyed_table(spark, path):
    def batch(*items):
        return spark.createDataFrame(list(items), "k bigint, v string, dt string, n int")

    def current(where=path):
        return rows(keyed.read_latest(spark, where, LAYOUT, ["k"]), "dt", "k", "v")

    assert current() == []
    keyed.upsert(batch((1, "a", "d1", 1), (1, "b", "d1", 2), (2, "c", "d1", 1), (1, "z", "d2", 1)), 0, path, ["k"], ["n"])
    first = [("d1", 1, "b"), ("d1", 2, "c"), ("d2", 1, "z")]
    assert current() == first
    for _ in range(2):
        keyed.upsert(batch((2, "C", "d1", 1), (3, "n", "d3", 1)), 1, path, ["k"], ["n"])
        assert current() == [("d1", 1, "b"), ("d1", 2, "C"), ("d2", 1, "z"), ("d3", 3, "n")]
    keyed.compact(spark, path, f"{path}-compact", LAYOUT, ["k"])
    assert current(f"{path}-compact") == current()
    assert keyed.layers(spark, f"{path}-compact", LAYOUT).count() == 4
    keyed.upsert(batch((1, "q", "d1", 1)), 2, f"{path}-compact", ["k"], ["n"])
    assert ("d1", 1, "q") in current(f"{path}-compact")
    only = keyed.read_latest(spark, path, LAYOUT, ["k"], within=lambda t: t.where("dt = 'd3'"))
    assert "PartitionFilters: [isnotnull(dt" in only._jdf.queryExecution().executedPlan().toString()
    assert rows(only, "k") == [(3,)]


def test_missing_table_is_empty(spark, path):
    assert read_or_empty(spark, f"{path}/none", "a int").count() == 0


def test_scratch_folder(spark):
    from tidemart.session import scratch_dir

    class Session:
        def __init__(self, master, folder):
            self.conf = {"spark.checkpoint.dir": folder} if folder else {}
            self.sparkContext = type("Context", (), {"master": master})

    assert scratch_dir(Session("yarn", "hdfs:///shared/"), "x").startswith("hdfs:///shared/x-")
    with pytest.raises(ValueError):
        scratch_dir(Session("yarn", None), "x")
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")
