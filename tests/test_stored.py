"""Stored documents, look-ups by key, bucketed orders, sketches of frequent values."""

import os

import pytest
from pyspark.sql import functions as F

from tidemart.operators import heavy_hitters, orders, search
from tidemart.session import settings
from tidemart.sinks import bucketed
from tidemart.sinks.documents import Documents
from tidemart.sources import tables

DOCS = "id BIGINT, name STRING, score DOUBLE, dt STRING"


def files_of(path, day):
    return {(f, os.stat(f"{d}/{f}").st_mtime_ns) for d, _, names in os.walk(f"{path}/dt={day}") for f in names}


def test_documents_by_layers(spark, path):
    def doc(i, name, score=1.0, day="d1"):
        return (i, name, score, day)

    def now():
        # A new object each time: nothing but what is stored is known.
        return {r.id: (r.name, r.score, r.dt) for r in Documents(spark, path, DOCS).current().collect()}

    store = Documents(spark, path, DOCS)
    assert now() == {}
    for _ in range(2):
        store.put(spark.createDataFrame([doc(1, "a"), doc(2, "b"), doc(3, "c", 3.0, "d2"), doc(4, None, None, "d2")], DOCS), 0)
    untouched = files_of(path, "d1")
    for _ in range(2):
        store.patch(spark.createDataFrame([(3, "C", None), (9, "no", 1.0)], "id BIGINT, name STRING, score DOUBLE"), 1)
    assert files_of(path, "d1") == untouched
    assert now() == {1: ("a", 1.0, "d1"), 2: ("b", 1.0, "d1"), 3: ("C", 3.0, "d2"), 4: (None, None, "d2")}
    for _ in range(2):
        store.delete(spark.createDataFrame([(2,), (2,), (7,)], "id BIGINT"), 2)
    store.patch(spark.createDataFrame([(2, "late")], "id BIGINT, name STRING"), 3)
    assert 2 not in now()
    for _ in range(2):  # on a second run the condition no longer holds for what the first one changed
        store.patch_where(F.col("name") == "a", "name", "A", 4)
    assert now()[1] == ("A", 1.0, "d1")
    store.patch_where(F.col("id") == 1, "score", None, 5)
    store.put(spark.createDataFrame([doc(2, "back"), doc(2, "again")], DOCS), 6, ["name"])
    assert now() == {1: ("A", None, "d1"), 2: ("back", 1.0, "d1"), 3: ("C", 3.0, "d2"), 4: (None, None, "d2")}
    # A write in between that comes again changes nothing that came after it.
    store.put(spark.createDataFrame([doc(1, "a"), doc(2, "b"), doc(3, "c", 3.0, "d2"), doc(4, None, None, "d2")], DOCS), 0)
    assert now()[1] == ("A", None, "d1") and now()[2][0] == "back"


def test_appended_documents_are_new_ones(spark, path):
    store = Documents(spark, path, "id STRING, name STRING, dt STRING")
    docs = spark.createDataFrame([("a", "d1"), ("a", "d1"), ("b", "d2")], "name STRING, dt STRING")
    for batch_id in (0, 1, 1):
        store.append(docs, batch_id)
    ids = [r.id for r in store.current().collect()]
    assert len(ids) == 6 == len(set(ids))


def scanned(df):
    """Rows that the scans of a query read."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


def test_look_ups_read_few_row_groups(spark, path):
    docs = spark.range(64_000).select(((F.col("id") * 7919) % 64_000).alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("code"))
    tables.write_by_key(docs, f"{path}/id", "id", 64)
    stored = spark.read.parquet(f"{path}/id")
    assert len(stored.inputFiles()) == 64
    found = tables.get_by_id(stored, 777)
    assert found.count() == 1 and scanned(found) <= 2 * 64_000 // 50
    # Values in no order in the files: only the filters tell row groups apart.
    (docs.repartition(64).write.option("parquet.bloom.filter.enabled#code", "true")
     .option("parquet.bloom.filter.expected.ndv#code", "2000").parquet(f"{path}/code"))
    code = docs.where("id = 5").first().code
    by_code = spark.read.parquet(f"{path}/code").where(F.col("code") == code)
    assert by_code.count() == 1 and scanned(by_code) <= 4 * 64_000 // 50



@pytest.mark.parametrize("hot", [False, True])
def test_bucketed_orders_join_where_they_lie(spark, path, hot):
    from tidemart import schemas as S
    kinds = dict(S.ORDER_WIDE)
    header_columns = [c for c in S.names(S.ORDER_WIDE) if c not in S.names(S.ORDER_LINE) and c not in ("detail_id", "order_id")]
    headers = spark.range(200).select("id", *(F.lit(None).cast(kinds[c]).alias(c) for c in header_columns))
    lines = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 250).cast("bigint").alias("order_id"), *(
        F.lit(None).cast(kind).alias(c) for c, kind in S.ORDER_LINE if c not in ("id", "order_id")))
    stored = bucketed.store(headers, lines, path, 4, 0.1, 100 if hot else 100_000)
    assert stored.hot_ids == ([5] if hot else [])
    expected = sorted((r.order_id, r.detail_id) for r in orders.order_wide(headers, lines).collect())
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        wide = stored.wide()
        assert sorted((r.order_id, r.detail_id) for r in wide.collect()) == expected
        plan = orders.order_wide(stored.headers, stored.lines)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert stored.hot_lines.count() == (1000 + 8 if hot else 0)


def counts_of(values):
    found = {}
    for v in values:
        if v is not None:
            found[v] = found.get(v, 0) + 1
    return sorted(((v, n) for v, n in found.items()), key=lambda r: (-r[1], r[0]))


@pytest.mark.parametrize("kind", ["skewed", "even", "tied", "few", "none"])
def test_top_values_are_exact(spark, kind):
    """Whether the sketch's bound settles it (a few frequent values) or not (many of one frequency, ties at the end)."""
    values = {"skewed": [f"h{i % 5 if i % 11 else 6}" for i in range(8000)] + [f"r{i}" for i in range(2000)],
              "even": [f"v{i % 3000}" for i in range(9000)], "tied": [f"v{i % 40}" for i in range(4000)],
              "few": ["a", "b", None, "a"], "none": [None]}[kind]
    df = spark.createDataFrame([(v, f"d{i % 5}") for i, v in enumerate(values)], "v STRING, dt STRING").repartition(3)
    sketches = heavy_hitters.day_sketches(df, "dt", "v", 64)
    got = [tuple(r) for r in heavy_hitters.top_values(df, sketches, "v", 5, 64, 3).collect()]
    assert sorted(got) == sorted(counts_of(values)[:5])
    named, others = heavy_hitters.candidates(sketches, 5, 64, 3)
    exact = dict(counts_of(values))
    assert all(n <= others for v, n in exact.items() if v not in named)
    settled = len(got) == 5 and min((n for _, n in got), default=0) > others
    assert settled == (kind == "skewed")


def test_near_and_far_pages_are_the_same(spark):
    hits = spark.createDataFrame([(i % 7, i) for i in range(200)] + [(3, None), (None, 5), (3, None)], "a INT, b INT")
    for first, size in ((0, 10), (95, 10), (198, 10), (300, 5)):
        near, far = (sorted(map(str, search.page_rows(hits, ["a", "b"], first, size, near=n).collect())) for n in (10_000, 0))
        assert near == far
