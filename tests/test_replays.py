"""Replays that are to grow with their input: topics, archives, batches."""

import glob
import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemart.plans import stream_plans
from tidemart.session import FREE_SHUFFLES
from tidemart.sinks import topics as sinks
from tidemart.sources import archive, topics
from tidemart.streaming import jobs


@pytest.mark.parametrize("files", ["2", "64"])
def test_topics_are_whole_whether_or_not_all_files_are_open(spark, path, monkeypatch, files):
    monkeypatch.setattr(sinks, "OPEN_FILES", {**sinks.OPEN_FILES, "spark.sql.maxConcurrentOutputFileWriters": files})
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    rows = [(f"t{i * 7 % 5}", f"v{i}") for i in range(500)]
    sinks.file_sink(f"{path}/topics")(spark.createDataFrame(rows, "topic STRING, value STRING"), 3)
    found = spark.read.schema("value STRING, topic STRING, batch_id BIGINT").text(f"{path}/topics")
    assert sorted((r.topic, r.value, r.batch_id) for r in found.collect()) == sorted((t, v, 3) for t, v in rows)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


def test_sent_topics_are_compressed_and_whole(spark, path):
    rows = spark.range(300).select("id", F.lit("x").alias("name"))
    stream_plans._send(rows, "t", path)
    assert all(f.endswith(".gz") for f in glob.glob(f"{path}/topic=t/*/part-*"))
    found = spark.read.schema("value STRING, topic STRING, batch_id BIGINT").text(path)
    assert sorted(r.id for r in found.select(F.get_json_object("value", "$.id").cast("int").alias("id")).collect()) == list(range(300))


def test_stored_topics_are_compressed_and_whole(spark, path, monkeypatch):
    """Only new rows of the tables that are asked for; their files are a small part of the messages."""
    from tidemart import schemas as S
    kinds = ["insert", "update", "bootstrap-insert", "delete"]
    changes = [(i, json.dumps({"type": kinds[i % 4], "table": ("order_info", "order_detail")[i % 3 == 0],
                               "data": {"id": i, "order_id": i // 2, "create_time": "2001-01-01 10:00:00"}})) for i in range(600)]
    monkeypatch.setattr(stream_plans.I.D, "change_log", lambda *_: spark.createDataFrame(changes, "seq BIGINT, value STRING"))
    monkeypatch.setattr(stream_plans.I, "scratch_dir", lambda *_: path)
    assert stream_plans.I.stored_topics(spark, "", "order_info", "order_detail") == path
    files = glob.glob(f"{path}/topic=*/*/part-*")
    assert files and all(f.endswith(".gz") for f in files)
    for table, is_line in (("order_info", False), ("order_detail", True)):
        found = stream_plans.I.inserted(spark, path, table, S.ORDER_LINE if is_line else S.ORDER_HEADER)
        assert sorted(r.id for r in found.collect()) == [i for i in range(600) if i % 2 == 0 and (i % 3 == 0) == is_line]


def test_an_archive_is_read_a_few_messages_at_a_time(path, monkeypatch):
    """Stretches lie across row groups and files; no batch is larger than stated."""
    monkeypatch.setattr(archive, "ROWS", 4)
    for name, start in (("a", 0), ("b", 50)):
        pq.write_table(pa.table({"offset": pa.array(range(start, start + 50), pa.int64()), "value": [f"m{i}" for i in range(start, start + 50)]}),
                       _made(f"{path}/partition=0/{name}.parquet"), row_group_size=20)
    pq.write_table(pa.table({"offset": pa.array(range(9), pa.int64()), "value": ["other"] * 9}), _made(f"{path}/partition=1/c.parquet"))
    batches = list(archive._Reader(path, {}).read(archive.Stretch(0, 17, 63)))
    assert max(b.num_rows for b in batches) <= 4
    assert [(r["partition"], r["offset"], r["value"]) for b in batches for r in b.to_pylist()] == [(0, i, f"m{i}") for i in range(17, 63)]


def _made(file: str) -> str:
    import os
    os.makedirs(os.path.dirname(file), exist_ok=True)
    return file


def test_a_stream_takes_so_many_bytes_a_batch(spark, path):
    spark.range(4000).repartition(8).write.parquet(f"{path}/in")
    stream = topics.parquet_stream(spark, f"{path}/in", "id BIGINT", max_bytes=1)
    query = jobs.start(stream, lambda rows, n: rows.write.mode("append").parquet(f"{path}/out"), f"{path}/checkpoint", every=None)
    assert jobs.run_to_end(query) >= 8
    assert sorted(r.id for r in spark.read.parquet(f"{path}/out").collect()) == list(range(4000))


def test_a_router_keeps_messages_only_to_set_them_aside(spark, path, monkeypatch):
    raw = spark.readStream.schema("seq BIGINT, value STRING").parquet(_made(f"{path}/in/x").rsplit("/", 1)[0])
    kept = []
    monkeypatch.setattr(jobs, "start", lambda stream, *a, **k: kept.append(stream.columns))
    for bad in (None, f"{path}/bad"):
        jobs.change_router(raw, None, None, None, f"{path}/dims", f"{path}/checkpoint", "live", bad)
    assert "value" not in kept[0] and "value" in kept[1]


def test_a_batch_frees_what_it_shuffles_and_leaves_the_settings(spark, path):
    key, seen = next(iter(FREE_SHUFFLES)), []
    before = spark.conf.get(key)
    spark.range(10).write.parquet(f"{path}/in")
    query = jobs.start(topics.parquet_stream(spark, f"{path}/in", "id BIGINT"),
                       lambda rows, n: seen.append(rows.sparkSession.conf.get(key)), f"{path}/checkpoint", every=None)
    jobs.run_to_end(query)
    assert seen and set(seen) == {"true"} and spark.conf.get(key) == before


def test_pages_of_a_replay_are_made_once(spark, path, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def counted(i):
        made.add(1)
        return i

    from tidemart import schemas as S
    rows = spark.range(40).select(*(counted("id").alias(c) if c == "ts" else F.lit(None).cast(kind).alias(c) for c, kind in S.PAGE_LOG))
    monkeypatch.setattr(stream_plans.I, "pages", lambda *_: rows)
    parts = []
    assert stream_plans._replay_in_turn(spark, "", path, lambda pages: parts.append(pages) or 1) == stream_plans.BATCHES
    assert made.value == 40
    sent = spark.read.schema("value STRING, topic STRING, batch_id BIGINT").text(f"{path}/topics")
    assert sorted(r.ts for r in sent.select(F.get_json_object("value", "$.ts").cast("int").alias("ts")).collect()) == list(range(40))


@pytest.mark.parametrize("first", [0, 1])
def test_changes_of_a_replay_are_made_once(spark, path, monkeypatch, first):
    """Every third row comes first, when the lists lack a table; without such rows the first start finds nothing."""
    made, ids = spark.sparkContext.accumulator(0), [i for i in range(90) if first == 0 or i % 3]
    tables = ["order_info", "order_detail", "user_info", "base_province"]

    @F.udf("string")
    def message(i):
        made.add(1)
        return json.dumps({"type": "insert", "table": tables[i // 3 % 4], "data": {"id": i}})
    log = spark.createDataFrame([(i,) for i in ids], "id BIGINT").select(F.col("id").alias("seq"), message("id").alias("value"))
    monkeypatch.setattr(stream_plans.D, "change_log", lambda *_: log)
    monkeypatch.setattr(stream_plans, "scratch_dir", lambda *_: path)
    targets = {"order_info": "DWD_ORDER_INFO_I_live", "order_detail": "DWD_ORDER_DETAIL_I_live"}
    wanted = [(targets.get(t, t), i) for i in ids for t in [tables[i // 3 % 4]]
              if i % 3 or t not in ("order_detail", "base_province")]
    found = stream_plans.dynamic_table_list(spark, "").collect()
    assert sorted((r.target, r.id) for r in found) == sorted(wanted) and made.value == len(ids)
