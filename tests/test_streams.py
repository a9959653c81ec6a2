"""Streams: late and early partners, replays, restarts; files are fed one at a time."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidemart import schemas as S
from tidemart.functions.scalars import event_time
from tidemart.operators import dedup, device_state, orders, reports, traffic, visitor_sets
from tidemart.session import settings
from tidemart.sinks import keyed
from tidemart.sinks.topics import file_sink
from tidemart.sources import decode, topics
from tidemart.streaming import accounts, jobs

DAY = 86_400_000


class Feed:
    """A topic folder; each ``put`` adds one file, newer than those before."""

    def __init__(self, folder):
        self.folder, self.n = folder, 0
        os.makedirs(folder, exist_ok=True)

    def put(self, *records):
        self.n += 1
        name = f"{self.folder}/{self.n:04d}.txt"
        with open(name, "w") as f:
            f.writelines((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records)
        os.utime(name, (1_000_000_000 + self.n, 1_000_000_000 + self.n))


def run(stream, path, mode="append"):
    """All of a stream's output so far; the query goes on where it left off."""
    accounts.keep(stream.sparkSession)
    jobs.run_to_end(stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out")
                    .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(), 300)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def header(i, time, user=1):
    return {"id": i, "user_id": user, "province_id": 1, "create_time": time}


def line(i, order, time):
    return {"id": i, "order_id": order, "sku_name": "n", "create_time": time}


def order_streams(spark, path):
    feeds = Feed(f"{path}/headers"), Feed(f"{path}/lines")
    headers = decode.parse_typed(topics.file_topic(spark, feeds[0].folder, 1), S.ORDER_HEADER)
    lines = decode.parse_typed(topics.file_topic(spark, feeds[1].folder, 1), S.ORDER_LINE)
    return *feeds, headers, lines


def pairs(df):
    return sorted((r.h_id, r.d_id) for r in df.collect())


def test_partners_meet_in_either_order_across_restarts(spark, path):
    hf, lf, headers, lines = order_streams(spark, path)
    joined = orders.join_order_streams(headers, lines)
    hf.put(header(1, "2001-01-01 10:00:00"))
    lf.put(line(20, 2, "2001-01-01 10:05:00"), line(21, 2, "2001-01-01 10:06:00"))
    assert pairs(run(joined, path)) == []
    hf.put(header(2, "2001-01-01 20:00:00"))
    lf.put(line(10, 1, "2001-01-02 08:00:00"))
    assert pairs(run(joined, path)) == [(1, 10), (2, 20), (2, 21)]
    lf.put(line(11, 1, "2001-01-02 08:00:00"))
    assert pairs(run(joined, path)) == [(1, 10), (1, 11), (2, 20), (2, 21)]


def test_a_partner_late_by_its_own_time_is_matched(spark, path):
    hf, lf, headers, lines = order_streams(spark, path)
    joined = orders.join_order_streams(headers, lines)
    hf.put(header(1, "2001-01-01 10:00:00"))
    lf.put(line(90, 9, "2001-01-01 10:00:00"))
    run(joined, path)
    for day in ("05", "06", "07"):
        hf.put(header(int(day), f"2001-01-{day} 10:00:00"))
        lf.put(line(int(day), 99, f"2001-01-{day} 10:00:00"))
        run(joined, path)
    lf.put(line(10, 1, "2001-01-01 11:00:00"), line(11, 1, None), line(12, 1, "no time"))
    hf.put(header(9, None), header(50, "2001-01-08 00:00:00"))
    assert pairs(run(joined, path)) == [(1, 10), (1, 11), (1, 12), (9, 90)]


def test_rows_behind_given_arrival_times_are_reported(spark, path):
    hf, lf, headers, lines = order_streams(spark, path)
    when = event_time(F.col("create_time"))
    joined = orders.join_order_streams(headers, lines, header_at=when, line_at=when)
    for day in ("05", "09", "01", "02"):
        hf.put(header(int(day), f"2001-01-{day} 10:00:00"))
        lf.put(line(int(day), int(day), f"2001-01-{day} 10:00:00"))
    with pytest.raises(RuntimeError, match="behind the watermark"):
        run(joined, path)


@pytest.mark.parametrize("salts", [1, 3])
def test_one_job_gives_wide_rows_and_orphans_of_both_sides(spark, path, salts):
    hf, lf, headers, lines = order_streams(spark, path)
    stored_dims(spark, f"{path}/dims")
    when = event_time(F.col("create_time"))

    def job():
        jobs.run_to_end(jobs.order_job(
            headers, lines, f"{path}/dims", f"{path}/wide", f"{path}/cp", F.lit("2001-01-01").cast("date"), salts=salts,
            line_orphans=f"{path}/alone/lines", header_orphans=f"{path}/alone/headers", header_at=when, line_at=when,
            late="1 second", every=None), 300)
        return [sorted(r.id for r in keyed.layers(spark, f"{path}/alone/{side}", layout).collect())
                for side, layout in (("headers", jobs.HEADER_ORPHANS), ("lines", jobs.LINE_ORPHANS))]

    hf.put(header(1, "2001-01-01 10:00:00"), header(2, "2001-01-01 10:00:00"), header(4, "2001-01-01 10:00:00"))
    lf.put(*(line(i, 1, "2001-01-01 10:00:00") for i in range(10, 30)), line(30, 3, "2001-01-01 10:00:00"))
    assert job() == [[], []]
    lf.put(line(40, 4, "2001-01-02 09:00:00"))
    hf.put(header(5, "2001-01-02 09:00:00"))
    assert job() == [[], []]
    for day in ("05", "09", "13", "17"):
        hf.put(header(int(day) * 100, f"2001-01-{day} 10:00:00"))
        lf.put(line(int(day) * 1000, int(day) * 100, f"2001-01-{day} 10:00:00"))
    assert job() == [[2, 5], [30]]
    wide = keyed.read_latest(spark, f"{path}/wide", jobs.ORDER_WIDE_STORED, ["order_id", "detail_id"])
    assert sorted((r.order_id, r.detail_id) for r in wide.where("order_id < 10").collect()) == [
        *((1, i) for i in range(10, 30)), (4, 40)]


def test_either_side_of_orders_is_in_the_state_once(spark, path):
    """Against a join for wide rows and lines alone, and another one for headers alone."""
    hf, lf, headers, lines = order_streams(spark, path)
    hf.put(*(header(i, "2001-01-01 10:00:00") for i in range(100)))
    lf.put(*(line(i, i % 120, "2001-01-01 10:00:00") for i in range(500)))

    def held(stream, name):
        query = jobs.start(stream, lambda rows, i: rows.count(), f"{path}/{name}", every=None)
        jobs.run_to_end(query, 300)
        return max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])
    one = held(orders.join_order_streams(headers, lines, how="full_outer"), "one")
    other = held(orders.join_order_streams(headers, lines, how="left_outer"), "two")
    assert one == other == 600  # a second join for headers alone would hold as many again


def test_accounts_of_more_batches_than_a_query_remembers(spark, path):
    """A row that is late in an early batch is known when the query itself has forgotten it."""
    feed = Feed(f"{path}/pages")
    _, at = arriving(spark, feed)
    for number in range(12):
        feed.put(at_hour(f"m{number}", 0 if number == 3 else 100 + number))
    stream = dedup.dau_dedup_stream(
        decode.parse_typed(topics.file_topic(spark, feed.folder, 1), S.PAGE_LOG), "1 hour", salts=1, at=at)
    with settings(spark, {"spark.sql.shuffle.partitions": "1", "spark.sql.streaming.numRecentProgressUpdates": "3"}):
        query = jobs.start(stream, lambda rows, i: rows.count(), f"{path}/cp", every=None, keep=False)
    with pytest.raises(RuntimeError, match="1 rows came behind the watermark"):
        jobs.run_to_end(query, 300)
    assert accounts.account(query).batches >= 12 and len(query.recentProgress) == 3


def test_messages_read_are_used_or_set_aside(spark, path):
    feed = Feed(f"{path}/logs")
    feed.put({"common": {"mid": "a"}, "page": {"page_id": "p", "during_time": "1"}, "ts": 1}, '{"cut')
    feed.put({"common": {"mid": "a"}, "page": {"page_id": "p", "during_time": "x"}, "ts": 1}, {"err": {"c": 1}})
    query = jobs.log_router(topics.file_topic(spark, feed.folder, 1), file_sink(f"{path}/topics"), f"{path}/cp", "t",
                            f"{path}/bad", every=None)
    jobs.run_to_end(query, 300)
    account = accounts.account(query)
    assert (account.read, account.used, account.set_aside, account.wrong_batch) == (4, 2, 2, None)
    lost = accounts.judged(decode.parse_log(accounts.read(topics.file_topic(spark, feed.folder, 1))).where("ts = 1"))
    # The filter stands between reading and judging: rows go missing.
    query = jobs.start(lost, lambda rows, i: rows.count(), f"{path}/cp2", every=None)
    with pytest.raises(RuntimeError, match="neither used nor set aside"):
        jobs.run_to_end(query, 300)


def page(mid, ts, last=None):
    return {"mid": mid, "ts": ts, "last_page_id": last, "user_id": "1", "province_id": "1", "during_time": 1}


def test_device_once_a_day_with_yesterday_late(spark, path):
    feed = Feed(f"{path}/pages")
    pages = decode.parse_typed(topics.file_topic(spark, feed.folder, 1), S.PAGE_LOG)
    first = dedup.dau_dedup_stream(dedup.session_first_page(pages))
    feed.put(page("a", 10 * DAY + 5), page("a", 10 * DAY + 6), page("b", 10 * DAY + 7, "home"))
    feed.put(page("a", 10 * DAY + 99), page("c", 9 * DAY + 99))
    feed.put(page("b", 11 * DAY - 1), *(page("a", 9 * DAY + i) for i in range(30)))
    got = sorted((r.mid, r.day_ts.day) for r in run(first, path).collect())
    assert got == [("a", 10), ("a", 11), ("b", 11), ("c", 10)]
    feed.put(page("a", 10 * DAY + 100))
    assert run(first, path).count() == 4


def user(i, gender, birthday="1990-01-01"):
    return {"id": i, "gender": gender, "birthday": birthday}


def province(i):
    return {"id": i, "name": f"p{i}", "area_code": "1", "iso_code": "2", "iso_3166_2": "3"}


def change(kind, table, data):
    return {"type": kind, "table": table, "data": data}


def raw_changes(spark, folder):
    # The line number in the file stands in for the offset of a message.
    return topics.file_topic(spark, folder, 1).withColumn("seq", F.get_json_object("value", "$.data.seq").cast("bigint"))


def test_changes_to_wide_orders(spark, path):
    """Change router, dimension table, both topics, join, lookups, upsert: end to end, in three goes."""
    feed = Feed(f"{path}/changes")
    lists = {"fact": ["order_info", "order_detail"], "dim": ["user_info"]}

    def listed(which):
        return lambda s: s.createDataFrame([(n,) for n in lists[which]], "table string")

    def route():
        jobs.run_to_end(jobs.change_router(
            raw_changes(spark, feed.folder), listed("fact"), listed("dim"), file_sink(f"{path}/topics"),
            f"{path}/dims", f"{path}/cp1", "t", every=None), 300)

    def join():
        folder = f"{path}/topics/topic=DWD_"
        for name in ("ORDER_INFO", "ORDER_DETAIL"):
            os.makedirs(f"{folder}{name}_I_t", exist_ok=True)
        headers = decode.parse_typed(topics.file_topic(spark, f"{folder}ORDER_INFO_I_t"), S.ORDER_HEADER)
        lines = decode.parse_typed(topics.file_topic(spark, f"{folder}ORDER_DETAIL_I_t"), S.ORDER_LINE)
        jobs.run_to_end(jobs.order_job(headers, lines, f"{path}/dims", f"{path}/wide", f"{path}/cp2",
                                       F.lit("2001-01-01").cast("date"), every=None), 300)
        wide = keyed.read_latest(spark, f"{path}/wide", jobs.ORDER_WIDE_STORED, ["order_id", "detail_id"])
        return sorted((r.order_id, r.detail_id, r.user_gender, r.user_age, r.province_name) for r in wide.collect())

    feed.put(change("insert", "user_info", {**user(1, "F"), "seq": 1}),
             change("update", "user_info", {**user(1, "M"), "seq": 2}),
             change("insert", "base_province", {**province(1), "seq": 3}),
             change("insert", "order_info", header(1, "2001-01-01 10:00:00")),
             change("update", "order_info", header(5, "2001-01-01 10:00:00")))
    route()
    assert join() == []
    # The lists are looked up for every batch: provinces count from here on.
    lists["dim"].append("base_province")
    feed.put(change("bootstrap-insert", "base_province", {**province(1), "seq": 4}),
             change("insert", "order_detail", line(10, 1, "2001-01-01 10:01:00")))
    route()
    assert join() == [(1, 10, "M", 11, "p1")]
    feed.put(change("insert", "order_detail", line(20, 2, "2001-01-01 10:01:00")),
             change("insert", "order_detail", line(11, 1, "2001-01-01 10:01:00")),
             change("delete", "user_info", {**user(1, "M"), "seq": 9}))
    feed.put(change("insert", "order_info", header(2, "2001-01-01 09:00:00", user=77)))
    route()
    assert join() == [(1, 10, "M", 11, "p1"), (1, 11, "M", 11, "p1"), (2, 20, None, None, "p1")]
    dims = keyed.read_latest(spark, f"{path}/dims", jobs.DIM_LAYOUT, ["id"], "table")
    assert sorted((r.key, r.is_deleted) for r in dims.collect()) == [
        ("DIM:BASE_PROVINCE:1", False), ("DIM:USER_INFO:1", True)]


def stored_dims(spark, path):
    rows = [("user_info", 1, "k", "I", json.dumps(user(1, "F")), 1), ("base_province", 1, "k", "I", json.dumps(province(1)), 1)]
    jobs.write_dims(spark.createDataFrame(rows, "table string, id bigint, key string, op string, data string, seq bigint"), 0, path)


def test_dau_job_restart_and_recovery(spark, path):
    feed, at = Feed(f"{path}/pages"), 20 * DAY
    stored_dims(spark, f"{path}/dims")

    def job(checkpoint, **how):
        pages = decode.parse_typed(topics.file_topic(spark, feed.folder, 1), S.PAGE_LOG)
        jobs.run_to_end(jobs.dau_job(pages, f"{path}/dims", f"{path}/dau", f"{path}/{checkpoint}",
                                     F.lit("2000-01-01").cast("date"), every=None, **how), 300)
        dau = keyed.read_latest(spark, f"{path}/dau", S.DAU_WIDE, ["mid"])
        return sorted((r.dt, r.mid, r.ts, r.user_gender, r.user_age, r.province_name) for r in dau.collect())

    feed.put(page("a", at + 5), page("a", at + 9, "home"))
    first = [("1970-01-21", "a", at + 5, "F", "10", "p1")]
    assert job("cp") == first
    feed.put(page("a", at + 7), page("b", at + 8))
    both = first + [("1970-01-21", "b", at + 8, "F", "10", "p1")]
    assert job("cp") == both
    # A new checkpoint reads everything again; what is stored stays as it was.
    feed.put(page("c", at + 11))
    layers = keyed.layers(spark, f"{path}/dau", S.DAU_WIDE)
    before = layers.count()
    everything = both + [("1970-01-21", "c", at + 11, "F", "10", "p1")]
    assert job("fresh", recover=True) == everything
    assert keyed.layers(spark, f"{path}/dau", S.DAU_WIDE).count() == before + 1


def test_a_batch_run_again_changes_nothing(spark, path):
    messages = spark.createDataFrame([("A", "1"), ("B", "2")], "topic string, value string")
    sink = file_sink(f"{path}/topics")
    for _ in range(2):
        sink(messages, 4)
    assert spark.read.schema("value string").text(f"{path}/topics").count() == 2
    for _ in range(2):
        stored_dims(spark, f"{path}/dims")
    assert keyed.layers(spark, f"{path}/dims", jobs.DIM_LAYOUT).count() == 2


def test_change_router_sets_bad_records_aside(spark, path):
    feed = Feed(f"{path}/changes")
    feed.put(change("insert", "t", {"id": 1, "seq": 1}), '{"type":"insert","table":"t","data":{"id"',
             {"type": "insert", "table": "t"}, change("insert", "t", {"no": 1}), change("insert", None, {"id": 1}))

    def listed(s):
        return s.createDataFrame([("t",)], "table string")
    jobs.run_to_end(jobs.change_router(raw_changes(spark, feed.folder), listed, listed, file_sink(f"{path}/topics"),
                                       f"{path}/dims", f"{path}/cp", "s", f"{path}/bad", every=None), 300)
    assert [r.value for r in spark.read.schema("value string").text(f"{path}/topics").collect()] == ['{"id":1,"seq":1}']
    assert [r.id for r in keyed.read_latest(spark, f"{path}/dims", jobs.DIM_LAYOUT, ["id"], "table").collect()] == [1]
    assert sorted(r.reason for r in spark.read.parquet(f"{path}/bad").collect()) == ["bad_json", "data", "id", "table"]


def test_log_router_sets_bad_records_aside(spark, path):
    feed = Feed(f"{path}/logs")
    feed.put({"common": {"mid": "a"}, "page": {"page_id": "p", "during_time": "1"}, "ts": 1}, '{"cut')
    feed.put({"common": {"mid": "a"}, "page": {"page_id": "p", "during_time": "x"}, "ts": 1}, {"err": {"c": 1}})
    jobs.run_to_end(jobs.log_router(topics.file_topic(spark, feed.folder, 1), file_sink(f"{path}/topics"),
                                    f"{path}/cp", "t", f"{path}/bad", every=None), 300)
    routed = spark.read.schema("value string, topic string, batch_id bigint").text(f"{path}/topics")
    assert dict(routed.groupBy("topic").count().collect()) == {"DWD_PAGE_LOG_t": 1, "DWD_ERROR_LOG_t": 1}
    assert sorted(r.reason for r in spark.read.parquet(f"{path}/bad").collect()) == ["bad_json", "during_time"]


def test_a_failing_batch_is_raised_and_run_again(spark, path):
    feed = Feed(f"{path}/in")
    feed.put("x")
    seen = []

    def batch(rows, batch_id):
        seen.append((batch_id, rows.count()))
        if len(seen) == 1:
            raise ValueError("sink is down")

    stream = topics.file_topic(spark, feed.folder)
    with pytest.raises(Exception, match="sink is down"):
        jobs.run_to_end(jobs.start(stream, batch, f"{path}/cp", every=None), 300)
    jobs.run_to_end(jobs.start(stream, batch, f"{path}/cp", every=None), 300)
    assert seen == [(0, 1), (0, 1)]
    jobs.run_to_end(jobs.start(stream, batch, f"{path}/cp", every=None), 300)
    assert len(seen) == 2


def test_batches_of_stateful_streams_are_planned_at_run_time(spark, path):
    feed = Feed(f"{path}/pages")
    pages = decode.parse_typed(topics.file_topic(spark, feed.folder, 1), S.PAGE_LOG)
    first = dedup.dau_dedup_stream(pages)
    feed.put(page("a", 20 * DAY), page("a", 20 * DAY + 1))
    feed.put(page("a", 20 * DAY + 2), page("b", 20 * DAY + 2))
    seen, plans = [], []

    def batch(rows, batch_id):
        counted = rows.groupBy("mid").count()
        seen.extend(r.mid for r in counted.collect())
        plans.append(counted._jdf.queryExecution().executedPlan().toString())

    jobs.run_to_end(jobs.start(first, batch, f"{path}/cp", every=None), 300)
    assert sorted(seen) == ["a", "b"]
    assert all("AdaptiveSparkPlan" in p for p in plans)


def test_continuous_trigger(spark, path):
    feed = Feed(f"{path}/in")
    feed.put("x")
    seen = []
    query = jobs.start(topics.file_topic(spark, feed.folder), lambda rows, i: seen.append(rows.count()), f"{path}/cp",
                       name="loop", every="1 second")
    try:
        query.processAllAvailable()
        feed.put("y", "z")
        query.processAllAvailable()
    finally:
        query.stop()
    assert seen == [1, 2]


def arriving(spark, feed):
    """Pages whose ``during_time`` is the hour in which they arrive, counted from some day."""
    pages = decode.parse_typed(topics.file_topic(spark, feed.folder), S.PAGE_LOG)
    return pages, F.timestamp_seconds(F.col("during_time") * 3600 + 86_400_000)


def at_hour(mid, hour, ts=10 * DAY):
    return {**page(mid, ts), "during_time": hour}


def test_each_use_renews_a_device(spark, path):
    feed = Feed(f"{path}/pages")
    pages, at = arriving(spark, feed)
    first = device_state.dau_renewed_stream(pages, DAY, at=at)

    def count(mid):
        return run(first, path).where(F.col("mid") == mid).count()
    feed.put(at_hour("a", 0), at_hour("a", 3, 10 * DAY + 5), at_hour("b", 0), at_hour(None, 0), at_hour(None, 1))
    assert count("a") == 1
    feed.put(at_hour("a", 20), at_hour("c", 20))  # each start goes on from the checkpoint
    assert count("a") == 1
    feed.put(at_hour("a", 40), at_hour("a", 40, 11 * DAY), at_hour("b", 23))
    assert count("a") == 2  # another day of its own
    feed.put(at_hour("a", 63), at_hour("b", 47, 10 * DAY), at_hour("c", 44))
    assert count("a") == 2 and count("b") == 2 and count("c") == 2  # 24 hours unused are too many
    assert run(first, path).where("mid IS NULL").count() == 1


def test_unused_devices_leave_the_state(spark, path):
    feed = Feed(f"{path}/pages")
    pages, at = arriving(spark, feed)
    first = device_state.dau_renewed_stream(pages, DAY, at=at)
    held = []

    def batch(rows, batch_id):
        rows.count()

    for hour, mids in ((0, "abc"), (20, "a"), (30, "d"), (40, "a"), (60, "a"), (200, "e"), (400, "f")):
        feed.put(*(at_hour(m, hour) for m in mids))
        query = jobs.start(first, batch, f"{path}/cp", every=None)
        jobs.run_to_end(query, 300)
        held.append(max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]))
    # By the end only the last two devices to come are left; a batch takes out what was due before it.
    assert held[:2] == [3, 3] and held[-1] == 2


def test_many_pages_of_a_device_become_one_before_they_are_sent(spark, path):
    feed = Feed(f"{path}/pages")
    pages, at = arriving(spark, feed)
    feed.put(*(at_hour("hot", 1, 10 * DAY + i) for i in range(3000)), at_hour("x", 1))
    first = device_state.dau_renewed_stream(pages, DAY, at=at)
    sent = []
    query = jobs.start(first, lambda rows, i: sent.append(sorted((r.mid, r.ts - 10 * DAY) for r in rows.collect())), f"{path}/cp",
                       every=None)
    jobs.run_to_end(query, 300)
    assert sent[0] == [("hot", 0), ("x", 0)]
    assert query.recentProgress[0]["stateOperators"][0]["numRowsUpdated"] <= 6


def test_hour_counts_do_not_depend_on_the_order_of_pages(spark, path):
    feed = Feed(f"{path}/pages")
    hour = 3_600_000

    def counts():
        pages = decode.parse_typed(topics.file_topic(spark, feed.folder, 1), S.PAGE_LOG)
        jobs.run_to_end(jobs.hour_changes_job(pages, f"{path}/changes", f"{path}/cp1", every=None), 300)
        jobs.run_to_end(jobs.hour_counts_job(spark, f"{path}/changes", f"{path}/counts", f"{path}/cp2", every=None), 300)
        return sorted((r.dt, r.hr, r.n) for r in jobs.read_hours(spark, f"{path}/counts").collect())

    feed.put(page("a", 20 * DAY + 5 * hour), page("b", 20 * DAY + 5 * hour), page("c", 20 * DAY + 9 * hour, "home"))
    assert counts() == [("1970-01-21", "05", 2)]
    feed.put(page("a", 20 * DAY + 7 * hour), page("a", 21 * DAY), page("d", 20 * DAY + 23 * hour))
    assert counts() == [("1970-01-21", "05", 2), ("1970-01-21", "23", 1), ("1970-01-22", "00", 1)]
    feed.put(page("a", 20 * DAY + 2 * hour), page("b", 20 * DAY + 2 * hour + 1))  # earlier ones come last
    feed.put(page("b", 20 * DAY + hour), page("z", None))
    both = [("1970-01-21", "01", 1), ("1970-01-21", "02", 1), ("1970-01-21", "23", 1), ("1970-01-22", "00", 1)]
    assert counts() == both
    assert counts() == both  # nothing new
    rows = jobs.read_hours(spark, f"{path}/counts")
    live = {(r.series, r.hr): r.n for r in reports.realtime_of_hours(rows, "1970-01-22").collect()}
    assert live == {("total", None): 1, ("today", "00"): 1, ("yesterday", "01"): 1, ("yesterday", "02"): 1, ("yesterday", "23"): 1}


def test_visitor_sets_answer_ranges_like_the_pages(spark, path):
    """Over several batches, one of them run twice, and a device numbered in an earlier batch."""
    steps = {"home": "p0", "detail": "p1"}
    sets = visitor_sets.visit_sets(steps)
    rows = [(f"m{i % 13}" if i % 11 else None, f"u{i % 7}" if i % 5 else None, f"p{i % 3}", str(i % 2), (20 + i % 6) * DAY + i)
            for i in range(400)] + [("m1", "u1", "p0", "1", None)]
    pages = spark.createDataFrame(rows, "mid STRING, user_id STRING, page_id STRING, is_new STRING, ts BIGINT")
    for batch_id in (0, 1, 1, 2):
        visitor_sets.store(pages.where(F.coalesce(F.col("ts") % 3, F.lit(0)) == batch_id), batch_id, path, sets)
    numbers = visitor_sets.numbers(spark, path)
    for subject, n in (("mid", 13), ("user_id", 7)):
        assert sorted(r.number for r in numbers.where(F.col("subject") == subject).collect()) == list(range(1, n + 1))
    stored, views = visitor_sets.stored_sets(spark, path), visitor_sets.stored_views(spark, path)
    timed = pages.where("ts IS NOT NULL")
    same = sorted(map(tuple, traffic.uv_by_day(timed).collect()))
    assert sorted(map(tuple, visitor_sets.uv_by_day(stored).collect())) == same and len(same) == 6
    for until, days in ((None, None), ("1970-01-24", 1), ("1970-01-25", 3), ("1999-01-01", 30)):
        for got, wanted in (
                (visitor_sets.visit_total(stored, views, until, days), traffic.visit_total(timed, until, days)),
                (visitor_sets.action_funnel(stored, steps, until, days), traffic.action_funnel(timed, steps, until, days))):
            assert got.columns == wanted.columns and list(map(tuple, got.collect())) == list(map(tuple, wanted.collect()))
    plan = visitor_sets.visit_total(stored, views, "1970-01-24", 3)._jdf.queryExecution().toString()
    assert "/sets" in plan and "PartitionFilters: [isnotnull(dt" in plan and "mid" not in plan
    assert visitor_sets.visit_total(stored.limit(0), views.limit(0)).collect()[0][:] == (0, 0, 0)


def test_numbers_do_not_need_one_task(spark, monkeypatch):
    monkeypatch.setattr(visitor_sets, "AT_ONCE", 10)
    ids = spark.range(500).select(F.lit("mid").alias("subject"), F.concat(F.lit("m"), "id").alias("id"))
    known = spark.createDataFrame([("mid", "m0", 40, 0), ("user_id", "m1", 90, 0)], visitor_sets.NUMBERS)
    found = visitor_sets.new_numbers(ids.where("id <> 'm0'"), known).collect()
    assert sorted(r.number for r in found) == list(range(41, 540))
