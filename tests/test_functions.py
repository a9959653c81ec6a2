import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemart.functions import scalars, text


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_query_words():
    assert text.query_words("Red  ring, RED") == ["red", "ring"]
    assert text.query_words(" -- ") == []


@pytest.mark.parametrize("body,query,every,some", [
    ("Red ring", "red RING", True, True),
    ("red widget", "red ring", False, True),
    ("redring", "red", False, False),
    ("red-ring/2", "2 red", True, True),
    ("été à la mer", "ÉTÉ mer", True, True),
    ("红海 行动", "红海", True, True),
    ("红海行动", "红海", False, False),
    ("a.b", "a.b", True, True),
    ("axb", "a.b", False, False),
    ("anything", "", False, False),
    ("", "red", False, False),
])
def test_match(spark, body, query, every, some):
    got = one(spark, text.match_all_terms(F.lit(body), query), text.match_any_term(F.lit(body), query))
    assert got == (every, some)


def test_match_of_missing_text_keeps_no_row(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.where(text.match_all_terms(F.col("t"), "red")).count() == 0


@pytest.mark.parametrize("body,query,marked", [
    ("Red ring of red", "red", "<em>Red</em> ring of <em>red</em>"),
    ("redder red", "red ring", "redder <em>red</em>"),
    ("nothing", "red", "nothing"),
    ("red", "", "red"),
])
def test_highlight(spark, body, query, marked):
    assert one(spark, text.highlight(F.lit(body), query)) == (marked,)


@pytest.mark.parametrize("born,today,years", [
    ("2000-02-29", "2023-02-28", 22), ("2000-02-29", "2023-03-01", 23),
    ("2000-06-15", "2020-06-14", 19), ("2000-06-15", "2020-06-15", 20), ("2000-12-31", "2001-01-01", 0)])
def test_age(spark, born, today, years):
    got = one(spark, scalars.age_years(F.lit(born).cast("date"), F.lit(today).cast("date")))
    assert got == (years,)


def test_day_and_hour_do_not_depend_on_the_session_zone(spark):
    ms = int(dt.datetime(2024, 1, 1, 23, 59, 59, 999000, dt.timezone.utc).timestamp() * 1000)
    columns = [scalars.ts_to_dt(F.lit(ms)), scalars.ts_to_hr(F.lit(ms)),
               scalars.ts_to_dt(F.lit(ms), "Asia/Shanghai"), scalars.ts_to_hr(F.lit(ms), "Asia/Shanghai")]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert one(spark, *columns) == ("2024-01-01", "23", "2024-01-02", "07")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_day_before_the_epoch(spark):
    assert one(spark, scalars.ts_to_dt(F.lit(-1)), scalars.ts_to_hr(F.lit(-1))) == ("1969-12-31", "23")


def test_small_scalars(spark):
    created = F.lit("2001-08-01 05:07:00")
    assert one(spark, scalars.create_date(created), scalars.create_hour(created)) == ("2001-08-01", "05")
    assert one(spark, scalars.day_shift(F.lit("2024-03-01"), -1)) == ("2024-02-29",)
    assert one(spark, *(scalars.str_to_long(F.lit(t)) for t in ("12", "-3", "x", "1.5", None))) == (
        12, -3, None, None, None)
    assert one(spark, scalars.fact_topic(F.lit("order_info"), F.lit("I"), "x"),
               scalars.dim_key(F.lit("user_info"), F.lit(7))) == ("DWD_ORDER_INFO_I_x", "DIM:USER_INFO:7")
    assert one(spark, scalars.record_to_json(F.lit(1).alias("a"), F.lit(None).cast("int").alias("b"))) == ('{"a":1}',)
