"""Who visited on a day, as bitmaps that add up over any range of days.

Devices and users get numbers from 1 on, without gaps, in the order they are first heard of. A day's set of them is
a row per 32,768 numbers, with a bit per number. Distinct visitors of a range are the bits of its days put
together, so a range of any length is answered from these rows alone, exactly, and pages are read once only: when
they come. Sets of further batches are further rows of a day; a batch that is run again replaces its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemart.functions.scalars import ts_to_dt
from tidemart.operators.traffic import last_days
from tidemart.sources.tables import read_or_empty

NUMBERS = "subject STRING, id STRING, number BIGINT, batch_id BIGINT"
SETS = "name STRING, bucket BIGINT, bits BINARY, dt STRING, batch_id BIGINT"
VIEWS = "n BIGINT, dt STRING, batch_id BIGINT"
#: New ids that a task puts in order, on average.
AT_ONCE = 100_000

#: What a set is of: a column of pages, and which pages count.
Sets = dict[str, tuple[str, Column | None]]


def visit_sets(steps: dict[str, str]) -> Sets:
    """Devices, new devices, and the users that saw each step's page."""
    return {"uv": ("mid", None), "new": ("mid", F.col("is_new") == "1"),
            **{f"step:{name}": ("user_id", F.col("page_id") == page) for name, page in steps.items()}}


def members(pages: DataFrame, sets: Sets, zone: str = "UTC") -> DataFrame:
    """``dt, name, subject, id``, each once; pages without a time or an id are in no set."""
    entries = [F.when(F.lit(True) if where is None else where, F.struct(
        F.lit(name).alias("name"), F.lit(subject).alias("subject"), F.col(subject).cast("string").alias("id")))
        for name, (subject, where) in sets.items()]
    found = pages.select(ts_to_dt(F.col("ts"), zone).alias("dt"), F.explode(F.array_compact(F.array(*entries))).alias("m"))
    return found.select("dt", "m.*").where("dt IS NOT NULL AND id IS NOT NULL").distinct()


def new_numbers(fresh: DataFrame, known: DataFrame) -> DataFrame:
    """``subject, id, number`` of ids (``subject, id``, distinct) that are not ``known``, from the next free number on.

    Ids are dealt to buckets by hash and put in order bucket by bucket; only the buckets' sizes meet in one place. The
    same ids after the same known ones get the same numbers.
    """
    buckets = F.lit(max(1, fresh.count() // AT_ONCE))
    keyed = fresh.withColumn("_bucket", F.pmod(F.xxhash64("id"), buckets))
    sizes = keyed.groupBy("subject", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("subject").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    used = known.groupBy("subject").agg(F.max("number").alias("_used"))
    first = sizes.join(used, "subject", "left").select(
        "subject", "_bucket", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + F.coalesce("_used", F.lit(0))).alias("_first"))
    inside = Window.partitionBy("subject", "_bucket").orderBy("id")
    return keyed.join(first, ["subject", "_bucket"]).select(
        "subject", "id", (F.col("_first") + F.row_number().over(inside)).alias("number"))


def bitmaps(numbered: DataFrame) -> DataFrame:
    """``dt, name, bucket, bits`` from ``dt, name, number``; bits are set in each task before rows are sent."""
    return numbered.groupBy("dt", "name", F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def store(pages: DataFrame, batch_id: int, path: str, sets: Sets, zone: str = "UTC") -> None:
    """Numbers, sets and page views of one batch of pages, as layer ``batch_id`` of the tables under ``path``."""
    spark = pages.sparkSession

    def write(rows: DataFrame, table: str, *partitions: str) -> None:
        (rows.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(*partitions, "batch_id").parquet(f"{path}/{table}"))

    pages = pages.persist()
    try:
        found = members(pages, sets, zone)
        earlier = numbers(spark, path).where(F.col("batch_id") < batch_id)
        fresh = found.select("subject", "id").distinct().join(earlier, ["subject", "id"], "left_anti").persist()
        write(new_numbers(fresh, earlier), "numbers")
        fresh.unpersist()
        known = numbers(spark, path).where(F.col("batch_id") <= batch_id)
        write(bitmaps(found.join(known, ["subject", "id"])).hint("rebalance", "dt"), "sets", "dt")
        write(pages.where("ts IS NOT NULL").groupBy(ts_to_dt(F.col("ts"), zone).alias("dt")).agg(F.count(F.lit(1)).alias("n")),
              "views", "dt")
    finally:
        pages.unpersist()


def numbers(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, f"{path}/numbers", NUMBERS)


def stored_sets(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, f"{path}/sets", SETS)


def stored_views(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, f"{path}/views", VIEWS)


def counted(sets: DataFrame, *by: str) -> DataFrame:
    """``by, n``: distinct members of the sets put together per ``by``; each bucket's bits are joined up on their own."""
    return (sets.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
            .groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias("n")))


def uv_by_day(sets: DataFrame, until: str | None = None, days: int | None = None) -> DataFrame:
    return counted(last_days(sets.where("name = 'uv'"), "dt", until, days), "dt").withColumnRenamed("n", "uv")


def visit_total(sets: DataFrame, views: DataFrame, until: str | None = None, days: int | None = None) -> DataFrame:
    """Views, devices and new devices of a range, as ``traffic.visit_total`` gives them."""
    who = counted(last_days(sets.where("name IN ('uv', 'new')"), "dt", until, days), "name")
    rows = who.unionByName(last_days(views, "dt", until, days).select(F.lit("pv").alias("name"), "n"))
    return rows.agg(*(F.coalesce(F.sum(F.when(F.col("name") == name, F.col("n"))), F.lit(0)).alias(f"{name}_count")
                      for name in ("pv", "uv", "new")))


def action_funnel(sets: DataFrame, steps: dict[str, str], until: str | None = None, days: int | None = None) -> DataFrame:
    """``pos, step, users`` of a range, as ``traffic.action_funnel`` gives them."""
    names = [f"step:{step}" for step in steps]
    who = counted(last_days(sets.where(F.col("name").isin(names)), "dt", until, days), "name")
    users = who.agg(*(F.coalesce(F.sum(F.when(F.col("name") == name, F.col("n"))), F.lit(0)).alias(f"_{i}")
                      for i, name in enumerate(names)))
    return users.select(F.inline(F.array(*(F.struct(
        F.lit(i).alias("pos"), F.lit(step).alias("step"), F.col(f"_{i}").alias("users")) for i, step in enumerate(steps)))))
