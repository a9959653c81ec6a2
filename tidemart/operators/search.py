"""Keyword search, paging and highlighting over order lines and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemart.functions.text import highlight, match_all_terms, match_any_term
from tidemart.operators.documents import bool_query, in_range
from tidemart.session import scratch_dir

# fixed values: the fields a detail page shows
DETAIL_FIELDS = ["create_time", "order_price", "province_name", "sku_name", "sku_num",
                 "total_amount", "user_age", "user_gender"]

#: Pages that end within so many rows are found by an ordered limit.
NEAR = 10_000


def fetch_source(df: DataFrame, fields: list[str] = DETAIL_FIELDS) -> DataFrame:
    return df.select(*fields)


def total_hits(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition).agg(F.count("*").alias("total"))


def top_rows(df: DataFrame, order: list[Column | str], start: int, size: int) -> DataFrame:
    """Rows ``start .. start+size-1`` in order. Order by a unique column last.

    Every task keeps ``start + size`` rows: for the first pages of a result.
    """
    return df.orderBy(*order).offset(start).limit(size)


def detail_page(order_wide: DataFrame, keyword: str, day: str | None = None,
                page: int = 1, page_size: int = 20, near: int = NEAR) -> DataFrame:
    """One page of the lines whose product name has all words of ``keyword``, with ``total``.

    Lines are in order of time and id, NULLs first; matched words are marked.
    """
    hits = order_wide.where(match_all_terms(F.col("sku_name"), keyword))
    if day is not None:
        hits = hits.where(F.col("create_date") == day)
    shown = page_rows(hits.select("detail_id", *DETAIL_FIELDS), ["create_time", "detail_id"],
                      (page - 1) * page_size, page_size, near)
    return shown.select(
        "detail_id", *(highlight(F.col(c), keyword).alias(c) if c == "sku_name" else c
                       for c in DETAIL_FIELDS),
        "total")


def page_rows(hits: DataFrame, order: list[str], first: int, size: int, near: int = NEAR) -> DataFrame:
    """Rows ``first .. first+size-1`` in order, and how many rows there are (``total``).

    For a page that ends within the first ``near`` rows each task keeps that many, and nothing is written. A page
    further down would make tasks keep ever more; it is found as ``far_rows`` says. Both give the same rows.
    """
    if first + size > near:
        return far_rows(hits, order, first, size)
    total = hits.agg(F.count("*")).scalar()
    return (hits.withColumn("_tie", F.xxhash64(*hits.columns)).orderBy(*order, "_tie").offset(first).limit(size)
            .select(*hits.columns, total.alias("total")))


def far_rows(hits: DataFrame, order: list[str], first: int, size: int) -> DataFrame:
    """``page_rows`` for any page alike.

    Rows are ranged by their order once and written with the number of their range; ranges are
    counted, and only those that reach into the page are numbered. Rows equal in order go by
    their other columns' hash, so no range is larger than its share.
    """
    keys = [*order, "_tie"]
    ranged = (hits.withColumn("_tie", F.xxhash64(*hits.columns)).repartitionByRange(*keys)
              .withColumn("_range", F.spark_partition_id()))
    path = scratch_dir(hits.sparkSession, "page")
    ranged.write.parquet(path)
    stored = hits.sparkSession.read.schema(ranged.schema).parquet(path)
    # One row for each range, of which there are as many as tasks.
    counts = stored.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select("_range", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                           F.sum("_n").over(everything).alias("total"))
    touched = starts.where((F.col("_before") < first + size) & (F.col("_before") + F.col("_n") > first))
    number = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    placed = (stored.join(F.broadcast(touched.drop("_n")), "_range")
              .withColumn("_pos", F.col("_before") + number - 1))
    return placed.where((F.col("_pos") >= first) & (F.col("_pos") < first + size)).select(*hits.columns, "total")


def search_by_condition(movies: DataFrame, words: str, min_score: float | None = None,
                        start: int = 0, size: int = 20) -> DataFrame:
    """Any word in the name, score at least ``min_score``; best first, words marked, with ``total``."""
    hits = movies.where(bool_query(filters=[in_range("score", min_score)],
                                   must=[match_any_term(F.col("name"), words)]))
    shown = top_rows(hits, [F.desc("score"), "id"], start, size)
    total = hits.agg(F.count("*")).scalar()
    return shown.select("id", highlight(F.col("name"), words).alias("name"), "score", total.alias("total"))
