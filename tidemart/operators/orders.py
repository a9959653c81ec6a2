"""Order headers and lines, joined.

An order id may be hot on the line side (very many lines of one order) and is unique on
the header side. Joins are therefore inner or left with the lines on the left, which
adaptive execution can split, and never full outer, which it cannot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemart import schemas as S
from tidemart.functions.scalars import create_date, create_hour
from tidemart.operators.dedup import arrival
from tidemart.operators.dims import lookup_province, lookup_user


def enrich_headers(headers: DataFrame, users: DataFrame, provinces: DataFrame, as_of: Column) -> DataFrame:
    """Adds the derived columns of an order header."""
    dated = (headers.withColumn("create_date", create_date(F.col("create_time")))
             .withColumn("create_hour", create_hour(F.col("create_time"))))
    return lookup_province(lookup_user(dated, users, as_of), provinces, "province_3166_2_code")


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns})


def merge_order_wide(joined: DataFrame) -> DataFrame:
    """Columns ``h_*`` and ``d_*`` of one joined row -> ``ORDER_WIDE``.

    Both sides have ``create_time``; the line's is taken, even where it is NULL.
    """
    def source(name: str) -> str:
        if name == "detail_id":
            return "d_id"
        if name == "order_id":
            return "d_order_id"
        return f"d_{name}" if name in S.names(S.ORDER_LINE) else f"h_{name}"
    return joined.select(*(F.col(source(c)).cast(kind).alias(c) for c, kind in S.ORDER_WIDE))


def join_order_lines(headers: DataFrame, lines: DataFrame, how: str = "inner") -> DataFrame:
    """Lines with their header as ``d_*`` and ``h_*`` columns; ``how`` is inner or left."""
    return _prefixed(lines, "d_").join(_prefixed(headers, "h_"), F.col("d_order_id") == F.col("h_id"), how)


def order_wide(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per line that has a header. ``headers`` come from ``enrich_headers``."""
    return merge_order_wide(join_order_lines(headers, lines))


def unmatched_headers(headers: DataFrame, lines: DataFrame) -> DataFrame:
    # The lines' order ids are made distinct first: one row per order crosses the network.
    ids = lines.select(F.col("order_id").alias("id")).distinct()
    return headers.join(ids, "id", "left_anti")


def unmatched_lines(headers: DataFrame, lines: DataFrame) -> DataFrame:
    ids = headers.select(F.col("id").alias("order_id"))
    return lines.join(ids, "order_id", "left_anti")


def full_outer(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Headers and lines on order id, each kept without a partner too.

    Written as lines left join headers plus headers without a line.
    """
    matched = join_order_lines(headers, lines, "left")
    alone = _prefixed(unmatched_headers(headers, lines), "h_")
    return (matched.unionByName(alone, allowMissingColumns=True)
            .withColumn("order_id", F.coalesce("h_id", "d_order_id")))


def join_order_streams(headers: DataFrame, lines: DataFrame, within: str = "24 hours", salts: int = 1,
                       how: str = "inner", header_at: Column | None = None,
                       line_at: Column | None = None, late: str = "0 seconds") -> DataFrame:
    """Lines with their header as ``d_*`` and ``h_*``, for streams in either order.

    The id alone joins them. Either side waits for the other for ``within`` of its arrival,
    whatever its own time is and even without one, so a replay in any order loses nothing.
    ``header_at`` and ``line_at`` say when a row arrived if the source knows; a row's micro-batch
    does otherwise. Only with these can rows come out of turn, by up to ``late``. Streams are not re-planned at run time: where single orders have very many
    lines, these are spread over ``salts`` tasks and the one header is copied to each. ``how`` is
    inner, left_outer to let lines out for which no header came in time, or full_outer to let
    out headers without a line as well; see ``split_joined``. As many salts are enough as let the lines of
    the largest order, divided by them, fit a task.
    """
    left = (_prefixed(lines.withColumn("at", arrival(line_at)), "d_")
            .withColumn("d_salt", F.pmod(F.xxhash64("d_id"), F.lit(salts)).cast("int"))
            .withWatermark("d_at", late))
    right = (_prefixed(headers.withColumn("at", arrival(header_at)), "h_")
             .withColumn("h_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
             .withWatermark("h_at", late))
    on = F.expr(f"""d_order_id = h_id AND d_salt = h_salt
                    AND d_at >= h_at - INTERVAL {within} AND d_at <= h_at + INTERVAL {within}""")
    joined = left.join(right, on, how).drop("d_at", "h_at")
    return joined if how == "full_outer" else joined.drop("d_salt", "h_salt")


def split_joined(joined: DataFrame, salts: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of a full outer ``join_order_streams``: lines with their header, lines alone, headers alone.

    A header was copied to each salt, and its copies come out alone together, when their time is past. It is
    alone only if all of them are.
    """
    lines_alone = joined.where("h_salt IS NULL").select(
        *(F.col(c).alias(c[2:]) for c in joined.columns if c.startswith("d_") and c != "d_salt"))
    copies = joined.where("d_salt IS NULL").select(
        "h_salt", *(F.col(c).alias(c[2:]) for c in joined.columns if c.startswith("h_") and c != "h_salt"))
    if salts > 1:
        header = [c for c in copies.columns if c != "h_salt"]
        copies = copies.groupBy(*header).agg(F.count_distinct("h_salt").alias("h_salt")).where(F.col("h_salt") == salts)
    matched = joined.where("h_salt IS NOT NULL AND d_salt IS NOT NULL").drop("h_salt", "d_salt")
    return matched, lines_alone, copies.drop("h_salt")
