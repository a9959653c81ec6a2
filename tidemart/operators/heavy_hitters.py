"""The n most frequent values of a column with very many of them, without counting every one.

A sketch per day names the values that may be frequent and how many of one it may have missed; sketches of
days add up over any range. The named values are counted exactly. Where the n-th of these counts is above
what any other value can have, the answer is settled; else all values are counted. The result is exact either way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that a sketch keeps, and how many times ``n`` are taken from it to be counted.
ITEMS, FACTOR = 10_000, 10
#: A sketch is wrong by no more than this part of all rows, divided by the values it keeps.
ERROR = 3.5


def day_sketches(rows: DataFrame, day: str, column: str, items: int = ITEMS) -> DataFrame:
    """``day, n, sketch``: rows with a value, and the sketch of their values. A sketch's size does not depend on the rows'."""
    return rows.where(F.col(column).isNotNull()).groupBy(day).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k_accumulate(`{column}`, {items})").alias("sketch"))


def candidates(sketches: DataFrame, n: int, items: int = ITEMS, factor: int = FACTOR) -> tuple[list, int]:
    """Values that may be among the ``n`` most frequent, and how many rows any other value has at most.

    There may be none to name where all values are about as frequent.
    """
    wanted = min(n * factor, items)
    found = sketches.groupBy(F.lit("all")).agg(F.sum("n").alias("n"), F.expr(f"approx_top_k_combine(sketch, {items})").alias("sketch"))
    row = found.select("n", F.expr(f"approx_top_k_estimate(sketch, {wanted})").alias("top")).first()
    if row is None:
        return [], 0
    # A value that the sketch has lost has few rows; one that it has but did not name no more than the last named.
    missed = int(ERROR * row.n / items) + 1
    return [t["item"] for t in row.top], max(missed, row.top[-1]["count"] if len(row.top) == wanted else 0)


def top_values(rows: DataFrame, sketches: DataFrame, column: str, n: int, items: int = ITEMS,
               factor: int = FACTOR) -> DataFrame:
    """``name, value``: the ``n`` most frequent values and their counts, ties in order of the value.

    ``sketches`` are those of the same rows. What is counted are at most ``n * factor`` values, if that settles it.
    """
    named, others = candidates(sketches, n, items, factor)
    known = rows.where(F.col(column).isNotNull())

    def most(some: DataFrame) -> DataFrame:
        return (some.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("value"))
                .orderBy(F.desc("value"), "name").limit(n))
    if not named:
        return most(known)
    counted = most(known.where(F.col(column).isin(named)))
    least = counted.agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("value")).first()
    return counted if least.n == n and least.value > others else most(known)
