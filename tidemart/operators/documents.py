"""Stored documents: put, update and delete by id or condition, filters, nested groups."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doc_put(base: DataFrame, docs: DataFrame, key: str = "id") -> DataFrame:
    """Writes with an id: a document of the same id is replaced. ``docs`` has one row per id."""
    kept = base.join(docs.select(key), key, "left_anti")
    return kept.unionByName(docs)


def doc_append(docs: DataFrame, batch: str | None = None) -> DataFrame:
    """Writes without an id: each row gets an id of its own, ``doc_id``, in every call.

    The id is a name for the call plus the row's number in its task, so it costs no
    shuffle. Name the call yourself to get the same ids when it is repeated on the same input.
    """
    call = batch or uuid.uuid4().hex
    return docs.withColumn(
        "doc_id", F.concat(F.lit(f"{call}-"), F.monotonically_increasing_id().cast("string")))


def doc_update(base: DataFrame, patch: DataFrame, key: str = "id") -> DataFrame:
    """Replaces the fields a patch row sets; fields it leaves NULL or does not have stay."""
    fields = [c for c in patch.columns if c != key]
    renamed = patch.withColumnsRenamed({c: f"_new_{c}" for c in fields})
    joined = base.join(renamed, key, "left")
    return joined.select(*(
        F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c)
        for c in base.columns))


def doc_update_where(base: DataFrame, condition: Column, field: str, value) -> DataFrame:
    """Sets ``field`` to ``value`` on the rows for which ``condition`` holds."""
    return base.withColumn(field, F.when(condition, F.lit(value)).otherwise(F.col(field)))


def doc_delete(base: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return base.join(ids.select(key).distinct(), key, "left_anti")


def term(field: str, value) -> Column:
    """Exact match of a whole field."""
    return F.col(field) == F.lit(value)


def in_range(field: str, low=None, high=None) -> Column:
    """``low <= field <= high``; without bounds, any value that is present."""
    tests = [F.col(field).isNotNull()]
    if low is not None:
        tests.append(F.col(field) >= F.lit(low))
    if high is not None:
        tests.append(F.col(field) <= F.lit(high))
    return bool_query(tests)


def bool_query(filters: list[Column] = (), must: list[Column] = ()) -> Column:
    """All clauses hold. Filters and musts differ only in scoring, which there is none of."""
    return reduce(Column.__and__, [*filters, *must], F.lit(True))


def group_by_nested(docs: DataFrame, items: str, field: str, score: str) -> DataFrame:
    """``name, doc_count, avg_score`` per value of a field inside an array of objects.

    A value that one document repeats counts once. The mean is taken over exact
    decimals, so it does not depend on how rows are split over tasks.
    """
    values = F.array_distinct(F.transform(items, lambda item: item[field]))
    rows = docs.select(F.explode(values).alias("name"), F.col(score).cast("decimal(18,6)").alias("_score"))
    return rows.where("name IS NOT NULL").groupBy("name").agg(
        F.count("*").alias("doc_count"),
        (F.sum("_score").cast("double") / F.count("_score")).alias("avg_score"))


def avg_by_actor(movies: DataFrame, groups: int = 10) -> DataFrame:
    """Mean score per actor, best first."""
    return (group_by_nested(movies, "actors", "name", "score")
            .orderBy(F.desc("avg_score"), "name").limit(groups))
