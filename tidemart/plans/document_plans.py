"""Document writes. The documents are the products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart.operators import documents
from tidemart.plans.registry import query
from tidemart.plans.views_sql import with_views
from tidemart.session import scratch_dir
from tidemart.sinks.documents import Documents
from tidemart.sinks.topics import append
from tidemart.sources import driver_tables as D


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.movie(spark, sf_dir).select("id", "name", "score")


def _stored(spark: SparkSession, sf_dir: str, key: str = "BIGINT") -> Documents:
    """The documents, put under their ids as the first write; days are made up of the id."""
    stored = Documents(spark, scratch_dir(spark, "documents"), f"id {key}, name STRING, score DOUBLE, dt STRING")
    if key == "BIGINT":
        stored.put(_dated(_docs(spark, sf_dir)), 0)
    return stored


def _dated(docs: DataFrame) -> DataFrame:
    return docs.withColumn("dt", F.concat(F.lit("2001-01-0"), F.col("id") % 5 + 1))


def _read(stored: Documents, write) -> DataFrame:
    """What is there after a write that is run twice, as after a failure."""
    for _ in range(2):
        write()
    return stored.current().select("id", "name", "score")


@query("doc_put", with_views("""
    select id, case when score > 5 then name || ' again' else name end as name, score from movie"""))
def doc_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good documents are written again under their id with a new name."""
    stored = _stored(spark, sf_dir)
    again = _docs(spark, sf_dir).where("score > 5").withColumn("name", F.concat("name", F.lit(" again")))
    return _read(stored, lambda: stored.put(_dated(again), 1))


@query("doc_append", with_views("select name, 2 * count(*) n, 2 * count(*) ids from movie group by name"))
def doc_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents written twice without an id: every write is a new one."""
    stored, docs = _stored(spark, sf_dir, "STRING"), _dated(_docs(spark, sf_dir)).drop("id")
    stored.append(docs, 0)
    return _read(stored, lambda: stored.append(docs, 1)).groupBy("name").agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@query("doc_bulk", with_views("""
    select id, name, score from movie union all select id, name, score from movie"""))
def doc_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two bulk writes, read back."""
    path = scratch_dir(spark, "bulk")
    docs = _docs(spark, sf_dir)
    append(docs, path)
    append(docs, path)
    return spark.read.schema(docs.schema).parquet(path)


@query("doc_update", with_views("""
    select id, case when score < 3 then name || ' 2' else name end as name, score from movie"""))
def doc_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, docs = _stored(spark, sf_dir), _docs(spark, sf_dir)
    patch = docs.where("score < 3").select("id", F.concat("name", F.lit(" 2")).alias("name"),
                                           F.lit(None).cast("double").alias("score"))
    return _read(stored, lambda: stored.patch(patch, 1))


@query("doc_update_where", with_views("""
    select id, case when name = 'red ring' then 'red ring 1' else name end as name, score from movie"""))
def doc_update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _stored(spark, sf_dir)
    return _read(stored, lambda: stored.patch_where(documents.term("name", "red ring"), "name", "red ring 1", 1))


@query("doc_delete", with_views("select id, name, score from movie where not score < 3"))
def doc_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _stored(spark, sf_dir)
    return _read(stored, lambda: stored.delete(_docs(spark, sf_dir).where("score < 3"), 1))


@query("doc_history", with_views("""
    select id, case when score < 1 then 'new' when score > 5 then name || ' 2' when id % 3 = 0 then 'three' else name end as name,
           case when score < 1 then null when id % 3 = 0 then 9 else score end as score
    from movie where id % 7 <> 0 or score < 1"""))
def doc_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches, a delete, and documents put again after it, each write run twice."""
    stored, docs = _stored(spark, sf_dir), _docs(spark, sf_dir)
    _read(stored, lambda: stored.patch(docs.where("id % 3 = 0").select("id", F.lit("three").alias("name"), F.lit(9.0).alias("score")), 1))
    _read(stored, lambda: stored.patch(docs.where("score > 5").select("id", F.concat("name", F.lit(" 2")).alias("name")), 2))
    _read(stored, lambda: stored.delete(docs.where("id % 7 = 0"), 3))
    _read(stored, lambda: stored.patch(docs.where("id % 7 = 0").select("id", F.lit("gone").alias("name")), 4))
    again = docs.where("score < 1").select("id", F.lit("new").alias("name"), F.lit(1.0).alias("score"))
    _read(stored, lambda: stored.put(_dated(again), 5))
    return _read(stored, lambda: stored.patch_where(documents.term("name", "new"), "score", None, 6))
