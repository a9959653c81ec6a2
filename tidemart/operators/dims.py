"""Dimension tables and lookups.

Lookups are left joins with the fact side on the left, without hints. Spark broadcasts
a dimension if its size is under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise
shuffles; adaptive execution then splits the fact rows of a hot key, which it can do for
the left side of a left join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemart.functions.scalars import age_years


def latest_dims(changes: DataFrame, order: str = "seq") -> DataFrame:
    """Latest image of each dimension row; a deleted row keeps its last image, marked."""
    last = F.max_by(F.struct("key", "data", "op", order), F.col(order)).alias("_last")
    return changes.groupBy("table", "id").agg(last).select(
        "table", "id", "_last.key", "_last.data", (F.col("_last.op") == "D").alias("is_deleted"),
        f"_last.{order}")


def _field(name: str) -> Column:
    return F.get_json_object("data", f"$.{name}").alias(name)


def user_dim(dims: DataFrame) -> DataFrame:
    return dims.where(F.col("table") == "user_info").select("id", _field("gender"), _field("birthday"))


def province_dim(dims: DataFrame) -> DataFrame:
    return dims.where(F.col("table") == "base_province").select(
        "id", _field("name"), _field("area_code"), _field("iso_code"), _field("iso_3166_2"))


def lookup_user(fact: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """Adds ``user_gender, user_age``; NULL where the user is unknown."""
    found = users.select(
        F.col("id").alias("_user"), F.col("gender").alias("user_gender"),
        age_years(F.col("birthday").try_cast("date"), as_of).alias("user_age"))
    key = F.col("user_id").try_cast("bigint")
    return fact.join(found, key == F.col("_user"), "left").drop("_user")


def lookup_province(fact: DataFrame, provinces: DataFrame, code_column: str = "province_3166_2") -> DataFrame:
    """Adds the province's area code, name and ISO codes; NULL where it is unknown."""
    found = provinces.select(
        F.col("id").alias("_province"), F.col("name").alias("province_name"),
        F.col("area_code").alias("province_area_code"), F.col("iso_code").alias("province_iso_code"),
        F.col("iso_3166_2").alias(code_column))
    key = F.col("province_id").try_cast("bigint")
    return fact.join(found, key == F.col("_province"), "left").drop("_province")
