"""Documents that are written, changed and deleted by id, as layers that are put together at reading.

A write is a layer of its own (``batch_id``) and says what was done (``_op``): the whole document was put, some of its
fields were set, or it was deleted. Nothing that is there is read again or rewritten but what a write itself needs,
so days that a write does not touch stay as they are, and a write that is run again replaces its own layer. At
reading the newest word on each field counts, if the document's newest put is not followed by a delete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemart.operators.dedup import last_per_key
from tidemart.sources.tables import read_or_empty

LAYER, DAY = "batch_id", "dt"
PUT, SET, DELETED = "put", "set", "deleted"


class Documents:
    """The documents at ``path``; ``schema`` has their columns, among them ``key`` and the day ``dt``.

    Writes take a ``batch_id``, larger for later ones. An id belongs to one day; writes that name only ids find out
    which from the layers before theirs.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: str = "id"):
        self.spark, self.path, self.key = spark, path, key
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.fields = [f.name for f in self.schema.fields if f.name not in (key, DAY)]

    def layers(self, before: int | None = None) -> DataFrame:
        columns = [f for f in self.schema.fields if f.name != DAY]
        stored = T.StructType([*columns, T.StructField("_op", T.StringType()), T.StructField("_set", T.ArrayType(T.StringType())),
                               T.StructField(DAY, T.StringType()), T.StructField(LAYER, T.LongType())])
        found = read_or_empty(self.spark, self.path, stored)
        return found if before is None else found.where(F.col(LAYER) < before)

    def current(self, before: int | None = None) -> DataFrame:
        """Documents as of now, or of the writes before ``before``. Words on one id are reduced in each task first."""
        op, newest = F.col("_op"), F.col(LAYER)
        whole = op.isin(PUT, DELETED)

        def last(field: str) -> Column:
            said = whole | F.array_contains("_set", field)
            # In a struct, so that a word that sets NULL counts too.
            return F.max_by(F.when(said, F.struct(F.col(field).alias("v"))), F.when(said, newest))["v"].alias(field)
        rows = self.layers(before).groupBy(DAY, self.key).agg(
            F.max_by(F.when(whole, op), F.when(whole, newest)).alias("_op"), *map(last, self.fields))
        return rows.where(F.col("_op") == PUT).select(*self.schema.names)

    def _write(self, rows: DataFrame, batch_id: int, op: str, set_fields: Column | None = None) -> None:
        none = F.lit(None).cast("array<string>")
        absent = {f.name: F.lit(None).cast(f.dataType) for f in self.schema.fields if f.name not in rows.columns}
        (rows.withColumns(absent).select(*self.schema.names, F.lit(op).alias("_op"),
                                         (none if set_fields is None else set_fields).alias("_set"))
         .hint("rebalance", DAY).withColumn(LAYER, F.lit(batch_id).cast("bigint"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY, LAYER).parquet(self.path))

    def _with_day(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Rows of ids that are there, with their day."""
        return rows.join(self.current(batch_id).select(self.key, DAY), self.key)

    def put(self, docs: DataFrame, batch_id: int, order: list[str] | None = None) -> None:
        """Whole documents under their ids; of several with one id the last in ``order`` counts."""
        self._write(last_per_key(docs, [DAY, self.key], order or [self.key]), batch_id, PUT)

    def append(self, docs: DataFrame, batch_id: int) -> None:
        """Documents without an id: each gets one of its own, named after the write."""
        number = F.concat(F.lit(f"{batch_id}-"), F.monotonically_increasing_id().cast("string"))
        self._write(docs.withColumn(self.key, number), batch_id, PUT)

    def patch(self, changes: DataFrame, batch_id: int) -> None:
        """Sets the fields of documents that a row names with a value; NULL and missing columns say nothing. One row per id."""
        fields = [c for c in changes.columns if c in self.fields]
        said = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in fields)))
        self._write(self._with_day(changes.select(self.key, *fields), batch_id), batch_id, SET, said)

    def patch_where(self, condition: Column, field: str, value, batch_id: int) -> None:
        """Sets one field, to NULL too, of the documents for which ``condition`` holds."""
        kind = self.schema[field].dataType
        rows = self.current(batch_id).where(condition).select(self.key, DAY, F.lit(value).cast(kind).alias(field))
        self._write(rows, batch_id, SET, F.array(F.lit(field)))

    def delete(self, ids: DataFrame, batch_id: int) -> None:
        self._write(self._with_day(ids.select(self.key).distinct(), batch_id), batch_id, DELETED)
