"""Order headers and lines stored so that they join where they lie.

Both are dealt to the same number of buckets by order id and sorted in them, so a join on the id moves neither.
Lines of orders that are too large for a bucket's task are stored apart, not by order, and meet their few headers
by broadcast.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemart.operators import orders

#: An order with a larger part of all lines than this is hot, so there are at most 1,000 hot orders.
HOT = 1 / 1000


@dataclass
class StoredOrders:
    headers: DataFrame
    lines: DataFrame
    hot_lines: DataFrame
    hot_ids: list[int]

    def wide(self) -> DataFrame:
        """One row per line that has a header, as ``orders.order_wide``."""
        plain = orders.order_wide(self.headers, self.lines)
        if not self.hot_ids:
            return plain
        few = F.broadcast(self.headers.where(F.col("id").isin(self.hot_ids)))  # at most 1 / HOT ids
        return plain.unionByName(orders.order_wide(few, self.hot_lines))


def hot_orders(lines: DataFrame, part: float = HOT) -> list[int]:
    """Ids of orders with more than this part of all lines."""
    counts = lines.groupBy("order_id").agg(F.count(F.lit(1)).alias("n"))
    most = part * lines.count()
    return sorted(r.order_id for r in counts.where((F.col("n") > most) & F.col("order_id").isNotNull()).collect())


def store(headers: DataFrame, lines: DataFrame, path: str, buckets: int, part: float = HOT, most_lines: int = 100_000) -> StoredOrders:
    """Writes both tables under ``path``. ``headers`` have their derived columns; orders of up to ``most_lines`` are never hot."""
    spark, name = lines.sparkSession, uuid.uuid4().hex
    hot = hot_orders(lines, max(part, most_lines / max(1, lines.count())))
    apart = F.coalesce(F.col("order_id").isin(hot), F.lit(False)) if hot else F.lit(False)

    def bucketed(rows: DataFrame, key: str, label: str) -> DataFrame:
        table = f"{label}_{name}"
        # One task per bucket, so a bucket is one sorted file.
        (rows.repartition(buckets, key).sortWithinPartitions(key).write.bucketBy(buckets, key).sortBy(key)
         .option("path", f"{path}/{label}").saveAsTable(table))
        return spark.table(table)
    lines.where(apart).write.parquet(f"{path}/hot_lines")
    return StoredOrders(bucketed(headers, "id", "headers"), bucketed(lines.where(~apart), "order_id", "lines"),
                        spark.read.schema(lines.schema).parquet(f"{path}/hot_lines"), hot)
