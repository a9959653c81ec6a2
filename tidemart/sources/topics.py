"""Topics as streams of one text column, ``value``."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def kafka_source_options(servers: str, topic: str, group: str,
                         offsets: dict[int, int] | None = None,
                         max_offsets_per_trigger: int | None = None,
                         partitions: int = 0) -> dict[str, str]:
    """Options to subscribe to one topic, from given offsets or else from the newest.

    They matter for a query's first run only: later runs go on from its checkpoint. The
    source wants every partition of the topic named; of the topic's ``partitions`` those
    without a given offset start at the newest one (-1).
    """
    start = "latest"
    if offsets:
        every = dict.fromkeys(range(partitions), -1) | offsets
        start = json.dumps({topic: {str(p): o for p, o in sorted(every.items())}})
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "kafka.group.id": group,
        "startingOffsets": start,
        "failOnDataLoss": "true",
    }
    if max_offsets_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return options


def from_offsets(messages: DataFrame, offsets: dict[int, int]) -> DataFrame:
    """Stored messages (``partition``, ``offset``, ...) from given offsets on, as a stream would start from them.

    A partition without a given offset starts at its newest one: nothing that is stored counts.
    """
    start = F.create_map(*(F.lit(x) for pair in sorted(offsets.items()) for x in pair)) if offsets else None
    return messages.where(F.col("offset") >= start[F.col("partition")]) if offsets else messages.limit(0)


def kafka_sink_options(servers: str) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers,
        "kafka.acks": "all",
        "kafka.enable.idempotence": "true",
    }


def kafka_topic(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    stream = spark.readStream.format("kafka").options(**options).load()
    # (partition, offset) is the order of arrival; fold it into one sortable number.
    return stream.selectExpr("CAST(value AS STRING) AS value",
                             "offset * 65536 + partition AS seq")


def file_topic(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A folder of text files, one message a line, as a topic."""
    reader = spark.readStream.format("text").schema("value STRING")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select("value")


def parquet_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = None,
                   max_bytes: int | None = None) -> DataFrame:
    """A Parquet table (one file or a folder) as a stream."""
    reader = spark.readStream.format("parquet").schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    folder, _, name = path.rstrip("/").rpartition("/")
    return reader.load(f"{folder}/{{{name}}}")
