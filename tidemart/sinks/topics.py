"""Writing ``topic, value`` rows: one write, the column ``topic`` says where each row goes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemart.session import settings
from tidemart.sources.topics import kafka_sink_options

#: A task keeps so many topics' files open, so it need not sort its messages by topic; only those of further topics are sorted.
OPEN_FILES = {"spark.sql.maxConcurrentOutputFileWriters": "64"}

TopicSink = Callable[[DataFrame, int], None]


def kafka_sink(servers: str) -> TopicSink:
    """At least once: a batch that is run again sends its messages again."""
    def write(messages: DataFrame, batch_id: int) -> None:
        (messages.select("topic", "value").write.format("kafka")
         .options(**kafka_sink_options(servers)).save())
    return write


def file_sink(path: str, first: int = 0, compression: str = "none") -> TopicSink:
    """Text files under ``topic=<name>/batch_id=<n>``; a batch run again replaces its files.

    Batch numbers start at ``first``: for a job with a new checkpoint name a number that
    the folder does not have yet, or its first batches would replace older ones. ``compression``
    is that of the files; messages of a topic are alike, so they become a small part of their text.
    """
    def write(messages: DataFrame, batch_id: int) -> None:
        with settings(messages.sparkSession, OPEN_FILES):
            (messages.select("topic", "value", F.lit(first + batch_id).alias("batch_id"))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", compression)
             .partitionBy("topic", "batch_id").text(path))
    return write


def append(rows: DataFrame, path: str) -> None:
    """Plain bulk write: every row is new."""
    rows.write.mode("append").parquet(path)
