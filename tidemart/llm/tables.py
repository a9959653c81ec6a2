"""Input tables, tables kept between steps, and the words of a text."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart.session import scratch_dir

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read again: lineage is cut, sizes are known to the planner."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. Where every character is one byte, ``lower`` does the same, faster."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, upper, upper.lower())))


def word_blocks(data: bytes, step: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, some at a time, so that a long text is not held as one list."""
    start, end = 0, len(data)
    while start < end:
        stop = min(start + step, end)
        if stop < end:
            space = _SPACE.search(data, stop)
            stop = space.start() if space else end
        yield data[start:stop].split()
        start = stop
