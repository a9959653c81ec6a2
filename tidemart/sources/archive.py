"""A stored topic as a stream that begins at given offsets.

An archive is a folder of Parquet files by topic partition (``partition=<n>``) with the messages' offsets. As a stream
it begins, per partition, at the offset that is given, or else behind the newest message that there is at the first
start. Where a stream has got to is in its checkpoint: a later start goes on from there, whatever is given. A
partition that appears later is read from its beginning. Only statistics in the files' footers are looked at to
find what is new, and a task reads the row groups in which its stretch of offsets lies.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "partition INT, offset BIGINT, value STRING"
_NAME = "topic_archive"
#: Messages that a task reads at most.
STRETCH = 1_000_000
#: Messages that a task holds at once.
ROWS = 4_096


@dataclass
class Stretch(InputPartition):
    """Messages of a partition from ``start`` up to but not including ``end``."""
    partition: int
    start: int
    end: int


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, offsets: dict[str, int]):
        self.path, self.offsets = path, offsets

    def _files(self) -> ds.Dataset:
        place, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        if place.get_file_info(path).type == fs.FileType.NotFound:
            return ds.dataset([], schema=pa.schema([("offset", pa.int64()), ("value", pa.string()), ("partition", pa.int32())]))
        return ds.dataset(path, filesystem=place, format="parquet",
                          partitioning=ds.partitioning(pa.schema([("partition", pa.int32())]), flavor="hive"),
                          schema=pa.schema([("offset", pa.int64()), ("value", pa.string()), ("partition", pa.int32())]),
                          exclude_invalid_files=False)

    def _newest(self) -> dict[str, int]:
        """Per partition the offset after its last message."""
        found: dict[str, int] = {}
        for file in self._files().get_fragments():
            partition = str(ds.get_partition_keys(file.partition_expression)["partition"])
            for group in file.row_groups:
                found[partition] = max(found.get(partition, 0), group.statistics["offset"]["max"] + 1)
        return found

    def initialOffset(self) -> dict:
        return self._newest() | self.offsets

    def latestOffset(self) -> dict:
        # A partition that is named before it has messages stays where it is to begin.
        newest = self._newest()
        return newest | {p: max(o, newest.get(p, 0)) for p, o in self.offsets.items()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [Stretch(int(p), at, min(at + STRETCH, end[p]))
                for p in sorted(end, key=int) for at in range(start.get(p, 0), end[p], STRETCH)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        """Row groups in which the stretch lies, one after the other and ``ROWS`` messages at a time; nothing is read ahead."""
        for file in self._files().get_fragments(filter=pc.field("partition") == partition.partition):
            wanted = [g.id for g in file.row_groups if g.statistics["offset"]["max"] >= partition.start
                      and g.statistics["offset"]["min"] < partition.end]
            if not wanted:
                continue
            with file.filesystem.open_input_file(file.path) as stored:
                parquet = pq.ParquetFile(stored, buffer_size=1 << 20, pre_buffer=False)
                for batch in parquet.iter_batches(ROWS, row_groups=wanted, columns=["offset", "value"], use_threads=False):
                    batch = batch.filter((pc.field("offset") >= partition.start) & (pc.field("offset") < partition.end))
                    if batch.num_rows:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([partition.partition] * batch.num_rows, pa.int32()), batch["offset"].cast(pa.int64()), batch["value"].cast(pa.string())],
                            names=["partition", "offset", "value"])


class TopicArchive(DataSource):
    """Options: ``path``, and ``offsets``, a JSON object of partition and offset to begin at."""

    @classmethod
    def name(cls) -> str:
        return _NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Reader:
        offsets = json.loads(self.options.get("offsets", "{}"))
        return _Reader(self.options["path"], {str(p): int(o) for p, o in offsets.items()})


def archive(messages: DataFrame, path: str) -> None:
    """Adds messages (``partition``, ``offset``, ``value``) to an archive, in the order of their offsets."""
    (messages.select("partition", "offset", "value").hint("rebalance", "partition").sortWithinPartitions("partition", "offset")
     .write.mode("append").partitionBy("partition").parquet(path))


def archive_stream(spark: SparkSession, path: str, offsets: dict[int, int] | None = None) -> DataFrame:
    """``partition, offset, value`` of an archive from the given offsets on."""
    spark.dataSource.register(TopicArchive)
    given = json.dumps({str(p): o for p, o in (offsets or {}).items()})
    return spark.readStream.format(_NAME).option("path", path).option("offsets", given).load()
