"""State per device and day that built-in streaming operators do not have, as ``transformWithState``.

Two kinds: a device that stays known for a while after its last use, and the hour a device counts for, which an
earlier page that comes later may change. These are the mart's only Python workers. Rows of a device and day are
reduced in each task before they are sent to where its state is, so a device with very many pages sends few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemart.functions.scalars import DAY_MS, day_start, ts_to_dt, ts_to_hr
from tidemart.operators.dedup import arrival


def _by_key(batch: pa.RecordBatch, keys: list[str], order: list[str]) -> tuple[pa.Table, np.ndarray]:
    """Rows of a batch by ``keys`` and ``order``, and which of them begin another key; NULL is a key."""
    table = pa.Table.from_batches([batch])
    codes = {k: pc.dictionary_encode(table[k].combine_chunks(), null_encoding="encode").indices for k in keys}
    at = pc.sort_indices(pa.table({**codes, **{f"_{c}": table[c] for c in order}}),
                         sort_keys=[*((k, "ascending") for k in keys), *((f"_{c}", "ascending") for c in order)])
    new = np.ones(table.num_rows, dtype=bool)
    if table.num_rows > 1:
        sorted_codes = np.stack([codes[k].take(at).to_numpy(zero_copy_only=False) for k in keys])
        new[1:] = (sorted_codes[:, 1:] != sorted_codes[:, :-1]).any(axis=0)
    return table.take(at), new


class Renewed(StatefulProcessor):
    """When a key was last used. A use within ``life`` of the one before is known, whenever the first one was.

    Rows are stretches of uses, from ``_from`` to ``_until`` in milliseconds, without a gap of ``life``. Whether a
    key is still known follows from the times alone; a timer only takes unused keys out of the state, and is set
    anew when it goes off, not at each use.
    """

    def __init__(self, life: int, columns: list[str]):
        self.life, self.columns = life, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at BIGINT")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.last.get()
        last = None if known is None else known[0]
        for row in sorted(rows, key=lambda r: (r["_from"], r["_order"] is not None, r["_order"])):
            if last is None or row["_from"] - last >= self.life:
                yield Row(**{c: row[c] for c in self.columns})
            last = row["_until"] if last is None else max(last, row["_until"])
        self.last.update((last,))
        if known is None:
            self.handle.registerTimer(last + self.life)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.last.get()
        if known is not None:
            due = known[0] + self.life
            if due > expiredTimerInfo.getExpiryTimeInMs():
                self.handle.registerTimer(due)
            else:
                self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def renewed_stream(rows: DataFrame, keys: list[str], life_ms: int, order: str, at: Column | None = None,
                   late: str = "1 second") -> DataFrame:
    """The first row of each key, and again the first one after ``life_ms`` without any row of the key.

    In contrast to ``dropDuplicatesWithinWatermark`` every row renews the life of its key. Times are those of arrival;
    where ``at`` gives them, rows may come out of turn by up to ``late``. In a task, rows of a key that are less than
    ``life_ms`` apart become one. Of rows that arrive together the one with the smallest ``order`` is first. NULL keys are a
    key. Needs the RocksDB state store.
    """
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("_order BIGINT, _from BIGINT, _until BIGINT")])

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, new = _by_key(batch, keys, ["_from", "_order"])
            times = table["_from"].to_numpy()
            new[1:] |= np.diff(times) >= life_ms
            first = np.flatnonzero(new)
            until = times[np.append(first[1:], len(times)) - 1] if len(times) else times
            yield from (table.take(pa.array(first)).append_column("_until", pa.array(until, pa.int64()))
                        .combine_chunks().to_batches())

    timed = rows.withColumn("_order", F.col(order).cast("bigint")).withColumn("_from", F.unix_millis(arrival(at)))
    short = (timed.mapInArrow(stretches, schema).withColumn("_at", F.timestamp_millis("_until")).withWatermark("_at", late))
    return short.groupBy(*keys).transformWithState(
        Renewed(life_ms, rows.columns), rows.schema, outputMode="Append", timeMode="EventTime")


def dau_renewed_stream(pages: DataFrame, life_ms: int = DAY_MS, zone: str = "UTC", at: Column | None = None,
                       late: str = "1 second") -> DataFrame:
    """Devices of a day on a stream; one stays known for ``life_ms`` after its last page of that day came, not its first."""
    return renewed_stream(pages.withColumn("day_ts", day_start(F.col("ts"), zone)), ["mid", "day_ts"], life_ms, "ts", at, late)


class CountedOnce(StatefulProcessor):
    """The earliest page of a device and day, as changes of the hours' counts: +1, and -1 where an earlier page takes it over."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "ts BIGINT, hr STRING")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.first.get()
        row = min(rows, key=lambda r: r["ts"])
        if known is None:
            self.handle.registerTimer(row["_arrived"] + self.keep)
        if known is None or row["ts"] < known[0]:
            self.first.update((row["ts"], row["hr"]))
            if known is None or row["hr"] != known[1]:
                yield Row(dt=key[1], hr=row["hr"], change=1)
                if known is not None:
                    yield Row(dt=key[1], hr=known[1], change=-1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.first.clear()
        return iter([])

    def close(self) -> None:
        pass


def hour_changes_stream(pages: DataFrame, keep_ms: int = 2 * DAY_MS, zone: str = "UTC", at: Column | None = None,
                        late: str = "1 second") -> DataFrame:
    """``dt, hr, change`` of the devices first seen in an hour, for pages in any order.

    A device counts once a day, in the hour of its earliest page. A device and day are known for ``keep_ms`` after their
    first page arrived. Pages without a time belong to no day and are left out.
    """
    schema = "mid STRING, dt STRING, hr STRING, ts BIGINT, _arrived BIGINT"
    timed = pages.where("ts IS NOT NULL").select(
        "mid", ts_to_dt(F.col("ts"), zone).alias("dt"), ts_to_hr(F.col("ts"), zone).alias("hr"), "ts",
        F.unix_millis(arrival(at)).alias("_arrived"))

    def earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, new = _by_key(batch, ["mid", "dt"], ["ts"])
            yield from table.take(pa.array(np.flatnonzero(new))).combine_chunks().to_batches()

    short = (timed.mapInArrow(earliest, schema).withColumn("_at", F.timestamp_millis("_arrived")).withWatermark("_at", late))
    return short.groupBy("mid", "dt").transformWithState(
        CountedOnce(keep_ms), "dt STRING, hr STRING, change BIGINT", outputMode="Append", timeMode="EventTime")
