"""The accounts of streaming queries: batches, rows left out as late, rows read, used and set aside.

A query itself remembers its newest batches only. A listener adds up what every batch reports, so a loss in any
batch of a long replay is known at its end. What is kept per query are sums and the first batch that is wrong.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass, field
from weakref import WeakSet

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

# Names under which a stream's own counts come with the progress of a batch.
_READ, _JUDGED = "read", "judged"


@dataclass
class Account:
    batches: int = 0
    late: int = 0
    read: int = 0
    used: int = 0
    set_aside: int = 0
    newest: int = -1
    wrong_batch: int | None = None
    ended: threading.Event = field(default_factory=threading.Event)


_runs: dict[str, Account] = {}
_listening: WeakSet[SparkSession] = WeakSet()


class _Book(StreamingQueryListener):
    def onQueryStarted(self, event) -> None:
        _runs.setdefault(str(event.runId), Account())

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        account = _runs.setdefault(str(progress.runId), Account())
        if progress.batchId <= account.newest:
            return
        account.newest = progress.batchId
        account.batches += 1
        account.late += sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)
        came, judged = progress.observedMetrics.get(_READ), progress.observedMetrics.get(_JUDGED)
        if came is None or judged is None:
            return
        account.read += came["n"]
        account.used += judged["used"]
        account.set_aside += judged["set_aside"]
        if came["n"] != judged["used"] + judged["set_aside"] and account.wrong_batch is None:
            account.wrong_batch = progress.batchId

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        _runs.setdefault(str(event.runId), Account()).ended.set()


def keep(spark: SparkSession) -> None:
    """From now on accounts are kept of the queries that the session starts."""
    if spark not in _listening:
        spark.streams.addListener(_Book())
        _listening.add(spark)


def read(raw: DataFrame) -> DataFrame:
    """Messages that report how many came."""
    return raw.observe(_READ, F.count(F.lit(1)).alias("n"))


def judged(checked: DataFrame) -> DataFrame:
    """Decoded records (with ``fault``) that report how many are used and how many set aside."""
    good = F.col("fault").isNull()
    return checked.observe(_JUDGED, F.count_if(good).alias("used"), F.count_if(~good).alias("set_aside"))


def account(query: StreamingQuery) -> Account:
    """What is known of a query so far."""
    found = _runs.get(str(query.runId))
    if found is None:
        raise ValueError("accounts are kept of queries that start after accounts.keep")
    return found


def settled(query: StreamingQuery, timeout: float = 60) -> Account:
    """The account of a query that has ended; raises if rows were lost or do not add up."""
    found = account(query)
    if not found.ended.wait(timeout):
        raise TimeoutError("the end of the query was not reported")
    if found.late:
        raise RuntimeError(f"{found.late} rows came behind the watermark and were left out")
    if found.wrong_batch is not None:
        raise RuntimeError(f"batch {found.wrong_batch} read rows that were neither used nor set aside")
    return found
