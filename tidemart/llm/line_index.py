"""Reversible dropping of lines that many documents share.

``LineIndex`` keeps, in a shared folder, an exact table of references (which document holds which
line, with +1 when it came and -1 when it went) and, for each shard of line keys, a cuckoo filter
of the lines that at least ``min_docs`` documents hold. A batch of documents first asks the filters,
which are small and never miss such a line; only what they let through meets the exact table.
Deleting documents takes lines out of the filters again as they fall below the bound.

References lie in a folder per shard. A change looks at the references of its own lines only, in the shards that have
them, so it costs what the change and these shards cost, however many documents came before. A filter that is
nearly full is built anew, twice as large as it has to be, from the exact table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart.llm.tables import ascii_lower, stored

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys of one shard that a task holds at a time, on average; the number of shards follows from it.
SHARD_KEYS = 100_000
_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
_FILTER = "shard INT, n BIGINT, slots BINARY, stash BINARY"
_REFS = "key BINARY, doc_id BIGINT, step INT, batch INT, shard INT"
#: Part of a filter's places that may be taken before it is built anew.
FULL = 0.9


class CuckooFilter:
    """16-bit fingerprints in buckets of four; what finds no place stands in a stash, so nothing is lost."""

    KICKS = 200

    def __init__(self, slots: np.ndarray, stash: list[int]):
        self.slots, self.stash = slots, stash

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        buckets = 1 << max(4, (2 * n // 4).bit_length())
        return cls(np.zeros((buckets, 4), dtype=np.uint16), [])

    @staticmethod
    def _spread(mark):
        """Distance between the two buckets of a fingerprint."""
        return (mark * 0x5BD1E995) & 0x7FFFFFFF

    def _places(self, h: int) -> tuple[int, int, int]:
        mark, last = (h >> 48) or 1, len(self.slots) - 1
        first = h & last
        return mark, first, (first ^ self._spread(mark)) & last

    def _put(self, bucket: int, mark: int) -> bool:
        row = self.slots[bucket]
        for i in range(4):
            if not row[i]:
                row[i] = mark
                return True
        return False

    def add(self, h: int) -> None:
        mark, bucket, other = self._places(h)
        if self._put(bucket, mark) or self._put(other, mark):
            return
        moved = []
        for kick in range(self.KICKS):
            slot = (mark + kick) % 4
            moved.append((bucket, slot))
            mark, self.slots[bucket, slot] = int(self.slots[bucket, slot]), mark
            bucket = (bucket ^ self._spread(mark)) & (len(self.slots) - 1)
            if self._put(bucket, mark):
                return
        for bucket, slot in reversed(moved):  # back to how it was
            mark, self.slots[bucket, slot] = int(self.slots[bucket, slot]), mark
        self.stash.append(h)

    def remove(self, h: int) -> None:
        """Only for what was added."""
        if h in self.stash:
            self.stash.remove(h)
            return
        mark, first, second = self._places(h)
        for bucket in (first, second):
            for i in range(4):
                if self.slots[bucket, i] == mark:
                    self.slots[bucket, i] = 0
                    return

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        last = len(self.slots) - 1
        mark = (hashes >> np.uint64(48)).astype(np.int64)
        mark[mark == 0] = 1
        first = (hashes & np.uint64(last)).astype(np.int64)
        second = (first ^ self._spread(mark)) & last
        found = ((self.slots[first] == mark[:, None]).any(1)) | ((self.slots[second] == mark[:, None]).any(1))
        return found | np.isin(hashes, np.array(self.stash, dtype=np.uint64))

    @property
    def held(self) -> int:
        return int(np.count_nonzero(self.slots)) + len(self.stash)

    def row(self, shard: int) -> pd.DataFrame:
        return pd.DataFrame({"shard": [shard], "n": [self.held], "slots": [self.slots.tobytes()],
                             "stash": [np.array(self.stash, dtype=np.uint64).tobytes()]})

    @classmethod
    def of(cls, rows: pd.DataFrame, room: int = 0) -> CuckooFilter:
        if not len(rows):
            return cls.sized(room)
        slots = np.frombuffer(rows["slots"].iloc[0], dtype=np.uint16).reshape(-1, 4).copy()
        return cls(slots, np.frombuffer(rows["stash"].iloc[0], dtype=np.uint64).tolist())


def _hashes(keys: pd.Series) -> np.ndarray:
    return np.array([int.from_bytes(k[:8], "big") for k in keys], dtype=np.uint64)


def _changed(changes: pd.DataFrame, current: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter after the lines that came over the bound (``step`` 1) or fell below it (-1)."""
    filter_ = CuckooFilter.of(current, len(changes))
    for h, step in zip(_hashes(changes["key"]).tolist(), changes["step"]):
        (filter_.add if step > 0 else filter_.remove)(h)
    shard = int((changes if len(changes) else current)["shard"].iloc[0])
    return filter_.row(shard)


def _let_through(keys: pd.DataFrame, current: pd.DataFrame) -> pd.DataFrame:
    if not len(keys) or not len(current):
        return keys.head(0)[["key"]]
    return keys.loc[CuckooFilter.of(current).holds(_hashes(keys["key"])), ["key"]]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(_BLANKS)))


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash``, ``pos`` from 0 and ``key`` (a digest) of every line that is long enough."""
    return (docs.select("doc_id", F.xxhash64("text").alias("text_hash"),
                        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
            .select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("line"))
            .where(F.char_length("line") >= MIN_CHARS)
            .select("doc_id", "text_hash", "pos", F.unhex(F.md5("line")).alias("key")))


class LineIndex:
    """References and filters under ``path``. Each change has a batch number of its own, counted up.

    A change writes its references, then its filters, in new folders. A batch that broke off is
    run again under the same number and leaves the same files.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int, min_docs: int = MIN_DOCS):
        self.spark, self.path, self.shards, self.min_docs, self.batch = spark, path, shards, min_docs, 0

    def _refs(self, upto: int, keys: DataFrame | None = None) -> DataFrame:
        """References of the batches up to one, of ``keys`` (with ``shard``, distinct) alone if these are given."""
        refs = self.spark.createDataFrame([], _REFS)
        if upto:
            refs = self.spark.read.schema(_REFS).option("basePath", self.path).option("mergeSchema", "false").parquet(
                *(f"{self.path}/batch={i}" for i in range(1, upto + 1)))
        if keys is not None:
            # A number per shard; folders of other shards are not read.
            touched = [r.shard for r in keys.select("shard").distinct().collect()]
            refs = refs.where(F.col("shard").isin(touched)).join(keys.select("key"), "key", "left_semi")
        return refs

    def counts(self, keys: DataFrame | None = None, upto: int | None = None) -> DataFrame:
        """``key``, ``docs``, ``last``: how many documents hold a line, and the largest id of them."""
        holders = self._refs(self.batch if upto is None else upto, keys).groupBy("key", "doc_id").agg(F.sum("step").alias("n")).where("n > 0")
        return holders.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last"))

    def _filters(self) -> DataFrame:
        if not self.batch:
            return self.spark.createDataFrame([], _FILTER)
        return self.spark.read.schema(_FILTER).parquet(f"{self.path}/filters-{self.batch}")

    def _shard(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int").alias("shard")

    def _change(self, lines: DataFrame, step: int) -> None:
        pairs = lines.where("doc_id IS NOT NULL").select("key", "doc_id").distinct()
        if self.batch or step < 0:
            # A document that is there already is not counted twice, one that is not is not taken out.
            asked = lines.select("key").distinct().select("key", self._shard())
            there = (self._refs(self.batch, asked).groupBy("key", "doc_id").agg(F.sum("step").alias("n"))
                     .where("n > 0").select("key", "doc_id"))
            pairs = pairs.join(there, ["key", "doc_id"], "left_anti" if step > 0 else "left_semi")
        number, earlier = self.batch + 1, self._filters()
        (pairs.select("key", "doc_id", F.lit(step).alias("step"), self._shard()).hint("rebalance", "shard")
         .write.mode("overwrite").partitionBy("shard").parquet(f"{self.path}/batch={number}"))
        new = self._refs(number).where(F.col("batch") == number)
        touched = new.select("key", "shard").distinct()
        # Documents that hold a touched line after the change, and before it.
        own = new if number == 1 else self._refs(number, touched)
        holders = own.groupBy("key", "doc_id").agg(
            F.sum("step").alias("after"), F.sum(F.when(F.col("batch") < number, F.col("step")).otherwise(0)).alias("before"))
        many = holders.groupBy("key").agg(*((F.count_if(F.col(c) > 0) >= self.min_docs).alias(c) for c in ("before", "after")))
        changes = many.where("before <> after").select(
            self._shard(), "key", F.when(F.col("after"), 1).otherwise(-1).alias("step"))
        if number > 1:
            changes = stored(changes, "line-changes")
            full = self._nearly_full(earlier, changes)
            if full:
                anew = self._refs(number).where(F.col("shard").isin(full)).select("key", "shard").distinct()
                whole = self.counts(anew, number).where(F.col("docs") >= self.min_docs).select(self._shard(), "key", F.lit(1).alias("step"))
                changes = changes.where(~F.col("shard").isin(full)).unionByName(whole)
                earlier = earlier.where(~F.col("shard").isin(full))
        (changes.groupBy("shard").cogroup(earlier.groupBy("shard")).applyInPandas(_changed, _FILTER)
         .write.mode("overwrite").parquet(f"{self.path}/filters-{number}"))
        self.batch = number

    def _nearly_full(self, filters: DataFrame, changes: DataFrame) -> list[int]:
        """Shards whose filter would have too few places left."""
        coming = changes.groupBy("shard").agg(F.count_if(F.col("step") > 0).alias("more"))
        places = F.octet_length("slots") / 2
        return [r.shard for r in filters.join(coming, "shard").where(
            (F.col("n") + F.col("more") > FULL * places) | (F.octet_length("stash") > 0)).select("shard").collect()]

    def insert(self, lines: DataFrame) -> None:
        """Counts the ``lines_of`` new documents. Rows with one ``doc_id`` are one document; without, none."""
        self._change(lines, 1)

    def delete(self, lines: DataFrame) -> None:
        """Takes documents out again, given as they were put in."""
        self._change(lines, -1)

    def repeated(self, keys: DataFrame) -> DataFrame:
        """``key``, ``last`` of those ``keys`` that ``min_docs`` documents or more hold."""
        asked = keys.select("key").distinct().select(self._shard(), "key")
        maybe = (asked.groupBy("shard").cogroup(self._filters().groupBy("shard"))
                 .applyInPandas(_let_through, "key BINARY"))
        known = self.counts() if self.batch <= 1 else self.counts(stored(maybe.select("key", self._shard()), "asked-lines"))
        return maybe.join(known, "key").where(F.col("docs") >= self.min_docs).select("key", "last")

    def drop_lines(self, docs: DataFrame, lines: DataFrame) -> DataFrame:
        """``docs``, given with their ``lines_of``, without repeated lines; plus ``n_lines`` (before) and ``n_dropped``.

        A line stays in the document with the largest id that holds it. A NULL or empty text is
        one empty line and gives an empty text; a text may lose all its lines and stays as an empty
        one. Rows without id lose repeated lines. Columns of the two new names are replaced, all
        others are kept as they are.
        """
        drops = (lines.join(self.repeated(lines), "key").where("NOT (doc_id <=> last)")
                 .groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("_drops"))
                 .withColumnsRenamed({"doc_id": "_drop_id", "text_hash": "_drop_hash"}))
        joined = docs.join(drops, docs["doc_id"].eqNullSafe(F.col("_drop_id"))
                           & (F.xxhash64(docs["text"]) == F.col("_drop_hash")), "left").select(*docs.columns, "_drops")
        text, drops = F.coalesce("text", F.lit("")), F.coalesce("_drops", F.array().cast("array<int>"))
        # What a lambda is given is worked out once: the text is not split again for each line.
        left = F.element_at(F.transform(F.array(F.split(text, "\n")), lambda parts: F.array_join(F.transform(
            F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), drops), lambda i: parts[i]), "\n")), 1)
        return joined.select(
            *(F.when(F.col("_drops").isNull(), text).otherwise(left).alias("text") if c == "text" else c
              for c in docs.columns if c not in ("n_lines", "n_dropped")),
            F.size(F.split(text, "\n")).cast("long").alias("n_lines"), F.size(drops).cast("long").alias("n_dropped"))


def drop_shared_lines(docs: DataFrame, path: str) -> DataFrame:
    """``drop_lines`` with an index of the documents themselves, whose shards follow the number of lines."""
    lines = stored(lines_of(docs), "lines")
    index = LineIndex(docs.sparkSession, path, max(8, -(-lines.count() // SHARD_KEYS)))
    index.insert(lines)
    return index.drop_lines(docs, lines)
