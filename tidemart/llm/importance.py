"""Importance resampling towards a target: hashed n-grams of all documents against those of a target corpus.

Separators of a text are collapsed to single spaces, so that one pattern between spaces finds every n-gram,
overlapping ones included; each is counted in the bucket of its CRC. What a document's n-grams are worth (the log
ratio of target to corpus in their buckets), with Gumbel noise drawn from its id, makes its score, and the
highest scores are a sample without replacement.

A text is scanned once; its bucket counts are stored and serve the corpus counts and the weights. Corpus
counts are summed inside each task first. The driver holds numbers per bucket only, whatever the corpus.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import methodcaller

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemart.llm.tables import stored

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, 2024
#: Bytes that are no part of a word become a space, A-Z lower case.
_CANONICAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
                   for c in range(256))
_GROUP = methodcaller("group")


def spans_of(n: int) -> regex.Pattern:
    """Finds runs of ``n`` words between spaces, from every word on if asked for overlapped ones."""
    return regex.compile(rb"(?<= )[^ ]+(?: [^ ]+){%d}(?= )" % (n - 1))


def bucket_counts(text: str, patterns: list[regex.Pattern], buckets: int) -> tuple[int, int, bytes]:
    """Words, n-grams, and pairs (bucket, count) as 32-bit numbers; a bucket may come more than once."""
    words = b" ".join(text.encode().translate(_CANONICAL).split())
    canonical = b" " + words + b" "
    seen: Counter[bytes] = Counter()
    for pattern in patterns:
        seen.update(map(_GROUP, pattern.finditer(canonical, overlapped=True)))
    pairs = np.empty((len(seen), 2), dtype="<u4")
    pairs[:, 0] = np.fromiter(map(zlib.crc32, seen), np.uint64, len(seen)) % buckets
    pairs[:, 1] = np.fromiter(seen.values(), np.uint32, len(seen))
    return words.count(b" ") + 1 if words else 0, seen.total(), pairs.tobytes()


def features(docs: DataFrame, key: str, shortest: int = 1, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``key``, ``n_words``, ``n_features`` and ``pairs`` of every row; a NULL text has no words."""
    schema = T.StructType([docs.schema[key], T.StructField("n_words", T.LongType()),
                           T.StructField("n_features", T.LongType()), T.StructField("pairs", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [spans_of(n) for n in range(shortest, longest + 1)]
        for batch in batches:
            found = [bucket_counts(v.as_py() or "", patterns, buckets) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.int64()),
                 pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.binary())],
                names=schema.names)

    return docs.select(key, "text").mapInArrow(run, schema)


def bucket_totals(counted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """N-grams of all rows of ``features`` by bucket. A task sends one number per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                pairs = np.frombuffer(value.as_buffer(), dtype="<u4").reshape(-1, 2)
                np.add.at(total, pairs[:, 0], pairs[:, 1])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    sums = counted.select("pairs").mapInArrow(run, "bucket INT, n BIGINT").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for row in sums.collect():  # at most one row per bucket
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed target to corpus shares, by bucket, rounded down."""
    buckets, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets))))
                     for s, t in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


def noise(doc_id: object, seed: int = SEED) -> int:
    """Thousandths of a Gumbel draw that an id fixes; a NULL id counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(counted: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """``features`` of documents with ``weight`` and ``score`` instead of their pairs."""
    schema = T.StructType([*counted.schema.fields[:3], T.StructField("weight", T.LongType()),
                           T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = []
            for n, value in zip(batch.column(2).to_pylist(), batch.column(3)):
                pairs = np.frombuffer(value.as_buffer(), dtype="<u4").reshape(-1, 2)
                weight.append(int(gain[pairs[:, 0]] @ pairs[:, 1].astype(np.int64)) // n if n else 0)
            score = [w + noise(i, seed) for w, i in zip(weight, batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(weight, pa.int64()), pa.array(score, pa.int64())], names=schema.names)

    return counted.mapInArrow(run, schema)


def ranked(scored: DataFrame, draw: int, least_words: int) -> DataFrame:
    """Adds ``rank`` from 1 to the ``draw`` highest scores of long enough documents, ties to smaller ids.

    Scores are whole thousandths within a few ten thousand values, however many rows there are: rows are
    counted per score, and only rows of one score, which noise keeps to under a thousandth of the ids of any
    one weight, are put in order together.
    """
    fit = F.col("n_words") >= least_words
    counts = (scored.where(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("high", F.floor(F.col("score") / 256)))
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("high")).rowsBetween(Window.unboundedPreceding, -1)
    high = counts.groupBy("high").agg(F.sum("n").alias("n")).select(
        "high", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("higher"))
    inside = Window.partitionBy("high").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.join(high, "high").select(
        "score", (F.col("higher") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("before"))
    first = scored.where(fit).join(before.where(F.col("before") < draw), "score")
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "weight", "n_features")
    place = F.col("before") + F.row_number().over(order)
    columns = ["doc_id", "n_features", "weight", "score"]
    near = first.withColumn("rank", F.when(place <= draw, place)).select(*columns, "rank")
    # Left out by score or by length.
    far = scored.withColumn("fits", fit).join(before.where(F.col("before") < draw).withColumn("fits", F.lit(True)),
                                              ["score", "fits"], "left_anti")
    return near.unionByName(far.select(*columns, F.lit(None).cast("bigint").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, target_key: str, shortest: int = 1, longest: int = 1,
             buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT,
             seed: int = SEED) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` of every row; ``rank`` is NULL for those not drawn.

    NULL and empty texts have no n-grams and weight 0. Rows repeated in full are rows of their own, with ranks next
    to each other. A NULL id comes last among equal scores. Without target texts all buckets lose alike; an
    empty table gives an empty result. Other columns are not looked at.
    """
    counted = stored(features(docs, "doc_id", shortest, longest, buckets), "features")
    wanted = features(target, target_key, shortest, longest, buckets)
    gain = gains(bucket_totals(counted, buckets), bucket_totals(wanted, buckets))
    scored = stored(scores(counted, gain, seed), "scores")
    draw = percent * scored.where(F.col("n_words") >= least_words).count() // 100
    return ranked(scored, draw, least_words)
