"""Quality of documents by gradient-boosted trees over binned document statistics.

Trees are fitted on the driver to a bounded, documented sample of labelled rows; features and scores
of all documents are worked out in tasks. Fitted trees are flattened into arrays, through which
numpy walks all rows and trees of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemart.llm.text_stats import FEATURES, quality_features

#: Labelled rows that trees are fitted to at most; those with the smallest hash of their id.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST_ROWS, SHRINK = 80, 4, 64, 0.15, 5, 1.0
#: Rows that a task scores at a time.
_AT_ONCE = 512
#: Scores of at least this are predicted to be good.
KEEP = 0.7


@dataclass
class Trees:
    """All trees in one set of arrays. A leaf leads to itself."""
    roots: np.ndarray
    feature: np.ndarray
    bound: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.bound[at], self.left[at], self.right[at])
        return 1.0 / (1.0 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Trees for log loss. Without rows every score is 1: nothing is known against a document."""
    n, width = x.shape
    rate = float(y.mean()) if n else 1.0
    base = float(np.log(np.clip(rate, 1e-6, 1 - 1e-6) / (1 - np.clip(rate, 1e-6, 1 - 1e-6))))
    nodes: list[list[float]] = []  # feature, bound, left, right, value
    roots: list[int] = []
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for f in range(width)]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1) if n else None
    raw = np.full(n, base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int) -> int:
        me = len(nodes)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        nodes.append([0, 0.0, me, me, -RATE * total_g / (total_h + SHRINK)])
        if level == depth or len(rows) < 2 * LEAST_ROWS:
            return me
        best = (1e-6, -1, -1)
        for f, e in enumerate(edges):
            if not len(e):
                continue
            b = bins[rows, f]
            gs = np.bincount(b, g[rows], len(e) + 1).cumsum()[:-1]
            hs = np.bincount(b, h[rows], len(e) + 1).cumsum()[:-1]
            count = np.bincount(b, minlength=len(e) + 1).cumsum()[:-1]
            gain = (gs ** 2 / (hs + SHRINK) + (total_g - gs) ** 2 / (total_h - hs + SHRINK)
                    - total_g ** 2 / (total_h + SHRINK))
            gain[(count < LEAST_ROWS) | (len(rows) - count < LEAST_ROWS)] = -1.0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
        _, f, k = best
        if f >= 0:
            low = bins[rows, f] <= k
            nodes[me][0], nodes[me][1] = f, float(edges[f][k])
            nodes[me][2] = grow(rows[low], g, h, level + 1)
            nodes[me][3] = grow(rows[~low], g, h, level + 1)
        return me

    def arrays() -> Trees:
        columns = list(zip(*nodes)) if nodes else [[0], [0.0], [0], [0], [0.0]]
        return Trees(np.array(roots or [0]), np.array(columns[0], dtype=np.int64), np.array(columns[1], dtype=float),
                     np.array(columns[2], dtype=np.int64), np.array(columns[3], dtype=np.int64),
                     np.array(columns[4], dtype=float), base, depth)

    if n and 0 < rate < 1:
        for _ in range(trees):
            p = 1.0 / (1.0 + np.exp(-raw))
            first = len(nodes)
            roots.append(grow(np.arange(n), p - y, p * (1 - p), 0))
            one = Trees(np.array([0]), *(np.array(c) for c in (
                [int(m[0]) for m in nodes[first:]], [m[1] for m in nodes[first:]],
                [int(m[2]) - first for m in nodes[first:]], [int(m[3]) - first for m in nodes[first:]],
                [m[4] for m in nodes[first:]])), 0.0, depth)
            score = one.score(x)
            raw += np.log(score / (1 - score))
    return arrays()


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learnt from; a row without id is not one of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def label_sample(labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``quality`` of at most ``rows`` labelled documents that may be learnt from.

    A document labelled more than once has its larger label; NULL labels and ids are passed over.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out())
    return (known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Trees:
    """Trees from a sample of labelled documents. Repeated rows of a document count once."""
    # At most ``rows`` pairs of an id and a label.
    sample = F.broadcast(label_sample(labels, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [quality_features(v.as_py() or "") for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("quality", labels.schema["quality"].dataType),
                           T.StructField("x", T.ArrayType(T.DoubleType()))])
    found = (docs.select("doc_id", "text").join(sample, "doc_id").select("doc_id", "quality", "text")
             .mapInArrow(run, schema).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x"))
             .orderBy("doc_id").collect())
    x = np.array([r.x for r in found], dtype=float).reshape(len(found), len(FEATURES))
    return fit_trees(x, np.array([float(r.quality) for r in found]))


def _scores(trees: Trees, texts: pa.Array) -> np.ndarray:
    parts = [trees.score(np.array([quality_features(v.as_py() or "") for v in texts.slice(start, _AT_ONCE)], dtype=float))
             for start in range(0, len(texts), _AT_ONCE)]
    return np.concatenate(parts) if parts else np.zeros(0)


def score_quality(docs: DataFrame, trees: Trees) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row; NULL texts score as empty ones."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()),
                           T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scores(trees, batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= KEEP).astype(np.int32))],
                names=schema.names)

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, trees: Trees) -> DataFrame:
    """The rows of ``docs`` that are predicted to be good, all columns as they are.

    They leave a task ``_AT_ONCE`` rows at most at a time, so that batches are not held twice over.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _AT_ONCE):
                part = batch.slice(start, _AT_ONCE)
                yield part.filter(pa.array(_scores(trees, part.column(at)) >= KEEP))

    return docs.mapInArrow(run, docs.schema)
