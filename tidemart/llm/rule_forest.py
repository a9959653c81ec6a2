"""Quality rules: fixed rules on counts, and an isolation forest over the same counts.

The forest splits at random; documents whose counts are unlike others' end up alone after few splits. A corpus
may hold so much junk that junk is no anomaly in it, so paths are counted over rows labelled good, and rows
labelled bad only stretch the ranges that splits are drawn from. Every labelled row is in at least one tree, and
how short a path is too short follows from the scores of all rows labelled good, so that nearly all of them are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemart.llm.quality_trees import held_out
from tidemart.llm.tables import stored
from tidemart.llm.text_stats import BASE, base_counts

#: Trees, and the documents that each gets at least, if there are so many; no row is left out of all trees.
TREES, ROWS, SEED = 128, 256, 7
#: Parts into which a range of scores is cut when one of given rank is looked for.
_PARTS = 4_096
#: Share of rows labelled good that the forest may reject.
MAY_LOSE = 0.005


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth at which one of ``n`` rows is alone."""
    n = np.asarray(n, dtype=float)
    steps = 2.0 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, steps, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees in flat arrays; a leaf leads to itself. ``path`` is a leaf's depth and what its rows would add."""
    roots: np.ndarray
    feature: np.ndarray
    bound: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    depth: int
    rows: int
    limit: float = np.inf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the larger, the sooner alone."""
        if not len(self.roots):
            return np.zeros(len(x))
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] < self.bound[at], self.left[at], self.right[at])
        return 2.0 ** (-self.path[at].mean(axis=1) / max(1e-9, float(_average_path(self.rows))))


def _depth(size: int) -> int:
    return max(1, int(np.ceil(np.log2(max(2, min(ROWS, size))))))


def grow_tree(x: np.ndarray, counted: np.ndarray, depth: int, random: np.random.Generator) -> list[list[float]]:
    """Nodes (feature, bound, left, right, path) of a tree; rows that are not counted only stretch the ranges.

    Splits follow from the set of rows, whatever order they come in.
    """
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, level: int) -> int:
        me, n = len(nodes), int(counted[rows].sum())
        nodes.append([0, 0.0, me, me, level + float(_average_path(n))])
        spread = np.flatnonzero(x[rows].min(0) < x[rows].max(0)) if n > 1 and level < depth else ()
        if len(spread):
            f = int(random.choice(spread))
            bound = float(random.uniform(x[rows, f].min(), x[rows, f].max()))
            low = x[rows, f] < bound
            nodes[me][:2] = f, bound
            nodes[me][2] = grow(rows[low], level + 1) if low.any() else me
            nodes[me][3] = grow(rows[~low], level + 1)
        return me

    grow(np.arange(len(x)), 0)
    return nodes


def _forest(trees: list[list[list[float]]], depth: int, rows: int) -> Forest:
    roots = np.cumsum([0, *map(len, trees)], dtype=np.int64)[:-1] if trees else np.zeros(0, np.int64)
    nodes = [(f, bound, int(left) + at, int(right) + at, path) for at, tree in zip(roots, trees) for f, bound, left, right, path in tree]
    columns = list(zip(*nodes)) or [[], [], [], [], []]
    return Forest(np.array(roots, dtype=np.int64), np.array(columns[0], dtype=np.int64), np.array(columns[1], dtype=float),
                  np.array(columns[2], dtype=np.int64), np.array(columns[3], dtype=np.int64),
                  np.array(columns[4], dtype=float), depth, rows)


def grow_forest(x: np.ndarray) -> Forest:
    """A forest of rows that are at hand."""
    random = np.random.default_rng(SEED)
    size = min(ROWS, len(x))
    trees = [grow_tree(x[random.choice(len(x), size, replace=False)], np.ones(size, bool), _depth(size), random)
             for _ in range(TREES)] if size else []
    return _forest(trees, _depth(size), size)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rates(counts: np.ndarray) -> np.ndarray:
    """What the forest looks at, from columns in the order of ``BASE``."""
    words, chars, symbols, dup, repeat, lines = counts.reshape(-1, len(BASE)).astype(float).T
    percent = [100 * symbols / np.maximum(chars, 1), 100 * dup / np.maximum(lines, 1), 100 * repeat / np.maximum(words, 1)]
    return np.stack([chars / np.maximum(words, 1), *map(np.log1p, percent)], axis=1)


def rule_counts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of every row; a NULL text has no words and one empty line."""
    schema = T.StructType([docs.schema["doc_id"]] + [T.StructField(n, T.LongType()) for n in BASE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.array([base_counts(v.as_py() or "") for v in batch.column(1)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c) for c in counts.reshape(-1, len(BASE)).T)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _known(labels: DataFrame) -> DataFrame:
    """``doc_id``, ``quality`` of all labelled documents that may be learnt from, as ``label_sample`` has them."""
    return (labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out())
            .groupBy("doc_id").agg(F.max("quality").alias("quality")))


def _grown(rows: DataFrame, n: int) -> Forest:
    """A forest of all ``rows`` (``doc_id``, counts, ``counted``), of which ``n`` are counted.

    Rows are dealt to trees by their id, each to as many as it takes for trees of ``ROWS`` rows. A tree is grown where
    its rows are, a part of ``TREES``; the driver gets its nodes, which the depth bounds.
    """
    each = min(TREES, -(-TREES * ROWS // max(1, n)))
    first, step = F.xxhash64("doc_id"), F.xxhash64("doc_id", F.lit(SEED)).bitwiseOR(F.lit(1).cast("bigint"))
    # An odd step leads to another tree each time, as their number is a power of two.
    trees = F.transform(F.sequence(F.lit(0), F.lit(each - 1)),
                        lambda i: F.pmod(F.pmod(first, F.lit(TREES)) + i * F.pmod(step, F.lit(TREES)), F.lit(TREES)).cast("int"))
    dealt = rows.select(F.explode(trees).alias("tree"), *BASE, "counted")
    depth = _depth(min(ROWS, n))
    names = ["feature", "bound", "left", "right", "path"]

    def grow(group: pa.Table) -> pa.Table:
        x = rates(np.stack([group.column(c).to_numpy() for c in BASE], axis=1))
        tree = group.column("tree")[0].as_py()
        counted = group.column("counted").to_numpy(zero_copy_only=False).astype(bool)
        nodes = np.array(grow_tree(x, counted, depth, np.random.default_rng([SEED, tree])), dtype=float)
        size = len(nodes)
        return pa.table({"tree": pa.array([tree] * size, pa.int32()), "node": pa.array(range(size), pa.int32()),
                         **{c: pa.array(v) for c, v in zip(names, nodes.T)}})

    schema = "tree INT, node INT, " + ", ".join(f"{c} DOUBLE" for c in names)
    grown = dealt.groupBy("tree").applyInArrow(grow, schema).toArrow().sort_by([("tree", "ascending"), ("node", "ascending")])
    found: dict[int, list[list[float]]] = {}
    for tree, *node in zip(*(grown.column(c).to_pylist() for c in ("tree", *names))):
        found.setdefault(tree, []).append(node)
    return _forest(list(found.values()), depth, max(1, n * each // TREES) if n else 0)


def score_at(scores: DataFrame, part: float) -> float:
    """The exact quantile of ``anomaly`` that ``numpy.quantile`` with method ``higher`` gives.

    The range in which it lies is cut into parts whose rows are counted, until one value is left.
    """
    n, low, high = scores.agg(F.count("anomaly"), F.min("anomaly"), F.max("anomaly")).first()
    rank = int(np.ceil(part * (n - 1)))
    while low < high:
        at = F.least(F.floor((F.col("anomaly") - low) / (high - low) * _PARTS), F.lit(_PARTS - 1))
        counts = (scores.where(F.col("anomaly").between(low, high)).groupBy(at.alias("part"))
                  .agg(F.count(F.lit(1)).alias("n"), F.min("anomaly").alias("low"), F.max("anomaly").alias("high")).orderBy("part").collect())
        for found in counts:
            if rank < found.n:
                break
            rank -= found.n
        low, high = found.low, found.high
    return float(low)


def fit_forest(counts: DataFrame, labels: DataFrame) -> Forest:
    """A forest from all labelled rows of ``rule_counts``, its limit from all rows labelled good.

    Only documents that pass the base rules are looked at. Without rows labelled good the forest
    is grown from all documents and rejects nothing.
    """
    passed = counts.where(~base_failed())
    one = passed.groupBy("doc_id").agg(*(F.min(n).alias(n) for n in BASE))
    learnt = stored(one.join(_known(labels), "doc_id").withColumn("counted", F.col("quality") == 1).drop("quality"), "rule-labels")
    good = learnt.where("counted")
    n = good.count()
    if not n:
        everything = stored(one.withColumn("counted", F.lit(True)), "rule-rows")
        return _grown(everything, everything.count())
    forest = _grown(learnt, n)
    forest.limit = score_at(stored(judge(good.select(*BASE), forest).select("anomaly"), "rule-scores"), 1 - MAY_LOSE)
    return forest


def judge(counts: DataFrame, forest: Forest) -> DataFrame:
    """``counts`` with ``base_failed``, the forest's ``anomaly`` (0 to 1) and ``kept``."""
    marked = counts.withColumn("base_failed", base_failed())
    schema = T.StructType([*marked.schema.fields, T.StructField("anomaly", T.DoubleType()),
                           T.StructField("kept", T.BooleanType())])
    first, failed_at = marked.columns.index(BASE[0]), marked.columns.index("base_failed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [batch.column(first + i).to_numpy(zero_copy_only=False) for i in range(len(BASE))]
            scores = forest.score(rates(np.stack(numbers, axis=1)))
            failed = batch.column(failed_at).to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores), pa.array(~failed & (scores <= forest.limit))], names=schema.names)

    return marked.mapInArrow(run, schema)


def rule_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdict of every row. Repeated rows are repeated in the result."""
    counts = stored(rule_counts(docs), "rule-counts")
    return judge(counts, fit_forest(counts, labels))
