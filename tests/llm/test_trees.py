"""Boosted trees and the isolation forest against plain walks and searches."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from taken import Taken

from tidemart.llm import quality_trees, rule_forest


def walk(tree, root, row, less):
    """Leaf of a row, node by node."""
    at = root
    while tree.left[at] != at:
        x, bound = row[tree.feature[at]], tree.bound[at]
        at = tree.left[at] if (x < bound if less else x <= bound) else tree.right[at]
    return at


def some(n=400, seed=2):
    random = np.random.default_rng(seed)
    x = np.stack([random.normal(size=n), random.integers(0, 5, n), np.zeros(n), random.exponential(size=n)], axis=1)
    return x, ((x[:, 0] + x[:, 1] > 2) ^ (random.random(n) < 0.05)).astype(float)


def test_scores_equal_a_walk_node_by_node():
    x, y = some()
    trees = quality_trees.fit_trees(x, y, trees=12)
    raw = [trees.base + sum(trees.value[walk(trees, r, row, False)] for r in trees.roots) for row in x]
    assert np.allclose(trees.score(x), 1 / (1 + np.exp(-np.array(raw))))
    assert np.mean((trees.score(x) >= 0.5) == (y == 1)) > 0.9


def test_the_first_split_is_the_best_of_all():
    """Over every feature and bound between bins, with as many rows on either side as are asked for."""
    x, y = some(300, 5)
    tree = quality_trees.fit_trees(x, y, trees=1, depth=1)
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))

    def gain(low):
        parts = [(g[m].sum() ** 2) / (h[m].sum() + quality_trees.SHRINK) for m in (low, ~low)]
        return sum(parts) - g.sum() ** 2 / (h.sum() + quality_trees.SHRINK)
    best = -1.0
    for f in range(x.shape[1]):
        for bound in np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality_trees.BINS + 1)[1:-1])):
            low = x[:, f] <= bound
            if min(low.sum(), (~low).sum()) >= quality_trees.LEAST_ROWS:
                best = max(best, gain(low))
    root = tree.roots[0]
    assert gain(x[:, tree.feature[root]] <= tree.bound[root]) == pytest.approx(best)
    for leaf, low in ((tree.left[root], True), (tree.right[root], False)):
        rows = (x[:, tree.feature[root]] <= tree.bound[root]) == low
        assert tree.value[leaf] == pytest.approx(-quality_trees.RATE * g[rows].sum() / (h[rows].sum() + quality_trees.SHRINK))


def test_good_rows_leave_in_small_batches(monkeypatch):
    """A batch is not built a second time as a whole; no row is lost between the parts."""
    frame = Taken(pa.schema({"doc_id": pa.int64(), "text": pa.string()}))
    texts = [None if i % 41 == 0 else f"some words {i} " * (i % 9) for i in range(1300)]
    x = np.array([quality_trees.quality_features(t or "") for t in texts])
    trees = quality_trees.fit_trees(x, np.array([float(i % 9 > 4) for i in range(1300)]), trees=5)
    scores = quality_trees._scores(trees, pa.array(texts))
    monkeypatch.setattr(quality_trees, "KEEP", float(np.median(scores)))
    batch = pa.record_batch([pa.array(range(1300), pa.int64()), pa.array(texts)], schema=frame.arrow)
    out = list(quality_trees.keep_good(frame, trees).function(iter([batch, batch.slice(0, 0), batch.slice(1299)])))
    kept = [i for i in [*range(1300), 1299] if scores[i] >= quality_trees.KEEP]
    assert max(b.num_rows for b in out) <= 512 and pa.Table.from_batches(out).column("doc_id").to_pylist() == kept
    assert [r["text"] for b in out for r in b.to_pylist()] == [texts[i] for i in kept] and len(kept) < 1301


def test_paths_equal_a_walk_node_by_node():
    x = some(600, 9)[0]
    forest = rule_forest.grow_forest(x)

    def depth(root, row):
        at, steps = root, 0
        while forest.left[at] != at:
            at, steps = (forest.left[at] if row[forest.feature[at]] < forest.bound[at] else forest.right[at]), steps + 1
        return at, steps
    usual = float(rule_forest._average_path(forest.rows))
    for row, score in zip(x[:40], forest.score(x[:40])):
        leaves = [depth(r, row) for r in forest.roots]
        # A leaf's path is its depth and what the rows left in it would add on average.
        assert all(forest.path[leaf] >= steps for leaf, steps in leaves)
        assert score == pytest.approx(2 ** (-np.mean([forest.path[leaf] for leaf, _ in leaves]) / usual))
    odd = np.array([[50.0, 4, 0, 40]])
    assert forest.score(odd)[0] > np.quantile(forest.score(x), 0.99)


def test_verdicts_follow_the_calibrated_limit(spark):
    """Against the forest's scores of all rows, worked out without Spark."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 211}" for k in range(60 + i % 50)) + (" #$%" * 40 if i % 9 == 0 else ""))
                                  for i in range(1, 200)], "doc_id BIGINT, text STRING")
    labels = spark.createDataFrame([(i, int(i % 9 != 0)) for i in range(1, 200)], "doc_id BIGINT, quality INT")
    counts = rule_forest.rule_counts(docs).collect()
    forest = rule_forest.fit_forest(rule_forest.rule_counts(docs), labels)
    scores = forest.score(rule_forest.rates(np.array([[r[n] for n in rule_forest.BASE] for r in counts])))
    plain = {r.doc_id: (bool(s <= forest.limit) and r.n_words >= 50 and 2 * r.n_repeat_words <= r.n_words) for r, s in zip(counts, scores)}
    verdicts = rule_forest.judge(rule_forest.rule_counts(docs), forest).collect()
    assert {r.doc_id: r.kept for r in verdicts} == plain
    learnt = {r.doc_id for r in quality_trees.label_sample(labels).collect()}
    good = [s for r, s in zip(counts, scores) if r.doc_id in learnt and r.doc_id % 9 and r.n_words >= 50 and 2 * r.n_repeat_words <= r.n_words]
    assert forest.limit == np.quantile(good, 1 - rule_forest.MAY_LOSE, method="higher")
    assert len({r.doc_id for r in verdicts if not r.kept and r.doc_id % 9 == 0}) > 10


def test_every_labelled_row_counts(spark, monkeypatch):
    """Each row is in a tree, also where trees get no more than a part, and the limit is that of all rows labelled good."""
    monkeypatch.setattr(rule_forest, "TREES", 4)
    monkeypatch.setattr(rule_forest, "ROWS", 8)
    random = np.random.default_rng(3)
    rows = [(i, 100, 500 + int(random.integers(90)), int(random.integers(5)), 0, 0, 10) for i in range(300)]
    rows[217] = (217, 100, 500, 90, 0, 0, 10)
    counts = spark.createDataFrame(rows, "doc_id BIGINT, " + ", ".join(f"{n} BIGINT" for n in rule_forest.BASE))
    labels = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id BIGINT, quality INT")
    seen = []
    plain = rule_forest._grown
    monkeypatch.setattr(rule_forest, "_grown", lambda found, n: seen.append((found.count(), n)) or plain(found, n))
    forest = rule_forest.fit_forest(counts, labels)
    learnt = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert seen == [(len(learnt), len(learnt))] and len(forest.roots) == 4 and forest.rows == len(learnt) // 4
    x = rule_forest.rates(np.array([r[1:] for r in learnt]))
    assert forest.limit == np.quantile(forest.score(x), 1 - rule_forest.MAY_LOSE, method="higher")


def test_score_at_is_the_exact_quantile(spark, monkeypatch):
    monkeypatch.setattr(rule_forest, "_PARTS", 3)
    values = [float(v) for v in np.random.default_rng(4).integers(0, 40, 500) / 97] + [0.125, 0.125 + 2 ** -50]
    scores = spark.createDataFrame([(v,) for v in values], "anomaly DOUBLE")
    for part in (0.0, 0.3, 0.995, 1.0):
        assert rule_forest.score_at(scores, part) == np.quantile(values, part, method="higher")
