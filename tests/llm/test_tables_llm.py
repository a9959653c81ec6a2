"""Operators with SQL twins or laws of their own: lines, benchmark passages, licences, shards, classifiers."""

from collections import Counter

import numpy as np
import pytest
from check_queries import compare, connect
from conftest_rows import ROWS

import corpus_pipeline
from tidemart.llm import decontaminate, licenses, line_index, plans, quality_trees, rule_forest, sharding
from tidemart.llm.tables import read


@pytest.mark.parametrize("name", list(plans.ORACLES))
def test_query_equals_its_twin(spark, sf, name):
    problem, n = compare(spark, connect(sf), sf, plans.QUERIES[name], plans.ORACLES[name])
    assert not problem and n > 0


@pytest.mark.parametrize("name", [n for n in plans.ORACLES if n != "op13_conversation_repair"])
def test_twin_on_messy_rows(spark, messy, path, name):
    """The same comparison over rows with nulls, empty and long texts, ties and repeats."""
    for table, df in (("documents", messy), ("benchmark", spark.createDataFrame(
            [(1, "quick brown fox"), (2, "the"), (3, None), (4, ""), (None, "own line"), (5, " ".join(
                f"word{i % 997}x{i % 13}" for i in range(100, 130))), (5, "quick brown fox")], "item_id BIGINT, text STRING"))):
        df.coalesce(1).write.parquet(f"{path}/{table}.parquet")
    duck = __import__("duckdb").connect()
    for table in ("documents", "benchmark"):
        duck.execute(f"create view {table} as select * from '{path}/{table}.parquet/*.parquet'")
    problem, n = compare(spark, duck, path, plans.QUERIES[name], plans.ORACLES[name])
    assert not problem and n == len(ROWS)


def test_empty_tables(spark, empty, path):
    items = spark.createDataFrame([], "item_id BIGINT, text STRING")
    assert decontaminate.contamination(empty, items).count() == 0
    assert licenses.scan(empty, licenses.known_licenses(spark)).count() == 0
    assert line_index.drop_shared_lines(empty, path).count() == 0
    assert sharding.balanced_shards(empty).count() == 0


def test_no_items_leaves_documents_alone(spark, messy):
    items = spark.createDataFrame([], "item_id BIGINT, text STRING")
    assert decontaminate.contamination(messy, items).where("contaminated").count() == 0
    assert decontaminate.drop_contaminated(messy, items).count() == len(ROWS)


def test_line_index_is_reversible(spark, path):
    line = "a line that many documents have"
    docs = spark.createDataFrame([(i, f"{line}\nown text of document {i}, long enough") for i in range(1, 5)],
                                 "doc_id BIGINT, text STRING")
    index = line_index.LineIndex(spark, path, shards=4)
    lines = line_index.lines_of(docs)
    index.insert(lines.where("doc_id <= 2"))

    def dropped():
        return {r.doc_id: r.n_dropped for r in index.drop_lines(docs, lines).collect()}
    assert dropped() == {1: 0, 2: 0, 3: 0, 4: 0}
    index.insert(lines.where("doc_id > 1"))  # 2 is there already
    assert dropped() == {1: 1, 2: 1, 3: 1, 4: 0}
    index.delete(lines.where("doc_id = 4"))
    assert dropped() == {1: 1, 2: 1, 3: 0, 4: 1}
    index.delete(lines.where("doc_id IN (3, 4)"))  # 4 is gone already
    assert dropped() == {1: 0, 2: 0, 3: 0, 4: 0}
    index.insert(lines.where("doc_id > 2"))
    assert dropped() == {1: 1, 2: 1, 3: 1, 4: 0}


def test_cuckoo_filter():
    random = np.random.default_rng(1)
    keys = random.integers(0, 1 << 63, 4000, dtype=np.uint64)
    full = line_index.CuckooFilter.sized(1000)  # four times what it is sized for: the rest is in the stash
    for h in keys.tolist():
        full.add(h)
    assert full.stash and full.holds(keys).all()
    for h in keys[:2000].tolist():
        full.remove(h)
    assert full.holds(keys[2000:]).all() and full.holds(keys[:2000]).mean() < 0.1


def test_shards(spark, messy):
    many = [(i, "hot text" if i % 3 == 0 else f"pair {i // 4}" if i % 3 == 1 else f"text {i}") for i in range(3000)]
    docs = spark.createDataFrame(many, "doc_id BIGINT, text STRING")
    for df, shards in ((docs, 40), (messy.select("doc_id", "text"), 4), (messy, 40)):
        rows = sharding.balanced_shards(df, shards).collect()
        sizes = Counter(r.shard for r in rows)
        assert len(rows) == df.count() and set(sizes) <= set(range(shards))
        assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
        for s in sizes:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    places = {}
    for r in sharding.balanced_shards(docs, 40).collect():
        places.setdefault(r.text_crc32, set()).add(r.shard)
    hot = max(places.values(), key=len)
    assert len(hot) <= 16  # 1000 rows need 14 of 75
    assert sum(len(p) > 1 for p in places.values()) <= 12


@pytest.mark.parametrize("n, copies", [(100, 100), (4030, 2), (3999, 3), (39, 1), (39, 39), (1, 1), (41, 2), (2000, 7)])
def test_shards_are_even_without_single_rows(spark, n, copies):
    docs = spark.range(n).selectExpr("id AS doc_id", f"concat('text ', id div {copies}) AS text")
    rows = sharding.balanced_shards(docs).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == n and max(sizes.values()) - min(sizes.get(s, 0) for s in range(40)) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(k)) for s, k in sizes.items())


def test_licenses(spark):
    mit = licenses.KNOWN[0][1]
    docs = spark.createDataFrame([
        (1, "Copyright (c) 2020 Somebody\n\n" + mit.replace("sublicense", "sublicence").upper()),
        (2, mit + " and more"), (3, "text\n  released under the MIT Licence!\nmore")], "doc_id BIGINT, text STRING")
    rows = {r.doc_id: r for r in licenses.scan(docs, licenses.known_licenses(spark)).collect()}
    assert [rows[i].license for i in (1, 2, 3)] == ["MIT", None, None]
    assert (rows[3].line_licenses, rows[3].n_lines) == ("MIT", 1)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    rows = {r.doc_id: r for r in quality_trees.score_quality(docs, quality_trees.fit_quality(docs, labels)).collect()}
    held = [(rows[r.doc_id].predicted, r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    assert len(held) > 60 and np.mean([p == q for p, q in held]) >= 0.95


def test_quality_of_odd_rows(spark, messy, empty):
    none = spark.createDataFrame([], "doc_id BIGINT, quality INT")
    trees = quality_trees.fit_quality(messy, none)
    rows = quality_trees.score_quality(messy, trees).collect()
    assert len(rows) == len(ROWS) and all(r.predicted == 1 for r in rows)
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 0), (8, None), (None, 1)], "doc_id BIGINT, quality INT")
    assert all(0 <= r.score <= 1 for r in quality_trees.score_quality(messy, quality_trees.fit_quality(messy, labels)).collect())
    assert quality_trees.keep_good(empty, trees).columns == empty.columns


def test_rules(spark, messy, empty):
    sf = "/root/testdata/sf0.01"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    rows = {r.doc_id: r for r in rule_forest.rule_verdicts(docs, labels).collect()}
    good = [rows[r.doc_id] for r in labels.where("quality = 1").collect()]
    assert np.mean([r.kept or r.base_failed for r in good]) >= 0.99
    assert all(not (r.kept and r.base_failed) for r in rows.values())
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) for r in rows.values())
    none = labels.limit(0)
    assert rule_forest.rule_verdicts(messy, none).count() == len(ROWS)
    assert rule_forest.rule_verdicts(empty, none).count() == 0


def test_pipeline(spark, sf):
    docs = read(spark, sf, "documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.schema == before.schema, name
        assert 0 < after.count() <= before.count(), name
        before = after
    out = corpus_pipeline.run(spark, sf)
    assert out.count() == before.count() and {"ids", "n_tokens"} <= set(out.columns)
    texts = {r.doc_id: r.text for r in before.collect()}
    assert {r.doc_id: r.text for r in out.collect()} == texts


@pytest.mark.parametrize("constants", [0, 3])
def test_items_that_are_too_many_for_constants(spark, sf, monkeypatch, constants):
    """Item shingles as a table give the same rows as item shingles as constants."""
    monkeypatch.setattr(decontaminate, "CONSTANTS", constants)
    name = "op10_decontaminate"
    problem, n = compare(spark, connect(sf), sf, plans.QUERIES[name], plans.ORACLES[name])
    assert not problem and n > 0


def test_odd_items_as_a_table(spark, messy, monkeypatch):
    items = spark.createDataFrame([(1, "quick brown fox"), (2, "the"), (3, None), (4, ""), (None, "own line"), (5, " ".join(
        f"word{i % 997}x{i % 13}" for i in range(100, 130))), (5, "quick brown fox")], "item_id BIGINT, text STRING")

    def found():
        return sorted((tuple(r) for r in decontaminate.contamination(messy, items).collect()), key=str)
    few = found()
    monkeypatch.setattr(decontaminate, "CONSTANTS", 0)
    assert found() == few and len(few) == len(ROWS)
