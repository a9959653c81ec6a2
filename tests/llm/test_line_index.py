"""The line index under many changes: what a change reads, and filters that grow."""

import glob
import shutil

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemart.llm import line_index


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING")


def line(i):
    return f"a line that several documents hold, number {i}"


def dropped(index, docs, lines):
    return {r.doc_id: r.n_dropped for r in index.drop_lines(docs, lines).collect()}


def test_a_deletion_reads_only_the_shards_of_its_lines(spark, path):
    docs = docs_of(spark, [(i, "\n".join(line(k) for k in range(40))) for i in range(1, 4)] + [(4, line(7)), (5, line(7))])
    lines = line_index.lines_of(docs)
    index = line_index.LineIndex(spark, path, shards=16)
    index.insert(lines)
    shard = index.counts().where(F.col("docs") == 5).select(index._shard()).first().shard
    for folder in glob.glob(f"{path}/batch=*/shard=*"):
        if not folder.endswith(f"shard={shard}"):
            shutil.rmtree(folder)
    index.delete(lines.where("doc_id = 5"))
    seven = docs_of(spark, [(i, line(7)) for i in range(1, 5)])
    assert dropped(index, seven, line_index.lines_of(seven)) == {1: 1, 2: 1, 3: 1, 4: 0}
    for gone in (4, 3):
        index.delete(lines.where(f"doc_id = {gone}").where(F.col("key") == line_index.lines_of(seven).first().key))
    assert dropped(index, seven, line_index.lines_of(seven)) == {1: 0, 2: 0, 3: 0, 4: 0}


def test_filters_grow_with_their_lines(spark, path):
    index = line_index.LineIndex(spark, path, shards=2)
    few = docs_of(spark, [(i, "\n".join(line(k) for k in range(8))) for i in range(1, 4)])
    index.insert(line_index.lines_of(few))
    small = {r.shard: len(r.slots) for r in index._filters().collect()}
    many = docs_of(spark, [(i, "\n".join(line(k) for k in range(3000))) for i in range(4, 7)])
    lines = line_index.lines_of(many)
    index.insert(lines)
    filters = index._filters().collect()
    assert all(len(r.slots) > 8 * small[r.shard] and not len(r.stash) for r in filters)
    assert sum(r.n for r in filters) == 3000
    held = {r.shard: line_index.CuckooFilter.of(pd.DataFrame([r.asDict()])) for r in filters}
    for r in lines.select("key", index._shard()).distinct().collect():
        assert held[r.shard].holds(np.array([int.from_bytes(r.key[:8], "big")], dtype=np.uint64)).all()
    assert dropped(index, many, lines) == {4: 3000, 5: 3000, 6: 0}
    index.delete(lines.where("doc_id <> 4"))
    # Eight lines are still held by three of the first documents and one of the second.
    assert dropped(index, many.where("doc_id = 4"), lines.where("doc_id = 4")) == {4: 0}
    assert dropped(index, few, line_index.lines_of(few)) == {1: 8, 2: 8, 3: 8}


def test_a_broken_off_change_is_run_again(spark, path, monkeypatch):
    docs = docs_of(spark, [(i, line(1)) for i in range(1, 4)])
    lines = line_index.lines_of(docs)
    index = line_index.LineIndex(spark, path, shards=4)
    index.insert(lines.where("doc_id < 3"))
    with monkeypatch.context() as broken:
        broken.setattr(index, "_nearly_full", lambda *a: 1 / 0)
        try:
            index.insert(lines.where("doc_id = 3"))
        except ZeroDivisionError:
            pass
    assert index.batch == 1
    index.insert(lines.where("doc_id = 3"))
    assert index.batch == 2 and dropped(index, docs, lines) == {1: 1, 2: 1, 3: 0}
