"""Importance resampling against a plain count over word lists."""

import math
import re
import zlib
from collections import Counter

from tidemart.llm import importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id BIGINT, text STRING, score INT, rank INT, pairs STRING"


def grams(text, lo, hi):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return words, [" ".join(words[i:i + n]) for n in range(lo, hi + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, lo, hi, buckets, least, percent):
    def bucket(gram):
        return zlib.crc32(gram.encode()) % buckets
    corpus = Counter(bucket(g) for _, text in docs for g in grams(text, lo, hi)[1])
    wanted = Counter(bucket(g) for text in target for g in grams(text, lo, hi)[1])
    s, t = sum(corpus.values()), sum(wanted.values())

    def gain(b):
        return math.floor(1000 * math.log((wanted[b] + 1.0) * (s + buckets) / ((corpus[b] + 1.0) * (t + buckets))))
    out = []
    for doc_id, text in docs:
        words, found = grams(text, lo, hi)
        weight = sum(gain(bucket(g)) for g in found) // len(found) if found else 0
        out.append([doc_id, len(found), weight, weight + importance.noise(doc_id), len(words) >= least])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    ranks = {id(r): i + 1 for i, r in enumerate(fit[:percent * len(fit) // 100])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_a_plain_count(spark):
    vocabulary = "alpha beta gamma delta Épsilon zeta-eta THETA iota99 kappa ünd".split()
    docs = [(i, " ".join(vocabulary[(i * k + k * k) % 10] for k in range(i % 40)) + "..\n\x7f") for i in range(300)]
    docs += [(None, "alpha " * 30), (None, None), (7, docs[7][1]), (400, ""), (401, None), (402, "x" * 300_000), (403, "\x00 -- _")]
    target = ["alpha beta gamma alpha", None, "", "Épsilon THETA"]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id INT, text STRING")
    df = spark.createDataFrame([(i, t, 1, 2, "c") for i, t in docs], SCHEMA).repartition(5)
    for lo, hi, buckets, least, percent in ((1, 1, 10_000, 20, 10), (1, 3, 97, 5, 50), (2, 2, 7, 0, 100)):
        got = importance.resample(df, items, "item_id", lo, hi, buckets, least, percent)
        assert rows(got) == plain(docs, target, lo, hi, buckets, least, percent)
    assert importance.resample(df.limit(0), items, "item_id").count() == 0
    assert all(r.weight >= 0 or r.n_features for r in importance.resample(df, items.limit(0), "item_id").collect())


def test_hot_rows_are_all_ranked(spark):
    """One row repeated for a third of the table shares a score; ranks stay gapless."""
    df = spark.range(1000).selectExpr("id AS doc_id", "repeat('word ', 25) AS text").union(
        spark.range(500).selectExpr("5L AS doc_id", "repeat('word ', 25) AS text"))
    got = importance.resample(df, df.limit(1).withColumnRenamed("doc_id", "item_id"), "item_id", percent=60)
    ranks = [r["rank"] for r in got.collect()]
    assert len(ranks) == 1500 and sorted(r for r in ranks if r) == list(range(1, 901))
