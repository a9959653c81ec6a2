"""The near-duplicate stage against exact Jaccard similarity of five-word shingles, by kind of edit."""

import random

import numpy as np

from tidemart.llm import shingle_join, simhash


def grams(text):
    w = text.lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def edited(rng, words, kind, vocabulary):
    """A copy of similarity 0.6 to 1 with one kind of edit."""
    copy, n = list(words), len(words)
    share = rng.uniform(0.02, 0.35)
    size = max(1, int(share * n * (0.5 if kind == "replaced" else 1)))
    at = rng.randrange(n - size)
    if kind == "spread":
        for i in rng.sample(range(n), max(1, int(share * n / 9))):
            copy[i] = rng.choice(vocabulary)
    elif kind == "replaced":
        copy[at:at + size] = rng.choices(vocabulary, k=size)
    elif kind == "added":
        copy[at:at] = rng.choices(vocabulary, k=size)
    else:
        del copy[at:at + size]
    return copy


def test_every_pair_alike_and_no_other(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, want, bands = [], [], {}
    for k in range(600):
        kind = ("spread", "replaced", "added", "cut")[k % 4]
        words = rng.choices(vocabulary, k=rng.randint(60, 500))
        texts = " ".join(words), " ".join(edited(rng, words, kind, vocabulary))
        rows += [(2 * k, texts[0]), (2 * k + 1, texts[1])]
        alike = jaccard(*texts)
        want += [2 * k] if alike >= 0.8 else [2 * k, 2 * k + 1]
        band = kind, min(int(alike * 20), 19)
        bands[band] = bands.get(band, 0) + 1
    assert all(bands.get((kind, band), 0) >= 5 for kind in ("spread", "replaced", "added", "cut") for band in (15, 16, 17))
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == want


def test_crowded_lists(spark, monkeypatch):
    """Many near copies of a few texts that share a passage: classes as over all pairs, frequent shingles or none."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=30)
    rows = []
    for _ in range(5):
        base = passage + rng.choices(vocabulary, k=70)
        for _ in range(50):
            copy = list(base)
            for i in rng.sample(range(len(copy)), rng.randint(0, 4)):
                copy[i] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    texts = [t for _, t in rows]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    for sample in (1, 32):
        monkeypatch.setattr(shingle_join, "SAMPLE", sample)
        kept = sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect())
        assert kept == sorted({find(i) for i in range(len(texts))})


def test_parities_bound_pairs_of_any_size():
    """No pair that is alike is lost, also of sets whose parities differ in number; sets that share little go."""
    random_ = np.random.default_rng(4)
    for n, least in ((10, 8), (2049, 1640), (3000, 2400), (9000, 7500), (40_000, 32_000)):
        a = np.unique(random_.integers(0, 1 << 64, n, dtype=np.uint64))
        b = np.sort(random_.choice(a, least, replace=False))  # of similarity 0.8 or just above
        c = np.unique(np.concatenate([a[:n // 20], random_.integers(0, 1 << 64, n, dtype=np.uint64)]))
        odd = [shingle_join.parities(s) for s in (a, b, c)]
        assert shingle_join.alike(a, b) and 9 * shingle_join._apart(odd[0], odd[1]) <= len(a) + len(b)
        assert shingle_join._apart(odd[1], odd[0]) == shingle_join._apart(odd[0], odd[1])
        assert not shingle_join.alike(a, c) and 9 * shingle_join._apart(odd[0], odd[2]) > len(a) + len(c)
