"""SimHash fingerprints and classes against brute force."""

import random
from collections import Counter

import corpus_pipeline
import xxhash
from conftest_rows import ROWS

from tidemart.llm import simhash
from tidemart.llm.components import components
from tidemart.llm.tables import read, stored
from tidemart.session import settings


def plain_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        {9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints, distance):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p
    nodes = list(root)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    return {p: find(p) for p in nodes}


def check(rows, found):
    prints = [(i, plain_print(t)) for i, t in rows]
    classes = plain_classes([p for _, p in prints], 3)
    least = {}
    for i, p in prints:
        if i is not None:
            least[classes[p]] = min(i, least.get(classes[p], i))
    want = Counter((i, f"{p:016x}", least.get(classes[p])) for i, p in prints)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == want


def test_messy_rows(messy, empty):
    check([r[:2] for r in ROWS], simhash.near_classes(messy).collect())
    assert simhash.near_classes(empty).count() == 0


def test_whole_table(spark, sf):
    docs = read(spark, sf, "documents")
    check([(r.doc_id, r.text) for r in docs.collect()], simhash.near_classes(docs).collect())


def test_crowded_buckets(spark):
    """Fingerprints around a few centres share buckets; every link still counts."""
    random.seed(5)
    prints = set()
    for _ in range(6):
        centre = random.getrandbits(64)
        for _ in range(60):
            p = centre
            for bit in random.sample(range(64), random.randint(0, 5)):
                p ^= 1 << bit
            prints.add(p)
    rows = [(f"{p:016x}", p - (1 << 64) if p >> 63 else p) for p in prints]
    nodes = spark.createDataFrame(rows, "node STRING, w0 BIGINT")
    links = simhash.near_pairs(nodes, 1, 3)
    for r in links.collect():
        assert (int(r.a, 16) ^ int(r.b, 16)).bit_count() <= 3
    root = {r.node: r.root for r in components(links).collect()}
    found = {}
    for node, _ in rows:
        found.setdefault(root.get(node, node), set()).add(int(node, 16))
    want = {}
    for p, c in plain_classes(list(prints), 3).items():
        want.setdefault(c, set()).add(p)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_no_exploded_table_is_broadcast(spark, path, monkeypatch):
    """Spark takes an exploded table for as small as it was before, and broadcasts what fits the threshold by that."""
    nodes = spark.range(200).selectExpr("lpad(hex(id * 977), 16, '0') node", "id * 977 w0")
    nodes.write.parquet(f"{path}/nodes")
    planned = []
    monkeypatch.setattr(simhash, "stored", lambda df, label: planned.append(df) or stored(df, label))
    planned.append(simhash.near_pairs(spark.read.parquet(f"{path}/nodes"), 1, 3))

    def holds(node, name):
        return node.nodeName().startswith(name) or any(holds(c, name) for c in children(node))

    def children(node):
        return [node.children().apply(i) for i in range(node.children().size())]

    def built(node):
        if node.nodeName().startswith("BroadcastHashJoin"):
            yield node.left() if node.buildSide().toString() == "BuildLeft" else node.right()
        for child in children(node):
            yield from built(child)
    # Over the size of the nodes' file and under what joins of them are taken for.
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "64k"}):
        joins = [side for df in planned for side in built(df.select("*")._jdf.queryExecution().sparkPlan())]
    assert len(planned) == 2 and joins and not any(holds(side, "Generate") for side in joins)


def test_stage_keeps_one_of_each_group(messy, empty):
    kept = simhash.drop_near_duplicates(messy)
    assert kept.columns == messy.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [1, 3, 6, 8, 9, 10, 10, 11]  # 2 copies 1; 4, 5 and a row without id are empty like 3; 7 is near 6
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_stage_finds_near_copies(spark):
    """Pairs whose five-word shingles are at least 0.8 alike: at least nine of ten are found."""
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, pairs = [], 0
    for k in range(150):
        words = random.choices(vocabulary, k=random.randint(80, 600))
        copy = list(words)
        for at in random.sample(range(len(words)), max(1, len(words) // 60)):
            copy[at] = random.choice(vocabulary)

        def grams(w):
            return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
        a, b = grams(words), grams(copy)
        if len(a & b) / len(a | b) >= 0.8:
            rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
            pairs += 1
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert pairs > 80 and all(i % 2 or i in kept for i, _ in rows)
    assert sum(i % 2 for i in kept) <= 0.1 * pairs


def test_pipeline_stage_keeps_one_of_each_fingerprint_class(spark, messy, empty):
    """The stage drops what the query's classes link, and nothing else."""
    words = [f"w{i}" for i in range(400)]
    docs = messy.unionByName(spark.createDataFrame(
        [(100, " ".join(words)), (101, " ".join([*words[:200], "x", *words[201:]])), (102, " ".join(words[::-1]))],
        "doc_id BIGINT, text STRING"), allowMissingColumns=True)
    least = {}
    for r in simhash.near_classes(docs).collect():
        if r.doc_id is not None:
            least[r.root] = min(r.doc_id, least.get(r.root, r.doc_id))
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == set(least.values())
    assert corpus_pipeline.near_dedup(spark, empty, "").count() == 0
