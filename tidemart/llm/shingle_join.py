"""All pairs of texts whose five-word shingles are at least 0.8 alike, by prefix lists.

The distinct shingles of a text are hashed and put into one order that is the same for all texts.
Two sets of Jaccard similarity 4/5 or more have a shingle in common among the first
``n - ceil(4n/5) + 1`` of each, so texts that meet in no such shingle need not be compared, and no
pair is missed, whatever the kind of edit. Shingles that are frequent in a sample come last in the
order; the sample bears on the work alone. Pairs that meet are held against bounds that follow from
the number of shingles and from parities (256, then one per shingle), and what is left is compared shingle by shingle.

Members of a list are held against one leader first. Those that are linked by then are one class and
are not compared again; all others are compared with each member that is not of their class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemart.llm.components import components
from tidemart.llm.tables import stored, word_blocks

SEED = 42
SHINGLE = 5
#: The least Jaccard similarity, as a fraction.
PART, WHOLE = 4, 5
#: One of so many texts is looked at for frequent shingles; frequent is what so many of these hold.
SAMPLE, FREQUENT, MOST_FREQUENT = 32, 8, 200_000
#: A class of near copies is held against about so many leaders.
LEADERS = 8
_CACHED = 4 << 20


def shingles(data: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a shorter text is one shingle, a blank one has none."""
    found: list[np.ndarray] = []
    tail: list[bytes] = []
    for block in word_blocks(data.lower()):
        run = tail + block
        grams = zip(*(run[i:] for i in range(SHINGLE)))
        found.append(np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in grams), np.uint64))
        tail = run[-(SHINGLE - 1):]
    if not any(map(len, found)) and tail:
        found = [np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], np.uint64)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return WHOLE * common >= PART * (len(a) + len(b) - common)


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent shingles, sorted, and how many sampled texts hold each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py() or b"").view(np.int64))], names=["h"])

    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text")
    rows = (sample.mapInArrow(run, "h BIGINT").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).toArrow())
    hashes = rows.column("h").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], rows.column("n").to_numpy()[order]


def _prefix(own: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    n = len(own)
    size = n - -(-PART * n // WHOLE) + 1 if n else 0
    if not len(hashes):
        return own[:size]
    at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
    weight = np.where(hashes[at] == own, counts[at], 0)
    return own[np.argsort(weight, kind="stable")[:size]]


def parities(own: np.ndarray) -> bytes:
    """For each value of the hashes' last bits whether an odd number of them has it; a bit per shingle or more, 2,048 at least."""
    width = 1 << max(11, (len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _apart(a: bytes, b: bytes) -> int:
    """In how many parities two sets differ; those of the larger one are folded to the number of the smaller one's."""
    x, y = (np.frombuffer(v, np.uint8) for v in sorted((a, b), key=len))
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def sets_of(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash``, ``node`` (hash of the set), ``n``, parities ``p0``..``p3`` and
    ``odd``, and ``prefix`` of every row."""
    hashes, counts = _frequent(docs)
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text_hash", T.LongType())]
        + [T.StructField(c, T.LongType()) for c in ("node", "n", "p0", "p1", "p2", "p3")]
        + [T.StructField("odd", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, wide, prefixes = [], [], []
            for text in batch.column(2).cast(pa.binary()):
                own = shingles(text.as_py() or b"")
                odd = np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=256) & 1
                node = np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).astype(np.int64)
                rows.append([node, len(own), *np.packbits(odd.astype(np.uint8)).view(">i8").astype(np.int64)])
                wide.append(parities(own))
                prefixes.append(_prefix(own, hashes, counts).view(np.int64))
            columns = np.array(rows, dtype=np.int64).reshape(-1, 6).T
            ends = np.cumsum([0, *map(len, prefixes)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c) for c in columns), pa.array(wide, pa.binary()), lists],
                names=schema.names)

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


def _may_be_alike(a: str, b: str) -> Column:
    """Bounds that every pair alike enough keeps: sizes, and parities that differ in one set alone."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    odd = F.lit(0)
    for p in ("p0", "p1", "p2", "p3"):
        odd = odd + F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}")))
    return ((WHOLE * F.least(n_a, n_b) >= PART * F.greatest(n_a, n_b))
            & (odd * (WHOLE + PART) <= (n_a + n_b) * (WHOLE - PART)))


def _near_enough(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` that the bound by as many parities as there are shingles leaves.

    Sets that share little differ in about half of these however large they are, so hardly any text that is not
    alike enough has to be fetched.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odd = np.array([_apart(a.as_py(), b.as_py()) for a, b in zip(batch.column(3), batch.column(4))], dtype=np.int64)
            left = odd * (WHOLE + PART) <= batch.column(2).to_numpy() * (WHOLE - PART)
            yield batch.select(["a", "b"]).filter(pa.array(left))

    x = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("odd").alias("odd_a"))
    y = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("odd").alias("odd_b"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", F.expr("n_a + n_b"), "odd_a", "odd_b")
    return both.mapInArrow(run, "a BIGINT, b BIGINT")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` of nodes whose sets are alike; ``texts`` has ``node`` and ``text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[int, np.ndarray] = {}
        held = 0

        def own(node: int, text: pa.Scalar) -> np.ndarray:
            nonlocal held
            if node not in cache:
                if held > _CACHED:
                    cache.clear()
                    held = 0
                cache[node] = shingles(text.cast(pa.binary()).as_py())
                held += len(cache[node])
            return cache[node]

        for batch in batches:
            a, b, text_a, text_b = batch.columns
            a, b = a.to_pylist(), b.to_pylist()
            good = [alike(own(x, s), own(y, t)) for x, y, s, t in zip(a, b, text_a, text_b)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, g in zip(v, good) if g], pa.int64()) for v in (a, b)],
                                             names=["a", "b"])

    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"))
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a BIGINT, b BIGINT")


def alike_classes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash``, ``root`` of every row; rows joined up by links of 4/5 or more have one root.

    Blank and NULL texts are one class. Repeated rows are repeated in the result.
    """
    own = stored(sets_of(docs), "shingle-sets")
    by_key = Window.partitionBy("key")
    lead = F.min(F.struct(F.xxhash64("node", F.pmod("key", F.lit(LEADERS))), "node")).over(by_key)
    lists = (own.select("node", F.explode("prefix").alias("key"))
             .select("key", "node", lead["node"].alias("leader"), F.min("node").over(by_key).alias("least"),
                     F.max("node").over(by_key).alias("most"))
             .where("least <> most").select("key", "node", "leader").distinct())
    lists = stored(lists, "shingle-lists")
    met = lists.select("node").distinct()
    facts = ("n", "p0", "p1", "p2", "p3")
    nodes = stored(own.join(met, "node", "left_semi").groupBy("node").agg(
        F.min("text_hash").alias("text_hash"), *(F.first(c).alias(c) for c in (*facts, "odd"))), "shingle-nodes")

    def pair(a: str, b: str) -> tuple[Column, Column]:
        return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")

    def compared(pairs: DataFrame, label: str) -> DataFrame:
        """The pairs that are alike, after the bounds."""
        pairs = stored(_near_enough(pairs, nodes), f"{label}-pairs")
        wanted = nodes.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(),
                            "node", "left_semi").select("node", "text_hash")
        texts = (docs.select(F.xxhash64("text").alias("text_hash"), "text").join(wanted, "text_hash")
                 .dropDuplicates(["node"]).select("node", "text"))
        return stored(_verified(pairs, stored(texts, f"{label}-texts")), f"{label}-links")

    x, y = nodes.drop("odd").alias("x"), nodes.drop("odd").alias("y")
    led = lists.where("node <> leader").select(*pair("node", "leader")).distinct()
    first = compared(led.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node"))
                     .where(_may_be_alike("x", "y")).select("a", "b"), "led")

    # What no leader has joined up is compared with all of its list that is of another class.
    roots = components(first)
    rooted = nodes.drop("odd").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = stored(lists.join(rooted, "node").join(
        rooted.select(F.col("node").alias("leader"), F.col("root").alias("lead_root")), "leader")
        .select("key", "node", "leader", "root", "lead_root", *facts), "shingle-members")
    apart = members.where("root <> lead_root").alias("x")
    rest = (apart.join(members.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root"))
                       & (F.col("y.node") != F.col("x.leader")) & _may_be_alike("x", "y"))
            .select(*pair("x.node", "y.node")).distinct())
    second = compared(rest.join(led, ["a", "b"], "left_anti"), "rest")
    roots = components(first.union(second))
    return (own.select("doc_id", "text_hash", "node").join(roots, "node", "left")
            .select("doc_id", "text_hash", F.coalesce("root", "node").alias("root")))
