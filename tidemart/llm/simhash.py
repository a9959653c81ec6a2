"""Near duplicates by SimHash and multi-index hashing.

A fingerprint is one or more 64-bit words. Each 32-bit half is a segment with a table of its
own. Two fingerprints that differ in at most 3 bits of a word differ in at most one bit of one
half, so looking up every value of a half with at most one bit changed finds all such pairs; of
a flipped bit only the change from 0 to 1 is looked up, since the partner finds the other. Every
match is verified on the whole fingerprint.

Buckets may be crowded by near copies of one text. All members and look-ups are held against the
bucket's leader first; what is near the leader is linked through it. Only pairs in which one is
not near the leader are compared one by one, so no pair is lost and no group is multiplied out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemart.llm.components import components
from tidemart.llm.shingle_join import alike_classes
from tidemart.llm.tables import stored, word_blocks

SEED = 42
#: Words of a shingle, bits that may differ, 64-bit words of a fingerprint: what the query uses.
SHINGLE, DISTANCE, WORDS = 3, 3, 1


def _bit_counts(hashes: list[int], words: int) -> np.ndarray:
    """How many hashes have each bit set; words after the first are mixed from the hash."""
    h = np.array(hashes, dtype=np.uint64)
    total = np.zeros((words, 64), dtype=np.int64)
    with np.errstate(over="ignore"):
        for k in range(words):
            x = h
            if k:
                x = (h + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                x ^= x >> np.uint64(32)
            bits = np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            total[k] = bits.sum(axis=0, dtype=np.int64)
    return total


def fingerprint(data: bytes, words: int = WORDS, size: int = SHINGLE) -> list[int]:
    """Signed 64-bit words of the fingerprint of a text; all zero if it has no words."""
    counts, n = np.zeros((words, 64), dtype=np.int64), 0
    tail: list[bytes] = []
    for block in word_blocks(data.lower()):
        run = tail + block
        hashes = [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(run[i:] for i in range(size)))]
        for start in range(0, len(hashes), 8192):
            counts += _bit_counts(hashes[start:start + 8192], words)
        n += len(hashes)
        tail = run[-(size - 1):] if size > 1 else []
    if not n and tail:
        counts, n = _bit_counts([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], words), 1
    return np.packbits(counts * 2 > n, axis=1).view(">i8").astype(np.int64).ravel().tolist() if n else [0] * words


def fingerprints(docs: DataFrame, words: int = WORDS, size: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``text_hash``, ``w0``, ``w1``, ... of every row; a NULL text is as an empty one."""
    names = [f"w{i}" for i in range(words)]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType),
                           T.StructField("text_hash", T.LongType())]
                          + [T.StructField(n, T.LongType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            rows = [fingerprint(t.as_py() or b"", words, size) for t in texts]
            columns = np.array(rows, dtype=np.int64).reshape(-1, words).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c) for c in columns)], names=schema.names)

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


def _segments(words: int) -> list[Column]:
    """The halves of all words, each with its number in the bits above."""
    parts = []
    for i in range(words):
        for half, value in enumerate((F.shiftrightunsigned(f"w{i}", 32), F.col(f"w{i}").bitwiseAND(0xFFFFFFFF))):
            parts.append(value.bitwiseOR(F.lit((2 * i + half) << 32)))
    return parts


def _one_bit_more(segment: Column) -> Column:
    """The values of a segment with one more bit set."""
    unset = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda bit: F.getbit(segment, bit) == 0)
    return F.transform(unset, lambda bit: segment.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit)))


def _distance(words: int, a: str, b: str) -> Column:
    total = F.lit(0)
    for i in range(words):
        total = total + F.bit_count(F.col(f"{a}.w{i}").bitwiseXOR(F.col(f"{b}.w{i}")))
    return total


def near_pairs(nodes: DataFrame, words: int, distance: int) -> DataFrame:
    """Links ``a``, ``b`` that join up all fingerprints that the tables bring together.

    ``nodes`` has ``node`` and ``w0``, ...; each fingerprint once.
    """
    code = F.struct(*(f"w{i}" for i in range(words)), "node")
    table = nodes.select(F.explode(F.array(*_segments(words))).alias("key"), code.alias("m"))
    leaders = table.groupBy("key").agg(F.min("m").alias("leader"), F.count(F.lit(1)).alias("n"))
    # Spark takes an exploded table for no larger than before: by its own estimate it would broadcast all look-ups.
    crowded = (table.join(leaders.where("n > 1").hint("merge"), "key").where("m.node <> leader.node")
               .withColumn("near", _distance(words, "m", "leader") <= distance))
    to_leader = crowded.where("near").select(F.col("leader.node").alias("a"), F.col("m.node").alias("b"))
    apart = crowded.where("NOT near").select("key", "m")
    among = (apart.alias("x").join(table.alias("y").hint("merge"), "key")
             .where((F.col("x.m.node") != F.col("y.m.node")) & (_distance(words, "x.m", "y.m") <= distance))
             .select(F.col("x.m.node").alias("a"), F.col("y.m.node").alias("b")))

    # Look-ups carry only a short reference; the few that meet something fetch their fingerprint.
    ref = F.xxhash64(*(f"w{i}" for i in range(words)))
    flips = F.flatten(F.array(*map(_one_bit_more, _segments(words))))
    probes = nodes.select(ref.alias("ref"), F.explode(flips).alias("key"))
    targets = leaders.select("key", F.col("leader").alias("m"), (F.col("n") > 1).alias("more")).unionByName(
        apart.withColumn("more", F.lit(False)))
    met = (probes.hint("merge").join(targets, "key").join(nodes.select(ref.alias("ref"), code.alias("p")), "ref")
           .withColumn("near", _distance(words, "p", "m") <= distance))
    met = stored(met.where("near OR more").select("key", "p", "m", "near", "more"), "met")
    hits = met.where("near").select(F.col("p.node").alias("a"), F.col("m.node").alias("b"))
    # A look-up that is not near the leader is held against those that are.
    missed = met.where("NOT near AND more").select("key", "p").alias("x")
    led = crowded.where("near").select("key", "m").alias("y")
    rest = (missed.join(led, "key").where(_distance(words, "p", "m") <= distance)
            .select(F.col("p.node").alias("a"), F.col("m.node").alias("b")))
    return to_leader.union(among).union(hits).union(rest)


def near_classes(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, size: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``text_hash``, ``fingerprint`` (hex), ``component_id``, ``root`` for every row.

    ``component_id`` is the smallest ``doc_id`` whose fingerprint can be reached over links, a
    row's own included; NULL ids are passed over, and a component of such alone has NULL. With
    one word and at most 3 bits every link is found; with more words and bits a link is found if
    one of the halves differs in at most one bit. Empty, blank and NULL texts have the fingerprint
    zero and are linked like any other. Repeated rows are repeated in the result.
    """
    if words == 1 and distance > 3:
        raise ValueError("one word finds pairs of at most 3 differing bits")
    names = [f"w{i}" for i in range(words)]
    prints = stored(fingerprints(docs, words, size), "fingerprints")
    node = F.concat(*(F.lower(F.lpad(F.hex(n), 16, "0")) for n in names)).alias("node")
    nodes = stored(prints.groupBy(*names).agg(F.min("doc_id").alias("first")).select(*names, node, "first"), "nodes")
    roots = components(near_pairs(nodes, words, distance))
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(least, "root").select(*names, "root", "component_id")
    return (prints.join(classes, names)
            .select("doc_id", "text_hash", node.alias("fingerprint"), "component_id", "root"))


def _one_of_each(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of the smallest ``doc_id`` of each ``root`` of ``classes``; a class without any id keeps one text."""
    stay = (classes.groupBy("root").agg(F.min_by(F.struct("doc_id", "text_hash"), F.struct(
        F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("k"))
        .select(F.col("k.doc_id").alias("_keep_id"), F.col("k.text_hash").alias("_keep_hash")))
    return docs.join(stay, docs["doc_id"].eqNullSafe(F.col("_keep_id"))
                     & (F.xxhash64(docs["text"]) == F.col("_keep_hash")), "left_semi")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each class of ``near_classes`` stays: the one with the smallest ``doc_id``.

    Documents are linked by their fingerprints, as in the query; every such link is found. Rows equal in
    ``doc_id`` and ``text`` are one document and stay or go together. All columns are kept.
    """
    return _one_of_each(docs, near_classes(docs))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the smallest ``doc_id``.

    Documents are linked if their five-word shingles are at least 0.8 alike; every such link is found
    and each is verified on the shingles. Rows equal in ``doc_id`` and ``text`` are one document and
    stay or go together. All columns are kept; a class without any id keeps one text.
    """
    return _one_of_each(docs, alike_classes(docs))
