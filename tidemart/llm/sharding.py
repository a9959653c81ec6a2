"""Balanced label propagation: linked documents come together in shards of equal row counts.

Documents that share a link (here: an equal text) are neighbours. Linked documents begin in link
order, so that most links already lie in one shard; then, round by round, the documents of a link
move to the shard where most of their neighbours are, as far as that shard has room. Documents
without neighbours, whose place cuts nothing, fill what is left. How many rows a shard is to have is
settled first, and neither the labels at the start nor a move goes beyond it, so counts are at most one
apart also where every document has neighbours.

A link may hold a third of all rows. Numbers inside a link or shard are given bucket by bucket, with
offsets from the buckets' counts, so no link and no shard ever meets in one task. What does meet in one are
the counts of the buckets, a number for each 20,000 rows.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemart.llm.tables import stored

SHARDS, ROUNDS = 40, 4
#: Part of a shard that linked documents may take at first; the rest is room to move into.
FIRST_FILL = 0.95
#: Rows that a task numbers at a time, on average.
BUCKET_ROWS = 20_000


def numbered(df: DataFrame, group: list[str], order: list[str], buckets: int, name: str) -> DataFrame:
    """Adds a gapless number from 0 inside each group, in hash order of the ``order`` columns."""
    keyed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = keyed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    return (keyed.join(offsets, [*group, "_bucket"]).withColumn(
        name, F.col("_before") + F.row_number().over(inside) - 1).drop("_bucket", "_before"))


def _link_starts(links: DataFrame, buckets: int) -> DataFrame:
    """Adds where each link begins when all links are laid one after the other."""
    keyed = links.withColumn("_bucket", F.pmod(F.xxhash64("link"), F.lit(buckets))).withColumn("_all", F.lit(0))
    sums = keyed.groupBy("_all", "_bucket").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("_all").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy("link").rowsBetween(Window.unboundedPreceding, -1)
    return keyed.join(offsets, "_bucket").select(
        "link", "size", (F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("start"))


def _shard_at(sizes: list[int], place: Column) -> Column:
    """The shard that has a place (from 0) when shards of these sizes are laid one after the other."""
    return F.size(F.filter(F.array(*map(F.lit, accumulate(sizes))), lambda end: end <= place))


def _lookup(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def balanced_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot``, gapless from 0 in each shard, of every row.

    ``size`` is the bytes of the text and 16 more; a NULL text has no bytes and is linked to other
    empty ones. Counts of two shards differ by one at most, whatever the links; a link larger than
    a shard lies in as few neighbouring shards as the room allows. Rows repeated in full are
    linked, as are rows with one ``doc_id`` and one text; NULL ids are ids like others.
    """
    text = F.coalesce("text", F.lit(""))
    base = stored(docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("link"), F.monotonically_increasing_id().alias("_row")), "shard-rows")
    n = base.count()
    buckets = max(8, n // BUCKET_ROWS)
    order = ["link", "doc_id", "_row"]
    links = stored(base.groupBy("link").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "links")
    n_linked = links.agg(F.sum("size")).first()[0] or 0
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    part = max(FIRST_FILL, n_linked / max(1, n))
    first_fill = [min(q, math.ceil(part * q)) for q in quota]

    linked = numbered(base.join(links.select("link"), "link"), ["link"], ["doc_id", "_row"], buckets, "_rank")
    state = stored(linked.join(_link_starts(links, buckets), "link").select(
        "_row", "link", _shard_at(first_fill, F.col("start") + F.col("_rank")).alias("shard")), "labels")

    for _ in range(rounds):
        counts = state.groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n"))
        taken = {r.shard: r.n for r in state.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
        room = [q - taken.get(s, 0) for s, q in enumerate(quota)]
        target = counts.groupBy("link").agg(F.max_by("shard", F.struct("n", -F.col("shard"))).alias("to"),
                                            F.count(F.lit(1)).alias("parts")).where("parts > 1")
        asking = numbered(state.join(target, "link").where("shard <> to"), ["to"], ["link", "_row"], buckets, "_turn")
        moves = stored(asking.where(F.col("_turn") < _lookup(room, F.col("to"))).select("_row", "to"), "moves")
        if moves.isEmpty():
            break
        state = stored(state.join(moves, "_row", "left").select(
            "_row", "link", F.coalesce("to", "shard").alias("shard")), "labels")

    taken = {r.shard: r.n for r in state.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    free = base.join(links.select("link"), "link", "left_anti").withColumn("_all", F.lit(0))
    left = [q - taken.get(s, 0) for s, q in enumerate(quota)]
    filled = numbered(free, ["_all"], order, buckets, "_turn").withColumn("shard", _shard_at(left, F.col("_turn")))
    placed = filled.select("doc_id", "size", "text_crc32", "_row", "shard").union(
        base.join(state.select("_row", "shard"), "_row").select("doc_id", "size", "text_crc32", "_row", "shard"))
    return numbered(placed, ["shard"], ["doc_id", "_row"], max(1, buckets // shards), "slot").select(
        "doc_id", "size", "text_crc32", "shard", "slot")
