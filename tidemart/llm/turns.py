"""Repair of the turns of a conversation by weighted interval parsing.

A well-formed conversation is one optional system turn and then pairs of user and assistant. A row may be kept,
given another role, or deleted, and empty turns may be inserted anywhere; the cheapest edits are wanted. The
grammar in Chomsky normal form has a nonterminal for each pair of states (p, q) of that shape, "leads from p to
q", with the rules (p, q) -> (p, r) (r, q). A cell holds, per nonterminal, the least (cost, audit) of a span,
audits being the edits' initials. Cells of one row are closed under insertion on both sides; longer spans are
combined bottom-up by length.

Costs and audits of a span do not depend on what stands beside it: among edits of one span with one cost no
audit is the beginning of another (they would differ by insertions, which cost), so the least audit stays least
in any longer span. And every way through a span passes some state at any given place, so spans beyond a block
of rows need one split only. That lets a conversation be cut anywhere: rows are sorted over all tasks, a task
parses what it has of a conversation, and the parts' cells are combined. Only the digest of a repaired
conversation is made in one task, as a stream of sorted rows that are not held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemart.llm.tables import stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows of a block, in which all splits of all spans are tried.
BLOCK = 8
#: Rows that a task sorts and parses, on average.
TASK_ROWS = 200_000
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
_NEXT_USER, _NEXT_ASSISTANT = (BEGIN, SYSTEM, ASSISTANT), (USER,)
_BLANKS = " \t\n\x0b\x0c\r"

Cell = dict[tuple[int, int], tuple[int, str]]


def _better(cell: Cell, pair: tuple[int, int], way: tuple[int, str]) -> None:
    if pair not in cell or way < cell[pair]:
        cell[pair] = way


def combined(left: Cell, right: Cell) -> Cell:
    """The cell of a span from the cells of its two parts."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in range(4):
            way = right.get((r, q))
            if way is not None:
                _better(out, (p, q), (cost + way[0], audit + way[1]))
    return out


def _closure() -> Cell:
    """Insertions alone: from each state to each other one, the shortest way."""
    one: Cell = {(s, s): (0, "") for s in range(4)}
    one |= {(s, USER): (INSERT, "I") for s in _NEXT_USER} | {(s, ASSISTANT): (INSERT, "I") for s in _NEXT_ASSISTANT}
    return combined(one, one)


@lru_cache(maxsize=None)
def _row(letter: str) -> Cell:
    """The cell of one row, insertions around it included.

    Letters are the role's initial s, u, a or another (o), as a capital if the text is cut off; x must go.
    """
    ways: Cell = {(s, s): (DELETE, "D") for s in range(4)}
    if letter != "x":
        more = TRUNCATED if letter.isupper() else 0
        to = {s: USER for s in _NEXT_USER} | {s: ASSISTANT for s in _NEXT_ASSISTANT}
        for state, after in to.items():
            _better(ways, (state, after), (REROLE + more, "R"))
        kept = {"s": {BEGIN: SYSTEM}, "u": {s: USER for s in _NEXT_USER}, "a": {s: ASSISTANT for s in _NEXT_ASSISTANT}}
        for state, after in kept.get(letter.lower(), {}).items():
            _better(ways, (state, after), (KEEP + more, "K"))
    inserted = _closure()
    return combined(combined(inserted, ways), inserted)


@lru_cache(maxsize=1 << 14)
def parse_block(letters: str) -> Cell:
    """The cell of a block: all spans, the shorter first, each from all its splits."""
    chart = {(i, i + 1): _row(letter) for i, letter in enumerate(letters)}
    for length in range(2, len(letters) + 1):
        for i in range(len(letters) - length + 1):
            cell: Cell = {}
            for k in range(i + 1, i + length):
                for pair, way in combined(chart[i, k], chart[k, i + length]).items():
                    _better(cell, pair, way)
            chart[i, i + length] = cell
    return chart[0, len(letters)]


def joined(cells: list[Cell]) -> Cell:
    """The cell of consecutive spans, neighbours first, so that spans double."""
    while len(cells) > 1:
        cells = [combined(*cells[i:i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def cheapest(cell: Cell) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return min(cell[BEGIN, q] for q in (BEGIN, ASSISTANT) if (BEGIN, q) in cell)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: by crc32 of ``conv_id:turn`` modulo 20 a row is dropped (0), emptied (1),
    without ``[.!?]`` (2), there twice (3), or the user's (4). NULLs in texts made of columns are one space.
    """
    space = F.lit(" ")
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fate = F.crc32(key.cast("binary")) % 20
    return conversations.where(fate != 0).select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fate == 3, 2).otherwise(1).cast("long").alias("copies"))


def marked(rows: DataFrame) -> DataFrame:
    """Equal rows of a conversation and turn as one with their number (``copies``), and what is wrong with it.

    ``blank`` goes before all else; ``first`` is true where no earlier row of the conversation has the role and
    text, turns without a number being the earliest; ``cut`` says that the text ends without ``.``, ``!`` or ``?``.
    """
    bare = F.btrim("text", F.lit(_BLANKS))
    base = stored(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).select(
        "*", F.monotonically_increasing_id().alias("row"), F.sha2("text", 256).alias("digest"),
        (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut")), "turns")
    # A role and text may be a third of all rows: the earliest is found by an aggregate and joined by row.
    earliest = (base.where(~F.col("blank")).groupBy("conv_id", "role", "digest")
                .agg(F.min_by("row", F.struct(F.col("turn").isNotNull(), "turn")).alias("row"))
                .select("row", F.lit(True).alias("first")))
    return base.join(earliest, "row", "left").withColumn("first", F.coalesce("first", F.lit(False)))


def counts(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated`` from ``marked`` rows; a row's first fault counts."""
    blank, first, copies = F.col("blank"), F.col("first"), F.col("copies")
    turns = rows.groupBy("conv_id", "turn").agg(
        F.sum(F.when(blank, copies).otherwise(0)).alias("blank"),
        F.sum(F.when(blank, 0).otherwise(copies - first.cast("long"))).alias("duplicate"),
        F.sum((~blank & first & F.col("cut")).cast("long")).alias("truncated"))
    return turns.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))


def _tasks(rows: DataFrame) -> int:
    """Parsing costs time, not bytes, by which Spark would deal rows to fewer tasks."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // TASK_ROWS)


def sorted_parts(rows: DataFrame) -> DataFrame:
    """``marked`` rows in the order of their conversations, dealt over tasks by ranges: ``part`` says to which, ``place``
    where in it. A conversation with very many rows has many parts. Rows of one turn go by role, then by digest of the text.
    """
    tasks = _tasks(rows)
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    initial = F.left("role", F.lit(1))
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(F.col("blank") | ~F.col("first"), "x").when(F.col("cut"), F.upper(known)).otherwise(known)
    return stored(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select(
        "conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"),
        "role", "text", initial.alias("initial"), letter.alias("letter"), "copies"), "sorted-turns")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[tuple], schema: T.StructType, size: int = 1000) -> Iterator[pa.RecordBatch]:
    kinds = to_arrow_schema(schema)
    while some := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), kinds)], schema=kinds)


def _legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


def _as_lists(cell: Cell) -> tuple[list, list]:
    found = [cell.get((p, q), (None, None)) for p in range(4) for q in range(4)]
    return [c for c, _ in found], [a for _, a in found]


def _from_lists(costs: list, audits: list) -> Cell:
    return {divmod(i, 4): (c, a) for i, (c, a) in enumerate(zip(costs, audits)) if c is not None}


def part_cells(placed: DataFrame) -> DataFrame:
    """The cell of what a task has of a conversation, the first and last role's initials and the illegal neighbours inside."""
    schema = T.StructType([placed.schema["conv_id"], *T.StructType.fromDDL(
        "part INT, costs ARRAY<BIGINT>, audits ARRAY<STRING>, first STRING, last STRING, illegal BIGINT")])

    def cells(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (conv_id, part), own in groupby(rows, itemgetter(0, 1)):
            blocks: list[Cell] = []
            letters, illegal, first, last = "", 0, None, None
            for _, _, initial, letter, copies in own:
                illegal += (copies - 1) + (last is not None and not _legal(last, initial))
                first, last = initial if first is None else first, initial
                while copies:  # all but the first of equal rows must go
                    run = min(copies, BLOCK - len(letters))
                    letters += letter + "x" * (run - 1)
                    letter, copies = "x", copies - run
                    if len(letters) == BLOCK:
                        blocks.append(parse_block(letters))
                        letters = ""
            if letters:
                blocks.append(parse_block(letters))
            yield conv_id, part, *_as_lists(joined(blocks)), first, last, illegal

    wanted = placed.select("conv_id", "part", "initial", "letter", "copies", "place")
    return wanted.repartition(_tasks(placed), "part").sortWithinPartitions("part", "place").drop("place").mapInArrow(
        lambda batches: _batches(cells(_rows(batches)), schema), schema)


def _chosen(cells: list[Cell]) -> tuple[int, str, list[str]]:
    """Cost and audit of a conversation from the cells of its parts, and the audit of each part."""
    levels = [cells]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([combined(*below[i:i + 2]) if i + 1 < len(below) else below[i] for i in range(0, len(below), 2)])
    top = levels[-1][0]
    cost, audit = cheapest(top)
    ways = [next((BEGIN, q) for q in (BEGIN, ASSISTANT) if top.get((BEGIN, q)) == (cost, audit))]
    for below in reversed(levels[:-1]):
        finer = []
        for at, (p, q) in enumerate(ways):
            pair = below[2 * at:2 * at + 2]
            if len(pair) == 1:
                finer.append((p, q))
                continue
            left, right = pair
            _, r = min(((left[p, r][0] + right[r, q][0], left[p, r][1] + right[r, q][1]), r)
                       for r in range(4) if (p, r) in left and (r, q) in right)
            finer += [(p, r), (r, q)]
        ways = finer
    return cost, audit, [cell[way][1] for cell, way in zip(cells, ways)]


def decisions(cells: DataFrame) -> DataFrame:
    """``conv_id, illegal, cost, audit`` and ``parts``, the audit of each part."""
    schema = T.StructType([cells.schema["conv_id"], *T.StructType.fromDDL(
        "illegal BIGINT, cost BIGINT, audit STRING, parts ARRAY<STRUCT<part: INT, edits: STRING>>")])

    def decided(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv_id, parts in rows:
            illegal = sum(p["illegal"] for p in parts) + sum(
                not _legal(a["last"], b["first"]) for a, b in zip(parts, parts[1:]))
            cost, audit, own = _chosen([_from_lists(p["costs"], p["audits"]) for p in parts])
            yield conv_id, illegal, cost, audit, [{"part": p["part"], "edits": e} for p, e in zip(parts, own)]

    whole = cells.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "part", "costs", "audits", "first", "last", "illegal"))).alias("parts"))
    return stored(whole.mapInArrow(lambda batches: _batches(decided(_rows(batches)), schema), schema), "edits")


def repaired_turns(rows: Iterator[tuple[str, str, int]], edits: Iterator[str], state: int = BEGIN) -> Iterator[tuple[str, str]]:
    """Role and text of the turns that edits make of rows (``role, text, copies``)."""
    def step(role: str) -> int:
        return {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]

    for role, text, copies in rows:
        while copies:
            edit = next(edits)
            copies -= edit != "I"
            if edit == "D":
                continue
            wanted = "assistant" if state == USER else "user"
            turn = (role if edit == "K" else wanted, "" if edit == "I" else text)
            state = step(turn[0])
            yield turn
    for _ in edits:  # insertions at the end
        wanted = "assistant" if state == USER else "user"
        state = step(wanted)
        yield wanted, ""


def digests(placed: DataFrame, decided: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: rows come sorted, after the edits of their part, and none is held."""
    schema = T.StructType([placed.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    def hashed(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv_id, own in groupby(rows, itemgetter(0)):
            waiting: list[Iterator[str]] = []

            def turns() -> Iterator[tuple[str, str, int]]:
                for _, role, text, copies in own:
                    if copies is None:
                        waiting.append(iter(text))
                    else:
                        yield role, text, copies

            def edits() -> Iterator[str]:
                while waiting:
                    yield from waiting.pop(0)

            digest, between = hashlib.sha256(), b""
            for role, text in repaired_turns(turns(), edits()):
                digest.update(between + f"{role}:{text}".encode())
                between = b"\n"
            yield conv_id, digest.hexdigest()

    edits = decided.select("conv_id", F.explode("parts").alias("p")).select(
        "conv_id", "p.part", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("role"),
        F.col("p.edits").alias("text"), F.lit(None).cast("long").alias("copies"))
    both = edits.unionByName(placed.select("conv_id", "part", "place", "role", "text", "copies"))
    return (both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place").drop("part", "place")
            .mapInArrow(lambda batches: _batches(hashed(_rows(batches)), schema), schema))


def repair(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Per ``conv_id`` of ``conversations`` what is wrong with its ``rows`` (its own if none are given, else e.g.
    ``damaged`` ones) and the cheapest repair.

    Columns: ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``. Rows go by turn, NULLs first,
    then by role and digest of the text; a NULL role or text is one space and a NULL ``conv_id`` an id like others. A row's
    first fault counts: blank, there before, cut off. Rows repeated in full are repeated turns. A conversation
    without rows has zeros, an empty audit and the digest of an empty text; an empty table gives an empty result. Other
    columns are not looked at.
    """
    if rows is None:
        space = F.lit(" ")
        rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"),
                                    F.coalesce("text", space).alias("text"), F.lit(1).cast("long").alias("copies"))
    faults = marked(rows)
    placed = sorted_parts(faults)
    decided = decisions(part_cells(placed))
    facts = (conversations.select("conv_id").distinct()
             .unionByName(counts(faults), allowMissingColumns=True)
             .unionByName(decided.drop("parts"), allowMissingColumns=True)
             .unionByName(digests(placed, decided), allowMissingColumns=True))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    empty = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return facts.groupBy("conv_id").agg(
        *(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers),
        *(F.coalesce(F.max(c), F.lit(v)).alias(c) for c, v in empty.items()))
