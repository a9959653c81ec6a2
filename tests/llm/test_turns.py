"""Conversation repair: cells against a plain search, the query against its SQL twin on odd rows."""

import hashlib
import itertools
import random

import duckdb
import pytest
from check_queries import compare

from tidemart.llm import plans, turns

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, cost INT, audit STRING, part STRING"


def by_search(letters):
    """Least cost and audit over all ways to edit a short conversation, insertions tried up to two at each place."""
    best = None
    for ops in itertools.product(*("D" if c == "x" else "DKR" for c in letters)):
        for gaps in itertools.product(range(3), repeat=len(letters) + 1):
            state, audit, cost = 0, "", 0
            for i, op in enumerate([*ops, ""]):
                for _ in range(gaps[i]):
                    state = turns.ASSISTANT if state == turns.USER else turns.USER
                    audit, cost = audit + "I", cost + 3
                if not op:
                    break
                audit += op
                cost += {"D": 4, "K": 0, "R": 3}[op] + (3 if op != "D" and letters[i].isupper() else 0)
                role = letters[i].lower() if op == "K" else "a" if state == turns.USER else "u"
                if op == "D":
                    continue
                if role == "u" and state != turns.USER:
                    state = turns.USER
                elif role == "a" and state == turns.USER:
                    state = turns.ASSISTANT
                elif role == "s" and state == turns.BEGIN:
                    state = turns.SYSTEM
                else:
                    break
            else:
                continue
            if not op and state in (turns.BEGIN, turns.ASSISTANT):
                best = min(best or (cost, audit), (cost, audit))
    return best


def row_by_row(letters):
    """The same for long conversations, without spans."""
    states = turns._closure()
    best = {q: states[0, q] for q in range(4) if (0, q) in states}
    for letter in letters:
        after = {}
        for p, (cost, audit) in best.items():
            for q in range(4):
                if (way := turns._row(letter).get((p, q))) is not None:
                    after[q] = min(after.get(q, (1 << 60, "")), (cost + way[0], audit + way[1]))
        best = after
    return min(best[q] for q in (0, 3) if q in best)


def test_cells_equal_a_search_over_all_edits():
    draw = random.Random(5)
    some = ["".join(draw.choices("suaoSUAOx", k=n)) for n in (1, 2, 3) for _ in range(60)]
    for letters in [*some, "uaua", "suau", "aaaa", "uuuu", "sxua"]:
        assert turns.cheapest(turns.parse_block(letters)) == by_search(letters), letters


def test_parts_give_the_whole():
    draw = random.Random(6)
    for _ in range(40):
        letters = "".join(draw.choices("suauauaoUAx", k=draw.randrange(1, 120)))
        cuts = sorted({0, len(letters), *(draw.randrange(len(letters) + 1) for _ in range(draw.randrange(6)))})
        cells = [turns.joined([turns.parse_block(letters[i:min(i + turns.BLOCK, b)]) for i in range(a, b, turns.BLOCK)])
                 for a, b in zip(cuts, cuts[1:])]
        cost, audit, own = turns._chosen(cells)
        assert (cost, audit) == row_by_row(letters) and "".join(own) == audit
        assert [len(e.replace("I", "")) for e in own] == [b - a for a, b in zip(cuts, cuts[1:])]


def test_repaired_turns():
    rows = [("system", "x", 1), ("user", "a", 2), ("tool", "b", 1)]
    assert list(turns.repaired_turns(iter(rows), iter("KKDIKI"[:3] + "R"))) == [("system", "x"), ("user", "a"), ("assistant", "b")]
    assert list(turns.repaired_turns(iter(rows[1:2]), iter("IKID"))) == [("user", ""), ("user", "a"), ("assistant", "")]


def conversations(spark):
    draw = random.Random(7)
    rows = [(c, t, draw.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]),
             draw.choice(["Hello.", "hello", " ", "", None, "Wait... what", "Done!\n", "Ü?\t", f"text {draw.random()}."]), 1, "a", "p")
            for c in range(60) for t in range(draw.randrange(1, 9))]
    rows += [(100, None, "user", "no turn.", 1, "a", "p"), (100, None, "assistant", "no turn.", 1, "a", "p"), (100, 7, "user", "no turn.", 1, "a", "p"),
             (None, 1, "user", "no id.", 1, "a", "p"), (None, 2, "assistant", "no id.", 1, "a", "p"), (None, None, None, None, 1, "a", "p")]
    rows += [(101, 3, "user", "again.", 1, "a", "p")] * 40 + [(101, 4, "assistant", "yes.", 1, "a", "p"), (102, 5, "user", "long " * 60_000, 1, "a", "p")]
    rows += [(200, t, "user" if t % 3 else "assistant", f"turn {t % 50}.", 1, "a", "p") for t in range(700)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("task_rows", [60, 200_000])
def test_twin_on_odd_conversations(spark, path, monkeypatch, task_rows):
    """Small tasks cut the long conversation into many parts."""
    monkeypatch.setattr(turns, "TASK_ROWS", task_rows)
    conversations(spark).coalesce(1).write.parquet(f"{path}/conversations.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{path}/conversations.parquet/*.parquet'")
    name = "op13_conversation_repair"
    problem, n = compare(spark, duck, path, plans.QUERIES[name], plans.ORACLES[name])
    assert not problem and n == 65


def test_undamaged_and_empty(spark):
    talk = spark.createDataFrame([(1, 1, "system", "Be brief."), (1, 2, "user", "Why?"), (1, 3, "assistant", "So."),
                                  (2, 1, "assistant", "So."), (2, 3, "user", "cut")], "conv_id INT, turn INT, role STRING, text STRING")
    rows = {r.conv_id: r for r in turns.repair(talk).collect()}
    assert (rows[1].cost, rows[1].audit, rows[1].illegal, rows[1].gaps) == (0, "KKK", 0, 0)
    assert rows[1].repaired_sha256 == hashlib.sha256("system:Be brief.\nuser:Why?\nassistant:So.".encode()).hexdigest()
    assert (rows[2].cost, rows[2].truncated, rows[2].gaps) == (7, 1, 1)
    assert turns.repair(talk.limit(0)).count() == 0
    assert sorted(tuple(r) for r in turns.repair(talk, turns.damaged(talk).limit(0)).collect()) == [
        (c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c in sorted(rows)]
