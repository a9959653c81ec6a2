"""Secrets in texts, by patterns and by reading assignments.

Besides three fixed patterns, a text is read as a run of assignments in source or configuration
syntax: a name, a sign (``=``, ``:``, ``:=``, ``=>``), and a value that is a quoted or bare literal, a
concatenation of quoted ones, or another name. Names with a known literal stand for it further on. A
literal is a secret if its score, from the name it is assigned to and from how random it looks, is
high enough.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The base patterns, in the order of their kinds, and the least length of what they find.
KINDS = ("assign", "access", "hex", "lexed")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_LEAST_ASSIGN, _LEAST_ACCESS = 12, 18

# Parts of names that say what a value is, with their weight in its score.
_NAMES = {"password": 3.0, "passwd": 3.0, "passphrase": 3.0, "pwd": 2.5, "secret": 3.0, "token": 2.5, "apikey": 3.0,
          "credential": 2.5, "credentials": 2.5, "auth": 1.5, "private": 1.5, "access": 1.0, "key": 1.0, "bearer": 2.0,
          "signature": 1.0, "salt": 1.0, "session": 1.0, "client": 0.5, "api": 0.5}
#: A literal of this score or more is a secret. Two sensitive words, or one and a random-looking value.
THRESHOLD, LEAST = 4.0, 8
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|your[_-].*|change[_-]?me|example.*|none|null|"
                          r"true|false|undefined|todo|password|secret|token|test|dummy|placeholder)$")
_NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_SIGN = re.compile(r":=|=>|=(?!=)|(?<!:):(?!:)")
_NAME_BEFORE = re.compile(r"""([A-Za-z_][\w.$-]*)["'\]]{0,2}[ \t]*$""", re.ASCII)
_QUOTED = re.compile(r'''[ \t]*(?:[bru]{0,2}"((?:[^"\\\n]|\\.)*)"|[bru]{0,2}'((?:[^'\\\n]|\\.)*)')''')
_PLUS = re.compile(r"[ \t]*(?:\+|\.(?=[ \t]*[\"']))")
_BARE = re.compile(r"[ \t]*([^\s\"',;(){}\[\]<>|]+)")
_IDENTIFIER = re.compile(r"[A-Za-z_][\w.$]*", re.ASCII)

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns, leftmost and not overlapping for each kind."""
    spans = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _LEAST_ASSIGN]
    spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= _LEAST_ACCESS]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return spans


def _name_before(text: str, at: int) -> str | None:
    """The name that ends where a sign begins, however long it is."""
    reach = 64
    while True:
        start = max(0, at - reach, text.rfind("\n", max(0, at - reach), at) + 1)
        found = _NAME_BEFORE.search(text, start, at)
        if found is None or found.start() > start or start == 0 or text[start - 1] == "\n":
            return found[1] if found else None
        reach *= 8


def _value_after(text: str, at: int) -> tuple[list[tuple[int, int]], str | None]:
    """Where the literals of a value lie, or the name it refers to."""
    pieces: list[tuple[int, int]] = []
    while found := _QUOTED.match(text, at):
        pieces.append(found.span(1 if found[1] is not None else 2))
        plus = _PLUS.match(text, found.end())
        if not plus:
            return pieces, None
        at = plus.end()
    if pieces:
        return pieces, None
    bare = _BARE.match(text, at)
    if not bare:
        return [], None
    if _IDENTIFIER.fullmatch(bare[1]):
        return [bare.span(1)], bare[1]
    return [bare.span(1)], None


def randomness(value: str) -> float:
    """Bits a character, from the value's own characters."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def score(name: str, value: str) -> float:
    """How likely a literal is a secret: its name's sensitive parts and its own look."""
    if len(value) < LEAST or _PLACEHOLDER.match(value) or " " in value:
        return 0.0
    parts = {p.lower() for p in _NAME_PARTS.findall(name)}
    named = sum(_NAMES.get(p, 0.0) for p in parts) + (1.0 if {"api", "key"} <= parts else 0.0)
    if not named:
        return 0.0
    kinds = bool(re.search("[a-z]", value)) + bool(re.search("[A-Z]", value)) + bool(re.search("[0-9]", value))
    looks = max(0.0, randomness(value) - 2.5) + 0.5 * (kinds - 1)
    return named + looks


def lexed_spans(text: str) -> list[Span]:
    """Literals that score as secrets, where they stand; a name that refers to one points back to it."""
    spans, known = set(), {}
    for sign in _SIGN.finditer(text):
        name = _name_before(text, sign.start())
        if name is None:
            continue
        pieces, refers = _value_after(text, sign.end())
        if not pieces:
            continue
        if refers is not None and refers in known:
            pieces = known[refers]
        value = "".join(text[a:b] for a, b in pieces)
        quoted = refers is None
        if quoted or refers in known:
            known[name] = pieces
        # A bare word may be a name from elsewhere: without digits it is no literal.
        if (quoted or refers in known or re.search(r"\d", value)) and score(name, value) >= THRESHOLD:
            spans.update((a, b, "lexed") for a, b in pieces if b > a)
    return list(spans)


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and these with the lexed ones that no base span covers; both in order."""
    def ordered(spans: list[Span]) -> list[Span]:
        return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    base = ordered(base_spans(text))
    more, reach, i = [], -1, 0
    for span in sorted(lexed_spans(text) if "=" in text or ":" in text else []):
        while i < len(base) and base[i][0] <= span[0]:
            reach, i = max(reach, base[i][1]), i + 1
        if span[1] > reach:
            more.append(span)
    return base, ordered(base + more) if more else base


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id`` and ``spans``, an array of (start, end, kind, base), in code points, end exclusive.

    NULL and empty texts have none. Repeated rows are repeated in the result; a row whose
    ``doc_id`` is NULL keeps it.
    """
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())])
    schema = T.StructType([docs.schema["doc_id"], T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("kind", T.StringType()), T.StructField("base", T.BooleanType())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                _, spans = all_spans(value.as_py() or "")
                rows.append([{"start": a, "end": b, "kind": k, "base": k != "lexed"} for a, b, k in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(span))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def digest_spans(found: DataFrame) -> DataFrame:
    """Counts and joined spans of ``find_secrets``."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
