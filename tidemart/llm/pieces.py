"""SentencePiece encoding and decoding as a shortest path through a weighted transducer.

The transducer is put together from a model file: a normaliser (a space becomes U+2581, one is put in
front), an arc for every piece, and arcs that spell a character without a piece in bytes. Composed
with a text it gives a lattice whose states are a place and the piece that ends there; the path of
least total weight (tropical semiring: weights add up along a path, the least path counts) is the
encoding. In unigram models an arc weighs minus the piece's score. In BPE models an arc weighs 0 if
merging would leave its piece and the one before apart, else it is closed; then one path is left,
the one that merging gives.

Whether merging leaves two pieces apart follows from their merges: a pair of symbols across the
border would have to be merged before either of them is merged to the other side.
"""

from __future__ import annotations

import math
import re
import struct
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Encoded chunks that a task remembers before it begins anew, and characters by which arcs are remembered.
MEMORY, _START = 250_000, 4
# Kinds of pieces and of models in the public model format.
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
_UNIGRAM, _BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Numbered fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield tag >> 3, data[at:at + size]
            at += size


class PieceModel:
    """Pieces, scores and switches of a model file, compiled for encoding."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, kinds = [], [], []
        spec: dict[int, object] = {}
        self.kind = _UNIGRAM
        for field, value in _fields(data):
            if field == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, _NORMAL))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, _UNIGRAM)
            elif field == 3:
                spec = dict(_fields(value))
        if self.kind not in (_UNIGRAM, _BPE) or spec.get(2) or _USER in kinds:
            raise ValueError("only unigram and BPE models without character map and user symbols are compiled")
        self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        self.unknown = kinds.index(_UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if kinds[i] == _BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.ids = {p: i for i, p in enumerate(self.pieces) if kinds[i] == _NORMAL}
        self.silent = {i for i, k in enumerate(kinds) if k not in (_NORMAL, _BYTE)}
        # A space after something else, or a line end, begins a new chunk if no piece goes across.
        if any(re.search(f"[^{SPACE}]{SPACE}", p) or len(p) > 1 and "\n" in p for p in self.ids):
            self.chunk = re.compile(r"(?s).+")
        else:
            self.chunk = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        # Unigram models give a character without a piece this much less than the worst piece.
        self.unknown_weight = 10.0 - min((self.scores[i] for i in self.ids.values()), default=0.0)
        if self.kind == _BPE:
            self._compile_merges()
        # A node of the arcs' tree: what follows by character, and the piece that ends there.
        self.root: dict[str, list] = {}
        for piece in self.tree if self.kind == _BPE else self.ids:
            following = self.root
            for char in piece:
                node = following.setdefault(char, [{}, None])
                following = node[0]
            node[1] = piece
        #: Bytes that a piece stands for, by id.
        self.spelt = [b"" if i in self.silent else p.encode() for i, p in enumerate(self.pieces)]
        for i, byte in self.byte_of.items():
            self.spelt[i] = bytes([byte])
        self.spelt[self.unknown] = " ⁇ ".encode()
        self.forget()
        self._apart: dict[tuple[str, str], bool] = {}
        # Arcs at a place by the characters there.
        self._starts: dict[str, tuple[tuple[str, ...], dict | None]] = {}

    def forget(self) -> None:
        """Gives up the chunks that were remembered; what they are made of stays, which is less."""
        # Chunks met since the last turn, and those of the turn before: frequent ones stay.
        self._seen: dict[str, tuple[int, ...]] = {}
        self._before: dict[str, tuple[int, ...]] = {}

    def _compile_merges(self) -> None:
        """For every piece the two symbols that its last merge joins.

        Pieces that share the last rank (runs of spaces) are merged after all others, from the left.
        """
        self.rank = {p: -self.scores[i] for p, i in self.ids.items()}
        ranks = Counter(self.rank.values())
        last = max(ranks, default=0.0)
        self.late = {p for p, r in self.rank.items() if len(p) > 1 and r == last and ranks[last] > 1}
        self.late_starts = {p[:2] for p in self.late}
        self.tree: dict[str, tuple[str, str] | None] = {p: None for p in self.ids if len(p) == 1}
        for piece in self.ids:
            if len(piece) > 1 and piece not in self.late:
                parts = self._merged(piece)
                if len(parts) != 2:  # what merging does not make is no arc
                    continue
                if any(len(p) > 1 and (p in self.late or self.rank[p] >= self.rank[piece]) for p in parts):
                    raise ValueError(f"piece {piece!r} comes before its parts")
                self.tree[piece] = (parts[0], parts[1])

    def _merged(self, text: str) -> list[str]:
        """The last two symbols that a piece is merged from; more if it cannot be merged that far."""
        parts = list(text)
        while len(parts) > 2:
            best = min((self.rank.get(a + b, math.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] == math.inf:
                break
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def _edge(self, piece: str, side: int) -> list[tuple[str, float]]:
        """The symbols at one edge of a piece, each with the rank of the merge that ends it."""
        edge, until = [], math.inf
        while True:
            edge.append((piece, until))
            parts = self.tree.get(piece)
            if parts is None:
                return edge
            until, piece = self.rank[piece], parts[side]

    def stay_apart(self, left: str, right: str) -> bool:
        """Whether merging leaves these two neighbours as they are."""
        apart = True
        right_side = self._edge(right, 0)
        for a, a_until in self._edge(left, 1):
            for b, b_until in right_side:
                both = a + b
                rank = self.rank.get(both)
                # At one rank the merge further left comes first.
                if rank is not None and rank < a_until and rank <= b_until and both not in self.late:
                    apart = False
                    break
            if not apart:
                break
        if len(self._apart) >= MEMORY:
            self._apart.clear()
        self._apart[left, right] = apart
        return apart

    def _arcs(self, chunk: str, at: int) -> tuple[str, ...]:
        """Pieces that begin at a place, the longest first; a character without a piece stands for itself."""
        start = chunk[at:at + _START]
        known = self._starts.get(start)
        if known is None:
            if len(self._starts) >= MEMORY:
                self._starts.clear()
            known = self._starts[start] = self._begun(start)
        found, following = known
        if not following or len(chunk) <= at + _START:
            return found
        longer = []
        for char in chunk[at + _START:]:
            node = following.get(char)
            if node is None:
                break
            following, piece = node
            if piece is not None:
                longer.append(piece)
        return (*longer[::-1], *found) if longer else found

    def _begun(self, start: str) -> tuple[tuple[str, ...], dict | None]:
        """The pieces that ``start`` has at its beginning, and the arcs that lead on from its end if any do."""
        found, following = [], self.root
        for char in start:
            node = following.get(char)
            if node is None:
                following = None
                break
            following, piece = node
            if piece is not None:
                found.append(piece)
        if not found or len(found[0]) > 1:
            found.insert(0, start[0])
        return tuple(found[::-1]), following

    def _least_path(self, chunk: str) -> list[str]:
        """The path of least weight when every piece has one of its own."""
        best: list[tuple[float, str] | None] = [None] * (len(chunk) + 1)
        best[0] = (0.0, "")
        for at in range(len(chunk)):
            weight = best[at][0]
            for piece in self._arcs(chunk, at):
                own = self.ids.get(piece)
                total = weight + (self.unknown_weight if own is None else -self.scores[own])
                there = best[at + len(piece)]
                if there is None or total < there[0]:
                    best[at + len(piece)] = (total, piece)
        path, at = [], len(chunk)
        while at:
            path.append(best[at][1])
            at -= len(path[-1])
        return path[::-1]

    def _open_path(self, chunk: str) -> list[str]:
        """The one path of weight 0 when arcs weigh 0 or are closed, by depth-first search.

        A place has one open state at most, as the text up to it is merged in one way; so a place
        that leads nowhere is left out from then on.
        """
        path: list[str] = []
        waiting: list[Iterator[str]] = []
        at, size, nowhere, known = 0, len(chunk), set(), self._apart
        arcs = iter(self._arcs(chunk, 0))
        while at < size:
            for piece in arcs:
                end = at + len(piece)
                if end in nowhere:
                    continue
                if path:
                    apart = known.get((path[-1], piece))
                    if apart is False or apart is None and not self.stay_apart(path[-1], piece):
                        continue
                path.append(piece)
                waiting.append(arcs)
                at = end
                if at < size:
                    arcs = iter(self._arcs(chunk, at))
                break
            else:
                nowhere.add(at)
                at -= len(path.pop())
                arcs = waiting.pop()
        return self._join_late(path) if any(map(chunk.__contains__, self.late_starts)) else path

    def _join_late(self, path: list[str]) -> list[str]:
        joined: list[str] = []
        for piece in path:
            joined.append(piece)
            while len(joined) > 1 and joined[-2] + joined[-1] in self.late:
                joined[-2:] = [joined[-2] + joined[-1]]
        return joined

    def _chunk_ids(self, chunk: str) -> tuple[int, ...]:
        ids: list[int] = []
        for piece in self._open_path(chunk) if self.kind == _BPE else self._least_path(chunk):
            own = self.ids.get(piece)
            if own is not None:
                ids.append(own)
            elif self.bytes:
                ids.extend(self.bytes[b] for b in piece.encode())
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return []
        text = text.replace(" ", SPACE)
        if self.prefix:
            text = SPACE + text
        ids: list[int] = []
        for chunk in self.chunk.findall(text):
            known = self._seen.get(chunk)
            ids.extend(self._remembered(chunk) if known is None else known)
        return ids

    def _remembered(self, chunk: str) -> tuple[int, ...]:
        known = self._before.get(chunk) or self._chunk_ids(chunk)
        if len(chunk) <= 64:
            if len(self._seen) >= MEMORY:
                self._before, self._seen = self._seen, {}
            self._seen[chunk] = known
        return known

    def decode(self, ids: list[int]) -> str:
        spelt = self.spelt
        text = b"".join([spelt[i] for i in ids]).decode(errors="replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


_models: dict[bytes, PieceModel] = {}


def model_of(data: bytes) -> PieceModel:
    """A worker compiles a model once. Workers are used again by other steps: tasks ``forget`` at their end."""
    if data not in _models:
        _models[data] = PieceModel(data)
    return _models[data]


def encode_texts(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """``docs`` with ``ids`` (array), ``n_tokens`` and ``round_trip``: whether decoding gives the text back.

    The driver reads the model file, whose size is that of the vocabulary, and sends it with the
    tasks. NULL and empty texts have no ids; a NULL text does not come back (``round_trip`` is
    NULL). U+2581 in a text is read as a space, so such a text does not come back either. Columns
    of these three names are replaced.
    """
    with open(model_path, "rb") as file:
        data = file.read()
    PieceModel(data)
    kept = docs.drop("ids", "n_tokens", "round_trip")
    schema = T.StructType([*kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())])
    text_at, names = kept.columns.index("text"), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(data)
        try:
            for whole in batches:
                for start in range(0, whole.num_rows, 256):
                    batch = whole.slice(start, 256)
                    ids, same = [], []
                    for value in batch.column(text_at):
                        text = value.as_py()
                        own = model.encode(text or "")
                        same.append(None if text is None else model.decode(own) == text)
                        ids.append(own)
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64()),
                         pa.array(same, pa.bool_())], names=names)
        finally:
            model.forget()
            pa.default_memory_pool().release_unused()

    return kept.mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """``encoded`` with ``text`` made from ``ids``; NULL ids give NULL, no ids an empty text."""
    with open(model_path, "rb") as file:
        data = file.read()
    kept = encoded.drop("text")
    schema = T.StructType([*kept.schema.fields, T.StructField("text", T.StringType())])
    at, names = kept.columns.index("ids"), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(data)
        for batch in batches:
            texts = [None if v.as_py() is None else model.decode(v.as_py()) for v in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return kept.mapInArrow(run, schema)
