"""Language of a text by a small convolutional network over its bytes.

Filters of several widths run over the bytes of fixed-length windows; of each filter the largest response in a
window counts, and a softmax over these gives the languages. The net is trained in numpy on the driver, on a
bounded, documented sample of labelled documents; all windows of all texts are scored in tasks, many at a time.
As the input is bytes, a filter's response is a sum of table entries: embedding and weights are folded into a
table per pair of neighbouring bytes, and scoring only looks up, adds and takes the maximum.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled documents of a language that are learnt from at most (those with the smallest hash of their id), and
#: windows taken of each, evenly spread over its text.
SAMPLE, WINDOWS = 400, 4
#: Bytes of a window; a shorter text is filled up with zero bytes.
LENGTH = 256
WIDTHS, FILTERS, DEPTH = (2, 3, 4), 12, 6
EPOCHS, BATCH, RATE, SEED = 8, 64, 0.01, 11
#: Windows scored at a time, so that responses stay in the processor's cache.
AT_ONCE = 64
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
#: Letters are kept in lower case; all other ASCII bytes are a space.
_BYTES = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def as_bytes(text: str) -> bytes:
    """What the net sees of a text."""
    return text.lower().encode().translate(_BYTES)


def windows(data: bytes) -> np.ndarray:
    """All windows of a text, one below the other; the last one is filled up."""
    n = max(1, -(-len(data) // LENGTH))
    out = np.zeros(n * LENGTH, dtype=np.uint8)
    out[:len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(n, LENGTH)


@dataclass
class Net:
    """``embed`` (256, depth), per width ``filters`` (width, depth, filters) and ``bias``, and the softmax layer."""
    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """Per width what bytes add to the filters: one table per pair of bytes, and one more if the width is odd."""
        found = []
        for w, b in zip(self.filters, self.bias):
            one = [(self.embed @ k).astype(np.float32) for k in w]
            pairs = [(a[:, None] + c[None, :]).reshape(1 << 16, -1) for a, c in zip(one[::2], one[1::2])]
            pairs[0] = pairs[0] + b.astype(np.float32)
            found.append(pairs + ([one[-1]] if len(one) % 2 else []))
        return found

    def probabilities(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Of each window (row) for each language."""
        parts = [np.zeros((0, len(self.langs)))]
        for start in range(0, len(x), AT_ONCE):
            columns = np.ascontiguousarray(x[start:start + AT_ONCE].T)
            pairs = columns[:-1].astype(np.uint16) << 8 | columns[1:]
            largest = []
            for width, table in zip((len(w) for w in self.filters), tables):
                n = LENGTH - width + 1
                total = table[0].take(pairs[:n], axis=0)
                for at, more in enumerate(table[1:], 1):
                    total += more.take(pairs[2 * at:2 * at + n] if len(more) > 256 else columns[2 * at:2 * at + n], axis=0)
                largest.append(total.max(axis=0))
            parts.append(_softmax(np.maximum(np.concatenate(largest, axis=1), 0) @ self.out + self.out_bias))
        return np.concatenate(parts)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = EPOCHS) -> Net:
    """A net from windows (rows of bytes) and the number of their language, by Adam on the cross entropy."""
    random = np.random.default_rng(SEED)
    k, step, wide = len(WIDTHS), 0, FILTERS * len(WIDTHS)
    shapes = [(256, DEPTH), *((w, DEPTH, FILTERS) for w in WIDTHS), *[(FILTERS,)] * k, (wide, len(langs)), (len(langs),)]
    scale = [0.5, *((w * DEPTH) ** -0.5 for w in WIDTHS), *[0.0] * k, wide ** -0.5, 0.0]
    theta = [random.normal(0, 1, shape) * by for shape, by in zip(shapes, scale)]
    m, v = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    weight = len(y) / (len(langs) * np.maximum(np.bincount(y, minlength=len(langs)), 1))
    for _ in range(epochs):
        order = random.permutation(len(x))
        for start in range(0, len(order), BATCH):
            rows = order[start:start + BATCH]
            xb, yb = x[rows], y[rows]
            embed, filters, bias, out, out_bias = theta[0], theta[1:1 + k], theta[1 + k:1 + 2 * k], theta[-2], theta[-1]
            best, pooled = [], []
            for w, b in zip(filters, bias):
                n = LENGTH - len(w) + 1
                total = sum((embed @ part).astype(np.float32)[xb[:, i:i + n]] for i, part in enumerate(w))
                best.append(total.argmax(axis=1))
                pooled.append(np.take_along_axis(total, best[-1][:, None], axis=1)[:, 0] + b)
            h = np.concatenate(pooled, axis=1)
            active = np.maximum(h, 0)
            p = _softmax(active @ out + out_bias)
            p[np.arange(len(yb)), yb] -= 1
            p *= weight[yb][:, None] / len(yb)
            back = (p @ out.T) * (h > 0)
            grads = [np.zeros(shapes[0])]
            for j, (w, at) in enumerate(zip(filters, best)):
                g = back[:, j * FILTERS:(j + 1) * FILTERS]
                gw = np.zeros_like(w)
                for i, part in enumerate(w):
                    seen = xb[np.arange(len(xb))[:, None], at + i]  # the byte behind each filter's largest response
                    gw[i] = np.einsum("nfd,nf->df", embed[seen], g)
                    np.add.at(grads[0], seen.ravel(), (g[:, :, None] * part.T[None]).reshape(-1, DEPTH))
                grads.append(gw)
            grads += [back[:, j * FILTERS:(j + 1) * FILTERS].sum(axis=0) for j in range(k)]
            grads += [active.T @ p, p.sum(axis=0)]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                theta[i] = theta[i] - RATE * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    return Net(langs, theta[0], list(theta[1:1 + k]), list(theta[1 + k:1 + 2 * k]), theta[-2], theta[-1])


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learnt from; a row without id is not one of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Net | None:
    """A net from at most ``sample`` documents a language, or None if no text has a language.

    Languages are counted first, so that a task sends on no more documents of a frequent language than are wanted, and of
    these only the windows. Texts without a letter teach nothing; a document that is repeated counts once.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out()).select(
        F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("doc_id", F.xxhash64("text")).alias("order"))
    often = known.groupBy("lang").agg(F.approx_count_distinct("order").alias("n"))
    # Twice as many as wanted by their hash: fewer than wanted are left by no chance worth speaking of.
    place = F.shiftrightunsigned("order", 1) / F.lit(float(1 << 63))
    # A row per language, of which the net has an output each.
    some = known.join(F.broadcast(often), "lang").where(place < 2.0 * sample / F.col("n")).select("lang", "order", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, order, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                value = text.as_py()
                if _LETTER.search(value):
                    every = windows(as_bytes(value))
                    at = sorted({round(i * (len(every) - 1) / max(1, WINDOWS - 1)) for i in range(WINDOWS)})
                    rows.append((lang, order, every[at].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.binary())], names=["lang", "order", "x"])

    one = some.mapInArrow(run, "lang STRING, order BIGINT, x BINARY").groupBy("lang", "order").agg(F.min("x").alias("x"))
    first = Window.partitionBy("lang").orderBy("order")
    # At most ``sample`` times ``WINDOWS`` windows a language.
    got = (one.withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample)
           .orderBy("lang", "order").select("lang", "x").collect())
    if not got:
        return None
    langs = sorted({r.lang for r in got})
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), dtype=np.uint8).reshape(-1, LENGTH)
    y = np.repeat([langs.index(r.lang) for r in got], [len(r.x) // LENGTH for r in got])
    return train(x, y, langs)


def predict(docs: DataFrame, net: Net | None) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every row.

    All windows of a text count, by the bytes of text they have; the score is the mean probability of the language
    that has the largest. A NULL text, one without a letter, and any text if nothing was learnt is ``und`` with
    score 0. Rows may be repeated, and other columns are not looked at.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()),
                           T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def judged(texts: list[str | None], tables) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(texts) if t and net is not None and _LETTER.search(t)]
        start = 0
        while start < len(some):
            chosen, parts, size = [], [], 0
            while start < len(some) and size < 1 << 20:  # short texts are scored together, a long one by itself
                parts.append(as_bytes(texts[some[start]]))
                chosen.append(some[start])
                size += len(parts[-1])
                start += 1
            every = [windows(p) for p in parts]
            x = np.concatenate(every)
            weight = np.concatenate([np.minimum(LENGTH, len(p) - LENGTH * np.arange(len(e))) for p, e in zip(parts, every)])
            first = np.cumsum([0] + [len(e) for e in every[:-1]])
            total = np.add.reduceat(net.probabilities(x, tables) * weight[:, None], first, axis=0)
            total /= np.add.reduceat(weight, first)[:, None]
            for i, at, p in zip(chosen, total.argmax(axis=1), total):
                langs[i], scores[i] = net.langs[at], float(min(1.0, p[at]))
        return langs, scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net is not None else None
        for batch in batches:
            langs, scores = judged(batch.column(2).to_pylist(), tables)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=schema.names)

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, schema)
