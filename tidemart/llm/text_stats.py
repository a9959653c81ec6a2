"""Counts over the words, lines and characters of a whole text."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np

from tidemart.llm.tables import word_blocks

_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _repeated(ids: np.ndarray, kinds: int) -> int:
    """Words that lie in a window of three which the text has twice or more."""
    n = len(ids) - 2
    if n < 2:
        return 0
    if kinds < 1 << 21:
        windows = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        _, pairs = np.unique(ids[:-2] << 32 | ids[1:-1], return_inverse=True)
        windows = pairs.astype(np.int64) << 32 | ids[2:]
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    if not twice.any():
        return 0
    hit = np.zeros(len(ids), dtype=bool)
    for shift in range(3):
        hit[shift:shift + n] |= twice
    return int(hit.sum())


def base_counts(text: str) -> list[int]:
    """The counts named in ``BASE``; words are what stands between the six ASCII blanks."""
    data = text.encode()
    number: dict[bytes, int] = {}
    blocks = [np.fromiter((number.setdefault(w, len(number)) for w in block), np.int64, len(block))
              for block in word_blocks(data)]
    ids = np.concatenate(blocks) if blocks else np.zeros(0, dtype=np.int64)
    lines = data.split(b"\n")
    seen: set[bytes] = set()
    dup = 0
    for line in lines:
        if line.strip():
            dup += line in seen
            seen.add(line)
    return [len(ids), len(text) - sum(map(text.count, _BLANKS)), sum(map(text.count, _SYMBOLS)), dup,
            _repeated(ids, len(number)), len(lines)]


def quality_features(text: str) -> list[float]:
    """Document statistics for the quality classifier; all zero for an empty text."""
    data = text.encode()
    if not data:
        return [0.0] * len(FEATURES)
    bytes_ = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words: Counter[bytes] = Counter()
    for block in word_blocks(data):
        words.update(block)
    n_words, kinds = max(1, sum(words.values())), max(1, len(words))
    lengths = sum(len(w) * n for w, n in words.items())
    short = sum(n for w, n in words.items() if len(w) <= 3)
    long_ = sum(n for w, n in words.items() if len(w) >= 16)
    odd_end = sum(n for w, n in words.items() if not (w[-1:].isalnum() or w[-1] >= 128 or w[-1] in b".,"))
    capital = sum(n for w, n in words.items() if 65 <= w[0] <= 90)
    bare = sum(n for w, n in words.items() if not any(65 <= c <= 90 or c >= 97 for c in w))
    lines = data.split(b"\n")
    full = Counter(line for line in lines if line.strip())
    n_full = max(1, sum(full.values()))
    n = len(data)
    share = bytes_[bytes_ > 0] / n
    letters = max(1, int(bytes_[65:91].sum() + bytes_[97:123].sum()))

    def part(chars: bytes) -> float:
        return float(sum(bytes_[c] for c in chars)) / n

    return [math.log1p(n), math.log1p(n_words), lengths / n_words, kinds / n_words, max(words.values(), default=0) / n_words,
            short / n_words, long_ / n_words, odd_end / n_words, capital / n_words, bare / n_words,
            float(bytes_[65:91].sum()) / letters, float(bytes_[48:58].sum()) / n, float(bytes_[128:].sum()) / n,
            part(b"#*$%&<>@^~_=+/\\"), part(b"|"), part(b"!?"), part(b"."), part(b","), part(b" \n\t"),
            len(lines) / n_words, 1 - len(full) / n_full, float(-(share * np.log2(share)).sum())]


FEATURES = ["bytes", "words", "word_length", "distinct", "most_common", "short", "long", "odd_end", "capital", "bare",
            "upper", "digits", "beyond_ascii", "symbols", "bars", "marks", "stops", "commas", "blanks", "lines",
            "repeated_lines", "entropy"]
