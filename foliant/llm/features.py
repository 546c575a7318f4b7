"""Line and word statistics of texts, by array operations over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

_CLASS = np.zeros(256, np.uint8)  # bit flags of a byte
SPACE, UPPER, LOWER, DIGIT, SYMBOL, MARK, PIPE, HIGH = (1 << k for k in range(8))
_CLASS[[32, *range(9, 14)]] |= SPACE
_CLASS[65:91] |= UPPER
_CLASS[97:123] |= LOWER
_CLASS[48:58] |= DIGIT
_CLASS[[ord(c) for c in "#*$%&|<>@^~_=+\\{}[]"]] |= SYMBOL
_CLASS[[ord(c) for c in "!?"]] |= MARK
_CLASS[ord("|")] |= PIPE
_CLASS[128:] |= HIGH
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
_FOLD += 1
_BASE = np.uint64(0x100000001B3 * 31 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

LINE_FEATURES = ("symbols", "uppercase", "repeats", "pipes", "marks", "digits", "high", "word_length", "log_words", "closed")


def _power(n: int, base: np.uint64, name: str) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        size = max(n, 1 << 16)
        p = np.full(size, base, np.uint64)
        p[0] = 1
        _powers[name] = np.cumprod(p)
    return _powers[name][:n]


class Lines:
    """Lines of texts: features and bytes of each line, lines of each text (one at least)."""

    def __init__(self, features: np.ndarray, length: np.ndarray, n_lines: np.ndarray):
        self.features, self.length, self.n_lines = features, length, n_lines
        self.first_line = np.concatenate(([0], np.cumsum(n_lines)[:-1])).astype(np.int64)

    def by_text(self, per_line: np.ndarray) -> np.ndarray:
        return np.add.reduceat(per_line, self.first_line, axis=0)

    def means(self) -> np.ndarray:
        """The line features of each text, weighted by line length."""
        w = self.length[:, None]
        return self.by_text(self.features * w) / self.by_text(w)


class Texts(Lines):
    """Of a list of texts: their lines (\\n-split; an empty text has one) with features, and their words with hashes."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode() for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        flags = _CLASS[data]
        breaks = np.flatnonzero(data == 10)
        starts = np.concatenate(([0], breaks[:-1] + 1))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        first_byte = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.first_line = np.searchsorted(starts, first_byte)  # of each text
        self.n_lines = np.diff(np.concatenate((self.first_line, [len(starts)])))
        space = (flags & SPACE) > 0
        begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        ends = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
        word_line = np.searchsorted(breaks, begins)
        n = len(data)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_FOLD[data] * _power(n, _BASE, "up"), dtype=np.uint64)))
        self.word_hash = (sums[ends] - sums[begins]) * _power(n, _INVERSE, "down")[begins]
        self.word_text = np.searchsorted(first_byte, begins, "right") - 1
        m = len(starts)
        count = lambda flag: np.add.reduceat(((flags & flag) > 0).astype(np.int64), starts).astype(float)
        words = np.bincount(word_line, minlength=m).astype(float)
        same = np.zeros(len(begins))
        if len(begins) > 1:
            same[1:] = (self.word_hash[1:] == self.word_hash[:-1]) & (word_line[1:] == word_line[:-1])
        self.length = (breaks - starts + 1).astype(float)  # bytes, the line end counted
        full, some = np.maximum(self.length - count(SPACE), 1), np.maximum(words, 1)
        letters = np.maximum(count(UPPER) + count(LOWER), 1)
        last = data[np.maximum(breaks - 1, starts)]
        self.features = np.stack([
            np.minimum(1, 4 * count(SYMBOL) / full), count(UPPER) / letters * np.minimum(1, letters / 12), np.bincount(word_line, same, m) / some,
            np.minimum(1, 2 * count(PIPE) / some), np.minimum(1, 4 * count(MARK) / full), count(DIGIT) / full, count(HIGH) / full,
            np.minimum(2, full / some / 10), np.log1p(words) / 5, np.isin(last, [46, 33, 63]).astype(float),
        ], axis=1)
        self.words = words
