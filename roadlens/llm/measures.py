"""Counts of one text that quality rules and the quality classifier build on."""

from __future__ import annotations

import numpy as np

from .text import SPACES, WordHashes, windows

SYMBOLS = b"#*$%&|<>"
UPPER, LOWER, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
MARKS = b"!?;:\"'()[]{}=+_~^@/\\`"
STOPS = b".,"
REPEAT_WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_marks",
          "n_stops", "n_distinct", "n_bytes", "n_pairs", "n_adjacent")


def _count(data: bytes, kinds: bytes) -> int:
    return len(data) - len(data.translate(None, kinds))


def repeated_words(h: np.ndarray, size: int = REPEAT_WINDOW) -> int:
    """Words that lie in a window of ``size`` words that occurs at least twice, its first occurrence included."""
    w = windows(h, size)
    if len(w) < 2:
        return 0
    ordered = np.sort(w)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    starts = np.flatnonzero(np.isin(w, again))
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counts(text: str | None, hashes: WordHashes) -> tuple[int, ...]:
    """The values named in COUNTS; all zero for a null or empty text."""
    if not text:
        return (0,) * len(COUNTS)
    data = text.encode()
    found = data.split()
    h = hashes.of(found)
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return (len(found), len(text) - _count(data, SPACES), _count(data, SYMBOLS), len(lines) - len(set(lines)), repeated_words(h), len(lines),
            _count(data, UPPER), _count(data, LOWER), _count(data, DIGITS), _count(data, MARKS), _count(data, STOPS), len(set(found)),
            len(data), max(0, len(found) - 1), int((h[1:] == h[:-1]).sum()))
