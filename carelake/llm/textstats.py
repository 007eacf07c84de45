"""Counts of a text's characters, words, lines and repeats in one pass each, for the quality operators."""

from __future__ import annotations

import math
from operator import eq

import numpy as np

SPACES, SYMBOLS = [9, 10, 11, 12, 13, 32], [ord(c) for c in "#*$%&|<>"]
WINDOW = 8
#: Names of the features in the order that features() gives them.
FEATURES = ["log_words", "word_length", "symbols", "pipes", "marks", "capitals", "digits", "stops", "same_as_last", "distinct", "repeats", "dup_lines", "line_words", "short_words", "foreign"]


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of 8 words that the text has twice or more, the first one included; exact, no hashes.

    Fours of word numbers get a number each, then pairs of fours; a text whose fours all differ has no repeat.
    """
    if len(words) <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == len(words):
        return 0
    code, width = ids, len(number)
    span = 1
    while span < window:
        if width * width >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            width = len(words)
        code, width = code[:-span] * width + code[span:], width * width
        span *= 2
        if span * 2 == window or span == window:
            ordered = np.sort(code)
            if (ordered[1:] != ordered[:-1]).all():
                return 0
            code = np.unique(code, return_inverse=True)[1]
            width = len(words)
    again = np.bincount(code)[code] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[: len(again)] += again
    edge[window : window + len(again)] -= again
    return int((edge.cumsum() > 0).sum())


def counts(text: str) -> tuple[np.ndarray, list[bytes], int, int, int]:
    """Bytes by value, words, lines that have a word, those of them equal to an earlier line, words in repeated windows."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    return np.bincount(np.frombuffer(data, np.uint8), minlength=256), words, len(lines), len(lines) - len(set(lines)), repeat_words(words)


def base_stats(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    by, words, _, dup, repeats = counts(text)
    return len(words), len(text) - int(by[SPACES].sum()), int(by[SYMBOLS].sum()), dup, repeats


def features(text: str) -> list[float]:
    """The numbers of FEATURES, shares of words, letters or lines so that they don't follow the length; all 0 for a text without words."""
    by, words, lines, dup, repeats = counts(text)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars, upper, lower = len(text) - by[SPACES].sum(), by[65:91].sum(), by[97:123].sum()
    return [
        math.log1p(n),
        float(chars / n),
        float(by[SYMBOLS].sum() / n),
        float(by[124] / n),
        float((by[33] + by[63]) / n),
        float(upper / max(1, upper + lower)),
        float(by[48:58].sum() / chars),
        float((by[44] + by[46]) / n),
        sum(map(eq, words, words[1:])) / n,
        len(set(words)) / n,
        repeats / n,
        dup / lines,
        math.log1p(n / lines),
        sum(1 for w in words if len(w) < 4) / n,
        float(by[128:].sum() / chars),
    ]

