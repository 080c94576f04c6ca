"""Statistics of whole texts, over bytes."""

from __future__ import annotations

import numpy as np

from .shingles import SPACE, span_hashes, window_hashes, word_spans

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_UPPER, _DIGIT, _PUNCT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _DIGIT[48:58] = True
_PUNCT[list(b".,;:!?")] = True


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def repeated_words(words: np.ndarray, width: int = 8) -> int:
    """Words in windows of so many words that are found twice or more in the text."""
    windows = window_hashes(words, width)
    if len(windows) < 2:
        return 0
    order = np.sort(windows)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(windows, twice))
    step = np.zeros(len(words) + 1, np.int64)
    step[at] += 1
    step[at + width] -= 1
    return int(np.count_nonzero(np.cumsum(step) > 0))


def duplicate_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    if not text or "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def base_counts(text: str | None) -> tuple[np.ndarray, int, int, int, int, int]:
    """The bytes; n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = as_bytes(text)
    start, end = word_spans(data)
    words = span_hashes(data, start, end)
    chars = int(np.count_nonzero(((data & 0xC0) != 0x80) & ~SPACE[data]))
    return data, len(words), chars, int(np.count_nonzero(_SYMBOL[data])), duplicate_lines(text), repeated_words(words)


#: Names of what features() returns, in order.
FEATURES = (
    "n_words",
    "word_length",
    "symbol_share",
    "upper_share",
    "digit_share",
    "punct_share",
    "dup_line_share",
    "repeat_share",
    "distinct_share",
    "top_word_share",
    "same_next_share",
    "line_words",
    "stop_share",
)


def features(text: str | None) -> tuple[float, ...]:
    """FEATURES of a text; all 0 without words."""
    data = as_bytes(text)
    start, end = word_spans(data)
    n = len(start)
    if not n:
        return (0.0,) * len(FEATURES)
    words = span_hashes(data, start, end)
    solid = int((end - start).sum())
    counts = np.unique(words, return_counts=True)[1]
    lines = int(np.count_nonzero(data == 10)) + 1
    share = lambda table: float(np.count_nonzero(table[data])) / solid
    ends = float(np.count_nonzero(_PUNCT[data[end - 1]])) / n
    return (
        float(n),
        float(np.count_nonzero(((data & 0xC0) != 0x80) & ~SPACE[data])) / n,
        share(_SYMBOL),
        share(_UPPER),
        share(_DIGIT),
        share(_PUNCT),
        duplicate_lines(text) / lines,
        repeated_words(words) / n,
        len(counts) / n,
        float(counts.max()) / n,
        float(np.count_nonzero(words[1:] == words[:-1])) / n,
        n / lines,
        ends,
    )
