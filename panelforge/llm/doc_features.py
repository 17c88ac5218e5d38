"""Text statistics of one document, shared by the quality operators."""

from __future__ import annotations

import math

import numpy as np

from .words import WordHashes, window_hashes

#: Fixed byte classes.
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_END = np.frombuffer(b".!?", np.uint8)
_PUNCT = np.frombuffer(b".,;:!?'\"()-", np.uint8)

NAMES = (
    "log_words", "word_len", "symbols_per_word", "upper_share", "digit_share", "punct_share", "ends_per_word",
    "space_share", "non_ascii_share", "dup_line_share", "repeat_word_share", "distinct_share", "top_word_share",
    "words_per_line", "bang_share", "pipe_share",
)


def base_stats(text: bytes, hashes: WordHashes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text.

    Repeat words lie in windows of five consecutive words found twice or more in the text.
    """
    words = text.split()
    raw = np.frombuffer(text, np.uint8)
    counts = np.bincount(raw, minlength=256)
    space = int(counts[9:14].sum() + counts[32])
    chars = len(raw) - int(counts[0x80:0xC0].sum()) - space
    return len(words), chars, int(counts[_SYMBOLS].sum()), dup_lines(text), repeat_words(hashes.of(words))


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def repeat_words(h: np.ndarray, k: int = 5) -> int:
    wins = window_hashes(h, k)
    if not len(wins):
        return 0
    order = np.sort(wins)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(wins, twice)
    edge = np.zeros(len(h) + 1, np.int64)
    edge[:-k][hit] += 1
    edge[k:][hit] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def features(text: bytes, hashes: WordHashes) -> list[float]:
    """NAMES of a whole text; an empty text gives zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = max(1, len(text))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    h = hashes.of(words)
    _, each = np.unique(h, return_counts=True)
    return [
        math.log1p(n),
        (size - int(counts[9:14].sum() + counts[32])) / n,
        int(counts[_SYMBOLS].sum()) / n,
        int(counts[65:91].sum()) / size,
        int(counts[48:58].sum()) / size,
        int(counts[_PUNCT].sum()) / size,
        int(counts[_END].sum()) / n,
        int(counts[32]) / size,
        int(counts[0xC0:].sum()) / size,
        1 - len(set(lines)) / max(1, len(lines)),
        repeat_words(h) / n,
        len(each) / n,
        int(each.max()) / n,
        n / max(1, len(lines)),
        int(counts[33]) / n,
        int(counts[124]) / n,
    ]
