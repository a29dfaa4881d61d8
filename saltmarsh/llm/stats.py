"""Statistics of one text, for the quality rules and the weak labellers."""

from __future__ import annotations

import numpy as np

from saltmarsh.llm.common import WORDS, WordHashes, windows

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
REPEAT_WIDTH = 8

_BYTE_CLASS = np.full(256, 5)
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", WHITE, "!")):
    _BYTE_CLASS[[ord(c) for c in _chars]] = _k
_BYTE_CLASS[128:] = 1  # parts of letters, mostly

#: Names of what ``features`` returns, in order.
FEATURES = (
    "log_words", "word_length", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "digit_share", "shouts_per_word",
    "bar_share", "distinct_share", "top_word_share", "same_as_previous_share", "short_word_share", "lines_per_word", "full_stop_share",
)


def repeated_words(hashes: np.ndarray, width: int = REPEAT_WIDTH) -> int:
    """Words that lie in a window of ``width`` words that occurs twice or more in the text."""
    runs = windows(hashes, width)
    if not len(runs):
        return 0
    order = np.sort(runs)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(runs, twice))
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(change)))


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return len(lines) - len(set(lines))


def base(text: str, words: list[str], hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    return len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated_words(hashes)


def features(text: str, words: list[str], hashes: np.ndarray, counts: tuple[int, int, int, int, int]) -> list[float]:
    """Statistics by the names in FEATURES, each 0 or a share where it would divide by zero."""
    n, chars, symbols, dup_lines, repeats = counts
    each = max(n, 1)
    kinds = np.bincount(_BYTE_CLASS[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)], minlength=6)
    letters = max(int(kinds[0] + kinds[1]), 1)
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    _, often = np.unique(hashes, return_counts=True)
    same = int(np.count_nonzero(hashes[1:] == hashes[:-1]))
    return [
        float(np.log1p(n)), chars / each, symbols / each, dup_lines / max(len(lines), 1), repeats / each, int(kinds[0]) / letters, int(kinds[2]) / max(chars, 1), int(kinds[4]) / each,
        words.count("|") / each, len(often) / each, int(often.max(initial=0)) / each, same / each, int(np.count_nonzero(np.fromiter(map(len, words), np.int64, n) < 4)) / each, len(lines) / each, sum(x.rstrip(WHITE)[-1] in ".!?" for x in lines) / max(len(lines), 1),
    ]


class Reader:
    """Words, word hashes, base counts and features of texts; null is empty."""

    def __init__(self) -> None:
        self.hashes = WordHashes()

    def read(self, text: str | None) -> tuple[list[str], tuple[int, int, int, int, int], list[float]]:
        text = text or ""
        words = WORDS(text)
        hashes = self.hashes.of(words)
        counts = base(text, words, hashes)
        return words, counts, features(text, words, hashes, counts)


