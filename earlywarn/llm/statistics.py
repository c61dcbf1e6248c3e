"""Statistics of a text that quality rules and line labels build on."""

from __future__ import annotations

from collections import Counter
from operator import eq

#: What makes up a symbol, an upper-case letter, a digit in ASCII.
SYMBOLS = b"#*$%&|<>"
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"


def count_of(data: bytes, wanted: bytes) -> int:
    return len(data) - len(data.translate(None, wanted))


def code_points(data: bytes) -> int:
    """Characters of valid UTF-8: every byte that does not continue another."""
    return len(data) if data.isascii() else len(data.decode("utf-8", "replace"))


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a window of ``size`` words which the text has twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[k : k + n] for k in range(size))))
    if len(set(windows)) == n:
        return 0
    counts = Counter(windows)
    covered, until = 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered += at + size - max(at, until)
            until = at + size
    return covered


def repeated_lines(lines: list[bytes]) -> int:
    """Lines with a word that equal an earlier line."""
    spoken = [line for line in lines if line.split()]
    return len(spoken) - len(set(spoken))


def echoes(words: list[bytes]) -> int:
    """Words that say the word before them again."""
    return sum(map(eq, words, words[1:]))
