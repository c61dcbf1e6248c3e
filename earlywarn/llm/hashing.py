"""Hashes of words and word sequences inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Odd multipliers, one for each place in a shingle.
_RNG = np.random.RandomState(20240229)
MULTIPLIERS = (_RNG.randint(0, 1 << 62, 64, dtype="int64").astype("uint64") << np.uint64(1)) | np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words, remembered; starts anew when it has ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), "uint64", len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class SequenceHashes:
    """64-bit hashes of the words of many texts at once, without an object for each word.

    A word's bytes, replaced by random numbers, are summed with powers of an odd base counted from the word's
    start: a difference of running sums, brought back by the inverse power. Two such sums with different bases make
    a hash, one of them with its halves exchanged, as the lowest bits of a sum say least.
    """

    _SPACE = np.zeros(256, bool)
    _SPACE[list(b" \t\n\v\f\r")] = True
    _NUMBERS = _RNG.randint(0, 1 << 62, 256, dtype="int64").astype("uint64") << np.uint64(1) | np.uint64(1)
    _NUMBERS[65:91] = _NUMBERS[97:123]  # A-Z as a-z
    _BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)

    def __init__(self, at_once: int = 1 << 15):
        self.at_once = at_once
        self._reserve(at_once)

    def _reserve(self, n: int) -> None:
        self.powers, self.inverse = (
            [np.cumprod(np.append(np.uint64(1), np.full(n, b, "uint64"))) for b in some]
            for some in (self._BASES, [pow(b, -1, 1 << 64) for b in self._BASES])
        )

    def of(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the words, in order, of a text as bytes that begins and ends with a space."""
        space = self._SPACE.take(text)
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        out, i = np.empty(len(starts), "uint64"), 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + self.at_once, "right")))
            a, b = starts[i:j] - starts[i], ends[i:j] - starts[i]
            if b[-1] > len(self.powers[0]):  # a single long word
                self._reserve(int(b[-1]))
            numbers = self._NUMBERS.take(text[starts[i] : ends[j - 1]])
            sums, found = np.zeros(len(numbers) + 1, "uint64"), []
            for powers, inverse in zip(self.powers, self.inverse):
                np.cumsum(numbers * powers[: len(numbers)], out=sums[1:])
                found.append((sums.take(b) - sums.take(a)) * inverse.take(a))
            out[i:j] = found[0] ^ (found[1] << np.uint64(32) | found[1] >> np.uint64(32))
            i = j
        return starts, out

    def shingles(self, texts: list, size: int) -> Iterator[np.ndarray]:
        """For each text sorted distinct hashes of all runs of ``size`` words, A-Z lowered; a shorter text is one
        run; no words, none."""
        starts, h = self.of(np.frombuffer(b" %b " % b" ".join(texts), "uint8"))
        first = np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in texts)]))
        total = h * MULTIPLIERS[0]
        for k in range(1, min(size, len(h))):
            total[: len(h) - k] += h[k:] * MULTIPLIERS[k]
        total = mix(total)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if a == b:
                yield total[:0]
            elif b - a < size:
                yield mix((h[a:b] * MULTIPLIERS[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                run = np.sort(total[a : b - size + 1])
                yield run[np.append(True, run[1:] != run[:-1])]
