"""Words and word shingles of many texts at once as 64-bit hashes, and their MinHash values.

A word is a longest run of bytes other than the six ASCII white-space characters. A shingle is
``size`` successive words; a text with fewer words, but at least one, has one shingle of all its words;
a text without words has none. All work is done on numpy arrays over blocks of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import worker_state

SIZE = 5
BLOCK = 1 << 19  # bytes of text handled at a time; one longer text makes a block of its own
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


BASE = 0x5851F42D4C957F2D
BYTE = stream(1, 256)
PLACE = stream(2, 64) | np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\x0b\x0c\r")] = True


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each; a worker keeps those of a usual block."""
    kept = worker_state("shingles").get("powers")
    if kept and len(kept[0]) >= n:
        return kept
    size = max(n, BLOCK + 4096)
    made = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        made.append(np.cumprod(steps, dtype=np.uint64))
    if size <= 4 * BLOCK:
        worker_state("shingles")["powers"] = made
    return made


def blocks(texts: list[bytes], limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word, and for each text the number of its first word, closed by the number of all."""
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    power, inverse = _tables(len(data))
    space = SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    total = np.cumsum(BYTE[data] * power[: len(data)], dtype=np.uint64)
    hashes = mix((total[ends - 1] - total[starts - 1]) * inverse[starts])
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return hashes, np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]) + 1)


def shingle_hashes(texts: list[bytes], size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all texts in turn (repeats included), and how many each text has."""
    words, first = word_hashes(texts)
    n = np.diff(first)
    counts = np.maximum(n - size + 1, np.minimum(n, 1))
    if not len(words):
        return words, counts
    padded = np.concatenate([words, np.zeros(size - 1, np.uint64)])
    sums = np.zeros(len(words), np.uint64)
    for i in range(size):
        sums += padded[i : len(words) + i] * PLACE[i]
    for d in np.flatnonzero((n > 0) & (n < size)):
        own = words[first[d] : first[d + 1]]
        sums[first[d]] = np.sum(np.append(own * PLACE[: len(own)], PLACE[size + len(own)]), dtype=np.uint64)
    place = np.arange(len(words)) - np.repeat(first[:-1], n)
    return mix(sums[place < np.repeat(counts, n)]), counts


class MinHash:
    """Universal hash functions h(x) = (a x + b) mod 2^64, a odd, of which the high bits count.

    Of each minimum the highest 16 bits are kept: two sets agree in a value with the probability of their
    Jaccard similarity, plus 2^-16 for chance. A text without shingles has 0xFFFF everywhere.
    """

    def __init__(self, permutations: int = 128, size: int = SIZE):
        self.size = size
        self.a, self.b = stream(3, permutations) | np.uint64(1), stream(4, permutations)

    def of_shingles(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.full((len(counts), len(self.a)), 0xFFFF, np.uint16)
        full = np.flatnonzero(counts)
        if not len(full):
            return out
        starts = (np.cumsum(counts) - counts)[full]
        values = np.empty_like(shingles)
        lows = np.empty((len(self.a), len(full)), np.uint64)
        for k in range(len(self.a)):
            np.multiply(shingles, self.a[k], out=values)
            np.add(values, self.b[k], out=values)
            np.minimum.reduceat(values, starts, out=lows[k])
        out[full] = (lows >> np.uint64(48)).astype(np.uint16).T
        return out

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """One row of values per text."""
        parts = [self.of_shingles(*shingle_hashes(texts[i:j], self.size)) for i, j in blocks(texts)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.a)), np.uint16)
