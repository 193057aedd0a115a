"""Indel similarity of two texts: 100 * 2 * LCS / (total length), rounded half to even."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 16
LANES = 2048  # 64-bit words that are worked on at a time
LANE_WORDS = 8  # a lane's most words


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one row of the table per machine-word operation.

    Bit i of the state is 0 where the table grows at position i of ``a``.
    """
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & where.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def code_points(texts: list[str]) -> np.ndarray:
    """Texts as rows of code points, zero behind their end."""
    width = max(map(len, texts), default=0)
    return np.array(texts, f"<U{max(1, width)}").view(np.uint32).reshape(len(texts), -1)


def lcs_lengths(first: list[str], second: list[str]) -> np.ndarray:
    """``lcs_length`` of many pairs at once: a pair is a lane of 64-bit words, and all lanes take the same steps."""
    out = np.zeros(len(first), np.int64)
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in zip(first, second)]
    words = np.array([-(-len(a) // 64) for a, _ in pairs])
    steps = np.array([len(b) for _, b in pairs])
    order = np.lexsort((steps, words))
    order = order[words[order] > 0]
    at = 0
    while at < len(order):
        n = int(words[order[at]])
        if n > LANE_WORDS:  # one big number holds such a text's state as well
            for i in order[at:]:
                out[i] = lcs_length(*pairs[i])
            break
        last = min(at + max(1, LANES // n), int(np.searchsorted(words[order], n, side="right")))
        own = order[at:last]
        out[own] = _lanes([pairs[i][0] for i in own], [pairs[i][1] for i in own], n)
        at = last
    return out


def _lanes(a: list[str], b: list[str], words: int) -> np.ndarray:
    lanes = np.arange(len(a))
    left, right = code_points(a), code_points(b)
    lengths, ends = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
    left_in, right_in = np.arange(left.shape[1]) < lengths[:, None], np.arange(right.shape[1]) < ends[:, None]
    letters = np.unique(left[left_in])
    # number 0 is for what occurs in no first text, and for places behind the end
    right = np.where(right_in & np.isin(right, letters), np.searchsorted(letters, right) + 1, 0)
    left = np.searchsorted(letters, left) + 1
    where = np.zeros((words, len(letters) + 1, len(a)), np.uint64)
    for i in range(left.shape[1]):
        has = np.flatnonzero(left_in[:, i])
        where[i // 64, left[has, i], has] |= np.uint64(1 << (i % 64))
    state = np.full((words, len(a)), np.iinfo(np.uint64).max)
    for j in range(right.shape[1]):
        carry = np.zeros(len(a), np.uint64)
        for w in range(words):
            found = where[w, right[:, j], lanes]
            now = state[w]
            part = now + (now & found)
            total = part + carry
            carry = ((part < now) | (total < part)).astype(np.uint64)
            state[w] = total | (now & ~found)
    left_over = np.zeros(len(a), np.int64)
    for w in range(words):
        bits = np.clip(lengths - 64 * w, 0, 64)
        mask = np.where(bits >= 64, np.iinfo(np.uint64).max, (np.uint64(1) << np.minimum(bits, 63).astype(np.uint64)) - np.uint64(1))
        left_over += np.bitwise_count(state[w] & mask)
    return lengths - left_over


@F.pandas_udf(T.LongType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(lcs_lengths(a.tolist(), b.tolist()))


def similarity(common: Column, total: Column) -> Column:
    """The score from the LCS length and the summed length of both texts (two empty texts: 100)."""
    return F.when(total == 0, 100).otherwise(F.bround(F.try_divide(common * 200.0, total), 0)).cast("int")


def letter_counts(value: Column) -> Column:
    """How often characters of each of 16 classes occur; the classes are the codes modulo 16."""
    codes = F.transform(F.split(value, ""), lambda ch: F.pmod(F.ascii(ch), F.lit(BUCKETS)))
    return F.transform(
        F.sequence(F.lit(0), F.lit(BUCKETS - 1)),
        lambda i: F.size(F.filter(codes, lambda c: c == i)))


def lcs_bound(a: Column, b: Column) -> Column:
    """An upper bound of the LCS length from two ``letter_counts``."""
    # spelled out, so that the test compiles into the join's loop
    return reduce(lambda x, y: x + y, [F.least(a[i], b[i]) for i in range(BUCKETS)])
