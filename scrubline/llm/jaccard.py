"""N-gram Jaccard join with Bayesian pruning of candidates.

Candidate pairs come from MinHash bands. Their signatures are compared STEP values at a time. With a uniform prior on the
similarity s, after m agreements among n values P(s >= t) is the chance that a binomial variable of n + 1 trials with
probability t is at most m. A pair is dropped as soon as that falls below the tolerance, so
a pair of similarity t or more is lost with at most the tolerance per step. What is left is verified exactly.

Defined results: see ``links.classes``; other columns are ignored, repeated rows are copies; a text of fewer than five words has one
shingle of all its words; an empty table gives no rows.
"""

from __future__ import annotations

from fractions import Fraction
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, unused
from .links import classes, digest_of

THRESHOLD = Fraction(4, 5)
TOLERANCE = 1e-6
STEP = 16
ROWS, BANDS = 4, 32  # a pair at the threshold misses all bands with probability 5e-8


def least_agreements(n: int, threshold: Fraction, tolerance: float) -> int:
    """The least m for which the posterior of reaching the threshold is not below the tolerance."""
    t, below = float(threshold), 0.0
    for m in range(n + 1):
        below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if below >= tolerance:
            return m
    return n


def pruner(permutations: int, threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE, step: int = STEP):
    """Which pairs of signatures are still likely enough to reach the threshold after all values."""
    limits = [(n, least_agreements(n, threshold, tolerance)) for n in range(step, permutations + 1, step)]

    def survive(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        alive = np.arange(len(a))
        agreed = np.zeros(len(a), np.int64)
        for n, least in limits:
            agreed += (a[alive, n - step : n] == b[alive, n - step : n]).sum(1)
            alive, agreed = alive[agreed >= least], agreed[agreed >= least]
        return alive

    return survive


def jaccard_join(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per row of df: the key, class_id, n_copies, n_links, row and class_row (which are never null), said (a digest of the
    text), and node and root, which stand for the row's words and its class."""
    found = classes(df, key, text, ROWS, BANDS, threshold, pruner(ROWS * BANDS, threshold, tolerance))
    return found.withColumnRenamed("id", key)


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: Fraction = THRESHOLD) -> DataFrame:
    """The rows of df that name their class, one for each. Where the lowest key of a class stands for several of its texts, the one with the
    lowest digest is meant. Columns of any name are kept."""
    own, said = unused(df, "own", "said")
    named = jaccard_join(df, key, text, threshold).where("row = class_row")
    chosen = named.groupBy("root").agg(F.min("row").alias(own), F.min("said").alias(said)).drop("root")
    chosen = materialize(chosen, "chosen")
    row = F.coalesce(F.col(key).cast("bigint"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    # repeated rows meet map-side, and the shuffle that removes them is the join's
    rows = df.withColumns({own: row, said: digest_of(text)}).dropDuplicates([own, said])
    return rows.join(chosen.hint("merge"), [own, said]).select(*df.columns)
