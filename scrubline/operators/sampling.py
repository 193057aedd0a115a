"""Seeded samples that do not depend on how the table is partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.functions.classes import col
from scrubline.session import measured_bytes

SMALL_BYTES = 256 << 20


HASH_DIGITS = 15


def key_hash(keys: list[str], seed: int) -> Column:
    """A number from 0 to 2^60 - 1: the first hex digits of the MD5 of seed and keys, which other engines have too."""
    parts = [F.lit(str(seed)), *[F.coalesce(col(k).cast("string"), F.lit("")) for k in keys]]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, HASH_DIGITS), 16, 10).cast("bigint")


def lowest_hashes(
    df: DataFrame, n: int, keys: list[str], seed: int = 42, small_bytes: int = SMALL_BYTES
) -> DataFrame:
    """The n rows with the lowest key hashes: a random sample of n rows without replacement.

    On a large table a hash threshold first drops nearly all rows that cannot be among the lowest
    n, so that the top-n never gathers n rows from each of very many partitions. If too few rows
    are below the threshold, the whole table is ranked: the result is always the n lowest.
    """
    order = [key_hash(keys, seed), *[col(k) for k in keys]]
    if measured_bytes(df) > small_bytes:
        rows = df.count()
        share = (4 * n + 1_000) / max(rows, 1)
        if share < 0.5:
            cut = int(share * 16**HASH_DIGITS)
            candidates = df.where(key_hash(keys, seed) < F.lit(cut))
            if candidates.count() >= min(n, rows):
                return candidates.orderBy(*order).limit(n)
    return df.orderBy(*order).limit(n)
