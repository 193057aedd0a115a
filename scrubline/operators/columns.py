"""Column selection and duplicate removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.functions.classes import col, columns_of, dtype
from scrubline.operators.profile import distinct_rows

WORDS = 1 << 20  # of 64 bits in the filter of repeated rows: a broadcast of at most some 32 MB


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    dtype(df, old)
    if not new:
        raise ValueError("the new name is empty")
    if new == old:
        return df
    if new in df.columns:
        raise ValueError(f"a column {new!r} exists already")
    return df.select(*[col(c).alias(new) if c == old else col(c) for c in df.columns])


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    for name in names:
        dtype(df, name)
    return df.select(*[col(c) for c in df.columns if c not in set(names)])


def select_by_class(df: DataFrame, kind: str) -> DataFrame:
    """The numeric, text or datetime columns."""
    return df.select(*[col(c) for c in columns_of(df, kind)])


def _with_repeats(df: DataFrame) -> tuple[DataFrame, str]:
    """df and a boolean column, which is true for every row that has a copy and, by chance, for a few others.

    A Bloom filter of one hash: 64-bit hashes of rows are counted, those seen twice set bits, and the words with any are broadcast.
    There are WORDS of them at most; where so many rows have copies that the filter fills up, more rows are marked.
    """
    word, bits, marked = (_unused(df, x) for x in ("word", "bits", "marked"))
    place = F.pmod(F.xxhash64(*[col(c) for c in df.columns]), F.lit(64 * WORDS))
    hashes = df.select(F.xxhash64(*[col(c) for c in df.columns]).alias("hash"))
    twice = hashes.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select(F.pmod("hash", F.lit(64 * WORDS)).alias("place"))
    words = twice.groupBy(F.shiftrightunsigned("place", 6).alias(word)).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias(bits))
    rows = df.withColumn(marked, place)  # the place, until it is known whether its bit is set
    looked = rows.withColumn(word, F.shiftrightunsigned(F.col(marked), 6)).join(F.broadcast(words), word, "left")
    is_set = F.expr(f"coalesce(shiftrightunsigned({bits}, cast({marked} & 63 as int)) & 1, 0) = 1")
    return looked.select(*[col(c) for c in df.columns], is_set.alias(marked)), marked


def _unused(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Keep one of equal rows.

    Only rows that a filter of repeated rows marks are shuffled, and copies are removed map-side before; all others pass through where
    they are. The shuffle of the whole table is one of 64-bit hashes. The table is read three times and must give the same rows each time.
    """
    if any(t.startswith("map<") for _, t in df.dtypes):
        raise TypeError("map columns cannot be compared; convert them to arrays of entries first")
    if not df.columns:
        return distinct_rows(df).drop("__n")
    rows, marked = _with_repeats(df)
    alone = rows.where(~F.col(marked)).drop(marked)
    return alone.union(distinct_rows(rows.where(marked).drop(marked)).drop("__n"))
