"""Joins of two tables on one column each, and stacking."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.functions.classes import col, dtype, fresh_name, is_datetime, is_numeric, is_text, quoted

HOW = ("inner", "left", "right", "outer")
HEAVY_KEY = 5_000_000  # rows of one key that a single task may join


def check_key_types(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> None:
    """Reject keys of different classes before anything runs."""
    for test in (is_text, lambda d, c: is_numeric(d, c, with_bool=True), is_datetime):
        if test(left, left_key) != test(right, right_key):
            raise TypeError(
                f"join keys differ in type: {left_key!r} is {dtype(left, left_key).simpleString()}, "
                f"{right_key!r} is {dtype(right, right_key).simpleString()}; convert one of them, "
                "and trim text keys")


def most_rows_of_a_key(df: DataFrame, key: str) -> int:
    """About how many rows share the most frequent key, a missing one included: from a mergeable sketch of a fixed size, in one scan of the key."""
    top = df.agg(F.expr(f"approx_top_k(xxhash64({quoted(key)}), 1)").alias("top")).head()["top"]
    return top[0]["count"] if top else 0


def join_tables(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner", heavy_key: int = HEAVY_KEY) -> DataFrame:
    """Equi-join where missing keys match each other.

    Keys of the same name give one key column; keys of different names are both kept. Other
    names on both sides get ``_x`` and ``_y``. Null-safe equality is an equi-join for the
    planner: it broadcasts a side measured small and sort-merges otherwise, and adaptive
    execution splits a key that holds much of the table, the missing key included. It cannot in a full
    join: an outer join whose most frequent key has over ``heavy_key`` rows on a side is put together from
    a left and an anti join, which read both sides twice. A scan of the keys decides; both ways give the same rows.
    """
    if how not in HOW:
        raise ValueError(f"how must be one of {HOW}")
    check_key_types(left, right, left_key, right_key)
    same_key = left_key == right_key
    shared = set(left.columns) & set(right.columns)
    if same_key:
        shared -= {left_key}

    def named(columns: list[str], suffix: str) -> list[str]:
        return [c + suffix if c in shared else c for c in columns]

    left_names, right_names = named(left.columns, "_x"), named(right.columns, "_y")
    kept_right = [c for c in right_names if not (same_key and c == right_key)]
    out = left_names + kept_right
    if len(set(out)) != len(out):
        raise ValueError("the suffixes _x and _y lead to equal column names; rename columns first")

    # positional names keep both sides apart during the join
    a = left.select(*[col(c).alias(f"l{i}") for i, c in enumerate(left.columns)])
    b = right.select(*[col(c).alias(f"r{i}") for i, c in enumerate(right.columns)])
    a_key, b_key = f"l{left.columns.index(left_key)}", f"r{right.columns.index(right_key)}"
    same = F.col(a_key).eqNullSafe(F.col(b_key))
    if how == "outer" and most_rows_of_a_key(a, a_key) <= heavy_key and most_rows_of_a_key(b, b_key) <= heavy_key:
        joined = a.join(b, same, "full")
    elif how == "outer":
        # adaptive execution can split a dominant key in left and anti joins, not in full joins
        alone = b.join(a.select(a_key).distinct(), same, "left_anti")
        joined = a.join(b, same, "left").unionByName(alone, allowMissingColumns=True)
    else:
        joined = a.join(b, same, how)

    picked = []
    for i, name in enumerate(left_names):
        value = F.col(f"l{i}")
        if same_key and left.columns[i] == left_key:
            if how == "right":
                value = F.col(b_key)
            elif how == "outer":
                value = F.coalesce(F.col(a_key), F.col(b_key))
        picked.append(value.alias(name))
    for i, name in enumerate(right_names):
        if not (same_key and right.columns[i] == right_key):
            picked.append(F.col(f"r{i}").alias(name))
    return joined.select(*picked)


def join_summary(left: DataFrame, right: DataFrame, merged: DataFrame) -> DataFrame:
    """Row counts, match rate (can exceed 100 %) and number of columns added."""
    rows_left = left.agg(F.count("*").alias("n")).scalar()
    rows_right = right.agg(F.count("*").alias("n")).scalar()
    return merged.agg(F.count("*").alias("rows_merged")).select(
        rows_left.alias("rows_left"), rows_right.alias("rows_right"), "rows_merged",
        F.try_divide(F.col("rows_merged") * 100.0, F.greatest(rows_left, rows_right)).alias("match_rate"),
        F.lit(len(merged.columns) - len(left.columns)).cast("bigint").alias("columns_added"))


def join_columns(left: DataFrame, right: DataFrame, merged: DataFrame) -> DataFrame:
    """Per merged column: type, counts and the table it comes from (suffixed names: ``Both``)."""
    one = merged.agg(F.count("*").alias("rows"),
                     *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(merged.columns)])

    def source(c: str) -> str:
        return "File 1" if c in left.columns else "File 2" if c in right.columns else "Both"

    entries = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(f"c{i}").alias("non_null"),
                        (F.col("rows") - F.col(f"c{i}")).alias("nulls"), F.lit(source(c)).alias("source"))
               for i, (c, t) in enumerate(merged.dtypes)]
    return one.select(F.explode(F.array(*entries)).alias("x")).select("x.*")


def keep_rows(df: DataFrame, flagged: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key is among the flagged ones; missing keys match each other, as in joins."""
    return _by_key(df, flagged, key, "left_semi")


def drop_rows(df: DataFrame, flagged: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key is not among the flagged ones; missing keys match each other, as in joins."""
    return _by_key(df, flagged, key, "left_anti")


def _by_key(df: DataFrame, flagged: DataFrame, key: list[str], how: str) -> DataFrame:
    names = [fresh_name(df, f"__flagged{i}") for i in range(len(key))]
    other = flagged.select(*[col(k).alias(n) for k, n in zip(key, names)])
    return df.join(other, reduce(and_, (col(k).eqNullSafe(F.col(n)) for k, n in zip(key, names))), how)


def append_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """Stack two tables by column name; a column only one of them has is missing in the other."""
    return first.unionByName(second, allowMissingColumns=True)
