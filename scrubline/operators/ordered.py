"""Operators that depend on row order: row numbers, forward and backward fill, interpolation.

A Spark table has no order, so each takes ``order_by``; the columns together must identify a row
(within ``partition_by``, if given). The work is done in two phases, see ``ranges``: a window
inside (partition, range of the order key), and one summary row per such range that is carried
to the next ones. Neither the whole table nor a dominant partition key ever meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scrubline.functions.classes import col, is_datetime, is_numeric, quoted, replace_column, wall_micros, wall_time
from scrubline.operators.ranges import with_ranges

RANGE = "__range"


def _with_range(df: DataFrame, order_by: list[str], ranges: int | None) -> tuple[DataFrame, bool]:
    if not order_by:
        raise ValueError("a table has no row order: order_by is needed")
    return with_ranges(df, order_by, RANGE, ranges)


def _windows(order_by: list[str], partition_by: list[str], forward: bool = True):
    """Windows inside a range and across ranges.

    Looking back in falling order is how the rows ahead are read: a frame that starts at the
    current row and ends at the last one would be computed anew for every row.
    """
    turn = F.asc if forward else F.desc
    inside = W.partitionBy(*[col(c) for c in partition_by], F.col(RANGE)).orderBy(*[turn(quoted(c)) for c in order_by])
    across = W.partitionBy(*[col(c) for c in partition_by]).orderBy(turn(RANGE))
    return inside, across


def _latest(value: Column, window) -> Column:
    return F.last(value, ignorenulls=True).over(window.rowsBetween(W.unboundedPreceding, W.currentRow))


def _before(value: Column, window) -> Column:
    return F.last(value, ignorenulls=True).over(window.rowsBetween(W.unboundedPreceding, -1))


def _carry(
    df: DataFrame, partition_by: list[str], summary: list[Column], carried: list[Column]
) -> DataFrame:
    """Join what earlier (or later) ranges hand over to the rows of each range.

    The summary has one row per (partition, range); a window over it meets at most as many rows
    per partition as there are ranges.
    """
    keys = [*partition_by, RANGE]
    held = df.groupBy(*[col(k) for k in keys]).agg(*summary)
    held = held.select(*[col(k).alias(f"__h{i}") for i, k in enumerate(keys)], *carried)
    match = None
    for i, k in enumerate(keys):
        test = col(k).eqNullSafe(F.col(f"__h{i}"))
        match = test if match is None else match & test
    return df.join(held, match, "left").drop(*[f"__h{i}" for i in range(len(keys))])


def number_rows(
    df: DataFrame, order_by: list[str], name: str = "row_number", partition_by: list[str] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Consecutive row numbers from 1 by the order key."""
    ranged, split = _with_range(df, order_by, ranges)
    return _numbered(ranged, order_by, name, partition_by or [], split).select(*[col(c) for c in df.columns], col(name))


def _numbered(ranged: DataFrame, order_by: list[str], name: str, parts: list[str], split: bool) -> DataFrame:
    inside, across = _windows(order_by, parts)
    local = F.row_number().over(inside).cast("bigint")
    if not split:
        return ranged.withColumn(name, local)
    before = F.coalesce(F.sum("__rows").over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    carried = _carry(ranged, parts, [F.count("*").alias("__rows")], [before.alias("__before")])
    return carried.withColumn(name, local + F.col("__before")).drop("__before")


def _fill(df: DataFrame, name: str, order_by: list[str], partition_by: list[str] | None, ranges: int | None, forward: bool) -> DataFrame:
    parts = partition_by or []
    value = col(name)
    ranged, split = _with_range(df, order_by, ranges)
    inside, across = _windows(order_by, parts, forward)
    local = _latest(value, inside)
    if not split:
        return replace_column(ranged, name, local).select(*[col(c) for c in df.columns])
    # the last (or first) value of a range: the value of the greatest (or least) key that has one
    keyed = F.when(value.isNotNull(), F.struct(*[col(c).alias(f"k{i}") for i, c in enumerate(order_by)], value.alias("v")))
    held = (F.max(keyed) if forward else F.min(keyed))["v"].alias("__held")
    carried = _carry(ranged, parts, [held], [_before(F.col("__held"), across).alias("__far")])
    return replace_column(carried, name, F.coalesce(local, F.col("__far"))).select(*[col(c) for c in df.columns])


def ffill(df: DataFrame, name: str, order_by: list[str], partition_by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """The last seen value; leading missing values stay."""
    return _fill(df, name, order_by, partition_by, ranges, forward=True)


def bfill(df: DataFrame, name: str, order_by: list[str], partition_by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """The next value; trailing missing values stay."""
    return _fill(df, name, order_by, partition_by, ranges, forward=False)


def interpolate(
    df: DataFrame, name: str, order_by: list[str], partition_by: list[str] | None = None, ranges: int | None = None,
) -> DataFrame:
    """Linear by row position: leading missing values stay, trailing ones take the last value.

    Numbers become double; dates are interpolated in microseconds; text stays as it is.
    """
    if is_datetime(df, name):
        kind = df.schema[name].dataType
        micros = replace_column(df, name, wall_micros(col(name)).cast("double"))
        done = interpolate(micros, name, order_by, partition_by, ranges)
        back = wall_time(F.floor(col(name)).cast("bigint")).cast(kind)
        return replace_column(done, name, back)
    if not is_numeric(df, name):
        return df
    parts = partition_by or []
    data = replace_column(df, name, col(name).cast("double"))
    ranged, split = _with_range(data, order_by, ranges)
    inside, across = _windows(order_by, parts)
    value = col(name)
    ahead, ahead_across = _windows(order_by, parts, forward=False)
    point = F.when(value.isNotNull(), F.struct(F.col("__row").alias("at"), value.alias("v")))
    # positions first, since points carried across ranges need them
    rows = _numbered(ranged, order_by, "__row", parts, split)
    rows = rows.withColumn("__prev", _latest(point, inside)).withColumn("__next", _latest(point, ahead))
    if split:
        rows = _carry(
            rows, parts, [F.max(point).alias("__last"), F.min(point).alias("__first")],
            [_before(F.col("__last"), across).alias("__from"), _before(F.col("__first"), ahead_across).alias("__to")])
        rows = rows.withColumn("__prev", F.coalesce("__prev", "__from")).withColumn("__next", F.coalesce("__next", "__to"))
    p, n = F.col("__prev"), F.col("__next")
    between = p["v"] + (n["v"] - p["v"]) * F.try_divide(F.col("__row") - p["at"], n["at"] - p["at"])
    filled = F.when(value.isNotNull(), value).when(p.isNull(), F.lit(None)).when(n.isNull(), p["v"]).otherwise(between)
    return replace_column(rows, name, filled).select(*[col(c) for c in df.columns])
