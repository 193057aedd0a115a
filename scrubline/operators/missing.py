"""Dropping and filling missing values (the order-dependent fills are in ``ordered``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.functions.classes import col, dtype, is_datetime, is_numeric, replace_column, wall_micros, wall_time
from scrubline.operators.quantiles import quantile_columns


def drop_null_rows(df: DataFrame, name: str) -> DataFrame:
    dtype(df, name)
    return df.where(col(name).isNotNull())


def _as_number(df: DataFrame, name: str) -> Column:
    if is_numeric(df, name, with_bool=True):
        return col(name).cast("double")
    if is_datetime(df, name):
        return wall_micros(col(name)).cast("double")
    raise TypeError(f"column {name!r} is {dtype(df, name).simpleString()}: it has no mean or median")


def _back(df: DataFrame, name: str, number: Column) -> Column:
    """A statistic in the type the filled column gets: double, or the date type."""
    if is_datetime(df, name):
        return wall_time(F.floor(number).cast("bigint")).cast(dtype(df, name))
    return number


def _filled(df: DataFrame, name: str, statistic: Column) -> DataFrame:
    value = col(name) if is_datetime(df, name) else col(name).cast("double")
    return replace_column(df, name, F.coalesce(value, _back(df, name, statistic)))


def fill_mean(df: DataFrame, name: str) -> DataFrame:
    """Fill with the mean of the column; numbers become double."""
    mean = df.agg(F.avg(_as_number(df, name)).alias("m")).scalar()
    return _filled(df, name, mean)


def fill_median(df: DataFrame, name: str, approx: bool = False) -> DataFrame:
    """Fill with the exact median of the column; numbers become double."""
    median = quantile_columns(df.select(_as_number(df, name).alias("v")), {"v": [0.5]}, approx)["v"][0]
    return _filled(df, name, median)


def mode_of(df: DataFrame, name: str) -> Column:
    """The most frequent value, the smallest of equally frequent ones; NULL without values.

    Values are counted by a grouped aggregate: no task holds the counts of a whole column.
    """
    value = col(name)
    best = (
        df.where(value.isNotNull()).groupBy(value.alias("v")).agg((-F.count("*")).alias("n"))
        .agg(F.min(F.struct("n", "v"))["v"].alias("v"))
    )
    return best.scalar()


def fill_mode(df: DataFrame, name: str) -> DataFrame:
    """Fill with the most frequent value; a text column without any value is filled with ''."""
    fallback = [F.lit("")] if isinstance(dtype(df, name), T.StringType) else []
    return replace_column(df, name, F.coalesce(col(name), mode_of(df, name), *fallback))


def fill_value(df: DataFrame, name: str, value) -> DataFrame:
    """Fill with a constant. A numeric column needs a number, and keeps its type if that fits."""
    if value is None or value == "":
        raise ValueError("the value to fill with is empty")
    kind = dtype(df, name)
    if is_numeric(df, name, with_bool=True):
        try:
            number = float(value)
        except ValueError as error:
            raise ValueError(f"column {name!r} is numeric, {value!r} is no number") from error
        whole = number.is_integer() and isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}.get(type(kind), 0)
        if whole and abs(number) < 2**bits:
            return replace_column(df, name, F.coalesce(col(name), F.lit(int(number)).cast(kind)))
        return replace_column(df, name, F.coalesce(col(name).cast("double"), F.lit(number)))
    if isinstance(kind, T.StringType):
        return replace_column(df, name, F.coalesce(col(name), F.lit(str(value))))
    if is_datetime(df, name):
        return replace_column(df, name, F.coalesce(col(name), F.lit(str(value)).cast(kind)))
    raise TypeError(f"column {name!r} is {kind.simpleString()} and cannot be filled with a constant")


def null_remaining(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count_if(col(name).isNull()).alias("remaining"))
