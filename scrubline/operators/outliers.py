"""Outliers of one numeric column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.functions.classes import col, replace_column, require_numeric
from scrubline.operators.profile import fences
from scrubline.operators.quantiles import quantile_columns

METHODS = ("iqr", "zscore")
# The accepted ranges of the two settings and their defaults.
IQR_RANGE, IQR_DEFAULT = (1.0, 3.0), 1.5
Z_RANGE, Z_DEFAULT = (1.0, 5.0), 3.0


def _setting(method: str, level: float | None) -> float:
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    low, high = IQR_RANGE if method == "iqr" else Z_RANGE
    chosen = (IQR_DEFAULT if method == "iqr" else Z_DEFAULT) if level is None else level
    if not low <= chosen <= high:
        raise ValueError(f"the level of {method} must lie between {low} and {high}")
    return chosen


def _moments(df: DataFrame, name: str) -> tuple[Column, Column]:
    stats = df.agg(F.struct(F.avg(col(name)).alias("mean"), F.stddev_samp(col(name)).alias("std")).alias("s")).scalar()
    return stats["mean"], stats["std"]


def outlier_flag(df: DataFrame, name: str, method: str = "iqr", level: float | None = None, approx: bool = False) -> Column:
    """True for outliers, false otherwise; missing values are no outliers.

    ``iqr``: strictly beyond q1 - m*iqr or q3 + m*iqr. ``zscore``: abs(x - mean) / std > t; a
    column without spread has none.
    """
    level = _setting(method, level)
    require_numeric(df, name)
    value = col(name)
    if method == "iqr":
        _, _, low, high = fences(df, [name], level, approx)[name]
        flag = (value < low) | (value > high)
    else:
        mean, std = _moments(df, name)
        flag = F.when(std != 0, F.abs(F.try_divide(value - mean, std)) > level)
    return F.coalesce(flag, F.lit(False))


def flag_outliers(df: DataFrame, name: str, method: str = "iqr", level: float | None = None, flag: str = "outlier", **options) -> DataFrame:
    return df.select("*", outlier_flag(df, name, method, level, **options).alias(flag))


def find_outliers(df: DataFrame, name: str, method: str = "iqr", level: float | None = None, **options) -> DataFrame:
    """The outlier rows."""
    return df.where(outlier_flag(df, name, method, level, **options))


def remove_outliers(df: DataFrame, name: str, method: str = "iqr", level: float | None = None, **options) -> DataFrame:
    """All rows but the outliers; rows without a value stay."""
    return df.where(~outlier_flag(df, name, method, level, **options))


def cap_outliers(df: DataFrame, name: str, method: str = "iqr", level: float | None = None, approx: bool = False) -> DataFrame:
    """Move values beyond the bounds onto the bounds; missing values stay missing. Result is double."""
    level = _setting(method, level)
    require_numeric(df, name)
    value = col(name).cast("double")
    if method == "iqr":
        _, _, low, high = fences(df, [name], level, approx)[name]
    else:
        mean, std = _moments(df, name)
        low, high = mean - std * level, mean + std * level
    capped = F.when(value < low, low).when(value > high, high).otherwise(value)
    return replace_column(df, name, capped)


def box_stats(df: DataFrame, name: str, approx: bool = False) -> DataFrame:
    """The box of a box plot: five numbers, whiskers and the number of points outside them."""
    require_numeric(df, name)
    value = col(name).cast("double")
    q1, q2, q3 = quantile_columns(df.select(col(name)), {name: [0.25, 0.5, 0.75]}, approx)[name]
    low, high = q1 - (q3 - q1) * IQR_DEFAULT, q3 + (q3 - q1) * IQR_DEFAULT
    inside = value.between(low, high)
    return df.agg(
        F.min(value).alias("min"), F.max(value).alias("max"),
        F.min(F.when(inside, value)).alias("whisker_low"), F.max(F.when(inside, value)).alias("whisker_high"),
        F.count_if((value < low) | (value > high)).alias("outliers"),
    ).select("min", "whisker_low", q1.alias("q1"), q2.alias("median"), q3.alias("q3"), "whisker_high", "max", "outliers")
