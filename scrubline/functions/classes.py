"""Column classes and the missing-value rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)
KINDS = {"numeric": NUMERIC, "text": (T.StringType,), "datetime": DATETIME}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col(quoted(name))


def dtype(df: DataFrame, name: str) -> T.DataType:
    if name not in df.columns:
        raise ValueError(f"no column {name!r}; the columns are {df.columns}")
    return df.schema[name].dataType


def columns_of(df: DataFrame, kind: str) -> list[str]:
    """The columns of one class: ``numeric`` (no booleans), ``text`` or ``datetime``."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {sorted(KINDS)}")
    return [f.name for f in df.schema.fields if isinstance(f.dataType, KINDS[kind])]


def is_numeric(df: DataFrame, name: str, with_bool: bool = False) -> bool:
    kinds = NUMERIC + ((T.BooleanType,) if with_bool else ())
    return isinstance(dtype(df, name), kinds)


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(dtype(df, name), T.StringType)


def is_datetime(df: DataFrame, name: str) -> bool:
    return isinstance(dtype(df, name), DATETIME)


def require_numeric(df: DataFrame, *names: str) -> None:
    for name in names:
        if not is_numeric(df, name):
            raise TypeError(f"column {name!r} is {dtype(df, name).simpleString()}, a number is needed")


def require_text(df: DataFrame, name: str) -> None:
    if not is_text(df, name):
        raise TypeError(f"column {name!r} is {dtype(df, name).simpleString()}, text is needed")


def normalize_missing(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in floating columns: one notion of "missing" for every operator.

    Without it ``NaN > 5`` is true in Spark and a NaN would count as an outlier.
    """
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floating:
        return df
    return df.select(
        *[F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floating else col(c) for c in df.columns]
    )


def replace_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Put ``value`` in place of one column, keeping the column order."""
    dtype(df, name)
    return df.select(*[value.alias(c) if c == name else col(c) for c in df.columns])


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name the frame does not have."""
    name = base
    while name in df.columns:
        name = "_" + name
    return name


def wall_micros(value: Column) -> Column:
    """Microseconds from 1970 to a wall-clock time, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), value.cast("timestamp_ntz"))


def wall_time(micros: Column) -> Column:
    """The wall-clock time a number of microseconds after 1970."""
    seconds = (micros.cast("decimal(24,6)") / 1_000_000).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
