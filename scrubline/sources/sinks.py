"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.functions.classes import col


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """A folder of CSV files, each with a header line; nested columns are written as JSON text."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    flat = df.select(*[F.to_json(col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else col(f.name)
                       for f in df.schema.fields])
    flat.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option(
        "emptyValue", "").option("nullValue", "").option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """A folder of Parquet files, the format for tables that are read again."""
    df.write.mode(mode).parquet(path)
    return path
