"""Small helpers of the subpackage."""

from __future__ import annotations

import sys
from types import ModuleType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# Fixed value: white space that separates words, as a character class of regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once into the shared folder and read it back.

    Later uses neither compute it anew nor depend on files of a single executor. Unlike checkpoint(), which
    runs a plan once to count and once to write, this runs it once.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fraction(*parts: Column | str) -> Column:
    """A number in (0, 1), fixed by the values: the first 52 bits of their MD5."""
    digest = F.md5(F.concat_ws(":", *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << 52)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names no column of df has, in either case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def slices(batch, rows: int = 256):
    """Parts of an Arrow array or batch, so that few of its rows are Python objects, and few results wait, at the same time."""
    for start in range(0, len(batch), rows):
        yield batch.slice(start, rows)


def worker_state(owner: str) -> dict:
    """What a Python worker keeps from one task to the next, for one owner at a time: another's is let go.

    Functions travel to workers by value, so their modules cannot keep it.
    """
    held = sys.modules.setdefault("_scrubline_worker_state", ModuleType("_scrubline_worker_state")).__dict__
    if held.get("owner") != owner:
        held.update(owner=owner, state={})
    return held["state"]
