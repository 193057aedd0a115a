"""Splitting a table into ranges of its order key.

A window without ``partitionBy`` moves the whole table to one task. The ordered operators instead
cut the table at literal bounds of the order key, work inside each range, and carry one summary
row per range across. Any bounds give a right result; even ones give an even load.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.functions.classes import NUMERIC, col, fresh_name, wall_micros
from scrubline.session import measured_bytes

RANGE_BYTES = 64 << 20  # of whole rows, since the windows carry all columns
MAX_RANGES = 16_384  # bounds what passes through the driver; a larger table has larger ranges, which windows spill
SAMPLES_PER_RANGE = 20


def key_of(order_by: list[str]) -> Column:
    """All order columns as one comparable value, missing values first."""
    return F.struct(*[col(c).alias(f"k{i}") for i, c in enumerate(order_by)])


def with_ranges(df: DataFrame, order_by: list[str], name: str, ranges: int | None = None) -> tuple[DataFrame, bool]:
    """Add the number of the range each row falls into, and say whether there is more than one.

    The cut points come from a sample whose size depends on the range count alone. They cut the
    first order column, if that is a number or a time without dominant values; otherwise they
    are keys of all order columns.
    """
    keys = df.select(key_of(order_by).alias("k"))
    if ranges is None:
        ranges = math.ceil(measured_bytes(df) / RANGE_BYTES)
    if ranges < 2:
        return df.withColumn(name, F.lit(0)), False
    rows = df.count()
    ranges = min(ranges, MAX_RANGES, rows)
    if ranges < 2:
        return df.withColumn(name, F.lit(0)), False
    kind = keys.schema["k"].dataType
    place = _place(F.col("k.k0"), kind.fields[0].dataType)
    texts = [F.col(f"k.{f.name}").cast("string").alias(f.name) for f in kind.fields]
    share = min(1.0, ranges * SAMPLES_PER_RANGE / rows)
    drawn = keys.sample(share, seed=42).orderBy("k").select(place.alias("place"), *texts).collect()
    cuts = drawn[max(1, math.ceil(len(drawn) / ranges))::max(1, math.ceil(len(drawn) / ranges))]
    if not cuts:
        return df.withColumn(name, F.lit(0)), False
    places = [c["place"] for c in cuts]
    if all(p is not None and math.isfinite(p) for p in places) and all(p < q for p, q in zip(places, places[1:])):
        at = fresh_name(df, "__place")
        cutter = Bucketizer(splits=[-math.inf, *places, math.inf], inputCol=at, outputCol=name, handleInvalid="keep")
        first = _place(col(order_by[0]), kind.fields[0].dataType)
        cut = cutter.transform(df.withColumn(at, F.coalesce(first, F.lit(-math.inf)))).drop(at)
        return cut.withColumn(name, F.col(name).cast("int")), True
    return df.withColumn(name, _search(key_of(order_by), cuts, kind)), True


def _place(value: Column, kind: T.DataType) -> Column:
    """A number that never falls as the key rises; NULL for types without one."""
    if isinstance(kind, NUMERIC):
        return value.cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("double")
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        return wall_micros(value).cast("double")
    return F.lit(None).cast("double")


def _search(key: Column, cuts: list, kind: T.StructType) -> Column:
    """How many cut points are not above the key, by binary search in a literal array."""
    structs = ["struct(" + ", ".join(_literal(c[f.name], f.dataType) for f in kind.fields) + ")" for c in cuts]
    # sorted again, since a text form may round a key
    array = F.expr(f"sort_array(cast(array({', '.join(structs)}) as array<{kind.simpleString()}>))")

    def middle(s: Column) -> Column:
        return F.floor((s["lo"] + s["hi"]) / 2).cast("int")

    # the state is the interval of counts still possible
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(math.ceil(math.log2(MAX_RANGES)) + 1)),
        F.struct(F.lit(0).alias("lo"), F.size(array).alias("hi")),
        lambda s, _: F.when(s["lo"] >= s["hi"], s)
        .when(F.get(array, middle(s)) <= key, F.struct((middle(s) + 1).alias("lo"), s["hi"].alias("hi")))
        .otherwise(F.struct(s["lo"].alias("lo"), middle(s).alias("hi"))),
        lambda s: s["lo"],
    )


def _literal(text: str | None, kind: T.DataType) -> str:
    if text is None:
        return f"cast(null as {kind.simpleString()})"
    return f"cast(decode(unhex('{text.encode().hex()}'), 'utf-8') as {kind.simpleString()})"
