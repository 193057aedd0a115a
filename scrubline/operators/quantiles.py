"""Exact quantiles with linear interpolation, at any size.

The built-in ``percentile`` keeps a value-to-count map per column in one task. That is the fastest
plan while the input is small, and it is used only behind a check of the input's size. Beyond it:

* whole columns: one scan makes a mergeable sketch of every column, which brackets each wanted rank.
  While a bracket holds many rows, a further scan counts what lies below it and sketches what lies inside.
  The last scan counts values inside brackets and gaps between them, all columns and ranks
  at once. Only the few inner values are sorted; two scans do for up to hundreds of millions of rows;
* per group: values are counted per group, split into value ranges, and only the range that holds
  the wanted rank is sorted. A group holding most of the table is spread over all ranges.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scrubline.functions.classes import col
from scrubline.operators.ranges import with_ranges
from scrubline.session import measured_bytes

ONE_PASS_BYTES = 32 << 20
BRACKET_ROWS = 1_000_000
ACCURACY = 10_000
SKETCH = 8192  # size of a quantile sketch: ranks are off by 0.07 percent at most, as a rule


def quantile_row(
    df: DataFrame,
    wanted: dict[str, list[float]],
    approx: bool = False,
    one_pass_bytes: int = ONE_PASS_BYTES,
    bracket_rows: int = BRACKET_ROWS,
) -> DataFrame:
    """One row with an array ``q0``, ``q1``, ... per wanted column, NULL entries for an empty one.

    A lazy aggregate for a small input or with ``approx``, literals otherwise.
    """
    if approx or measured_bytes(df.select(*[col(c) for c in wanted])) <= one_pass_bytes:
        parts = []
        for i, (name, probs) in enumerate(wanted.items()):
            value, array = col(name).cast("double"), F.array(*[F.lit(float(p)) for p in probs])
            found = F.percentile_approx(value, array, ACCURACY) if approx else F.percentile(value, array)
            parts.append(found.alias(f"q{i}"))
        return df.agg(*parts)
    values = exact_quantiles(df, wanted, bracket_rows)
    return df.sparkSession.range(1).select(*[
        F.array(*[F.lit(v).cast("double") for v in vs]).alias(f"q{i}") for i, vs in enumerate(values.values())])


def quantile_columns(df: DataFrame, wanted: dict[str, list[float]], approx: bool = False, **sizes) -> dict[str, list[Column]]:
    """Expressions for the wanted quantiles of several columns, usable in any query of the session."""
    if not wanted:
        return {}
    row = quantile_row(df, wanted, approx, **sizes)
    stats = row.select(F.struct(*row.columns).alias("s")).scalar()
    return {c: [stats[f"q{i}"][j] for j in range(len(probs))] for i, (c, probs) in enumerate(wanted.items())}


def exact_quantiles(
    df: DataFrame, wanted: dict[str, list[float]], bracket_rows: int = BRACKET_ROWS, sketch: int = SKETCH
) -> dict[str, list[float | None]]:
    """The wanted quantiles as numbers (see the module text). NaN counts as the largest value."""
    names = list(wanted)
    data = df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    values = [F.nanvl(F.col(f"c{i}"), F.lit(None).cast("double")) for i in range(len(names))]
    parts = [x for i, v in enumerate(values) for x in (F.count(f"c{i}").alias(f"n{i}"), F.count(v).alias(f"m{i}"), F.kll_sketch_agg_double(v, F.lit(sketch)).alias(f"s{i}"))]
    # the only row of the first scan: counts and sketches, of a size that the data do not change
    first = data.agg(*parts).head()
    places = {(i, p): p * (first[f"n{i}"] - 1) for i, c in enumerate(names) for p in wanted[c] if first[f"n{i}"]}
    ranks = sorted({(i, k) for (i, _), at in places.items() for k in (math.floor(at), math.ceil(at))})
    found = {(i, k): math.nan for i, k in ranks if k >= first[f"m{i}"]}
    found |= _at_ranks(data.select(*[v.alias(f"c{i}") for i, v in enumerate(values)]), [t for t in ranks if t not in found],
                       {i: (first[f"s{i}"], first[f"m{i}"]) for i in range(len(names))}, bracket_rows, sketch)

    def value(i: int, p: float) -> float | None:
        if (i, p) not in places:
            return None
        at = places[(i, p)]
        part = at - math.floor(at)
        low, high = found[(i, math.floor(at))], found[(i, math.ceil(at))]
        return low if part == 0 else (1 - part) * low + part * high

    return {c: [value(i, p) for p in wanted[c]] for i, c in enumerate(names)}


def _at_ranks(data: DataFrame, ranks: list[tuple[int, int]], sketches: dict[int, tuple[bytes, int]], bracket_rows: int, sketch: int) -> dict[tuple[int, int], float]:
    """The values at (column number, rank from 0) of the columns c0, c1, ..., given a sketch and the size of each column."""
    # what a sketch says holds for the values of a bracket: of the whole column at first
    whole = {c: {"sketch": made, "before": 0, "inside": n, "narrow": False} for c, (made, n) in sketches.items()}
    within = {t: whole[t[0]] | {"reach": 1.0} for t in ranks}
    found: dict[tuple[int, int], float] = {}
    while within:
        brackets = _proposed(data, within, sketch)
        wide = {t for t, x in within.items() if x["inside"] * 4 * x["reach"] * _error(sketch) > bracket_rows and not x["narrow"]}
        if wide:  # narrow first: the next sketches hold the values inside
            got = _narrowed(data, {t: brackets[t] for t in wide}, sketch)
            # equal values, or brackets that touch, can be as narrow as they get
            within |= {t: x | {"reach": within[t]["reach"], "narrow": 2 * x["inside"] > within[t]["inside"]} for t, x in got.items()}
            missed = wide - set(got)
        else:
            got = _counted(data, brackets)
            found |= got
            within = {t: x for t, x in within.items() if t not in got}
            missed = set(within)
        # a sketch can miss a rank: from the whole column again, looking further around it
        within |= {t: whole[t[0]] | {"reach": 4 * within[t]["reach"]} for t in missed}
    return found


def _error(sketch: int) -> float:
    """The share of the values by which a rank read from a sketch may be wrong, in all but one of a hundred cases."""
    return 2.296 / sketch**0.9021


def _proposed(data: DataFrame, within: dict, sketch: int) -> dict[tuple[int, int], tuple[float, float]]:
    """For each rank two values between which it lies, but for a rare miss."""
    shares = {}
    for t, x in within.items():
        at, n, off = t[1] - x["before"], x["inside"], x["reach"] * _error(sketch)
        shares[t] = F.array(*[F.lit(min(max(q, 0.0), 1.0)) for q in (at / n - off, (at + 1) / n + off)])
    read = [F.kll_sketch_get_quantile_double(F.lit(x["sketch"]), shares[t]).alias(f"q{k}") for k, (t, x) in enumerate(within.items())]
    row = data.sparkSession.range(1).select(*read).head()
    return {t: (row[f"q{k}"][0], row[f"q{k}"][1]) for k, t in enumerate(within)}


def _intervals(brackets: dict[tuple[int, int], tuple[float, float]]) -> dict[int, list[tuple[float, float]]]:
    """Per column the brackets in order, those that touch as one."""
    merged: dict[int, list[tuple[float, float]]] = {}
    for (c, _), (low, high) in sorted(brackets.items(), key=lambda x: (x[0][0], x[1])):
        own = merged.setdefault(c, [])
        if own and low <= own[-1][1]:
            own[-1] = (own[-1][0], max(own[-1][1], high))
        else:
            own.append((low, high))
    return merged


def _narrowed(data: DataFrame, brackets: dict, sketch: int) -> dict:
    """For the ranks that lie inside their brackets: sketches and counts of the values there, from one scan."""
    merged = _intervals(brackets)
    parts = []
    for c, own in merged.items():
        v = F.col(f"c{c}")
        for k, (low, high) in enumerate(own):
            inside = F.when(v.between(F.lit(low), F.lit(high)), v)
            parts += [F.count_if(v < F.lit(low)).alias(f"b{c}_{k}"), F.count(inside).alias(f"n{c}_{k}"), F.kll_sketch_agg_double(inside, F.lit(sketch)).alias(f"s{c}_{k}")]
    row = data.agg(*parts).head()
    out = {}
    for t, bracket in brackets.items():
        c = t[0]
        k = next(k for k, (low, high) in enumerate(merged[c]) if low <= bracket[0] <= high)
        before, inside = row[f"b{c}_{k}"], row[f"n{c}_{k}"]
        if before <= t[1] < before + inside:
            out[t] = {"sketch": row[f"s{c}_{k}"], "before": before, "inside": inside}
    return out


def _counted(data: DataFrame, brackets: dict) -> dict[tuple[int, int], float]:
    """The values at those ranks that lie inside their brackets, in one scan.

    A row gives one key a column: its value if it lies inside a bracket, else the gap between brackets. Equal keys meet before they are
    shuffled, so a gap or a frequent value is a row a task, and only the few values inside brackets are sorted, once.
    """
    merged = _intervals(brackets)
    keys = []
    for c, own in merged.items():
        v = F.col(f"c{c}")
        passed = reduce(lambda a, b: a + b, [(v > F.lit(high)).cast("int") for _, high in own])
        inside = reduce(lambda a, b: a | b, [v.between(F.lit(low), F.lit(high)) for low, high in own])
        keys.append(F.when(v.isNotNull(), F.struct(F.lit(c).alias("c"), passed.alias("gap"), F.when(inside, v).alias("v"))))
    counts = data.select(F.explode(F.array(*keys)).alias("x")).where("x is not null").groupBy("x.c", "x.gap", "x.v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("c").orderBy("gap", F.col("v").asc_nulls_first()))
    asked = F.create_map(*[x for c in merged for x in (F.lit(c), F.array(*[F.lit(k).cast("bigint") for d, k in brackets if d == c]))])
    hits = counts.withColumn("upto", upto).withColumn(
        "ranks", F.filter(asked[F.col("c")], lambda k: (k < F.col("upto")) & (k >= F.col("upto") - F.col("n")))).where("size(ranks) > 0 and v is not null")
    return {(r["c"], k): r["v"] for r in hits.select("c", "ranks", "v").collect() for k in r["ranks"]}


def grouped_median(
    df: DataFrame, keys: list[str], value: str, name: str = "median",
    one_pass_bytes: int = ONE_PASS_BYTES, ranges: int | None = None,
) -> DataFrame:
    """The exact median of ``value`` per group of non-null keys; groups without values are left out."""
    data = df.where(col(value).isNotNull()).select(*[col(k) for k in keys], col(value).cast("double").alias("__v"))
    if ranges is None and measured_bytes(data) <= one_pass_bytes:
        return data.groupBy(*[col(k) for k in keys]).agg(F.median("__v").alias(name))
    ranged, _ = with_ranges(data, ["__v"], "__range", ranges)
    counted = ranged.groupBy(*[col(k) for k in keys], F.col("__range"), F.col("__v")).agg(F.count("*").alias("__n"))
    by_key = W.partitionBy(*[col(k) for k in keys])
    # one row per group and value range: at most `ranges` rows meet in a window partition
    held = (
        counted.groupBy(*[col(k) for k in keys], F.col("__range")).agg(F.sum("__n").alias("__in"))
        .withColumn("__upto", F.sum("__in").over(by_key.orderBy("__range")))
        .withColumn("__all", F.sum("__in").over(by_key))
        .withColumn("__low", F.floor((F.col("__all") - 1) / 2))
        .withColumn("__high", F.ceil((F.col("__all") - 1) / 2))
        .withColumn("__before", F.col("__upto") - F.col("__in"))
        .where((F.col("__before") <= F.col("__high")) & (F.col("__upto") > F.col("__low")))
    )
    upto = F.col("__before") + F.sum("__n").over(
        W.partitionBy(*[col(k) for k in keys], F.col("__range")).orderBy("__v"))
    return (
        counted.join(held, [*keys, "__range"])
        .withColumn("__at", upto)
        .where((F.col("__at") > F.col("__low")) & (F.col("__at") - F.col("__n") <= F.col("__high")))
        .groupBy(*[col(k) for k in keys])
        .agg(((F.min("__v") + F.max("__v")) / 2).alias(name))
    )
