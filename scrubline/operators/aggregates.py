"""Chart and table data: histogram, top values, correlation, pivot, totals."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scrubline.functions.classes import col, columns_of, dtype, is_numeric, quoted, require_numeric
from scrubline.operators.quantiles import grouped_median
from scrubline.operators.sampling import lowest_hashes

AGGREGATES = ("sum", "mean", "count", "min", "max", "median")
ROUNDING = 1e-12  # what is left of a sum of squares by rounding alone


def histogram(df: DataFrame, name: str, bins: int = 30) -> DataFrame:
    """Counts in equally wide bins between minimum and maximum, empty bins included.

    The maximum belongs to the last bin. A constant column has all its values in bin 0.
    """
    require_numeric(df, name)
    value = col(name).cast("double")
    ends = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("s")).scalar()
    width = (ends["hi"] - ends["lo"]) / bins
    number = F.when(width > 0, F.least(F.floor(F.try_divide(value - ends["lo"], width)), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = df.where(value.isNotNull()).groupBy(number.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin", (ends["lo"] + width * F.col("bin")).alias("bin_low"),
        (ends["lo"] + width * (F.col("bin") + 1)).alias("bin_high"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("count"))


def scatter_sample(df: DataFrame, x: str, y: str, key: list[str], n: int = 5_000, seed: int = 42) -> DataFrame:
    """The points of a scatter plot: all rows, or n random ones of a larger table."""
    require_numeric(df, x, y)
    return lowest_hashes(df.select(*[col(c) for c in dict.fromkeys([*key, x, y])]), n, key, seed)


def top_values(df: DataFrame, name: str, k: int = 15) -> DataFrame:
    """The k most frequent values; equally frequent ones in value order."""
    return (
        df.where(col(name).isNotNull()).groupBy(col(name)).agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), F.asc(quoted(name))).limit(k)
    )


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every pair of columns, over the rows where both have a value: count, sums, squares and products.

    Values are measured from a value of the column itself (``from_x``, ``from_y``), which keeps the sums exact enough.
    """
    sums = origin = None
    with np.errstate(all="ignore"):
        for batch in batches:
            values = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            here = ~np.isnan(values)
            lowest = np.where(np.isfinite(values), values, np.inf).min(axis=0, initial=np.inf)
            lowest = np.where(np.isinf(lowest), np.nan, lowest)
            origin = lowest if origin is None else np.where(np.isnan(origin), lowest, origin)
            values = np.where(here, values - np.nan_to_num(origin), 0.0)
            here = here.astype(float)
            part = np.stack([here.T @ here, values.T @ here, (values * values).T @ here, values.T @ values])
            sums = part if sums is None else sums + part
    if sums is not None:
        i, j = np.triu_indices(sums.shape[1])
        count, total, square, product = sums
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (i, j, count[i, j], total[i, j], total[j, i], square[i, j], square[j, i], product[i, j])]
            + [pa.array(origin[k], from_pandas=True) for k in (i, j)],
            names=["i", "j", "n", "x", "y", "xx", "yy", "xy", "from_x", "from_y"])


def correlation_matrix(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns, one row per cell.

    Each pair uses the rows where both values are present; NaN counts as missing. One scan: every task multiplies
    matrices and passes on a row per pair, whose sums are then measured from a common origin and added.
    Cells of a column without spread, or with infinite values, are NULL.
    """
    names = names or columns_of(df, "numeric")
    require_numeric(df, *names)
    if len(names) < 2:
        raise ValueError("two numeric columns are needed")
    width = len(names)
    numbers = df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    parts = numbers.mapInArrow(_pair_sums, (
        "i bigint, j bigint, n double, x double, y double, xx double, yy double, xy double, from_x double, from_y double"))
    pair = W.partitionBy("i", "j")
    dx, dy = (F.coalesce(F.col(c) - F.min(c).over(pair), F.lit(0.0)) for c in ("from_x", "from_y"))
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    moved = parts.withColumns({"dx": dx, "dy": dy}).select(
        "i", "j", "n", (x + n * F.col("dx")).alias("x"), (y + n * F.col("dy")).alias("y"),
        (F.col("xx") + 2 * F.col("dx") * x + n * F.col("dx") * F.col("dx")).alias("xx"),
        (F.col("yy") + 2 * F.col("dy") * y + n * F.col("dy") * F.col("dy")).alias("yy"),
        (F.col("xy") + F.col("dx") * y + F.col("dy") * x + n * F.col("dx") * F.col("dy")).alias("xy"))
    pairs = moved.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])

    def spread(total: str, square: str) -> Column:
        found = F.col(square) - F.try_divide(F.col(total) * F.col(total), F.col("n"))
        return F.when(found > F.col(square) * ROUNDING, F.sqrt(found))

    shared = F.col("xy") - F.try_divide(F.col("x") * F.col("y"), F.col("n"))
    corr = F.try_divide(shared, spread("x", "xx") * spread("y", "yy"))
    corr = F.when(F.col("i") == F.col("j"), F.when(spread("x", "xx") > 0, 1.0)).when(F.abs(corr) > 1, F.signum(corr)).otherwise(corr)
    finite = F.abs(F.col("xx")) + F.abs(F.col("yy")) < float("inf")
    pairs = pairs.select("i", "j", F.when(finite, corr).alias("corr"))
    cells = df.sparkSession.range(width * width).select(F.floor(F.col("id") / width).alias("a"), (F.col("id") % width).alias("b"))
    cells = cells.select("a", "b", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))
    named = F.array(*[F.lit(c) for c in names])
    return cells.join(pairs, ["i", "j"], "left").select(
        F.get(named, F.col("a").cast("int")).alias("column_x"), F.get(named, F.col("b").cast("int")).alias("column_y"), "corr")


def _aggregate(name: str, value: Column) -> Column:
    if name == "sum":
        return F.coalesce(F.sum(value), F.lit(0))
    return {"mean": F.avg, "count": F.count, "min": F.min, "max": F.max}[name](value)


def _pivot_key(columns: list[str]) -> Column:
    """The values of the column fields as one name, the separator escaped inside values."""
    def part(c: str) -> Column:
        text = col(c).cast("string")
        return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")) if len(columns) > 1 else text
    return F.concat_ws("|", *[part(c) for c in columns])


def _cells(df: DataFrame, rows: list[str], value: str, agg: str, columns: list[str], median_options: dict) -> DataFrame:
    """One row for each combination of the row and column fields, with its value as ``__cell``."""
    if agg not in AGGREGATES:
        raise ValueError(f"agg must be one of {AGGREGATES}")
    if not rows:
        raise ValueError("at least one row field is needed")
    for c in [*rows, *columns]:
        dtype(df, c)
    if agg != "count" and not is_numeric(df, value):
        raise TypeError(f"column {value!r} is not numeric")
    fields = list(dict.fromkeys([*rows, *columns]))
    present = df
    for c in fields:
        present = present.where(col(c).isNotNull())
    if agg == "median":
        return grouped_median(present, fields, value, "__cell", **median_options)
    cells = present.groupBy(*[col(c) for c in fields]).agg(_aggregate(agg, col(value)).alias("__cell"))
    return cells if agg in ("sum", "count") else cells.where(F.col("__cell").isNotNull())


def pivot_table(
    df: DataFrame, rows: list[str], value: str, agg: str = "sum", columns: list[str] | None = None,
    column_values: list[str] | None = None, **median_options,
) -> DataFrame:
    """Aggregate ``value`` by row fields, spread over the values of the column fields.

    Rows with a missing key are left out and missing cells are 0. For mean, min, max and median a
    cell without any value vanishes, and with it a row group that has none; sum and count keep
    it as 0. Cells are aggregated before the pivot, so the pivot itself handles one row per cell.
    ``column_values`` names the result columns and saves the job that finds them. Over 10,000 values the
    engine refuses that many columns; ``pivot_sparse`` has no such limit.
    """
    columns = columns or []
    cells = _cells(df, rows, value, agg, columns, median_options)
    if not columns:
        return cells.withColumnRenamed("__cell", value)
    spread = cells.select(*[col(c) for c in rows], _pivot_key(columns).alias("__key"), "__cell")
    wide = spread.groupBy(*[col(c) for c in rows]).pivot("__key", column_values).agg(F.first("__cell"))
    return wide.select(*[col(c) if c in rows else F.coalesce(col(c), F.lit(0)).alias(c) for c in wide.columns])


def pivot_sparse(
    df: DataFrame, rows: list[str], value: str, agg: str = "sum", columns: list[str] | None = None, part_cells: int = 10_000, **median_options,
) -> DataFrame:
    """``pivot_table`` of any width: per row group a map ``cells`` of the cells there are, by the name their column would have.

    A missing entry stands for 0. A row group of more than ``part_cells`` cells comes as several rows, numbered by ``part``, so no
    row outgrows a task: a cell's part follows from its name.
    """
    if not columns:
        raise ValueError("at least one column field is needed")
    cells = _cells(df, rows, value, agg, columns, median_options).select(*[col(c) for c in rows], _pivot_key(columns).alias("__key"), "__cell")
    keys = [col(c) for c in rows]
    sizes = cells.groupBy(*keys).agg(F.count("*").alias("__n"))
    same = reduce(lambda a, b: a & b, [F.col(f"__r{i}").eqNullSafe(col(c)) for i, c in enumerate(rows)])
    parts = F.ceil(F.col("__n") / part_cells).cast("int")
    dealt = cells.join(sizes.select(*[col(c).alias(f"__r{i}") for i, c in enumerate(rows)], "__n"), same)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("__key"), parts).cast("int"))
    return dealt.groupBy(*keys, "part").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__key", "__cell")))).alias("cells"))


def group_totals(df: DataFrame, name: str, value: str | None = None) -> DataFrame:
    """Rows per location, or the sum of a value per location (0 where all values are missing)."""
    total = F.count("*") if value is None else F.coalesce(F.sum(col(value)), F.lit(0))
    if value is not None:
        require_numeric(df, value)
    return df.where(col(name).isNotNull()).groupBy(col(name)).agg(total.alias("value"))
