"""Trend data, regular time grids and additive seasonal decomposition."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scrubline.functions.classes import col, is_datetime, require_numeric, wall_micros, wall_time
from scrubline.operators.ordered import interpolate
from scrubline.session import cut_lineage

DAY = 86_400_000_000
BLOCK = 100_000


def trend(df: DataFrame, date: str, value: str) -> DataFrame:
    """The rows with both a date and a value, by date."""
    return df.where(col(date).isNotNull() & col(value).isNotNull()).orderBy(col(date))


@dataclass(frozen=True)
class Grid:
    """A regular time grid: ``points`` steps from ``start`` (microseconds of the wall clock)."""

    kind: str  # fixed, month_start, month_end or weekdays
    start: int
    step: int  # microseconds, months or weekdays
    points: int

    def at(self, i: Column) -> Column:
        start = wall_time(F.lit(self.start))
        if self.kind == "fixed":
            return wall_time(F.lit(self.start) + i * self.step)
        if self.kind == "weekdays":
            # start on the Monday before, count five days a week
            day = F.weekday(start)
            n = i + day
            days = F.floor(n / 5) * 7 + n % 5 - day
            return wall_time(F.lit(self.start) + days * DAY)
        months = F.add_months(start.cast("date"), (i * self.step).cast("int"))
        months = F.last_day(months) if self.kind == "month_end" else months
        in_day = self.start % DAY
        return wall_time(wall_micros(months) + in_day)


def infer_grid(df: DataFrame, date: str) -> Grid:
    """The grid the dates lie on: a constant gap, a whole-month step, weekdays, else days.

    No ordering is needed: n different dates lie on a grid of n points exactly if every offset
    from the first is a multiple of (last - first) / (n - 1). Two aggregates decide.
    """
    micros = wall_micros(col(date))
    dates = df.where(col(date).isNotNull()).select(col(date).alias("d"), micros.alias("u"))
    day, month = F.col("d").cast("date"), F.year("d") * 12 + F.month("d")
    ends = dates.agg(F.count("*").alias("n"), F.min("u").alias("lo"), F.max("u").alias("hi"),
                     F.min(month).alias("m0"), F.max(month).alias("m1")).head()
    n, lo, hi = ends["n"], ends["lo"], ends["hi"]
    if n < 3:
        raise ValueError("at least 3 dates are needed to find their frequency")
    gap = (hi - lo) // (n - 1)
    months = (ends["m1"] - ends["m0"]) // (n - 1)
    in_day = F.col("u") % DAY == lo % DAY
    # the calendar day number, 1970-01-05 being a Monday
    first_day = lo // DAY
    days = F.floor(F.col("u") / DAY).cast("bigint")
    weekday = F.weekday("d")
    found = dates.agg(
        F.count_distinct("u").alias("different"),
        (F.bool_and((F.col("u") - lo) % max(gap, 1) == 0)).alias("fixed"),
        F.bool_and(in_day & (F.dayofmonth("d") == 1) & ((month - ends["m0"]) % max(months, 1) == 0)).alias("starts"),
        F.bool_and(in_day & (day == F.last_day(day)) & ((month - ends["m0"]) % max(months, 1) == 0)).alias("finals"),
        F.bool_and(in_day & (weekday < 5)).alias("weekdays"),
        F.max(days).alias("last_day"),
    ).head()
    if found["different"] < n:
        raise ValueError(f"column {date!r} holds equal dates; give agg= to combine them")
    if gap > 0 and found["fixed"] and gap * (n - 1) == hi - lo:
        return Grid("fixed", lo, gap, n)
    if months > 0 and months * (n - 1) == ends["m1"] - ends["m0"]:
        if found["starts"]:
            return Grid("month_start", lo, months, n)
        if found["finals"]:
            return Grid("month_end", lo, months, n)
    if found["weekdays"] and _weekdays(first_day, found["last_day"]) == n:
        return Grid("weekdays", lo, 1, n)
    return Grid("fixed", lo, DAY, (hi - lo) // DAY + 1)


def _weekdays(first: int, last: int) -> int:
    """Mondays to Fridays between two day numbers, both included."""
    def upto(day: int) -> int:
        weeks, rest = divmod(day + 3, 7)  # day 0 is a Thursday
        return weeks * 5 + min(rest + 1, 5)
    return upto(last) - upto(first - 1)


def _series(df: DataFrame, date: str, value: str, agg: str | None) -> DataFrame:
    if not is_datetime(df, date):
        raise TypeError(f"column {date!r} is no date; convert it first")
    require_numeric(df, value)
    rows = df.where(col(date).isNotNull() & col(value).isNotNull()).select(
        col(date).cast("timestamp_ntz").alias("date"), col(value).cast("double").alias("value"))
    if agg:
        if agg not in ("sum", "mean", "min", "max", "count"):
            raise ValueError("agg must be sum, mean, min, max or count")
        rows = rows.groupBy("date").agg(getattr(F, "avg" if agg == "mean" else agg)("value").cast("double").alias("value"))
        rows = cut_lineage(rows)  # read for the grid and again for the values
    return rows


def regularize(df: DataFrame, date: str, value: str, agg: str | None = None, ranges: int | None = None) -> DataFrame:
    """One row per step of the inferred grid (``position``, ``date``, ``value``), gaps interpolated.

    Equal dates are an error unless ``agg`` says how to combine them. Without a common step the
    grid is daily from the first date, and rows off that grid are lost; ``grid_losses`` counts them.
    The grid comes from a distributed range, not from one exploded array.
    """
    rows = _series(df, date, value, agg)
    return _on_grid(rows, infer_grid(rows, "date"), ranges)


def _on_grid(rows: DataFrame, grid: Grid, ranges: int | None) -> DataFrame:
    points = rows.sparkSession.range(grid.points).select(
        F.col("id").alias("position"), grid.at(F.col("id")).alias("date"))
    return interpolate(points.join(rows, "date", "left").select("position", "date", "value"), "value", ["position"], ranges=ranges)


def grid_losses(df: DataFrame, date: str, value: str, agg: str | None = None) -> DataFrame:
    """How many points the series has (``points``) and how many of them no step of its grid meets (``off_grid``)."""
    rows = _series(df, date, value, agg)
    grid = infer_grid(rows, "date")
    # all other grids are only inferred where they meet every point
    off = (wall_micros(F.col("date")) - grid.start) % grid.step != 0 if grid.kind == "fixed" else F.lit(False)
    return rows.agg(F.count("*").alias("points"), F.count_if(off).alias("off_grid"))


def moving_average(series: DataFrame, period: int, block: int = BLOCK) -> DataFrame:
    """Adds ``trend``: the centred moving average over one period, NULL at the edges.

    An even period takes both ends at half weight. The dense positions are cut into blocks, each
    joined by the few rows of its neighbours that its windows reach, so that blocks are averaged
    independently.
    """
    half = period // 2
    size = max(block, period)
    home = F.floor(F.col("position") / size).cast("bigint")
    offset = F.col("position") % size
    blocks = F.filter(F.array(
        home,
        F.when(offset < half, home - 1),
        F.when(offset >= size - half, home + 1)), lambda b: b.isNotNull())
    spread = series.select("*", home.alias("__home"), F.explode(blocks).alias("__block"))
    window = W.partitionBy("__block").orderBy("position")
    full = F.count("value").over(window.rowsBetween(-half, half)) == 2 * half + 1
    if period % 2:
        mean = F.sum("value").over(window.rowsBetween(-half, half)) / period
    else:
        mean = (F.sum("value").over(window.rowsBetween(-half, half - 1))
                + F.sum("value").over(window.rowsBetween(-half + 1, half))) / (2 * period)
    return (spread.withColumn("trend", F.when(full, mean))
            .where(F.col("__block") == F.col("__home")).drop("__block", "__home"))


def decompose(
    df: DataFrame, date: str, value: str, period: int = 7, agg: str | None = None, block: int = BLOCK,
    ranges: int | None = None,
) -> DataFrame:
    """Additive decomposition into trend, seasonal part and residual.

    The seasonal part is the mean deviation from the trend per position within the period, shifted
    to mean zero. At least two full periods are needed.
    """
    if period < 2:
        raise ValueError("the period must be at least 2")
    rows = _series(df, date, value, agg)
    grid = infer_grid(rows, "date")
    if grid.points < 2 * period:
        raise ValueError(f"{2 * period} data points are needed for period {period}, there are {grid.points}")
    series = _on_grid(rows, grid, ranges)
    smooth = moving_average(series, period, block).withColumn("__phase", F.col("position") % period)
    # one row per position within the period
    means = smooth.where(F.col("trend").isNotNull()).groupBy("__phase").agg(F.avg(F.col("value") - F.col("trend")).alias("__mean"))
    centre = means.agg(F.avg("__mean").alias("m")).scalar()
    seasonal = F.col("__mean") - centre
    return smooth.join(means, "__phase", "left").select(
        "date", "value", "trend", seasonal.alias("seasonal"),
        (F.col("value") - F.col("trend") - seasonal).alias("residual"))
