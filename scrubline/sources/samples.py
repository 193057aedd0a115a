"""A generated table with known defects, for trying the tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Shares of the generated cities and ratings, the rest of each being missing.
CITIES = [("Mumbai", 0.30), ("Delhi", 0.30), ("Bangalore", 0.20), ("Chennai", 0.15)]
RATINGS = [(1.0, 0.05), (2.0, 0.05), (3.0, 0.15), (4.0, 0.35), (5.0, 0.35)]
MISSING_AGES, OUTLIERS, COPIES = 20, 10, 8


def _unit(seed: int) -> Column:
    """A number in [0, 1) from the row id."""
    return F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / float(1 << 30)


def _normal(seed: int, mean: float, std: float) -> Column:
    angle = F.cos(_unit(seed) * 6.283185307179586)
    return F.lit(mean) + F.sqrt(-2 * F.log(1 - _unit(seed + 100))) * angle * std


def _draw(seed: int, shares: list) -> Column:
    out, upto = None, 0.0
    for value, share in shares:
        upto += share
        test = _unit(seed) < round(upto, 6)
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out


def sample_dirty(spark: SparkSession, n: int = 300, seed: int = 42) -> DataFrame:
    """n customers, with padded names, gaps, ten far amounts, and the first eight rows repeated."""
    base = spark.range(1, n + 1)
    # the rows with the lowest hashes lose their age
    ageless = base.orderBy(F.xxhash64(F.lit(seed + 9), "id")).limit(min(MISSING_AGES, n)).withColumn("__ageless", F.lit(True))
    rows = base.join(ageless, "id", "left")
    name = F.concat(F.lit("Customer "), F.col("id").cast("string"))
    table = rows.select(
        F.col("id").alias("customer_id"),
        F.when(F.col("id") % 7 == 0, F.concat(F.lit("  "), name, F.lit("  "))).otherwise(name).alias("name"),
        F.when(F.col("__ageless").isNull(), F.floor(_unit(seed) * 52 + 18).cast("double")).alias("age"),
        _draw(seed + 1, CITIES).alias("city"),
        F.when(F.col("id") > n - OUTLIERS, _normal(seed + 2, 20000.0, 2000.0))
        .otherwise(_normal(seed + 3, 2000.0, 500.0)).alias("purchase_amount"),
        F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), (F.col("id") - 1).cast("int")), "yyyy-MM-dd").alias("signup_date"),
        _draw(seed + 4, RATINGS).alias("rating"),
    )
    return table.unionByName(table.where(F.col("customer_id") <= COPIES))
