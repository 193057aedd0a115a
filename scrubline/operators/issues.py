"""Issue detection: what is wrong with a table, and whether it can be fixed automatically."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.functions.classes import columns_of
from scrubline.operators.profile import iqr_counts, row_profile

# The thresholds, in percent, and the words of the issue records.
CRITICAL_NULLS = 50.0
WARNING_NULLS = 5.0
CRITICAL_DUPLICATES = 10.0
OUTLIERS = 5.0
ALL_COLUMNS = "All columns"
NULLS_TEXT = "%.1f%% missing values"
DUPLICATES_TEXT = "%s duplicate rows (%.1f%%)"
NUMBERS_TEXT = "Stored as text but looks like numbers"
DATES_TEXT = "Stored as text but looks like dates"
OUTLIERS_TEXT = "%s outliers detected (%.1f%%)"


def _issue(when: Column, severity: Column, kind: str, column: str, detail: Column, action: Column, fixable: bool) -> Column:
    return F.when(when, F.struct(
        severity.alias("severity"), F.lit(kind).alias("type"), F.lit(column).alias("column"),
        detail.alias("detail"), action.alias("action"), F.lit(fixable).alias("auto_fixable")))


def detect_issues(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per issue, ``position`` giving the order in which fixes are to be applied.

    The profile is one scan with one shuffle, the outlier counts a second scan; the rules are then
    evaluated on the single profile row, so the plan holds no per-column job and no driver step.
    """
    one = row_profile(df)
    numbers, texts = columns_of(df, "numeric"), columns_of(df, "text")
    rows = F.col("rows")
    found: list[Column] = []

    for i, c in enumerate(df.columns):
        pct = F.try_divide(F.get("nulls", F.lit(i)) * 100.0, rows)
        high = pct > CRITICAL_NULLS
        found.append(_issue(
            pct > WARNING_NULLS, F.when(high, "critical").otherwise("warning"), "missing_values", c,
            F.format_string(NULLS_TEXT, pct), F.when(high, "drop_or_fill").otherwise("fill"), True))

    copies = F.col("duplicates")
    pct = F.try_divide(copies * 100.0, rows)
    found.append(_issue(
        copies > 0, F.when(pct < CRITICAL_DUPLICATES, "warning").otherwise("critical"), "duplicates", ALL_COLUMNS,
        F.format_string(DUPLICATES_TEXT, F.format_number(copies, 0), pct), F.lit("remove"), True))

    for i, c in enumerate(texts):
        filled = F.get("nulls", F.lit(df.columns.index(c))) < rows
        found.append(_issue(
            filled & F.get("numeric_text", F.lit(i)), F.lit("warning"), "datatype", c,
            F.lit(NUMBERS_TEXT), F.lit("convert_numeric"), True))
        found.append(_issue(
            F.get("date_text", F.lit(i)), F.lit("warning"), "datatype", c,
            F.lit(DATES_TEXT), F.lit("convert_datetime"), True))

    if numbers:
        one = one.withColumn("outliers", iqr_counts(df, approx).select("outliers").scalar())
        for i, c in enumerate(numbers):
            n = F.get("outliers", F.lit(i))
            pct = F.try_divide(n * 100.0, rows)
            found.append(_issue(
                pct > OUTLIERS, F.lit("info"), "outliers", c,
                F.format_string(OUTLIERS_TEXT, F.format_number(n, 0), pct), F.lit("review"), False))

    return (
        one.select(F.posexplode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("position", "x"))
        .select("position", "x.*")
    )


def issue_counts(issues: DataFrame) -> DataFrame:
    """Issues by severity and how many of them can be fixed automatically."""
    return issues.groupBy("severity").agg(
        F.count("*").alias("issues"), F.count_if(F.col("auto_fixable")).alias("auto_fixable"))
