"""Automatic fixes of detected issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.functions.classes import col, dtype, is_numeric, is_text, replace_column
from scrubline.functions.convert import guess_formats, to_float, to_timestamp
from scrubline.operators.columns import drop_duplicates
from scrubline.operators.issues import detect_issues
from scrubline.operators.missing import fill_mode
from scrubline.operators.profile import duplicate_count
from scrubline.operators.quantiles import quantile_row

# The wording of the list of actions.
MEDIAN, MODE = "Filled '{}' with median", "Filled '{}' with mode"
COPIES = "Removed {:,} duplicate rows"
NUMBER, DATE = "Converted '{}' to numeric", "Converted '{}' to datetime"
SKIPPED = "Could not auto-fix {}"
# types whose text form has the order of the values
PLAIN = (T.StringType, T.BooleanType, T.DateType, T.TimestampNTZType)


def fill_statistics(df: DataFrame, names: list[str]) -> dict[str, Column]:
    """What fills each column: the median of numbers, else the most frequent value.

    All medians come from one pass, all modes of plain columns from one grouped count of
    (column, value).
    """
    numbers = [c for c in names if is_numeric(df, c)]
    plain = [c for c in names if c not in numbers and isinstance(dtype(df, c), PLAIN)]
    fills: dict[str, Column] = {}
    if numbers:
        row = quantile_row(df, {c: [0.5] for c in numbers}).head()
        fills |= {c: F.lit(q[0]).cast("double") for c, q in zip(numbers, row)}
    if plain:
        cells = F.array(*[F.struct(F.lit(i).alias("i"), col(c).cast("string").alias("v")) for i, c in enumerate(plain)])
        best = (
            df.select(F.explode(cells).alias("x")).where(F.col("x.v").isNotNull())
            .groupBy("x.i", "x.v").agg((-F.count("*")).alias("n"))
            .groupBy("i").agg(F.min(F.struct("n", "v"))["v"].alias("v")).collect()
        )
        found = {plain[r["i"]]: r["v"] for r in best}
        for c in plain:
            empty = "" if isinstance(dtype(df, c), T.StringType) else None
            fills[c] = F.lit(found.get(c, empty)).cast(dtype(df, c))
    return fills


def auto_fix(df: DataFrame, issues: list | None = None) -> tuple[DataFrame, list[str]]:
    """Apply all fixable issues in their order; returns the fixed table and what was done.

    Missing values are filled (median for numbers, else the most frequent value), whatever their
    share; copies are removed; text is converted to numbers, then to dates. A column listed for
    both conversions becomes a date if it holds eight-digit dates, else a number. The driver gets
    the issue list, one value per filled column and the number of copies.
    """
    if issues is None:
        issues = detect_issues(df).orderBy("position").collect()
    issues = [i for i in issues if i["auto_fixable"]]

    def listed(test: str, value: str) -> list[str]:
        return [i["column"] for i in issues if i[test] == value]

    fills = fill_statistics(df, listed("type", "missing_values"))
    # the formats are read off the source table, which holds all values that can occur
    formats = guess_formats(df, listed("action", "convert_datetime"))
    fixed, actions = df, []
    for issue in issues:
        name = issue["column"]
        if issue["type"] == "missing_values":
            if name in fills:
                value = col(name).cast("double") if is_numeric(df, name) else col(name)
                fixed = replace_column(fixed, name, F.coalesce(value, fills[name]))
            else:
                fixed = fill_mode(fixed, name)
            actions.append((MEDIAN if is_numeric(df, name) else MODE).format(name))
        elif issue["type"] == "duplicates":
            removed = duplicate_count(fixed).head()["duplicates"]
            fixed = drop_duplicates(fixed)
            actions.append(COPIES.format(removed))
        elif issue["action"] == "convert_numeric":
            if formats.get(name) != "%Y%m%d":
                fixed = to_float(fixed, name)
                actions.append(NUMBER.format(name))
        elif issue["action"] == "convert_datetime" and is_text(fixed, name):
            if formats[name] is None:
                actions.append(SKIPPED.format(name))
                continue
            fixed = to_timestamp(fixed, name, formats[name])
            actions.append(DATE.format(name))
    return fixed, actions
