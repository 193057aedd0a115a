"""Recipes: a list of named steps that can be replayed on any table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from scrubline.functions import convert, text
from scrubline.operators import columns, missing, ordered, outliers

STEPS: dict[str, Callable[..., DataFrame]] = {
    "drop_null_rows": missing.drop_null_rows,
    "fill_mean": missing.fill_mean,
    "fill_median": missing.fill_median,
    "fill_mode": missing.fill_mode,
    "fill_value": missing.fill_value,
    "ffill": ordered.ffill,
    "bfill": ordered.bfill,
    "interpolate": ordered.interpolate,
    "rename_column": columns.rename_column,
    "drop_columns": columns.drop_columns,
    "drop_duplicates": columns.drop_duplicates,
    "clean_text": text.clean_text,
    "find_replace": text.find_replace,
    "convert": convert.typed,
    "remove_outliers": outliers.remove_outliers,
    "cap_outliers": outliers.cap_outliers,
}
LOG_SCHEMA = "step int, action string, detail string, time string, shape string"


@dataclass(frozen=True)
class Step:
    action: str
    params: dict = field(default_factory=dict)

    def detail(self) -> str:
        return ", ".join(f"{k}={v}" for k, v in self.params.items())


@dataclass
class Recipe:
    """Steps in order. Earlier states of a table are prefixes of the recipe applied to its source."""

    steps: list[Step] = field(default_factory=list)

    def add(self, action: str, /, **params) -> Recipe:
        """A new recipe with one more step."""
        if action not in STEPS:
            raise ValueError(f"action must be one of {sorted(STEPS)}")
        return Recipe([*self.steps, Step(action, params)])

    def prefix(self, n: int) -> Recipe:
        return Recipe(self.steps[:n])

    def apply(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = STEPS[step.action](df, **step.params)
        return df

    def apply_logged(self, df: DataFrame, source: str = "table", count_rows: bool = False) -> tuple[DataFrame, DataFrame]:
        """The result and the log as a table.

        ``count_rows`` adds row counts to the shapes; each is a Spark job of its own.
        """
        log = [_entry(1, "load", f"Loaded '{source}'", df, count_rows)]
        for i, step in enumerate(self.steps):
            df = STEPS[step.action](df, **step.params)
            log.append(_entry(i + 2, step.action, step.detail(), df, count_rows))
        return df, log_frame(df.sparkSession, log)


def _entry(number: int, action: str, detail: str, df: DataFrame, count_rows: bool) -> tuple:
    rows = f"{df.count():,}" if count_rows else "?"
    return number, action, detail, datetime.now().strftime("%H:%M:%S"), f"{rows} × {len(df.columns)}"


def log_frame(spark: SparkSession, entries: list[tuple]) -> DataFrame:
    return spark.createDataFrame(entries, LOG_SCHEMA)
