"""The cleaning report: scores, steps and final size."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.operators.profile import quality_score


def cleaning_report(before: DataFrame, after: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Rows of (section, item, value as text): quality, steps applied and final data."""
    first = quality_score(before).select("score").scalar()
    numbers = quality_score(after).select(
        F.explode(F.array(
            _item("quality", "initial_score", F.format_string("%.3f", first)),
            _item("quality", "final_score", F.format_string("%.3f", F.col("score"))),
            _item("quality", "improvement", F.format_string("%.3f", F.col("score") - first)),
            _item("data", "rows", F.col("rows").cast("string")),
            _item("data", "columns", F.lit(str(len(after.columns)))),
            _item("data", "missing_cells", F.col("null_cells").cast("string")),
        )).alias("x")).select("x.*")
    if log is None:
        return numbers
    steps = log.select(
        F.lit("steps").alias("section"), F.col("step").cast("string").alias("item"),
        F.concat_ws(" - ", "action", F.when(F.col("detail") != "", F.col("detail"))).alias("value"))
    return numbers.unionByName(steps)


def _item(section: str, item: str, value):
    return F.struct(F.lit(section).alias("section"), F.lit(item).alias("item"), value.alias("value"))


def render(report: DataFrame) -> str:
    """The report, a few lines long, as text."""
    lines = ["DATA CLEANING REPORT", f"Generated: {datetime.now():%Y-%m-%d %H:%M:%S}"]
    rows = report.collect()
    for section, title in (("quality", "QUALITY"), ("steps", "STEPS APPLIED"), ("data", "FINAL DATA")):
        found = [r for r in rows if r["section"] == section]
        if section == "steps":
            found.sort(key=lambda r: int(r["item"]))
        lines += ["", title + ":"] + [f"{r['item']}: {r['value']}" for r in found]
    return "\n".join(lines)
