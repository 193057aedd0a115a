"""scrubline: data-quality, cleaning and exploratory analytics over Spark DataFrames."""

import sys

from pyspark import cloudpickle

from scrubline.functions import convert, similarity, text
from scrubline.operators import (
    aggregates,
    anomalies,
    columns,
    forest,
    fuzzy,
    issues,
    joins,
    missing,
    ordered,
    outliers,
    profile,
    quantiles,
    timeseries,
)
from scrubline.plans import autofix, recipe, report
from scrubline.sources import readers, samples, sinks

__all__ = [
    "aggregates", "anomalies", "autofix", "columns", "convert", "forest", "fuzzy", "issues",
    "joins", "missing", "ordered", "outliers", "profile", "quantiles", "readers", "recipe",
    "report", "samples", "similarity", "sinks", "text", "timeseries",
]

# the few functions that run in Python workers travel with the job, so that executors need no copy
# of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
