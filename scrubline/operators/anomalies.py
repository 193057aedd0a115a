"""Isolation forest (Liu, Ting and Zhou, 2008): rows that random splits separate early.

Training touches a bounded sample only: 100 trees of at most 256 rows each. Trees are grown in one
small group per tree, and all trees together (a bounded table) go to the scoring tasks, which walk
whole Arrow batches through a tree at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.functions.classes import col, require_numeric
from scrubline.operators.joins import drop_rows
from scrubline.operators.quantiles import ONE_PASS_BYTES, quantile_columns
from scrubline.operators.sampling import lowest_hashes
from scrubline.session import cut_lineage, measured_bytes

# Fixed values of the forest and the accepted shares of anomalies.
TREES = 100
SAMPLE = 256
MIN_ROWS = 20
CONTAMINATION = (0.01, 0.20)
EULER = 0.5772156649015329
SEED = 42
PLOT_POINTS = 5_000


def path_length(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(big - 1) + EULER) - 2 * (big - 1) / big))


def grow(points: np.ndarray, seed: int) -> list[tuple[int, int, float, int, int, float]]:
    """One tree as (node, feature, cut, left, right, depth estimate); leaves have feature -1."""
    random = np.random.default_rng(seed)
    limit = int(np.ceil(np.log2(max(len(points), 2))))
    nodes: list[tuple[int, int, float, int, int, float]] = []
    todo, free = [(0, np.arange(len(points)), 0)], 1
    while todo:
        node, rows, depth = todo.pop()
        low, high = points[rows].min(axis=0), points[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            nodes.append((node, -1, 0.0, -1, -1, depth + float(path_length(len(rows)))))
            continue
        feature = int(random.choice(usable))
        cut = float(random.uniform(low[feature], high[feature]))
        goes_left = points[rows, feature] <= cut
        nodes.append((node, feature, cut, free, free + 1, 0.0))
        todo += [(free, rows[goes_left], depth + 1), (free + 1, rows[~goes_left], depth + 1)]
        free += 2
    return nodes


def _tree_samples(data: DataFrame, key: list[str], rows: int) -> tuple[DataFrame, int]:
    """At most 256 rows per tree: those with the lowest hashes of tree and key, at every size of the table.

    On a large table only hashes below a threshold are copied out for their trees. It lets through 416 rows
    a tree on average, so that a tree short of rows (eight deviations off) is not to be expected.
    """
    size = min(SAMPLE, rows)
    keys = [col(k) for k in key]
    trees = F.sequence(F.lit(0), F.lit(TREES - 1))
    share = (size + 10 * size**0.5) / max(rows, 1)
    if share < 0.99:
        highest = int(share * 2**64) - 2**63
        trees = F.filter(trees, lambda t: F.xxhash64(t, *keys) < F.lit(highest))
    each = data.withColumn("tree", F.explode(trees))
    place = F.row_number().over(W.partitionBy("tree").orderBy(F.xxhash64(F.col("tree"), *keys), *keys))
    return each.withColumn("__place", place).where(F.col("__place") <= size), size


def fit_forest(df: DataFrame, names: list[str], key: list[str], seed: int = SEED) -> tuple[pd.DataFrame, int]:
    """The trees as a table of at most 100 * 511 nodes, and the rows per tree."""
    require_numeric(df, *names)
    data = _complete(df, names, key)
    rows = data.count()
    if rows < MIN_ROWS:
        raise ValueError(f"at least {MIN_ROWS} complete rows are needed, there are {rows}")
    sample, size = _tree_samples(data, key, rows)
    features = [f"__x{i}" for i in range(len(names))]

    def plant(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        # the order of a group's rows is not fixed; the order of its points is
        points = group[features].sort_values(features, kind="stable").to_numpy(dtype=float)
        nodes = pd.DataFrame(grow(points, seed * 1_000 + tree), columns=["node", "feature", "cut", "left", "right", "depth"])
        return nodes.assign(tree=tree)

    schema = "tree int, node int, feature int, cut double, left int, right int, depth double"
    trees = sample.select("tree", *features).groupBy("tree").applyInPandas(
        lambda g: plant(g)[["tree", "node", "feature", "cut", "left", "right", "depth"]], schema)
    return trees.toPandas().sort_values(["tree", "node"], ignore_index=True), size


def _complete(df: DataFrame, names: list[str], key: list[str]) -> DataFrame:
    rows = df
    for c in names:
        rows = rows.where(col(c).isNotNull())
    return rows.select(*[col(k) for k in key], *[col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(names)])


def score_column(trees: pd.DataFrame, size: int, names: list[str]) -> Column:
    """The anomaly score 2^(-E[depth]/c) of complete rows, 0..1, higher for stranger rows."""
    forest = [t.sort_values("node")[["feature", "cut", "left", "right", "depth"]].to_numpy() for _, t in trees.groupby("tree")]
    normal = float(path_length(size))

    @F.pandas_udf(T.DoubleType())
    def score(*columns: pd.Series) -> pd.Series:
        points = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        return pd.Series(np.exp2(-mean_depth(forest, points) / normal))

    return score(*[col(c).cast("double") for c in names])


def mean_depth(forest: list[np.ndarray], points: np.ndarray) -> np.ndarray:
    total = np.zeros(len(points))
    for tree in forest:
        feature, cut, left, right = tree[:, 0].astype(int), tree[:, 1], tree[:, 2].astype(int), tree[:, 3].astype(int)
        at = np.zeros(len(points), dtype=int)
        inner = np.flatnonzero(feature[at] >= 0)
        while len(inner):
            here = at[inner]
            goes_left = points[inner, feature[here]] <= cut[here]
            at[inner] = np.where(goes_left, left[here], right[here])
            inner = inner[feature[at[inner]] >= 0]
        total += tree[at, 4]
    return total / max(len(forest), 1)


def isolation_forest(
    df: DataFrame, names: list[str], key: list[str], contamination: float = 0.05, seed: int = SEED,
) -> DataFrame:
    """Complete rows with ``score`` (negative for anomalies) and ``anomaly``.

    The score is the threshold minus the raw anomaly score; the threshold is the exact quantile
    that leaves the wanted share above it.
    """
    low, high = CONTAMINATION
    if not low <= contamination <= high:
        raise ValueError(f"contamination must lie between {low} and {high}")
    if not names:
        raise ValueError("at least one column is needed")
    trees, size = fit_forest(df, names, key, seed)
    complete = df
    for c in names:
        complete = complete.where(col(c).isNotNull())
    scored = complete.select(*[col(k) for k in key], *[col(c) for c in names if c not in key],
                             (-score_column(trees, size, names)).alias("__score"))
    if measured_bytes(scored) > ONE_PASS_BYTES:
        # several passes find the threshold: keep the scores instead of walking the trees in each
        scored = cut_lineage(scored)
    offset = quantile_columns(scored.select("__score"), {"__score": [contamination]})["__score"][0]
    return (scored.withColumn("score", F.col("__score") - offset).drop("__score")
            .withColumn("anomaly", F.col("score") < 0))


def anomaly_summary(result: DataFrame) -> DataFrame:
    """Anomalies, rows scanned and rate in percent."""
    return result.agg(F.count_if("anomaly").alias("anomalies"), F.count("*").alias("scanned")).select(
        "*", F.coalesce(F.try_divide(F.col("anomalies") * 100.0, F.col("scanned")), F.lit(0.0)).alias("rate"))


def plot_sample(result: DataFrame, key: list[str], points: int = PLOT_POINTS, seed: int = SEED) -> DataFrame:
    """All anomalies, and a seeded sample of the normal rows of a larger table."""
    normal = result.where(~F.col("anomaly"))
    return result.where("anomaly").unionByName(lowest_hashes(normal, points, key, seed))


def remove_anomalies(df: DataFrame, result: DataFrame, key: list[str]) -> DataFrame:
    """The rows not flagged; rows the forest did not see stay. Missing keys match each other, as in joins."""
    return drop_rows(df, result.where("anomaly"), key)
