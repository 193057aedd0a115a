"""Forests and anomalies: planted structure is found, results do not depend on partitioning."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from scrubline.operators import aggregates, anomalies, forest, trees


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    n = 1500
    data = pd.DataFrame({"k": range(n), "x": rng.normal(size=n), "noise": rng.normal(size=n), "c": rng.choice(["p", "q", "r"], n)})
    data["y"] = 5 * data["x"] + (data["c"] == "q") * 2 + rng.normal(size=n) * 0.1
    data["label"] = np.where(data["x"] > 0, "high", "low")
    return spark.createDataFrame(data)


def test_regression(planted):
    trained = forest.train_forest(planted, ["x", "noise", "c"], "y", ["k"], trees=20)
    assert trained.problem == "regression" and trained.feature_names == ["x", "noise", "c_q", "c_r"]
    assert forest.regression_metrics(trained.predictions).head()["r2"] > 0.8
    top = forest.feature_importance(trained).collect()
    assert top[0]["feature"] == "x" and sum(r["importance"] for r in top) == pytest.approx(1)
    line = forest.actual_vs_predicted(trained).head()
    assert line["line_low"] <= line["actual"] <= line["line_high"]


def test_classification(planted):
    trained = forest.train_forest(planted, ["x", "noise"], "label", ["k"], trees=10)
    row = forest.classification_metrics(trained.predictions, planted, "label").head()
    assert trained.problem == "classification" and row["accuracy"] > 0.95 and row["classes"] == trained.classes == 2
    assert row["test_rows"] == trained.predictions.count()


@pytest.mark.parametrize("room", [None, 1, 2, 3])
def test_indicators_equal_one_hot(planted, room):
    features = ["c", "x", "label"]
    stages, inputs, names = forest.indicators(planted, features, room)
    columns = forest.one_hot(planted, features, room)
    assert [c if v is None else f"{c}_{v}" for c, v in names] == [n for n, _ in columns]
    prepare = PipelineModel([*stages, VectorAssembler(inputCols=inputs, outputCol="v")])
    rows = prepare.transform(planted).select(vector_to_array("v").alias("v"), F.array(*[x for _, x in columns]).alias("w"))
    assert rows.where("v <> w").count() == 0


def test_wide_text_feature(spark):
    df = spark.range(3000).selectExpr("id as k", "concat('v', id % 1000) as c", "id % 41 as x", "id % 41 * 2.0 + id % 3 as y")
    trained = forest.train_forest(df, ["x", "c"], "y", ["k"], trees=2, depth=3)
    assert len(trained.feature_names) == 1000 and forest.regression_metrics(trained.predictions).head()["r2"] > 0.5


def test_trees_grow_deeper_than_ten(spark):
    """Parts whose sizes halve, each with a value of its own: a tree needs a level for every part."""
    df = spark.range(60_000).selectExpr("id as k", "cast(floor(log2(1 + id)) as double) as x").selectExpr("k", "x", "pow(8D, x) as y")
    full, cut = (forest.train_forest(df, ["x"], "y", ["k"], trees=2, **given) for given in ({}, {"depth": 10}))
    assert min(full.depths) > 10 and max(cut.depths) <= 10


def plain_tree(x, y, w, classes):
    """Leaf groups and gains of a tree grown node by node, trying every split between two values."""
    def worth(rows):
        if not w[rows].sum():
            return 0.0
        sums = np.bincount(y[rows].astype(int), w[rows], classes) if classes else np.array([(w * y)[rows].sum()])
        return (sums**2).sum() / w[rows].sum()

    gains, groups = np.zeros(x.shape[1]), []

    def down(rows):
        best = (1e-9, None, None)
        for f in range(x.shape[1]):
            for v in np.unique(x[rows, f])[:-1]:
                left, right = rows[x[rows, f] <= v], rows[x[rows, f] > v]
                if w[left].sum() and w[right].sum():
                    gain = worth(left) + worth(right) - worth(rows)
                    if gain > best[0] + 1e-9:
                        best = (gain, f, v)
        if best[1] is None:
            groups.append(frozenset(rows.tolist()))
            return
        gains[best[1]] += best[0]
        down(rows[x[rows, best[1]] <= best[2]])
        down(rows[x[rows, best[1]] > best[2]])

    down(np.arange(len(y)))
    return set(groups), gains


@pytest.mark.parametrize("classes", [0, 3])
def test_a_tree_equals_one_grown_node_by_node(classes):
    rng = np.random.default_rng(classes)
    x = rng.integers(0, 9, (200, 3)).astype(np.int32)
    y = rng.integers(0, 3, 200).astype(float) if classes else x[:, 0] * 2.5 + rng.normal(size=200)
    w = rng.poisson(1.0, 200).astype(float)
    plan = trees.Plan((9, 9, 9), (False,) * 3, classes, 30, 1, None)
    leaf, gains, _ = trees.grow(x, y, w, plan, [1], 30)
    groups, expected = plain_tree(x, y, w, classes)
    drawn = np.flatnonzero(w)
    own = {frozenset(drawn[leaf[drawn] == k].tolist()) for k in np.unique(leaf[drawn])}
    if not classes:  # equal gains of class splits may be taken in another order
        assert own == {frozenset(g & set(drawn.tolist())) for g in groups}
        np.testing.assert_allclose(gains, expected)
    np.testing.assert_allclose(gains.sum(), expected.sum(), rtol=0.05 if classes else 1e-9)
    for k in np.unique(leaf[drawn]):  # nothing is left to split
        rows = drawn[leaf[drawn] == k]
        assert len(np.unique(y[rows])) == 1 or len(np.unique(x[rows], axis=0)) == 1 or classes


def test_importances_equal_those_of_plain_trees(spark):
    rng = np.random.default_rng(5)
    data = pd.DataFrame({"k": range(120), "a": rng.integers(0, 12, 120) * 1.0, "b": rng.integers(0, 5, 120) * 1.0})
    data["y"] = data["a"] * 3 + data["b"] ** 2 + rng.normal(size=120)
    trained = forest.train_forest(spark.createDataFrame(data).repartition(3), ["a", "b"], "y", ["k"], trees=4)
    keyed = spark.createDataFrame(data).select("*", forest.key_hash(["k"], 43).cast("bigint").alias("draw"), (F.pmod(forest.key_hash(["k"], 42), F.lit(10_000)) < 2000).alias("test")).toPandas()
    keyed = keyed[~keyed["test"]]
    shares = np.zeros(2)
    for tree in range(4):
        w = trees.times_drawn(keyed["draw"].to_numpy(), tree, 42)
        _, gains = plain_tree(keyed[["a", "b"]].to_numpy(), keyed["y"].to_numpy(), w, 0)
        shares += gains / gains.sum() / 4
    np.testing.assert_allclose(trained.importances, shares, atol=1e-4)  # splits of equal gain may differ


@pytest.mark.parametrize("target", ["y", "label"])
def test_forests_with_upper_levels_by_the_library(planted, target):
    whole = forest.train_forest(planted, ["x", "noise", "c"], target, ["k"], trees=12)
    parts = forest.train_forest(planted, ["x", "noise", "c"], target, ["k"], trees=12, subtree_rows=150)
    assert whole.top is None and parts.top is not None and parts.predictions.count() == whole.predictions.count()
    assert sum(parts.importances) == pytest.approx(1) and np.argmax(parts.importances) == np.argmax(whole.importances) == 0
    assert abs(parts.importances[0] - whole.importances[0]) < 0.05
    if target == "y":
        scores = [forest.regression_metrics(t.predictions).head()["r2"] for t in (whole, parts)]
    else:
        scores = [forest.classification_metrics(t.predictions, planted, "label").head()["accuracy"] for t in (whole, parts)]
    assert min(scores) > 0.95 and abs(scores[0] - scores[1]) < 0.01


def test_forests_do_not_depend_on_partitions(planted):
    a, b = (forest.train_forest(p, ["x", "c"], "y", ["k"], trees=3) for p in (planted, planted.repartition(5)))
    assert a.importances == b.importances
    assert sorted(map(tuple, a.predictions.collect())) == sorted(map(tuple, b.predictions.collect()))


def test_samples_with_replacement_are_poisson():
    drawn = trees.times_drawn(np.arange(200_000), 3, 42)
    shares = np.bincount(drawn.astype(int), minlength=5)[:5] / 200_000
    np.testing.assert_allclose(shares, [0.3679, 0.3679, 0.1839, 0.0613, 0.0153], atol=0.004)


def test_max_columns_and_checks(planted):
    assert [n for n, _ in forest.one_hot(planted, ["c", "x"], 2)] == ["c_q", "c_r"]
    assert [n for n, _ in forest.one_hot(planted, ["x", "c"], 2)] == ["x", "c_q"]
    with pytest.raises(ValueError, match="30"):
        forest.train_forest(planted.limit(10), ["x"], "y", ["k"])
    with pytest.raises(ValueError):
        forest.prepare_training(planted, ["y"], "y")
    assert forest.prepare_training(planted, ["x"], "y", ["k"], 100).count() == 100


def test_split_is_stable(planted):
    train, test = forest.split(planted, ["k"])
    again, _ = forest.split(planted.repartition(7), ["k"])
    assert {r["k"] for r in train.collect()} == {r["k"] for r in again.collect()}
    assert train.count() + test.count() == 1500 and 0.15 < test.count() / 1500 < 0.25


@pytest.mark.parametrize("n", [400, 30_000])
def test_isolation_forest(spark, n):
    rng = np.random.default_rng(1)
    data = pd.DataFrame({"k": range(n), "a": rng.normal(size=n), "b": rng.normal(size=n)})
    data.loc[:4, ["a", "b"]] = 40.0
    df = spark.createDataFrame(data).withColumn("a", F.when(F.col("k") != 7, F.col("a")))
    result = anomalies.isolation_forest(df, ["a", "b"], ["k"], 0.05)
    rows = result.collect()
    assert len(rows) == n - 1
    flagged = {r["k"] for r in rows if r["anomaly"]}
    assert set(range(5)) <= flagged and abs(len(flagged) / n - 0.05) < 0.005
    again = anomalies.isolation_forest(df.repartition(5), ["a", "b"], ["k"], 0.05)
    assert {r["k"] for r in again.where("anomaly").collect()} == flagged
    summary = anomalies.anomaly_summary(result).head()
    assert (summary["anomalies"], summary["scanned"]) == (len(flagged), n - 1)
    assert anomalies.remove_anomalies(df, result, ["k"]).count() == n - len(flagged)
    assert anomalies.plot_sample(result, ["k"], points=100).count() == len(flagged) + 100


def test_forest_needs_rows_and_a_sane_share(spark):
    df = spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("a"))
    with pytest.raises(ValueError, match="20"):
        anomalies.isolation_forest(df, ["a"], ["k"])
    with pytest.raises(ValueError):
        anomalies.isolation_forest(df, ["a"], ["k"], 0.5)


def test_path_length():
    assert anomalies.path_length(np.array([1, 2])).tolist() == [0.0, 1.0]
    assert anomalies.path_length(256) == pytest.approx(10.2448, abs=1e-3)


def test_scatter_sample(planted):
    assert aggregates.scatter_sample(planted, "x", "y", ["k"], 200).count() == 200


@pytest.mark.parametrize("target", ["y", "label"])
def test_trees_over_cells_equal_those_over_rows(spark, target, monkeypatch):
    """Rows in equal bins are added up, also where they are more than a task may take, and the forest is that of the rows."""
    rng = np.random.default_rng(3)
    data = pd.DataFrame({"k": range(4000), "a": rng.integers(0, 15, 4000) * 1.0, "c": rng.choice(["p", "q", "r"], 4000)})
    data["y"] = data["a"] ** 2 + (data["c"] == "q") * 7 + rng.normal(size=4000)
    data["label"] = np.where(data["y"] + 30 * rng.normal(size=4000) > 60, "high", np.where(data["a"] > 3, "mid", "low"))
    df = spark.createDataFrame(data)
    cells, again = (forest.train_forest(d, ["a", "c"], target, ["k"], trees=6, subtree_rows=300) for d in (df, df.repartition(5)))
    monkeypatch.setattr(forest, "CELL_ROWS", 1 << 40)
    rows = forest.train_forest(df, ["a", "c"], target, ["k"], trees=6)
    assert cells.top is None and rows.top is None and cells.depths == rows.depths
    assert cells.importances == again.importances and sorted(map(tuple, cells.predictions.collect())) == sorted(map(tuple, again.predictions.collect()))
    np.testing.assert_allclose(cells.importances, rows.importances, rtol=1e-9)
    both = cells.predictions.alias("a").join(rows.predictions.alias("b"), "k").select("a.actual", F.col("a.predicted").alias("p"), F.col("b.predicted").alias("q"))
    assert both.count() == rows.predictions.count()
    off = F.abs(F.col("p") - F.col("q")) > 1e-9 if target == "y" else F.col("p") != F.col("q")
    assert both.where(off).count() == 0


def test_cells_of_rows_with_one_key(spark):
    """All rows share one draw, so some trees draw none of them and take all."""
    df = spark.range(1000).selectExpr("1 as k", "id % 7 as a", "cast(id % 7 * 2 as double) as y").union(spark.range(500).selectExpr("2 + id % 2", "id % 7", "id % 7 * 2.0D"))
    df = df.selectExpr("k", "a", "y + 0.01D * (a * a + k) as y")
    trained = forest.train_forest(df, ["a"], "y", ["k"], trees=8)
    assert trained.predictions.where("abs(actual - predicted) > 0.1").count() == 0


def test_exact_parts():
    y = np.random.default_rng(1).normal(size=5000) * 10.0 ** np.arange(-3, 2).repeat(1000)
    parts = trees.exact_parts(y, np.abs(y).max(), 30_000_000)
    np.testing.assert_allclose(sum(parts), y, rtol=0, atol=np.abs(y).max() * 2.0**-53)
    order = np.random.default_rng(2).permutation(5000)
    assert all(np.cumsum(p)[-1] == np.cumsum(p[order])[-1] for p in parts)
