"""Order-dependent operators against pandas, for any number of ranges and any partitioning."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scrubline.functions.classes import normalize_missing
from scrubline.operators import ordered, quantiles, ranges, sampling, timeseries


def gappy(seed: int, n: int = 300) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    data = pd.DataFrame({"k": rng.permutation(n), "p": rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1]), "v": rng.normal(size=n)})
    data.loc[rng.random(n) < 0.5, "v"] = np.nan
    data.loc[data["k"] < 5, "v"] = np.nan
    data.loc[data["k"] > n - 5, "v"] = np.nan
    data.loc[(data["k"] > 100) & (data["k"] < 160), "v"] = np.nan
    return data


def spark_values(df):
    return df.orderBy("k").toPandas()["v"].to_numpy(dtype=float)


OPERATORS = {"ffill": ordered.ffill, "bfill": ordered.bfill, "interpolate": ordered.interpolate}


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("split", [None, 2, 7, 40])
def test_fills_follow_pandas(spark, name, split):
    data = gappy(split or 1)
    df = normalize_missing(spark.createDataFrame(data)).repartition(5)
    found = spark_values(OPERATORS[name](df, "v", ["k"], ranges=split))
    expected = getattr(data.sort_values("k")["v"], name)().to_numpy()
    np.testing.assert_allclose(found, expected)


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("split", [None, 9])
def test_fills_within_partitions(spark, name, split):
    data = gappy(3)
    df = normalize_missing(spark.createDataFrame(data)).repartition(3, "v")
    found = spark_values(OPERATORS[name](df, "v", ["k"], ["p"], ranges=split))
    ordered_rows = data.sort_values("k")
    expected = ordered_rows.groupby("p")["v"].transform(lambda s: getattr(s, name)()).to_numpy()
    np.testing.assert_allclose(found, expected)


@pytest.mark.parametrize("split", [None, 6])
def test_missing_partition_keys_are_a_partition(spark, split):
    df = spark.createDataFrame([(i, None if i % 2 else "a", float(i) if i < 2 else None) for i in range(30)], "k int, p string, v double")
    found = spark_values(ordered.ffill(df, "v", ["k"], ["p"], ranges=split))
    assert found.tolist() == [float(i % 2) for i in range(30)]


def test_interpolated_dates_and_text(spark):
    data = pd.DataFrame({"k": range(5), "d": pd.to_datetime(["2020-01-01", None, None, "2020-01-04", None]), "t": ["a", None, "b", None, None]})
    df = spark.createDataFrame(data.astype({"t": object}))
    found = ordered.interpolate(df, "d", ["k"]).orderBy("k").toPandas()["d"]
    assert found.tolist() == data["d"].interpolate().tolist()
    assert ordered.interpolate(df, "t", ["k"]).orderBy("k").toPandas()["t"].isna().sum() == 3


@pytest.mark.parametrize("split", [1, 5, 50])
def test_row_numbers(spark, split):
    df = spark.range(500).select(F.concat(F.lit("k"), F.col("id") % 7).alias("a"), F.col("id").alias("b")).repartition(4)
    rows = ordered.number_rows(df, ["a", "b"], ranges=split).orderBy("a", "b").collect()
    assert [r["row_number"] for r in rows] == list(range(1, 501))


@pytest.mark.parametrize("kind", ["string", "double", "date", "timestamp", "timestamp_ntz", "decimal(20,3)"])
def test_ranges_follow_the_order(spark, kind):
    base = F.col("id") * 37 % 1000
    value = {"string": F.concat(F.lit("q'\\"), base), "double": base / 7, "date": F.date_add(F.lit("2020-01-01").cast("date"), base.cast("int")),
             "timestamp": F.timestamp_seconds(base * 1800), "timestamp_ntz": F.timestamp_micros(base * 123457).cast("timestamp_ntz")}.get(kind, base / 3)
    df = spark.range(1000).select(F.when(F.col("id") > 3, value).cast(kind).alias("k"), "id")
    cut, split = ranges.with_ranges(df, ["k", "id"], "r", 11)
    assert split and cut.columns == ["k", "id", "r"]
    rows = cut.orderBy("k", "id").collect()
    found = [r["r"] for r in rows]
    assert found == sorted(found) and 5 < len(set(found)) <= 20


def test_ties_are_cut_by_the_next_column(spark):
    df = spark.range(2000).select(F.when(F.col("id") < 1500, 5).otherwise(F.col("id")).alias("k"), "id")
    cut, _ = ranges.with_ranges(df, ["k", "id"], "r", 10)
    sizes = [r["count"] for r in cut.groupBy("r").count().collect()]
    assert len(sizes) > 6 and max(sizes) < 700
    rows = ordered.number_rows(df, ["k", "id"], ranges=10).orderBy("k", "id").collect()
    assert [r["row_number"] for r in rows] == list(range(1, 2001))


def test_split_plan_has_no_global_window(spark):
    df = spark.range(2000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, F.col("id") * 1.0).alias("v"))
    for operator in OPERATORS.values():
        plan = operator(df, "v", ["k"], ranges=8)._jdf.queryExecution().executedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window" in line]
        # only the per-range summaries, one row each, share a window without a key
        assert all("__range" in line for line in windows)


def test_exact_quantiles_by_brackets(spark):
    rng = np.random.default_rng(0)
    data = pd.DataFrame({"a": rng.normal(size=20_000), "b": rng.integers(0, 5, 20_000).astype(float),
                         "c": np.where(rng.random(20_000) < 0.4, 3.0, rng.random(20_000) * 6)})
    data.loc[:3000, "a"] = np.nan
    data.loc[data.index % 2 == 0, "c"] = 1.0
    df = normalize_missing(spark.createDataFrame(data)).withColumn("e", F.lit(None).cast("double"))
    wanted = {c: [0.0, 0.05, 0.25, 0.5, 0.75, 1.0] for c in "abc"} | {"e": [0.5]}
    found = quantiles.exact_quantiles(df, wanted, bracket_rows=50)
    for c in "abc":
        np.testing.assert_allclose(found[c], data[c].quantile(wanted[c]).to_numpy(), rtol=1e-12)
    assert found["e"] == [None]
    lazy = df.select(*[x.alias(f"x{i}") for i, x in enumerate(quantiles.quantile_columns(df, wanted, one_pass_bytes=0, bracket_rows=100)["a"])]).head()
    np.testing.assert_allclose(list(lazy), data["a"].quantile(wanted["a"]).to_numpy(), rtol=1e-12)


@pytest.mark.parametrize("sketch, bracket_rows", [(8, 1_000_000), (8, 20), (200, 1), (8192, 100)])
def test_exact_quantiles_by_poor_sketches(spark, sketch, bracket_rows):
    rng = np.random.default_rng(sketch)
    data = pd.DataFrame({"a": rng.normal(size=3000), "b": np.where(rng.random(3000) < 0.3, 7.0, rng.integers(0, 40, 3000) * 1.0),
                         "c": np.repeat([-np.inf, -0.0, 1.5, np.inf], 750), "d": 5.0})
    df = spark.createDataFrame(data).repartition(3)
    wanted = {c: [0.0, 0.1, 0.25, 0.5, 0.55, 0.9, 1.0] for c in "abd"} | {"c": [0.0, 0.1, 0.3, 0.6, 0.9]}
    found = quantiles.exact_quantiles(df, wanted, bracket_rows=bracket_rows, sketch=sketch)
    for c in "abd":
        np.testing.assert_allclose(found[c], np.quantile(data[c], wanted[c]), rtol=1e-12)
    assert found["c"] == [-np.inf, -np.inf, 0.0, 1.5, np.inf]


def test_quantiles_with_nan_and_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (float("nan"), None), (None, None)], "a double, b double")
    found = quantiles.exact_quantiles(df, {"a": [0.0, 0.5, 1.0], "b": [0.5]})
    assert found["a"][:2] == [1.0, 2.0] and np.isnan(found["a"][2]) and found["b"] == [None]
    assert quantiles.exact_quantiles(df.where("a < 0"), {"a": [0.5]}) == {"a": [None]}


def test_two_scans_do_for_all_columns_and_ranks(spark, monkeypatch):
    calls = []
    for name in ("_narrowed", "_counted"):
        own = getattr(quantiles, name)
        monkeypatch.setattr(quantiles, name, lambda *a, own=own, name=name: calls.append(name) or own(*a))
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    names = ["l_quantity", "l_extendedprice", "l_orderkey", "l_discount"]
    found = quantiles.exact_quantiles(lines, {c: [k / 20 for k in range(21)] for c in names})
    assert calls == ["_counted"]
    data = lines.select(*names).toPandas()
    for c in names:
        np.testing.assert_allclose(found[c], np.quantile(data[c], [k / 20 for k in range(21)]), rtol=1e-12)


@pytest.mark.parametrize("split", [None, 6])
def test_grouped_median(spark, split):
    rng = np.random.default_rng(1)
    data = pd.DataFrame({"g": rng.choice(["hot", "b", "c"], 3000, p=[0.8, 0.15, 0.05]), "v": rng.integers(0, 400, 3000) / 4})
    data.loc[rng.random(3000) < 0.1, "v"] = np.nan
    df = normalize_missing(spark.createDataFrame(data))
    found = {r["g"]: r["median"] for r in quantiles.grouped_median(df, ["g"], "v", ranges=split).collect()}
    assert found == data.groupby("g")["v"].median().to_dict()


def test_samples_do_not_depend_on_partitioning(spark):
    df = spark.range(50_000).withColumnRenamed("id", "k")
    plain = {r["k"] for r in sampling.lowest_hashes(df, 100, ["k"]).collect()}
    cut = {r["k"] for r in sampling.lowest_hashes(df.repartition(13), 100, ["k"], small_bytes=0).collect()}
    assert len(plain) == 100 and plain == cut


def series(spark, dates, vals):
    return spark.createDataFrame(pd.DataFrame({"d": pd.to_datetime(dates), "v": vals}))


@pytest.mark.parametrize("freq", ["D", "h", "7D", "MS", "ME", "QS", "B", "YS"])
def test_grids_follow_pandas(spark, freq):
    index = pd.date_range("2021-03-01" if freq != "ME" else "2021-03-31", periods=30, freq=freq)
    assert pd.infer_freq(index) is not None
    df = series(spark, index, np.arange(30.0)).repartition(4)
    found = timeseries.regularize(df, "d", "v").orderBy("position").toPandas()
    assert found["date"].tolist() == index.tolist()
    assert found["value"].tolist() == list(range(30))


def test_gaps_make_a_daily_grid(spark):
    dates = ["2021-01-01 00:00", "2021-01-02 00:00", "2021-01-05 00:00", "2021-01-06 12:00"]
    found = timeseries.regularize(series(spark, dates, [1.0, 2.0, 8.0, 9.0]), "d", "v", ranges=3).orderBy("position").toPandas()
    expected = pd.Series([1.0, 2, 8, 9], pd.to_datetime(dates)).asfreq("D").interpolate()
    assert found["value"].tolist() == expected.tolist()
    with pytest.raises(ValueError, match="equal dates"):
        timeseries.regularize(series(spark, ["2021-01-01"] * 3, [1.0, 2, 3]), "d", "v")
    with pytest.raises(ValueError, match="3 dates"):
        timeseries.regularize(series(spark, ["2021-01-01", "2021-01-02"], [1.0, 2]), "d", "v")


def classical(x: np.ndarray, period: int):
    weights = np.ones(period) / period if period % 2 else np.r_[0.5, np.ones(period - 1), 0.5] / period
    half = period // 2
    trend = np.full(len(x), np.nan)
    trend[half:len(x) - half] = np.convolve(x, weights, "valid")
    means = np.array([np.nanmean((x - trend)[i::period]) for i in range(period)])
    seasonal = np.tile(means - means.mean(), len(x) // period + 1)[:len(x)]
    return trend, seasonal, x - trend - seasonal


@pytest.mark.parametrize("period", [2, 4, 7])
@pytest.mark.parametrize("block", [10, 100_000])
def test_decomposition(spark, period, block):
    rng = np.random.default_rng(period)
    x = np.arange(60) * 0.3 + np.sin(np.arange(60) * 2 * np.pi / period) + rng.normal(size=60)
    df = series(spark, pd.date_range("2022-01-01", periods=60), x).repartition(3)
    found = timeseries.decompose(df, "d", "v", period, block=block).orderBy("date").toPandas()
    for name, expected in zip(("trend", "seasonal", "residual"), classical(x, period)):
        np.testing.assert_allclose(found[name].to_numpy(dtype=float), expected, atol=1e-9)
    with pytest.raises(ValueError, match="data points"):
        timeseries.decompose(df, "d", "v", 40)


def test_time_zone_of_the_session_plays_no_part(spark):
    index = pd.date_range("2021-03-26 02:30", periods=5)
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        from scrubline.functions import convert

        texts = spark.createDataFrame([(str(d), 1.0) for d in index], "d string, v double")
        df = convert.to_timestamp(texts, "d")
        found = timeseries.regularize(df, "d", "v").orderBy("position").collect()
        assert [r["date"] for r in found] == [d.to_pydatetime() for d in index]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_rows_off_the_grid_are_counted(spark):
    daily = series(spark, [f"2021-01-{d}" for d in ("01 00:00", "02 00:00", "04 00:00", "05 12:00")], [1.0, 2.0, 3.0, 4.0])
    assert tuple(timeseries.grid_losses(daily, "d", "v").head()) == (4, 1)
    monthly = series(spark, ["2021-01-01", "2021-02-01", "2021-03-01"], [1.0, 2.0, 3.0])
    assert tuple(timeseries.grid_losses(monthly, "d", "v").head()) == (3, 0)
