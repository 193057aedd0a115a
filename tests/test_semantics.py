"""Hand-computed and pandas-computed expectations on small tables."""

import math
import os
import random
import subprocess
import sys

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scrubline.functions import convert, text
from scrubline.functions.classes import columns_of, normalize_missing
from scrubline.operators import aggregates, anomalies, columns, issues, joins, missing, outliers, profile
from scrubline.plans.autofix import auto_fix
from scrubline.plans.recipe import Recipe
from scrubline.plans.report import cleaning_report, render


def values(df, name):
    return [r[name] for r in df.collect()]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_nan_becomes_missing(spark):
    df = normalize_missing(frame(spark, [(1.0,), (float("nan"),), (None,)], "x double"))
    assert sorted(values(df, "x"), key=str) == [1.0, None, None]
    assert outliers.find_outliers(df, "x").count() == 0


def test_classes(spark):
    df = frame(spark, [(1, 1.0, "a", True, None)], "i int, d double, s string, b boolean, t timestamp")
    assert (columns_of(df, "numeric"), columns_of(df, "text"), columns_of(df, "datetime")) == (["i", "d"], ["s"], ["t"])


def test_odd_column_names(spark):
    df = frame(spark, [(1.0, "x"), (None, "x")], "`a.b` double, `c``d` string")
    assert sorted(values(missing.fill_mean(df, "a.b"), "a.b")) == [1.0, 1.0]
    assert profile.quality_score(df).head()["rows"] == 2
    assert values(aggregates.top_values(df, "c`d"), "count") == [2]


def test_mode_takes_the_smallest_of_equals(spark):
    df = frame(spark, [("b",), ("a",), ("b",), ("a",), (None,)], "x string")
    assert sorted(values(missing.fill_mode(df, "x"), "x")) == ["a", "a", "a", "b", "b"]
    empty = frame(spark, [(None,)], "x string")
    assert values(missing.fill_mode(empty, "x"), "x") == [""]


def test_fill_value_checks(spark):
    df = frame(spark, [(1, None), (None, "x")], "n bigint, s string")
    with pytest.raises(ValueError):
        missing.fill_value(df, "n", "abc")
    with pytest.raises(ValueError):
        missing.fill_value(df, "s", "")
    assert dict(missing.fill_value(df, "n", "3").dtypes)["n"] == "bigint"
    assert sorted(values(missing.fill_value(df, "n", "3.5"), "n")) == [1.0, 3.5]
    with pytest.raises(TypeError):
        missing.fill_mean(df, "s")


def test_fill_mean_of_dates(spark):
    df = frame(spark, [("2020-01-01",), ("2020-01-03",), (None,)], "d string").select(F.col("d").cast("timestamp_ntz").alias("d"))
    assert sorted(str(v) for v in values(missing.fill_mean(df, "d"), "d"))[1] == "2020-01-02 00:00:00"


NUMBER_TEXTS = ["", "Inf", "-inf", "infinity", "1.", ".5", "+5", "1e3", " 1 ", "\t2\n", "1E+5"]
OTHER_TEXTS = [" ", "nan", "1_000", "0x1A", "1d", "5f", "٣", "True", "\xa03", "1e", "e3", ".", "+", "1,000", "-", "- 5", "--5", "1e400"]


def test_number_syntax_follows_pandas(spark):
    df = frame(spark, [(t,) for t in NUMBER_TEXTS + OTHER_TEXTS], "t string")
    found = {r["t"]: (r["ok"], r["n"]) for r in df.select(
        "t", convert.looks_numeric(F.col("t")).alias("ok"), convert.parse_number(F.col("t")).alias("n")).collect()}
    for t in NUMBER_TEXTS:
        expected = pd.to_numeric(pd.Series([t])).iloc[0]
        assert found[t][0], t
        assert (found[t][1] is None) == bool(pd.isna(expected)), t
        if found[t][1] is not None:
            assert found[t][1] == expected, t
    assert [t for t in OTHER_TEXTS if found[t][0]] == []


def test_to_integer(spark):
    df = frame(spark, [("7",), ("1e3",), ("x",), ("9007199254740993",), ("5.0",), (None,)], "t string")
    assert values(convert.to_integer(df, "t"), "t") == [7, 1000, None, 9007199254740993, 5, None]
    with pytest.raises(Exception, match="no integer"):
        convert.to_integer(frame(spark, [("1.5",)], "t string"), "t").collect()


def test_timestamps(spark):
    df = frame(spark, [(1, "03/04/2021"), (2, "25/12/2021"), (3, None)], "i int, t string")
    first = convert.to_timestamp(df, "t", order_by=["i"])
    assert [str(v) for v in values(first.orderBy("i"), "t")] == ["2021-03-04 00:00:00", "None", "None"]
    best = convert.to_timestamp(df, "t")
    assert [str(v) for v in values(best.orderBy("i"), "t")] == ["2021-04-03 00:00:00", "2021-12-25 00:00:00", "None"]
    fmt = frame(spark, [("5 Jan 2020 03:04 PM",)], "t string")
    assert str(values(convert.to_timestamp(fmt, "t", "%d %b %Y %I:%M %p"), "t")[0]) == "2020-01-05 15:04:00"
    digits = frame(spark, [("20230101",)], "t string")
    assert str(values(convert.to_timestamp(digits, "t"), "t")[0]) == "2023-01-01 00:00:00"
    micro = frame(spark, [("2020-01-01 00:00:00.25",)], "t string")
    assert str(values(convert.to_timestamp(micro, "t"), "t")[0]) == "2020-01-01 00:00:00.250000"


TEXTS = ["it's o-neil 3rd", "  a  b\t\tc \x1f", "ÀÉ straße ßa 中a", "x$y@z", "", "a\n", " x　", None]


@pytest.mark.parametrize("action,expected", [
    ("trim", str.strip), ("lower", str.lower), ("upper", str.upper), ("title", str.title),
    ("remove_special", lambda s: __import__("re").sub(r"[^A-Za-z0-9\s]", "", s)),
    ("collapse_spaces", lambda s: __import__("re").sub(r"\s+", " ", s).strip()),
])
def test_text_actions_follow_python(spark, action, expected):
    df = frame(spark, list(enumerate(TEXTS)), "i int, t string")
    found = values(text.clean_text(df, "t", action).orderBy("i"), "t")
    assert found == [None if t is None else expected(t) for t in TEXTS]


@pytest.mark.parametrize("find,replacement,regex", [
    ("a.c", "$1", False), (r"(?P<x>\w)-(\w)", r"\g<2>$\g<x>", True), (r"(a)(.)", r"\2\1", True), (r"\d+", "#", True)])
def test_find_replace_follows_python(spark, find, replacement, regex):
    texts = ["a.c abc", "a-b c-d", "x12y3", ""]
    df = frame(spark, list(enumerate(texts)), "i int, t string")
    found = values(text.find_replace(df, "t", find, replacement, regex).orderBy("i"), "t")
    assert found == pd.Series(texts).str.replace(find, replacement, regex=regex).tolist()


def test_find_replace_needs_a_text(spark):
    with pytest.raises(ValueError):
        text.find_replace(frame(spark, [("a",)], "t string"), "t", "", "x")


JOIN_LEFT = pd.DataFrame({"k": [1, 2, None, 2], "v": ["a", "b", "c", "d"], "j": [9, 8, 7, 6]})
JOIN_RIGHT = pd.DataFrame({"k": [2, None, 3], "v": ["x", "y", "z"], "j": [1.0, 2.0, None]})


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
@pytest.mark.parametrize("keys", [("k", "k"), ("k", "j")])
def test_joins_follow_pandas(spark, how, keys):
    left = normalize_missing(spark.createDataFrame(JOIN_LEFT))
    right = normalize_missing(spark.createDataFrame(JOIN_RIGHT))
    expected = JOIN_LEFT.merge(JOIN_RIGHT, left_on=keys[0], right_on=keys[1], how=how)
    found = joins.join_tables(left, right, *keys, how)
    assert found.columns == list(expected.columns)
    clean = [tuple(None if pd.isna(v) else v for v in r) for r in expected.itertuples(index=False)]
    assert sorted(map(str, [tuple(map(norm, r)) for r in found.collect()])) == sorted(map(str, [tuple(map(norm, r)) for r in clean]))


def norm(v):
    return float(v) if isinstance(v, (int, float)) else v


def test_join_rejects_text_against_number(spark):
    with pytest.raises(TypeError):
        joins.join_tables(frame(spark, [("1",)], "k string"), frame(spark, [(1,)], "k int"), "k", "k")


def test_score_of_empty_and_all_missing(spark):
    assert profile.quality_score(frame(spark, [], "a int, b string")).head()["score"] == 0
    row = profile.quality_score(frame(spark, [(1, None), (2, None)], "a int, b string")).head()
    assert row["score"] == pytest.approx(100 - 30 - 2)


def test_profile_of_maps_and_arrays(spark):
    df = frame(spark, [({"a": 1, "b": 2}, [1]), ({"b": 2, "a": 1}, [1]), (None, [2])], "m map<string,int>, a array<int>")
    assert profile.duplicate_count(df).head()["duplicates"] == 1
    assert profile.quality_score(df).head()["null_cells"] == 1


def test_issue_rules(spark):
    rows = [(i, None if i % 2 else "5", f"2020-01-{i % 28 + 1:02d}", 1000.0 if i < 8 else float(i % 3)) for i in range(100)]
    rows += rows[:20]
    df = frame(spark, rows, "id int, n string, order_date string, v double")
    found = [(r["severity"], r["type"], r["column"], r["detail"], r["action"]) for r in issues.detect_issues(df).orderBy("position").collect()]
    nulls = sum(r[1] is None for r in rows) / len(rows) * 100
    assert nulls == 50.0
    assert found == [
        ("warning", "missing_values", "n", "50.0% missing values", "fill"),
        ("critical", "duplicates", "All columns", "20 duplicate rows (16.7%)", "remove"),
        ("warning", "datatype", "n", "Stored as text but looks like numbers", "convert_numeric"),
        ("warning", "datatype", "order_date", "Stored as text but looks like dates", "convert_datetime"),
        ("info", "outliers", "v", "16 outliers detected (13.3%)", "review"),
    ]


def test_sampled_type_rules(spark):
    df = frame(spark, [(i, str(i) if i < 100 else "x", "2020-01-01" if i < 10 else "?") for i in range(200)], "i int, n string, day_date string")
    assert values(profile.numeric_text_columns(df), "column") == []
    assert values(profile.numeric_text_columns(df, 100, ["i"]), "column") == ["n"]
    assert values(profile.date_text_columns(df), "column") == []
    assert values(profile.date_text_columns(df, 10, ["i"]), "column") == ["day_date"]


def test_auto_fix(spark):
    rows = [(1, 2.0, "a", "1", "20230105"), (1, 2.0, "a", "1", "20230105"), (2, None, None, "2", "20230106"), (3, 4.0, "b", "3", None)]
    df = frame(spark, rows, "id int, v double, s string, n string, order_date string")
    fixed, actions = auto_fix(df)
    assert dict(fixed.dtypes) == {"id": "int", "v": "double", "s": "string", "n": "double", "order_date": "timestamp_ntz"}
    assert sorted(tuple(map(str, r)) for r in fixed.collect()) == [
        ("1", "2.0", "a", "1.0", "2023-01-05 00:00:00"), ("2", "2.0", "a", "2.0", "2023-01-06 00:00:00"),
        ("3", "4.0", "b", "3.0", "2023-01-05 00:00:00")]
    assert actions[0] == "Filled 'v' with median" and "Removed 1 duplicate rows" in actions
    log = Recipe().add("fill_median", name="v").apply_logged(df)[1]
    report = render(cleaning_report(df, fixed, log))
    assert "fill_median - name=v" in report and "missing_cells: 0" in report


def test_recipe_prefix_and_replay(spark):
    df = frame(spark, [(None, " A "), (2, "b")], "n int, t string")
    recipe = Recipe().add("fill_value", name="n", value=0).add("clean_text", name="t", action="trim").add("drop_columns", names=["n"])
    assert recipe.apply(df).columns == ["t"]
    assert sorted(values(recipe.prefix(1).apply(df), "n")) == [0, 2]
    with pytest.raises(ValueError):
        Recipe().add("no such step")


def test_columns(spark):
    df = frame(spark, [(1, 2), (1, 2)], "a int, b int")
    assert columns.drop_duplicates(df).count() == 1
    with pytest.raises(ValueError):
        columns.rename_column(df, "a", "b")
    with pytest.raises(ValueError):
        columns.drop_columns(df, ["z"])


def test_outlier_edges(spark):
    flat = frame(spark, [(5.0,)] * 4 + [(None,)], "x double")
    assert outliers.find_outliers(flat, "x", "zscore").count() == 0
    assert outliers.find_outliers(frame(spark, [(5.0,)], "x double"), "x", "zscore").count() == 0
    assert outliers.remove_outliers(flat, "x").count() == 5
    with pytest.raises(ValueError):
        outliers.find_outliers(flat, "x", "iqr", 9.0)
    data = frame(spark, [(float(v),) for v in (1, 2, 3, 4, 100)] + [(None,)], "x double")
    assert sorted(values(outliers.cap_outliers(data, "x"), "x"), key=lambda v: (v is None, v)) == [1, 2, 3, 4, 7, None]


def test_correlation_of_constant_and_gaps(spark):
    data = pd.DataFrame({"a": [1.0, 2, 3, None, 5], "b": [2.0, None, 1, 4, 9], "c": [7.0] * 5})
    found = {(r["column_x"], r["column_y"]): r["corr"] for r in aggregates.correlation_matrix(
        normalize_missing(spark.createDataFrame(data))).collect()}
    expected = data.corr()
    for (x, y), v in found.items():
        e = expected.loc[x, y]
        assert (v is None and math.isnan(e)) or v == pytest.approx(e)


PIVOT = pd.DataFrame({
    "r": ["a", "a", "b", "b", None, "c", "c"], "k": ["x", "y", "x", None, "x", "y", "y"],
    "l": ["p|q", "p", "p", "p", "p", "p", "p\\"], "v": [1.0, None, 3, 4, 5, None, None]})


@pytest.mark.parametrize("agg", aggregates.AGGREGATES)
def test_pivot_follows_pandas(spark, agg):
    df = normalize_missing(spark.createDataFrame(PIVOT))
    expected = pd.pivot_table(PIVOT, index=["r"], columns=["k"], values="v", aggfunc=agg, fill_value=0)
    found = aggregates.pivot_table(df, ["r"], "v", agg, ["k"]).toPandas().set_index("r").sort_index()
    assert {r: {c: float(x) for c, x in row.items()} for r, row in found.to_dict("index").items()} == {
        r: {c: float(x) for c, x in row.items()} for r, row in expected.to_dict("index").items()}
    plain = pd.pivot_table(PIVOT, index=["r", "k"], values="v", aggfunc=agg, fill_value=0)
    flat = aggregates.pivot_table(df, ["r", "k"], "v", agg).toPandas().set_index(["r", "k"])
    assert flat["v"].astype(float).to_dict() == plain["v"].astype(float).to_dict()


def test_pivot_column_names_stay_apart(spark):
    df = normalize_missing(spark.createDataFrame(PIVOT))
    found = aggregates.pivot_table(df, ["r"], "v", "count", ["k", "l"])
    assert set(found.columns) == {"r", "x|p\\|q", "y|p", "x|p", "y|p\\\\"}


def test_histogram_edges(spark):
    flat = aggregates.histogram(frame(spark, [(3.0,), (3.0,), (None,)], "x double"), "x", 4)
    assert [(r["bin"], r["count"]) for r in flat.orderBy("bin").collect()] == [(0, 2), (1, 0), (2, 0), (3, 0)]
    some = aggregates.histogram(frame(spark, [(float(i),) for i in range(11)], "x double"), "x", 5)
    assert [r["count"] for r in some.orderBy("bin").collect()] == [2, 2, 2, 2, 3]


def test_group_totals_of_missing(spark):
    df = frame(spark, [("a", None), ("a", None), (None, 3)], "g string, v int")
    assert [tuple(r) for r in aggregates.group_totals(df, "g", "v").collect()] == [("a", 0)]


def test_describe(spark):
    data = pd.DataFrame({"n": [1.0, 2, None, 4], "t": ["b", "a", "b", None], "d": pd.to_datetime(["2020-01-01", "2020-01-03", None, "2020-01-02"])})
    rows = {r["column"]: r for r in profile.describe_all(normalize_missing(spark.createDataFrame(data))).collect()}
    expected = data["n"].describe()
    assert [rows["n"][c] for c in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")] == pytest.approx(expected.tolist())
    assert [rows["t"][c] for c in ("count", "unique", "top", "freq")] == [3, 2, "b", 2]
    assert str(rows["d"]["ts_mean"]) == "2020-01-02 00:00:00" and str(rows["d"]["ts_25"]) == "2020-01-01 12:00:00"


def test_flagged_rows_with_missing_keys(spark):
    from scrubline.operators.joins import drop_rows, keep_rows

    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k int, v string")
    flagged = spark.createDataFrame([(None,), (2,)], "k int")
    assert {r.v for r in keep_rows(df, flagged, ["k"]).collect()} == {"b", "c"}
    assert {r.v for r in drop_rows(df, flagged, ["k"]).collect()} == {"a"}


@pytest.mark.parametrize("fmt, value", [
    ("%d%m%Y", "05012023"), ("%Y%m", "202301"), ("%H%M", "0930"), ("%y%m%d", "990105"), ("%d.%m.%y", "5.1.68"), ("%d.%m.%y", "5.1.69"), ("%Y%j", "2024366"),
    ("%a, %d %b %Y", "Thu, 5 Jan 2023"), ("%A %d %B %Y", "thursday 5 January 2023"), ("%I:%M %p", "9:30 PM"), ("100%% %Y", "100% 2023"), ("%Y-%m-%dT%H:%M:%S", "2023-01-05T01:02:03")])
def test_formats_as_strptime_reads_them(spark, fmt, value):
    import datetime as dt

    from scrubline.functions.convert import parse_timestamp

    df = spark.createDataFrame([(value,), ("x" + value,), (None,)], "t string")
    found = [r[0] for r in df.select(parse_timestamp(F.col("t"), fmt)).collect()]
    assert found == [dt.datetime.strptime(value, fmt), None, None]


@pytest.mark.parametrize("fmt", ["%Y %A", "%Q", "%Y%"])
def test_formats_that_are_refused(fmt):
    from scrubline.functions.convert import parse_timestamp

    with pytest.raises(ValueError):
        parse_timestamp(F.lit("x"), fmt)


def test_row_digests_tell_rows_apart_as_grouping_does(spark):
    texts = spark.createDataFrame([(None, "a"), ("a", None), ("-", "a"), ("1:a", "-"), ("", "1:a-"), (None, "a")], "x string, y string")
    nested = spark.sql("""
        select * from values
          (0.0d, array(1, 2), map('a', 1, 'b', cast(null as int)), named_struct('p', 1, 'q', -0.0d), X'00ff'),
          (-0.0d, array(1, 2), map('b', cast(null as int), 'a', 1), named_struct('p', 1, 'q', 0.0d), X'00ff'),
          (0.0d, array(12), map('a', 1, 'b', 2), null, X'00ff'),
          (double('NaN'), array(12), map('a', 1, 'b', 2), named_struct('p', null, 'q', null), null),
          (double('NaN'), null, map('a', 1, 'b', 2), named_struct('p', null, 'q', null), null),
          (double('NaN'), array(null), map('a', 1, 'b', 2), named_struct('p', null, 'q', null), null),
          (double('NaN'), array(), map('a', 1, 'b', 2), named_struct('p', null, 'q', null), null),
          (double('NaN'), array(12), map('a', 1, 'b', 2), named_struct('p', null, 'q', null), null) as t(a, b, c, d, e)""")
    for df, copies in ((texts, 1), (nested, 2), (nested.limit(0), 0)):
        assert profile.duplicate_count(df).head()["duplicates"] == copies == df.count() - profile.distinct_rows(df).count()


def test_correlation_of_many_columns_against_pandas(spark):
    wide = spark.range(0, 500, 1, 4).select(*[
        (F.when(F.rand(i) > 0.3, F.rand(i + 100) * 1e-3 + 1e6) if i % 3 == 0 else F.rand(i) + F.col("id") * 0.01 * (i % 2)).alias(f"x{i}")
        for i in range(40)])
    data = wide.toPandas()
    expected = (data - data.min()).corr()  # pandas loses digits on values far from zero
    found = aggregates.correlation_matrix(wide).toPandas().pivot(index="column_x", columns="column_y", values="corr")
    pd.testing.assert_frame_equal(found.loc[expected.index, expected.columns], expected, check_names=False, rtol=0, atol=1e-10)


def test_correlation_of_constants_across_partitions(spark):
    df = spark.range(0, 1000, 1, 8).select(
        F.lit(0.1).alias("a"), F.when(F.col("id") > 500, 0.3).alias("b"), (F.col("id") + 1e9).alias("c"),
        (F.col("id") * -2 + 1e9).alias("d"), F.when(F.col("id") % 2 == 0, float("nan")).otherwise(F.col("id") % 7).alias("e"))
    found = {(r["column_x"], r["column_y"]): r["corr"] for r in aggregates.correlation_matrix(df).collect()}
    assert len(found) == 25
    assert all(found["a", x] is None and found[x, "b"] is None for x in "abcde")
    assert found["c", "d"] == found["d", "c"] == pytest.approx(-1)
    assert found["c", "e"] == pytest.approx(df.where("not isnan(e)").corr("c", "e"))
    empty = aggregates.correlation_matrix(df.limit(0)).collect()
    assert len(empty) == 25 and all(r["corr"] is None for r in empty)


def test_layouts_count_what_each_format_parses(spark):
    rng = random.Random(2)
    words = ["2020", "1999", "1", "02", "13", "31", "-", "/", ".", " ", ":", "T", "Jan", "May", "March", "Sept", ", ", "10:20", "10:20:30", ".5", "20200131"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randrange(1, 8))) for _ in range(4000)]
    stamps = pd.date_range("1990-01-01", "2030-01-01", periods=40)
    texts += [t.strftime(f) for t in stamps for f, _ in convert.DATE_FORMATS] + [None, "", "x" * 100, "2020-01-01" + " " * 80, "1 " + "Y" * 70 + " 2020"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.agg(F.array(*convert.format_hits(F.col("t")))).head()[0]
    expected = df.agg(F.array(*[F.count(convert.parse_timestamp(F.col("t"), f)) for f, _ in convert.DATE_FORMATS])).head()[0]
    assert found == expected and min(found) >= 40


def test_rows_with_a_flagged_missing_key_go(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, t string")
    verdicts = df.withColumn("anomaly", F.col("k").isNull() | (F.col("k") == 3))
    assert [r["t"] for r in anomalies.remove_anomalies(df, verdicts, ["k"]).collect()] == ["a"]


def test_title_case_follows_python(spark):
    texts = ["it's o-neil", "ABC def", "ß straße", "ǆ ǆabc", "éCOLE été", "ﬁne", "日本 abc", None, "", "x1y2z", "ʼn", "İstanbul i̇"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    got = {r[0]: r[1] for r in df.select("t", text.title("t")).collect()}
    assert got == {t: None if t is None else t.title() for t in texts}


@pytest.mark.parametrize("part_cells", [3, 10_000])
def test_sparse_pivot_holds_the_cells_of_the_wide_one(spark, part_cells):
    df = spark.createDataFrame([(i % 3 if i % 11 else None, f"c|{i % 7}", i % 2, float(i)) for i in range(200)], "r int, c string, d int, v double")
    for agg in ("sum", "mean", "median", "count"):
        wide = {r["r"]: r.asDict() for r in aggregates.pivot_table(df, ["r"], "v", agg, ["c", "d"]).collect()}
        sparse = {}
        for r in aggregates.pivot_sparse(df, ["r"], "v", agg, ["c", "d"], part_cells=part_cells).collect():
            assert not set(sparse.setdefault(r["r"], {})) & set(r["cells"])
            sparse[r["r"]] |= r["cells"]
        assert {k: {c: v for c, v in x.items() if c != "r" and v != 0} for k, x in wide.items()} == {k: {c: v for c, v in x.items() if v != 0} for k, x in sparse.items()}


def test_scratch_folder_without_a_setting(tmp_path):
    code = "from scrubline.session import *; s = local_session(1); assert s.conf.get('spark.checkpoint.dir', None) is None; cut_lineage(s.range(3)).count(); p = scratch_path(s, 'x'); s.range(2).write.parquet(p); print('rows', s.read.parquet(p).count())"
    run = subprocess.run([sys.executable, "-c", code], env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)}, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True, timeout=120)
    assert "rows 2" in run.stdout, run.stderr[-800:]


def test_an_outer_join_is_one_join_unless_a_key_dominates(spark):
    left = spark.range(500).selectExpr("if(id % 3 = 0, 7, if(id % 5 = 0, null, id)) as k", "id as v")
    right = spark.range(300).selectExpr("if(id % 4 = 0, 7, if(id % 7 = 0, null, id * 2)) as k", "id as w")
    assert joins.most_rows_of_a_key(left, "k") == 168 and joins.most_rows_of_a_key(left.where("k is null"), "k") == 66
    assert joins.most_rows_of_a_key(left.limit(0), "k") == 0
    one, two = (joins.join_tables(left, right, "k", "k", "outer", heavy_key=n) for n in (1000, 10))
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (one, two)]
    assert [p.count("Join ") for p in plans] == [1, 2] and "FullOuter" in plans[0] and "FullOuter" not in plans[1]
    assert plans[0].count("Range (") == 2
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_only_rows_with_copies_are_shuffled_to_remove_copies(spark, monkeypatch):
    """Odd values, columns named like inner ones, and a filter that is far too small."""
    nan = float("nan")
    rows = [(i, f"t{i}", float(i), [i]) for i in range(3000)] + [(i % 7, f"t{i % 7}", float(i % 7), [i % 7]) for i in range(500)]
    rows += [(None, None, nan, None), (None, None, nan, None), (-1, "z", 0.0, []), (-1, "z", -0.0, []), (-2, None, None, [None]), (-2, "", None, [None])]
    df = spark.createDataFrame(rows, "word bigint, Marked string, bits double, `a.b` array<int>").repartition(6)
    expected = 3000 + 1 + 1 + 2
    marked, name = columns._with_repeats(df)
    assert 7 + 500 + 4 <= marked.where(name).count() <= 7 + 500 + 4 + 3
    for words in (columns.WORDS, 4, 1):
        monkeypatch.setattr(columns, "WORDS", words)
        out = columns.drop_duplicates(df)
        assert out.columns == df.columns and out.count() == out.distinct().count() == expected
    assert columns.drop_duplicates(df.limit(0)).count() == 0


def test_row_profile_computes_its_table_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def costly(x):
        seen.add(1)
        return None if x % 5 == 0 else str(x % 4)

    df = spark.range(40, numPartitions=2).select(costly("id").alias("t"), (F.col("id") % 2).alias("k"))
    got = profile.quality_score(df).head()
    # t is missing in 8 rows, else one of 4 texts, each of which goes with one k: 4 + 2 different rows
    assert (got["rows"], got["null_cells"], got["duplicates"], got["numeric_text_columns"]) == (40, 8, 34, 1)
    assert seen.value == 40


def test_row_profile_of_many_columns(spark):
    names = [f"c{i}" if i % 3 else f"date {i}" for i in range(45)]  # 90 flags: two words of bits
    rows = [tuple(None if (i + j) % 7 == 0 else ("x" if j == i % 90 else "2020-01-02") if i % 3 == 0 else "7" if i % 3 == 1 else "-" for i in range(45)) for j in range(30)]
    rows += rows[:4]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in names)).repartition(3)
    got = profile.row_profile(df).head()
    values = [[r[i] for r in rows if r[i] is not None] for i in range(45)]
    assert got["rows"] == 34 and got["duplicates"] == 34 - len(set(rows))
    assert got["nulls"] == [34 - len(v) for v in values]
    assert got["numeric_text"] == [set(v) == {"7"} for v in values]
    assert got["date_text"] == [set(v) == {"2020-01-02"} if i % 3 == 0 else None for i, v in enumerate(values)]
    assert profile.row_profile(df, dates=False).head()["date_text"] == [None] * 45
    none = profile.row_profile(df.limit(0)).head()
    assert (none["rows"], none["duplicates"], none["nulls"], none["numeric_text"]) == (0, 0, [0] * 45, [True] * 45)
    assert none["date_text"] == [None if i % 3 else False for i in range(45)]


def test_number_texts_at_the_edges(spark):
    texts = ["", " ", "+", "1", " 1. ", ".5", "1e400", "-1e400", "inf", "-Infinity", "+inf", "NaN", "1d", "1e5", "1,5", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(convert.parse_number(F.col("t")), convert.looks_numeric(F.col("t"))).collect()
    inf = float("inf")
    assert [r[0] for r in got] == [None, None, None, 1.0, 1.0, 0.5, None, None, inf, -inf, inf, None, None, 1e5, None, None]
    assert [r[1] for r in got] == [True, False, False, True, True, True, False, False, True, True, True, False, False, True, False, None]
