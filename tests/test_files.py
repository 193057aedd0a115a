"""Reading and writing files."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scrubline.sources import readers, samples, sinks


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


CSV = 'a,a,b,c,d,e,f,\n1,x,1.5,True,NA,2020-01-01,007x,k\n2,"q, ""r""",,False,,2020-01-02,5, \n 3 ,n/a,1e3,true,null,None,nan,\n'


def test_csv_follows_pandas(spark, tmp_path):
    path = put(tmp_path, "x.csv", CSV)
    expected = pd.read_csv(path)
    df = readers.read_csv(spark, path)
    assert df.columns == list(expected.columns)
    assert dict(df.dtypes) == {"a": "bigint", "a.1": "string", "b": "double", "c": "boolean", "d": "double", "e": "string", "f": "string", "Unnamed: 7": "string"}
    clean = [[None if pd.isna(v) else v for v in r] for r in expected.itertuples(index=False)]
    assert [list(r) for r in df.collect()] == clean


def test_csv_with_line_breaks(spark, tmp_path):
    path = put(tmp_path, "x.csv", 'id,t\n1,"two\nlines, ""quoted"""\n2,plain\n')
    assert readers.has_quoted_newlines(spark, path)
    assert [tuple(r) for r in readers.read_csv(spark, path).collect()] == [(1, 'two\nlines, "quoted"'), (2, "plain")]
    assert not readers.has_quoted_newlines(spark, put(tmp_path, "y.csv", 'id,t\n1,"a ""b"""\n'))


def test_one_large_csv_is_read_in_ranges(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(['a', ' ', ',', '"', '\n', '\r\n', 'bc', '""']) for _ in range(rng.randrange(0, 40))) + "x", "".join(rng.choice("\ny") for _ in range(900 if i % 50 == 0 else 1)) + "z")
            for i in range(400)]
    data = pd.DataFrame(rows, columns=["id", 'say "it"\nagain', "t"])
    for name in ("one", "two"):
        (tmp_path / "d").mkdir(exist_ok=True)
        data[data["id"] % 2 == (name == "one")].to_csv(tmp_path / "d" / f"{name}.csv", index=False, lineterminator="\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("300", "2000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            records = readers.csv_records(spark, str(tmp_path / "d"))
            assert records.where("header").count() == 2
            df = readers.read_csv(spark, str(tmp_path / "d"))
            assert sorted(tuple(r) for r in df.collect()) == sorted(rows), size
            assert df.columns == list(data.columns)
            assert size == "128m" or spark.read.text(str(tmp_path / "d")).rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_csv_records_at_the_ends(spark, tmp_path):
    for text, rows in (('a,b\n"p\n",2', [("p\n", 2)]), ('a,b\n\n"p\n",2\n\n', [("p\n", 2)]), ('a,b\r\n"x\r\ny",2\r\n', [("x\r\ny", 2)]), ('"a",b\n1,"not closed\n', [(1, "not closed")])):
        path = put(tmp_path, "e.csv", text)
        got = [tuple(r) for r in readers.read_csv(spark, path, multi_line=True).collect()]
        assert [tuple(v.rstrip("\n") if isinstance(v, str) and "closed" in v else v for v in r) for r in got] == rows, text
    with pytest.raises(ValueError):
        readers.read_csv(spark, put(tmp_path, "nothing.csv", ""), multi_line=True)
    (tmp_path / "h").mkdir()
    put(tmp_path / "h", "1.csv", 'a,b\n"1\n2",2\n')
    put(tmp_path / "h", "2.csv", "b,a\n1,2\n")
    with pytest.raises(ValueError, match="header"):
        readers.read_csv(spark, str(tmp_path / "h"))


def test_unique_names():
    assert readers.unique_names(["a", "a", None, "a", "a.1"]) == ["a", "a.1", "Unnamed: 2", "a.2", "a.1.1"]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, ' padded "x"', None, [1]), (2, "line\nbreak,comma", 2.5, None)], "i int, t string, v double, l array<int>")
    back = readers.read_csv(spark, sinks.write_csv(df, str(tmp_path / "out.csv")))
    assert sorted(tuple(r) for r in back.collect()) == [(1, ' padded "x"', None, "[1]"), (2, "line\nbreak,comma", 2.5, None)]


ROWS = [{"id": 1, "created_at": "2020-01-01T10:00:00", "v": 1.5, "n": {"x": 1}}, {"id": 2, "created_at": None, "v": None, "n": None}]


def test_json_layouts(spark, tmp_path):
    array = readers.read_json(spark, put(tmp_path, "a.json", json.dumps(ROWS, indent=1)))
    lines = readers.read_json(spark, put(tmp_path, "l.json", "\n".join(map(json.dumps, ROWS))))
    for df in (array, lines):
        assert dict(df.dtypes)["created_at"] == "timestamp_ntz"
        assert sorted((r["id"], str(r["created_at"]), r["v"]) for r in df.collect()) == [(1, "2020-01-01 10:00:00", 1.5), (2, "None", None)]


@pytest.mark.parametrize("indent", [None, 2])
def test_json_of_columns(spark, tmp_path, indent):
    data = pd.DataFrame({"id": range(12), "t": [f"t{i}" if i % 5 else None for i in range(12)], "timestamp": range(1_600_000_000, 1_600_000_012)})
    path = put(tmp_path, "c.json", json.dumps(json.loads(data.to_json()), indent=indent))
    expected = pd.read_json(path)
    df = readers.read_json(spark, path)
    assert [(r["id"], r["t"], str(r["timestamp"])) for r in df.collect()] == [
        (r.id, r.t, str(r.timestamp)) for r in expected.itertuples()]


def test_row_labels_are_no_schema(spark, tmp_path):
    n = 30_000
    data = {"a": {str(i): i for i in range(n)}, "b.c": {str(i): i / 4 if i % 7 else None for i in range(n)}, "d": {str(i): [i, f"x{i}"][i % 2] for i in range(n)},
            "e": {str(i): None for i in range(n)}, "f": {str(i): {"k": i} for i in range(n)}, "g": {str(i): i % 2 == 0 for i in range(n)}}
    df = readers.read_json(spark, put(tmp_path, "w.json", json.dumps(data)))
    assert df.dtypes == [("a", "bigint"), ("`b.c`".strip("`"), "double"), ("d", "string"), ("e", "string"), ("f", "struct<k:bigint>"), ("g", "boolean")]
    rows = df.collect()
    assert len(rows) == n and len(df._jdf.queryExecution().analyzed().toString()) < 20_000
    assert tuple(rows[9])[:4] == (9, 2.25, "x9", None) and rows[7]["b.c"] is None and rows[8]["d"] == "8" and rows[8]["f"]["k"] == 8


def test_one_flat_record(spark, tmp_path):
    assert readers.read_json(spark, put(tmp_path, "o.json", '{"a": 1, "b": "x"}')).collect()[0].asDict() == {"a": 1, "b": "x"}


def test_load_tables_and_guard(spark, tmp_path):
    good = put(tmp_path, "g.csv", "a\n1\n2\n")
    with pytest.raises(ValueError):
        readers.load_tables(spark, [str(tmp_path / "x.txt")])
    failed = []
    tables = readers.load_tables(spark, [good, str(tmp_path / "none.csv")], on_error=lambda n, e: failed.append(n))
    assert list(tables) == ["g.csv"] and failed == ["none.csv"]
    with pytest.raises(ValueError):
        readers.row_guard(tables["g.csv"], 1)
    assert readers.row_guard(tables["g.csv"], 2).count() == 2


def test_sample_table(spark):
    df = samples.sample_dirty(spark)
    assert df.columns == ["customer_id", "name", "age", "city", "purchase_amount", "signup_date", "rating"]
    assert df.count() == 308 and df.distinct().count() == 300
    first = df.distinct()
    assert first.where("age is null").count() == 20
    assert first.where("purchase_amount > 10000").count() == 10
    assert first.where("name like '  Customer %  '").count() == 300 // 7
    shares = {r["city"]: r["count"] / 300 for r in first.groupBy("city").count().collect()}
    assert 0.2 < shares["Mumbai"] < 0.4 and 0.01 < shares[None] < 0.12
    from scrubline.operators.issues import detect_issues

    found = {(r["type"], r["column"]) for r in detect_issues(df).collect()}
    assert ("duplicates", "All columns") in found and ("datatype", "signup_date") in found
    assert first.agg(F.min("signup_date")).head()[0] == "2023-01-01"


def test_csv_lines_of_other_lengths(spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_text('a,b\n1,2\n6\n"x,y","say ""hi"", you"\n')
    assert [tuple(r) for r in readers.read_csv(spark, str(path)).collect()] == [("1", "2"), ("6", None), ("x,y", 'say "hi", you')]
    for name, text in (("long", "a,b\n1,2\n3,4,5\n6\n"), ("trailing", "a,b\n3,4,\n"), ("lines", 'a,b\n"1\n2",3,4\n')):
        path = tmp_path / f"{name}.csv"
        path.write_text(text)
        with pytest.raises(Exception, match="more than 2 fields"):
            readers.read_csv(spark, str(path)).select("b").collect()
        with pytest.raises(Exception, match="more than 2 fields"):
            readers.read_csv(spark, str(path), infer=False).select("b").collect()


def test_csv_folder_with_other_headers(spark, tmp_path):
    (tmp_path / "1.csv").write_text("a,b\n1,2\n")
    (tmp_path / "2.csv").write_text("b,a\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_csv(spark, str(tmp_path)).collect()


def test_no_task_writes_the_whole_multi_line_input(spark, tmp_path):
    import glob

    from checks import files
    from scrubline.session import shared_dir

    rows = [(i, f"line one of {i}\nline \"two\", of {i}", "en", "web", 20 + i) for i in range(300)]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    spark.createDataFrame(rows, names).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    pattern = f"{shared_dir(spark).removeprefix('file:')}/one.csv-*"
    before = set(glob.glob(pattern))
    found = files.s1_multiline_split(spark, str(tmp_path))
    assert sorted(map(tuple, found.select(names).collect())) == rows
    written, = set(glob.glob(pattern)) - before
    assert len(glob.glob(f"{written}/part-*")) == 3
