"""Every registered query against its SQL, and the contract of the entry module."""

import pytest

import __spark_entry__ as entry
from compare import difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert difference(spark, SF, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and 0 < rows[0]["score"] < 100


def test_score_of_dirty_orders(spark):
    row = entry.queries()["score_dirty_orders"](spark, "/root/testdata/sf0.01").head()
    assert (row["rows"], row["duplicates"], row["null_cells"], row["numeric_text_columns"]) == (15300, 300, 12556, 1)
    assert row["score"] == pytest.approx(82.362, abs=1e-3)


def test_join_sizes_with_missing_keys(spark):
    from scrubline.operators.joins import join_tables

    sf = "/root/testdata/sf0.01"
    left = spark.read.parquet(f"{sf}/nation.parquet").selectExpr(
        "case when n_nationkey % 5 = 0 then null else n_nationkey end as k", "n_name as v")
    right = spark.read.parquet(f"{sf}/supplier.parquet").where("s_suppkey % 9 = 0 or s_nationkey < 20").selectExpr(
        "case when s_suppkey % 9 = 0 then null else s_nationkey end as j", "s_name as v")
    sizes = [join_tables(left, right, "k", "j", how).count() for how in ("inner", "left", "right", "outer")]
    assert sizes == [127, 131, 137, 141]
