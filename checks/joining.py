"""Joins, stacking and key lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import LEFT_KEYS, RIGHT_KEYS, derived, query, table
from scrubline.operators import joins


def _keys(spark, sf):
    return derived(spark, sf, LEFT_KEYS), derived(spark, sf, RIGHT_KEYS)


def _join_sql(how: str) -> str:
    return f"select l.k, l.v as v_x, r.j, r.v as v_y from ({LEFT_KEYS}) l {how} join ({RIGHT_KEYS}) r on l.k is not distinct from r.j"


def _join(how: str):
    def run(spark, sf):
        left, right = _keys(spark, sf)
        return joins.join_tables(left, right, "k", "j", how)
    return run


for _how, _sql in (("inner", "inner"), ("left", "left"), ("right", "right"), ("outer", "full")):
    query(f"join_{_how}", _join_sql(_sql))(_join(_how))


def _documents(how: str):
    def run(spark, sf):
        labels = table(spark, sf, "labels").withColumn("lang", F.lit("label"))
        documents = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
        return joins.join_tables(documents, labels, "doc_id", "doc_id", how)
    return run


for _how, _sql in (("left", "left"), ("right", "right"), ("outer", "full")):
    _key = {"left": "d.doc_id", "right": "b.doc_id", "outer": "coalesce(d.doc_id, b.doc_id)"}[_how]
    query(f"join_{_how}_documents_labels", f"""
select {_key} as doc_id, d.lang as lang_x, d.n_chars, b.quality, b.toxic, case when b.doc_id is not null then 'label' end as lang_y
from documents d {_sql} join labels b on d.doc_id = b.doc_id""")(_documents(_how))


@query("join_inner_lineitem_orders", """
select l_orderkey, l_partkey, l_quantity, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
from lineitem join orders on l_orderkey = o_orderkey""")
def j1_large(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return joins.join_tables(lines, table(spark, sf, "orders"), "l_orderkey", "o_orderkey")


@query("j5_check_key_types", "select count(*) as accepted from customer join nation on c_nationkey = n_nationkey")
def j5(spark, sf):
    customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    try:
        joins.join_tables(customer, nation, "c_nationkey", "n_name")
        raise AssertionError("keys of different types were accepted")
    except TypeError:
        return joins.join_tables(customer, nation, "c_nationkey", "n_nationkey").agg(F.count("*").alias("accepted"))


MERGED = "merged as (" + _join_sql("full") + ")"


@query("j6_join_summary", f"""
with {MERGED}
select (select count(*) from nation) as rows_left, (select count(*) from supplier) as rows_right, count(*) as rows_merged,
  round(count(*) * 100.0 / greatest((select count(*) from nation), (select count(*) from supplier)), 4) as match_rate,
  cast(2 as bigint) as columns_added
from merged""")
def j6(spark, sf):
    left, right = _keys(spark, sf)
    merged = joins.join_tables(left, right, "k", "j", "outer")
    return joins.join_summary(left, right, merged).withColumn("match_rate", F.round("match_rate", 4))


@query("j7_join_columns", f"with {MERGED} " + " union all ".join(
    f"select '{c}' as \"column\", '{t}' as dtype, count({c}) as non_null, count(*) - count({c}) as nulls, '{s}' as source from merged"
    for c, t, s in (("k", "int", "File 1"), ("v_x", "string", "Both"), ("j", "int", "File 2"), ("v_y", "string", "Both"))))
def j7(spark, sf):
    left, right = _keys(spark, sf)
    return joins.join_columns(left, right, joins.join_tables(left, right, "k", "j", "outer"))


@query("j8_keep_rows", "select * from documents where doc_id in (select doc_id from labels where quality = 1)")
def j8(spark, sf):
    return joins.keep_rows(table(spark, sf, "documents"), table(spark, sf, "labels").where("quality = 1"), ["doc_id"])


@query("j8_drop_rows", "select * from documents where doc_id not in (select doc_id from labels where toxic = 1)")
def j8_drop(spark, sf):
    return joins.drop_rows(table(spark, sf, "documents"), table(spark, sf, "labels").where("toxic = 1"), ["doc_id"])


@query("u1_append_rows", """
select c_name as name, c_nationkey as nation, c_acctbal as balance, c_mktsegment as segment from customer
union all select s_name, s_nationkey, s_acctbal, null from supplier""")
def u1(spark, sf):
    customers = table(spark, sf, "customer").selectExpr("c_name name", "c_nationkey nation", "c_acctbal balance", "c_mktsegment segment")
    suppliers = table(spark, sf, "supplier").selectExpr("s_acctbal balance", "s_name name", "s_nationkey nation")
    return joins.append_rows(customers, suppliers)
