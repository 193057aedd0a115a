"""Files written from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import DIRTY_ORDERS, dirty_orders, query, table
from scrubline.session import scratch_path
from scrubline.sources import readers, samples, sinks


@query("s1_read_csv", "select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, c_acctbal, c_mktsegment from customer")
def s1(spark, sf):
    path = sinks.write_csv(table(spark, sf, "customer"), scratch_path(spark, "customer.csv"))
    return readers.read_csv(spark, path)


@query("s1_read_csv_missing", f"""
select o_orderkey, price, priority, status, cast(cust_text as bigint) as cust_text, order_date from ({DIRTY_ORDERS})""")
def s1_missing(spark, sf):
    path = sinks.write_csv(dirty_orders(spark, sf), scratch_path(spark, "dirty.csv"))
    return readers.read_csv(spark, path)


@query("s1_read_csv_multiline", "select doc_id, text, lang, source, n_chars from documents")
def s1_multiline(spark, sf):
    path = sinks.write_csv(table(spark, sf, "documents"), scratch_path(spark, "documents.csv"))
    return readers.read_csv(spark, path)


@query("s1_read_csv_multiline_split", "select doc_id, text, lang, source, n_chars from documents")
def s1_multiline_split(spark, sf):
    """Files with line breaks inside quotes, one a part of the table, each read in ranges."""
    path = sinks.write_csv(table(spark, sf, "documents"), scratch_path(spark, "one.csv"))
    return readers.read_csv(spark, path, multi_line=True)


@query("s2_read_json_columns", "select c_custkey, c_name, c_acctbal, c_mktsegment, case when c_custkey % 3 <> 0 then c_nationkey end as c_nationkey from customer")
def s2_columns(spark, sf):
    """One JSON object of columns, each an object by row label."""
    customers = table(spark, sf, "customer").select(
        "c_custkey", "c_name", "c_acctbal", "c_mktsegment", F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("c_nationkey"))
    label = F.col("c_custkey").cast("string")
    columns = [F.map_from_entries(F.collect_list(F.struct(label, F.col(c)))).alias(c) for c in customers.columns]
    path = scratch_path(spark, "columns.json")
    customers.agg(*columns).select(F.to_json(F.struct(*customers.columns), {"ignoreNullFields": "false"})).write.text(path)
    return readers.read_json(spark, path)


@query("s2_read_json", "select event_id, user_id, event_type, value, date_trunc('second', ts) as created_at from events")
def s2(spark, sf):
    path = scratch_path(spark, "events.json")
    events = table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"))
    events.write.json(path)
    return readers.read_json(spark, path)


@query("s3_load_tables", """
select 'nation.csv' as name, count(*) as rows from nation union all select 'region.json', count(*) from region
union all select 'part.parquet', count(*) from part""")
def s3(spark, sf):
    csv = sinks.write_csv(table(spark, sf, "nation"), scratch_path(spark, "nation") + ".csv")
    json = scratch_path(spark, "region") + ".json"
    table(spark, sf, "region").write.json(json)
    skipped = []
    tables = readers.load_tables(
        spark, {"nation.csv": csv, "region.json": json, "part.parquet": f"{sf}/part.parquet", "notes.txt": "notes.txt"},
        on_error=lambda name, error: skipped.append(name))
    assert skipped == ["notes.txt"]
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("s5_sample_dirty", """
with n as (select count(*) as n from customer)
select n + 8 as rows, n as different, 20 as missing_ages, 10 as far_amounts, n // 7 as padded_names, '2023-01-01' as first_date, n as last_id from n""")
def s5(spark, sf):
    """The known defects of a sample table with as many rows as there are customers."""
    df = samples.sample_dirty(spark, table(spark, sf, "customer").count())
    once = df.distinct()
    copies = df.agg(F.count("*").cast("bigint").alias("rows"))
    found = once.agg(F.count("*").alias("different"), F.count_if(F.col("age").isNull()).cast("int").alias("missing_ages"),
                     F.count_if(F.col("purchase_amount") > 10_000).cast("int").alias("far_amounts"),
                     F.count_if(F.col("name").like("  Customer %  ")).alias("padded_names"), F.min("signup_date").alias("first_date"), F.max("customer_id").alias("last_id"))
    return found.withColumn("rows", copies.scalar())


@query("s6_write_csv", "select count(*) as rows, count(distinct l_orderkey) as orders, cast(round(sum(l_quantity), 0) as bigint) as quantity from lineitem")
def s6(spark, sf):
    path = sinks.write_csv(table(spark, sf, "lineitem").select("l_orderkey", "l_quantity"), scratch_path(spark, "lines.csv"))
    back = spark.read.option("header", True).schema("l_orderkey bigint, l_quantity double").csv(path)
    return back.agg(F.count("*").alias("rows"), F.count_distinct("l_orderkey").alias("orders"),
                    F.round(F.sum("l_quantity")).cast("bigint").alias("quantity"))
