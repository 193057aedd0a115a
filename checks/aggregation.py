"""Chart data, pivots and totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import dirty_orders, key_hash_sql, query, table
from checks.profiling import d
from scrubline.operators import aggregates


def _hist_sql(column: str, source: str, bins: int = 30) -> str:
    return f"""
with s as (select min({column}) as lo, max({column}) as hi, (max({column}) - min({column})) / {bins}.0 as w from {source}),
c as (select least(floor(({column} - lo) / w), {bins - 1}) as bin, count(*) as n from {source}, s group by 1)
select cast(b as integer) as bin, round(lo + w * b, 4) as bin_low, round(lo + w * (b + 1), 4) as bin_high,
  coalesce(n, 0) as count
from range({bins}) g(b) cross join s left join c on c.bin = b"""


def _hist(df, column):
    return aggregates.histogram(df, column).select(
        "bin", F.round("bin_low", 4).alias("bin_low"), F.round("bin_high", 4).alias("bin_high"), "count")


@query("hist_events", _hist_sql("value", "events"))
def v1(spark, sf):
    return _hist(table(spark, sf, "events"), "value")


@query("hist_lineitem", _hist_sql("l_extendedprice", "lineitem"))
def v1_lineitem(spark, sf):
    return _hist(table(spark, sf, "lineitem"), "l_extendedprice")


POINT_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("v2_scatter_sample", f"""
select {', '.join(POINT_KEY)}, l_quantity, l_extendedprice from lineitem
order by {key_hash_sql(42, *POINT_KEY)}, {', '.join(POINT_KEY)} limit 5000""")
def v2(spark, sf):
    return aggregates.scatter_sample(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", POINT_KEY)


@query("top_brand", "select p_brand, count(*) as count from part group by p_brand order by count desc, p_brand limit 15")
def v3(spark, sf):
    return aggregates.top_values(table(spark, sf, "part"), "p_brand")


NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql(columns: list[str], source: str) -> str:
    return " union all ".join(
        f"select '{a}' as column_x, '{b}' as column_y, case when isnan(corr({a}, {b})) then null else round(corr({a}, {b}), 4) end as corr from {source}"
        for a in columns for b in columns)


@query("v4_correlation_matrix", _corr_sql(NUMBERS, "lineitem"))
def v4(spark, sf):
    return aggregates.correlation_matrix(table(spark, sf, "lineitem")).withColumn("corr", F.round("corr", 4) + 0.0)


GAPS = """g as (select case when event_id % 3 = 0 then null else value end as a,
  case when event_id % 4 = 0 then null else user_id end as b, 7 as c from events)"""


@query("v4_correlation_matrix_gaps", f"with {GAPS} " + _corr_sql(["a", "b"], "g") + "".join(
    f" union all select '{x}', '{y}', null" for x, y in (("a", "c"), ("b", "c"), ("c", "a"), ("c", "b"), ("c", "c"))))
def v4_gaps(spark, sf):
    e = table(spark, sf, "events")
    gaps = e.select(F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("a"),
                    F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("b"), F.lit(7).alias("c"))
    return aggregates.correlation_matrix(gaps).withColumn("corr", F.round("corr", 4) + 0.0)


STATUSES = ["F", "O", "P"]


def _pivot_sql(agg: str) -> str:
    function = {"mean": "avg", "median": "median"}.get(agg, agg)
    drop = "" if agg in ("sum", "count") else "where cell is not null"
    total = {"sum": "coalesce(sum(price), 0)"}.get(agg, f"{function}(price)")
    cast = "bigint" if agg == "count" else "double"
    cells = ", ".join(f"round(cast(coalesce(max(case when status = '{s}' then cell end), 0) as {cast}), 4) as \"{s}\"" for s in STATUSES)
    return f"""
with {d()}, c as (select priority, status, {total} as cell from d where priority is not null and status is not null group by priority, status)
select priority, {cells} from c {drop} group by priority"""


def _pivot(agg: str):
    def run(spark, sf):
        out = aggregates.pivot_table(dirty_orders(spark, sf), ["priority"], "price", agg, ["status"])
        return out.select("priority", *[F.round(c, 4).alias(c) for c in out.columns if c != "priority"])
    return run


for _agg in aggregates.AGGREGATES:
    query(f"pivot_{_agg}", _pivot_sql(_agg))(_pivot(_agg))


@query("pivot_two_columns", """
select l_linenumber, """ + ", ".join(
    f"coalesce(sum(case when l_returnflag = '{a}' and l_linestatus = '{b}' then l_quantity end), 0) as \"{a}|{b}\""
    for a in "ANR" for b in "FO") + " from lineitem group by l_linenumber")
def v8_two(spark, sf):
    values = [f"{a}|{b}" for a in "ANR" for b in "FO"]
    return aggregates.pivot_table(table(spark, sf, "lineitem"), ["l_linenumber"], "l_quantity", "sum",
                                  ["l_returnflag", "l_linestatus"], values)


@query("pivot_sparse", """
select o_orderpriority as priority, cast(o_custkey as varchar) || '|' || cast(o_orderkey % 16 as varchar) as name, round(sum(o_totalprice), 2) as cell
from orders where o_orderpriority is not null group by all""")
def pivot_sparse(spark, sf):
    """Tens of thousands of columns: customers by a part of the order number."""
    orders = table(spark, sf, "orders").select("o_orderpriority", "o_custkey", (F.col("o_orderkey") % 16).alias("slot"), "o_totalprice")
    wide = aggregates.pivot_sparse(orders, ["o_orderpriority"], "o_totalprice", "sum", ["o_custkey", "slot"], part_cells=1000)
    return wide.select(F.col("o_orderpriority").alias("priority"), F.explode("cells").alias("name", "cell")).withColumn("cell", F.round("cell", 2))


@query("pivot_no_columns", """
select l_returnflag, l_linestatus, round(median(l_extendedprice), 4) as l_extendedprice from lineitem group by l_returnflag, l_linestatus""")
def v8_none(spark, sf):
    out = aggregates.pivot_table(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", "median")
    return out.withColumn("l_extendedprice", F.round("l_extendedprice", 4))


@query("v9_group_totals", """
select n_name, round(sum(c_acctbal), 4) as value from customer join nation on c_nationkey = n_nationkey group by n_name""")
def v9(spark, sf):
    located = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return aggregates.group_totals(located, "n_name", "c_acctbal").withColumn("value", F.round("value", 4))


@query("v9_group_counts", """
select n_name, count(*) as value from customer join nation on c_nationkey = n_nationkey group by n_name""")
def v9_counts(spark, sf):
    located = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return aggregates.group_totals(located, "n_name")
