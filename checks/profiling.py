"""Profiles, quality score, issues."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import BASE_ORDERS, DIRTY_ORDERS, base_orders, dirty_orders, key_hash_sql, query, table
from scrubline.functions.classes import normalize_missing
from scrubline.operators import issues, profile
from scrubline.plans import autofix, report
from scrubline.sources.readers import row_guard

ORDER_COLUMNS = ["o_orderkey", "price", "priority", "status", "cust_text", "order_date"]
TEXTS = ["priority", "status", "cust_text", "order_date"]
NUMBER_PATTERN = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"


def d(name: str = "d") -> str:
    return f"{name} as ({DIRTY_ORDERS})"


DUPLICATES = "(select sum(n - 1) from (select count(*) as n from d group by all))"
NULL_CELLS = " + ".join(f"count(*) - count({c})" for c in ORDER_COLUMNS)
NUMERIC_TEXTS = " + ".join(
    f"case when count({c}) = count(case when regexp_matches({c}, {NUMBER_PATTERN}) then 1 end) then 1 else 0 end"
    for c in TEXTS)


def score_parts(source: str) -> str:
    """A one-row SQL with the parts of the score of a relation with the columns of dirty_orders."""
    return f"""
select count(*) as n_rows, cast({NULL_CELLS} as bigint) as null_cells,
  cast(count(*) - (select count(*) from (select distinct * from {source})) as bigint) as duplicates,
  cast({NUMERIC_TEXTS} as bigint) as numeric_text_columns
from {source}"""


SCORE = "greatest(0, least(100, 100 - least(null_cells * 100.0 / (n_rows * 6), 30) - least(duplicates * 100.0 / n_rows, 20) - 2.0 * numeric_text_columns))"


@query("p1_shape", """
select count(*) as rows, cast(11 as bigint) as columns, cast(5 as bigint) as dtypes from lineitem""")
def p1(spark, sf):
    return profile.shape(table(spark, sf, "lineitem"))


def _types(columns: list[tuple[str, str]], source: str, extra: str = "") -> str:
    return " union all ".join(
        f"select '{c}' as \"column\", count({c}) as non_null, '{t}' as dtype{extra} from {source}" for c, t in columns)


@query("info_orders", _types(
    [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
     ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")], "orders"))
def p2(spark, sf):
    return profile.column_info(table(spark, sf, "orders"))


@query("p3_null_profile", f"with {d()} " + " union all ".join(
    f"select '{c}' as \"column\", count(*) - count({c}) as nulls, round((count(*) - count({c})) * 100.0 / count(*), 4) as null_pct from d"
    for c in ORDER_COLUMNS))
def p3(spark, sf):
    return profile.null_profile(dirty_orders(spark, sf)).withColumn("null_pct", F.round("null_pct", 4))


@query("p3_null_cells", f"with {d()} select cast({NULL_CELLS} as bigint) as null_cells from d")
def p3_cells(spark, sf):
    return profile.null_cells(dirty_orders(spark, sf))


@query("p4_duplicate_count", f"""
with {d()}, u as (select distinct * from d)
select (select count(*) from d) - (select count(*) from u) as duplicates,
  round(((select count(*) from d) - (select count(*) from u)) * 100.0 / (select count(*) from d), 4) as duplicate_pct""")
def p4(spark, sf):
    return profile.duplicate_count(dirty_orders(spark, sf)).withColumn("duplicate_pct", F.round("duplicate_pct", 4))


@query("p5_numeric_text_columns", f"with {d()} " + " union all ".join(
    f"select '{c}' as \"column\" from d having count({c}) > 0 and count({c}) = count(case when regexp_matches({c}, {NUMBER_PATTERN}) then 1 end)"
    for c in TEXTS))
def p5(spark, sf):
    return profile.numeric_text_columns(dirty_orders(spark, sf))


@query("p6_date_text_columns", f"""
with {d()} select 'order_date' as "column" from d
having count(order_date) > 0 and count(order_date) = count(try_strptime(order_date, '%Y-%m-%d'))""")
def p6(spark, sf):
    return profile.date_text_columns(dirty_orders(spark, sf))


def iqr_sql(source: str, columns: list[str]) -> str:
    return " union all ".join(f"""
select '{c}' as "column", round(q1, 4) as q1, round(q3, 4) as q3,
  count(case when {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1) then 1 end) as outliers,
  round(count(case when {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1) then 1 end) * 100.0 / count(*), 4) as outlier_pct
from {source}, (select quantile_cont(cast({c} as double), 0.25) as q1, quantile_cont(cast({c} as double), 0.75) as q3 from {source})
group by q1, q3""" for c in columns)


def _iqr(df):
    return profile.iqr_profile(df).select(
        "column", F.round("q1", 4).alias("q1"), F.round("q3", 4).alias("q3"), "outliers",
        F.round("outlier_pct", 4).alias("outlier_pct"))


@query("p7_iqr_profile", iqr_sql("events", ["event_id", "user_id", "value"]))
def p7(spark, sf):
    return _iqr(table(spark, sf, "events"))


@query("p7_iqr_profile_lineitem", iqr_sql("lineitem", [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def p7_lineitem(spark, sf):
    return _iqr(table(spark, sf, "lineitem"))


@query("score_dirty_orders", f"""
with {d()}, p as ({score_parts("d")})
select n_rows as rows, null_cells, duplicates, numeric_text_columns, round({SCORE}, 4) as score from p""")
def p8(spark, sf):
    return profile.quality_score(normalize_missing(dirty_orders(spark, sf))).withColumn("score", F.round("score", 4))


ISSUES = f"""
with {d()}, p as ({score_parts("d")}),
n as (select count(*) as rows, count(*) - count(price) as price, count(*) - count(priority) as priority,
        count(*) - count(status) as status, count(*) - count(order_date) as order_date from d),
found as (
  {" union all ".join(f'''
  select {i} as rank, case when {c} * 100.0 / rows > 50 then 'critical' else 'warning' end as severity, 'missing_values' as type,
    '{c}' as "column", format('{{:.1f}}% missing values', {c} * 100.0 / rows) as detail,
    case when {c} * 100.0 / rows > 50 then 'drop_or_fill' else 'fill' end as action, true as auto_fixable
  from n where {c} * 100.0 / rows > 5''' for i, c in enumerate(["price", "priority", "status", "order_date"]))}
  union all
  select 10, case when duplicates * 100.0 / n_rows < 10 then 'warning' else 'critical' end, 'duplicates', 'All columns',
    format('{{:,}} duplicate rows ({{:.1f}}%)', duplicates, duplicates * 100.0 / n_rows), 'remove', true
  from p where duplicates > 0
  {" ".join(f'''
  union all select {20 + 2 * i}, 'warning', 'datatype', '{c}', 'Stored as text but looks like numbers', 'convert_numeric', true
  from d having count({c}) > 0 and count({c}) = count(case when regexp_matches({c}, {NUMBER_PATTERN}) then 1 end)''' for i, c in enumerate(TEXTS))}
  union all select 27, 'warning', 'datatype', 'order_date', 'Stored as text but looks like dates', 'convert_datetime', true
  from d having count(order_date) > 0 and count(order_date) = count(try_strptime(order_date, '%Y-%m-%d'))
  {" ".join(f'''
  union all select {40 + i}, 'info', 'outliers', '{c}', format('{{:,}} outliers detected ({{:.1f}}%)', n, n * 100.0 / rows), 'review', false
  from (select count(*) as rows, count(case when {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1) then 1 end) as n
        from d, (select quantile_cont(cast({c} as double), 0.25) as q1, quantile_cont(cast({c} as double), 0.75) as q3 from d))
  where n * 100.0 / rows > 5''' for i, c in enumerate(["o_orderkey", "price"]))}
)"""


@query("issues_dirty_orders", ISSUES + """
select cast(row_number() over (order by rank) - 1 as integer) as position, severity, type, "column", detail, action, auto_fixable
from found""")
def p9(spark, sf):
    return issues.detect_issues(dirty_orders(spark, sf))


@query("p10_issue_counts", ISSUES + """
select severity, count(*) as issues, count(case when auto_fixable then 1 end) as auto_fixable from found group by severity""")
def p10(spark, sf):
    return issues.issue_counts(issues.detect_issues(dirty_orders(spark, sf)))


def _describe_numbers(c: str, source: str) -> str:
    return f"""
select '{c}' as "column", count({c}) as count, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std,
  round(cast(min({c}) as double), 4) as min, round(quantile_cont(cast({c} as double), 0.25), 4) as q25,
  round(quantile_cont(cast({c} as double), 0.5), 4) as q50, round(quantile_cont(cast({c} as double), 0.75), 4) as q75,
  round(cast(max({c}) as double), 4) as max,
  cast(null as timestamp) as ts_min, cast(null as timestamp) as ts_max,
  cast(null as bigint) as "unique", cast(null as varchar) as top, cast(null as bigint) as freq
from {source}"""


def _describe_text(c: str, source: str) -> str:
    return f"""
select '{c}', (select count({c}) from {source}), null, null, null, null, null, null, null, null, null,
  (select count(distinct {c}) from {source}), v, n
from (select {c} as v, count(*) as n from {source} where {c} is not null group by {c} order by n desc, v limit 1)"""


@query("p11_describe_all", " union all ".join(
    [_describe_numbers(c, "lineitem") for c in ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                                                  "l_extendedprice", "l_discount", "l_tax"]]
    + ["(" + _describe_text(c, "lineitem") + ")" for c in ["l_returnflag", "l_linestatus"]]
    + ["""
select 'l_shipdate', count(l_shipdate), null, null, null, null, null, null, null, min(l_shipdate), max(l_shipdate),
  null, null, null from lineitem"""]))
def p11(spark, sf):
    out = profile.describe_all(table(spark, sf, "lineitem"))
    rounded = [F.round(c, 4).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")]
    return out.select("column", "count", *rounded, "ts_min", "ts_max", "unique", "top", "freq")


# The table after its missing values are filled, copies removed and text converted.
FIXED = """
fixed as (
  select distinct o_orderkey,
    coalesce(price, (select median(price) from d)) as price,
    coalesce(priority, (select priority from d where priority is not null group by priority order by count(*) desc, priority limit 1)) as priority,
    coalesce(status, (select status from d where status is not null group by status order by count(*) desc, status limit 1)) as status,
    cast(cust_text as double) as cust_text,
    strptime(coalesce(order_date, (select order_date from d where order_date is not null group by order_date order by count(*) desc, order_date limit 1)), '%Y-%m-%d') as order_date
  from d)"""


@query("p12_quality_delta", f"""
with {d()}, p as ({score_parts("d")}), {FIXED}
select round({SCORE}, 4) as score_before, cast(100 as double) as score_after, round(100 - {SCORE}, 4) as improvement from p""")
def p12(spark, sf):
    before = dirty_orders(spark, sf)
    after, _ = autofix.auto_fix(before)
    return profile.quality_delta(before, after).select(
        *[F.round(c, 4).alias(c) for c in ("score_before", "score_after", "improvement")])


@query("p13_preview", "select * from orders order by o_orderkey limit 50")
def p13(spark, sf):
    return profile.preview(table(spark, sf, "orders"), 50, ["o_orderkey"])


@query("p13_sample", f"select * from orders order by {key_hash_sql(42, 'o_orderkey')}, o_orderkey limit 5")
def p13_sample(spark, sf):
    return profile.sample(table(spark, sf, "orders"), 5, ["o_orderkey"])


@query("autofix_dirty_orders", f"""
with {d()}, {FIXED}
select o_orderkey, round(price, 4) as price, priority, status, cust_text, cast(order_date as timestamp) as order_date from fixed""")
def c15(spark, sf):
    fixed, _ = autofix.auto_fix(dirty_orders(spark, sf))
    return fixed.withColumn("price", F.round("price", 4))


@query("report_orders", f"""
with {d()}, p as ({score_parts("d")}), s as (select {SCORE} as score from p)
select 'quality' as section, 'initial_score' as item, format('{{:.3f}}', score) as value from s
union all select 'quality', 'final_score', '100.000'
union all select 'quality', 'improvement', format('{{:.3f}}', 100 - score) from s
union all select 'data', 'rows', cast((select count(*) from (select distinct * from d)) as varchar)
union all select 'data', 'columns', '6'
union all select 'data', 'missing_cells', '0'""")
def s7(spark, sf):
    before = dirty_orders(spark, sf)
    after, _ = autofix.auto_fix(before)
    return report.cleaning_report(before, after)


@query("s4_row_guard", "select count(*) as rows from customer")
def s4(spark, sf):
    return row_guard(table(spark, sf, "customer"), 1_000_000_000).agg(F.count("*").alias("rows"))


@query("normalize_missing", f"with base as ({BASE_ORDERS}) select o_orderkey, price from base")
def nan_rule(spark, sf):
    orders = base_orders(spark, sf)
    with_nan = orders.select("o_orderkey", F.coalesce("price", F.lit(float("nan"))).alias("price"))
    return normalize_missing(with_nan)
