"""Outliers, fuzzy duplicates and anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import key_hash_sql, query, table
from scrubline.operators import anomalies, fuzzy, outliers

EVENTS = "event_id, ts, user_id, event_type, value, props"
FENCES = """s as (select q1, q2, q3, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from (
  select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as q2, quantile_cont(value, 0.75) as q3 from events))"""
MOMENTS = "s as (select avg(value) as mean, stddev_samp(value) as std from events)"


@query("o1_outliers_iqr", f"with {FENCES} select {EVENTS} from events, s where value < lo or value > hi")
def o1(spark, sf):
    return outliers.find_outliers(table(spark, sf, "events"), "value", "iqr", 1.5)


@query("o1_outliers_iqr_wide", """
with s as (select quantile_cont(n_chars, 0.25) as q1, quantile_cont(n_chars, 0.75) as q3 from documents)
select doc_id, lang, source, n_chars from documents, s where n_chars < q1 - 3 * (q3 - q1) or n_chars > q3 + 3 * (q3 - q1)""")
def o1_wide(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return outliers.find_outliers(documents, "n_chars", "iqr", 3.0)


@query("o2_outliers_zscore", f"with {MOMENTS} select {EVENTS} from events, s where abs((value - mean) / std) > 3")
def o2(spark, sf):
    return outliers.find_outliers(table(spark, sf, "events"), "value", "zscore", 3.0)


@query("o3_remove_outliers", f"with {FENCES} select {EVENTS} from events, s where not (value < lo or value > hi)")
def o3(spark, sf):
    return outliers.remove_outliers(table(spark, sf, "events"), "value", "iqr")


@query("o3_flag_outliers", f"with {FENCES} select event_id, value < lo or value > hi as outlier from events, s")
def o3_flag(spark, sf):
    return outliers.flag_outliers(table(spark, sf, "events"), "value").select("event_id", "outlier")


@query("o4_cap_outliers", f"with {FENCES} select event_id, round(least(greatest(value, lo), hi), 4) as value from events, s")
def o4(spark, sf):
    capped = outliers.cap_outliers(table(spark, sf, "events"), "value", "iqr")
    return capped.select("event_id", F.round("value", 4).alias("value"))


@query("o4_cap_outliers_zscore", f"""
with {MOMENTS} select event_id, round(least(greatest(value, mean - 2 * std), mean + 2 * std), 4) as value from events, s""")
def o4_z(spark, sf):
    capped = outliers.cap_outliers(table(spark, sf, "events"), "value", "zscore", 2.0)
    return capped.select("event_id", F.round("value", 4).alias("value"))


@query("o5_box_stats", f"""
with {FENCES} select round(min(value), 4) as min, round(min(case when value between lo and hi then value end), 4) as whisker_low,
  round(q1, 4) as q1, round(q2, 4) as median, round(q3, 4) as q3,
  round(max(case when value between lo and hi then value end), 4) as whisker_high, round(max(value), 4) as max,
  count(case when value < lo or value > hi then 1 end) as outliers
from events, s group by q1, q2, q3""")
def o5(spark, sf):
    out = outliers.box_stats(table(spark, sf, "events"), "value")
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns if c != "outliers"], "outliers")


# The LCS of every pair of different names, cell by cell: k runs over the cells, a row per step.
def pairs(name: str, key: str, source: str) -> str:
    return f"""
with recursive v as (select {name} as s, min({key}) as id from {source} group by {name}),
p as (select a.id as ka, a.s as va, b.id as kb, b.s as vb, length(a.s) as la, length(b.s) as lb
      from v a join v b on a.id < b.id),
w(ka, kb, i, prev) as (
  select ka, kb, 0, list_transform(range(lb + 1), lambda x: 0) from p
  union all
  select w.ka, w.kb, w.i + 1,
    list_reduce(list_prepend([0], list_transform(range(1, lb + 1), lambda j: [j])),
      lambda acc, x: list_append(acc, case when substr(va, w.i + 1, 1) = substr(vb, x[1], 1)
        then w.prev[x[1]] + 1 else greatest(w.prev[x[1] + 1], acc[x[1]]) end))
  from w join p on w.ka = p.ka and w.kb = p.kb where w.i < la),
scored as (
  select p.ka, p.va, p.kb, p.vb, cast(round_even(200.0 * w.prev[lb + 1] / (la + lb), 0) as integer) as score
  from w join p on w.ka = p.ka and w.kb = p.kb and w.i = p.la)"""


def _pairs(threshold: int):
    def run(spark, sf):
        return fuzzy.fuzzy_pairs(table(spark, sf, "part"), "p_name", "p_partkey", threshold)
    return run


for _t in (70, 80, 90):
    query(f"f1_fuzzy_pairs_{_t}", pairs("p_name", "p_partkey", "part") + f"""
select ka as key_a, va as value_a, kb as key_b, vb as value_b, score from scored where score >= {_t}""")(_pairs(_t))


@query("f1_fuzzy_pairs_supplier", pairs("s_name", "s_suppkey", "supplier") + """
select ka as key_a, va as value_a, kb as key_b, vb as value_b, score from scored where score >= 94""")
def f1_supplier(spark, sf):
    return fuzzy.fuzzy_pairs(table(spark, sf, "supplier"), "s_name", "s_suppkey", 94)


# Values in key order: the first without a similar leader before it leads, others follow the first such leader.
def groups(name: str, key: str, source: str, threshold: int) -> str:
    return pairs(name, key, source) + f""",
ordered as (select id, s, row_number() over (order by id) as position from v),
near as (select kb as id, list(ka) as ids from scored where score >= {threshold} group by kb),
walk(position, leaders, id, leader) as (
  select cast(0 as bigint), cast([] as bigint[]), cast(null as bigint), cast(null as bigint)
  union all
  select o.position, case when list_has_any(coalesce(n.ids, []), w.leaders) then w.leaders else list_append(w.leaders, o.id) end,
    o.id, coalesce(list_min(list_intersect(n.ids, w.leaders)), o.id)
  from walk w join ordered o on o.position = w.position + 1 left join near n on n.id = o.id),
led as (
  select w.leader, t.{key} as key, t.{name} as value
  from walk w join ordered o on o.id = w.id join {source} t on t.{name} = o.s),
numbered as (
  select leader, row_number() over (order by leader) as "group" from led group by leader having count(*) > 1)"""


@query("f2_fuzzy_groups", groups("p_name", "p_partkey", "part", 90) + """
select "group", leader, key, value from led join numbered using (leader)""")
def f2(spark, sf):
    return fuzzy.fuzzy_groups(table(spark, sf, "part"), "p_name", "p_partkey", 90)


@query("f3_fuzzy_summary", groups("p_name", "p_partkey", "part", 80) + """
select count(distinct "group") as groups, count(*) as rows, count(*) / count(distinct "group") as average_size
from led join numbered using (leader)""")
def f3(spark, sf):
    return fuzzy.fuzzy_summary(fuzzy.fuzzy_groups(table(spark, sf, "part"), "p_name", "p_partkey", 80))


def _forest(spark, sf):
    events = table(spark, sf, "events")
    return anomalies.isolation_forest(events, ["value", "user_id"], ["event_id"], 0.05)


@query("a1_isolation_forest")
def a1(spark, sf):
    return _forest(spark, sf)


@query("a2_anomaly_summary")
def a2(spark, sf):
    return anomalies.anomaly_summary(_forest(spark, sf))


@query("a3_plot_sample")
def a3(spark, sf):
    return anomalies.plot_sample(_forest(spark, sf), ["event_id"])


@query("a4_remove_anomalies")
def a4(spark, sf):
    return anomalies.remove_anomalies(table(spark, sf, "events"), _forest(spark, sf), ["event_id"])


@query("f2_fuzzy_groups_names")
def f2_names(spark, sf):
    """All names of customers, each much like most others."""
    return fuzzy.fuzzy_groups(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_name", "c_custkey", 90)


def _far(spark, sf):
    """Events with a verdict given by a rule, in place of a forest's."""
    return table(spark, sf, "events").select("event_id", "value", (F.col("value") > 150).alias("anomaly"))


FAR = "with r as (select event_id, value, value > 150 as anomaly from events)"


@query("a2_anomaly_summary_rule", f"""
{FAR} select count_if(anomaly)::bigint as anomalies, count(*) as scanned, round(count_if(anomaly) * 100.0::double / count(*), 6) as rate from r""")
def a2_rule(spark, sf):
    return anomalies.anomaly_summary(_far(spark, sf)).withColumn("rate", F.round("rate", 6))


@query("a3_plot_sample_rule", f"""
{FAR} select * from r where anomaly union all
select * from (select * from r where not anomaly order by {key_hash_sql(42, 'event_id')}, event_id limit 5000)""")
def a3_rule(spark, sf):
    return anomalies.plot_sample(_far(spark, sf), ["event_id"])


@query("a4_remove_anomalies_rule", "select * from events where not coalesce(value > 150, false)")
def a4_rule(spark, sf):
    return anomalies.remove_anomalies(table(spark, sf, "events"), _far(spark, sf), ["event_id"])
