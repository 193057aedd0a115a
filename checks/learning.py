"""Forests: training, metrics, importances."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import dirty_orders, key_hash_sql, query, table
from checks.profiling import d
from scrubline.operators import forest

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("m1_infer_problem", """
select 'l_extendedprice' as target, count(distinct l_extendedprice) as distinct_values, case when count(distinct l_extendedprice) > 15 then 'regression' else 'classification' end as problem from lineitem
union all select 'l_linenumber', count(distinct l_linenumber), case when count(distinct l_linenumber) > 15 then 'regression' else 'classification' end from lineitem
union all select 'l_returnflag', count(distinct l_returnflag), 'classification' from lineitem""")
def m1(spark, sf):
    lines = table(spark, sf, "lineitem")
    out = None
    for c in ("l_extendedprice", "l_linenumber", "l_returnflag"):
        one = forest.problem_stats(lines, c).select(F.lit(c).alias("target"), "distinct_values", "problem")
        out = one if out is None else out.unionByName(one)
    return out


@query("m2_prepare_training", f"""
with {d()} select o_orderkey, priority, price from d where o_orderkey is not null and priority is not null and price is not null""")
def m2(spark, sf):
    return forest.prepare_training(dirty_orders(spark, sf), ["o_orderkey", "priority"], "price")


@query("m2_prepare_training_sample", f"""
select o_orderkey, o_orderpriority, o_totalprice from orders where o_orderpriority is not null and o_totalprice is not null
order by {key_hash_sql(42, 'o_orderkey')}, o_orderkey limit 20000""")
def m2_sample(spark, sf):
    return forest.prepare_training(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", ["o_orderkey"], 20_000)


@query("m3_one_hot", """
select o_orderkey, """ + ", ".join(
    f"case when o_orderpriority = '{p}' then 1.0::double else 0.0::double end as \"o_orderpriority_{p}\""
    for p in ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " from orders")
def m3(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.select("o_orderkey", *[x.alias(n) for n, x in forest.one_hot(orders, ["o_orderpriority"])])


@query("m4_split", f"""
select count_if({key_hash_sql(42, 'o_orderkey')} % 10000 >= 2000) as train_rows, count_if({key_hash_sql(42, 'o_orderkey')} % 10000 < 2000) as test_rows from orders""")
def m4(spark, sf):
    train, test = forest.split(table(spark, sf, "orders"), ["o_orderkey"])
    return train.agg(F.count("*").alias("train_rows"), test.agg(F.count("*")).scalar().alias("test_rows"))


def _regression(spark, sf):
    return forest.train_forest(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_returnflag"],
                               "l_extendedprice", LINE_KEY)


@query("m5_train_forest_regression")
def m5(spark, sf):
    return forest.regression_metrics(_regression(spark, sf).predictions)


@query("m6_train_forest_classification")
def m6(spark, sf):
    events = table(spark, sf, "events")
    trained = forest.train_forest(events, ["value", "user_id"], "event_type", ["event_id"])
    return forest.classification_metrics(trained.predictions, events, "event_type")


@query("m7_regression_metrics", """
with g as (select o_orderstatus, avg(o_totalprice) as p from orders group by o_orderstatus),
t as (select o_totalprice as actual, p as predicted from orders join g using (o_orderstatus))
select round(1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)), 4) as r2, round(avg(abs(actual - predicted)), 4) as mae,
  round(sqrt(avg((actual - predicted) ** 2)), 4) as rmse from t""")
def m7(spark, sf):
    orders = table(spark, sf, "orders")
    means = orders.groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("predicted"))
    out = forest.regression_metrics(orders.join(means, "o_orderstatus").select(F.col("o_totalprice").alias("actual"), "predicted"))
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


@query("m8_classification_metrics", """
select round(avg(case when l_linestatus = 'O' then 1.0 else 0.0 end), 6) as accuracy, count(distinct l_linestatus) as classes, count(*) as test_rows from lineitem""")
def m8(spark, sf):
    lines = table(spark, sf, "lineitem")
    guess = lines.select(F.col("l_linestatus").alias("actual"), F.lit("O").alias("predicted"))
    return forest.classification_metrics(guess, lines, "l_linestatus").withColumn("accuracy", F.round("accuracy", 6))


@query("m9_feature_importance")
def m9(spark, sf):
    return forest.feature_importance(_regression(spark, sf))


@query("m10_actual_vs_predicted")
def m10(spark, sf):
    return forest.actual_vs_predicted(_regression(spark, sf))


@query("m10_actual_vs_predicted_means", """
select o_orderkey, o_totalprice as actual, round(avg(o_totalprice) over (partition by o_orderstatus), 4) as predicted,
  min(o_totalprice) over () as line_low, max(o_totalprice) over () as line_high from orders""")
def m10_means(spark, sf):
    orders = table(spark, sf, "orders")
    means = orders.groupBy("o_orderstatus").agg(F.round(F.avg("o_totalprice"), 4).alias("predicted"))
    predictions = orders.join(means, "o_orderstatus").select("o_orderkey", F.col("o_totalprice").alias("actual"), "predicted")
    return forest.actual_vs_predicted(forest.Training("regression", [], [], predictions, None))
