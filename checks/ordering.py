"""Order-dependent fills, time grids and decomposition."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import BASE_ORDERS, base_orders, query, table
from scrubline.operators import ordered, timeseries

B = f"b as ({BASE_ORDERS})"
W = "over (order by o_orderkey rows between unbounded preceding and current row)"
A = "over (order by o_orderkey rows between current row and unbounded following)"


@query("c6_ffill", f"with {B} select o_orderkey, last_value(price ignore nulls) {W} as price from b")
def c6(spark, sf):
    return ordered.ffill(base_orders(spark, sf).select("o_orderkey", "price"), "price", ["o_orderkey"])


@query("c6_ffill_split", f"with {B} select o_orderkey, last_value(status ignore nulls) {W} as status from b")
def c6_split(spark, sf):
    return ordered.ffill(base_orders(spark, sf).select("o_orderkey", "status"), "status", ["o_orderkey"], ranges=16)


@query("c7_bfill", f"with {B} select o_orderkey, first_value(price ignore nulls) {A} as price from b")
def c7(spark, sf):
    return ordered.bfill(base_orders(spark, sf).select("o_orderkey", "price"), "price", ["o_orderkey"], ranges=16)


# gaps in a conversation: a speaker named on the first and every third turn


@query("c6_ffill_partitioned", """
with t as (select conv_id, turn, case when turn % 3 = 0 then role end as role from conversations)
select conv_id, turn, last_value(role ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) as role from t""")
def c6_part(spark, sf):
    talk = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.col("role")).alias("role"))
    return ordered.ffill(talk, "role", ["turn"], ["conv_id"], ranges=8)


@query("c7_bfill_partitioned", """
with t as (select conv_id, turn, case when turn % 3 = 1 then role end as role from conversations)
select conv_id, turn, first_value(role ignore nulls) over (partition by conv_id order by turn rows between current row and unbounded following) as role from t""")
def c7_part(spark, sf):
    talk = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 1, F.col("role")).alias("role"))
    return ordered.bfill(talk, "role", ["turn"], ["conv_id"])


INTERPOLATED = f"""
n as (select *, row_number() over (order by o_orderkey) as rn from b),
k as (select *, last_value(price ignore nulls) {W} as pv, last_value(case when price is not null then rn end ignore nulls) {W} as pp,
        first_value(price ignore nulls) {A} as nv, first_value(case when price is not null then rn end ignore nulls) {A} as np from n)
select o_orderkey, round(case when price is not null then price when pv is null then null when nv is null then pv
  else pv + (nv - pv) * (rn - pp) / (np - pp) end, 4) as price from k"""


def _interpolated(ranges):
    def run(spark, sf):
        data = base_orders(spark, sf).select("o_orderkey", "price")
        return ordered.interpolate(data, "price", ["o_orderkey"], ranges=ranges).withColumn("price", F.round("price", 4))
    return run


query("c8_interpolate", f"with {B}, {INTERPOLATED}")(_interpolated(None))
query("c8_interpolate_split", f"with {B}, {INTERPOLATED}")(_interpolated(16))


@query("row_numbers", "select o_orderkey, o_orderdate, row_number() over (order by o_orderdate, o_orderkey) as row_number from orders")
def numbers(spark, sf):
    return ordered.number_rows(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], ranges=16)


@query("v5_trend", "select * from events where ts is not null and value is not null")
def v5(spark, sf):
    return timeseries.trend(table(spark, sf, "events"), "ts", "value")


# order totals per day on a dense grid of days, gaps interpolated
DAILY = """
t as (select o_orderdate as date, sum(o_totalprice) as value from orders group by o_orderdate),
g as (select cast(range as timestamp) as date, row_number() over (order by range) - 1 as position
      from range((select min(date) from t), (select max(date) from t) + interval 1 day, interval 1 day)),
j as (select g.position, g.date, t.value from g left join t on g.date = t.date),
k as (select *, last_value(value ignore nulls) over p as pv, last_value(case when value is not null then position end ignore nulls) over p as pp,
        first_value(value ignore nulls) over f as nv, first_value(case when value is not null then position end ignore nulls) over f as np
      from j window p as (order by position rows between unbounded preceding and current row),
                    f as (order by position rows between current row and unbounded following)),
daily as (select position, date, case when value is not null then value else pv + (nv - pv) * (position - pp) / (np - pp) end as value from k)"""


@query("v6_regularize_daily", f"with {DAILY} select position, date, round(value, 4) as value from daily")
def v6(spark, sf):
    daily = timeseries.regularize(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", agg="sum")
    return daily.withColumn("value", F.round("value", 4))


def _decompose_sql(period: int, daily: str, digits: int) -> str:
    half = period // 2
    if period % 2:
        mean = f"sum(value) over (order by position rows between {half} preceding and {half} following) / {period}"
    else:
        mean = (f"(sum(value) over (order by position rows between {half} preceding and {half - 1} following)"
                f" + sum(value) over (order by position rows between {half - 1} preceding and {half} following)) / {2 * period}")
    parts = ", ".join(f"round({x}, {digits}) as {n}" for x, n in (
        ("value", "value"), ("trend", "trend"), ("seasonal", "seasonal"), ("value - trend - seasonal", "residual")))
    return f"""
with {daily},
m as (select *, case when count(*) over (order by position rows between {half} preceding and {half} following) = {2 * half + 1}
        then {mean} end as trend from daily),
a as (select position % {period} as phase, avg(value - trend) as mean from m where trend is not null group by 1),
s as (select phase, mean - (select avg(mean) from a) as seasonal from a)
select date, {parts} from m join s on m.position % {period} = s.phase"""


def _decompose(period: int, agg: str, digits: int):
    def run(spark, sf):
        out = timeseries.decompose(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", period, agg=agg, block=500)
        return out.select("date", *[F.round(c, digits).alias(c) for c in ("value", "trend", "seasonal", "residual")])
    return run


query("decompose_orders", _decompose_sql(7, DAILY, 4))(_decompose(7, "sum", 4))
# the number of orders per day, with a period of even length
COUNTS = DAILY.replace("sum(o_totalprice)", "cast(count(*) as double)")
query("decompose_orders_even", _decompose_sql(12, COUNTS, 8))(_decompose(12, "count", 8))


@query("v6_monthly_orders", """
select cast(row_number() over (order by m) - 1 as bigint) as position, m as date, v as value
from (select cast(date_trunc('month', o_orderdate) as timestamp) as m, cast(count(*) as double) as v from orders group by 1)""")
def v6_monthly(spark, sf):
    monthly = table(spark, sf, "orders").select(
        F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month"), F.lit(1).alias("one"))
    return timeseries.regularize(monthly, "month", "one", agg="count")


@query("v6_grid_losses", """
with s as (select distinct epoch_us(ts) as u from events where value is not null)
select count(*) as points, count_if((u - (select min(u) from s)) % 86400000000 <> 0)::bigint as off_grid from s""")
def v6_losses(spark, sf):
    return timeseries.grid_losses(table(spark, sf, "events"), "ts", "value", agg="sum")
