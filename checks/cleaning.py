"""Missing values, columns, text and type conversion."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import dirty_orders, query, table
from checks.profiling import d
from scrubline.functions import convert, text
from scrubline.functions.classes import columns_of
from scrubline.operators import columns, missing
from scrubline.plans.recipe import Recipe

COLUMNS = "o_orderkey, price, priority, status, cust_text, order_date"


def _filled(column: str, value: str) -> str:
    kept = ", ".join(f"{value} as {c}" if c == column else c for c in COLUMNS.split(", "))
    return f"with {d()} select {kept} from d"


@query("c1_drop_null_rows", f"with {d()} select {COLUMNS} from d where price is not null")
def c1(spark, sf):
    return missing.drop_null_rows(dirty_orders(spark, sf), "price")


@query("c2_fill_mean", _filled("price", "round(coalesce(price, (select avg(price) from d)), 4)"))
def c2(spark, sf):
    return missing.fill_mean(dirty_orders(spark, sf), "price").withColumn("price", F.round("price", 4))


@query("c3_fill_median", _filled("price", "round(coalesce(price, (select median(price) from d)), 4)"))
def c3(spark, sf):
    return missing.fill_median(dirty_orders(spark, sf), "price").withColumn("price", F.round("price", 4))


@query("c4_fill_mode", _filled("priority", """coalesce(priority, (
  select priority from d where priority is not null group by priority order by count(*) desc, priority limit 1))"""))
def c4(spark, sf):
    return missing.fill_mode(dirty_orders(spark, sf), "priority")


@query("c5_fill_value", _filled("status", "coalesce(status, 'missing')"))
def c5(spark, sf):
    return missing.fill_value(dirty_orders(spark, sf), "status", "missing")


@query("c5_fill_value_number", _filled("price", "coalesce(price, 12.5)"))
def c5_number(spark, sf):
    return missing.fill_value(dirty_orders(spark, sf), "price", "12.5")


@query("c9_null_remaining", f"with {d()} select count(*) - count(status) as remaining from d")
def c9(spark, sf):
    filled = missing.fill_mode(dirty_orders(spark, sf), "priority")
    return missing.null_remaining(filled, "status")


@query("c10_rename_column", f"with {d()} select o_orderkey, price as amount, priority, status, cust_text, order_date from d")
def c10(spark, sf):
    return columns.rename_column(dirty_orders(spark, sf), "price", "amount")


@query("c11_drop_columns", f"with {d()} select o_orderkey, price, priority from d")
def c11(spark, sf):
    return columns.drop_columns(dirty_orders(spark, sf), ["status", "cust_text", "order_date"])


@query("c12_select_by_class", "select o_orderkey, o_custkey, o_totalprice from orders")
def c12(spark, sf):
    return columns.select_by_class(table(spark, sf, "orders"), "numeric")


@query("c12_class_lists", """
select 'numeric' as kind, 'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax' as names
union all select 'text', 'l_returnflag,l_linestatus' union all select 'datetime', 'l_shipdate'""")
def c12_lists(spark, sf):
    df = table(spark, sf, "lineitem")
    present = df.agg(F.count("*").alias("n")).where("n > 0")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(",".join(columns_of(df, k))).alias("names"))
                      for k in ("numeric", "text", "datetime")])
    return present.select(F.explode(kinds).alias("x")).select("x.*")


@query("c13_drop_duplicates", f"with {d()} select distinct {COLUMNS} from d")
def c13(spark, sf):
    return columns.drop_duplicates(dirty_orders(spark, sf))


@query("c14_predicates", f"""
with {d()} select o_orderkey, price, status from d
where price is null or (price < 1000 or price > 400000) and not status in ('F', 'P') or abs(price - 200000) < 50""")
def c14(spark, sf):
    price, status = F.col("price"), F.col("status")
    keep = price.isNull() | (((price < 1000) | (price > 400000)) & ~status.isin("F", "P")) | (F.abs(price - 200000) < 50)
    return dirty_orders(spark, sf).where(keep).select("o_orderkey", "price", "status")


@query("c16_recipe", f"""
with {d()} select o_orderkey, coalesce(price, 0) as amount, lower(priority) as priority, cast(cust_text as bigint) as cust_text, order_date
from d where order_date is not null""")
def c16(spark, sf):
    recipe = (Recipe().add("drop_null_rows", name="order_date").add("fill_value", name="price", value=0)
              .add("rename_column", old="price", new="amount").add("clean_text", name="priority", action="lower")
              .add("convert", name="cust_text", target="integer").add("drop_columns", names=["status"]))
    return recipe.apply(dirty_orders(spark, sf))


@query("c16_recipe_log", f"""
with {d()} select cast(1 as integer) as step, 'load' as action, printf('%s × 6', format('{{:,}}', count(*))) as shape from d
union all select 2, 'fill_mode', printf('%s × 6', format('{{:,}}', count(*))) from d
union all select 3, 'drop_duplicates', printf('%s × 6', format('{{:,}}', count(*))) from (select distinct * from d)""")
def c16_log(spark, sf):
    recipe = Recipe().add("fill_mode", name="priority").add("drop_duplicates")
    _, log = recipe.apply_logged(dirty_orders(spark, sf), count_rows=True)
    return log.select("step", "action", "shape")


# numbers as text, some padded, some unusable
NUMBER_TEXTS = """select event_id, case when event_id % 10 = 3 then 'x' || user_id
  when event_id % 10 = 5 then ' ' || cast(user_id as varchar) || ' '
  when event_id % 10 = 7 then cast(user_id as varchar) || '.0'
  when event_id % 10 = 8 then null when event_id % 10 = 9 then cast(user_id as varchar) || 'e2'
  else cast(user_id as varchar) end as v from events"""
NUMBERS = """select event_id, case when event_id % 10 in (3, 8) then null
  when event_id % 10 = 9 then user_id * 100 else user_id end as v from events"""


def number_texts(spark, sf):
    user = F.col("user_id").cast("string")
    last = F.col("event_id") % 10
    return table(spark, sf, "events").select(
        "event_id",
        F.when(last == 3, F.concat(F.lit("x"), user)).when(last == 5, F.concat(F.lit(" "), user, F.lit(" ")))
        .when(last == 7, F.concat(user, F.lit(".0"))).when(last == 8, F.lit(None))
        .when(last == 9, F.concat(user, F.lit("e2"))).otherwise(user).alias("v"))


@query("x1_to_integer", f"select event_id, cast(v as bigint) as v from ({NUMBERS})")
def x1(spark, sf):
    return convert.to_integer(number_texts(spark, sf), "v")


@query("x2_to_float", f"select event_id, cast(v as double) as v from ({NUMBERS})")
def x2(spark, sf):
    return convert.to_float(number_texts(spark, sf), "v")


@query("x3_to_string", """
select o_orderkey, cast(o_custkey as varchar) as o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders""")
def x3(spark, sf):
    return convert.to_text(table(spark, sf, "orders"), "o_custkey")


@query("x4_to_timestamp", f"""
with {d()} select o_orderkey, price, priority, status, cust_text, cast(try_strptime(order_date, '%Y-%m-%d') as timestamp) as order_date from d""")
def x4(spark, sf):
    return convert.to_timestamp(dirty_orders(spark, sf), "order_date")


@query("x4_to_timestamp_format", """
select o_orderkey, cast(try_strptime(strftime(o_orderdate, '%d.%m.%Y %H:%M'), '%d.%m.%Y %H:%M') as timestamp) as t from orders""")
def x4_format(spark, sf):
    texts = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy HH:mm").alias("t"))
    return convert.to_timestamp(texts, "t", "%d.%m.%Y %H:%M")


def _format_check(name: str, spark_pattern: str, fmt: str):
    """Dates written by one engine's pattern and read back by a strptime format, against the other engine's reading."""
    @query(f"x4_to_timestamp_{name}", f"select o_orderkey, cast(try_strptime(strftime(o_orderdate, '{fmt}'), '{fmt}') as timestamp) as t from orders")
    def run(spark, sf):
        texts = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", spark_pattern).alias("t"))
        return convert.to_timestamp(texts, "t", fmt)


for _check in [("compact", "ddMMyyyy", "%d%m%Y"), ("year2", "dd/MM/yy", "%d/%m/%y"), ("month_year", "yyyyMM", "%Y%m"), ("hour_minute", "HHmm", "%H%M"),
               ("compact_time", "yyyyMMddHHmmss", "%Y%m%d%H%M%S"), ("month_name", "MMMM d, yyyy", "%B %d, %Y"), ("weekday", "EEE, d MMM yyyy", "%a, %d %b %Y"), ("half_day", "yyyy-MM-dd hh:mm a", "%Y-%m-%d %I:%M %p"),
               ("day_of_year", "yyyy-DDD", "%Y-%j")]:
    _format_check(*_check)


@query("x4_to_timestamp_first_value", "select event_id, case when event_id % 4 <> 1 then date_trunc('day', ts) end as t from events")
def x4_first(spark, sf):
    day = F.date_format("ts", "yyyy-MM-dd")
    other = F.date_format("ts", "dd/MM/yyyy")
    texts = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 4 == 1, other).otherwise(day).alias("t"))
    return convert.to_timestamp(texts, "t", order_by=["event_id"])


@query("x4_to_timestamp_unit", "select event_id, date_trunc('second', ts) as t from events")
def x4_unit(spark, sf):
    numbers = table(spark, sf, "events").select(
        "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint").alias("t"))
    return convert.to_timestamp(numbers, "t", unit="s")


@query("x5_conversion_failures", "select count(case when event_id % 10 = 3 then 1 end) as failed from events")
def x5(spark, sf):
    before = number_texts(spark, sf)
    return convert.conversion_failures(before, convert.to_float(before, "v"), "v")


def _clean(action: str, source: str, key: str):
    def run(spark, sf):
        return text.clean_text(table(spark, sf, source).select(key, "text"), "text", action)
    return run


TITLE = "array_to_string(list_transform(regexp_extract_all(text, '(\\p{L}+|[^\\p{L}]+)', 0), lambda p: case when p[1] = 'ß' then 'Ss' else upper(p[1]) end || lower(p[2:])), '')"
# characters a Unicode-aware \s stands for
WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

for _name, _action, _sql in (
    ("x6_text_trim", "trim", rf"regexp_replace(text, '^{WS}+|{WS}+$', '', 'g')"),
    ("x7_text_lower", "lower", "lower(text)"),
    ("x8_text_upper", "upper", "upper(replace(text, 'ß', 'ss'))"),
    ("x9_text_title", "title", TITLE),
    ("x10_text_remove_special", "remove_special", rf"regexp_replace(text, '[^A-Za-z0-9{WS[1:-1]}]', '', 'g')"),
    ("x11_text_collapse_spaces", "collapse_spaces",
     rf"regexp_replace(regexp_replace(text, '{WS}+', ' ', 'g'), '^{WS}+|{WS}+$', '', 'g')"),
):
    query(_name, f"select doc_id, {_sql} as text from documents")(_clean(_action, "documents", "doc_id"))
    query(_name + "_benchmark", f"select item_id, {_sql} as text from benchmark")(_clean(_action, "benchmark", "item_id"))

PADDED = """select o_orderkey, repeat(' ', cast(o_orderkey % 3 as integer)) || replace(o_orderpriority, '-', '  ') || repeat(chr(9), cast(o_orderkey % 2 as integer)) as text from orders"""


@query("x11_text_collapse_padded", rf"""
select o_orderkey, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') as text from ({PADDED})""")
def x11_padded(spark, sf):
    key = F.col("o_orderkey")
    padded = table(spark, sf, "orders").select("o_orderkey", F.concat(
        F.repeat(F.lit(" "), (key % 3).cast("int")), F.replace("o_orderpriority", F.lit("-"), F.lit("  ")),
        F.repeat(F.lit("\t"), (key % 2).cast("int"))).alias("text"))
    return text.clean_text(padded, "text", "collapse_spaces")


@query("x12_find_replace", "select p_partkey, replace(p_name, 'red', 'RED') as p_name from part")
def x12(spark, sf):
    return text.find_replace(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "red", "RED")


@query("x12_find_replace_number", "select replace(cast(p_size as varchar), '1', 'one') as p_size, p_partkey from part")
def x12_number(spark, sf):
    return text.find_replace(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", "1", "one")


@query("x13_find_replace_regex", r"""
select page_id, regexp_replace(url, '^https?://([^/?#]+)', 'host=\1$', 'g') as url,
  regexp_replace(html, '<(/?)(\w+)[^>]*>', '[\1\2]', 'g') as html from pages""")
def x13(spark, sf):
    pages = table(spark, sf, "pages")
    hosts = text.find_replace(pages, "url", r"^https?://(?P<host>[^/?#]+)", r"host=\g<host>$", regex=True)
    return text.find_replace(hosts, "html", r"<(/?)(\w+)[^>]*>", r"[\1\2]", regex=True)


@query("x14_numeric_scalars", """
select event_id, round(abs(value - 50), 4) as distance, round(least(greatest(value, 10), 90), 4) as clipped, round(sqrt(abs(value)), 4) as root from events""")
def x14(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", F.round(F.abs(v - 50), 4).alias("distance"),
        F.round(F.least(F.greatest(v, F.lit(10.0)), F.lit(90.0)), 4).alias("clipped"), F.round(F.sqrt(F.abs(v)), 4).alias("root"))
