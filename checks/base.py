"""Registry of checked queries, and the inputs several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL giving the same rows where SQL can express them."""
    def add(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Orders with missing values, numbers and dates kept as text. The same text runs in both engines.
BASE_ORDERS = """
  select o_orderkey,
    case when o_orderkey % 7  = 0 then null else o_totalprice    end as price,
    case when o_orderkey % 11 = 0 then null else o_orderpriority end as priority,
    case when o_orderkey % 2  = 0 then null else o_orderstatus   end as status,
    cast(o_custkey as string) as cust_text,
    case when o_orderkey % 13 = 0 then null
         else substr(cast(o_orderdate as string), 1, 10) end as order_date
  from orders"""

# All of these rows, and a second copy of some of them.
DIRTY_ORDERS = f"with base as ({BASE_ORDERS}) select * from base union all select * from base where o_orderkey % 50 = 0"

# Join inputs with missing keys, and rows without a partner on both sides.
LEFT_KEYS = "select case when n_nationkey % 5 = 0 then null else n_nationkey end as k, n_name as v from nation"
RIGHT_KEYS = "select case when s_suppkey % 9 = 0 then null else s_nationkey + 3 end as j, s_name as v from supplier"


def key_hash_sql(seed: int, *keys: str) -> str:
    """What draws samples and splits, a number from 0 to 2^60 - 1."""
    parts = " || ':' || ".join([f"'{seed}'", *[f"cast({k} as varchar)" for k in keys]])
    return f"cast('0x' || substr(md5({parts}), 1, 15) as bigint)"


def derived(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    """A frame from SQL text that names the given tables."""
    for name in ("orders", "nation", "supplier", "conversations"):
        if name in sql:
            table(spark, sf, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def base_orders(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, BASE_ORDERS)


def dirty_orders(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, DIRTY_ORDERS)
