"""The general tables seen as market data, and the same views as DuckDB common table expressions.

ticks: events (symbol = event_type, price = value); daily bars: orders by day (symbol =
o_orderpriority, price = o_totalprice); option quotes: lineitem with part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import bars as B
from quantloom.operators import blocks as L


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, d: str) -> DataFrame:
    """One bar a tick: symbol, ts, id, open, high, low, close, volume."""
    price = F.col("value")
    return table(spark, d, "events").select(
        F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("id"), *[price.alias(c) for c in ("open", "high", "low", "close")], F.col("user_id").alias("volume")
    )


TICKS = "ticks as (select event_type as symbol, ts, event_id as id, value as price, user_id as volume from events)"


def trades(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("id"), *[price.alias(c) for c in ("open", "high", "low", "close")], F.lit(1).cast("long").alias("volume")
    )


def daily(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars: symbol, ts, open, high, low, close, adjclose, volume."""
    return B.resample(trades(spark, d), "daily", tie="id")


BARS = """bars as (
  select o_orderpriority as symbol, o_orderdate as ts, arg_min(o_totalprice, o_orderkey) as open, max(o_totalprice) as high,
         min(o_totalprice) as low, arg_max(o_totalprice, o_orderkey) as close, count(*)::bigint as volume
  from orders group by 1, 2)"""

RETURNS = BARS + """, returns as (
  select *, close / lag(close) over (partition by symbol order by ts) - 1 as ret,
         row_number() over (partition by symbol order by ts) as rn from bars)"""

#: Two of the symbols, side by side by date.
PAIR = RETURNS + """, pair as (
  select a.ts, a.close as a, b.close as b, a.ret as ra, b.ret as rb, row_number() over (order by a.ts) as rn
  from returns a join returns b on a.ts = b.ts and a.symbol = '1-URGENT' and b.symbol = '2-HIGH')"""


def pair(spark: SparkSession, d: str) -> DataFrame:
    """ts, a, b (closes), ra, rb (returns) of 1-URGENT and 2-HIGH."""
    r = L.in_blocks(daily(spark, d), B.returns, 1)
    side = lambda s, x: r.where(F.col("symbol") == s).select("ts", F.col("close").alias(x), F.col("ret").alias(f"r{x}"))
    return side("1-URGENT", "a").join(side("2-HIGH", "b"), "ts")


def chain(spark: SparkSession, d: str) -> DataFrame:
    """Option quotes: symbol, ts, expiration, option_type, strike, bid, ask, delta, id."""
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    sign = F.when(F.col("l_linestatus") == "O", 1.0).otherwise(-1.0)
    bid = F.floor(F.col("l_extendedprice") / F.col("l_quantity") + 0.5) / 100.0
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_returnflag").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        F.date_add(F.to_date("l_shipdate"), (7 + F.col("l_partkey") % 60).cast("int")).alias("expiration"),
        F.when(F.col("l_linestatus") == "O", "c").otherwise("p").alias("option_type"),
        F.floor(F.col("p_retailprice") / 5).cast("double").alias("strike"),
        bid.alias("bid"),
        (F.floor(bid * (1 + F.col("l_tax")) * 100 + 0.5) / 100.0).alias("ask"),
        F.round(sign * F.col("l_discount") * 10, 2).alias("delta"),
        (F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey") % 100000).alias("id"),
    )


CHAIN = """quotes as (
  select l_returnflag as symbol, l_shipdate as ts, cast(l_shipdate as date) + cast(7 + l_partkey % 60 as integer) as expiration,
         case when l_linestatus = 'O' then 'c' else 'p' end as option_type, floor(p_retailprice / 5) as strike,
         floor(l_extendedprice / l_quantity + 0.5) / 100 as bid,
         floor(floor(l_extendedprice / l_quantity + 0.5) / 100 * (1 + l_tax) * 100 + 0.5) / 100 as ask,
         round((case when l_linestatus = 'O' then 1.0 else -1.0 end) * l_discount * 10, 2) as delta,
         l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey % 100000 as id
  from lineitem join part on l_partkey = p_partkey)"""


def splits(spark: SparkSession, d: str) -> DataFrame:
    """A split on each day on which a symbol's price passes 250."""
    days = table(spark, d, "events").groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("date")).agg((2 + F.max("event_id") % 3).cast("double").alias("ratio"), F.max("value").alias("top"))
    return days.where("top > 250").drop("top")


def dividends(spark: SparkSession, d: str) -> DataFrame:
    """A dividend every day, of the day's lowest price."""
    return table(spark, d, "events").groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("date")).agg(F.min("value").alias("amount"))


ACTIONS = """splits as (select event_type as symbol, cast(ts as date) as date, cast(2 + max(event_id) % 3 as double) as ratio
  from events group by 1, 2 having max(value) > 250),
dividends as (select event_type as symbol, cast(ts as date) as date, min(value) as amount from events group by 1, 2)"""


def day_closes(spark: SparkSession, d: str) -> DataFrame:
    return B.resample(ticks(spark, d), "daily", tie="id").select("symbol", F.to_date("ts").alias("date"), "close")


DAY_CLOSES = "day_closes as (select event_type as symbol, cast(ts as date) as date, arg_max(value, ts) as close from events group by 1, 2)"
