"""Converters, catalogue and sinks over lines and files made of the general tables; distribution functions."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from quantloom.functions import distributions as D
from quantloom.operators import bars as B
from quantloom.operators import lineage, store
from quantloom.plans import _inputs as I
from quantloom.plans import _sql as Q
from quantloom.plans._registry import Registry
from quantloom.sources import market

query = Registry()

_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _catalog(spark, d):
    """The tables' folder as a category of a symbol catalogue."""
    root, category = d.rstrip("/").rsplit("/", 1)
    return market.catalog(spark, root).where(F.col("category") == category)


@query("sc4_catalog_search", "select upper(t) as symbol from (select unnest([" + ", ".join(f"'{t}'" for t in _TABLES) + "]) as t) where upper(t) like '%EN%'")
def sc4(spark, d):
    return market.search(_catalog(spark, d), "en").select(F.upper("symbol").alias("symbol"))


@query("sc7_first_category", """with f as (select distinct case c_custkey % 5 when 0 then 'crypto' when 1 then 'stocks' when 2 then 'etf' when 3 then 'futures' else 'indices' end as category, c_mktsegment || '-' || c_nationkey as symbol from customer)
  select symbol, arg_min(category, case category when 'etf' then 1 when 'stocks' then 2 when 'futures' then 3 when 'indices' then 4 end) as category from f where category <> 'crypto' group by 1""")
def sc7(spark, d):
    """The files of a catalogue that the customers name: a segment and nation is a symbol."""
    category = F.element_at(F.array(*[F.lit(c) for c in ("crypto", "stocks", "etf", "futures", "indices")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    symbol = F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string"))
    files = I.table(spark, d, "customer").select(category.alias("category"), symbol.alias("symbol")).distinct()
    return market.resolve(files.withColumn("path", F.concat_ws("/", "category", "symbol"))).select("symbol", "category")


_LINE = "o_orderkey % 11"


@query("sc10_bar_lines", f"""with o as (select *, {_LINE} as k from orders)
  select o_orderpriority as symbol, o_orderdate as ts, round(o_totalprice, 4) as open, round(o_totalprice + 1, 4) as high, case when k = 1 then null else round(o_totalprice - 1, 4) end as low, round(o_totalprice, 4) as close,
   case when k = 2 then 0 else o_custkey end::bigint as volume from o where k not in (3, 4)""")
def sc10(spark, d):
    """Some lines have a price that cannot be read (1), no volume (2), no time (3) or too few fields (4)."""
    k = F.col("o_orderkey") % 11
    text = lambda c: F.format_string("%.4f", c)
    price = F.col("o_totalprice")
    low = F.when(k == 1, F.lit("n/a")).otherwise(text(price - 1))
    time = F.when(k == 3, F.lit("no time")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    volume = F.when(k != 2, F.col("o_custkey").cast("string"))
    line = F.when(k == 4, F.concat_ws(",", time, text(price))).otherwise(F.concat_ws(",", time, text(price), text(price + 1), low, text(price), volume))
    lines = I.table(spark, d, "orders").select(F.col("o_orderpriority").alias("symbol"), line.alias("value"))
    got = market.bar_lines(lines)
    return got.select("symbol", "ts", *[F.round(F.nanvl(c, F.lit(None).cast("double")), 4).alias(c) for c in ("open", "high", "low", "close")], "volume")


@query("sc11_quote_lines", f"""with {I.CHAIN} select symbol, cast(ts as date) as date, round(strike, 2) as strike, expiration, option_type, round(bid, 2) as bid, round(ask, 2) as ask, round(delta, 2) as delta from quotes where id % 13 <> 5""")
def sc11(spark, d):
    """Lines of too few fields (id % 13 = 5) are left out."""
    two = lambda c: F.format_string("%.2f", F.col(c))
    zero = F.lit("0")
    fields = [F.to_date("ts").cast("string"), two("strike"), F.col("expiration").cast("string"), F.col("option_type"), zero, two("bid"), two("ask"), *[zero] * 4, two("delta"), *[zero] * 4]
    line = F.when(F.col("id") % 13 == 5, F.lit("2024-01-01,1")).otherwise(F.concat_ws(",", *fields))
    got = market.quote_lines(I.chain(spark, d).select("symbol", line.alias("value")))
    return got.select("symbol", "date", "strike", "expiration", "option_type", "bid", "ask", "delta")


@query("sc13_corporate_actions", """with l as (select o_orderpriority as symbol, cast(o_orderdate as date) as date, o_orderkey % 5 - 1 as ratio from orders where o_orderkey % 7 <> 3)
  select upper(symbol) as symbol, date, max(ratio)::double as ratio from (select symbol, date, ratio from l where ratio > 0 qualify count(distinct ratio) over (partition by symbol, date) = 1) group by 1, 2""")
def sc13(spark, d):
    """Numbers at or below 0 and unreadable dates (key % 7 = 3) are left out; of days with several numbers none is compared."""
    date = F.when(F.col("o_orderkey") % 7 == 3, F.lit("2024-13-45")).otherwise(F.to_date("o_orderdate").cast("string"))
    ratio = F.col("o_orderkey") % 5 - 1
    lines = I.table(spark, d, "orders").select("o_orderpriority", "o_orderdate", ratio.alias("ratio"), date.alias("date"), F.concat_ws(",", F.lower("o_orderpriority"), date, ratio.cast("string")).alias("value"))
    plain = lines.where("ratio > 0").groupBy(F.upper("o_orderpriority").alias("symbol"), F.expr("try_cast(date as date)").alias("date")).agg(F.countDistinct("ratio").alias("k")).where("k = 1").drop("k")
    return market.corporate_actions(lines.select("value"), "ratio").join(plain, ["symbol", "date"], "left_semi")


@query("sc14_run_store", """select o_orderpriority as symbol, count(*)::bigint as runs, round(sum(o_totalprice), 2) as total from (select * from orders where o_orderkey % 2 = 0 union all select * from orders where o_orderkey % 3 = 0) group by 1""")
def sc14(spark, d):
    """Two appends to a stored table of runs, read back."""
    path = f"{lineage.folder(spark)}/runs-{uuid.uuid4().hex}"
    runs = I.table(spark, d, "orders").select(F.col("o_orderpriority").alias("symbol"), "o_orderkey", "o_totalprice")
    for part in (2, 3):
        store.append(runs.where(F.col("o_orderkey") % part == 0), path)
    got = lineage.cut(spark.read.parquet(path).groupBy("symbol").agg(F.count("*").alias("runs"), F.round(F.sum("o_totalprice"), 2).alias("total")))
    lineage.delete(spark, path)
    return got


@query("x10_bars_a_year", "select * from (values " + ", ".join(f"('{k}', {v!r}::double, {B.SIM_BARS_PER_YEAR.get(k, 'null')}::double)" for k, v in B.BARS_PER_YEAR.items()) + ") t(interval, analysis, simulator)")
def x10(spark, d):
    return spark.createDataFrame([(k, v, B.SIM_BARS_PER_YEAR.get(k)) for k, v in B.BARS_PER_YEAR.items()], "interval string, analysis double, simulator double")


@pandas_udf(DoubleType())
def _normal(z: pd.Series) -> pd.Series:
    return pd.Series(D.normal_cdf(z.to_numpy(float)))


@pandas_udf(DoubleType())
def _t(t: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(D.t_two_sided(t.to_numpy(float), n.to_numpy(float)))


@pandas_udf(DoubleType())
def _f2(f: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(D.f_upper(f.to_numpy(float), n.to_numpy(float) * 0 + 2, n.to_numpy(float)))


@pandas_udf(DoubleType())
def _chi2(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([D.chi2_upper(a, b) for a, b in zip(x, k, strict=True)])


@query("x11_distributions", f"""with v as (select s_suppkey, s_acctbal / 2500 as z, 3 + s_suppkey % 40 as n from supplier)
  select s_suppkey, round({Q.normal_cdf("z")}, 6) as normal, round({Q.t_two_sided("z", "n")}, 6) as t, round(pow(1 + 2 * abs(z) / n, -n / 2.0), 6) as f, round(exp(-abs(z) / 2), 6) as chi2 from v""")
def x11(spark, d):
    """The normal, t, F (2 and n degrees) and chi-square (2 degrees) functions; the last two have closed forms."""
    v = I.table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 2500).alias("z"), (3 + F.col("s_suppkey") % 40).cast("double").alias("n"))
    round6 = lambda c, name: F.round(c, 6).alias(name)
    return v.select("s_suppkey", round6(_normal("z"), "normal"), round6(_t("z", "n"), "t"), round6(_f2(F.abs("z"), "n"), "f"), round6(_chi2(F.abs("z"), F.lit(2.0)), "chi2"))
