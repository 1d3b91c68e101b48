"""Scans, resampling, seasonality, alignment, as-of lookups, adjustments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.operators import bars as B
from quantloom.operators import seasonality as S
from quantloom.plans import _inputs as I
from quantloom.plans._registry import Registry

query = Registry()
R6 = lambda c, n=6: F.round(F.col(c) if isinstance(c, str) else c, n)


@query("sc1_clean_scan", """select event_type as symbol, ts, value as close from events
  where value > 0 and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-13'""")
def sc1(spark, d):
    return B.between(B.clean(I.ticks(spark, d)), "2024-01-05", "2024-01-12").select("symbol", "ts", "close")


@query("sc2_chain_scan", """select l_orderkey, cast(l_shipdate as date) + interval '15 hours 59 minutes' as ts, l_extendedprice as bid
  from lineitem where cast(l_shipdate as date) between date '1997-01-01' and date '1997-03-31'""")
def sc2(spark, d):
    from quantloom.sources.market import quote_time

    rows = I.table(spark, d, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("bid"))
    return quote_time(rows, "1997-01-01", "1997-03-31").select("l_orderkey", "ts", "bid")


@query("sc3_price_query_tail", f"""with {I.TICKS}, r as (
  select symbol, min(ts) as ts, arg_min(price, ts) as open, max(price) as high, min(price) as low, arg_max(price, ts) as close, sum(volume)::bigint as volume
  from ticks t where ts >= (select max(ts) from ticks m where m.symbol = t.symbol) - interval 7 day
  group by symbol, date_trunc('hour', ts))
  select * from r qualify row_number() over (partition by symbol order by ts desc) <= 20""")
def sc3(spark, d):
    return B.price_query(I.ticks(spark, d), "1h", limit=20, tail=True, tie="id").drop("adjclose")


@query("sc5_distinct_symbols", "select distinct o_orderpriority as symbol from orders")
def sc5(spark, d):
    return I.trades(spark, d).select("symbol").distinct()


@query("sc6_date_range", "select min(ts) as first, max(ts) as last from events")
def sc6(spark, d):
    return I.ticks(spark, d).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))


def _resample_sql(bucket: str) -> str:
    return f"""with {I.TICKS} select symbol, min(ts) as ts, arg_min(price, ts) as open, max(price) as high, min(price) as low,
  arg_max(price, ts) as close, arg_max(price, ts) as adjclose, sum(volume)::bigint as volume from ticks group by symbol, {bucket}"""


for _name, _bucket in {
    "5m": "time_bucket(interval 5 minute, ts)",
    "30m": "time_bucket(interval 30 minute, ts)",
    "1h": "date_trunc('hour', ts)",
    "4h": "date_trunc('day', ts), hour(ts) // 4",
    "daily": "date_trunc('day', ts)",
    "weekly": "date_trunc('week', ts)",
    "monthly": "date_trunc('month', ts)",
}.items():
    query(f"a1_resample_{_name}", _resample_sql(_bucket))(lambda spark, d, n=_name: B.resample(I.ticks(spark, d), n, tie="id"))


@query("a1_resample_of_bars", f"""with {I.TICKS}, hours as (select symbol, min(ts) as ts, arg_min(price, ts) as open, max(price) as high, min(price) as low,
  arg_max(price, ts) as close, sum(volume)::bigint as volume from ticks group by symbol, date_trunc('hour', ts))
  select symbol, min(ts) as ts, arg_min(open, ts) as open, max(high) as high, min(low) as low, arg_max(close, ts) as close, sum(volume)::bigint as volume
  from hours group by symbol, date_trunc('week', ts)""")
def a1_twice(spark, d):
    return B.resample(B.resample(I.ticks(spark, d), "1h", tie="id"), "weekly").drop("adjclose")


_SEASON = {
    "day_of_week": "isodow(ts)",
    "month": "month(ts)",
    "quarter": "quarter(ts)",
    "year": "year(ts)",
}
for _by, _key in _SEASON.items():
    query(
        "a2_seasonality_weekday" if _by == "day_of_week" else f"a2_seasonality_{_by}",
        f"""with {I.RETURNS}, s as (select symbol, {_key} as bucket, ret * 100 as v from returns where ret is not null)
  select symbol, bucket::int as bucket, count(*)::bigint as n, round(avg(v), 5) as mean, round(median(v), 5) as median, round(coalesce(stddev_samp(v), 0), 5) as std,
         round(min(v), 5) as min, round(max(v), 5) as max, round(sum(v), 3) as total, round(100.0 * avg(case when v > 0 then 1.0 else 0.0 end), 5) as positive_pct,
         case when count(*) >= 2 and stddev_samp(v) > 0 then round(avg(v) / (stddev_samp(v) / sqrt(count(*))), 5) end as t, count(*) < 20 as few
  from s group by symbol, 2""",
    )(lambda spark, d, by=_by: S.rounded(S.aggregate(I.daily(spark, d), by, "return")))

query(
    "a2_seasonality_hour_volume",
    f"""with {I.TICKS}, h as (select symbol, min(ts) as ts, sum(volume)::bigint as volume from ticks group by symbol, date_trunc('hour', ts)),
  s as (select symbol, hour(ts) as bucket, volume::double as v from h)
  select symbol, bucket::int as bucket, count(*)::bigint as n, round(avg(v), 5) as mean, round(median(v), 5) as median, round(coalesce(stddev_samp(v), 0), 5) as std,
         round(min(v), 5) as min, round(max(v), 5) as max, round(sum(v), 3) as total, round(100.0 * avg(case when v > 0 then 1.0 else 0.0 end), 5) as positive_pct,
         null::double as t, count(*) < 20 as few
  from s group by symbol, 2""",
)(lambda spark, d: S.rounded(S.aggregate(B.resample(I.ticks(spark, d), "1h", tie="id"), "hour_of_day", "volume")))


@query("w1_returns", f"""with {I.BARS} select symbol, ts, round(close / lag(close) over w - 1, 6) as ret, round(open / lag(close) over w - 1, 6) as gap,
  round((high - low) / low, 6) as range from bars window w as (partition by symbol order by ts)""")
def w1(spark, d):
    return B.returns(I.daily(spark, d)).select("symbol", "ts", R6("ret").alias("ret"), R6("gap").alias("gap"), R6("range").alias("range"))


@query("j3_align_by_date", f"with {I.BARS} select a.ts, a.close as a, b.close as b from bars a join bars b using (ts) where a.symbol = '1-URGENT' and b.symbol = '5-LOW'")
def j3(spark, d):
    bars = I.daily(spark, d)
    return B.align_by_date(bars.where("symbol = '1-URGENT'"), bars.where("symbol = '5-LOW'"))


@query("j4_align_tail", f"""with {I.RETURNS}, n as (select symbol, ret, row_number() over (partition by symbol order by ts desc) - 1 as back from returns where ret is not null)
  select a.back::int as back, round(a.ret, 6) as one, round(b.ret, 6) as two, round(c.ret, 6) as three
  from n a join n b using (back) join n c using (back) where a.symbol = '1-URGENT' and b.symbol = '2-HIGH' and c.symbol = '5-LOW'""")
def j4(spark, d):
    wide = B.align_tail(B.returns(I.daily(spark, d)), ["1-URGENT", "2-HIGH", "5-LOW"])
    return wide.select("back", R6(F.col("`1-URGENT`")).alias("one"), R6(F.col("`2-HIGH`")).alias("two"), R6(F.col("`5-LOW`")).alias("three"))


@query("j5_asof_cross_symbol", """with p as (select ts, value from events where event_type = 'purchase'), c as (select ts, value from events where event_type = 'click'),
  f as (select arg_min(value, ts) as v from c)
  select p.ts, p.value as price, coalesce(c.value, (select v from f)) as cross_price from p asof left join c on p.ts >= c.ts""")
def j5(spark, d):
    t = I.ticks(spark, d)
    left = t.where("symbol = 'purchase'").select(F.lit(1).alias("k"), "ts", F.col("close").alias("price"))
    right = t.where("symbol = 'click'").select(F.lit(1).alias("k"), "ts", "close")
    return B.asof_join(left, right, ["k"], ["close"], backfill=True).select("ts", "price", F.col("close").alias("cross_price"))


@query("j7_asof_close", f"""with {I.BARS}, q as (select distinct l_shipdate as ts from lineitem)
  select q.ts, b.close from q asof join (select * from bars where symbol = '3-MEDIUM') b on q.ts >= b.ts""")
def j7(spark, d):
    days = I.table(spark, d, "lineitem").select(F.lit("3-MEDIUM").alias("symbol"), F.col("l_shipdate").alias("ts")).distinct()
    return B.asof_join(days, I.daily(spark, d).select("symbol", "ts", "close"), ["symbol"], ["close"]).where("close is not null").select("ts", "close")


@query("j9_prior_close", f"""with {I.ACTIONS}, {I.DAY_CLOSES} select d.symbol, d.date, d.amount, c.close as prior
  from dividends d asof left join day_closes c on d.symbol = c.symbol and d.date > c.date""")
def j9(spark, d):
    closes = I.day_closes(spark, d).select("symbol", F.col("date").cast("timestamp_ntz").alias("ts"), "close")
    paid = I.dividends(spark, d).select("symbol", F.col("date").cast("timestamp_ntz").alias("ts"), "date", "amount")
    return B.asof_join(paid, closes, ["symbol"], ["close"], strict=True).select("symbol", "date", "amount", F.col("close").alias("prior"))


@query("j11_common_dates", f"""with {I.BARS}, d as (select ts from bars where symbol in ('1-URGENT', '2-HIGH', '3-MEDIUM') group by ts having count(distinct symbol) = 3)
  select symbol, ts, close from bars where symbol in ('1-URGENT', '2-HIGH', '3-MEDIUM') and ts in (select ts from d)""")
def j11(spark, d):
    return B.common_dates(I.daily(spark, d), ["1-URGENT", "2-HIGH", "3-MEDIUM"]).select("symbol", "ts", "close")


_FACTORS = f"""{I.ACTIONS}, {I.DAY_CLOSES}, paid as (select d.symbol, d.date, d.amount, c.close from dividends d asof left join day_closes c on d.symbol = c.symbol and d.date > c.date),
  own as (select symbol, date, 1 / ratio as own from splits union all select symbol, date, (close - amount) / close from paid where amount > 0 and amount < close),
  days as (select symbol, date, product(own) as own from own group by 1, 2),
  factors as (select symbol, date, own, exp(sum(ln(own)) over (partition by symbol order by date desc)) as factor from days)"""


@query("w21_adjustment_factors", f"with {_FACTORS} select symbol, date, round(own, 8) as own, round(factor, 8) as factor from factors")
def w21(spark, d):
    f = B.adjustment_factors(I.splits(spark, d), I.dividends(spark, d), I.day_closes(spark, d))
    return f.select("symbol", "date", R6("own", 8).alias("own"), R6("factor", 8).alias("factor"))


@query("j8_adjusted_bars", f"""with {_FACTORS} select c.symbol, c.date, round(c.close * coalesce(f.factor, 1), 5) as adjusted
  from day_closes c asof left join factors f on c.symbol = f.symbol and c.date < f.date""")
def j8(spark, d):
    closes = I.day_closes(spark, d)
    f = B.adjustment_factors(I.splits(spark, d), I.dividends(spark, d), closes)
    bars = B.adjust(closes.withColumn("ts", F.col("date").cast("timestamp_ntz")), f)
    return bars.select("symbol", F.to_date("ts").alias("date"), F.round(F.col("close") * F.col("adj_factor"), 5).alias("adjusted"))


@query("w22_split_ratio", f"with {I.ACTIONS} select symbol, product(ratio) as ratio from splits where date > date '2024-01-05' and date <= date '2024-01-25' group by 1")
def w22(spark, d):
    return B.split_ratio_between(I.splits(spark, d), "2024-01-05", "2024-01-25")


@query("sc9_splits_lookup", f"with {I.ACTIONS} select date, ratio from splits where symbol = 'click'")
def sc9(spark, d):
    return I.splits(spark, d).where("symbol = 'click'").select("date", "ratio").orderBy("date")


@query("f9_session_filter", "select event_id as id, ts from events where hour(ts) * 60 + minute(ts) >= 570 and hour(ts) * 60 + minute(ts) < 960")
def f9(spark, d):
    from quantloom.operators.options import session

    return session(I.ticks(spark, d), "regular").select("id", "ts")


@query("f10_effective_start", "select max(ts) as last, max(ts) - interval 365 day as start from events")
def f10(spark, d):
    return I.ticks(spark, d).agg(F.max("ts").alias("last")).withColumn("start", F.col("last") - F.make_dt_interval(days=F.lit(B.LOOKBACK_DAYS["5m"])))


@query("f12_timestamp_set", "select event_id as id, ts from events where ts in (select ts from events where event_type = 'error')")
def f12(spark, d):
    t = I.ticks(spark, d)
    return t.join(t.where("symbol = 'error'").select("ts").distinct(), "ts", "left_semi").select("id", "ts")


@query("f14_subsample", f"""with {I.BARS}, n as (select symbol, ts, close, row_number() over (partition by symbol order by ts) - 1 as i, count(*) over (partition by symbol) as n from bars),
  k as (select distinct symbol, (g.k * (n - 1)) // 99 as i from (select distinct symbol, n from n), (select unnest(range(100)) as k) g)
  select n.symbol, n.ts, n.close from n join k using (symbol, i)""")
def f14(spark, d):
    from quantloom.operators.windows import subsample

    return subsample(I.daily(spark, d), 100).select("symbol", "ts", "close")


@query("u1_union_bars", f"with {I.BARS} select symbol, ts, close from bars where symbol = '1-URGENT' union all select symbol, ts, close from bars where symbol = '5-LOW'")
def u1(spark, d):
    b = I.daily(spark, d).select("symbol", "ts", "close")
    return b.where("symbol = '1-URGENT'").unionByName(b.where("symbol = '5-LOW'"))


@query("u3_intersect_dates", f"with {I.BARS} select ts from bars where symbol = '1-URGENT' intersect select ts from bars where symbol = '5-LOW'")
def u3(spark, d):
    b = I.daily(spark, d)
    return b.where("symbol = '1-URGENT'").select("ts").intersect(b.where("symbol = '5-LOW'").select("ts"))


@query("t2_head_tail", f"""with {I.BARS}, r as (select symbol, ts, close, row_number() over (partition by symbol order by ts) as a, row_number() over (partition by symbol order by ts desc) as z from bars)
  select symbol, ts, close, case when a <= 5 then 'head' else 'tail' end as part from r where a <= 5 or z <= 5""")
def t2(spark, d):
    b = I.daily(spark, d)
    up, down = (F.row_number().over(Window.partitionBy("symbol").orderBy(o)) for o in (F.asc("ts"), F.desc("ts")))
    return b.withColumns({"a": up, "z": down}).where("a <= 5 or z <= 5").select("symbol", "ts", "close", F.when(F.col("a") <= 5, "head").otherwise("tail").alias("part"))
