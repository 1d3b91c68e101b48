"""Rolling statistics, drawdowns, streaks, calendar, walk-forward windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import bars as B
from quantloom.operators import blocks as L
from quantloom.operators import windows as W
from quantloom.plans import _inputs as I
from quantloom.plans._registry import Registry

query = Registry()
N = 21
RW = f"window w as (partition by symbol order by ts rows between {N - 1} preceding and current row)"


def r(c, n=5):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def rets(spark, d):
    return B.returns(I.daily(spark, d))


@query("w2_rolling_mean", f"with {I.BARS} select symbol, ts, case when count(*) over w = {N} then round(avg(close) over w, 3) end as mean from bars {RW}")
def w2(spark, d):
    got = L.in_blocks(I.daily(spark, d), lambda b: b.withColumn("mean", W.full(F.avg("close").over(W.trailing(N)), N)), N - 1)
    return got.select("symbol", "ts", r("mean", 3).alias("mean"))


for _m, _e in {
    "volatility": "stddev_samp(ret) over w * sqrt(252) * 100",
    "sharpe": "case when stddev_samp(ret) over w > 0 then avg(ret) over w / stddev_samp(ret) over w * sqrt(252) else 0 end",
    "mean_return": "avg(ret) over w * 252 * 100",
}.items():
    query(f"w3_rolling_{_m}", f"with {I.RETURNS} select symbol, ts, case when count(ret) over w = {N} then round({_e}, 4) end as value from returns {RW}")(
        lambda spark, d, m=_m: L.in_blocks(I.daily(spark, d), lambda b: B.returns(b).withColumn("value", W.rolling("ret", N, m)), N).select("symbol", "ts", r("value", 4).alias("value"))
    )


@query("w4_rolling_max_drawdown", f"""with recursive {I.RETURNS},
  e as (select a.symbol, a.ts, a.rn, b.ret, a.rn - b.rn as back from returns a join returns b on a.symbol = b.symbol and b.rn between a.rn - 20 and a.rn where a.rn > 21),
  q as (select symbol, ts, back, exp(sum(ln(1 + ret)) over (partition by symbol, ts order by back desc)) as equity from e),
  p as (select symbol, ts, back, equity, greatest(1, max(equity) over (partition by symbol, ts order by back desc)) as peak from q)
  select symbol, ts, round(max((peak - equity) / peak) * 100, 4) as value from p group by 1, 2""")
def w4(spark, d):
    out = L.in_blocks(I.daily(spark, d), lambda b: W.rolling_max_drawdown(B.returns(b), "ret", N), N + 1).withColumn("value", r("value", 4))
    return out.where("value is not null").select("symbol", "ts", "value")


@query("w5_rolling_beta_correlation", f"""with {I.PAIR} select ts, case when count(*) over w = {N} then round(covar_samp(ra, rb) over w / var_samp(rb) over w, 5) end as beta,
  case when count(*) over w = {N} then round(corr(ra, rb) over w, 5) end as correlation from pair window w as (order by ts rows between {N - 1} preceding and current row)""")
def w5(spark, d):
    p = I.pair(spark, d).withColumn("symbol", F.lit("pair"))
    p = L.in_blocks(p, lambda b: b.withColumns({"beta": W.rolling_beta("ra", "rb", N), "correlation": W.rolling_correlation("ra", "rb", N)}), N - 1)
    return p.select("ts", r("beta").alias("beta"), r("correlation").alias("correlation"))


@query("w6_series_summary", f"""with {I.RETURNS}, v as (select symbol, ts, case when count(ret) over w = {N} then stddev_samp(ret) over w * sqrt(252) * 100 end as v from returns {RW}),
  n as (select *, row_number() over (partition by symbol order by ts) as i from v where v is not null),
  g as (select symbol, count(*) as n, arg_max(v, ts) as current, avg(v) as mean, min(v) as min, max(v) as max, stddev_samp(v) as std, regr_slope(v, i) as slope from n group by 1)
  select symbol, n::bigint as n, round(current, 4) as current, round(mean, 4) as mean, round(min, 4) as min, round(max, 4) as max, round(std, 4) as std,
    case when n > 10 and slope * n / std > 1 then 'rising' when n > 10 and slope * n / std < -1 then 'falling' else 'stable' end as trend from g""")
def w6(spark, d):
    v = rets(spark, d).withColumn("v", W.rolling("ret", N, "volatility"))
    s = W.summary(v, "v")
    return s.select("symbol", "n", *[r(c, 4).alias(c) for c in ("current", "mean", "min", "max", "std")], "trend")


@query("w7_rolling_level_correlation", f"with {I.PAIR} select ts, case when count(*) over w = 60 then round(corr(a, b) over w, 5) end as correlation from pair window w as (order by ts rows between 59 preceding and current row)")
def w7(spark, d):
    p = I.pair(spark, d).withColumn("symbol", F.lit("p"))
    return L.in_blocks(p, lambda b: b.withColumn("correlation", W.rolling_correlation("a", "b", 60)), 59).select("ts", r("correlation").alias("correlation"))


@query("w8_lead_lag", f"""with {I.PAIR}, p as (select *, row_number() over (order by ts) as k from pair where ra is not null and rb is not null), lags as (select unnest(range(-10, 11)) as lag)
  select lag::int as lag, count(*)::bigint as n, round(corr(x.ra, y.rb), 5) as correlation from lags join p x on true join p y on y.k = x.k + lag group by 1""")
def w8(spark, d):
    from quantloom.operators.stats import lead_lag

    return lead_lag(I.pair(spark, d).where("ra is not null and rb is not null"), "ra", "rb", 10).select("lag", "n", r("correlation").alias("correlation"))


@query("w9_underwater", f"""with {I.BARS} select symbol, ts, max(close) over w as peak, round(close / max(close) over w - 1, 6) as drawdown from bars
  window w as (partition by symbol order by ts rows between unbounded preceding and current row)""")
def w9(spark, d):
    return W.drawdown(I.daily(spark, d)).select("symbol", "ts", "peak", r("drawdown", 6).alias("drawdown"))


_EPISODES = I.BARS + """, m as (select symbol, ts, close, row_number() over (partition by symbol order by ts) as i,
    max(close) over (partition by symbol order by ts rows between unbounded preceding and current row) as peak from bars),
  g as (select *, sum(case when close >= peak then 1 else 0 end) over (partition by symbol order by ts) as island, lead(ts) over (partition by symbol order by ts) as nts,
    lead(i) over (partition by symbol order by ts) as ni from m),
  e as (select symbol, island, min(ts) as start, min(i) as si, arg_min(ts, (close / peak - 1, i)) as trough, arg_min(i, (close / peak - 1, i)) as ti, min(close / peak - 1) as worst,
    arg_max(nts, i) as "end", max(i) as li, bool_or(nts is null) as open from g where close < peak group by 1, 2),
  ep as (select symbol, start, trough, case when open then null else "end" end as "end", worst * 100 as depth, (li + 1 - si)::bigint as duration, case when open then 0 else li + 1 - ti end::bigint as recovery
    from e where worst < -0.001)"""


@query("w10_drawdown_episodes", f'with {_EPISODES} select symbol, start, trough, "end", round(depth, 5) as depth, duration, recovery from ep')
def w10(spark, d):
    return W.drawdown_episodes(I.daily(spark, d)).withColumn("depth", r("depth"))


@query("t3_worst_drawdowns", f'with {_EPISODES} select symbol, start, trough, "end", round(depth, 5) as depth, duration, recovery, row_number() over (partition by symbol order by depth, start)::int as rank from ep qualify rank <= 20')
def t3(spark, d):
    return W.worst_episodes(I.daily(spark, d)).withColumn("depth", r("depth"))


@query("w11_drawdown_durations", f"with {_EPISODES} select symbol, round(avg(duration), 5) as mean, max(duration) as longest, count(*)::bigint as n from ep group by 1")
def w11(spark, d):
    return W.drawdown_episodes(I.daily(spark, d)).groupBy("symbol").agg(r(F.avg("duration")).alias("mean"), F.max("duration").alias("longest"), F.count("*").alias("n"))


_RUNS = I.BARS + """, c as (select *, close - lag(close) over (partition by symbol order by ts) as c, row_number() over (partition by symbol order by ts) as i from bars),
  k as (select *, max(case when c > 0 then 0 else i end) over w as bu, max(case when c < 0 then 0 else i end) over w as bd from c window w as (partition by symbol order by ts))"""


@query("w15_consecutive", f"with {_RUNS} select symbol, ts, case when c > 0 then i - bu else 0 end::int as up_run, case when c < 0 then i - bd else 0 end::int as down_run from k")
def w15(spark, d):
    return W.consecutive(I.daily(spark, d)).select("symbol", "ts", F.col("up_run").cast("int").alias("up_run"), F.col("down_run").cast("int").alias("down_run"))


@query("w12_losing_streak", f"with {_RUNS} select symbol, max(case when c < 0 then i - bd else 0 end)::int as longest from k group by 1")
def w12(spark, d):
    t = L.in_blocks(I.daily(spark, d), lambda b: b.withColumn("pnl", F.col("close") - F.lag("close").over(W.order())), 1)
    return W.longest_losing_streak(t).select("symbol", F.col("longest").cast("int").alias("longest"))


@query("w13_ranks", f"""with {I.BARS}, l as (select symbol, ts, close, list(close) over w as l, count(*) over w as n, min(close) over w as low, max(close) over w as high from bars {RW})
  select symbol, ts, case when n = {N} then round(len(list_filter(l, lambda x: x < close)) / {N - 1}.0 * 100, 5) end as percentile,
    case when n = {N} then case when high > low then round((close - low) / (high - low) * 100, 5) else 50.0 end end as range_rank from l""")
def w13(spark, d):
    got = W.percentile_rank(I.daily(spark, d), "close", N)
    got = L.in_blocks(got, lambda b: b.withColumn("range_rank", W.range_rank("close", N)), N - 1)
    return got.select("symbol", "ts", r("percentile").alias("percentile"), r("range_rank").alias("range_rank"))


@query("w16_extremes", f"""with {I.BARS} select symbol, ts, max(high) over w as highest_high, min(low) over w as lowest_low, max(close) over w as highest_close, min(close) over w as lowest_close from bars {RW}""")
def w16(spark, d):
    w = W.trailing(N)
    wanted = {"highest_high": F.max("high").over(w), "lowest_low": F.min("low").over(w), "highest_close": F.max("close").over(w), "lowest_close": F.min("close").over(w)}
    return L.in_blocks(I.daily(spark, d), lambda b: b.withColumns(wanted), N - 1).select("symbol", "ts", *wanted)


@query("w17_lookback", f"with {I.BARS} select symbol, ts, lag(close, 5) over (partition by symbol order by ts) as close_5, lag(volume, 1) over (partition by symbol order by ts) as volume_1 from bars")
def w17(spark, d):
    wanted = {"close_5": F.lag("close", 5).over(W.order()), "volume_1": F.lag("volume", 1).over(W.order())}
    return L.in_blocks(I.daily(spark, d), lambda b: b.withColumns(wanted), 5).select("symbol", "ts", *wanted)


@query("w18_crossings", f"""with {I.BARS}, m as (select symbol, ts, close, case when count(*) over w = {N} then avg(close) over w end as sma from bars {RW}),
  p as (select *, lag(close) over v as pc, lag(sma) over v as ps from m window v as (partition by symbol order by ts))
  select symbol, ts, coalesce(close > sma and pc <= ps, false) as above, coalesce(close < sma and pc >= ps, false) as below from p""")
def w18(spark, d):
    def add(b):
        b = b.withColumn("sma", W.full(F.avg("close").over(W.trailing(N)), N))
        return b.withColumns({"above": W.crossed("close", "sma"), "below": W.crossed("close", "sma", above=False)})

    return L.in_blocks(I.daily(spark, d), add, N).select("symbol", "ts", "above", "below")


@query("w19_calendar", f"""with {I.TICKS}, h as (select symbol, min(ts) as ts from ticks group by symbol, date_trunc('hour', ts)),
  k as (select *, cast(ts as date) as day, lag(cast(ts as date)) over w as before, lead(cast(ts as date)) over w as after from h window w as (partition by symbol order by ts)),
  left_ as (select symbol, day, count(*) over (partition by symbol, date_trunc('month', day) order by day desc) - 1 as n from (select distinct symbol, day from k))
  select k.symbol, ts, isodow(ts)::int as day_of_week, month(ts)::int as month, day(ts)::int as day_of_month, hour(ts)::int as hour, minute(ts)::int as minute, week(ts)::int as week,
    strftime(ts, '%H:%M') as hhmm, (hour(ts) * 60 + minute(ts) - 570)::int as since_open, before is null or before <> k.day as first_bar, after is null or after <> k.day as last_bar,
    after is null or quarter(after) <> quarter(k.day) as quarter_end, left_.n::int as trading_days_left from k join left_ on k.symbol = left_.symbol and k.day = left_.day""")
def w19(spark, d):
    return W.calendar(B.resample(I.ticks(spark, d), "1h", tie="id").select("symbol", "ts"))


@query("w20_forward_returns", f"with {I.BARS} select symbol, ts, round(lead(close, 5) over (partition by symbol order by ts) / close - 1, 6) as forward from bars")
def w20(spark, d):
    return L.in_blocks(I.daily(spark, d), lambda b: b.withColumn("forward", W.forward_return(5)), 0, 5).select("symbol", "ts", r("forward", 6).alias("forward"))


@query("w20_purge_overlaps", f"""with recursive {I.RETURNS}, s as (select symbol, rn::bigint as i from returns where ret > 0.5),
  gaps as (select symbol, median(gap) as gap from (select symbol, i - lag(i) over (partition by symbol order by i) as gap from s) group by 1),
  nx as (select s.symbol, s.i, min(n.i) as nxt from s left join s n on s.symbol = n.symbol and n.i >= s.i + 5 group by 1, 2),
  kept(symbol, i) as (select symbol, min(i) from s group by 1 union all select nx.symbol, nx.nxt from kept join nx on kept.symbol = nx.symbol and kept.i = nx.i where nx.nxt is not null)
  select symbol, i from s join gaps using (symbol) where not coalesce(gap < 5, false) or (symbol, i) in (select (symbol, i) from kept)"""
)
def w20p(spark, d):
    b = B.returns(I.daily(spark, d)).withColumn("i", F.row_number().over(W.order()).cast("bigint"))
    return W.purge_overlaps(b.where("ret > 0.5").select("symbol", "i"), 5)


_DAYS = "days as (select day, row_number() over (order by day) - 1 as i, count(*) over () as t from (select distinct cast(o_orderdate as date) as day from orders))"


@query("w23_walk_forward_rolling", f"""with {_DAYS}, p as (select distinct floor(t * 0.3 / (0.7 + 5 * 0.3))::bigint as test, t from days), q as (select *, round(test * 0.7 / 0.3)::bigint as train from p),
  w as (select k::int as "window", k * test as a, k * test + train - 1 as b, k * test + train as c, least(k * test + train + test, t) - 1 as d from q, (select unnest(range(5)) as k))
  select "window", x.day as train_start, y.day as train_end, z.day as test_start, v.day as test_end from w join days x on x.i = a join days y on y.i = b join days z on z.i = c join days v on v.i = d""")
def w23r(spark, d):
    return W.walk_forward_windows(I.trades(spark, d).select(F.to_date("ts").alias("day")).distinct(), 5, 0.7)


@query("w23_walk_forward_anchored", f"""with {_DAYS}, p as (select distinct t // 6 as test, round(t * 0.7 / 6)::bigint as train, t from days),
  w as (select k::int as "window", 0 as a, train + k * test - 1 as b, train + k * test as c, least(train + k * test + test, t) - 1 as d from p, (select unnest(range(5)) as k))
  select "window", x.day as train_start, y.day as train_end, z.day as test_start, v.day as test_end from w join days x on x.i = a join days y on y.i = b join days z on z.i = c join days v on v.i = d""")
def w23a(spark, d):
    return W.walk_forward_windows(I.trades(spark, d).select(F.to_date("ts").alias("day")).distinct(), 5, 0.7, "anchored")
