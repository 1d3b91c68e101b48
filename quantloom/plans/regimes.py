"""Regimes, pattern scan, chance tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.operators import bars as B
from quantloom.operators import blocks as L
from quantloom.operators import patterns as P
from quantloom.operators import regimes as G
from quantloom.operators import resampling as X
from quantloom.operators import stats as S
from quantloom.plans import _inputs as I
from quantloom.plans import _sql as Q
from quantloom.plans._registry import Registry

query = Registry()


def r(c, n=5):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


_VOL = I.RETURNS + """, v as (select symbol, ts, close, ret, case when count(ret) over w = 21 then stddev_samp(ret) over w * sqrt(252) * 100 end as vol,
    case when count(*) over w = 21 then avg(close) over w end as s, case when count(*) over l = 63 then avg(close) over l end as m
    from returns window w as (partition by symbol order by ts rows 20 preceding), l as (partition by symbol order by ts rows 62 preceding)),
  q as (select symbol, quantile_cont(vol, 1/3) as a, quantile_cont(vol, 2/3) as b from v where vol is not null group by 1),
  st as (select symbol, ts, ret, vol, case when vol is not null then (vol > a)::int + (vol > b)::int end as state from v join q using (symbol)),
  tr as (select symbol, ts, ret, vol, case when m is not null then case when s / m - 1 > 0.01 then 2 when s / m - 1 < -0.01 then 0 else 1 end end as state from v)"""


@query("p13_volatility_clusters", f"with {_VOL} select symbol, ts, state from st")
def p13v(spark, d):
    return G.volatility_clusters(I.daily(spark, d), 3).select("symbol", "ts", "state")


@query("p13_trend_states", f"with {_VOL} select symbol, ts, state from tr")
def p13t(spark, d):
    return G.trend_states(I.daily(spark, d), 3).select("symbol", "ts", "state")


@query("a11_regime_statistics", f"""with {_VOL} select symbol, state, count(*)::bigint as n, round(count(*) * 100.0 / sum(count(*)) over (partition by symbol), 5) as pct, round(avg(ret), 5) as mean,
  round(coalesce(stddev_samp(ret), 0), 4) as std, round(avg(vol), 3) as vol from st where state is not null group by 1, 2""")
def a11(spark, d):
    s = G.statistics(G.volatility_clusters(I.daily(spark, d), 3))
    return s.select("symbol", "state", "n", r("pct").alias("pct"), r("mean").alias("mean"), r("std", 4).alias("std"), r("vol", 3).alias("vol"))


@query("a12_transitions", f"""with {_VOL}, k as (select symbol, state as f, lead(state) over (partition by symbol order by ts) as t from st),
  c as (select symbol, f, t, count(*) as n from k where f is not null and t is not null group by 1, 2, 3), g as (select distinct symbol, a.x as f, b.x as t from st, (select unnest(range(3)) as x) a, (select unnest(range(3)) as x) b)
  select symbol, f::int as "from", t::int as "to", round(coalesce(n / sum(n) over (partition by symbol, f), 0), 6) as probability from g left join c using (symbol, f, t)""")
def a12(spark, d):
    return G.transitions(G.volatility_clusters(I.daily(spark, d), 3), 3).withColumn("probability", r("probability", 6))


@query("p11_hmm_states")
def p11(spark, d):
    return G.hmm_states(I.daily(spark, d), 2)


@query("p12_hmm_online", None)
def p12(spark, d):
    return G.hmm_states(I.daily(spark, d), 2).groupBy("symbol", "online").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"))


@query("p14_pattern_weekday", f"""with {I.RETURNS}, s as (select symbol, rn as i, isodow(ts) as d, lead(close, 5) over (partition by symbol order by ts) / close - 1 as forward from returns),
  f as (select symbol, d, i, forward, i - lag(i) over (partition by symbol, d order by i) as gap from s where forward is not null and d <= 5)
  select symbol, ['mon', 'tue', 'wed', 'thu', 'fri'][d::int] as day, count(*)::bigint as candidates, median(gap) as gap from f group by 1, 2""")
def p14s(spark, d):
    base, conditions = P.flags(I.daily(spark, d))
    names = [k for k in conditions if k.split("/")[1] in ("mon", "tue", "wed", "thu", "fri")]
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = base.withColumn("forward", F.try_divide(F.lead("close", 5).over(w), F.col("close")) - 1).withColumn("day", F.coalesce(*[F.when(conditions[k], k.split("/")[1]) for k in names]))
    rows = rows.where("forward is not null and day is not null").withColumn("gap", F.col("__i") - F.lag("__i").over(Window.partitionBy("symbol", "day").orderBy("__i")))
    return rows.groupBy("symbol", "day").agg(F.count("*").alias("candidates"), F.median("gap").alias("gap"))


#: Conditions by pattern, on the columns of `f`.
_CONDITIONS = {f"seasonality/{d}": f"isodow(ts) = {k + 1}" for k, d in enumerate(("mon", "tue", "wed", "thu", "fri"))}
_CONDITIONS |= {f"seasonality/{m}": f"month(ts) = {k + 1}" for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
_CONDITIONS |= {
    "seasonality/turn_of_month": "day(ts) <= 3 or before_end <= 2", "price_action/three_down": "down = 3", "price_action/three_up": "up = 3", "price_action/up_5pct_20": "r20 > 0.05", "price_action/down_5pct_20": "r20 < -0.05",
    "price_action/day_up_2pct": "ret > 0.02", "price_action/day_down_2pct": "ret < -0.02", "mean_reversion/below_band": "close < sma - 2 * sd", "mean_reversion/above_band": "close > sma + 2 * sd",
    "mean_reversion/z_below_2": "sd > 0 and (close - sma) / sd < -2", "volume/spike": "volume > 2 * vol_sma", "volume/dry": "volume < 0.5 * vol_sma", "volatility/low": "vol < v25", "volatility/high": "vol > v75",
    "microstructure/gap_up": "gap > 0.01", "microstructure/gap_down": "gap < -0.01", "microstructure/wide_range": "range > 2 * range_sma", "autocorrelation/lag1": "abs(ac1) > 0.05 and r1 > 0", "autocorrelation/lag5": "abs(ac5) > 0.05 and r5 > 0",
}


def _signals_sql(hits: str | None = None, before: str = "") -> str:
    """CTEs up to `found`: symbol, pattern, horizon, i, ts, forward.  hits: bars with their patterns, of the conditions if not given; before: CTEs that it needs."""
    w20 = "over (partition by symbol order by ts rows between 19 preceding and current row)"
    patterns = ", ".join(f"case when {c} then '{k}' end" for k, c in _CONDITIONS.items())
    full = lambda x: f"case when count(*) {w20} = 20 then {x} {w20} end"
    hits = hits or f"select *, unnest(list_filter([{patterns}], lambda x: x is not null)) as pattern from f"
    ahead = " union all ".join(f"select symbol, pattern, {h} as horizon, rn as i, ts, f{h} as forward, min(rn) over (partition by symbol, pattern order by rn range between {h} following and unbounded following) as nxt from hits where f{h} is not null" for h in P.HORIZONS)
    return f"""{I.RETURNS}, f0 as (select *, lag(ret) over v as r1, lag(ret, 5) over v as r5, open / lag(close) over v - 1 as gap, (high - low) / low as range, close / lag(close, 20) over v - 1 as r20, datediff('day', ts::date, last_day(ts)) as before_end,
    case when ret > 0 then rn - max(case when ret > 0 then 0 else rn end) over v else 0 end as up, case when ret < 0 then rn - max(case when ret < 0 then 0 else rn end) over v else 0 end as down,
    {", ".join(f"lead(close, {h}) over v / close - 1 as f{h}" for h in P.HORIZONS)} from returns window v as (partition by symbol order by ts)),
  f1 as (select *, {full("avg(close)")} as sma, {full("stddev_samp(close)")} as sd, {full("avg(volume)")} as vol_sma, {full("avg(range)")} as range_sma, case when count(ret) {w20} = 20 then stddev_samp(ret) {w20} end as vol from f0),
  qu as (select symbol, quantile_cont(vol, 0.25) as v25, quantile_cont(vol, 0.75) as v75, corr(ret, r1) as ac1, corr(ret, r5) as ac5, median(vol) as middle from f1 group by 1),
  f as (select * from f1 join qu using (symbol)), {before}hits as ({hits}),
  long as ({ahead}), gaps as (select symbol, pattern, horizon, median(g) as gap from (select *, i - lag(i) over (partition by symbol, pattern, horizon order by i) as g from long) group by 1, 2, 3),
  dense as (select symbol, pattern, horizon from gaps where gap < horizon),
  kept(symbol, pattern, horizon, i) as (select symbol, pattern, horizon, min(i) from long semi join dense using (symbol, pattern, horizon) group by 1, 2, 3
    union all select l.symbol, l.pattern, l.horizon, l.nxt from kept k join long l on k.symbol = l.symbol and k.pattern = l.pattern and k.horizon = l.horizon and k.i = l.i where l.nxt is not null),
  found as (select * from long anti join dense using (symbol, pattern, horizon) union all select long.* from long join kept using (symbol, pattern, horizon, i))"""


def _scan_sql(hits: str | None = None, before: str = "") -> str:
    """CTEs up to `scanned`; hits, before: as in `_signals_sql`."""
    key = "symbol, pattern, horizon"
    best = "case when trials > 1 then sqrt(2 * ln(trials)) - (ln(ln(trials)) + ln(4 * pi())) / (2 * sqrt(2 * ln(trials))) else 0 end"
    return _signals_sql(hits, before) + f""",
  m as (select {key}, count(*) as n, avg(forward) as mean, stddev_samp(forward) as std, avg((forward > 0)::int) as win_rate from found group by {key} having count(*) >= {P.LEAST_SIGNALS} and stddev_samp(forward) > 0),
  zs as (select {key}, sum(((forward - mean) / std) ** 3) as z3, sum(((forward - mean) / std) ** 4) as z4 from found join m using ({key}) group by {key}),
  st as (select *, sqrt(n * (n - 1.0)) / (n - 2) * z3 / n as skew, (n - 1.0) / ((n - 2) * (n - 3)) * ((n + 1) * z4 / n - 3 * (n - 1)) as kurtosis, mean / (std / sqrt(n)) as t, mean / std * sqrt(252.0 / horizon) as sharpe, count(*) over (partition by symbol) as trials from m join zs using ({key})),
  tp as (select *, {Q.t_two_sided("t", "n - 1")} as p from st), ra as (select *, row_number() over (partition by symbol order by p, pattern, horizon) as rank from tp),
  re as (select {key}, (f.vol > f.middle)::int as regime, count(*) as k, avg(forward) / nullif(stddev_samp(forward), 0) as s from found join f using (symbol, ts) where f.vol is not null group by {key}, 4 having count(*) >= 3 and stddev_samp(forward) > 0),
  cv as (select {key}, case when count(*) >= 2 and avg(s) <> 0 then stddev_samp(s) / abs(avg(s)) end as cv from re group by {key}),
  ad as (select *, least(min(p * trials / rank) over (partition by symbol order by rank desc), 1) as adjusted, (1 + 0.5 * skew * sharpe + kurtosis / 4 * sharpe * sharpe) / (n - 1) as var, {best} as best from ra left join cv using ({key})),
  zz as (select *, case when var > 0 then (sharpe - best * sqrt(var)) / sqrt(var) end as z from ad),
  ds as (select *, coalesce({Q.normal_cdf("z")}, 0) as dsr from zz),
  scanned as (select *, case when pattern like 'seasonality/%' or pattern like 'volume/%' then {P.STRUCTURAL} else {P.EMPIRICAL} end * greatest(dsr, 0) / (1 + coalesce(cv, 1)) as score from ds)"""


_SHOWN = {"mean": 6, "std": 6, "win_rate": 6, "skew": 4, "kurtosis": 3, "t": 4, "sharpe": 4, "p": 5, "adjusted": 5, "cv": 3, "dsr": 5, "score": 5}


@query("p14_pattern_scan", f"""with recursive {_scan_sql()}
  select symbol, pattern, horizon::int as horizon, n::bigint as n, trials::bigint as trials, {", ".join(f"round({c}, {k}) as {c}" for c, k in _SHOWN.items())}, adjusted <= 0.05 as significant from scanned""")
def p14(spark, d):
    return P.scan(I.daily(spark, d)).select("symbol", "pattern", "horizon", "n", "trials", *[r(c, k).alias(c) for c, k in _SHOWN.items()], "significant")


#: Granger tests of all ordered pairs with two lags, as CTEs up to `tests`; the tail of F with two and d degrees is in closed form.
_TESTS = f"""pairs as (select x.symbol as c, y.symbol as e, x.ts, x.ret as rc, y.ret as re from returns x join returns y on x.ts = y.ts and x.symbol <> y.symbol where x.ret is not null and y.ret is not null),
  lags as (select c, e, ts, re as y, {", ".join(f"lag(r{x}, {k}) over w as {x}{k}" for x in "ce" for k in (1, 2))} from pairs window w as (partition by c, e order by ts)),
  whole as (select * from lags where c2 is not null), {Q.ols("small", "whole", ["e1", "e2"], "y", "c, e")}, {Q.ols("large", "whole", ["e1", "e2", "c1", "c2"], "y", "c, e")},
  fs as (select l.c as cause, l.e as effect, l.n, (s.rss - l.rss) / 2 / (l.rss / (l.n - 5)) as f from small s join large l on s.c = l.c and s.e = l.e),
  tests as (select *, pow(1 + 2 * f / (n - 5), -(n - 5) / 2.0) as p from fs)"""


@query("p14_cross_granger", f"with {I.RETURNS}, {_TESTS} select cause, effect, round(f, 4) as f, round(p, 6) as p, n::bigint as n from tests")
def p14g(spark, d):
    tests = S.granger_pairs(L.in_blocks(I.daily(spark, d), B.returns, 1), p=2)
    return tests.select("cause", "effect", r("f", 4).alias("f"), r("p", 6).alias("p"), "n")


#: Few of the pairs here lead: a fifth of all tests is let through.
_LED = "select f.*, 'cross_asset/' || cause as pattern from f join tests on effect = f.symbol and p < 0.2 join returns m on m.symbol = cause and m.ts = f.ts and abs(m.ret) > 0.02"


@query("p14_cross_asset", f"""with recursive {_scan_sql(_LED, _TESTS + ", ")}
  select symbol, pattern, horizon::int as horizon, n::bigint as n, trials::bigint as trials, {", ".join(f"round({c}, {k}) as {c}" for c, k in _SHOWN.items())}, adjusted <= 0.05 as significant from scanned""")
def p14c(spark, d):
    bars = I.daily(spark, d)
    tests = S.granger_pairs(L.in_blocks(bars, B.returns, 1), p=2)
    found = P.cross_asset_signals(bars, tests, alpha=0.2)
    return P.scan(bars, found=found).select("symbol", "pattern", "horizon", "n", "trials", *[r(c, k).alias(c) for c, k in _SHOWN.items()], "significant")


@query("j14_similar_patterns", f"""with {I.RETURNS}, t as (select symbol, ts, 'fri' as pattern from returns where isodow(ts) = 5 union all select symbol, ts, 'up' from returns where ret > 0
    union all select symbol, ts, 'big' from returns where ret > 0.02 union all select symbol, ts, 'gap' from returns where ret > 0.5), n as (select symbol, pattern, count(*) as n from t group by 1, 2),
  b as (select x.symbol, x.pattern as a, y.pattern as b, count(*) as k from t x join t y on x.symbol = y.symbol and x.ts = y.ts and x.pattern < y.pattern group by 1, 2, 3)
  select b.symbol, a, b.b, round(k / (m.n + o.n - k), 6) as similarity from b join n m on m.symbol = b.symbol and m.pattern = a join n o on o.symbol = b.symbol and o.pattern = b.b where k / (m.n + o.n - k) > 0.3""")
def j14(spark, d):
    x = B.returns(I.daily(spark, d))
    tests = {"fri": F.weekday("ts") == 4, "up": F.col("ret") > 0, "big": F.col("ret") > 0.02, "gap": F.col("ret") > 0.5}
    found = x.select("symbol", "ts", F.explode(F.array_compact(F.array(*[F.when(v, k) for k, v in tests.items()]))).alias("pattern"))
    return P.similar_patterns(found, 0.3).withColumn("similarity", r("similarity", 6))


@query("p6_distinct_patterns", f"""with recursive {_scan_sql()},
  dates as (select distinct symbol, pattern, ts from found), sizes as (select symbol, pattern, count(*) as n from dates group by 1, 2),
  both_ as (select x.symbol, x.pattern as a, y.pattern as b, count(*) as k from dates x join dates y on x.symbol = y.symbol and x.ts = y.ts and x.pattern <> y.pattern group by 1, 2, 3),
  pairs as (select b.symbol, b.a, b.b from both_ b join sizes m on m.symbol = b.symbol and m.pattern = b.a join sizes o on o.symbol = b.symbol and o.pattern = b.b where k / (m.n + o.n - k) > 0.5),
  reach(symbol, a, b) as (select distinct symbol, pattern, pattern from scanned union select r.symbol, r.a, p.b from reach r join pairs p on p.symbol = r.symbol and p.a = r.b),
  label as (select symbol, a as pattern, min(b) as label from reach semi join (select distinct symbol, pattern from scanned) s on reach.symbol = s.symbol and reach.b = s.pattern group by 1, 2)
  select symbol, pattern, horizon::int as horizon, n::bigint as n, round(dsr, 5) as dsr from scanned join label using (symbol, pattern) qualify row_number() over (partition by symbol, label order by round(dsr, 9) desc, pattern, horizon) = 1""")
def p6(spark, d):
    bars = I.daily(spark, d)
    found = P.signals(bars).persist()
    return P.deduplicate(P.scan(bars, found=found), P.similar_patterns(found)).select("symbol", "pattern", "horizon", "n", r("dsr").alias("dsr"))


def _trades(spark, d):
    return I.table(spark, d, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") - 240000).alias("pnl"))


@query("p19_sign_flip_permutation", """with t as (select o_orderpriority as symbol, o_orderkey as id, o_totalprice - 240000 as pnl from orders),
  f as (select symbol, k, case when k = 0 or (('0x' || md5('42:' || ((k - 1) // 60) || ':' || id)[1:15])::bigint >> ((k - 1) % 60)) & 1 = 0 then pnl else -pnl end as x from t, (select unnest(range(101)) as k)),
  v as (select symbol, k, count(*) as n, coalesce(avg(x) / nullif(stddev_samp(x), 0), 0) as value from f group by 1, 2)
  select a.symbol, a.n::bigint as n, round(a.value, 6) as observed, sum((b.value >= a.value)::int)::bigint as hits, round(case when a.n >= 10 then (sum((b.value >= a.value)::int) + 1) / 101 else 1 end, 6) as p
  from v a join v b on a.symbol = b.symbol and a.k = 0 and b.k > 0 group by a.symbol, a.n, a.value""")
def p19(spark, d):
    return X.sign_flip_test(_trades(spark, d), 100).select("symbol", "n", r("observed", 6).alias("observed"), "hits", r("p", 6).alias("p"))


@query("p18_monte_carlo")
def p18(spark, d):
    x = B.returns(B.resample(I.ticks(spark, d), "1h", tie="id")).withColumn("ret", F.least(F.greatest(F.col("ret") / 1000, F.lit(-0.05)), F.lit(0.05)))
    return X.path_summary(X.bootstrap_paths(x, paths=2000, key="symbol"), key="symbol")
