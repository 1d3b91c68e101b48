"""Statistics, correlation, regression, tests, trade and risk metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.operators import bars as B
from quantloom.operators import metrics as M
from quantloom.operators import portfolio as P
from quantloom.operators import stats as S
from quantloom.plans import _inputs as I
from quantloom.plans import _sql as Q
from quantloom.plans._registry import Registry

query = Registry()


def r(c, n=5):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def rets(spark, d):
    return B.returns(I.daily(spark, d)).where("ret is not null")


#: Power sums of z-scores by the sample deviation, per symbol.
_Z = I.RETURNS + """, m as (select symbol, avg(ret) as mu, stddev_samp(ret) as s, count(ret)::double as n from returns where ret is not null group by 1),
  z as (select symbol, any_value(n) as n, sum(((ret - mu) / s) ** 3) as z3, sum(((ret - mu) / s) ** 4) as z4, sum((ret - mu) ** 2) as c2, sum((ret - mu) ** 3) as c3, sum((ret - mu) ** 4) as c4
    from returns join m using (symbol) where ret is not null group by 1)"""


@query("a3_describe", f"""with {I.RETURNS} select symbol, count(ret)::bigint as n, round(avg(ret), 5) as mean, round(stddev_samp(ret), 5) as std, round(median(ret), 5) as median,
  round(quantile_cont(ret, 0.05), 5) as p5, round(quantile_cont(ret, 0.25), 5) as p25, round(quantile_cont(ret, 0.75), 5) as p75, round(quantile_cont(ret, 0.95), 5) as p95,
  round(min(ret), 5) as min, round(max(ret), 5) as max from returns where ret is not null group by 1""")
def a3(spark, d):
    got = S.describe(rets(spark, d), "ret", ["symbol"])
    return got.select("symbol", "n", *[r(c).alias(c) for c in ("mean", "std", "median", "p5", "p25", "p75", "p95", "min", "max")])


@query("a4_skew_kurtosis", f"with {_Z} select symbol, round(sqrt(n * (n - 1)) / (n - 2) * z3 / n, 4) as skew, round((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * z4 / n - 3 * (n - 1)), 3) as kurtosis from z")
def a4(spark, d):
    return S.describe(rets(spark, d), "ret", ["symbol"]).select("symbol", r("skew", 4).alias("skew"), r("kurtosis", 3).alias("kurtosis"))


_RANKED = I.PAIR + """, k as (select a, b, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as x, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as y from pair)"""


@query("a5_correlation", f"with {_RANKED} select count(*)::bigint as n, round(corr(a, b), 6) as pearson, round(corr(x, y), 6) as spearman, round(covar_samp(a, b) / 1e6, 3) as covariance from k")
def a5(spark, d):
    p = I.pair(spark, d).withColumn("k", F.lit(1))
    return S.correlation(p, "a", "b", ["k"]).select("n", r("pearson", 6).alias("pearson"), r("spearman", 6).alias("spearman"), r(F.col("covariance") / 1e6, 3).alias("covariance"))


@query("a6_covariance_matrix", f"""with {I.RETURNS} select x.symbol as a, y.symbol as b, count(*)::bigint as n, round(covar_samp(x.ret, y.ret) * 252, 4) as covariance, round(corr(x.ret, y.ret), 5) as correlation
  from returns x join returns y using (ts) where x.ret is not null and y.ret is not null group by 1, 2""")
def a6(spark, d):
    return S.covariance_matrix(rets(spark, d)).select("a", "b", "n", r("covariance", 4).alias("covariance"), r("correlation").alias("correlation"))


@query("j15_pairwise_correlation", f"""with {I.RETURNS} select x.symbol as a, y.symbol as b, round(corr(x.ret, y.ret), 5) as correlation
  from returns x join returns y using (ts) where x.symbol < y.symbol and x.ret is not null and y.ret is not null group by 1, 2""")
def j15(spark, d):
    return S.covariance_matrix(rets(spark, d)).where("a < b").select("a", "b", r("correlation").alias("correlation"))


@query("a7_histogram", f"""with {I.BARS}, e as (select symbol, min(close) as lo, max(close) as hi, count(*) as total from bars group by 1),
  g as (select *, unnest(range(30))::int as bin from e), c as (select symbol, least(floor((close - lo) / ((hi - lo) / 30)), 29)::int as bin, count(*) as n from bars join e using (symbol) group by 1, 2)
  select symbol, bin, round(lo + bin * ((hi - lo) / 30), 3) as low, round(lo + (bin + 1) * ((hi - lo) / 30), 3) as high, coalesce(n, 0)::bigint as n, round(coalesce(n, 0) / total, 6) as frequency from g left join c using (symbol, bin)""")
def a7(spark, d):
    return S.histogram(I.daily(spark, d), "close", 30, ["symbol"]).select("symbol", "bin", r("low", 3).alias("low"), r("high", 3).alias("high"), "n", r("frequency", 6).alias("frequency"))


@query("a8_tails_and_normality", f"""with {_Z}, t as (select symbol, count(*) filter (ret < mu - 2 * s)::bigint as "left", count(*) filter (ret > mu + 2 * s)::bigint as "right" from returns join m using (symbol) where ret is not null group by 1),
  jb as (select symbol, n / 6 * ((c3 / n / (c2 / n) ** 1.5) ** 2 + (c4 / n / (c2 / n) ** 2 - 3) ** 2 / 4) as jb from z)
  select symbol, "left", "right", round(case when "right" > 0 then "left" / "right" when "left" > 0 then 999.99 else 0 end, 5) as ratio, round(jb, 2) as jb, exp(-jb / 2) > 0.05 as normal from t join jb using (symbol)""")
def a8(spark, d):
    x = rets(spark, d)
    return S.tail_ratio(x, "ret", ["symbol"]).join(S.jarque_bera(x, "ret", ["symbol"]), "symbol").select("symbol", "left", "right", r("ratio").alias("ratio"), r("jb", 2).alias("jb"), "normal")


@query("p1_t_test", f"with {I.RETURNS} select symbol, count(ret)::bigint as n, round(avg(ret) / (stddev_samp(ret) / sqrt(count(ret))), 5) as t from returns where ret is not null group by 1")
def p1(spark, d):
    return S.t_test(rets(spark, d), "ret", ["symbol"]).select("symbol", "n", r("t").alias("t"))


@query("p1_t_test_p_values", f"""with {I.RETURNS}, t as (select symbol, count(ret)::bigint as n, avg(ret) / (stddev_samp(ret) / sqrt(count(ret))) as t from returns where ret is not null group by 1)
  select symbol, n, round(t, 5) as t, round({Q.t_two_sided("t", "n - 1")}, 6) as p from t""")
def p1p(spark, d):
    return S.t_test(rets(spark, d), "ret", ["symbol"]).select("symbol", "n", r("t").alias("t"), r("p", 6).alias("p"))


@query("p2_jarque_bera", f"with {_Z} select symbol, n::bigint as n, round(n / 6 * ((c3 / n / (c2 / n) ** 1.5) ** 2 + (c4 / n / (c2 / n) ** 2 - 3) ** 2 / 4), 2) as jb from z")
def p2(spark, d):
    return S.jarque_bera(rets(spark, d), "ret", ["symbol"]).select("symbol", "n", r("jb", 2).alias("jb"))


@query("p3_pearson_p", f"""with {I.RETURNS}, c as (select x.symbol as a, y.symbol as b, count(*) as n, corr(x.ret, y.ret) as r
    from returns x join returns y using (ts) where x.symbol < y.symbol and x.ret is not null and y.ret is not null group by 1, 2)
  select a, b, round(r, 6) as correlation, round({Q.t_two_sided("r * sqrt((n - 2) / (1 - r * r))", "n - 2")}, 6) as p from c""")
def p3(spark, d):
    c = S.covariance_matrix(rets(spark, d)).where("a < b")
    return c.select("a", "b", r("correlation", 6).alias("correlation"), r(S.pearson_p(F.col("correlation"), F.col("n")), 6).alias("p"))


@query("p4_correlate_levels", f"""with {I.PAIR} select count(*)::bigint as n, round(corr(a, b), 6) as pearson, round(corr(a, b) ** 2, 6) as r2, round(regr_slope(b, a), 6) as slope from pair""")
def p4(spark, d):
    return I.pair(spark, d).agg(F.count("*").alias("n"), r(F.corr("a", "b"), 6).alias("pearson"), r(F.pow(F.corr("a", "b"), 2), 6).alias("r2"), r(F.regr_slope("b", "a"), 6).alias("slope"))


def _granger_sql() -> str:
    """F of each direction for one and two lags; its tail by t (one lag) or in closed form (two)."""
    ctes, rows = [], []
    for c, e in (("ra", "rb"), ("rb", "ra")):
        for k in (1, 2):
            g = f"g_{c}_{k}"
            own, other = [f"e{i}" for i in range(1, k + 1)], [f"c{i}" for i in range(1, k + 1)]
            lags = ", ".join(f"lag({e}, {i}) over (order by ts) as e{i}, lag({c}, {i}) over (order by ts) as c{i}" for i in range(1, k + 1))
            # The shorter fit is over the same rows.
            ctes += [f"{g} as (select * from (select ts, {e} as y, {lags} from pair where ra is not null and rb is not null) where {' and '.join(x + ' is not null' for x in own + other)})"]
            ctes += [Q.ols(f"{g}_small", g, own, "y"), Q.ols(f"{g}_large", g, own + other, "y")]
            free = f"(l.n - 1 - {2 * k})"
            f = f"(((s.rss - l.rss) / {k}) / (l.rss / {free}))"
            p = Q.t_two_sided(f"sqrt({f})", free) if k == 1 else f"pow(1 + 2 * {f} / {free}, -{free} / 2.0)"
            rows.append(f"select '{c}' as cause, '{e}' as effect, {k}::int as lags, round({f}, 5) as f, round({p}, 6) as p, l.n::bigint as n from {g}_small s, {g}_large l")
    return f"with {I.PAIR},\n  " + ",\n  ".join(ctes) + "\n" + "\nunion all ".join(rows)


@query("p5_granger", _granger_sql())
def p5(spark, d):
    p = I.pair(spark, d).where("ra is not null and rb is not null")
    rows = [(c, e, k, (g or {}).get("f"), (g or {}).get("p"), (g or {}).get("n")) for c, e in (("ra", "rb"), ("rb", "ra")) for k in (1, 2) for g in [S.granger(p, c, e, k)]]
    got = spark.createDataFrame(rows, "cause string, effect string, lags int, f double, p double, n long")
    return got.withColumns({"f": r("f"), "p": r("p", 6)})


@query("p7_cointegration_regression", f"""with {I.PAIR}, c as (select regr_intercept(b, a) as alpha, regr_slope(b, a) as beta from pair), s as (select ts, b - alpha - beta * a as spread from pair, c),
  m as (select avg(spread) as mu, stddev_samp(spread) as sd, arg_max(spread, ts) as now, count(*) as n from s)
  select round(alpha, 2) as alpha, round(beta, 5) as beta, round((now - mu) / sd, 4) as z, n::bigint as n, round((select count(*) from s where spread < now) / n * 100, 4) as percentile from m, c""")
def p7(spark, d):
    got = P.spread_summary(I.pair(spark, d))
    return got.select(r("alpha", 2).alias("alpha"), r("beta").alias("beta"), r("z", 4).alias("z"), "n", r("percentile", 4).alias("percentile"))


def _adf_sql(t: str) -> str:
    """p by straight lines between the points that `adf_p` joins."""
    points = P.ADF_POINTS
    between = " ".join(f"when {t} <= {x1!r} then {y0!r} + ({t} - {x0!r}) * {(y1 - y0) / (x1 - x0)!r}" for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False))
    return f"case when {t} <= {points[0][0]!r} then {points[0][1]!r} {between} else {points[-1][1]!r} end"


@query("p7_engle_granger", f"""with {I.PAIR}, line as (select regr_intercept(b, a) as alpha, regr_slope(b, a) as beta, regr_r2(b, a) as r2 from pair),
  s as (select ts, b - alpha - beta * a as spread, lag(b - alpha - beta * a) over (order by ts) as level from pair, line),
  steps as (select ts, spread, level, spread - level as d, lag(spread - level) over (order by ts) as d1 from s),
  {Q.ols("fit", "steps", ["level", "d1"], "d")}, phi as (select regr_slope(spread, level) as phi, count(*)::bigint + 1 as n from steps where level is not null)
  select round(alpha, 2) as alpha, round(beta, 6) as beta, round(r2, 6) as r2, phi.n as n, round(b1 / e1, 5) as adf, round({_adf_sql("(b1 / e1)")}, 6) as p, b1 / e1 < {P.ADF_CRITICAL["5%"]} as cointegrated,
    round(case when phi > 0 and phi < 1 then -ln(2) / ln(phi) end, 5) as half_life from line, fit, phi""")
def p7e(spark, d):
    got = P.engle_granger(I.pair(spark, d))
    got = spark.createDataFrame([tuple(got.values())], "alpha double, beta double, r2 double, n long, adf double, p double, cointegrated boolean, half_life double")
    return got.withColumns({"alpha": r("alpha", 2), "beta": r("beta", 6), "r2": r("r2", 6), "adf": r("adf"), "p": r("p", 6), "half_life": r("half_life")})


_FACTORS = ["market", "size", "momentum"]


@query("p8_factor_attribution", f"""with {I.RETURNS}, k as (select symbol, ret, row_number() over (partition by symbol order by ts desc) as back from returns where ret is not null),
  wide as (select a.ret as y, m.ret as market, s.ret - m.ret as size, l.ret - m.ret as momentum from k a join k m using (back) join k s using (back) join k l using (back)
    where a.symbol = '1-URGENT' and m.symbol = '2-HIGH' and s.symbol = '3-MEDIUM' and l.symbol = '5-LOW'),
  {Q.ols("fit", "wide", _FACTORS, "y")}, means as (select avg(y) as my, avg(market) as m1, avg(size) as m2, avg(momentum) as m3 from wide)
  """ + " union all ".join(
    f"select '{name}' as factor, round(b{i}, 6) as coefficient, round(e{i}, 6) as error, round(b{i} / e{i}, 4) as t, round(2 * (1 - {Q.normal_cdf(f'abs(b{i} / e{i})')}), 6) as p, "
    f"round(b{i} * {f'm{i}' if i else '1'} / my * 100, 3) as contribution_pct, round(1 - rss / tss, 6) as r2, round(1 - rss / tss * (n - 1) / (n - 4), 6) as adjusted_r2, n::bigint as n from fit, means"
    for i, name in enumerate(["alpha", *_FACTORS])
))
def p8(spark, d):
    wide = B.align_tail(rets(spark, d), ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"])
    got = P.factor_attribution(wide, "1-URGENT", "2-HIGH", {"size": "3-MEDIUM", "momentum": "5-LOW"})
    return got.withColumns({c: r(c, n) for c, n in (("coefficient", 6), ("error", 6), ("t", 4), ("p", 6), ("contribution_pct", 3), ("r2", 6), ("adjusted_r2", 6))})


@query("p9_benchmark", f"""with {I.PAIR}, p as (select * from pair where ra is not null and rb is not null)
  select count(*)::bigint as n, round(regr_intercept(ra, rb) * 252, 4) as alpha, round(regr_slope(ra, rb), 5) as beta, round(regr_r2(ra, rb), 6) as r2,
   round(stddev_samp(ra - rb) * sqrt(252), 4) as tracking_error, round(avg(ra - rb) * 252 / (stddev_samp(ra - rb) * sqrt(252)), 4) as information_ratio,
   round(avg(ra) filter (rb > 0) / avg(rb) filter (rb > 0), 5) as up_capture, round(avg(ra) filter (rb < 0) / avg(rb) filter (rb < 0), 5) as down_capture from p""")
def p9(spark, d):
    got = P.benchmark(I.pair(spark, d), "ra", "rb")
    return got.select("n", r("alpha", 4).alias("alpha"), r("beta").alias("beta"), r("r2", 6).alias("r2"), r("tracking_error", 4).alias("tracking_error"), r("information_ratio", 4).alias("information_ratio"), r("up_capture").alias("up_capture"), r("down_capture").alias("down_capture"))


@query("p10_risk_parity", f"""with {I.RETURNS}, s as (select symbol, avg(ret) * 252 as mean, stddev_samp(ret) * sqrt(252) as vol from returns where ret is not null group by 1)
  select symbol, round(mean, 4) as mean, round(vol, 4) as vol, round((mean - 0.05) / vol, 5) as sharpe, round(1 / vol / sum(1 / vol) over (), 6) as weight from s""")
def p10(spark, d):
    return P.risk_parity(rets(spark, d)).select("symbol", r("mean", 4).alias("mean"), r("vol", 4).alias("vol"), r("sharpe").alias("sharpe"), r("weight", 6).alias("weight"))


_FIVE = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _weights_sql() -> str:
    pairs = [(i, j) for i in range(5) for j in range(5)]
    matrix = ", ".join(f"max(c) filter (a = '{_FIVE[i]}' and b = '{_FIVE[j]}') as m_{i}_{j}" for i, j in pairs)
    mean = ", ".join(f"max(mean) filter (symbol = '{s}') - 0.05 as u_{i}" for i, s in enumerate(_FIVE))
    raw = {
        "risk_parity": [f"1 / sqrt(cov.m_{i}_{i})" for i in range(5)],
        "min_variance": [" + ".join(f"inv.w_{i}_{j}" for j in range(5)) for i in range(5)],
        "max_sharpe": [" + ".join(f"inv.w_{i}_{j} * u_{j}" for j in range(5)) for i in range(5)],
    }
    rows = " union all ".join(f"select '{m}' as method, '{_FIVE[i]}' as symbol, greatest({x}, 0) as w from cov, inv, means" for m, xs in raw.items() for i, x in enumerate(xs))
    return f"""with {I.RETURNS}, c as (select x.symbol as a, y.symbol as b, covar_samp(x.ret, y.ret) * 252 as c from returns x join returns y using (ts) where x.ret is not null and y.ret is not null group by 1, 2),
  cov as (select {matrix} from c), means as (select {mean} from (select symbol, avg(ret) * 252 as mean from returns where ret is not null group by 1)), {Q.inverse("inv", "cov", 5)},
  raw as ({rows})
  select method, symbol, round(case when sum(w) over v > 0 then w / sum(w) over v else 0.2 end, 6) as weight from raw window v as (partition by method)"""


@query("p10_optimal_weights", _weights_sql())
def p10o(spark, d):
    return P.optimize(rets(spark, d)).withColumn("weight", r("weight", 6))


_TESTS = I.RETURNS + """, t as (select symbol || '-' || isodow(ts) as label, exp(-abs(avg(ret) / (stddev_samp(ret) / sqrt(count(*))))) as p from returns where ret is not null group by 1)"""


def _tests(spark, d):
    x = rets(spark, d).withColumn("label", F.concat("symbol", F.lit("-"), (F.weekday("ts") + 1).cast("string")))
    return x.groupBy("label").agg(F.exp(-F.abs(F.avg("ret") / (F.stddev_samp("ret") / F.sqrt(F.count("*"))))).alias("p"))


@query("p15_benjamini_hochberg", f"""with {_TESTS}, k as (select *, row_number() over (order by p, label) as rank, count(*) over () as n from t),
  a as (select *, least(min(p * n / rank) over (order by rank desc rows between unbounded preceding and current row), 1) as adjusted from k)
  select label, round(p, 6) as p, rank::int as rank, round(adjusted, 6) as adjusted, adjusted <= 0.05 as significant from a""")
def p15(spark, d):
    return S.benjamini_hochberg(_tests(spark, d)).select("label", r("p", 6).alias("p"), "rank", r("adjusted", 6).alias("adjusted"), "significant")


@query("p15_bonferroni", f"with {_TESTS} select label, round(p, 6) as p, round(least(p * count(*) over (), 1), 6) as adjusted, least(p * count(*) over (), 1) <= 0.05 as significant from t")
def p15b(spark, d):
    return S.bonferroni(_tests(spark, d)).select("label", r("p", 6).alias("p"), r("adjusted", 6).alias("adjusted"), "significant")


#: Trades: the close-to-close changes of each symbol, in thousands, held one to seven days.
_TRADES = I.RETURNS + """, trades as (select symbol, ts, round((close - lag(close) over (partition by symbol order by ts)) / 1000, 2) as pnl, 1 + day(ts) % 7 as days from bars)"""


def _trades(spark, d):
    w = Window.partitionBy("symbol").orderBy("ts")
    return I.daily(spark, d).select("symbol", "ts", F.round((F.col("close") - F.lag("close").over(w)) / 1000, 2).alias("pnl"), (1 + F.dayofmonth("ts") % 7).alias("days")).where("pnl is not null")


@query("a9_trade_metrics", f"""with {_TRADES} select symbol, count(*)::bigint as trades, round(avg(case when pnl > 0 then 1.0 else 0.0 end), 6) as win_rate,
  round(case when sum(pnl) filter (pnl < 0) < 0 then sum(pnl) filter (pnl > 0) / -sum(pnl) filter (pnl < 0) else 999.99 end, 3) as profit_factor, round(avg(pnl), 3) as avg_pnl,
  round(avg(pnl) filter (pnl > 0), 3) as avg_winner, round(avg(pnl) filter (pnl < 0), 3) as avg_loser, round(avg(days), 3) as avg_days,
  round(avg(case when pnl > 0 then 1.0 else 0.0 end) * avg(pnl) filter (pnl > 0) + avg(case when pnl < 0 then 1.0 else 0.0 end) * avg(pnl) filter (pnl < 0), 3) as expectancy
  from trades where pnl is not null group by 1""")
def a9(spark, d):
    got = M.trade_metrics(_trades(spark, d))
    return got.select("symbol", "trades", r("win_rate", 6).alias("win_rate"), *[r(c, 3).alias(c) for c in ("profit_factor", "avg_pnl", "avg_winner", "avg_loser", "avg_days", "expectancy")])


@query("a16_value_at_risk", f"""with {I.RETURNS}, k as (select symbol, ret, row_number() over (partition by symbol order by ret) - 1 as i, count(*) over (partition by symbol) as n from returns where ret is not null)
  select symbol, round(-max(ret) filter (i = floor(n * 0.05)), 5) as var, round(-quantile_cont(ret, 0.05), 5) as historical_var, round(-avg(ret) filter (i < greatest(ceil(n * 0.05), 1)), 5) as cvar from k group by symbol""")
def a16(spark, d):
    return M.value_at_risk(rets(spark, d), 0.05).select("symbol", *[r(c).alias(c) for c in ("var", "historical_var", "cvar")])


_EQUITY = I.BARS + ", e as (select symbol, ts, close as equity, (max(close) over w - close) / max(close) over w as dd, close / lag(close) over v - 1 as ret, first(close) over v as a from bars window w as (partition by symbol order by ts rows unbounded preceding), v as (partition by symbol order by ts))"


@query("a17_ulcer_pain", f"with {_EQUITY} select symbol, round(sqrt(avg((dd * 100) ** 2)), 5) as ulcer, round(avg(dd) * 100, 5) as pain, round(max(dd), 6) as max_drawdown from e group by 1")
def a17(spark, d):
    return M.equity_metrics(I.daily(spark, d).withColumnRenamed("close", "equity")).select("symbol", r("ulcer").alias("ulcer"), r("pain").alias("pain"), r("max_drawdown", 6).alias("max_drawdown"))


@query("a18_sharpe_sortino_cagr", f"""with {_EQUITY}, g as (select symbol, avg(ret) as m, stddev_samp(ret) as s, sqrt(sum(case when ret < 0 then ret * ret else 0 end) / (count(ret) - 1)) as down,
    arg_max(equity, ts) / arg_min(equity, ts) as total, datediff('day', min(ts), max(ts)) as days, max(dd) as mdd from e group by 1)
  select symbol, round(m / s * sqrt(252), 5) as sharpe, round(m / down * sqrt(252), 5) as sortino, round(case when days >= 25 then total ** (365.0 / days) - 1 end, 5) as cagr,
    round(case when days >= 25 and mdd > 0 then (total ** (365.0 / days) - 1) / mdd end, 5) as calmar from g""")
def a18(spark, d):
    return M.equity_metrics(I.daily(spark, d).withColumnRenamed("close", "equity")).select("symbol", *[r(c).alias(c) for c in ("sharpe", "sortino", "cagr", "calmar")])
