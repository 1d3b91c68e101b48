"""Order fills, backtests, option strategies, sweeps, walk-forward."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.operators import options as O
from quantloom.operators import search as V
from quantloom.operators import simulation as S
from quantloom.operators import windows as W
from quantloom.plans import _inputs as I
from quantloom.plans._registry import Registry

query = Registry()


@query("b3_order_fills", f"""with {I.BARS}, o as (select *, close * (0.9 + 0.02 * (day(ts) % 10)) as lim, close * (0.9 + 0.02 * (day(ts) % 7)) as stp, month(ts) % 2 = 0 as buy from bars)
  select symbol, ts, round(case when buy and low <= lim then least(lim, open) when not buy and high >= lim then greatest(lim, open) end, 4) as limit_fill,
   round(case when buy and high >= stp then greatest(stp, open) when not buy and low <= stp then least(stp, open) end, 4) as stop_fill,
   round(case when buy and stp <= lim and high >= stp and low <= lim then least(lim, greatest(stp, open)) when not buy and stp >= lim and low <= stp and high >= lim then greatest(lim, least(stp, open)) end, 4) as stop_limit_fill, open as market_fill from o""")
def b3(spark, d):
    day = F.dayofmonth("ts")
    b = I.daily(spark, d).withColumns({"lim": F.col("close") * (0.9 + 0.02 * (day % 10)), "stp": F.col("close") * (0.9 + 0.02 * (day % 7)), "buy": F.month("ts") % 2 == 0})
    r = lambda c: F.round(c, 4)
    buy, lim, stp = F.col("buy"), F.col("lim"), F.col("stp")
    return b.select("symbol", "ts", r(S.fill("limit", buy, lim)).alias("limit_fill"), r(S.fill("stop", buy, stop=stp)).alias("stop_fill"), r(S.fill("stop_limit", buy, lim, stp)).alias("stop_limit_fill"), S.fill("market", buy).alias("market_fill"))


def crossing(rows):
    """Buy when the close passes the mean of so many closes, sell when it falls below."""
    w = W.order().rowsBetween(-49, 0)
    recent = F.collect_list("close").over(w)
    n = F.col("params")["window"].cast("int")
    mean = F.when(F.size(recent) >= n, F.aggregate(F.slice(recent, -n, n), F.lit(0.0), lambda a, x: a + x) / n)
    rows = rows.withColumn("mean", mean)
    return rows.withColumns({"enter": F.col("close") > F.col("mean"), "leave": F.col("close") < F.col("mean")})


def one_combo(spark, d, window=20):
    return crossing(I.daily(spark, d).withColumns({"combo": F.lit(0), "params": F.create_map(F.lit("window"), F.lit(float(window)))}))


@query("b1_backtest_trades")
def b1(spark, d):
    return S.backtest(one_combo(spark, d), S.Rules(stop_loss=0.3, profit_target=0.5))


@query("b8_equity_curve")
def b8(spark, d):
    return S.equity(S.backtest(one_combo(spark, d), S.Rules()), I.daily(spark, d))


@query("b16_fixed_holding", f"""with {I.BARS}, x as (select symbol, ts, isodow(ts) = 1 as enter, lead(open, 1) over w as entry_price, lead(open, 6) over w as exit_price, lead(ts, 1) over w as entry_ts, lead(ts, 6) over w as exit_ts from bars window w as (partition by symbol order by ts))
  select symbol, entry_ts, exit_ts, floor(10000 / entry_price + 100)::bigint as quantity, round((exit_price - entry_price) * floor(10000 / entry_price + 100), 2) as pnl from x where enter and exit_ts is not null""")
def b16(spark, d):
    w = Window.partitionBy("symbol").orderBy("ts")
    b = I.daily(spark, d).withColumns({"entry_ts": F.lead("ts", 1).over(w), "exit_ts": F.lead("ts", 6).over(w), "p": F.lead("open", 1).over(w), "q": F.lead("open", 6).over(w)}).where("weekday(ts) = 0 and exit_ts is not null")
    n = F.floor(10000 / F.col("p") + 100)
    return b.select("symbol", "entry_ts", "exit_ts", n.alias("quantity"), F.round((F.col("q") - F.col("p")) * n, 2).alias("pnl"))


def closes(spark, d):
    """An underlying for the option quotes: the mean strike of each day."""
    q = I.chain(spark, d).groupBy("symbol", "ts").agg(F.floor(F.avg("strike")).cast("double").alias("close"))
    return q


_STRADDLE = "with " + I.CHAIN + """, dq as (select *, datediff('day', cast(ts as date), expiration) as dte from quotes where bid > 0.05 and ask > 0.05),
  leg as (select * from dq where abs(delta) between 0.4 and 0.6 and dte between 15 and 45 qualify row_number() over (partition by symbol, ts, option_type order by abs(abs(delta) - 0.5), strike, expiration, id) = 1),
  pos as (select c.symbol, c.ts, c.strike as ck, p.strike as pk, c.bid as cb, c.ask as ca, p.bid as pb, p.ask as pa, least(c.expiration, p.expiration) as expiration from leg c join leg p on c.symbol = p.symbol and c.ts = p.ts and c.option_type = 'c' and p.option_type = 'p'),
  u as (select symbol, ts, floor(avg(strike)) as close from quotes group by 1, 2)"""


@query("b15_short_straddle", _STRADDLE + """ select pos.symbol, pos.ts, expiration, round(-((cb + ca) / 2 + (pb + pa) / 2) * 100, 4) as cost, u.close, round(-(greatest(u.close - ck, 0) + greatest(pk - u.close, 0)) * 100 + ((cb + ca) / 2 + (pb + pa) / 2) * 100, 4) as pnl,
  case when ck <= u.close then 'called_away' when pk >= u.close then 'assignment' else 'expiration' end as exit from pos asof join u on pos.symbol = u.symbol and pos.expiration::timestamp >= u.ts""")
def b15(spark, d):
    legs = S.strategy("short_straddle", 0.5, 0.5, dte=30)
    held = S.hold_to_expiration(S.resolve(I.chain(spark, d), legs), closes(spark, d))
    return held.select("symbol", "ts", "expiration", F.round("cost", 4).alias("cost"), "close", F.round("pnl", 4).alias("pnl"), "exit")


#: Deltas of a strategy's arguments, by their number.
_DELTAS = {1: (0.4,), 2: (0.5, 0.3), 3: (0.6, 0.4, 0.2), 4: (0.3, 0.1, 0.3, 0.1)}
_DTE, _FAR, _FEE = 30, 50, 0.65


def _strategy_legs(name):
    n = 1 + max(int(code[2]) for code in S.STRATEGIES[name].split())
    return S.strategy(name, *_DELTAS[n], dte=_DTE, far_dte=_FAR)


def _strategy_sql(name: str) -> str:
    """Each leg's contract by its window, side by side, valued at the earliest expiration."""
    ctes, cost, value, fate, expirations = [], [], [], [], []
    for n, leg in enumerate(_strategy_legs(name)):
        w = O.leg_window(leg.delta, leg.dte)
        ctes.append(
            f"l{n} as (select * from dq where option_type = '{leg.kind}' and abs(delta) between {w['low']!r} and {w['high']!r} and dte between {w['min_dte']} and {w['max_dte']} "
            f"qualify row_number() over (partition by symbol, ts order by abs(abs(delta) - {leg.delta!r}), strike, expiration, id) = 1)"
        )
        sign = "+" if leg.long else "-"
        cost.append(f"{sign} (l{n}.bid + l{n}.ask) / 2 * 100")
        value.append(f"{sign} greatest({f'u.close - k{n}' if leg.kind == 'c' else f'k{n} - u.close'}, 0) * 100")
        expirations.append(f"l{n}.expiration")
        if not leg.long:
            fate.append(f"when k{n} {'>=' if leg.kind == 'p' else '<='} u.close then '{'assignment' if leg.kind == 'p' else 'called_away'}'")
    many = len(expirations)
    joins = " ".join(f"join l{n} on l{n}.symbol = l0.symbol and l{n}.ts = l0.ts" for n in range(1, many))
    first = f"least({', '.join(expirations)})" if many > 1 else expirations[0]
    strikes = ", ".join(f"l{n}.strike as k{n}" for n in range(many))
    exit_ = f"case {' '.join(fate)} else 'expiration' end" if fate else "'expiration'"
    return f"""with {I.CHAIN}, dq as (select *, datediff('day', cast(ts as date), expiration) as dte from quotes where bid > 0.05 and ask > 0.05), {", ".join(ctes)},
  u as (select symbol, ts, floor(avg(strike)) as close from quotes group by 1, 2), pos as (select l0.symbol, l0.ts, {strikes}, {first} as expiration, {" ".join(cost)} as cost from l0 {joins})
  select pos.symbol, pos.ts, expiration, round(cost, 4) as cost, u.close, round({" ".join(value)}, 4) as value, round({" ".join(value)} - cost, 4) as pnl, {_FEE * many!r}::double as fee, {exit_} as exit
  from pos asof join u on pos.symbol = u.symbol and pos.expiration::timestamp >= u.ts"""


def _strategy(name):
    def run(spark, d):
        held = S.hold_to_expiration(S.resolve(I.chain(spark, d), _strategy_legs(name)), closes(spark, d), per_contract=_FEE)
        return held.select("symbol", "ts", "expiration", F.round("cost", 4).alias("cost"), "close", F.round("value", 4).alias("value"), F.round("pnl", 4).alias("pnl"), F.round("fee", 4).alias("fee"), "exit")

    return run


for _name in S.STRATEGIES:
    if _name != "short_straddle":  # above
        query(f"b15_{_name}", _strategy_sql(_name))(_strategy(_name))


@query("b11_net_delta", _STRADDLE + " select c.symbol, c.ts, round((c.delta + p.delta) * 100, 4) as net_delta from leg c join leg p on c.symbol = p.symbol and c.ts = p.ts and c.option_type = 'c' and p.option_type = 'p'")
def b11(spark, d):
    return S.resolve(I.chain(spark, d), S.strategy("long_straddle", 0.5, 0.5, dte=30)).select("symbol", "ts", F.round(S.net_delta(), 4).alias("net_delta"))


_GRID = list(range(7, 29))
_SPAN_GRID = [10, 20, 40]


def _positions_sql(windows) -> str:
    """CTEs up to `pos`: symbol, ts, window, ret, entered."""
    one = lambda n: f"""select symbol, ts, {n}::int as "window", coalesce(lag(p) over v, 0) * coalesce(ret, 0) as ret, (coalesce(lag(p) over v, 0) = 1 and coalesce(lag(p, 2) over v, 0) = 0)::int as entered
    from (select *, case when count(*) over w = {n} and close > avg(close) over w then 1 else 0 end as p from returns window w as (partition by symbol order by ts rows {n - 1} preceding)) window v as (partition by symbol order by ts)"""  # noqa: E731
    return f"{I.RETURNS}, pos as ({' union all '.join(one(n) for n in windows)})"


_SHARPE = "case when stddev_samp(ret) > 0 then avg(ret) / stddev_samp(ret) * sqrt(252) else 0 end"


@query("v2_position_sweep", f"""with {_positions_sql(_GRID)}, g as (select symbol, "window", count(*)::bigint as bars, sum(entered)::bigint as trades, product(1 + ret) - 1 as total_return, {_SHARPE} as sharpe from pos group by 1, 2)
  select symbol, "window", bars, trades, round(total_return, 5) as total_return, round(sharpe, 5) as sharpe, row_number() over (partition by symbol order by round(sharpe, 9) desc, "window")::int as rank from g""")
def v2p(spark, d):
    """A grid of 22 windows."""
    got = V.position_sweep(I.daily(spark, d), _GRID)
    return got.withColumns({"total_return": F.round("total_return", 5), "sharpe": F.round("sharpe", 5)})


_SPANS = f"""{_positions_sql(_SPAN_GRID)}, days as (select day, row_number() over (order by day) - 1 as i, count(*) over () as t from (select distinct cast(o_orderdate as date) as day from orders)),
  pq as (select distinct floor(t * 0.3 / (0.7 + 4 * 0.3))::bigint as test, t from days), q as (select *, round(test * 0.7 / 0.3)::bigint as train from pq),
  sp as (select k::int as span, k * test as a, k * test + train - 1 as b, k * test + train as c, least(k * test + train + test, t) - 1 as d from q, (select unnest(range(4)) as k)),
  spans as (select span, x.day as train_start, y.day as train_end, z.day as test_start, v.day as test_end from sp join days x on x.i = a join days y on y.i = b join days z on z.i = c join days v on v.i = d),
  parts as (select pos.*, span, 'train' as part from pos join spans on ts::date between train_start and train_end union all select pos.*, span, 'test' from pos join spans on ts::date between test_start and test_end),
  fig as (select symbol, span, part, "window", {_SHARPE} as sharpe, product(1 + ret) - 1 as total_return from parts group by 1, 2, 3, 4),
  best as (select symbol, span, "window", sharpe as in_sample from fig where part = 'train' qualify row_number() over (partition by symbol, span order by round(sharpe, 9) desc, "window") = 1)"""


def _walk(spark, d):
    bars = I.daily(spark, d)
    return V.position_walk_forward(bars, _SPAN_GRID, W.walk_forward_windows(bars.select(F.to_date("ts").alias("day")).distinct(), 4, 0.7))


@query("v4_position_walk_forward", f"""with {_SPANS} select symbol, span, "window", round(in_sample, 5) as in_sample, round(fig.sharpe, 5) as out_of_sample, round(fig.total_return, 5) as test_return
  from best left join (select * from fig where part = 'test') fig using (symbol, span, "window")""")
def v4p(spark, d):
    return _walk(spark, d)[0].withColumns({c: F.round(c, 5) for c in ("in_sample", "out_of_sample", "test_return")})


@query("v4_stitched_curve", f"""with {_SPANS} select symbol, ts, span, "window", round(product(1 + ret) over (partition by symbol order by span, ts), 5) as equity from parts join best using (symbol, span, "window") where part = 'test'""")
def v4c(spark, d):
    return _walk(spark, d)[1].withColumn("equity", F.round("equity", 5))


@query("v2_grid_sweep")
def v2(spark, d):
    return V.sweep(I.daily(spark, d), V.grid(spark, {"window": V.steps(10, 40, 10)}), crossing, S.Rules())


@query("v4_walk_forward")
def v4(spark, d):
    days = I.daily(spark, d).select(F.to_date("ts").alias("day")).distinct()
    return V.walk_forward(I.daily(spark, d), W.walk_forward_windows(days, 4, 0.7), V.grid(spark, {"window": [10.0, 30.0]}), crossing, S.Rules())



def _days(spark, d):
    return I.daily(spark, d).select(F.to_date("ts").alias("day")).distinct()


@query("v5_gates")
def v5(spark, d):
    return V.gates(I.daily(spark, d), _days(spark, d), V.grid(spark, {"window": [10.0, 30.0]}), crossing, S.Rules())


@query("v6_evaluation")
def v6(spark, d):
    return V.evaluate(I.daily(spark, d), _days(spark, d), V.grid(spark, {"window": [10.0, 30.0]}), crossing, S.Rules())


@query("v3_bayesian_search")
def v3(spark, d):
    """The points tried for the window, a batch of them a job; the objective is the symbols' mean."""
    bars = I.daily(spark, d).cache()

    def evaluate(points):
        combos = spark.createDataFrame([(k, p) for k, p in enumerate(points)], "combo int, params map<string,double>")
        got = {r["combo"]: r["sharpe"] for r in V.sweep(bars, combos, crossing, S.Rules()).groupBy("combo").agg(F.avg("sharpe").alias("sharpe")).collect()}
        return [got.get(k) for k in range(len(points))]

    tried = V.bayesian(evaluate, {"window": (5.0, 45.0, 5.0)}, evaluations=8, initial=4)
    return spark.createDataFrame([(p["window"], float(v)) for p, v in tried], "window double, sharpe double")


@query("b7_wheel")
def b7(spark, d):
    q = I.chain(spark, d)
    return S.wheel(S.resolve(q, S.strategy("short_put", 0.4, dte=30)), S.resolve(q, S.strategy("short_call", 0.4, dte=30)), closes(spark, d))
