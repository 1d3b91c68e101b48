"""One query an indicator, on daily bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import indicators as N
from quantloom.plans import _inputs as I
from quantloom.plans._registry import Registry

query = Registry()

_C = I.BARS + """, c0 as (select *, row_number() over v as i, lag(close) over v as pc, lag(high) over v as ph, lag(low) over v as pl, (high + low + close) / 3 as tp from bars window v as (partition by symbol order by ts)),
  c1 as (select *, close - pc as chg, case when pc is null then high - low else greatest(high - low, abs(high - pc), abs(low - pc)) end as tr, lag(tp) over (partition by symbol order by ts) as ptp,
    case when high - ph > pl - low and high > ph then high - ph else 0 end as up, case when pl - low > high - ph and low < pl then pl - low else 0 end as dn,
    case when high > low then (2 * close - low - high) / (high - low) else 0 end * volume as clv from c0),
  c as (select *, greatest(chg, 0) as gain, greatest(-chg, 0) as loss, case when tp > ptp then tp * volume else 0 end as inn, case when tp < ptp then tp * volume else 0 end as outt from c1)"""


def w(n: int, extra: int = 0) -> str:
    return f"over (partition by symbol order by ts rows between {n - 1 - extra} preceding and current row)"


RUN = "over (partition by symbol order by ts rows unbounded preceding)"


def full(x: str, n: int) -> str:
    return f"case when i >= {n} then {x} end"


def weighted(x: str, n: int, alpha: float, extra: int = 0) -> str:
    norm = sum((1 - alpha) ** k for k in range(n))
    return f"list_sum(list_transform(list({x}) {w(n, extra)}, lambda e, k: e * pow({1 - alpha!r}, {n - extra} - k))) / {norm!r}"


def ema(x: str, n: int) -> str:
    return full(weighted(x, n, 2 / (n + 1)), n)


def smoothed(x: str, n: int) -> str:
    return full(weighted(x, n, 1 / n), n)


_G, _L = (weighted(x, 14, 1 / 14, 1) for x in ("gain", "loss"))
_DI = {k: full(f"100 * ({weighted(x, 14, 1 / 14)}) / ({weighted('tr', 14, 1 / 14)})", 15) for k, x in (("plus_di", "up"), ("minus_di", "dn"))}

_SQL = {
    "sma:20": full(f"avg(close) {w(20)}", 20),
    "ema:20": ema("close", 20),
    "rsi:14": full(f"case when {_G} + {_L} > 0 then 100 * ({_G}) / ({_G} + {_L}) else 50 end", 14),
    "atr:14": smoothed("tr", 14),
    "bbands_upper:20:20": full(f"avg(close) {w(20)} + 2 * stddev_pop(close) {w(20)}", 20),
    "bbands_mid:20:20": full(f"avg(close) {w(20)}", 20),
    "bbands_lower:20:20": full(f"avg(close) {w(20)} - 2 * stddev_pop(close) {w(20)}", 20),
    "obv": f"case when i > 1 then sum(coalesce(sign(chg) * volume, 0)::double) {RUN} end",
    "plus_di:14": _DI["plus_di"],
    "minus_di:14": _DI["minus_di"],
    "tr": "case when i > 1 then tr end",
    "keltner_upper:20:20": f"{ema('close', 20)} + 2 * {smoothed('tr', 20)}",
    "keltner_lower:20:20": f"{ema('close', 20)} - 2 * {smoothed('tr', 20)}",
    "donchian_upper:20": full(f"max(high) {w(20)}", 20),
    "donchian_mid:20": full(f"(max(high) {w(20)} + min(low) {w(20)}) / 2", 20),
    "donchian_lower:20": full(f"min(low) {w(20)}", 20),
    "williams_r:14": full(f"-100 * (max(high) {w(14)} - close) / (max(high) {w(14)} - min(low) {w(14)})", 14),
    "ppo:12:26": f"100 * ({ema('close', 12)} / {ema('close', 26)} - 1)",
    "cmo:14": full(f"100 * (sum(gain) {w(14, 1)} - sum(loss) {w(14, 1)}) / (sum(gain) {w(14, 1)} + sum(loss) {w(14, 1)})", 14),
    "mfi:14": full(f"100 * (sum(inn) {w(14, 1)}) / (sum(inn) {w(14, 1)} + sum(outt) {w(14, 1)})", 14),
    "vpt": f"sum(coalesce(volume * chg / pc, 0)) {RUN}",
    "roc:12": "(close / lag(close, 12) over (partition by symbol order by ts) - 1) * 100",
    "iv_rank:252": full(f"case when max(close) {w(252)} > min(close) {w(252)} then (close - min(close) {w(252)}) / (max(close) {w(252)} - min(close) {w(252)}) * 100 else 50 end", 252),
    "cmf:20": full(f"sum(clv) {w(20)} / sum(volume) {w(20)}", 20),
    "change:1": "close - lag(close, 1) over (partition by symbol order by ts)",
    "pct_change:1": "close / lag(close, 1) over (partition by symbol order by ts) - 1",
    "std:20": full(f"stddev_pop(close) {w(20)}", 20),
    "max:20": full(f"max(close) {w(20)}", 20),
    "min:20": full(f"min(close) {w(20)}", 20),
}
_NESTED = {
    "macd_line:12:26:9": (f"{ema('close', 12)} - {ema('close', 26)}", "x"),
    "macd_signal:12:26:9": (f"{ema('close', 12)} - {ema('close', 26)}", f"case when i >= 34 then {weighted('x', 9, 0.2)} end"),
    "macd_hist:12:26:9": (f"{ema('close', 12)} - {ema('close', 26)}", f"case when i >= 34 then x - {weighted('x', 9, 0.2)} end"),
    "stochastic:14": (full(f"100 * (close - min(close) {w(14)}) / (max(close) {w(14)} - min(close) {w(14)})", 14), f"case when i >= 16 then avg(x) {w(3)} end"),
    "cci:20": (f"list(tp) {w(20)}", "case when i >= 20 then (tp - list_avg(x)) / (0.015 * list_avg(list_transform(x, lambda e: abs(e - list_avg(x))))) end"),
    "adx:14": (f"100 * abs({_DI['plus_di']} - {_DI['minus_di']}) / ({_DI['plus_di']} + {_DI['minus_di']})", f"case when i >= 28 then avg(x) {w(14)} end"),
    "rank:252": (f"list(close) {w(252)}", "case when i >= 252 then len(list_filter(x, lambda e: e < close)) / 251.0 * 100 end"),
    "consecutive_up": (f"max(case when chg > 0 then 0 else i end) {RUN}", "case when chg > 0 then i - x else 0 end::double"),
    "consecutive_down": (f"max(case when chg < 0 then 0 else i end) {RUN}", "case when chg < 0 then i - x else 0 end::double"),
}


#: Walks from bar to bar, as recursive queries.
_WALKS = {
    "psar:2:20": f"""with recursive {_C}, b as (select symbol, ts, i, high, low, lag(low) over v as l1, coalesce(lag(low, 2) over v, lag(low) over v) as l2, lag(high) over v as h1, coalesce(lag(high, 2) over v, lag(high) over v) as h2
    from c window v as (partition by symbol order by ts)),
  walk(symbol, ts, i, long, stop, extreme, pace) as (
    select symbol, ts, i, true, low, high, 0.02::double from b where i = 1
    union all select symbol, ts, i, long <> flip, case when flip then extreme else s end, case when flip then case when long then low else high end when further then case when long then high else low end else extreme end,
      case when flip then 0.02 when further then least(pace + 0.02, 0.2) else pace end
    from (select *, case when long then low < s else high > s end as flip, case when long then high > extreme else low < extreme end as further from (
      select b.*, w.long, w.extreme, w.pace, case when w.long then least(w.stop + w.pace * (w.extreme - w.stop), l1, l2) else greatest(w.stop + w.pace * (w.extreme - w.stop), h1, h2) end as s
      from walk w join b on b.symbol = w.symbol and b.i = w.i + 1)))
  select symbol, ts, round(stop, 4) as value from walk""",
    "supertrend:10:30": f"""with recursive {_C}, b as (select symbol, ts, i, close, pc, (high + low) / 2 + 3 * avg(tr) {w(10)} as top, (high + low) / 2 - 3 * avg(tr) {w(10)} as bottom from c),
  walk(symbol, ts, i, upper, lower, up) as (
    select symbol, ts, i, top, bottom, close >= bottom from b where i = 10
    union all select symbol, ts, i, u, l, case when up then close >= l else close > u end
    from (select b.symbol, b.ts, b.i, b.close, w.up, case when top < w.upper or pc > w.upper then top else w.upper end as u, case when bottom > w.lower or pc < w.lower then bottom else w.lower end as l
      from walk w join b on b.symbol = w.symbol and b.i = w.i + 1))
  select b.symbol, b.ts, round(case when up then lower else upper end, 4) as value from b left join walk w on w.symbol = b.symbol and w.i = b.i""",
}


def _query(declaration: str):
    (name, p), = N.parse(declaration)
    column = N.column_name(name, p)

    def run(spark, d):
        return N.add(I.daily(spark, d), [declaration]).select("symbol", "ts", F.round(column, 4).alias("value"))

    return name, run


for _d in [*_SQL, *_NESTED, *_WALKS]:
    _name, _run = _query(_d)
    _sql = None
    if _d in _SQL:
        _sql = f"with {_C} select symbol, ts, round({_SQL[_d]}, 4) as value from c"
    elif _d in _NESTED:
        _sql = f"with {_C}, n as (select *, {_NESTED[_d][0]} as x from c) select symbol, ts, round({_NESTED[_d][1]}, 4) as value from n"
    elif _d in _WALKS:
        _sql = _WALKS[_d]
    query(f"i{N.NAMES.index(_name) + 1:02d}_{_name}", _sql)(_run)


@query("i_all_at_once")
def every(spark, d):
    """All indicators in one plan."""
    return N.add(I.daily(spark, d), list(N.NAMES))
