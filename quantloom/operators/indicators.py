"""Technical indicators, by name and parameters: "sma:20", "macd_hist", "supertrend:10:30".

`add` computes any number of them in one pass of windows a dependency level.  An indicator is
null until its window is full.  Averages are evaluated over their window alone:

* ema(n): weights (1 - 2 / (n + 1)) ** age over the last n values, normalised;
* smoothed(n): the same with 1 / n;
* rsi, cmo, mfi: over the changes among the last n bars (n - 1 of them);
* atr(n): smoothed true range of the last n bars; a symbol's first bar has high - low;
* adx, plus_di, minus_di (n): smoothed movements over smoothed true range, adx the mean of n.

Multipliers are whole numbers ten times their value (psar: a hundred times).  psar and
supertrend carry a state from bar to bar and run as grouped pandas functions, a symbol at a
time; all others are window expressions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from quantloom.operators import blocks
from quantloom.operators.windows import full, order, percentile_rank, range_rank, trailing

#: Default parameters of each indicator (fixed values).
DEFAULTS: dict[str, tuple[int, ...]] = {
    "sma": (20,), "ema": (20,), "rsi": (14,), "atr": (14,), "macd_line": (12, 26, 9), "macd_signal": (12, 26, 9), "macd_hist": (12, 26, 9),
    "bbands_upper": (20, 20), "bbands_mid": (20, 20), "bbands_lower": (20, 20), "stochastic": (14,), "cci": (20,), "obv": (), "adx": (14,), "plus_di": (14,), "minus_di": (14,),
    "psar": (2, 20), "tr": (), "supertrend": (10, 30), "keltner_upper": (20, 20), "keltner_lower": (20, 20), "donchian_upper": (20,), "donchian_mid": (20,), "donchian_lower": (20,),
    "williams_r": (14,), "ppo": (12, 26), "cmo": (14,), "mfi": (14,), "vpt": (), "roc": (12,), "rank": (252,), "iv_rank": (252,), "cmf": (20,), "change": (1,), "pct_change": (1,),
    "std": (20,), "max": (20,), "min": (20,), "consecutive_up": (), "consecutive_down": (),
}
NAMES = tuple(DEFAULTS)
#: Names that stand for several indicators.
FAMILIES = {
    "macd": ("macd_line", "macd_signal", "macd_hist"), "bbands": ("bbands_upper", "bbands_mid", "bbands_lower"), "keltner": ("keltner_upper", "keltner_lower"),
    "donchian": ("donchian_upper", "donchian_mid", "donchian_lower"),
}


def parse(text: str) -> list[tuple[str, tuple[int, ...]]]:
    """(name, parameters) of a declaration; a family gives all its members.  Missing parameters take the defaults."""
    name, *rest = text.strip().lower().split(":")
    given = tuple(int(x) for x in rest)
    out = []
    for n in FAMILIES.get(name, (name,)):
        if n not in DEFAULTS:
            raise ValueError(f"unknown indicator {name!r}")
        if len(given) > len(DEFAULTS[n]):
            raise ValueError(f"too many parameters: {text!r}")
        parameters = given + DEFAULTS[n][len(given) :]
        if any(p < 1 for p in parameters):
            raise ValueError(f"parameters are 1 or more: {text!r}")
        out.append((n, parameters))
    return out


def column_name(name: str, parameters: tuple[int, ...]) -> str:
    return "_".join([name, *map(str, parameters)])


def _aged(x: str, n: int, frame: WindowSpec, keep: float) -> Column:
    """The sum of a frame of n rows at most with weights keep ** age, without a list: null values count as 0.

    Rows carry keep ** -place in chunks of n rows; a frame meets two chunks, an even and an odd one.
    """
    if keep <= 0:
        return F.coalesce(F.col(x), F.lit(0.0))
    at, odd = F.pmod("__i", F.lit(n)), F.pmod(F.floor(F.col("__i") / n), F.lit(2)) == 1
    grown = F.col(x) * F.pow(F.lit(1 / keep), at)
    evens, odds = (F.coalesce(F.sum(F.when(c, grown)).over(frame), F.lit(0.0)) for c in (~odd, odd))
    here, before = F.when(odd, odds).otherwise(evens), F.when(odd, evens).otherwise(odds)
    return F.pow(F.lit(keep), at) * (here + keep**n * before)


def weighted(x: str, n: int, alpha: float) -> Column:
    """The normalised mean of the last n values with weights (1 - alpha) ** age; null until there are n."""
    keep = 1 - alpha
    norm = sum(keep**i for i in range(n))
    return F.when(F.count(x).over(trailing(n)) == n, _aged(x, n, trailing(n), keep) / norm)


def ema(x: str, n: int) -> Column:
    return weighted(x, n, 2 / (n + 1))


def smoothed(x: str, n: int) -> Column:
    return weighted(x, n, 1 / n)


def ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    out = F.when(b != 0, a / F.when(b != 0, b))
    return out if otherwise is None else out.otherwise(F.when(b.isNotNull() & a.isNotNull(), otherwise))


#: Columns that indicators are built from, in levels: each level uses only the ones before.
_BASE: list[dict[str, Callable[[], Column]]] = [
    {
        "__pc": lambda: F.lag("close").over(order()),
        "__ph": lambda: F.lag("high").over(order()),
        "__pl": lambda: F.lag("low").over(order()),
        "__tp": lambda: (F.col("high") + F.col("low") + F.col("close")) / 3,
    },
    {
        "__chg": lambda: F.col("close") - F.col("__pc"),
        "__tr": lambda: F.when(F.col("__pc").isNull(), F.col("high") - F.col("low")).otherwise(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("__pc")), F.abs(F.col("low") - F.col("__pc")))),
        "__ptp": lambda: F.lag("__tp").over(order()),
        "__up": lambda: F.when((F.col("high") - F.col("__ph") > F.col("__pl") - F.col("low")) & (F.col("high") > F.col("__ph")), F.col("high") - F.col("__ph")).otherwise(0.0),
        "__dn": lambda: F.when((F.col("__pl") - F.col("low") > F.col("high") - F.col("__ph")) & (F.col("low") < F.col("__pl")), F.col("__pl") - F.col("low")).otherwise(0.0),
        "__clv": lambda: F.when(F.col("high") > F.col("low"), (2 * F.col("close") - F.col("low") - F.col("high")) / F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low"))).otherwise(0.0) * F.col("volume"),
    },
    {
        "__gain": lambda: F.when(F.col("__chg").isNotNull(), F.greatest(F.col("__chg"), F.lit(0.0))),
        "__loss": lambda: F.when(F.col("__chg").isNotNull(), F.greatest(-F.col("__chg"), F.lit(0.0))),
        "__in": lambda: F.when(F.col("__tp") > F.col("__ptp"), F.col("__tp") * F.col("volume")).otherwise(0.0),
        "__out": lambda: F.when(F.col("__tp") < F.col("__ptp"), F.col("__tp") * F.col("volume")).otherwise(0.0),
    },
]


def _over(n: int):
    """The changes among the last n bars."""
    return order().rowsBetween(2 - n, 0)


def _whole(x: Column, n: int) -> Column:
    return F.when(F.col("__i") >= n - 1, x)


def _change_mean(x: str, n: int) -> Column:
    """The smoothed mean of the changes among the last n bars (not normalised: both sides of a ratio have them)."""
    return _aged(x, n, _over(n), 1 - 1 / n)


def _simple(name: str, p: tuple[int, ...]) -> dict[str, Column] | None:
    """Indicators that need one level on the base columns."""
    n = p[0] if p else 1
    w, close = trailing(n), F.col("close")
    at = lambda c: {column_name(name, p): c}
    if name == "sma":
        return at(full(F.avg("close").over(w), n))
    if name == "ema":
        return at(ema("close", n))
    if name == "rsi":
        g, x = _change_mean("__gain", n), _change_mean("__loss", n)
        return at(_whole(F.when(g + x > 0, 100 * g / F.when(g + x > 0, g + x)).otherwise(50.0), n))
    if name == "atr":
        return at(smoothed("__tr", n))
    if name.startswith("bbands"):
        mid, dev = F.avg("close").over(w), F.stddev_pop("close").over(w) * (p[1] / 10)
        return at(full({"upper": mid + dev, "mid": mid, "lower": mid - dev}[name[7:]], n))
    if name == "cci":
        mean = F.avg("__tp").over(w)
        mad = F.aggregate(F.collect_list("__tp").over(w), F.lit(0.0), lambda acc, v: acc + F.abs(v - mean)) / n
        return at(full(ratio(F.col("__tp") - mean, 0.015 * mad, 0.0), n))
    if name in ("plus_di", "minus_di"):
        return at(_whole(100 * ratio(smoothed("__up" if name == "plus_di" else "__dn", n), smoothed("__tr", n), 0.0), n + 1))
    if name == "tr":
        return at(F.when(F.col("__i") >= 1, F.col("__tr")))
    if name.startswith("keltner"):
        return at(ema("close", n) + (1 if name == "keltner_upper" else -1) * p[1] / 10 * smoothed("__tr", n))
    if name.startswith("donchian"):
        high, low = F.max("high").over(w), F.min("low").over(w)
        return at(full({"upper": high, "mid": (high + low) / 2, "lower": low}[name[9:]], n))
    if name == "williams_r":
        high, low = F.max("high").over(w), F.min("low").over(w)
        return at(full(-100 * ratio(high - close, high - low, 0.0), n))
    if name == "ppo":
        return at(100 * (ema("close", p[0]) / ema("close", p[1]) - 1))
    if name in ("cmo", "mfi"):
        a, b = (F.sum(c).over(_over(n)) for c in (("__gain", "__loss") if name == "cmo" else ("__in", "__out")))
        return at(_whole(100 * ratio(a - b if name == "cmo" else a, a + b, 0.0 if name == "cmo" else 50 / 100), n))
    if name == "roc":
        return at((F.try_divide("close", F.lag("close", n).over(order())) - 1) * 100)
    if name == "iv_rank":
        return at(range_rank("close", n))
    if name == "cmf":
        return at(full(ratio(F.sum("__clv").over(w), F.sum("volume").over(w), 0.0), n))
    if name == "change":
        return at(close - F.lag("close", n).over(order()))
    if name == "pct_change":
        return at(F.try_divide("close", F.lag("close", n).over(order())) - 1)
    if name in ("std", "max", "min"):
        return at(full({"std": F.stddev_pop, "max": F.max, "min": F.min}[name]("close").over(w), n))
    return None


def _psar(step: float, most: float) -> Callable[[pd.DataFrame], np.ndarray]:
    def run(b: pd.DataFrame) -> np.ndarray:
        """Starts long at the first low; turns when a bar crosses the stop, which trails the last extreme."""
        high, low = b["high"].to_numpy(), b["low"].to_numpy()
        out = np.full(len(b), np.nan)
        long, stop, extreme, pace = True, low[0], high[0], step
        out[0] = stop
        for i in range(1, len(b)):
            stop += pace * (extreme - stop)
            stop = min(stop, *low[max(0, i - 2) : i]) if long else max(stop, *high[max(0, i - 2) : i])
            if (low[i] < stop) if long else (high[i] > stop):
                long, stop, extreme, pace = not long, extreme, low[i] if long else high[i], step
            elif (high[i] > extreme) if long else (low[i] < extreme):
                extreme, pace = high[i] if long else low[i], min(pace + step, most)
            out[i] = stop
        return out

    return run


def _supertrend(n: int, times: float) -> Callable[[pd.DataFrame], np.ndarray]:
    def run(b: pd.DataFrame) -> np.ndarray:
        """Bands of the middle price +- times the mean true range; the band on the trend's side only tightens."""
        high, low, close = (b[c].to_numpy() for c in ("high", "low", "close"))
        tr = np.maximum(high - low, np.maximum(abs(high - np.roll(close, 1)), abs(low - np.roll(close, 1))))
        tr[0] = high[0] - low[0]
        atr = pd.Series(tr).rolling(n).mean().to_numpy()
        out, upper, lower, up = np.full(len(b), np.nan), np.inf, -np.inf, True
        for i in range(n - 1, len(b)):
            mid = (high[i] + low[i]) / 2
            before = close[i - 1] if i else close[i]
            top, bottom = mid + times * atr[i], mid - times * atr[i]
            upper = top if top < upper or before > upper else upper
            lower = bottom if bottom > lower or before < lower else lower
            up = close[i] >= lower if up else close[i] > upper
            out[i] = lower if up else upper
        return out

    return run


#: Running sums, of values that look at their own row.
_SUMS: dict[str, Callable[[], Column]] = {
    "obv": lambda: F.coalesce(F.signum("__chg") * F.col("volume"), F.lit(0.0)),
    "vpt": lambda: F.coalesce(F.col("volume") * F.try_divide("__chg", "__pc"), F.lit(0.0)),
}
_RUNS: dict[str, Callable[[], Column]] = {"consecutive_up": lambda: F.col("__chg") > 0, "consecutive_down": lambda: F.col("__chg") < 0}


def add(bars: DataFrame, declarations: list[str], span: str = "month", size: int | None = None) -> DataFrame:
    """`bars` with a column for each declared indicator, named by `column_name`.

    A symbol's bars are computed in blocks, running sums and streaks with values handed on from block to
    block (span, size: as in `blocks`), so a long series uses many tasks.  Only psar and supertrend, whose state
    depends on every bar before, walk through a symbol's bars in one task: three prices a bar, about 100 bytes
    of a worker's memory each.
    """
    wanted = list(dict.fromkeys(x for d in declarations for x in parse(d)))
    levels: list[dict[str, Column]] = [{k: f() for k, f in level.items()} for level in _BASE]
    first: dict[str, Column] = {}
    second: dict[str, Column] = {}
    third: dict[str, Column] = {}
    sums, streaks, ranks, stateful = {}, {}, {}, {}
    for name, p in wanted:
        key = column_name(name, p)
        simple = _simple(name, p)
        if simple is not None:
            first |= simple
        elif name.startswith("macd"):
            line = f"__macd_{p[0]}_{p[1]}"
            first[line] = ema("close", p[0]) - ema("close", p[1])
            signal = ema(line, p[2])
            second[key] = {"macd_line": F.col(line), "macd_signal": signal, "macd_hist": F.col(line) - signal}[name]
        elif name == "stochastic":
            w, raw = trailing(p[0]), f"__k_{p[0]}"
            low, high = F.min("close").over(w), F.max("close").over(w)
            first[raw] = full(100 * ratio(F.col("close") - low, high - low, 0.5), p[0])
            second[key] = full(F.avg(raw).over(trailing(3)), 3, F.col(raw))
        elif name == "adx":
            up, down, dx = f"__pdi_{p[0]}", f"__mdi_{p[0]}", f"__dx_{p[0]}"
            first |= {up: _simple("plus_di", p)[column_name("plus_di", p)], down: _simple("minus_di", p)[column_name("minus_di", p)]}
            second[dx] = 100 * ratio(F.abs(F.col(up) - F.col(down)), F.col(up) + F.col(down), 0.0)
            third[key] = full(F.avg(dx).over(trailing(p[0])), p[0], F.col(dx))
        elif name in _SUMS:
            sums[key] = ("sum", _SUMS[name]())
        elif name in _RUNS:
            streaks[key] = _RUNS[name]()
        elif name == "rank":
            ranks[key] = p[0]
        else:
            stateful[key] = _psar(p[0] / 100, p[1] / 100) if name == "psar" else _supertrend(p[0], p[1] / 10)

    def windows(*parts: dict[str, Column]) -> Callable[[DataFrame], DataFrame]:
        def apply(rows: DataFrame) -> DataFrame:
            for level in parts:
                rows = rows.withColumns(level) if level else rows
            return rows

        return apply

    reach = 4 + 2 * max((sum(p) for _, p in wanted), default=0)  # over the levels; more border rows change nothing
    place = {"span": span, "size": size}
    placed = blocks.placed(bars, span=span)
    rows = blocks.in_blocks(placed, windows(*levels, first, second, third), reach, **place)
    # What reads its rows twice does so on a few columns of its own.
    beside = []
    if sums or streaks:
        side = blocks.in_blocks(placed.select("symbol", "ts", "high", "low", "close", "volume", "__i"), windows(*levels), 4, **place)
        has = {k: F.coalesce(c, F.lit(False)) for k, c in streaks.items()}
        side = blocks.running(side, sums | {f"__{k}": ("max", F.when(~c, F.col("__i"))) for k, c in has.items()}, **place)
        lengths = {k: F.when(c, F.col("__i") - F.coalesce(f"__{k}", F.lit(-1))).otherwise(0).cast("double") for k, c in has.items()}
        seen = {k: F.when(F.col("__i") >= 1, F.col(k)) for k in sums if k == "obv"}
        beside.append(side.withColumns(lengths | seen).select(F.col("symbol").alias("__s"), F.col("__i").alias("__j"), *sums, *streaks))
    for key, n in ranks.items():
        side = percentile_rank(placed.select("symbol", "ts", "close", "__i"), "close", n, key, **place)
        beside.append(side.select(F.col("symbol").alias("__s"), F.col("__i").alias("__j"), key))
    for side in beside:
        rows = rows.join(side, F.col("symbol").eqNullSafe(F.col("__s")) & (F.col("__i") == F.col("__j"))).drop("__s", "__j")
    out = rows.select(*bars.columns, *[column_name(name, p) for name, p in wanted if column_name(name, p) not in stateful])
    if stateful:
        # The walk reads three prices; its columns are joined to the rest (one bar a symbol and time).
        schema = ", ".join(["symbol string", "ts timestamp_ntz", *[f"`{k}` double" for k in stateful]])

        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("ts", kind="stable")
            return pd.DataFrame({"symbol": group["symbol"], "ts": group["ts"], **{k: f(group) for k, f in stateful.items()}})

        walked = bars.select("symbol", "ts", "high", "low", "close").groupBy("symbol").applyInPandas(run, schema)
        out = out.join(walked, ["symbol", "ts"], "left").select(*out.columns, *stateful)
        out = out.withColumns({k: F.nanvl(k, F.lit(None).cast("double")) for k in stateful})
    return out
