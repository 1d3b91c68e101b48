"""Backtests: order fills, positions bar by bar, option strategies, metrics.

What does not depend on the positions - indicators, conditions, contracts, quotes - is
columns and joins made beforehand, for all symbols and parameter sets at once.  Only the
walk along the bars, where an exit depends on the entry before it, is a small function on
one (symbol, combo) group.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.pricing import commission, fill_price
from quantloom.operators import options as O
from quantloom.operators.bars import asof_join


def fill(kind: str, buy: Column, limit: Column | None = None, stop: Column | None = None) -> Column:
    """The price at which an order fills on a bar (open, high, low), or null.

    market: open.  limit: buy if low <= limit at min(limit, open), sell if high >= limit at
    max(limit, open).  stop: buy if high >= stop at max(stop, open), sell if low <= stop at
    min(stop, open).  stop_limit: both must be reached; buy at min(limit, max(stop, open)), sell
    at max(limit, min(stop, open)); a pair that contradicts itself never fills.
    """
    o, h, lo = F.col("open"), F.col("high"), F.col("low")
    if kind == "market":
        return o
    if kind == "limit":
        return F.when(buy & (lo <= limit), F.least(limit, o)).when(~buy & (h >= limit), F.greatest(limit, o))
    if kind == "stop":
        return F.when(buy & (h >= stop), F.greatest(stop, o)).when(~buy & (lo <= stop), F.least(stop, o))
    if kind == "stop_limit":
        up = buy & (stop <= limit) & (h >= stop) & (lo <= limit)
        down = ~buy & (stop >= limit) & (lo <= stop) & (h >= limit)
        return F.when(up, F.least(limit, F.greatest(stop, o))).when(down, F.greatest(limit, F.least(stop, o)))
    raise ValueError(kind)


@dataclass(frozen=True)
class Rules:
    """How a long stock position is opened and closed.

    Orders queued by a bar's conditions fill on the next bar's open.  stop_loss and
    profit_target are orders from the fill on (parts of the fill price), trailing_stop closes
    when the price gives back a part of its best since entry; days is the longest holding,
    most_shares the largest position.
    """

    capital: float = 100_000.0
    fraction: float = 1.0
    stop_loss: float | None = None
    profit_target: float | None = None
    trailing_stop: float | None = None
    days: int | None = None
    slippage: float = 0.0
    most_shares: int = 1_000_000_000
    close_at_end: bool = True


TRADES = "symbol string, combo int, entry_ts timestamp_ntz, exit_ts timestamp_ntz, quantity long, entry_price double, exit_price double, pnl double, days int, reason string"


def _walk(bars: pd.DataFrame, rules: Rules) -> list[tuple]:
    """The trades of one group's bars (ts, open, high, low, close, enter, leave), in order.

    Within a bar: pending orders fill, then stop and target (the stop first), then the
    trailing stop, then new orders are queued; the last bar queues none.  An exit condition
    counts from the second bar after the fill, when a day has passed.
    """
    trades, cash, position, pending = [], rules.capital, None, None
    rows = list(bars.itertuples(index=False))
    for n, b in enumerate(rows):
        if pending == "enter" and position is None:
            price = b.open + rules.slippage
            quantity = int(min(cash * rules.fraction // price, rules.most_shares))
            if quantity > 0:
                position = {"ts": b.ts, "price": price, "quantity": quantity, "best": price, "held": 0}
        exit_price, reason = None, None
        if position is not None:
            entry = position["price"]
            stop = entry * (1 - rules.stop_loss) if rules.stop_loss else None
            target = entry * (1 + rules.profit_target) if rules.profit_target else None
            if pending == "leave":
                exit_price, reason = b.open - rules.slippage, "signal"
            elif position["ts"] != b.ts and stop is not None and b.low <= stop:
                exit_price, reason = min(stop, b.open), "stop_loss"
            elif position["ts"] != b.ts and target is not None and b.high >= target:
                exit_price, reason = max(target, b.open), "profit_target"
            elif rules.trailing_stop and position["held"] > 0 and b.close <= position["best"] * (1 - rules.trailing_stop):
                exit_price, reason = b.close - rules.slippage, "trailing_stop"
            elif rules.days and (b.ts - position["ts"]).days >= rules.days:
                exit_price, reason = b.close - rules.slippage, "max_hold"
            elif n == len(rows) - 1 and rules.close_at_end:
                exit_price, reason = b.close, "end_of_data"
        if exit_price is not None:
            pnl = (exit_price - position["price"]) * position["quantity"]
            trades.append((position["ts"], b.ts, position["quantity"], position["price"], exit_price, pnl, (b.ts - position["ts"]).days, reason))
            cash, position = cash + pnl, None
        pending = None
        if n < len(rows) - 1:
            if position is None and b.enter:
                pending = "enter"
            elif position is not None and b.leave and position["held"] > 0:
                pending = "leave"
        if position is not None:
            position["best"] = max(position["best"], b.close)
            position["held"] = (b.ts - position["ts"]).days
    return trades


def backtest(signals: DataFrame, rules: Rules) -> DataFrame:
    """Trades of every symbol and combo.  signals: symbol, combo, ts, open, high, low, close, enter, leave (conditions as columns)."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        found = _walk(group.sort_values("ts", kind="stable"), rules)
        names = ["entry_ts", "exit_ts", "quantity", "entry_price", "exit_price", "pnl", "days", "reason"]
        out = pd.DataFrame(found, columns=names)
        out.insert(0, "combo", int(key[1]))
        out.insert(0, "symbol", key[0])
        return out

    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    rows = signals.select("symbol", "combo", "ts", "open", "high", "low", "close", flag("enter"), flag("leave"))
    return rows.groupBy("symbol", "combo").applyInPandas(run, TRADES)


def equity(trades: DataFrame, bars: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """symbol, combo, ts, equity: the capital, closed results, and the open position at each close."""
    combos = trades.select("symbol", "combo").distinct()
    grid = bars.select("symbol", "ts", "close").join(combos, "symbol")
    t = trades.select("symbol", "combo", "entry_ts", "exit_ts", "quantity", "entry_price", "pnl")
    closed = t.select("symbol", "combo", F.col("exit_ts").alias("ts"), "pnl").groupBy("symbol", "combo", "ts").agg(F.sum("pnl").alias("pnl"))
    w = Window.partitionBy("symbol", "combo").orderBy("ts")
    curve = grid.join(closed, ["symbol", "combo", "ts"], "left").withColumn("done", F.sum(F.coalesce("pnl", F.lit(0.0))).over(w))
    opened = asof_join(curve.select("symbol", "combo", "ts", "close", "done"), t.withColumn("ts", F.col("entry_ts")).select("symbol", "combo", "ts", "exit_ts", "quantity", "entry_price"), ["symbol", "combo"], ["exit_ts", "quantity", "entry_price"])
    live = F.when(F.col("ts") < F.col("exit_ts"), (F.col("close") - F.col("entry_price")) * F.col("quantity")).otherwise(0.0)
    return opened.select("symbol", "combo", "ts", (capital + F.col("done") + live).alias("equity"))


# Option strategies --------------------------------------------------------------------------


@dataclass(frozen=True)
class Leg:
    """long or short, c or p, target delta and days; quantity per unit."""

    long: bool
    kind: str
    delta: float = 0.30
    dte: int = 45
    quantity: int = 1


#: Legs of each strategy: L or S, C or P, the number of the delta argument, N(ear) or F(ar) (fixed values).
STRATEGIES: dict[str, str] = {
    "long_call": "LC0N", "short_call": "SC0N", "long_put": "LP0N", "short_put": "SP0N", "covered_call": "SC0N",
    "bull_call_spread": "LC0N SC1N", "bear_call_spread": "SC0N LC1N", "bull_put_spread": "SP0N LP1N", "bear_put_spread": "LP0N SP1N",
    "long_straddle": "LC0N LP1N", "short_straddle": "SC0N SP1N", "long_strangle": "LP0N LC1N", "short_strangle": "SP0N SC1N",
    "long_call_butterfly": "LC0N SC1N SC1N LC2N", "short_call_butterfly": "SC0N LC1N LC1N SC2N", "long_put_butterfly": "LP0N SP1N SP1N LP2N", "short_put_butterfly": "SP0N LP1N LP1N SP2N",
    "long_call_condor": "LC0N SC1N SC2N LC3N", "short_call_condor": "SC0N LC1N LC2N SC3N", "long_put_condor": "LP0N SP1N SP2N LP3N", "short_put_condor": "SP0N LP1N LP2N SP3N",
    "iron_condor": "LP1N SP0N SC2N LC3N", "iron_butterfly": "LP1N SP0N SC2N LC3N", "reverse_iron_condor": "SP1N LP0N LC2N SC3N", "reverse_iron_butterfly": "SP1N LP0N LC2N SC3N",
    "call_calendar": "SC0N LC1F", "put_calendar": "SP0N LP1F", "call_diagonal": "SC0N LC1F", "put_diagonal": "SP0N LP1F",
    "double_calendar": "SP0N LP1F SC2N LC3F", "double_diagonal": "SP0N LP1F SC2N LC3F",
}


def strategy(name: str, *deltas: float, dte: int = 45, far_dte: int = 75) -> list[Leg]:
    """The legs of a named strategy; deltas in the order of its arguments."""
    codes = STRATEGIES[name].split()
    if len(deltas) != 1 + max(int(c[2]) for c in codes):
        raise ValueError(f"{name} takes {1 + max(int(c[2]) for c in codes)} deltas")
    return [Leg(c[0] == "L", c[1].lower(), deltas[int(c[2])], dte if c[3] == "N" else far_dte) for c in codes]


def resolve(quotes: DataFrame, legs: list[Leg]) -> DataFrame:
    """symbol, ts and legs (array of number, long, kind, quantity, strike, expiration, bid, ask, delta) for each time at which all legs have a contract.

    Each leg takes, over all expirations in its window, the contract nearest to its delta,
    then the lower strike, the earlier expiration, the lower id.
    """
    found = None
    for n, leg in enumerate(legs):
        one = O.leg(quotes, leg.kind, leg.delta, leg.dte, keys=("symbol", "ts"))
        row = F.struct(F.lit(n).alias("number"), F.lit(leg.long).alias("long"), F.lit(leg.kind).alias("kind"), F.lit(leg.quantity).alias("quantity"), "strike", "expiration", "bid", "ask", "delta")
        one = one.select("symbol", "ts", row.alias(f"leg{n}"))
        found = one if found is None else found.join(one, ["symbol", "ts"])
    return found.select("symbol", "ts", F.array(*[f"leg{n}" for n in range(len(legs))]).alias("legs"))


def entry_cost(model: str = "mid", amount: float = 0.5, multiplier: int = 100) -> Column:
    """The cost of the legs at the fill price: positive if paid."""
    price = lambda x: fill_price(x["bid"], x["ask"], x["long"], model, amount)
    return F.aggregate("legs", F.lit(0.0), lambda acc, x: acc + F.when(x["long"], price(x)).otherwise(-price(x)) * x["quantity"] * multiplier)


def net_delta(multiplier: int = 100) -> Column:
    """Sum of the legs' deltas, whatever their side."""
    return F.aggregate("legs", F.lit(0.0), lambda acc, x: acc + x["delta"] * x["quantity"] * multiplier)


def hold_to_expiration(positions: DataFrame, closes: DataFrame, model: str = "mid", amount: float = 0.5, multiplier: int = 100, per_contract: float = 0.0) -> DataFrame:
    """Adds expiration (the earliest leg's), cost, close (the underlying's at or before it), value, pnl, fee, exit.

    positions: symbol, ts, legs; closes: symbol, ts, close.  A leg is worth what it is in the
    money by at the earliest expiration.  exit is assignment if a short put has its strike at
    or over the close, called_away if a short call has it at or under; the first such leg
    decides; else expiration.
    """
    last = positions.withColumns({"expiration": F.array_min(F.transform("legs", lambda x: x["expiration"])), "entry_ts": F.col("ts"), "cost": entry_cost(model, amount, multiplier)})
    at = asof_join(last.withColumn("ts", F.col("expiration").cast("timestamp_ntz")), closes, ["symbol"], ["close"])
    worth = lambda x: F.greatest(F.when(x["kind"] == "c", F.col("close") - x["strike"]).otherwise(x["strike"] - F.col("close")), F.lit(0.0))
    value = F.aggregate("legs", F.lit(0.0), lambda acc, x: acc + F.when(x["long"], worth(x)).otherwise(-worth(x)) * x["quantity"] * multiplier)
    fate = F.transform("legs", lambda x: F.when(~x["long"] & (x["kind"] == "p") & (x["strike"] >= F.col("close")), "assignment").when(~x["long"] & (x["kind"] == "c") & (x["strike"] <= F.col("close")), "called_away"))
    contracts = F.aggregate("legs", F.lit(0), lambda acc, x: acc + x["quantity"])
    out = at.where("close is not null").withColumns({"value": value, "exit": F.coalesce(F.get(F.array_compact(fate), F.lit(0)), F.lit("expiration")), "fee": commission(contracts, per_contract)})
    return out.select("symbol", F.col("entry_ts").alias("ts"), "legs", "expiration", "cost", "close", "value", (F.col("value") - F.col("cost")).alias("pnl"), "fee", "exit")


def wheel(puts: DataFrame, calls: DataFrame, closes: DataFrame, multiplier: int = 100) -> DataFrame:
    """Puts sold until one is assigned, then calls on the stock until it is called away, and again.

    puts, calls: `resolve` of one short leg each; closes: symbol, ts, close.  A put with its
    strike at or over the close at expiration leaves stock bought at the strike; a call with
    its strike at or under it sells the stock at that strike.  The next contract is the first
    one quoted after the expiration.  Prices at expiration are joined beforehand; what is left
    for the walk is one symbol's contracts in order.
    """
    one = lambda df, kind: df.select("symbol", "ts", F.lit(kind).alias("kind"), F.get("legs", F.lit(0)).alias("q"))
    quotes = one(puts, "p").unionByName(one(calls, "c")).select("symbol", F.col("ts").alias("entry_ts"), "kind", F.col("q.strike").alias("strike"), F.col("q.expiration").cast("timestamp_ntz").alias("ts"), ((F.col("q.bid") + F.col("q.ask")) / 2 * multiplier).alias("credit"))
    settled = asof_join(quotes, closes, ["symbol"], ["close"]).where("close is not null").select("symbol", "entry_ts", F.col("ts").alias("exit_ts"), "kind", "strike", "credit", "close")
    last = closes.groupBy("symbol").agg(F.max("ts").alias("known"))
    settled = settled.join(last, "symbol").where("exit_ts <= known").drop("known")

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows, stock, after = [], None, None
        for q in group.sort_values(["entry_ts", "kind"], kind="stable").itertuples(index=False):
            if q.kind != ("p" if stock is None else "c") or (after is not None and q.entry_ts <= after):
                continue
            exit_, gain = "expiration", 0.0
            if q.kind == "p" and q.strike >= q.close:
                exit_, stock = "assignment", q.strike
            elif q.kind == "c" and q.strike <= q.close:
                exit_, gain, stock = "called_away", (q.strike - stock) * multiplier, None
            rows.append((key[0], q.entry_ts, q.exit_ts, q.kind, q.strike, q.credit, gain, exit_))
            after = q.exit_ts
        return pd.DataFrame(rows, columns=["symbol", "entry_ts", "exit_ts", "kind", "strike", "credit", "stock_pnl", "exit"])

    return settled.groupBy("symbol").applyInPandas(run, "symbol string, entry_ts timestamp_ntz, exit_ts timestamp_ntz, kind string, strike double, credit double, stock_pnl double, exit string")
