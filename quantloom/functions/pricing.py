"""Prices and sizes as columns: fills, profit and loss, commission, position sizing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fill_price(bid: Column, ask: Column, long: Column, model: str = "mid", amount: float = 0.5) -> Column:
    """The price of a fill by a slippage model.

    mid; spread (buy at ask, sell at bid); liquidity and bid_ask_travel (so much of the
    spread from bid when buying, from ask when selling); per_leg (mid and so much more or less).
    """
    mid, width = (bid + ask) / 2, ask - bid
    if model == "mid":
        return mid
    if model == "spread":
        return F.when(long, ask).otherwise(bid)
    if model in ("liquidity", "bid_ask_travel"):
        return F.when(long, bid + width * amount).otherwise(ask - width * amount)
    if model == "per_leg":
        return F.when(long, mid + amount).otherwise(mid - amount)
    raise ValueError(model)


def leg_pnl(entry: Column, exit_: Column, long: Column, quantity: Column, multiplier: int = 100) -> Column:
    return F.when(long, exit_ - entry).otherwise(entry - exit_) * quantity * multiplier


def commission(contracts: Column, per_contract: float = 0.65, base: float = 0.0, least: float = 0.0) -> Column:
    return F.greatest(base + per_contract * F.abs(contracts), F.lit(float(least)))


def size_by_equity(equity: Column, price: Column, fraction: float) -> Column:
    """Whole shares that a part of the equity buys; 0 for a price at or below 0."""
    return F.when(price > 0, F.floor(equity * fraction / price)).otherwise(0).cast("long")


def size_by_risk(equity: Column, risk: float, entry: Column, stop: Column) -> Column:
    """Whole shares whose loss at the stop is a part of the equity; 0 without a distance."""
    distance = F.abs(entry - stop)
    return F.when(distance > 0, F.floor(equity * risk / distance)).otherwise(0).cast("long")


def size_by_volatility(equity: Column, price: Column, atr: Column, risk: float, times: float = 2.0) -> Column:
    """Whole shares whose move of `times` ATR is a part of the equity, and that the equity can buy."""
    wanted = F.floor(equity * risk / (atr * times))
    return F.when((atr > 0) & (price > 0), F.least(wanted, F.floor(equity / price))).otherwise(0).cast("long")


def kelly_fraction(win_rate: Column, avg_win: Column, avg_loss: Column, trades: Column, part: float = 0.5, least_trades: int = 20) -> Column:
    """A part of the Kelly fraction, within [0, 1]; 0 with too few trades or without losses or wins."""
    ratio = avg_win / F.abs(F.when(avg_loss != 0, avg_loss))
    raw = win_rate - (1 - win_rate) / F.when(ratio > 0, ratio)
    return F.when(trades >= least_trades, F.coalesce(F.least(F.greatest(raw * part, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))).otherwise(0.0)


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
