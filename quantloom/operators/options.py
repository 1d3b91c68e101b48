"""Option chains: filters, the choice of a contract, joins of legs, quote lookups.

Quotes are symbol, ts, expiration, option_type (c or p), strike, bid, ask, delta.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.bars import asof_join

#: Half-open session windows in minutes after midnight (fixed values).
SESSIONS = {"premarket": (240, 570), "regular": (570, 960), "afterhours": (960, 1200), "extended": (240, 1200)}


def session(bars: DataFrame, name: str) -> DataFrame:
    """Bars whose time of day lies in a session."""
    low, high = SESSIONS[name]
    minute = F.hour("ts") * 60 + F.minute("ts")
    return bars.where((minute >= low) & (minute < high))


def with_dte(quotes: DataFrame) -> DataFrame:
    """Adds dte, whole days from the quote to the expiration, unless it is there."""
    return quotes if "dte" in quotes.columns else quotes.withColumn("dte", F.datediff("expiration", F.to_date("ts")))


def candidates(quotes: DataFrame, option_type: str | None = None, min_dte: int | None = None, max_dte: int | None = None, min_price: float | None = None) -> DataFrame:
    """Quotes of a type, in a range of days (both ends included), with bid and ask above a price."""
    out = with_dte(quotes)
    if option_type is not None:
        out = out.where(F.col("option_type") == option_type)
    if min_dte is not None:
        out = out.where(F.col("dte") >= min_dte)
    if max_dte is not None:
        out = out.where(F.col("dte") <= max_dte)
    if min_price is not None:
        out = out.where((F.col("bid") > min_price) & (F.col("ask") > min_price))
    return out


def is_third_friday(day: Column) -> Column:
    return (F.weekday(day) == 4) & F.dayofmonth(day).between(15, 21)


def expirations(quotes: DataFrame, kind: str = "any") -> DataFrame:
    """Quotes that expire on any day, on a Friday ("weekly"), or on a third Friday ("monthly")."""
    if kind == "any":
        return quotes
    day = F.col("expiration")
    return quotes.where(F.weekday(day) == 4 if kind == "weekly" else is_third_friday(day))


def closest_delta(quotes: DataFrame, target: float, low: float, high: float, keys: tuple[str, ...] = ("symbol", "ts", "expiration")) -> DataFrame:
    """One quote a key: the one whose absolute delta is nearest to `target`, within [low, high].

    Ties go to the lower strike, then to the earlier expiration, then to the lower id if
    there is one.  It is a grouped minimum, so that only one row a key and task is shuffled.
    """
    size = F.abs("delta")
    order = [F.abs(size - target).alias("distance"), F.col("strike"), F.col("expiration"), *([F.col("id")] if "id" in quotes.columns else [])]
    rest = F.struct(*[c for c in quotes.columns if c not in keys])
    best = quotes.where((size >= low) & (size <= high)).groupBy(*keys).agg(F.min_by(rest, F.struct(*order)).alias("q"))
    return best.select(*keys, "q.*")


def leg_window(delta: float, dte: int) -> dict[str, float]:
    """The default search window of a leg: delta +- 0.10 within [0.01, 1], days +- 15 from 1."""
    return {"low": max(delta - 0.10, 0.01), "high": min(delta + 0.10, 1.0), "min_dte": max(dte - 15, 1), "max_dte": dte + 15}


def leg(quotes: DataFrame, option_type: str, delta: float, dte: int, min_price: float = 0.05, keys: tuple[str, ...] = ("symbol", "ts", "expiration")) -> DataFrame:
    """The contract of a leg by its target delta and days, in the default window."""
    w = leg_window(delta, dte)
    return closest_delta(candidates(quotes, option_type, int(w["min_dte"]), int(w["max_dte"]), min_price), delta, w["low"], w["high"], keys)


def leg_columns(leg_: DataFrame, number: int, columns: tuple[str, ...] = ("strike", "bid", "ask", "delta"), expiration: str = "expiration") -> DataFrame:
    """symbol, ts, the expiration under a name, and the columns with the leg's number."""
    return leg_.select("symbol", "ts", F.col("expiration").alias(expiration), *[F.col(c).alias(f"{c}_{number}") for c in columns])


def join_legs(legs: list[DataFrame]) -> DataFrame:
    """Legs side by side where all of them quote the same time and expiration; from the first leg on."""
    numbered = [leg_columns(x, i) for i, x in enumerate(legs)]
    return reduce(lambda a, b: a.join(b, ["symbol", "ts", "expiration"]), numbered)


def join_two_expirations(primary: list[DataFrame], secondary: list[DataFrame]) -> DataFrame:
    """Legs of a near and of a later expiration at the same time: every pair with the second after the first."""
    def side(legs, name, first):
        numbered = [leg_columns(x, first + i, expiration=f"expiration_{name}") for i, x in enumerate(legs)]
        return reduce(lambda a, b: a.join(b, ["symbol", "ts", f"expiration_{name}"]), numbered)

    near, far = side(primary, "primary", 0), side(secondary, "secondary", len(primary))
    return near.join(far, ["symbol", "ts"]).where(F.col("expiration_secondary") > F.col("expiration_primary"))


CONTRACT = ["symbol", "expiration", "strike", "option_type"]


def price_table(quotes: DataFrame, tie: str) -> DataFrame:
    """One quote a contract and day: the last by `tie`."""
    day = F.to_date("ts").alias("day")
    return quotes.groupBy(*CONTRACT, day).agg(F.max_by(F.struct("ts", "bid", "ask", "delta"), tie).alias("q")).select(*CONTRACT, "day", "q.*")


def lookup(wanted: DataFrame, prices: DataFrame) -> DataFrame:
    """Quotes of contracts on days: wanted (contract, day) joined with `price_table`; only those quoted."""
    return wanted.join(prices, [*CONTRACT, "day"])


def last_known(wanted: DataFrame, prices: DataFrame) -> DataFrame:
    """The quote of each wanted contract (contract, ts) at its time or the last one before it; null if there was none."""
    return asof_join(wanted, prices.select(*CONTRACT, "ts", "bid", "ask"), CONTRACT, ["bid", "ask"], span=None)


def select_candidate(quotes: DataFrame, how: str, target_dte: int = 45, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """One quote a key: nearest_dte, first, highest_premium or lowest_premium; ties by expiration, strike, id."""
    premium = F.abs((F.col("bid") + F.col("ask")) / 2)
    first = {"nearest_dte": F.abs(F.col("dte") - target_dte).cast("double"), "first": F.lit(0.0), "highest_premium": -premium, "lowest_premium": premium}[how]
    rest = F.struct(*[c for c in quotes.columns if c not in keys])
    return quotes.groupBy(*keys).agg(F.min_by(rest, F.struct(first, "expiration", "strike", "option_type", "id")).alias("q")).select(*keys, "q.*")
