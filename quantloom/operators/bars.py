"""Bars: cleaning, resampling, returns, alignment of series, as-of lookups, adjustment factors.

Bars are symbol, ts (TIMESTAMP without zone), open, high, low, close, adjclose, volume.  Every
operator keeps symbols apart, so a task holds one symbol's bars at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Minutes of the intraday intervals.
MINUTES = {"1m": 1, "5m": 5, "10m": 10, "15m": 15, "30m": 30, "1h": 60, "4h": 240}
_CALENDAR = {"daily": "day", "weekly": "week", "monthly": "month"}
INTERVALS = (*MINUTES, *_CALENDAR)

#: Bars a year by interval; the analysis tools and the simulator count differently (fixed values).
BARS_PER_YEAR = {"daily": 252.0, "weekly": 52.0, "monthly": 12.0, "1m": 252.0 * 390, "5m": 252.0 * 78, "10m": 252.0 * 39, "15m": 252.0 * 26, "30m": 252.0 * 13, "1h": 252.0 * 7, "4h": 252.0 * 2}
SIM_BARS_PER_YEAR = {"daily": 252.0, "1m": 252.0 * 390, "5m": 252.0 * 78, "15m": 252.0 * 26, "30m": 252.0 * 13, "1h": 252.0 * 6.5, "4h": 252.0 * 1.625}
#: Days of history that a request reaches back at most, by interval (fixed values).
LOOKBACK_DAYS = {"1m": 180, "5m": 365, "10m": 365, "15m": 365, "30m": 730, "1h": 1095, "4h": 1095}


def clean(bars: DataFrame) -> DataFrame:
    """Drops bars with a null or non-finite time or price, or a price at or below zero at open or close."""
    good = F.col("ts").isNotNull()
    for c in ("open", "high", "low", "close"):
        good &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return bars.where(good & (F.col("open") > 0) & (F.col("close") > 0))


def between(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars from the day `start` to the day `end`, both included; pushed down to the scan."""
    if start:
        bars = bars.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        bars = bars.where(F.col("ts") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    return bars


def bucket(interval: str, ts: str | Column = "ts") -> Column:
    """The start of the interval that a time falls in."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    if interval in _CALENDAR:
        return F.date_trunc(_CALENDAR[interval], ts)
    n = MINUTES[interval]
    minute = F.hour(ts) * 60 + F.minute(ts)
    return F.date_trunc("day", ts) + F.make_dt_interval(mins=F.floor(minute / n).cast("int") * n)


def resample(bars: DataFrame, interval: str, tie: str | None = None, label: str = "first") -> DataFrame:
    """Bars of a longer interval: first open, highest high, lowest low, last close, summed volume.

    A bar is labelled by its first bar's time (label="first") or by the interval's start
    ("boundary").  tie: a column that orders bars of one time.  adjclose falls back to close.
    Highs and lows that are not finite are left out; if none is finite, open stands for them.
    """
    if interval not in INTERVALS:
        raise ValueError(f"unknown interval {interval}")
    order = F.struct("ts", tie) if tie else F.struct("ts")
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    adj = F.col("adjclose") if "adjclose" in bars.columns else F.col("close")
    grouped = bars.groupBy("symbol", bucket(interval).alias("__bucket")).agg(
        F.min("ts").alias("ts"),
        F.min_by("open", order).alias("open"),
        F.max(finite("high")).alias("high"),
        F.min(finite("low")).alias("low"),
        F.max_by("close", order).alias("close"),
        F.max_by(F.coalesce(adj, "close"), order).alias("adjclose"),
        F.sum("volume").cast("long").alias("volume"),
    )
    ts = F.col("ts") if label == "first" else F.col("__bucket").cast("timestamp_ntz")
    return grouped.select("symbol", ts.alias("ts"), "open", F.coalesce("high", "open").alias("high"), F.coalesce("low", "open").alias("low"), "close", "adjclose", "volume")


def by_time(*more: str):
    return Window.partitionBy("symbol").orderBy("ts", *more)


def returns(bars: DataFrame) -> DataFrame:
    """Adds ret (close over the close before, less 1), gap (open over it, less 1), range (high less low, over low).

    Null on a symbol's first bar, and where the divisor is 0.
    """
    before = F.lag("close").over(by_time())
    return bars.withColumns(
        {"ret": F.try_divide("close", before) - 1, "gap": F.try_divide("open", before) - 1, "range": F.try_divide(F.col("high") - F.col("low"), F.col("low"))}
    )


def last_of_day(bars: DataFrame, tie: str) -> DataFrame:
    """One bar for each symbol and time: the last by `tie`."""
    return bars.groupBy("symbol", "ts").agg(F.max_by(F.struct(*[c for c in bars.columns if c not in ("symbol", "ts")]), tie).alias("r")).select("symbol", "ts", "r.*")


def align_by_date(a: DataFrame, b: DataFrame, value: str = "close") -> DataFrame:
    """ts, a, b where both series have a bar; both without symbol, unique by ts."""
    return a.select("ts", F.col(value).alias("a")).join(b.select("ts", F.col(value).alias("b")), "ts")


def align_tail(bars: DataFrame, symbols: list[str], value: str = "ret") -> DataFrame:
    """Series paired from their ends, without regard to dates: back (0 is the last), and a column a symbol.

    Stops at the shortest series.  Symbols with gaps are paired at different dates.
    """
    numbered = bars.where(F.col("symbol").isin(symbols) & F.col(value).isNotNull()).withColumn(
        "back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts"))) - 1
    )
    wide = numbered.groupBy("back").agg(*[F.max(F.when(F.col("symbol") == s, F.col(value))).alias(s) for s in symbols])
    return wide.dropna(subset=symbols)


def asof_join(left: DataFrame, right: DataFrame, by: list[str], values: list[str], strict: bool = False, backfill: bool = False, prefix: str = "", span: str | None = "month") -> DataFrame:
    """`left` with the values of the right row at or before (strict: before) its ts, of the same `by`.

    backfill: where there is none, the first right row's.  The right side must be unique by
    key and ts.  Both sides are sorted within a key and a `span` of time, so that a long series
    is spread over tasks; a row without a match in its span takes what the last earlier span
    with right rows has handed on.  span=None keeps a key's rows together: for many keys with
    short series each.
    """
    payload = F.struct("ts", *values)
    late, early = (0, 1) if strict else (1, 0)
    sides = left.select(*left.columns, F.lit(None).cast(right.select(payload.alias("p")).schema[0].dataType).alias("__p"), F.lit(late).alias("__side"))
    nulls = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in (*by, "ts")]
    other = right.select(*by, "ts", *nulls, payload.alias("__p"), F.lit(early).alias("__side"))
    both = sides.unionByName(other)
    fields = [*left.columns, *[F.col(f"__f.{v}").alias(f"{prefix}{v}") for v in values], F.col("__f.ts").alias(f"{prefix}found_ts")]
    if span is None:
        last = F.last("__p", ignorenulls=True).over(Window.partitionBy(*by).orderBy("ts", "__side").rowsBetween(Window.unboundedPreceding, 0))
        last = F.coalesce(last, F.min("__p").over(Window.partitionBy(*by))) if backfill else last
        return both.withColumn("__f", last).where(F.col("__side") == late).select(*fields)
    both = both.withColumn("__span", F.date_trunc(span, "ts"))
    spans = both.groupBy(*by, "__span").agg(F.max("__p").alias("__end"), F.min("__p").alias("__start"))
    before = Window.partitionBy(*by).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    handed = F.last("__end", ignorenulls=True).over(before)
    if backfill:
        handed = F.coalesce(handed, F.min("__start").over(Window.partitionBy(*by)))
    spans = spans.select(*by, "__span", handed.alias("__handed"))
    inside = Window.partitionBy(*by, "__span").orderBy("ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__in", F.last("__p", ignorenulls=True).over(inside)).where(F.col("__side") == late)
    joined = found.join(spans, [*by, "__span"], "left").withColumn("__f", F.coalesce("__in", "__handed"))
    return joined.select(*fields)


def common_dates(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """The bars of `symbols` on the dates that all of them have."""
    chosen = bars.where(F.col("symbol").isin(symbols))
    dates = chosen.groupBy("ts").agg(F.countDistinct("symbol").alias("n")).where(F.col("n") == len(set(symbols))).select("ts")
    return chosen.join(dates, "ts", "left_semi")


def adjustment_factors(splits: DataFrame, dividends: DataFrame, closes: DataFrame) -> DataFrame:
    """symbol, date, own (an event date's factor) and factor (its product with those of all later events).

    splits: symbol, date, ratio; dividends: symbol, date, amount; closes: symbol, date, close.
    A split divides by its ratio; a dividend multiplies by (close - amount) / close of the last
    close before its date, if the amount lies between 0 and that close.
    """
    as_bars = closes.select("symbol", F.col("date").cast("timestamp_ntz").alias("ts"), "close")
    paid = asof_join(dividends.select("symbol", F.col("date").cast("timestamp_ntz").alias("ts"), "date", "amount"), as_bars, ["symbol"], ["close"], strict=True)
    dividend = F.when((F.col("amount") > 0) & (F.col("amount") < F.col("close")), (F.col("close") - F.col("amount")) / F.col("close"))
    events = splits.where("ratio > 0").select("symbol", "date", (1 / F.col("ratio")).alias("own"))
    events = events.unionByName(paid.select("symbol", "date", dividend.alias("own")).where("own is not null"))
    days = events.groupBy("symbol", "date").agg(F.product("own").alias("own"))
    later = Window.partitionBy("symbol").orderBy(F.desc("date"))
    return days.withColumn("factor", F.product("own").over(later))


def adjust(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """`bars` with adj_factor: the factor of the first event strictly after the bar's date, 1 after the last."""
    by_date = Window.partitionBy("symbol").orderBy("date")
    # What holds from an event on is the next one's factor; before the first event, its own.
    since = factors.select("symbol", F.col("date").cast("timestamp_ntz").alias("ts"), F.coalesce(F.lead("factor").over(by_date), F.lit(1.0)).alias("adj_factor"))
    ever = factors.groupBy("symbol").agg(F.lit("0001-01-01 00:00:00").cast("timestamp_ntz").alias("ts"), F.min_by("factor", "date").alias("adj_factor"))
    found = asof_join(bars, since.unionByName(ever), ["symbol"], ["adj_factor"])
    return found.withColumn("adj_factor", F.coalesce("adj_factor", F.lit(1.0))).drop("found_ts")


def split_ratio_between(splits: DataFrame, start: str, end: str) -> DataFrame:
    """symbol and the product of its split ratios after `start`, up to and including `end`."""
    return splits.where((F.col("date") > F.lit(start).cast("date")) & (F.col("date") <= F.lit(end).cast("date"))).groupBy("symbol").agg(F.product("ratio").alias("ratio"))


def price_query(bars: DataFrame, interval: str = "daily", start: str | None = None, end: str | None = None, limit: int | None = None, tail: bool = False, tie: str | None = None) -> DataFrame:
    """Bars of a date range, resampled, ascending, first or last `limit` of them.

    An intraday request without dates reaches back 7 days from the last bar.
    """
    chosen = between(bars, start, end)
    if interval in MINUTES and not (start or end):
        last = bars.groupBy("symbol").agg(F.max("ts").alias("__last"))
        chosen = chosen.join(last, "symbol").where(F.col("ts") >= F.col("__last") - F.expr("INTERVAL 7 DAYS")).drop("__last")
    out = resample(chosen, interval, tie)
    if limit is None:
        return out.orderBy("symbol", "ts")
    order = F.desc("ts") if tail else F.asc("ts")
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(order))
    return out.withColumn("__n", rank).where(F.col("__n") <= limit).drop("__n").orderBy("symbol", "ts")
