"""Rolling statistics, drawdowns, streaks, lookbacks: operators along one symbol's bars."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators import blocks

YEAR = 252.0


def order():
    return Window.partitionBy("symbol").orderBy("ts")


def trailing(n: int):
    """The row and the n - 1 before it."""
    return order().rowsBetween(1 - n, 0)


def full(x: Column, n: int, over: Column | None = None) -> Column:
    """x where n rows (that have `over`, if given) stand in the trailing window; null before."""
    return F.when(F.count(F.lit(1) if over is None else over).over(trailing(n)) == n, x)


def rolling(value: str, n: int, metric: str) -> Column:
    """volatility (annual, %), sharpe (annual), mean_return (annual, %) of the last n returns; null until there are n."""
    mean, std = F.avg(value).over(trailing(n)), F.stddev_samp(value).over(trailing(n))
    x = {
        "volatility": std * F.sqrt(F.lit(YEAR)) * 100,
        "sharpe": F.when(std > 0, mean / std * F.sqrt(F.lit(YEAR))).otherwise(0.0),
        "mean_return": mean * YEAR * 100,
    }[metric]
    return full(x, n, F.col(value))


def rolling_max_drawdown(rows: DataFrame, value: str, n: int, name: str = "value") -> DataFrame:
    """Adds the deepest fall (%) from a peak inside the last n returns, each window starting at 1; null until there are n.

    rows: with __i (``blocks.placed``); in blocks it looks n rows back.
    """
    rows = blocks.sliding_drawdown(rows, name, value, n)
    return rows.withColumn(name, full(F.col(name) * 100, n, F.col(value)))


def rolling_beta(asset: str, bench: str, n: int) -> Column:
    """Covariance over the benchmark's variance, on the pairs that are whole; null with fewer than 2 of them or before n rows."""
    a, b = (F.when(F.col(asset).isNotNull() & F.col(bench).isNotNull(), F.col(c)) for c in (asset, bench))
    w = trailing(n)
    return F.when((F.count(F.lit(1)).over(w) == n) & (F.var_samp(b).over(w) > 0), F.covar_samp(a, b).over(w) / F.var_samp(b).over(w))


def rolling_correlation(a: str, b: str, n: int) -> Column:
    w = trailing(n)
    return F.when((F.count(F.lit(1)).over(w) == n) & (F.stddev_samp(a).over(w) > 0) & (F.stddev_samp(b).over(w) > 0), F.corr(a, b).over(w))


def summary(series: DataFrame, value: str) -> DataFrame:
    """symbol, n, current, mean, min, max, std and trend of a series: rising or falling if slope * n / std passes 1 or -1."""
    rows = series.where(F.col(value).isNotNull()).withColumn("i", F.row_number().over(order()).cast("double"))
    n, std = F.count("*"), F.coalesce(F.stddev_samp(value), F.lit(0.0))
    got = rows.groupBy("symbol").agg(
        n.alias("n"), F.max_by(value, "ts").alias("current"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), std.alias("std"), F.regr_slope(value, "i").alias("slope")
    )
    change = F.col("slope") * F.col("n") / F.when(F.col("std") > 0, F.col("std"))
    trend = F.when((F.col("n") > 10) & (change > 1), "rising").when((F.col("n") > 10) & (change < -1), "falling").otherwise("stable")
    return got.withColumn("trend", trend).drop("slope")


def drawdown(bars: DataFrame, value: str = "close", **place) -> DataFrame:
    """Adds peak (the highest so far) and drawdown (the fall from it, as a part of it; 0 or below)."""
    return blocks.running(bars, {"peak": ("max", F.col(value))}, **place).withColumn("drawdown", F.col(value) / F.col("peak") - 1)


def drawdown_episodes(bars: DataFrame, least: float = 0.001, span: str = "month", size: int | None = None) -> DataFrame:
    """A row an episode: from the first close under the peak to the first at or over it.

    symbol, start, trough, end (null if still open), depth (%), duration and recovery in bars
    (0 if open).  Episodes no deeper than `least` are left out.  span, size: as in `blocks`.
    """
    place = {"span": span, "size": size}
    marked = drawdown(blocks.placed(bars, span=span).withColumn("i", F.col("__i") + 1), **place)
    under = F.col("close") < F.col("peak")

    def neighbours(rows: DataFrame) -> DataFrame:
        begins = under & ~F.coalesce(F.lag(under).over(order()), F.lit(False))
        return rows.withColumns({"under": under, "begins": begins, "next_i": F.lead("i").over(order()), "next_ts": F.lead("ts").over(order())})

    marked = blocks.in_blocks(marked, neighbours, 1, 1, **place)
    marked = blocks.running(marked, {"episode": ("sum", F.col("begins").cast("int"))}, **place)
    at_end = F.struct("i", "next_i", "next_ts")
    got = marked.where("under").groupBy("symbol", "episode").agg(
        F.min("ts").alias("start"), F.min("i").alias("start_i"), F.min_by(F.struct("ts", "i"), F.struct("drawdown", "i")).alias("low"), F.min("drawdown").alias("worst"), F.max(at_end).alias("last")
    )
    is_open = F.col("last.next_i").isNull()
    end_i = F.when(is_open, F.col("last.i") + 1).otherwise(F.col("last.next_i"))
    return got.where(F.col("worst") < -least).select(
        "symbol", "start", F.col("low.ts").alias("trough"), F.col("last.next_ts").alias("end"), (F.col("worst") * 100).alias("depth"), (end_i - F.col("start_i")).cast("long").alias("duration"), F.when(is_open, 0).otherwise(end_i - F.col("low.i")).cast("long").alias("recovery")
    )


def worst_episodes(bars: DataFrame, k: int = 20) -> DataFrame:
    """The k deepest episodes of each symbol."""
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy("depth", "start"))
    return drawdown_episodes(bars).withColumn("rank", rank).where(F.col("rank") <= k)


def runs(flag: Column, w) -> Column:
    """How many rows in a row have the flag, up to this one; 0 without it."""
    broken = F.max(F.when(~F.coalesce(flag, F.lit(False)), F.col("__i"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.when(F.coalesce(flag, F.lit(False)), F.col("__i") - F.coalesce(broken, F.lit(0))).otherwise(0)


def runs(flag: Column, w) -> Column:
    """How many rows in a row have the flag, up to this one; 0 without it.  Rows have __i, from 1."""
    broken = F.max(F.when(~F.coalesce(flag, F.lit(False)), F.col("__i"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.when(F.coalesce(flag, F.lit(False)), F.col("__i") - F.coalesce(broken, F.lit(0))).otherwise(0)


def run_lengths(rows: DataFrame, flags: dict[str, Column], **place) -> DataFrame:
    """Adds, for each name, how many rows in a row have the flag up to this one; 0 without it.  rows: with __i."""
    has = {k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}
    marked = blocks.running(rows, {f"__{k}": ("max", F.when(~v, F.col("__i"))) for k, v in has.items()}, **place)
    lengths = {k: F.when(v, F.col("__i") - F.coalesce(f"__{k}", F.lit(-1))).otherwise(0) for k, v in has.items()}
    return marked.withColumns(lengths).drop(*[f"__{k}" for k in flags])


def consecutive(bars: DataFrame, span: str = "month", size: int | None = None) -> DataFrame:
    """Adds up_run and down_run: closes in a row above, below the close before."""
    place = {"span": span, "size": size}
    rows = blocks.in_blocks(blocks.placed(bars, span=span), lambda b: b.withColumn("__c", F.col("close") - F.lag("close").over(order())), 1, **place)
    return run_lengths(rows, {"up_run": F.col("__c") > 0, "down_run": F.col("__c") < 0}, **place).drop("__c", "__i")


def longest_losing_streak(trades: DataFrame, pnl: str = "pnl", span: str = "month", size: int | None = None) -> DataFrame:
    """symbol and the most losing trades in a row; a trade of 0 ends a streak."""
    rows = run_lengths(blocks.placed(trades, span=span), {"r": F.col(pnl) < 0}, size=size)
    return rows.groupBy("symbol").agg(F.max("r").alias("longest"))


def percentile_rank(df: DataFrame, value: str, n: int, name: str = "percentile", **place) -> DataFrame:
    """Adds the part (%) of the n - 1 values before that are lower; null until there are n.

    A block's values are compared n at a time in one array of bounded size, not as a list a row.
    Nulls are no values: they are lower than none, and a null's own rank is null.
    """

    def ranks(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__i", kind="stable")
        x = group[value].to_numpy(float)
        out = np.full(len(x), np.nan)
        windows = np.lib.stride_tricks.sliding_window_view(x, n) if len(x) >= n else np.zeros((0, n))
        step = max(1, (1 << 20) // n)
        for a in range(0, len(windows), step):
            part = windows[a : a + step]
            out[n - 1 + a : n - 1 + a + len(part)] = (part[:, :-1] < part[:, -1:]).sum(1) / max(n - 1, 1) * 100.0
        return pd.DataFrame({"__s": group["__s"], "__b": group["__b"], "__i": group["__i"], "__x": np.where(np.isnan(x), np.nan, out)})

    def add(rows: DataFrame) -> DataFrame:
        flat = rows.select(F.col("symbol.symbol").alias("__s"), F.col("symbol.__block").alias("__b"), "__i", F.col(value).cast("double").alias(value))
        kind = flat.schema["__s"].dataType.simpleString()
        got = flat.groupBy("__s", "__b").applyInPandas(ranks, f"__s {kind}, __b long, __i long, __x double")
        got = got.select(F.struct(F.col("__s").alias("symbol"), F.col("__b").alias("__block")).alias("__k"), F.col("__i").alias("__j"), F.nanvl("__x", F.lit(None).cast("double")).alias(name))
        return rows.join(got, F.col("symbol").eqNullSafe(F.col("__k")) & (F.col("__i") == F.col("__j"))).drop("__k", "__j")

    return blocks.in_blocks(df, add, n - 1, **place)


def range_rank(value: str, n: int) -> Column:
    """Where the value stands (%) between the lowest and highest of n; 50 if they are equal."""
    low, high = F.min(value).over(trailing(n)), F.max(value).over(trailing(n))
    return full(F.when(high > low, (F.col(value) - low) / (high - low) * 100).otherwise(50.0), n)


def crossed(a: str, b: str, above: bool = True) -> Column:
    """True where a passes b on this bar; false if one of the four values is missing."""
    before_a, before_b = F.lag(a).over(order()), F.lag(b).over(order())
    now = F.col(a) > F.col(b) if above else F.col(a) < F.col(b)
    then = before_a <= before_b if above else before_a >= before_b
    return F.coalesce(now & then, F.lit(False))


def calendar(bars: DataFrame) -> DataFrame:
    """Adds the calendar of each bar.  last_bar, quarter_end and trading_days_left look ahead."""
    day = F.to_date("ts")
    before, after = F.lag(day).over(order()), F.lead(day).over(order())
    month = Window.partitionBy("symbol", F.date_trunc("month", "ts"))
    return bars.withColumns(
        {
            "day_of_week": F.weekday("ts") + 1,
            "month": F.month("ts"),
            "day_of_month": F.dayofmonth("ts"),
            "hour": F.hour("ts"),
            "minute": F.minute("ts"),
            "week": F.weekofyear("ts"),
            "hhmm": F.date_format("ts", "HH:mm"),
            "since_open": F.hour("ts") * 60 + F.minute("ts") - 570,
            "first_bar": before.isNull() | (before != day),
            "last_bar": after.isNull() | (after != day),
            "quarter_end": after.isNull() | (F.quarter(after) != F.quarter(day)),
            "trading_days_left": F.dense_rank().over(month.orderBy(F.desc(day))) - 1,
        }
    )


def forward_return(h: int) -> Column:
    return F.try_divide(F.lead("close", h).over(order()), F.col("close")) - 1


def spaced(rows: DataFrame, key: list[str], h: str | int, most: int | None = None, least_span: int = 256) -> DataFrame:
    """Of the places i of each key, those at least h after the last kept one; the first is kept.  Adds kept.

    rows: the key, i (from 0 or 1, repeated places count once) and, where `h` names one, a
    column that is one number a key, of at most `most`.  Places are folded in spans of `least_span` or h of them:
    first for each state in which a span can be entered (so many places still blocked), then
    over a key's spans, then once more for the state that holds.  No list is longer than a span
    or a key's number of spans.
    """
    far = (lambda x: F.col(x)) if isinstance(h, str) else F.lit
    span = max(least_span, most if isinstance(h, str) else h)
    held = [h] if isinstance(h, str) else []
    placed = rows.withColumn("__span", F.floor(F.col("i") / span))
    spans = placed.groupBy(*key, *held, "__span").agg(F.sort_array(F.collect_set(F.col("i").cast("bigint"))).alias("__at"))
    begin = F.col("__span") * span

    def leave(blocked: Column) -> Column:
        """Places of the next span that are blocked, by those of this one that were."""
        free = F.aggregate("__at", begin + blocked, lambda free, i: F.when(i >= free, i + far(h)).otherwise(free))
        return F.greatest(free - begin - span, F.lit(0)).cast("bigint")

    table = F.transform(F.sequence(F.lit(0).cast("bigint"), (far(h) - 1).cast("bigint")), leave)
    maps = spans.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("__span", table.alias("t")))).alias("__maps"))
    start = F.struct(F.lit(-2).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("state"), F.array().cast("array<bigint>").alias("into"))

    def hand_on(acc: Column, m: Column) -> Column:
        into = F.when(m["__span"] == acc["last"] + 1, acc["state"]).otherwise(F.lit(0).cast("bigint"))
        return F.struct(m["__span"].alias("last"), F.get(m["t"], into.cast("int")).alias("state"), F.concat(acc["into"], F.array(into)).alias("into"))

    into = F.arrays_zip(F.transform("__maps", lambda m: m["__span"]).alias("__span"), F.aggregate("__maps", start, hand_on)["into"].alias("__into"))
    entered = maps.select(*key, F.explode(into).alias("x")).select(*key, F.col("x.__span").alias("__span"), F.col("x.__into").alias("__into"))
    first = F.struct((begin + F.col("__into")).alias("free"), F.array().cast("array<bigint>").alias("kept"))
    step = lambda acc, i: F.when(i >= acc["free"], F.struct((i + far(h)).cast("bigint").alias("free"), F.concat(acc["kept"], F.array(i)).alias("kept"))).otherwise(acc)
    kept = spans.join(entered, [*key, "__span"]).select(*key, F.explode(F.aggregate("__at", first, step)["kept"]).alias("i"), F.lit(True).alias("kept"))
    kept = kept.withColumn("i", F.col("i").cast(rows.schema["i"].dataType))
    return rows.join(kept, [*key, "i"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def purge_overlaps(signals: DataFrame, h: int) -> DataFrame:
    """Of each symbol's signals (symbol, i), those at least h bars after the last kept one.

    The first signal is kept.  Where the median gap is at least h already, all stay.
    """
    gaps = signals.withColumn("gap", F.col("i") - F.lag("i").over(Window.partitionBy("symbol").orderBy("i")))
    gaps = gaps.groupBy("symbol").agg(F.median("gap").alias("gap"))
    marked = spaced(signals, ["symbol"], h).join(gaps, "symbol")
    return marked.where(F.col("kept") | ~F.coalesce(F.col("gap") < h, F.lit(False))).select("symbol", "i")


def subsample(bars: DataFrame, most: int) -> DataFrame:
    """At most `most` bars of each symbol, evenly spread, the first and the last among them."""
    numbered = bars.withColumns({"i": F.row_number().over(order()) - 1, "n": F.count("*").over(Window.partitionBy("symbol"))})
    # Row i is taken if some k has floor(k * (n - 1) / (most - 1)) = i: the least k with k * (n - 1) >= i * (most - 1) is one.
    k = F.ceil(F.col("i") * (most - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    hit = F.floor(k * (F.col("n") - 1) / (most - 1)) == F.col("i")
    return numbered.where((F.col("n") <= most) | hit).drop("i", "n")


def walk_forward_windows(days: DataFrame, n: int = 5, train: float = 0.7, mode: str = "rolling") -> DataFrame:
    """window, train_start, train_end, test_start, test_end from a table of distinct days (day).

    The days are numbered in one task: there are no more than the calendar has.  Rolling windows train on as many days each; anchored ones from the first day on.
    """
    numbered = days.withColumn("i", F.row_number().over(Window.orderBy("day")) - 1)
    total = days.count()
    if mode == "rolling":
        test = int(total * (1 - train) / (train + n * (1 - train)))
        first = round(test * train / (1 - train))
        spans = [(k, k * test, k * test + first) for k in range(n)]
    else:
        test = total // (n + 1)
        first = round(total * train / (n + 1))
        spans = [(k, 0, first + k * test) for k in range(n)]
    rows = [(k, a, b - 1, b, min(b + test, total) - 1) for k, a, b in spans if test > 0 and first > 0 and b < total]
    plan = days.sparkSession.createDataFrame(rows, "window int, a int, b int, c int, d int")
    out = plan
    for key, name in zip("abcd", ("train_start", "train_end", "test_start", "test_end"), strict=True):
        out = out.join(numbered.select(F.col("i").alias(key), F.col("day").alias(name)), key)
    return out.select("window", "train_start", "train_end", "test_start", "test_end")
