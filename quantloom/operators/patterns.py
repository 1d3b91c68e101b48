"""Pattern scan: conditions on bars, the returns that follow them, and which of them are more than chance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from quantloom.functions import distributions as D
from quantloom.operators import blocks
from quantloom.operators import stats as S
from quantloom.operators.bars import returns
from quantloom.operators.lineage import cut
from quantloom.operators.windows import full, order, runs, spaced, trailing

HORIZONS = (5, 10, 20)
LEAST_SIGNALS = 5
#: Weights of patterns with and without a structural reason (fixed values).
STRUCTURAL, EMPIRICAL = 1.0, 0.6


def flags(bars: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Bars with what the conditions need, and the conditions by "dimension/name"."""
    base = returns(bars).withColumns({"pc": F.lag("close").over(order()), "__i": F.row_number().over(order())})
    base = base.withColumns(
        {
            "sma": full(F.avg("close").over(trailing(20)), 20), "sd": full(F.stddev_samp("close").over(trailing(20)), 20), "r20": F.try_divide("close", F.lag("close", 20).over(order())) - 1,
            "vol_sma": full(F.avg("volume").over(trailing(20)), 20), "vol": full(F.stddev_samp("ret").over(trailing(20)), 20, F.col("ret")), "range_sma": full(F.avg("range").over(trailing(20)), 20),
            "up": runs(F.col("ret") > 0, order()), "down": runs(F.col("ret") < 0, order()),
            "before_end": F.datediff(F.last_day(F.to_date("ts")), F.to_date("ts")), "r1": F.lag("ret", 1).over(order()), "r5": F.lag("ret", 5).over(order()),
        }
    )
    quarter = base.groupBy("symbol").agg(F.percentile("vol", F.lit(0.25)).alias("v25"), F.percentile("vol", F.lit(0.75)).alias("v75"), F.corr("ret", "r1").alias("ac1"), F.corr("ret", "r5").alias("ac5"))
    base = base.join(quarter, "symbol")
    c = F.col
    weekdays, months = ("mon", "tue", "wed", "thu", "fri"), ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
    conditions = {f"seasonality/{d}": F.weekday("ts") == k for k, d in enumerate(weekdays)} | {f"seasonality/{m}": F.month("ts") == k + 1 for k, m in enumerate(months)}
    conditions |= {
        "seasonality/turn_of_month": (F.dayofmonth("ts") <= 3) | (c("before_end") <= 2),
        "price_action/three_down": c("down") == 3, "price_action/three_up": c("up") == 3, "price_action/up_5pct_20": c("r20") > 0.05, "price_action/down_5pct_20": c("r20") < -0.05, "price_action/day_up_2pct": c("ret") > 0.02, "price_action/day_down_2pct": c("ret") < -0.02,
        "mean_reversion/below_band": c("close") < c("sma") - 2 * c("sd"), "mean_reversion/above_band": c("close") > c("sma") + 2 * c("sd"), "mean_reversion/z_below_2": (c("close") - c("sma")) / F.when(c("sd") > 0, c("sd")) < -2,
        "volume/spike": c("volume") > 2 * c("vol_sma"), "volume/dry": c("volume") < 0.5 * c("vol_sma"), "volatility/low": c("vol") < c("v25"), "volatility/high": c("vol") > c("v75"),
        "microstructure/gap_up": c("gap") > 0.01, "microstructure/gap_down": c("gap") < -0.01, "microstructure/wide_range": c("range") > 2 * c("range_sma"),
        "autocorrelation/lag1": (F.abs("ac1") > 0.05) & (c("r1") > 0), "autocorrelation/lag5": (F.abs("ac5") > 0.05) & (c("r5") > 0),
    }
    return base, conditions


def signals(bars: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """symbol, pattern, horizon, i, ts, forward: the return after each bar on which a pattern's condition holds.

    Of a pattern's signals only those are kept that stand at least a horizon after the last
    kept one, where their median gap is shorter than that.
    """
    base, conditions = flags(bars)
    base = base.withColumns({f"f{h}": F.try_divide(F.lead("close", h).over(order()), F.col("close")) - 1 for h in horizons})
    hit = F.filter(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in conditions.items()]), lambda x: x.isNotNull())
    ahead = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"f{h}").alias("forward")) for h in horizons])
    long = base.select("symbol", "ts", F.col("__i").alias("i"), F.explode(hit).alias("pattern"), ahead.alias("ahead")).select("symbol", "pattern", "i", "ts", F.explode("ahead").alias("a"))
    long = long.select("symbol", "pattern", F.col("a.horizon").alias("horizon"), "i", "ts", F.col("a.forward").alias("forward")).where("forward is not null")
    return _apart(long, horizons)


def _apart(long: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Signals (symbol, pattern, horizon, i, ts, forward) that stand a horizon apart, where a pattern's median gap is shorter than that."""
    key = ["symbol", "pattern", "horizon"]
    w = Window.partitionBy(*key).orderBy("i")
    long = long.withColumn("gap", F.col("i") - F.lag("i").over(w))
    gaps = long.groupBy(*key).agg(F.median("gap").alias("close"))
    marked = spaced(long.drop("gap"), key, "horizon", max(horizons)).join(gaps, key)
    return marked.where(F.col("kept") | ~F.coalesce(F.col("close") < F.col("horizon"), F.lit(False))).select(*key, "i", "ts", "forward")


def cross_asset_signals(bars: DataFrame, tests: DataFrame, horizons: tuple[int, ...] = HORIZONS, alpha: float = 0.05, move: float = 0.02) -> DataFrame:
    """Signals, as of `signals`, of patterns "cross_asset/<symbol>": a day's move of over `move` of a symbol that leads this one.

    tests: `stats.granger_pairs`; a symbol leads another where its p is below `alpha`.  A signal stands on the bar of the
    symbol that is led, at the time of the move.
    """
    lead = {f"f{h}": F.try_divide(F.lead("close", h).over(order()), F.col("close")) - 1 for h in horizons}
    rows = blocks.in_blocks(blocks.placed(bars), lambda b: returns(b).withColumns(lead), 1, max(horizons))
    moves = rows.where(F.abs("ret") > move).select(F.col("symbol").alias("cause"), "ts")
    led = tests.where(F.col("p") < alpha).select("cause", F.col("effect").alias("symbol"))
    hits = led.join(moves, "cause").select("symbol", "ts", F.concat(F.lit("cross_asset/"), "cause").alias("pattern"))
    ahead = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"f{h}").alias("forward")) for h in horizons])
    base = rows.select("symbol", "ts", (F.col("__i") + 1).cast("int").alias("i"), F.explode(ahead).alias("a"))
    long = hits.join(base, ["symbol", "ts"]).select("symbol", "pattern", F.col("a.horizon").alias("horizon"), "i", "ts", F.col("a.forward").alias("forward"))
    return _apart(long.where("forward is not null"), horizons)


@pandas_udf(DoubleType())
def deflated_sharpe(sharpe: pd.Series, trials: pd.Series, skew: pd.Series, kurtosis: pd.Series, n: pd.Series) -> pd.Series:
    """The probability that a Sharpe ratio is above the best of `trials` by chance; 0 where it is not defined.

    The variance has + 0.5 * skew * sharpe, as the compared results do; the published
    estimator has - skew * sharpe.
    """
    sr, t, s, k, m = (v.to_numpy(float) for v in (sharpe, trials, skew, kurtosis, n))
    with np.errstate(all="ignore"):
        best = np.sqrt(2 * np.log(np.maximum(t, 1)))
        best = np.where(t > 1, best - (np.log(np.log(np.maximum(t, 2))) + np.log(4 * np.pi)) / (2 * np.where(best > 0, best, 1)), 0.0)
        var = (1 + 0.5 * s * sr + (k / 4) * sr * sr) / np.maximum(m - 1, 1)
        out = D.normal_cdf((sr - best * np.sqrt(np.maximum(var, 0))) / np.sqrt(np.where(var > 0, var, np.nan)))
    return pd.Series(np.where(np.isfinite(out) & (m > 1), out, 0.0))


def scan(bars: DataFrame, horizons: tuple[int, ...] = HORIZONS, alpha: float = 0.05, found: DataFrame | None = None) -> DataFrame:
    """A row a symbol, pattern and horizon with at least LEAST_SIGNALS signals: statistics, p, adjusted p, deflated Sharpe ratio, score.

    found: the bars' `signals`, where they are there already.
    """
    found = signals(bars, horizons) if found is None else found
    vol = returns(bars).withColumn("vol", full(F.stddev_samp("ret").over(trailing(20)), 20, F.col("ret")))
    middle = vol.groupBy("symbol").agg(F.median("vol").alias("middle"))
    regime = vol.join(middle, "symbol").where("vol is not null").select("symbol", "ts", (F.col("vol") > F.col("middle")).cast("int").alias("regime"))
    key = ["symbol", "pattern", "horizon"]
    std = F.stddev_samp("forward")
    stats = found.groupBy(*key).agg(
        F.count("*").alias("n"), F.avg("forward").alias("mean"), std.alias("std"), F.avg(F.when(F.col("forward") > 0, 1.0).otherwise(0.0)).alias("win_rate"), S.skew("forward").alias("skew"), S.excess_kurtosis("forward").alias("kurtosis")
    ).where(f"n >= {LEAST_SIGNALS} and std > 0")
    stats = stats.withColumns({"t": F.col("mean") / (F.col("std") / F.sqrt("n")), "sharpe": F.col("mean") / F.col("std") * F.sqrt(252.0 / F.col("horizon"))})
    stats = stats.withColumn("p", S.t_p(F.col("t"), (F.col("n") - 1).cast("double"))).withColumn("trials", F.count("*").over(Window.partitionBy("symbol")))
    by_regime = found.join(regime, ["symbol", "ts"]).groupBy(*key, "regime").agg(F.count("*").alias("k"), (F.avg("forward") / F.when(std > 0, std)).alias("s")).where("k >= 3 and s is not null")
    stable = by_regime.groupBy(*key).agg(F.when((F.count("*") >= 2) & (F.avg("s") != 0), F.stddev_samp("s") / F.abs(F.when(F.avg("s") != 0, F.avg("s")))).alias("cv"))
    order_p = Window.partitionBy("symbol").orderBy("p", "pattern", "horizon")
    out = stats.join(stable, key, "left").withColumn("rank", F.row_number().over(order_p))
    down = Window.partitionBy("symbol").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("adjusted", F.least(F.min(F.col("p") * F.col("trials") / F.col("rank")).over(down), F.lit(1.0))).withColumn("significant", F.col("adjusted") <= alpha)
    out = out.withColumn("dsr", deflated_sharpe("sharpe", "trials", "skew", "kurtosis", "n"))
    weight = F.when(F.col("pattern").startswith("seasonality/") | F.col("pattern").startswith("volume/"), STRUCTURAL).otherwise(EMPIRICAL)
    return out.withColumn("score", weight * F.greatest(F.col("dsr"), F.lit(0.0)) / (1 + F.coalesce("cv", F.lit(1.0))))


def similar_patterns(found: DataFrame, threshold: float = 0.5) -> DataFrame:
    """symbol, a, b, similarity of pattern pairs (a < b) whose signal dates' Jaccard similarity passes the threshold.

    found: symbol, pattern, ts.  Intersections come from a join on the dates, so only
    patterns that share a date meet.
    """
    dates = found.select("symbol", "pattern", "ts").distinct()
    sizes = dates.groupBy("symbol", "pattern").agg(F.count("*").alias("n"))
    one = dates.select("symbol", "ts", F.col("pattern").alias("a"))
    both = one.join(dates.select("symbol", "ts", F.col("pattern").alias("b")), ["symbol", "ts"]).where("a < b").groupBy("symbol", "a", "b").agg(F.count("*").alias("both"))
    size = lambda x: sizes.select("symbol", F.col("pattern").alias(x), F.col("n").alias(f"n_{x}"))
    pairs = both.join(size("a"), ["symbol", "a"]).join(size("b"), ["symbol", "b"])
    jaccard = F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))
    return pairs.select("symbol", "a", "b", jaccard.alias("similarity")).where(F.col("similarity") > threshold)


def deduplicate(scanned: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row a group of similar patterns: the one with the highest dsr (to nine digits; then the least name).

    Groups are connected components over `pairs`: each round a pattern takes the least label of
    those similar to it, and then that label's own, until nothing changes.  Rounds grow with the
    logarithm of a group, and each is a checkpoint.
    """
    scanned = scanned.persist()
    nodes = cut(scanned.select("symbol", F.col("pattern").alias("node")).distinct().withColumn("label", F.col("node")))
    edges = cut(pairs.select("symbol", F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select("symbol", "b", "a")).distinct())
    changed = 1
    while changed:
        near = edges.join(nodes.select("symbol", F.col("node").alias("y"), "label"), ["symbol", "y"]).groupBy("symbol", F.col("x").alias("node")).agg(F.min("label").alias("other"))
        step = nodes.join(near, ["symbol", "node"], "left").select("symbol", "node", F.col("label").alias("old"), F.least("label", F.coalesce("other", "label")).alias("near"))
        of_label = nodes.select("symbol", F.col("node").alias("near"), F.col("label").alias("own"))
        step = cut(step.join(of_label, ["symbol", "near"], "left").select("symbol", "node", "old", F.least("near", F.coalesce("own", "near")).alias("label")))
        changed = step.where("label <> old").count()
        nodes = step.select("symbol", "node", "label")
    best = scanned.join(nodes.withColumnRenamed("node", "pattern"), ["symbol", "pattern"])
    rank = F.row_number().over(Window.partitionBy("symbol", "label").orderBy(F.desc(F.round("dsr", 9)), "pattern", "horizon"))
    return best.withColumn("place", rank).where("place = 1").drop("place", "label")
