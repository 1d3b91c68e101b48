"""Metrics of trades, returns and equity curves, by symbol (or whatever the curve is named by)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Stands for a ratio without losses (fixed value).
CAP = 999.99
#: Calendar days from which a yearly growth rate is given (fixed value).
CAGR_DAYS = 25


def trade_metrics(trades: DataFrame, key: str = "symbol") -> DataFrame:
    """trades, win_rate, profit_factor, avg_pnl, avg_winner, avg_loser, avg_days, expectancy.

    A trade of 0 counts in the total only.
    """
    pnl = F.col("pnl")
    won, lost = F.when(pnl > 0, pnl), F.when(pnl < 0, pnl)
    win_rate, loss_rate = F.avg(F.when(pnl > 0, 1.0).otherwise(0.0)), F.avg(F.when(pnl < 0, 1.0).otherwise(0.0))
    gain, loss = F.coalesce(F.sum(won), F.lit(0.0)), F.coalesce(F.sum(lost), F.lit(0.0))
    return trades.groupBy(key).agg(
        F.count("*").alias("trades"), win_rate.alias("win_rate"), F.when(loss < 0, gain / F.when(loss < 0, -loss)).when(gain > 0, CAP).otherwise(0.0).alias("profit_factor"),
        F.avg(pnl).alias("avg_pnl"), F.avg(won).alias("avg_winner"), F.avg(lost).alias("avg_loser"), F.avg("days").alias("avg_days"),
        (win_rate * F.coalesce(F.avg(won), F.lit(0.0)) + loss_rate * F.coalesce(F.avg(lost), F.lit(0.0))).alias("expectancy"),
    )


def value_at_risk(returns: DataFrame, level: float = 0.05, key: str = "symbol", x: str = "ret") -> DataFrame:
    """var (the return at the floor index), historical_var (interpolated), cvar (mean of the worst ceil(n * level), at least one); signs turned."""
    rows = returns.where(F.col(x).isNotNull())
    size = rows.groupBy(key).agg(F.count("*").alias("n_"), F.percentile(x, F.lit(level)).alias("h_"))
    ranked = rows.join(size, key).withColumn("i_", F.row_number().over(Window.partitionBy(key).orderBy(x)) - 1)
    at = F.col("i_") == F.floor(F.col("n_") * level)
    worst = F.col("i_") < F.greatest(F.ceil(F.col("n_") * level), F.lit(1))
    return ranked.groupBy(key).agg((-F.max(F.when(at, F.col(x)))).alias("var"), (-F.first("h_")).alias("historical_var"), (-F.avg(F.when(worst, F.col(x)))).alias("cvar"))


def equity_metrics(curve: DataFrame, key: str = "symbol", bars_per_year: float = 252.0) -> DataFrame:
    """total_return, sharpe, sortino, cagr, calmar, max_drawdown, ulcer, pain of equity curves (key, ts, equity).

    Sortino divides by the root of the negative returns' squares over all returns less one;
    cagr counts calendar days over 365 and needs CAGR_DAYS of them.
    """
    w = Window.partitionBy(key).orderBy("ts")
    peak = F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = curve.select(key, "ts", "equity", ((peak - F.col("equity")) / peak).alias("dd"), (F.try_divide("equity", F.lag("equity").over(w)) - 1).alias("ret"))
    got = rows.groupBy(key).agg(
        F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.count("ret").alias("n"), F.sum(F.when(F.col("ret") < 0, F.col("ret") * F.col("ret")).otherwise(0.0)).alias("d2"),
        F.try_divide(F.max_by("equity", "ts"), F.min_by("equity", "ts")).alias("total"), F.datediff(F.max("ts"), F.min("ts")).alias("days"), F.max("dd").alias("max_drawdown"),
        F.sqrt(F.avg(F.col("dd") * F.col("dd") * 10000)).alias("ulcer"), (F.avg("dd") * 100).alias("pain"),
    )
    year = F.sqrt(F.lit(bars_per_year))
    down = F.sqrt(F.col("d2") / F.when(F.col("n") > 1, F.col("n") - 1))
    cagr = F.when((F.col("days") >= CAGR_DAYS) & (F.col("total") > 0), F.pow("total", 365.0 / F.col("days")) - 1)
    return got.select(
        key, (F.col("total") - 1).alias("total_return"), F.when(F.col("s") > 0, F.col("m") / F.col("s") * year).otherwise(0.0).alias("sharpe"), F.when(down > 0, F.col("m") / F.when(down > 0, down) * year).otherwise(0.0).alias("sortino"),
        cagr.alias("cagr"), F.when(F.col("max_drawdown") > 0, cagr / F.when(F.col("max_drawdown") > 0, F.col("max_drawdown"))).alias("calmar"), "max_drawdown", "ulcer", "pain",
    )
