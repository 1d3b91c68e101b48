"""Seasonality: statistics of a metric by a part of the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators.bars import returns

BUCKETS = {
    "day_of_week": lambda ts: F.weekday(ts) + 1,
    "month": F.month,
    "quarter": F.quarter,
    "year": F.year,
    "hour_of_day": F.hour,
}
METRICS = {
    "return": lambda: F.col("ret") * 100,
    "gap": lambda: F.col("gap") * 100,
    "range": lambda: F.col("range") * 100,
    "volume": lambda: F.col("volume").cast("double"),
}


def aggregate(bars: DataFrame, group_by: str, metric: str) -> DataFrame:
    """symbol, bucket, n, mean, median, std, min, max, total, positive_pct, t (of mean = 0; returns and gaps only), few (n < 20)."""
    values = returns(bars).select("symbol", BUCKETS[group_by](F.col("ts")).cast("int").alias("bucket"), METRICS[metric]().alias("v")).where("v is not null")
    n, std = F.count("*"), F.stddev_samp("v")
    t = F.avg("v") / F.when(std > 0, std / F.sqrt(n))
    return values.groupBy("symbol", "bucket").agg(
        n.alias("n"),
        F.avg("v").alias("mean"),
        F.median("v").alias("median"),
        F.coalesce(std, F.lit(0.0)).alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.sum("v").alias("total"),
        (100 * F.avg(F.when(F.col("v") > 0, 1.0).otherwise(0.0))).alias("positive_pct"),
        (t if metric in ("return", "gap") else F.lit(None).cast("double")).alias("t"),
        (n < 20).alias("few"),
    )


def rounded(table: DataFrame) -> DataFrame:
    """For reports: five digits after the point, three for totals."""
    digits = {"mean": 5, "median": 5, "std": 5, "min": 5, "max": 5, "total": 3, "positive_pct": 5, "t": 5}
    return table.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in table.columns])
