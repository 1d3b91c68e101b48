"""Streams of ticks and the forward test: the same bars and checks over growing data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Relative changes against the baseline from which a figure is worth a warning, and an alert (fixed values).
DRIFT = {"sharpe": (-0.25, -0.5), "win_rate": (-0.15, -0.3), "max_drawdown": (0.25, 0.5)}


def tick_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def live_bars(ticks: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of (symbol, ts, id, price, volume) ticks by event time; ticks later than `late` are dropped.

    Works on a stream (append mode gives each bar once, when its window has closed) and on a table.
    """
    order = F.struct("ts", "id")
    watched = ticks.withWatermark("ts", late) if ticks.isStreaming else ticks
    bars = watched.groupBy("symbol", F.window("ts", every).alias("w")).agg(
        F.min("ts").alias("ts"), F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume")
    )
    return bars.select("symbol", F.col("w.start").alias("start"), "ts", "open", "high", "low", "close", "volume")


def sessions(ticks: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """symbol, start, end, n of runs of ticks without a pause of `gap`."""
    watched = ticks.withWatermark("ts", late) if ticks.isStreaming else ticks
    got = watched.groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return got.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def forward_step(stored: DataFrame, replay: DataFrame) -> DataFrame:
    """What a step adds to a forward test: the replay's snapshots (session, ts, equity) after the last stored one.

    Raises ValueError if the replay has fewer snapshots than are stored for a session: then
    the past has changed.
    """
    have = stored.groupBy("session").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    seen = replay.groupBy("session").agg(F.count("*").alias("m"))
    if have.join(seen, "session", "left").where(F.coalesce("m", F.lit(0)) < F.col("n")).limit(1).count():
        raise ValueError("the replay is shorter than the stored session")
    return replay.join(have.select("session", "last"), "session", "left").where(F.col("last").isNull() | (F.col("ts") > F.col("last"))).drop("last")


def drift(current: DataFrame, baseline: DataFrame, key: str = "session") -> DataFrame:
    """key, figure, change and level (ok, warning, alert) of each figure against the baseline, and confidence by trades."""
    joined = current.select(key, "trades", *[F.col(f).alias(f"now_{f}") for f in DRIFT]).join(baseline.select(key, *DRIFT), key)
    change = lambda f: F.when(F.col(f) != 0, (F.col(f"now_{f}") - F.col(f)) / F.abs(F.when(F.col(f) != 0, F.col(f))))
    rows = joined.select(key, "trades", F.explode(F.array(*[F.struct(F.lit(f).alias("figure"), change(f).alias("change"), F.lit(w).alias("w"), F.lit(a).alias("a")) for f, (w, a) in DRIFT.items()])).alias("d"))
    worse = lambda x: F.when(x < 0, F.col("d.change") <= x).otherwise(F.col("d.change") >= x)
    level = F.when(worse(F.col("d.a")), "alert").when(worse(F.col("d.w")), "warning").otherwise("ok")
    confidence = F.when(F.col("trades") >= 30, "comparable").when(F.col("trades") >= 20, "preliminary").otherwise("insufficient")
    return rows.select(key, F.col("d.figure").alias("figure"), F.col("d.change").alias("change"), level.alias("level"), confidence.alias("confidence"))
