"""Blocks, handed-on values and sliding folds: any block size gives what whole series give."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.operators import bars as B
from quantloom.operators import blocks as L
from quantloom.operators import indicators
from quantloom.operators import windows as W

SIZES = [3, 50]


def prices(symbol: str, n: int, seed: int, ties: bool = False) -> list[tuple]:
    draw = random.Random(seed)
    out, close = [], 100.0
    for i in range(n):
        close = draw.choice([98.0, 99.0, 100.0, 101.0]) if ties else max(1.0, close * (1 + draw.uniform(-0.1, 0.1)))
        out.append((symbol, datetime(2020, 1, 1) + timedelta(days=i * 3), close * 0.99, close * 1.02, close * 0.97, close, 10 + i % 17))
    return out


SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long"


@pytest.fixture(scope="module")
def bars(spark):
    rows = prices("a", 157, 1) + prices("b", 41, 2, ties=True) + prices("c", 1, 3)
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


def same(one, two) -> bool:
    rows = [sorted(df.select(*one.columns).collect(), key=lambda r: (r["symbol"], r["ts"])) for df in (one, two)]
    near = lambda a, b: a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))
    return len(rows[0]) == len(rows[1]) and all(near(x, y) for r, s in zip(*rows, strict=True) for x, y in zip(r, s, strict=True))


def test_places_count_each_series_from_0(bars):
    for span in ("month", "year", "day"):
        got = L.placed(bars, span=span).withColumn("k", F.row_number().over(W.order()) - 1)
        assert got.count() == bars.count() and got.where("__i <> k").count() == 0
    assert L.placed(bars.limit(0)).count() == 0


@pytest.mark.parametrize("size", SIZES)
def test_blocks_look_over_their_borders(bars, size):
    wanted = {"mean": F.avg("close").over(W.trailing(5)), "back": F.lag("close", 4).over(W.order()), "next": F.lead("close", 2).over(W.order()), "n": F.count("*").over(W.trailing(5))}
    got = L.in_blocks(bars, lambda b: b.withColumns(wanted), 4, 2, size=size)
    assert got.columns == [*bars.columns, *wanted] and same(bars.withColumns(wanted), got)


@pytest.mark.parametrize("size", SIZES)
def test_values_are_handed_on_over_blocks(bars, size):
    to_here = W.order().rowsBetween(Window.unboundedPreceding, 0)
    some = F.when(F.col("close") > 100, F.col("close"))  # null in many rows and in whole blocks
    kinds = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
    got = L.running(bars, {k: (k, some) for k in kinds}, size=size)
    assert same(bars.withColumns({k: f(some).over(to_here) for k, f in kinds.items()}), got)


def fall(returns: list[float]) -> float:
    equity, peak, worst = 1.0, 1.0, 0.0
    for r in returns:
        equity *= 1 + r
        peak = max(peak, equity)
        worst = max(worst, (peak - equity) / peak)
    return worst * 100


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("n", [1, 7, 41])
def test_sliding_drawdown_equals_a_fold(bars, n, size):
    got = L.in_blocks(bars, lambda b: W.rolling_max_drawdown(B.returns(b), "ret", n), n + 1, size=size)
    series: dict = {}
    for r in sorted(got.collect(), key=lambda r: (r["symbol"], r["ts"])):
        series.setdefault(r["symbol"], []).append(r)
    for rows in series.values():
        for i, r in enumerate(rows):
            window = [x["ret"] for x in rows[max(0, i - n + 1) : i + 1]]
            whole = len(window) == n and None not in window
            assert r["value"] == pytest.approx(fall(window), rel=1e-9, abs=1e-9) if whole else r["value"] is None


def test_a_total_loss_stays_one(spark):
    rows = [("s", datetime(2020, 1, 1) + timedelta(days=i), x) for i, x in enumerate([0.1, -1.0, 0.5, 0.2, -0.1, 0.3, -0.5, 0.0, 0.1])]
    got = L.in_blocks(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, ret double"), lambda b: W.rolling_max_drawdown(b, "ret", 3), 3, size=3)
    values = [r["value"] for r in got.orderBy("ts").collect()]
    assert values[:2] == [None, None]
    assert values[2:] == pytest.approx([fall([x for _, _, x in rows[i - 2 : i + 1]]) for i in range(2, 9)])


@pytest.mark.parametrize("size", SIZES)
def test_ranks_with_ties_equal_counts(bars, size):
    got = W.percentile_rank(bars, "close", 6, size=size)
    series: dict = {}
    for r in sorted(got.collect(), key=lambda r: (r["symbol"], r["ts"])):
        series.setdefault(r["symbol"], []).append(r)
    for rows in series.values():
        for i, r in enumerate(rows):
            lower = sum(x["close"] < r["close"] for x in rows[i - 5 : i]) if i >= 5 else 0
            assert r["percentile"] == pytest.approx(lower / 5 * 100) if i >= 5 else r["percentile"] is None


@pytest.mark.parametrize("size", [5, 40])
def test_every_indicator_in_blocks_equals_whole_series(bars, size):
    every = [n for n in indicators.NAMES if n not in ("rank", "iv_rank")] + ["rank:9", "iv_rank:30", "ema:1", "ema:60", "macd:3:8:4"]
    whole = indicators.add(bars, every).cache()
    assert same(whole, indicators.add(bars, every, size=size)) and whole.columns[: len(bars.columns)] == bars.columns


@pytest.mark.parametrize("size", [1, 6, 1 << 16])
def test_episodes_and_streaks_over_borders(bars, size):
    key = lambda r: (r["symbol"], r["start"])
    assert sorted(W.drawdown_episodes(bars, size=size).collect(), key=key) == sorted(W.drawdown_episodes(bars).collect(), key=key)
    got = {(r["symbol"], r["ts"]): r for r in W.consecutive(bars, size=size).collect()}
    up = down = 0
    rows = sorted(bars.collect(), key=lambda r: (r["symbol"], r["ts"]))
    for before, r in zip([None, *rows], rows, strict=False):
        change = r["close"] - before["close"] if before and before["symbol"] == r["symbol"] else None
        up, down = (up + 1 if change and change > 0 else 0), (down + 1 if change and change < 0 else 0)
        assert (got[r["symbol"], r["ts"]]["up_run"], got[r["symbol"], r["ts"]]["down_run"]) == (up, down)


def test_one_series_is_in_many_tasks(spark):
    one = spark.createDataFrame(prices("a", 600, 5), SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows here are few
    try:
        add = lambda b: b.withColumn("m", F.avg("close").over(W.trailing(3))).withColumn("task", F.spark_partition_id())
        wide = L.in_blocks(one, add, 2, size=20)
        assert wide.select("task").distinct().count() > 1
        assert "SinglePartition" not in wide._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
