"""Granger tests of all pairs and the patterns that follow, with a planted leader."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import bars as B
from quantloom.operators import patterns as P
from quantloom.operators import stats as S

N = 400


@pytest.fixture(scope="module")
def bars(spark):
    draw = np.random.default_rng(4)
    lead, other = draw.normal(0, 0.02, N), draw.normal(0, 0.02, N)
    led = draw.normal(0, 0.004, N)
    led[2:] += 0.6 * lead[:-2]  # two days later
    rows = []
    for name, ret in (("lead", lead), ("led", led), ("other", other)):
        close = 100 * np.cumprod(1 + ret)
        rows += [(name, datetime(2020, 1, 1) + timedelta(days=i), *[float(c)] * 4, 100) for i, c in enumerate(close) if not (name == "other" and i % 50 == 7)]
    rows += [("short", datetime(2020, 1, 1) + timedelta(days=i), *[50.0 + i] * 4, 1) for i in range(30)]
    rows += [("flat", datetime(2020, 1, 1) + timedelta(days=i), *[50.0] * 4, 1) for i in range(N)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long").cache()


@pytest.mark.parametrize("size", [7, None])
def test_pairs_equal_one_test_a_pair(bars, size):
    returns = B.returns(bars)
    got = {(r["cause"], r["effect"]): r for r in S.granger_pairs(returns, 3, size=size).collect()}
    assert set(got) == {(a, b) for a in ("lead", "led", "other", "flat") for b in ("lead", "led", "other", "flat") if a != b}
    wide = returns.groupBy("ts").pivot("symbol", ["lead", "led", "other"]).agg(F.first("ret"))
    for a, b in (("lead", "led"), ("led", "lead"), ("other", "lead")):
        one = S.granger(wide.select("ts", a, b).dropna(), a, b, 3)
        assert got[a, b]["n"] == one["n"] and got[a, b]["f"] == pytest.approx(one["f"], rel=1e-6) and got[a, b]["p"] == pytest.approx(one["p"], rel=1e-5, abs=1e-12)
    assert got["lead", "led"]["p"] < 1e-12 and got["led", "lead"]["p"] > 0.001
    assert got["flat", "led"]["f"] is None and got["led", "flat"]["p"] is None
    assert S.granger_pairs(returns.limit(0), 2).count() == 0


def test_the_planted_leader_is_found(bars):
    tests = S.granger_pairs(B.returns(bars), 5)
    found = P.cross_asset_signals(bars, tests, alpha=1e-6).cache()
    assert {(r["symbol"], r["pattern"]) for r in found.select("symbol", "pattern").distinct().collect()} == {("led", "cross_asset/lead")}
    moves = {r["ts"] for r in B.returns(bars).where("symbol = 'lead' and abs(ret) > 0.02").collect()}
    kept = sorted(r["i"] for r in found.where("horizon = 5").collect())
    assert {r["ts"] for r in found.collect()} <= moves and all(b - a >= 5 for a, b in zip(kept, kept[1:], strict=False)) and len(kept) > 20
    close = {r["i"]: r["close"] for r in bars.where("symbol = 'led'").withColumn("i", F.datediff("ts", F.lit("2020-01-01")) + 1).collect()}
    assert all(r["forward"] == pytest.approx(close[r["i"] + r["horizon"]] / close[r["i"]] - 1) for r in found.collect())
    scanned = P.scan(bars, found=found).collect()
    assert {(r["symbol"], r["pattern"], r["horizon"]) for r in scanned} == {("led", "cross_asset/lead", h) for h in P.HORIZONS}
