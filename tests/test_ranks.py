"""Ranks in ranges, adjusted p and blocked covariances against plain loops."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import ranks as R
from quantloom.operators import stats as S


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("parts", [1, 3, 64])
def test_average_ranks(spark, parts):
    draw = random.Random(2)
    rows = [("ab"[i % 3 == 0], draw.choice([0.0, -1.5, 3.25, float(i), None, 1e300])) for i in range(300)] + [("c", 7.0)] * 400 + [(None, 2.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = R.ranked(df, "v", "rank", ["k"], parts).collect()
    assert len(got) == len(rows)
    for r in got:
        mine = [v for k, v in rows if k == r["k"] and v is not None]
        want = None if r["v"] is None else sum(v < r["v"] for v in mine) + (sum(v == r["v"] for v in mine) + 1) / 2
        assert r["rank"] == want
    whole = {r["v"]: r["rank"] for r in R.average_ranks(df, "v", parts=parts).collect()}
    assert whole == {x: sum(v < x for _, v in rows if v is not None) + (sum(v == x for _, v in rows) + 1) / 2 for x in {v for _, v in rows if v is not None}}
    assert R.average_ranks(df.limit(0), "v").count() == 0


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_adjusted_p(spark, parts):
    draw = random.Random(3)
    tests = [(f"t{i:03}", draw.choice([0.001, 0.01, 0.04, draw.random(), 1.0])) for i in range(150)]
    got = {r["label"]: r for r in R.adjusted(spark.createDataFrame(tests, "label string, p double").repartition(4), parts=parts).collect()}
    order = sorted(tests, key=lambda t: (t[1], t[0]))
    least = 1.0
    for rank, (label, p) in reversed(list(enumerate(order, 1))):
        least = min(least, p * len(tests) / rank)
        assert got[label]["rank"] == rank and got[label]["adjusted"] == pytest.approx(least)


def only_ranges_meet(df) -> bool:
    """Whether what meets in one task is a row a range."""
    lines = plan_of(df).splitlines()
    return all("keys=[__range" in below for line, below in zip(lines, lines[1:], strict=False) if "SinglePartition" in line)


def test_only_a_row_a_range_meets_in_one_task(spark):
    df = spark.createDataFrame([(float(i % 50), float(i), f"l{i}", 1) for i in range(500)], "a double, b double, label string, k int")
    found = S.correlation(df, "a", "b", ["k"])
    assert "SinglePartition" not in plan_of(found) and only_ranges_meet(R.adjusted(df.withColumn("p", F.col("b") / 500)))
    rank_a = (np.arange(500) % 50) * 10 + 5.5  # ten equal values each
    assert found.first()["spearman"] == pytest.approx(np.corrcoef(rank_a, np.arange(500.0))[0, 1])


@pytest.mark.parametrize(("width", "times"), [(2, 7), (3, 1000), (256, 4096)])
def test_covariances_with_gaps(spark, width, times):
    draw = np.random.default_rng(1)
    names = ["d", "a", "c", "b", "e", "flat", "alone"]
    x = 5 + draw.normal(0, 1, (40, 7))
    x[:, 5] = 2.0
    there = draw.random((40, 7)) < 0.7
    there[:, 6] = False
    there[3, 6] = True
    rows = [(n, datetime(2020, 1, 1) + timedelta(days=i), float(x[i, j])) for i in range(40) for j, n in enumerate(names) if there[i, j]] + [("a", datetime(2021, 1, 1), None)]
    got = {(r["a"], r["b"]): r for r in S.covariance_matrix(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, ret double"), factor=2.0, width=width, times=times).collect()}
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            both = there[:, i] & there[:, j]
            if not both.any():
                assert (a, b) not in got
                continue
            r = got[a, b]
            assert r["n"] == both.sum()
            if both.sum() < 2:
                assert r["covariance"] is None and r["correlation"] is None
                continue
            want = np.cov(x[both, i], x[both, j])
            assert r["covariance"] == pytest.approx(2 * want[0, 1], abs=1e-9)
            assert r["correlation"] is None if "flat" in (a, b) else r["correlation"] == pytest.approx(want[0, 1] / np.sqrt(want[0, 0] * want[1, 1]))
    assert len(got) == sum((there[:, i] & there[:, j]).any() for i in range(7) for j in range(7))
    assert S.covariance_matrix(spark.createDataFrame([], "symbol string, ts timestamp_ntz, ret double")).count() == 0
