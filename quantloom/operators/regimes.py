"""Market regimes: volatility clusters, trend states, a Gaussian hidden Markov model; their statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.bars import returns
from quantloom.operators.windows import full, order, rolling, trailing

#: Names of the volatility clusters and of the trend states, from the lowest up (fixed values).
VOLATILITY_NAMES = {2: ("low_vol", "high_vol"), 3: ("low_vol", "normal_vol", "high_vol"), 4: ("low_vol", "normal_vol", "high_vol", "extreme_vol")}
TREND_NAMES = {2: ("downtrend", "uptrend"), 3: ("downtrend", "neutral", "uptrend"), 4: ("strong_downtrend", "weak_downtrend", "weak_uptrend", "strong_uptrend")}
#: Relative distance of the two averages that bounds the middle trend states (fixed values).
TREND_BAND = {3: 0.01, 4: 0.03}


def volatility_clusters(bars: DataFrame, n: int = 3, lookback: int = 21) -> DataFrame:
    """symbol, ts, ret, vol and state (0 is calm): rolling volatility against its own quantiles of the symbol."""
    rows = returns(bars).withColumn("vol", rolling("ret", lookback, "volatility"))
    cuts = rows.where("vol is not null").groupBy("symbol").agg(*[F.percentile("vol", F.lit(k / n)).alias(f"cut{k}") for k in range(1, n)])
    state = sum((F.when(F.col("vol") > F.col(f"cut{k}"), 1).otherwise(0) for k in range(1, n)), F.lit(0))
    return rows.join(cuts, "symbol", "left").select("symbol", "ts", "ret", "vol", F.when(F.col("vol").isNotNull(), state).alias("state"))


def trend_states(bars: DataFrame, n: int = 3, lookback: int = 21) -> DataFrame:
    """symbol, ts, ret, vol and state by the short average's distance from one three times as long."""
    short, long = full(F.avg("close").over(trailing(lookback)), lookback), full(F.avg("close").over(trailing(3 * lookback)), 3 * lookback)
    rows = returns(bars).withColumns({"vol": rolling("ret", lookback, "volatility"), "gap": short / long - 1})
    g = F.col("gap")
    if n == 2:
        state = F.when(g > 0, 1).otherwise(0)
    elif n == 3:
        state = F.when(g > TREND_BAND[3], 2).when(g < -TREND_BAND[3], 0).otherwise(1)
    else:
        state = F.when(g > TREND_BAND[4], 3).when(g > 0, 2).when(g >= -TREND_BAND[4], 1).otherwise(0)
    return rows.select("symbol", "ts", "ret", "vol", F.when(g.isNotNull(), state).alias("state"))


def statistics(states: DataFrame) -> DataFrame:
    """symbol, state, n, pct, mean and std of the returns, mean volatility."""
    known = states.where("state is not null")
    return known.groupBy("symbol", "state").agg(
        F.count("*").alias("n"), (F.count("*") * 100.0 / F.sum(F.count("*")).over(Window.partitionBy("symbol"))).alias("pct"), F.avg("ret").alias("mean"), F.coalesce(F.stddev_samp("ret"), F.lit(0.0)).alias("std"), F.avg("vol").alias("vol")
    )


def transitions(states: DataFrame, n: int) -> DataFrame:
    """symbol, from, to, probability for every pair of n states; a state that is never left has a row of 0."""
    steps = states.withColumn("to", F.lead("state").over(order())).where("state is not null and to is not null")
    counts = steps.groupBy("symbol", F.col("state").alias("from"), "to").agg(F.count("*").alias("k"))
    total = counts.groupBy("symbol", "from").agg(F.sum("k").alias("total"))
    every = F.sequence(F.lit(0), F.lit(n - 1))
    grid = states.select("symbol").distinct().withColumn("from", F.explode(every)).withColumn("to", F.explode(every))
    return grid.join(counts, ["symbol", "from", "to"], "left").join(total, ["symbol", "from"], "left").select("symbol", "from", "to", F.coalesce(F.col("k") / F.col("total"), F.lit(0.0)).alias("probability"))


# Hidden Markov model -----------------------------------------------------------------------

ITERATIONS, TOLERANCE, VARIANCE_FLOOR, STAY = 100, 1e-6, 1e-10, 0.7


def _densities(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * (x[:, None] - mean) ** 2 / var) / np.sqrt(2 * np.pi * var) + 1e-300


def hmm_fit(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, transition, mean, variance of n states in order of their means, by scaled Baum-Welch."""
    chunks = np.array_split(np.sort(x), n)
    mean, var = np.array([c.mean() for c in chunks]), np.maximum([c.var() for c in chunks], VARIANCE_FLOOR)
    start = np.full(n, 1 / n)
    move = np.full((n, n), (1 - STAY) / max(n - 1, 1))
    np.fill_diagonal(move, STAY if n > 1 else 1.0)
    last = -np.inf
    for _ in range(ITERATIONS):
        b = _densities(x, mean, var)
        alpha, scale = np.zeros_like(b), np.zeros(len(x))
        for t in range(len(x)):
            alpha[t] = (start if t == 0 else alpha[t - 1] @ move) * b[t]
            scale[t] = alpha[t].sum()
            alpha[t] /= scale[t]
        beta = np.ones_like(b)
        for t in range(len(x) - 2, -1, -1):
            beta[t] = move @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
        gamma = alpha * beta
        gamma /= gamma.sum(1, keepdims=True)
        joint = move * (alpha[:-1].T @ (b[1:] * beta[1:] / scale[1:, None]))
        start, move = gamma[0], joint / np.maximum(joint.sum(1, keepdims=True), 1e-300)
        weight = np.maximum(gamma.sum(0), 1e-300)
        mean = (gamma * x[:, None]).sum(0) / weight
        var = np.maximum((gamma * (x[:, None] - mean) ** 2).sum(0) / weight, VARIANCE_FLOOR)
        likelihood = np.log(scale).sum()
        if abs(likelihood - last) < TOLERANCE:
            break
        last = likelihood
    rank = np.argsort(mean)
    return start[rank], move[np.ix_(rank, rank)], mean[rank], var[rank]


def viterbi(x: np.ndarray, start: np.ndarray, move: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    b, step = np.log(_densities(x, mean, var)), np.log(move + 1e-300)
    score, back = np.log(start + 1e-300) + b[0], np.zeros((len(x), len(mean)), dtype=int)
    for t in range(1, len(x)):
        paths = score[:, None] + step
        back[t] = paths.argmax(0)
        score = paths.max(0) + b[t]
    path = np.zeros(len(x), dtype=int)
    path[-1] = score.argmax()
    for t in range(len(x) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def online_filter(x: np.ndarray, start: np.ndarray, move: np.ndarray, mean: np.ndarray, var: np.ndarray, threshold: float = 0.6) -> np.ndarray:
    """The state at each time by the past alone; it changes only when another's probability passes the threshold."""
    b, p = _densities(x, mean, var), start
    out, state = np.zeros(len(x), dtype=int), int(np.argmax(start))
    for t in range(len(x)):
        p = (p if t == 0 else p @ move) * b[t]
        p /= p.sum()
        best = int(p.argmax())
        if best != state and p[best] > threshold:
            state = best
        out[t] = state
    return out


def hmm_states(bars: DataFrame, n: int = 2) -> DataFrame:
    """symbol, ts, ret, vol, state (Viterbi) and online (filtered) of a model fitted to each symbol's returns.

    A series is sequential, so one task fits one symbol; with fewer than 10 * n returns the
    states are null.
    """
    rows = returns(bars).withColumn("vol", rolling("ret", 21, "volatility")).where("ret is not null").select("symbol", "ts", "ret", "vol")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ts", kind="stable")
        x = group["ret"].to_numpy()
        if len(x) < 10 * n:
            return group.assign(state=pd.array([None] * len(x), "Int32"), online=pd.array([None] * len(x), "Int32"))
        model = hmm_fit(x, n)
        return group.assign(state=pd.array(viterbi(x, *model), "Int32"), online=pd.array(online_filter(x, *model), "Int32"))

    return rows.groupBy("symbol").applyInPandas(run, "symbol string, ts timestamp_ntz, ret double, vol double, state int, online int")


def overlapping(mean: np.ndarray, var: np.ndarray) -> bool:
    """Whether two neighbouring states' means lie closer than their mean deviation."""
    dev = np.sqrt(var)
    return bool(np.any(np.diff(mean) < (dev[:-1] + dev[1:]) / 2))
