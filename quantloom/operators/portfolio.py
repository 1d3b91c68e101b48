"""Two series and many: benchmark and factor regressions, cointegration, portfolio weights."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators import stats as S

YEAR = 252.0
#: Critical values of the unit-root test with a constant, at 1, 5 and 10 % (fixed values).
ADF_CRITICAL = {"1%": -3.43, "5%": -2.86, "10%": -2.57}
#: Statistics and p-values that lines join.
ADF_POINTS = [(-5.0, 0.0005), (ADF_CRITICAL["1%"], 0.01), (ADF_CRITICAL["5%"], 0.05), (ADF_CRITICAL["10%"], 0.10), (-1.0, 0.60), (0.0, 0.95), (2.0, 0.999)]


def benchmark(pairs: DataFrame, asset: str, bench: str) -> DataFrame:
    """One row: n, alpha and its t, beta, r2, tracking_error, information_ratio, treynor, up_capture, down_capture (yearly where it applies)."""
    a, b = F.col(asset), F.col(bench)
    active = a - b
    capture = lambda c: F.coalesce(F.try_divide(F.avg(F.when(c, a)), F.avg(F.when(c, b))), F.lit(1.0))
    got = pairs.where(a.isNotNull() & b.isNotNull()).agg(
        F.count("*").alias("n"), F.regr_intercept(a, b).alias("a0"), F.regr_slope(a, b).alias("beta"), F.regr_r2(a, b).alias("r2"), (F.stddev_samp(active) * math.sqrt(YEAR)).alias("tracking_error"),
        (F.avg(active) * YEAR).alias("excess"), (F.avg(a) * YEAR).alias("mean"), capture(b > 0).alias("up_capture"), capture(b < 0).alias("down_capture"),
        F.regr_sxx(a, b).alias("sxx"), F.regr_syy(a, b).alias("syy"), F.avg(b).alias("mb"),
    )
    s2 = F.col("syy") * (1 - F.col("r2")) / (F.col("n") - 2)
    error = F.sqrt(s2 * (1 / F.col("n") + F.col("mb") * F.col("mb") / F.col("sxx")))
    t = F.try_divide(F.col("a0"), error)
    return got.select(
        "n", (F.col("a0") * YEAR).alias("alpha"), t.alias("alpha_t"), (F.abs(t) > 1.96).alias("alpha_significant"), "beta", "r2", "tracking_error",
        F.try_divide(F.col("excess"), F.col("tracking_error")).alias("information_ratio"), F.try_divide(F.col("mean"), F.col("beta")).alias("treynor"), "up_capture", "down_capture",
    )


def spread(pairs: DataFrame) -> tuple[DataFrame, float, float, float]:
    """ts and spread = b - alpha - beta * a by least squares, and alpha, beta, r2."""
    alpha, beta, r2 = pairs.agg(F.regr_intercept("b", "a"), F.regr_slope("b", "a"), F.regr_r2("b", "a")).first()
    return pairs.select("ts", (F.col("b") - alpha - beta * F.col("a")).alias("spread")), alpha, beta, r2


def spread_summary(pairs: DataFrame) -> DataFrame:
    """One row: alpha, beta, z of the last spread, its percentile, n."""
    rows, alpha, beta, _ = spread(pairs)
    now = rows.agg(F.max_by("spread", "ts")).first()[0]
    return rows.agg(
        F.lit(alpha).alias("alpha"), F.lit(beta).alias("beta"), ((F.lit(now) - F.avg("spread")) / F.stddev_samp("spread")).alias("z"), F.count("*").alias("n"), (F.avg(F.when(F.col("spread") < now, 1.0).otherwise(0.0)) * 100).alias("percentile")
    )


def adf_p(t: float) -> float:
    """A p-value by straight lines between ADF_POINTS."""
    return float(np.interp(t, *zip(*ADF_POINTS, strict=True)))


def engle_granger(pairs: DataFrame) -> dict:
    """Cointegration of b with a: regression, unit-root test of the residuals with one lag, half-life.

    The critical values are those of a single series, so that the test rejects too often
    for residuals of a fitted pair.  Needs 30 rows.
    """
    rows, alpha, beta, r2 = spread(pairs)
    behind = S.lagged(rows.select("ts", "spread"), {"level": ("spread", 1), "before": ("spread", 2)})
    steps = behind.withColumns({"d": F.col("spread") - F.col("level"), "d1": F.col("level") - F.col("before")})
    fit = S.ols(steps, ["level", "d1"], "d")
    first = steps.where("level is not null").agg(F.regr_slope("spread", "level"), F.count("*")).first()
    t = float(fit["t"][1]) if fit and first[1] >= 29 else None
    phi = first[0]
    return {
        "alpha": alpha, "beta": beta, "r2": r2, "n": int(first[1]) + 1, "adf": t, "p": adf_p(t) if t is not None else None, "cointegrated": t is not None and t < ADF_CRITICAL["5%"],
        "half_life": -math.log(2) / math.log(phi) if phi is not None and 0 < phi < 1 else None,
    }


def factor_attribution(wide: DataFrame, target: str, market: str, proxies: dict[str, str]) -> DataFrame:
    """A row a factor: coefficient, error, t, p, contribution (%) and the fit's r2, adjusted_r2, n.

    Factors are the market and, for each proxy, its return less the market's.
    """
    q = lambda c: F.col(f"`{c}`")
    rows = wide.select(q(target).alias("y"), q(market).alias("market"), *[(q(c) - q(market)).alias(n) for n, c in proxies.items()])
    names = ["market", *proxies]
    fit, means = S.ols(rows, names, "y"), rows.agg(*[F.avg(c) for c in ("y", *names)]).first()
    schema = "factor string, coefficient double, error double, t double, p double, contribution_pct double, r2 double, adjusted_r2 double, n long"
    if fit is None:
        return wide.sparkSession.createDataFrame([], schema)
    share = [fit["coefficients"][0], *[fit["coefficients"][i + 1] * means[i + 1] for i in range(len(names))]]
    total = means[0] if means[0] else float("nan")
    out = [(n, *(float(fit[k][i]) for k in ("coefficients", "errors", "t", "p")), float(share[i] / total * 100), fit["r2"], fit["adjusted_r2"], fit["n"]) for i, n in enumerate(["alpha", *names])]
    return wide.sparkSession.createDataFrame(out, schema)


def risk_parity(returns: DataFrame, risk_free: float = 0.05) -> DataFrame:
    """symbol, mean, vol, sharpe (yearly) and weight: inverse volatility, normalised."""
    s = returns.where("ret is not null").groupBy("symbol").agg((F.avg("ret") * YEAR).alias("mean"), (F.stddev_samp("ret") * math.sqrt(YEAR)).alias("vol"))
    s = s.withColumn("inverse", 1 / F.when(F.col("vol") > 0, F.col("vol")))
    total = Window.partitionBy(F.lit(1))
    return s.withColumns({"sharpe": (F.col("mean") - risk_free) / F.when(F.col("vol") > 0, F.col("vol")), "weight": F.col("inverse") / F.sum("inverse").over(total)}).drop("inverse")


def _clamped(w: np.ndarray) -> np.ndarray:
    w = np.maximum(w, 0)
    return w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / len(w))


def optimize(returns: DataFrame, risk_free: float = 0.05, most: int = 20) -> DataFrame:
    """method, symbol, weight for risk_parity, min_variance and max_sharpe; over `most` symbols are an error.

    Sums are taken in Spark; a matrix of most x most is solved on the driver.  Negative
    weights are set to 0 and the rest normalised; a singular matrix gives equal weights.
    """
    means = {r["symbol"]: r["mean"] for r in risk_parity(returns).collect()}
    if len(means) > most:
        raise ValueError(f"{len(means)} symbols, {most} at most: choose some, or give a larger limit")
    symbols = sorted(means)
    at = {s: i for i, s in enumerate(symbols)}
    cov = np.zeros((len(symbols), len(symbols)))
    for r in S.covariance_matrix(returns.where(F.col("symbol").isin(symbols))).collect():
        cov[at[r["a"]], at[r["b"]]] = r["covariance"]
    mu, ones = np.array([means[s] for s in symbols]), np.ones(len(symbols))
    weights = {"risk_parity": _clamped(1 / np.sqrt(np.diag(cov)))}
    for name, target in (("min_variance", ones), ("max_sharpe", mu - risk_free)):
        weights[name] = _clamped(np.linalg.solve(cov, target)) if np.linalg.matrix_rank(cov) == len(symbols) else ones / len(symbols)
    return returns.sparkSession.createDataFrame([(m, s, float(w[i])) for m, w in weights.items() for s, i in at.items()], "method string, symbol string, weight double")
