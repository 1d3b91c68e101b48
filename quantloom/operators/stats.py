"""Descriptive statistics, distributions, correlation, regressions, tests, multiple comparisons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from quantloom.functions import distributions as D
from quantloom.operators import blocks, ranks


def skew(x: str) -> Column:
    """Skewness from z-scores of the sample deviation, with a bias factor; 0 for fewer than 3 values or none spread."""
    n = F.count(x).cast("double")
    raw = F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2) * F.pow((n - 1) / n, 1.5) * F.skewness(x)
    return F.when((n >= 3) & (F.stddev_samp(x) > 0), raw).otherwise(0.0)


def excess_kurtosis(x: str) -> Column:
    """Excess kurtosis from z-scores of the sample deviation, with a bias factor; 0 for fewer than 4 values or none spread."""
    n = F.count(x).cast("double")
    fourth = F.pow((n - 1) / n, 2) * (F.kurtosis(x) + 3)
    raw = (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * fourth - 3 * (n - 1))
    return F.when((n >= 4) & (F.stddev_samp(x) > 0), raw).otherwise(0.0)


def describe(df: DataFrame, x: str, keys: list[str]) -> DataFrame:
    """n, mean, std, median, p5, p25, p75, p95, min, max, skew, kurtosis by `keys`."""
    p = lambda q: F.percentile(x, F.lit(q))
    return df.where(F.col(x).isNotNull()).groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"), F.median(x).alias("median"),
        p(0.05).alias("p5"), p(0.25).alias("p25"), p(0.75).alias("p75"), p(0.95).alias("p95"), F.min(x).alias("min"), F.max(x).alias("max"), skew(x).alias("skew"), excess_kurtosis(x).alias("kurtosis"),
    )


def histogram(df: DataFrame, x: str, bins: int, keys: list[str]) -> DataFrame:
    """keys, bin (from 0), low, high, n, frequency of equal-width bins; the last one is closed, empty ones are there.

    One bin holds everything where all values are equal.
    """
    values = df.where(F.col(x).isNotNull())
    ends = values.groupBy(*keys).agg(F.min(x).alias("low_"), F.max(x).alias("high_"), F.count("*").alias("total"))
    ends = ends.withColumn("bins", F.when(F.col("high_") - F.col("low_") < 2.220446049250313e-16, 1).otherwise(bins)).withColumn("width", (F.col("high_") - F.col("low_")) / F.col("bins"))
    place = F.when(F.col("bins") == 1, 0).otherwise(F.least(F.floor(F.try_divide(F.col(x) - F.col("low_"), F.col("width"))), F.col("bins") - 1)).cast("int")
    counts = values.join(ends, keys).groupBy(*keys, place.alias("bin")).agg(F.count("*").alias("n"))
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    return grid.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin", (F.col("low_") + F.col("bin") * F.col("width")).alias("low"), (F.col("low_") + (F.col("bin") + 1) * F.col("width")).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("frequency")
    )


def jarque_bera(df: DataFrame, x: str, keys: list[str]) -> DataFrame:
    """n, jb, p (chi-square with 2 degrees), normal (p > 0.05); null for fewer than 8 values or none spread."""
    n = F.count(x)
    jb = n / 6 * (F.pow(F.skewness(x), 2) + F.pow(F.kurtosis(x), 2) / 4)
    got = df.where(F.col(x).isNotNull()).groupBy(*keys).agg(n.alias("n"), F.when((n >= 8) & (F.stddev_pop(x) > 0), jb).alias("jb"))
    return got.withColumn("p", F.exp(-F.col("jb") / 2)).withColumn("normal", F.col("p") > 0.05)


def tail_ratio(df: DataFrame, x: str, keys: list[str]) -> DataFrame:
    """left and right: values beyond two sample deviations of the mean; ratio = left / right, 999.99 if right is 0 and left is not."""
    values = df.where(F.col(x).isNotNull())
    stats = values.groupBy(*keys).agg(F.avg(x).alias("m_"), F.stddev_samp(x).alias("s_"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    got = values.join(stats, keys).groupBy(*keys).agg(count(F.col(x) < F.col("m_") - 2 * F.col("s_")).alias("left"), count(F.col(x) > F.col("m_") + 2 * F.col("s_")).alias("right"))
    return got.withColumn("ratio", F.when(F.col("right") > 0, F.col("left") / F.when(F.col("right") > 0, F.col("right"))).when(F.col("left") > 0, 999.99).otherwise(0.0))


def t_test(df: DataFrame, x: str, keys: list[str], mu: float = 0.0) -> DataFrame:
    """n, t and the two-sided p of mean = mu; null for fewer than 2 values or none spread."""
    n, s = F.count(x), F.stddev_samp(x)
    got = df.where(F.col(x).isNotNull()).groupBy(*keys).agg(n.alias("n"), F.when((n >= 2) & (s > 0), (F.avg(x) - mu) / F.when(s > 0, s / F.sqrt(n))).alias("t"))
    return got.withColumn("p", t_p(F.col("t"), F.col("n") - 1))


@pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t."""
    return pd.Series(D.t_two_sided(t.to_numpy(float), df.to_numpy(float)))


@pandas_udf(DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper-tail p of F."""
    return pd.Series(D.f_upper(f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)))


@pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return pd.Series(D.normal_cdf(z.to_numpy(float)))


def pearson_p(r: Column, n: Column) -> Column:
    """p of a correlation by t with n - 2 degrees; 0 where 1 - r * r vanishes."""
    rest = 1 - r * r
    t = r * F.sqrt((n - 2) / F.when(rest >= 2.220446049250313e-16, rest))
    return F.when(n > 2, F.when(rest < 2.220446049250313e-16, 0.0).otherwise(t_p(t, (n - 2).cast("double"))))


def correlation(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """n, pearson, spearman (average ranks), covariance by `keys`; correlations are 0 with fewer than 2 pairs or none spread."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    both = ranks.ranked(ranks.ranked(rows, a, "ra_", keys), b, "rb_", keys)
    zero = lambda c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    return both.groupBy(*keys).agg(F.count("*").alias("n"), zero(F.corr(a, b)).alias("pearson"), zero(F.corr("ra_", "rb_")).alias("spearman"), F.covar_samp(a, b).alias("covariance"))


def covariance_matrix(returns: DataFrame, key: str = "symbol", at: str = "ts", x: str = "ret", factor: float = 252.0, width: int = 256, times: int = 4096) -> DataFrame:
    """a, b, n, covariance (times factor) and correlation of every two series on the times that both have; each pair both ways.

    returns: one row a series and time; null values are no rows.  Sums of products come from matrices: `width` series or
    so by `times` times or so, with a matrix of ones where a value stands, so that a pair's sums are over the times that both
    have.  A row goes to each pair of blocks of series that holds its own, and a matrix gives a
    row a pair; no time is expanded into its pairs.  Values are taken about their series' mean, for precision.
    """
    rows = returns.where(F.col(x).isNotNull()).select(F.col(key).alias("a"), F.col(at).alias("t"), F.col(x).cast("double").alias("x"))
    total, series = rows.agg(F.count("*"), F.approx_count_distinct("a")).first()
    blocks = max(1, -(-series // width))
    chunks = max(1, total // (max(series, 1) * times))
    means = rows.groupBy(F.col("a").alias("of")).agg(F.avg("x").alias("mean"))
    rows = rows.join(means, F.col("a") == F.col("of")).select("a", "t", (F.col("x") - F.col("mean")).alias("x"), F.pmod(F.xxhash64("a"), F.lit(blocks)).alias("own"), F.pmod(F.xxhash64("t"), F.lit(chunks)).alias("chunk"))
    wide = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    wide = wide.select("a", "t", "x", "own", "chunk", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def sums(where: tuple, group: pd.DataFrame) -> pd.DataFrame:
        times_, t = np.unique(group["t"].to_numpy(), return_inverse=True)
        sides = []
        for block in (where[0], where[1]):
            mine = (group["own"] == block).to_numpy()
            symbols, s = np.unique(group["a"].to_numpy()[mine].astype(str), return_inverse=True)
            values, ones = np.zeros((len(times_), len(symbols))), np.zeros((len(times_), len(symbols)))
            values[t[mine], s], ones[t[mine], s] = group["x"].to_numpy()[mine], 1.0
            sides.append((symbols, values, ones))
        (a, xa, ma), (b, xb, mb) = sides
        got = [ma.T @ mb, xa.T @ mb, ma.T @ xb, (xa * xa).T @ mb, ma.T @ (xb * xb), xa.T @ xb]
        p, q = np.nonzero(got[0])
        if where[0] == where[1]:
            p, q = p[p <= q], q[p <= q]
        left, right = a[p], b[q]
        turned = left > right
        cells = [m[p, q] for m in got]
        for one, two in ((1, 2), (3, 4)):
            cells[one], cells[two] = np.where(turned, cells[two], cells[one]), np.where(turned, cells[one], cells[two])
        return pd.DataFrame({"a": np.where(turned, right, left), "b": np.where(turned, left, right), **dict(zip(names, cells, strict=True))})

    parts = wide.groupBy("i", "j", "chunk").applyInPandas(sums, "a string, b string, " + ", ".join(f"{c} double" for c in names))
    half = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in names])
    n = F.col("n")
    product = F.col("sxy") - F.col("sx") * F.col("sy") / n
    spread = (F.col("sxx") - F.col("sx") * F.col("sx") / n) * (F.col("syy") - F.col("sy") * F.col("sy") / n)
    figures = [n.cast("long").alias("n"), F.when(n > 1, product / F.when(n > 1, n - 1) * factor).alias("covariance"), F.when(spread > 0, product / F.sqrt(F.when(spread > 0, spread))).alias("correlation")]
    there, back = F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    ways = F.when(F.col("a") == F.col("b"), F.array(there)).otherwise(F.array(there, back))
    both = half.select(F.explode(ways).alias("w"), *figures).select("w.*", "n", "covariance", "correlation")
    kind = returns.schema[key].dataType
    return both.withColumns({c: F.col(c).cast(kind) for c in ("a", "b")})


def numbered(df: DataFrame, name: str, by: str = "ts", span: str = "month") -> DataFrame:
    """Adds the row number, from 1, in order of `by`; rows without a time come first, ties as they fall.

    Rows are numbered in spans of time, and a row a span hands on how many came before it, so
    that only as many rows as the calendar has spans are sorted in one task.
    """
    rows = df.withColumn("__span", F.date_trunc(span, by))
    counts = rows.groupBy("__span").agg(F.count("*").alias("__n"))
    earlier = Window.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("__span").alias("__of"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    rows = rows.withColumn("__in", F.row_number().over(Window.partitionBy("__span").orderBy(by)))
    joined = rows.join(before, F.col("__span").eqNullSafe(F.col("__of")))
    return joined.select(*df.columns, (F.col("__before") + F.col("__in")).alias(name))


def lagged(df: DataFrame, lags: dict[str, tuple[str, int]], by: str = "ts", block: int = 1 << 16) -> DataFrame:
    """Adds, for each name, the column's value so many rows (0 or more) earlier in order of `by`; null before the first.

    Rows are dealt into blocks of consecutive ones, and the last rows of a block go to the next
    as well, so that no task sorts the whole series.
    """
    reach = max((k for _, k in lags.values()), default=0)
    block = max(block, reach)
    place = lambda k: F.floor((k - 1) / block)
    rows = numbered(df, "__k", by)
    rows = rows.withColumn("__block", F.explode(F.array_distinct(F.array(place(F.col("__k")), place(F.col("__k") + reach)))))
    inside = Window.partitionBy("__block").orderBy("__k")
    rows = rows.withColumns({name: F.lag(c, k).over(inside) for name, (c, k) in lags.items()})
    return rows.where(F.col("__block") == place(F.col("__k"))).drop("__k", "__block")


def lead_lag(pairs: DataFrame, a: str, b: str, most: int) -> DataFrame:
    """lag, n, correlation of a with b so many rows later, for lags from -most to most; rows in order of ts.

    An earlier b is a later a: every row is set beside the `most` before it, and both signs are read off.
    """
    here = pairs.select("ts", F.struct(F.col(a).alias("x"), F.col(b).alias("y")).alias("now"))
    rows = lagged(here, {f"back{k}": ("now", k) for k in range(1, most + 1)})
    pair = lambda lag, x, y: F.struct(F.lit(lag).alias("lag"), F.col(f"{x}.x").alias("x"), F.col(f"{y}.y").alias("y"))
    sides = [pair(0, "now", "now")]
    for k in range(1, most + 1):
        for way in (pair(k, f"back{k}", "now"), pair(-k, "now", f"back{k}")):
            sides.append(F.when(F.col(f"back{k}").isNotNull(), way))
    found = rows.select(F.explode(F.array_compact(F.array(*sides))).alias("p")).select("p.*")
    return found.groupBy("lag").agg(F.count("*").alias("n"), F.corr("x", "y").alias("correlation"))


def normal_matrix(df: DataFrame, columns: list[str], y: str) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'X, X'y, y'y and n of a regression with these columns (a constant first), summed in Spark."""
    xs = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    k = len(xs)
    sums = [F.sum(xs[i] * xs[j]) for i in range(k) for j in range(i, k)] + [F.sum(x * F.col(y)) for x in xs] + [F.sum(F.col(y) * F.col(y)), F.count("*")]
    got = df.dropna(subset=[*columns, y]).agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
    values = [float(v or 0) for v in got]
    m, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = values[at]
            at += 1
    return m, np.array(values[at : at + k]), values[at + k], int(values[-1])


def centred_sums(df: DataFrame, columns: list[str], y: str) -> tuple | None:
    """Means (of the columns, then y), X'X, X'y and y'y about them, and n, over rows without nulls; None without rows.

    Sums of products are taken about the means, for precision.
    """
    rows = df.dropna(subset=[*columns, y])
    means = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate([*columns, y])]).first()
    if means is None or means[0] is None:
        return None
    m, v, yy, n = normal_matrix(rows.select(*[(F.col(c) - means[i]).alias(c) for i, c in enumerate([*columns, y])]), columns, y)
    return np.array(means), m[1:, 1:], v[1:], yy, n


def fit(sums: tuple | None, k: int) -> dict | None:
    """The least-squares fit of y by a constant and the first k columns of `centred_sums`; None if singular or too short."""
    if sums is None:
        return None
    means, m, v, yy, n = sums[0], sums[1][:k, :k], sums[2][:k], sums[3], sums[4]
    if n <= k + 1 or np.linalg.matrix_rank(m) < k:
        return None
    inverse = np.linalg.inv(m)
    beta = inverse @ v
    rss = max(yy - float(beta @ v), 0.0)
    sigma2 = rss / (n - k - 1)
    errors = np.sqrt(np.concatenate([[sigma2 * (1 / n + means[:k] @ inverse @ means[:k])], sigma2 * np.diag(inverse)]))
    coefficients = np.concatenate([[means[-1] - beta @ means[:k]], beta])
    t = coefficients / np.where(errors > 0, errors, np.nan)
    r2 = 1 - rss / yy if yy > 0 else 0.0
    return {
        "coefficients": coefficients, "errors": errors, "t": t, "p": 2 * (1 - D.normal_cdf(np.abs(t))),
        "r2": r2, "adjusted_r2": 1 - (1 - r2) * (n - 1) / (n - k - 1), "rss": rss, "n": n,
    }


def ols(df: DataFrame, columns: list[str], y: str) -> dict | None:
    """coefficients, errors, t, p (normal), r2, adjusted_r2, rss, n of a least-squares fit; None if singular or too short."""
    return fit(centred_sums(df, columns, y), len(columns))


def granger(pairs: DataFrame, cause: str, effect: str, p: int) -> dict | None:
    """F and its p for lags 1..p of `cause` in a regression of `effect` on its own lags; rows in order of ts."""
    lags = {f"e{i}": (effect, i) for i in range(1, p + 1)} | {f"c{i}": (cause, i) for i in range(1, p + 1)}
    rows = lagged(pairs.select("ts", effect, cause), lags).dropna()
    sums = centred_sums(rows, [*[f"e{i}" for i in range(1, p + 1)], *[f"c{i}" for i in range(1, p + 1)]], effect)
    small, large = fit(sums, p), fit(sums, 2 * p)  # the shorter fit's sums are among those of the longer
    if small is None or large is None or large["n"] < 2 * p + 2 or large["rss"] <= 0:
        return None
    free = large["n"] - 1 - 2 * p
    f = ((small["rss"] - large["rss"]) / p) / (large["rss"] / free)
    return {"f": f, "p": float(D.f_upper(np.array([f]), np.array([p]), np.array([free]))[0]), "n": large["n"]}


def granger_pairs(returns: DataFrame, p: int = 5, x: str = "ret", least: int = 60, span: str = "month", size: int | None = None) -> DataFrame:
    """cause, effect, f, p, n: the Granger test of every ordered pair of symbols for lags 1..p of both, in one job.

    returns: symbol, ts, x.  A pair's series are the times that both have; pairs with fewer than `least` are left out,
    and f and p are null where a fit is singular or too short.  Lags are taken in blocks of a pair's rows (span, size: as in
    `blocks`); the sums of products of a pair serve both directions, and pairs are
    solved many at a time where their sums lie.
    """
    one = returns.where(F.col(x).isNotNull()).select(F.col("symbol").alias("a"), "ts", F.col(x).cast("double").alias("xa"))
    two = one.select(F.col("a").alias("b"), "ts", F.col("xa").alias("xb"))
    pairs = one.join(two, "ts").where("a < b").select(F.struct("a", "b").alias("symbol"), "ts", "xa", "xb")
    names = [f"{c}{k}" for c in ("a", "b") for k in range(1, p + 1)]
    along = Window.partitionBy("symbol").orderBy("ts")
    lags = {f"{c}{k}": F.lag(f"x{c}", k).over(along) for c in ("a", "b") for k in range(1, p + 1)}
    rows = blocks.in_blocks(pairs, lambda b: b.withColumns(lags), p, span=span, size=size)
    zs = [F.col(c) for c in [*names, "xa", "xb"]]
    whole = F.col(names[p - 1]).isNotNull() if p else F.lit(True)
    products = [F.sum(F.when(whole, zs[i] * zs[j])) for i in range(len(zs)) for j in range(i, len(zs))]
    sums = rows.groupBy("symbol").agg(F.count("*").alias("times"), F.count(F.when(whole, 1)).alias("n"), F.array(*[F.sum(F.when(whole, z)) for z in zs], *products).alias("sums"))
    k = len(zs)
    up = np.triu_indices(k)

    def solve(batches):
        for g in batches:
            n = g["n"].to_numpy(float)
            s = np.array([np.asarray(v, float) for v in g["sums"]]).reshape(len(g), -1)
            m = np.zeros((len(g), k, k))
            m[:, up[0], up[1]] = m[:, up[1], up[0]] = s[:, k:]
            m -= s[:, :k, None] * s[:, None, :k] / n[:, None, None]  # about the means
            for effect, own, others in (("b", range(p, 2 * p), range(p)), ("a", range(p), range(p, 2 * p))):
                y = 2 * p + (effect == "b")
                small, large = (_residual(m, list(q), y, n) for q in (own, [*own, *others]))
                free = n - 1 - 2 * p
                with np.errstate(all="ignore"):
                    f = np.where((n >= 2 * p + 2) & (large > 0) & (free > 0), (small - large) / p / (large / free), np.nan)
                tail = D.f_upper(np.nan_to_num(f), np.full(len(f), float(p)), np.maximum(free, 1.0))
                cause = "a" if effect == "b" else "b"
                yield pd.DataFrame({"cause": g[cause], "effect": g[effect], "f": f, "p": np.where(np.isnan(f), np.nan, tail), "n": g["n"]})

    kind = one.schema["a"].dataType.simpleString()
    flat = sums.where(F.col("times") >= least).where("n > 0").select("symbol.a", "symbol.b", "n", "sums")
    got = flat.mapInPandas(solve, f"cause {kind}, effect {kind}, f double, p double, n long")
    return got.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("f", "p")})


def _residual(m: np.ndarray, q: list[int], y: int, n: np.ndarray) -> np.ndarray:
    """The residual sums of squares of y on the variables q, by sums of products about the means; nan where singular or too short."""
    x, v = m[:, q][:, :, q], m[:, q, y]
    good = (n > len(q) + 1) & (np.linalg.matrix_rank(x) == len(q))
    out = np.full(len(m), np.nan)
    if good.any():
        beta = np.linalg.solve(x[good], v[good][:, :, None])[:, :, 0]
        out[good] = np.maximum(m[good, y, y] - (beta * v[good]).sum(1), 0.0)
    return out


def benjamini_hochberg(tests: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Adds rank, adjusted (Benjamini-Hochberg) and significant to a table of tests; ties by label.

    The table has a row a hypothesis; its order and reverse minimum are taken in ranges of p.
    """
    return ranks.adjusted(tests, p).withColumn("significant", F.col("adjusted") <= alpha)


def bonferroni(tests: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    n = tests.count()
    return tests.withColumn("adjusted", F.least(F.col(p) * n, F.lit(1.0))).withColumn("significant", F.col("adjusted") <= alpha)
