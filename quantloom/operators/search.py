"""Parameter search and validation: grids, sweeps, walk-forward, Bayesian search, the pipeline of gates."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions import distributions as D
from quantloom.operators import metrics as M
from quantloom.operators import simulation as Sim
from quantloom.operators import store
from quantloom.operators.bars import returns
from quantloom.operators.resampling import sign_flip_test
from quantloom.operators.windows import full, order, trailing, walk_forward_windows


def steps(low: float, high: float, step: float) -> list[float]:
    """low, low + step, ... up to high, counted by whole numbers and rounded to 4 digits."""
    return [round(low + k * step, 4) for k in range(int(math.floor((high - low) / step + 1e-9)) + 1)]


def grid(spark: SparkSession, parameters: dict[str, list[float]]) -> DataFrame:
    """combo (from 0) and params (a map): every combination of the values, the last name running fastest; one empty combo without any."""
    names = list(parameters)
    rows = [(k, dict(zip(names, map(float, values), strict=True))) for k, values in enumerate(itertools.product(*parameters.values()))]
    return spark.createDataFrame(rows, "combo int, params map<string,double>")


def run_combos(bars: DataFrame, combos: DataFrame, signal: Callable[[DataFrame], DataFrame], rules: Sim.Rules) -> tuple[DataFrame, DataFrame]:
    """Bars once for each combo (symbol is "symbol|combo", __of the symbol itself), and the trades of each."""
    few = combos.select(F.collect_list(F.struct("combo", "params")).alias("c")).first()["c"]  # the stated grid
    choices = F.array(*[F.struct(F.lit(r["combo"]).alias("combo"), F.create_map(*[x for k, v in r["params"].items() for x in (F.lit(k), F.lit(v))]).cast("map<string,double>").alias("params")) for r in few])
    rows = bars.withColumn("__c", F.explode(choices)).select(*bars.columns, "__c.combo", "__c.params").withColumn("__of", F.col("symbol"))
    rows = rows.withColumn("symbol", F.concat_ws("|", "symbol", F.col("combo").cast("string")))
    return rows, Sim.backtest(signal(rows), rules).cache()


def sweep(bars: DataFrame, combos: DataFrame, signal: Callable[[DataFrame], DataFrame], rules: Sim.Rules, run: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """A row a symbol and combo: params, trade metrics and equity metrics; all combos in one job.

    signal: adds enter and leave to bars that have params; it sees each symbol and combo as a
    symbol of its own, so that the window operators keep them apart.  The bars are read once
    and each is evaluated for each combo of the stated grid.
    """
    rows, trades = run or run_combos(bars, combos, signal, rules)
    t = M.trade_metrics(trades)
    e = M.equity_metrics(Sim.equity(trades, rows.select("symbol", "ts", "close"), rules.capital))
    keys = rows.select("symbol", "__of", "combo").distinct().join(combos, "combo")
    return keys.join(t, "symbol", "left").join(e, "symbol", "left").drop("symbol").withColumnRenamed("__of", "symbol")


def walk_forward(bars: DataFrame, windows: DataFrame, combos: DataFrame, signal: Callable[[DataFrame], DataFrame], rules: Sim.Rules, by: str = "sharpe") -> DataFrame:
    """A row a symbol and window: the best combo in training, its objective there and in the test span.

    Every window and combo is evaluated in one job; the choice is an argmax, and the test
    figures of the chosen combo are joined to it.
    """
    spans = windows.select("window", F.explode(F.array(F.struct(F.lit("train").alias("part"), F.col("train_start").alias("a"), F.col("train_end").alias("z")), F.struct(F.lit("test").alias("part"), F.col("test_start").alias("a"), F.col("test_end").alias("z")))).alias("s"))
    spans = spans.select("window", "s.*")
    day = F.to_date("ts")
    days = spans.select("window", "part", F.explode(F.sequence("a", "z")).alias("__day"))
    # A row a day of the stated windows; a window's part is a symbol of its own, and its name any text.
    parts = bars.withColumn("__day", day).join(days, "__day").withColumn("symbol", F.to_json(F.struct("symbol", "window", "part"))).drop("window", "part", "__day")
    results = sweep(parts, combos, signal, rules)
    key = F.from_json("symbol", "symbol string, window int, part string")
    results = results.withColumn("__key", key).withColumns({c: F.col(f"__key.{c}") for c in ("window", "part", "symbol")}).drop("__key")
    results = results.withColumn("o", F.coalesce(store.objective(by), F.lit(0.0))).cache()  # both halves read it
    train = results.where("part = 'train'").groupBy("symbol", "window").agg(F.max_by(F.struct("combo", "params", "o"), F.struct(F.col("o"), -F.col("combo"))).alias("best"))
    test = results.where("part = 'test'").select("symbol", "window", "combo", F.col("o").alias("out_of_sample"), "total_return", "trades")
    chosen = train.select("symbol", "window", "best.combo", "best.params", F.col("best.o").alias("in_sample"))
    return chosen.join(test, ["symbol", "window", "combo"], "left")


def position_returns(bars: DataFrame, windows: list[int]) -> DataFrame:
    """symbol, ts, window, ret, entered for each bar and each of the stated windows.

    A position of that window is held on the bar after a close over the mean of so many closes;
    ret is the bar's return while it is held, else 0; entered is 1 on a position's first bar.
    Every window is a column of one pass over the sorted bars, then a row.
    """
    base = returns(bars).withColumns({f"__p{n}": F.coalesce((F.col("close") > full(F.avg("close").over(trailing(n)), n)).cast("int"), F.lit(0)) for n in windows})
    held = lambda n, k: F.coalesce(F.lag(f"__p{n}", k).over(order()), F.lit(0))
    row = lambda n: F.struct(F.lit(n).alias("window"), (F.col(f"__h{n}") * F.coalesce("ret", F.lit(0.0))).alias("ret"), F.when((F.col(f"__h{n}") == 1) & (F.col(f"__b{n}") == 0), 1).otherwise(0).alias("entered"))
    base = base.withColumns({f"__{x}{n}": held(n, k) for n in windows for x, k in (("h", 1), ("b", 2))})
    return base.select("symbol", "ts", F.explode(F.array(*[row(n) for n in windows])).alias("r")).select("symbol", "ts", "r.*")


def _figures() -> list[Column]:
    std = F.stddev_samp("ret")
    sharpe = F.when(std > 0, F.avg("ret") / F.when(std > 0, std) * math.sqrt(252)).otherwise(0.0)
    return [F.count("*").alias("bars"), F.sum("entered").alias("trades"), (F.product(1 + F.col("ret")) - 1).alias("total_return"), sharpe.alias("sharpe")]


def position_sweep(bars: DataFrame, windows: list[int]) -> DataFrame:
    """symbol, window, bars, trades, total_return, sharpe and rank (by sharpe, then the shorter window) of every stated window."""
    got = position_returns(bars, windows).groupBy("symbol", "window").agg(*_figures())
    return got.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(F.round("sharpe", 9)), "window")))


def position_walk_forward(bars: DataFrame, windows: list[int], spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each span of `walk_forward_windows` the window that was best in training, and its test figures; and the stitched curve.

    The first: symbol, span, window, in_sample, out_of_sample (sharpe), test_return.  The second:
    symbol, ts, span, window, equity: test returns of the chosen windows, one span after the other.
    """
    days = lambda part: spans.select(F.col("window").alias("span"), F.lit(part).alias("part"), F.explode(F.sequence(f"{part}_start", f"{part}_end")).alias("day"))
    rows = position_returns(bars, windows).withColumn("day", F.to_date("ts"))
    parts = rows.join(F.broadcast(days("train").unionByName(days("test"))), "day")  # a row a day of the stated spans
    figures = parts.groupBy("symbol", "span", "part", "window").agg(*_figures())
    best = figures.where("part = 'train'").groupBy("symbol", "span").agg(F.max_by(F.struct("window", "sharpe"), F.struct(F.round("sharpe", 9), -F.col("window"))).alias("b"))
    best = best.select("symbol", "span", "b.window", F.col("b.sharpe").alias("in_sample"))
    test = figures.where("part = 'test'").select("symbol", "span", "window", F.col("sharpe").alias("out_of_sample"), F.col("total_return").alias("test_return"))
    chosen = best.join(test, ["symbol", "span", "window"], "left")
    curve = parts.where("part = 'test'").join(best.drop("in_sample"), ["symbol", "span", "window"])
    running = Window.partitionBy("symbol").orderBy("span", "ts")
    return chosen, curve.select("symbol", "ts", "span", "window", F.product(1 + F.col("ret")).over(running).alias("equity"))


def walk_forward_verdict(results: DataFrame, *keys: str) -> DataFrame:
    """The keys (symbol), efficiency (sum out of sample over sum in sample), stability, verdict by fixed bounds."""
    keys = keys or ("symbol",)
    got = results.groupBy(*keys).agg(F.sum("out_of_sample").alias("o"), F.sum("in_sample").alias("i"), F.avg("out_of_sample").alias("mean"), F.avg(F.when(F.col("out_of_sample") > 0, 1.0).otherwise(0.0)).alias("positive"))
    efficiency = F.when(F.col("i") != 0, F.col("o") / F.when(F.col("i") != 0, F.col("i"))).otherwise(0.0)
    stability = F.when(F.col("positive") >= 0.8, "stable").when(F.col("positive") >= 0.5, "moderate").otherwise("unstable")
    verdict = F.when((F.col("mean") >= 0.5) & (efficiency >= 0.8), "strong").when((F.col("mean") >= 0.1) & (efficiency >= 0.7), "acceptable").otherwise("weak")
    return got.select(*keys, efficiency.alias("efficiency"), stability.alias("stability"), verdict.alias("verdict"))


def bayesian(evaluate: Callable[[list[dict[str, float]]], list[float]], space: dict[str, tuple[float, float, float]], evaluations: int = 50, initial: int = 10, batch: int = 4, seed: int = 42) -> list[tuple[dict[str, float], float]]:
    """(parameters, objective) of every point tried, by a Gaussian process and expected improvement.

    evaluate gets a batch of points and runs them as one Spark job (`sweep`).  space: low,
    high and step of each parameter.  Ends early after max(evaluations / 3, 5) points without a
    better one.
    """
    draw, names, tried = np.random.default_rng(seed), list(space), {}
    lattice = [steps(*space[n]) for n in names]

    def random_points(n: int) -> list[tuple[float, ...]]:
        return [tuple(float(draw.choice(v)) for v in lattice) for _ in range(n)]

    def scaled(points) -> np.ndarray:
        return np.array([[(p - space[n][0]) / max(space[n][1] - space[n][0], 1e-12) for n, p in zip(names, x, strict=True)] for x in points])

    def kernel(a: np.ndarray, b: np.ndarray, width: float) -> np.ndarray:
        return np.exp(-((a[:, None] - b[None]) ** 2).sum(-1) / (2 * width * width))

    since, best = 0, -math.inf
    while len(tried) < evaluations and since < max(evaluations // 3, 5):
        if len(tried) < initial:
            wanted = [p for p in dict.fromkeys(random_points(4 * initial)) if p not in tried][: initial - len(tried)]
        else:
            x, y = scaled(tried), np.array(list(tried.values()))
            mean, dev = y.mean(), y.std() or 1.0
            gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
            width = float(np.median(gaps[gaps > 0])) if (gaps > 0).any() else 1.0
            chol = np.linalg.cholesky(kernel(x, x, width) + 1e-6 * np.eye(len(x)))
            weight = np.linalg.solve(chol.T, np.linalg.solve(chol, (y - mean) / dev))
            pool = [p for p in dict.fromkeys(random_points(1000)) if p not in tried]
            if not pool:
                break
            k = kernel(scaled(pool), x, width)
            mu, v = k @ weight, np.linalg.solve(chol, k.T)
            sd = np.sqrt(np.maximum(1 - (v * v).sum(0), 1e-12))
            z = (mu - (y.max() - mean) / dev) / sd
            gain = sd * (z * D.normal_cdf(z) + D.normal_pdf(z))
            wanted = [pool[i] for i in np.argsort(-gain, kind="stable")[:batch]]
        wanted = wanted[: evaluations - len(tried)]
        if not wanted:
            break
        for p, value in zip(wanted, evaluate([dict(zip(names, p, strict=True)) for p in wanted]), strict=True):
            tried[p] = value if value is not None and math.isfinite(value) else -1e9
            since, best = (0, tried[p]) if tried[p] > best else (since + 1, best)
    return [(dict(zip(names, p, strict=True)), v) for p, v in tried.items()]


def parameter(name: str) -> Column:
    return F.col("params")[name]


#: The walk-forward variants of a strategy evaluation: mode, windows, part of a window for training (fixed values).
VARIANTS = tuple((mode, n, part) for mode in ("rolling", "anchored") for n, part in ((5, 0.7), (8, 0.7), (5, 0.8)))


def evaluate(bars: DataFrame, days: DataFrame, combos: DataFrame, signal: Callable[[DataFrame], DataFrame], rules: Sim.Rules, variants=VARIANTS) -> DataFrame:
    """The walk-forward verdicts of every variant: variant, symbol, efficiency, stability, verdict; all windows of all variants in one job."""
    plans = None
    for k, (mode, n, part) in enumerate(variants):
        plan = walk_forward_windows(days, n, part, mode).withColumn("window", F.col("window") + 1000 * k)
        plans = plan if plans is None else plans.unionByName(plan)
    results = walk_forward(bars, plans, combos, signal, rules).withColumn("variant", F.floor(F.col("window") / 1000).cast("int"))
    return walk_forward_verdict(results, "variant", "symbol")


def gates(bars: DataFrame, days: DataFrame, combos: DataFrame, signal: Callable[[DataFrame], DataFrame], rules: Sim.Rules, alpha: float = 0.05, permutations: int = 200, least_returns: int = 30) -> DataFrame:
    """A row a symbol: the best combo of a sweep and how far it comes through the gates.

    passed counts them in order: trades that beat sign flips (p <= alpha), a walk-forward
    with efficiency over 0.5, enough out-of-sample returns; a gate after a failed one is skipped.
    """
    rows, trades = run_combos(bars, combos, signal, rules)
    found = sweep(bars, combos, signal, rules, (rows, trades))
    best = found.groupBy("symbol").agg(F.max_by(F.struct("combo", "sharpe"), F.struct(F.coalesce("sharpe", F.lit(-1e9)), -F.col("combo"))).alias("b")).select("symbol", "b.*")
    of = rows.select("symbol", F.col("__of")).distinct()
    traded = trades.join(of, "symbol").select(F.col("__of").alias("symbol"), "combo", F.unix_timestamp(F.col("entry_ts").cast("timestamp")).alias("id"), "pnl").join(best.select("symbol", "combo"), ["symbol", "combo"])
    chance = sign_flip_test(traded, permutations).select("symbol", "p")
    forward = walk_forward(bars, walk_forward_windows(days), combos, signal, rules)
    tested = walk_forward_verdict(forward).select("symbol", "efficiency", "stability")
    spans = walk_forward_windows(days).agg(F.min("test_start").alias("a"), F.max("test_end").alias("z")).first()
    returns = bars.where(F.to_date("ts").between(F.lit(spans["a"]), F.lit(spans["z"]))).groupBy("symbol").agg(F.count("*").alias("out_of_sample"))
    out = best.join(chance, "symbol", "left").join(tested, "symbol", "left").join(returns, "symbol", "left")
    one, two, three = F.coalesce(F.col("p") <= alpha, F.lit(False)), F.coalesce(F.col("efficiency") > 0.5, F.lit(False)), F.coalesce(F.col("out_of_sample") >= least_returns, F.lit(False))
    return out.withColumn("passed", F.when(~one, 0).when(~two, 1).when(~three, 2).otherwise(3))


def merge_profiles(*profiles: dict[str, float]) -> dict[str, float]:
    """Parameters of the profiles, later ones over earlier: global, strategy, caller."""
    return {k: v for p in profiles for k, v in p.items()}
