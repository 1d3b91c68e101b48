"""Tests by chance: sign-flip permutations and block-bootstrap paths."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_TRADES, MOST_PERMUTATIONS = 10, 100_000
#: Permutations that take their signs from one hash of a trade.
SIGNS = 60
BLOCK = 21


def sign_flip_test(trades: DataFrame, permutations: int, seed: int = 42, key: str = "symbol", id_: str = "id", pnl: str = "pnl") -> DataFrame:
    """key, n, observed (mean over deviation of the results), hits and p = (hits + 1) / (permutations + 1).

    A trade's sign in a permutation is a bit of a hash of seed, block of SIGNS permutations and
    id, so the result does not depend on how rows are dealt out (observed is rounded to 12 digits).  Fewer than LEAST_TRADES trades:
    p is 1.  Flips keep the sum of squares, so a permutation is one sum of signed results; a
    block's sums come from one hash a trade and are pre-aggregated before the shuffle.
    """
    permutations = min(permutations, MOST_PERMUTATIONS)
    blocks = -(-permutations // SIGNS)
    dealt = trades.where(F.col(pnl).isNotNull()).select(key, F.col(pnl).cast("double").alias("x"), id_, F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))).alias("block"))
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "block", F.col(id_))), 1, SIGNS // 4), 16, 10).cast("long")
    dealt = dealt.withColumn("bits", bits)
    sums = [F.sum(F.col("x") * (1 - 2 * F.shiftright("bits", j).bitwiseAND(1))).alias(f"s{j}") for j in range(SIGNS)]
    got = dealt.groupBy(key, "block").agg(F.count("*").alias("n"), F.sum("x").alias("plain"), F.sum(F.col("x") * F.col("x")).alias("squares"), *sums)

    def value(total: Column) -> Column:
        """Mean over sample deviation; 0 where there is no spread."""
        mean, n = total / F.col("n"), F.col("n")
        var = (F.col("squares") - total * mean) / F.when(n > 1, n - 1)
        return F.when(var > 1e-12 * F.col("squares") / n, mean / F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(0.0)

    observed = value(F.col("plain"))
    hit = [F.when((F.col("block") * SIGNS + j < permutations) & (value(F.col(f"s{j}")) >= observed), 1).otherwise(0) for j in range(SIGNS)]
    by_block = got.select(key, "n", F.round(observed, 12).alias("observed"), reduce(lambda x, y: x + y, hit).alias("hits"))
    out = by_block.groupBy(key).agg(F.max("n").alias("n"), F.max("observed").alias("observed"), F.sum("hits").alias("hits"))
    return out.select(key, "n", "observed", "hits", F.when(F.col("n") >= LEAST_TRADES, (F.col("hits") + 1) / F.lit(permutations + 1)).otherwise(1.0).alias("p"))


def bootstrap_paths(returns: DataFrame, paths: int = 10_000, horizon: int = 252, capital: float = 100_000.0, seed: int = 42, key: str | None = None) -> DataFrame:
    """path, terminal (value) and max_drawdown of paths made of blocks of BLOCK returns.

    returns: ts, ret; all of them, of any number from 30.  With `key`, paths of each of its
    values, under it; values of fewer than 30 returns have none.  A path draws from a generator
    of its own, by seed and number, so that it is the same on any cluster.  Blocks begin from 0
    up to, not including, n - BLOCK.  Places are drawn first, then joined to numbered returns.
    """
    name = key or "_all"
    series = returns.where("ret is not null").select((F.col(key) if key else F.lit(0)).alias(name), "ts", "ret")
    numbered = series.withColumn("place", F.row_number().over(Window.partitionBy(name).orderBy("ts", "ret")) - 1).drop("ts")
    counts = series.groupBy(name).agg(F.count("*").alias("n")).where("n >= 30")
    if not key and counts.isEmpty():
        raise ValueError("needs 30 returns")
    blocks = -(-horizon // BLOCK)

    def draws(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            starts = [np.random.Generator(np.random.Philox(key=[seed, int(k)])).integers(0, n - BLOCK, blocks) for k, n in zip(batch["path"], batch["n"], strict=True)]
            yield pd.DataFrame({name: batch[name], "path": batch["path"], "starts": starts})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for steps in batch["rets"]:
                value = capital * np.cumprod(1 + np.asarray(steps))
                peak = np.maximum.accumulate(np.concatenate([[capital], value]))[1:]
                rows.append((value[-1], ((peak - value) / peak).max()))
            yield batch[[name, "path"]].assign(**dict(zip(("terminal", "max_drawdown"), np.array(rows).reshape(-1, 2).T, strict=True)))

    kind = numbered.schema[name].dataType.simpleString()
    drawn = counts.crossJoin(returns.sparkSession.range(paths).withColumnRenamed("id", "path")).mapInPandas(draws, f"{name} {kind}, path long, starts array<long>")
    begun = drawn.select(name, "path", F.posexplode("starts").alias("block", "start"))
    steps = begun.select(name, "path", F.explode(F.sequence(F.lit(0), F.lit(BLOCK - 1))).alias("i"), "block", "start").select(name, "path", (F.col("block") * BLOCK + F.col("i")).alias("step"), (F.col("start") + F.col("i")).alias("place"))
    joined = steps.where(F.col("step") < horizon).join(numbered, [name, "place"])
    whole = joined.groupBy(name, "path").agg(F.sort_array(F.collect_list(F.struct("step", "ret"))).alias("x")).select(name, "path", F.col("x.ret").alias("rets"))
    return whole.mapInPandas(walk, f"{name} {kind}, path long, terminal double, max_drawdown double").select(*([key] if key else []), "path", "terminal", "max_drawdown")


def path_summary(paths: DataFrame, capital: float = 100_000.0, key: str | None = None, bins: int = 30) -> DataFrame:
    """One row, or one of each value of `key`, over its paths.

    n, mean, p5 ... p95 (the terminal value at index floor(n * q) of the sorted ones),
    below_100 ... below_50 (probabilities of ending under that part of the capital),
    median_drawdown and p95_drawdown (interpolated), and histogram: low, high and n of `bins`
    equal bins of the terminal values, the last one closed; one bin where none differ.
    """
    p = lambda c, q: F.percentile(c, F.lit(q))
    ruin = {f"below_{k}": F.avg(F.when(F.col("terminal") < capital * k / 100, 1.0).otherwise(0.0)).alias(f"below_{k}") for k in (100, 90, 75, 50)}
    by = [key] if key else []
    got = paths.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("terminal").alias("mean"), F.sort_array(F.collect_list("terminal")).alias("sorted"),  # as many as the paths asked for
        *ruin.values(), p("max_drawdown", 0.5).alias("median_drawdown"), p("max_drawdown", 0.95).alias("p95_drawdown"),
    )
    low, high = F.array_min("sorted"), F.array_max("sorted")
    many = F.when(high - low < 2.220446049250313e-16, 1).otherwise(bins)
    width = (high - low) / many
    place = lambda x: F.when(width > 0, F.least(F.floor((x - low) / F.when(width > 0, width)), many - 1)).otherwise(0)
    cells = F.transform(F.sequence(F.lit(0), many - 1), lambda k: F.struct((low + k * width).alias("low"), (low + (k + 1) * width).alias("high"), F.size(F.filter("places", lambda x: x == k)).cast("long").alias("n")))
    at = {f"p{q}": F.get("sorted", F.least(F.floor(F.col("n") * q / 100), F.col("n") - 1).cast("int")).alias(f"p{q}") for q in (5, 25, 50, 75, 95)}
    placed = got.withColumn("places", F.transform("sorted", place))
    return placed.select(*by, "n", "mean", *at.values(), *ruin, "median_drawdown", "p95_drawdown", cells.alias("histogram"))
