"""The store of runs: appends, upserts, cascading deletes and the list queries over them.

Tables: sweeps (id, name, created_at), runs (id, sweep_id, symbol, params, sharpe, total_return,
tags, created_at), trades (run_id, ...), validations (run_id, p).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OBJECTIVES = ("sharpe", "sortino", "calmar", "profit_factor")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], version: str) -> DataFrame:
    """Both tables with one row a key: the latest version; an incoming row wins a tie."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rest = F.struct(*[c for c in both.columns if c not in key and c != "__new"])
    return both.groupBy(*key).agg(F.max_by(rest, F.struct(version, "__new")).alias("r")).select(*key, "r.*")


def cascade_delete(sweeps: DataFrame, runs: DataFrame, trades: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the sweeps in `doomed` (sweep_id), their runs and those runs' trades."""
    gone = runs.join(doomed, "sweep_id", "left_semi").select("run_id")
    return sweeps.join(doomed, "sweep_id", "left_anti"), runs.join(doomed, "sweep_id", "left_anti"), trades.join(gone, "run_id", "left_anti")


def with_tag(runs: DataFrame, text: str) -> DataFrame:
    return runs.where(F.lower(F.coalesce("tags", F.lit(""))).contains(text.lower()))


def overview(runs: DataFrame) -> DataFrame:
    """One row: runs, sweeps, best_sharpe, mean_return."""
    return runs.agg(F.count("*").alias("runs"), F.countDistinct("sweep_id").alias("sweeps"), F.max("sharpe").alias("best_sharpe"), F.avg("total_return").alias("mean_return"))


def best_of_sweeps(sweeps: DataFrame, runs: DataFrame, validations: DataFrame) -> DataFrame:
    """Every sweep with its number of runs, its best run's figures and its least validation p; zeros and nulls without runs."""
    best = runs.groupBy("sweep_id").agg(F.count("*").alias("runs"), F.max("sharpe").alias("best_sharpe"), F.max_by("run_id", F.when(F.col("sharpe").isNotNull(), F.struct("sharpe", "run_id"))).alias("best_run"), F.min("total_return").alias("worst_return"))
    valid = validations.join(runs.select("run_id", "sweep_id"), "run_id").groupBy("sweep_id").agg(F.min("p").alias("least_p"))
    return sweeps.join(best, "sweep_id", "left").join(valid, "sweep_id", "left").withColumn("runs", F.coalesce("runs", F.lit(0)))


def listing(sweeps: DataFrame, runs: DataFrame) -> DataFrame:
    """Sweeps and single runs in one list, the latest first."""
    one = sweeps.select(F.lit("sweep").alias("kind"), F.col("sweep_id").cast("string").alias("id"), F.col("name").alias("title"), "created_at")
    two = runs.where("sweep_id is null").select(F.lit("run").alias("kind"), F.col("run_id").cast("string").alias("id"), F.col("symbol").alias("title"), "created_at")
    return one.unionByName(two, allowMissingColumns=True).orderBy(F.desc("created_at"), "kind", "id")


def page(runs: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Runs by sharpe, nulls last, a page of them."""
    return runs.orderBy(F.desc_nulls_last("sharpe"), "run_id").offset(offset).limit(limit)


def objective(name: str) -> Column:
    """The column that ranks runs; unknown names, and cagr, fall back to sharpe."""
    return F.col(name if name in OBJECTIVES else "sharpe")


def ranked(results: DataFrame, by: str = "sharpe", key: list[str] | None = None) -> DataFrame:
    """Adds rank: by the objective, falling, nulls last; ties by combo."""
    w = Window.partitionBy(*(key or [])).orderBy(objective(by).desc_nulls_last(), "combo")
    return results.withColumn("rank", F.row_number().over(w))


def sensitivity(results: DataFrame, by: str = "sharpe") -> DataFrame:
    """name, value, n and mean objective for every value of every parameter; params is a map."""
    return results.select(F.explode("params").alias("name", "value"), objective(by).alias("o")).groupBy("name", "value").agg(F.count("*").alias("n"), F.avg("o").alias("mean"))


def json_field(text: str, path: str, kind: str = "string") -> Column:
    return F.get_json_object(text, path).try_cast(kind)
