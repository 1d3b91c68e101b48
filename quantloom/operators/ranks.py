"""Ranks of a whole table's values without sorting it in one task.

Sampled splitters cut the values into ranges of near equal size; values are ordered inside their range, and
a row a range hands on how many stood before it.  Equal values are counted before they are ordered, so that
they are one row however many there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges at most.
PARTS = 64


def ranged(df: DataFrame, value: str, parts: int = PARTS, name: str = "__range") -> DataFrame:
    """Adds the number of the row's range of `value` (double, not null), from 0; the cuts are quantiles to a quarter of a range."""
    found = df.approxQuantile(value, [k / parts for k in range(1, parts)], 1 / (4 * parts)) if parts > 1 else []
    cuts = sorted({x for x in found if x == x and abs(x) != float("inf")})
    if not cuts:
        return df.withColumn(name, F.lit(0))
    to_range = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol=value, outputCol=name, handleInvalid="keep")
    return to_range.transform(df).withColumn(name, F.col(name).cast("int"))


def _handed(totals: DataFrame, keys: Sequence[str], ahead: bool = False):
    """A window over a key's ranges (so many rows at most) before this one, or after it."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__range")
    return w.rowsBetween(1, Window.unboundedFollowing) if ahead else w.rowsBetween(Window.unboundedPreceding, -1)


def average_ranks(df: DataFrame, value: str, keys: Sequence[str] = (), parts: int = PARTS) -> DataFrame:
    """keys, value, rank: the rank from 1 of each different value among its key's rows, ties with their mean rank; nulls have none."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    placed = ranged(counts.withColumn("__v", F.col(value).cast("double")), "__v", parts)
    totals = placed.groupBy(*keys, "__range").agg(F.sum("__n").alias("__rows"))
    before = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__range").alias("__at"), F.coalesce(F.sum("__rows").over(_handed(totals, keys)), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys, "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("__range") == F.col("__at")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    placed = placed.withColumn("__in", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(before, same)
    return placed.select(*keys, value, (F.col("__before") + F.col("__in") + (F.col("__n") + 1) / 2).alias("rank"))


def ranked(df: DataFrame, value: str, name: str, keys: Sequence[str] = (), parts: int = PARTS) -> DataFrame:
    """Adds the row's average rank among its key's rows; null for a null value."""
    ranks = average_ranks(df, value, keys, parts)
    ranks = ranks.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(value).alias("__of"), F.col("rank").alias(name))
    same = F.col(value) == F.col("__of")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return df.join(ranks, same, "left").drop("__of", *[f"__k{i}" for i in range(len(keys))])


def adjusted(tests: DataFrame, p: str = "p", label: str = "label", parts: int = PARTS) -> DataFrame:
    """Adds rank (by p, then label) and adjusted, the Benjamini-Hochberg p: the least p * n / rank from this rank on, at most 1."""
    placed = ranged(tests, p, parts)
    totals = placed.groupBy("__range").agg(F.count("*").alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(_handed(totals, ())), F.lit(0))
    whole = F.sum("__rows").over(Window.partitionBy(F.lit(0)))
    counted = totals.select(F.col("__range").alias("__at"), before.alias("__before"), whole.alias("__whole"))
    inside = Window.partitionBy("__range").orderBy(p, label)
    rows = placed.join(counted, F.col("__range") == F.col("__at")).withColumn("rank", (F.col("__before") + F.row_number().over(inside)).cast("int"))
    rows = rows.withColumn("__raw", F.col(p) * F.col("__whole") / F.col("rank"))
    least = rows.groupBy("__range").agg(F.min("__raw").alias("__least"))
    later = least.select(F.col("__range").alias("__to"), F.min("__least").over(_handed(least, (), ahead=True)).alias("__later"))
    down = Window.partitionBy("__range").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(later, F.col("__range") == F.col("__to")).withColumn("adjusted", F.least(F.min("__raw").over(down), F.col("__later"), F.lit(1.0)))
    return rows.select(*tests.columns, "rank", "adjusted")
