"""Windows along a series of any length, over many tasks: overlapping blocks, values handed on, sliding folds.

A series' rows are numbered in spans of the calendar, a row a span handing on how many came
before it, and dealt into blocks of consecutive rows.  What looks back (or ahead) so many
rows is computed in blocks that hold their neighbours' border rows as well (``in_blocks``); what depends
on all rows before is computed in each block and combined with one value a block, handed on by a small
window over the blocks (``running``).  So no task sorts a series, and a series' rows use as many
tasks as it has blocks.

Sliding folds cost a few steps a row whatever the window's length n: chunks of n rows have a
value from their begin to each row and one from each row to their end, and a window is the end of one
chunk and the begin of the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block.
SIZE = 1 << 16


def placed(df: DataFrame, by: str = "ts", span: str = "month", key: str = "symbol") -> DataFrame:
    """Adds __i, the row's place in its series from 0, in order of `by`; ties as they fall, rows without a time first.

    span: the calendar unit in which rows are numbered; a series' rows of one unit are sorted in one task.
    """
    rows = df.withColumn("__span", F.date_trunc(span, by))
    counts = rows.groupBy(key, "__span").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(key).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col(key).alias("__of"), F.col("__span").alias("__at"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    rows = rows.withColumn("__in", F.row_number().over(Window.partitionBy(key, "__span").orderBy(by)) - 1)
    joined = rows.join(before, F.col(key).eqNullSafe(F.col("__of")) & F.col("__span").eqNullSafe(F.col("__at")))
    return joined.select(*df.columns, (F.col("__before") + F.col("__in")).cast("long").alias("__i"))


def _block(i: Column, size: int) -> Column:
    return F.floor(i / size)


def in_blocks(df: DataFrame, add: Callable[[DataFrame], DataFrame], back: int, ahead: int = 0, by: str = "ts", span: str = "month", size: int | None = None) -> DataFrame:
    """``add(df)`` for an `add` whose windows by symbol reach `back` rows back and `ahead` rows ahead at most.

    `add` sees blocks as symbols (its `symbol` is a struct of the symbol and the block, `__i` the row's place
    in the series) and keeps their rows; border rows are dropped afterwards.  Rows out of a window's reach are
    as absent as rows before the first.
    """
    size = max(size or SIZE, back, ahead, 1)
    rows = df if "__i" in df.columns else placed(df, by, span)
    own = _block(F.col("__i"), size)
    blocks = F.array_distinct(F.array(own, _block(F.col("__i") + back, size), F.greatest(_block(F.col("__i") - ahead, size), F.lit(0))))
    wide = rows.withColumn("__block", F.explode(blocks)).withColumn("symbol", F.struct("symbol", "__block")).drop("__block")
    out = add(wide)
    out = out.where(_block(F.col("__i"), size) == F.col("symbol.__block")).withColumn("symbol", F.col("symbol.symbol"))
    return out if "__i" in df.columns else out.drop("__i")


#: What is handed on: the values of earlier rows, and their value combined with that of the rows since.
_KINDS: dict[str, tuple[Callable, Callable]] = {
    "sum": (F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}


def running(df: DataFrame, values: dict[str, tuple[str, Column]], by: str = "ts", span: str = "month", size: int | None = None) -> DataFrame:
    """Adds, for each name, the sum, max, min or last value (not null) of the symbol's rows up to this one.

    values: name -> (kind, column); the columns look at their own row only.
    """
    size = size or SIZE
    had = "__i" in df.columns
    rows = df if had else placed(df, by, span)
    names = list(values)
    rows = rows.withColumns({"__block": _block(F.col("__i"), size)} | {f"__v_{k}": c for k, (_, c) in values.items()})
    own = Window.partitionBy("symbol", "__block").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda kind, k: F.max_by(f"__v_{k}", F.when(F.col(f"__v_{k}").isNotNull(), F.col("__i"))) if kind == "last" else _KINDS[kind][0](f"__v_{k}")
    blocks = rows.groupBy("symbol", "__block").agg(*[last(kind, k).alias(f"__b_{k}") for k, (kind, _) in values.items()])
    before = Window.partitionBy("symbol").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    handed = blocks.select(F.col("symbol").alias("__s"), F.col("__block").alias("__at"), *[_KINDS[kind][0](f"__b_{k}").over(before).alias(f"__c_{k}") for k, (kind, _) in values.items()])
    joined = rows.join(handed, F.col("symbol").eqNullSafe(F.col("__s")) & (F.col("__block") == F.col("__at")))
    out = joined.withColumns({k: _KINDS[kind][1](F.col(f"__c_{k}"), _KINDS[kind][0](f"__v_{k}").over(own)) for k, (kind, _) in values.items()})
    return out.select(*[c for c in df.columns if c not in names], *([] if had or "__i" not in df.columns else ["__i"]), *names)


def _chunks(n: int) -> tuple:
    """The windows of a chunk of n rows: from its begin, from its end, and all of it."""
    chunk = ["symbol", _block(F.col("__i"), n)]
    up = Window.partitionBy(*chunk).orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*chunk).orderBy(F.desc("__i")).rowsBetween(Window.unboundedPreceding, 0)
    return up, down, Window.partitionBy(*chunk)


def sliding_drawdown(df: DataFrame, name: str, x: str, n: int) -> DataFrame:
    """Adds the deepest fall (a part, 0 to 1) from a peak within the last n returns x, each window starting at 1.

    A window is an end of a chunk of n rows with (growth, peak, worst fall) from each row on, and a begin of the
    next with (trough, worst fall) up to each row; the falls across are those from the first's
    peak to the second's trough.  A return of -1 or less is a loss of everything, a null one is none.  df: with __i;
    in blocks it looks n rows back.
    """
    up, down, whole = _chunks(n)
    order = Window.partitionBy("symbol").orderBy("__i")
    rows = df.withColumn("__g", F.product(F.greatest(1 + F.coalesce(F.col(x), F.lit(0.0)), F.lit(1e-30))).over(up))
    rows = rows.withColumns(
        {
            "__fall": 1 - F.col("__g") / F.greatest(F.max("__g").over(up), F.lit(1.0)),
            "__trough": F.min("__g").over(up),
            "__low": F.min("__g").over(down),
            "__peak": F.max("__g").over(down) / F.col("__g"),
            "__all": F.max_by("__g", "__i").over(whole) / F.col("__g"),
        }
    )
    rows = rows.withColumns({"__worst": F.max("__fall").over(up), "__ahead": F.max(1 - F.col("__low") / F.col("__g")).over(down)})
    before = {k: F.lag(f"__{k}", n).over(order) for k in ("all", "peak", "ahead")}
    across = 1 - before["all"] * F.col("__trough") / before["peak"]
    # With the chunk's last row in the window, the chunk is the window.
    whole_chunk = F.pmod("__i", F.lit(n)) == n - 1
    worst = F.when(whole_chunk, F.col("__worst")).otherwise(F.greatest(F.col("__worst"), before["ahead"], across, F.lit(0.0)))
    return rows.withColumn(name, worst).drop("__g", "__fall", "__trough", "__low", "__peak", "__all", "__worst", "__ahead")
