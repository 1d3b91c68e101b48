"""Temperature mixing of sources: token shares raised to an exponent, found by bisection.

A source with share p gets the weight p**a / sum(p**a).  With a = 1 the sources keep their
shares, with a = 0 all weigh the same.  Bisection finds the smallest exponent at which the
weights' entropy is at most the target and no source is repeated more than the limit.  The
weights are then realised: each source is read in passes, each pass in another random order,
up to its token budget, and the passes are cut into blocks, so that every block holds each
source by its weight.

All steps are DataFrame functions, on ids and token counts; texts are not shuffled.  Places
within a source come from two levels of running sums (about the square root of its
documents in each), so no source is gathered in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.shared import settle, table, unit


@dataclass(frozen=True)
class Mix:
    """What `plan_mix` found: the exponent, and a row a source.

    sources: __source, __docs, __tokens, __weight, __budget (tokens), __last (its last pass, from 0).
    """

    exponent: float
    entropy: float
    budget: int
    sources: DataFrame
    small: bool


def count_tokens(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """A row for each id, source and text: __id, __source, __text (a hash), __tokens (words, and one for the end) and __times, how often it stands."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+"))
    named = docs.select(F.col("doc_id").alias("__id"), F.col(source).alias("__source"), F.xxhash64(body).alias("__text"), (words + 1).cast("long").alias("__tokens"))
    return named.groupBy(*named.columns).agg(F.count("*").alias("__times"))


def plan_mix(
    counted: DataFrame,
    target_entropy: float | None = None,
    max_repeats: float = 2.0,
    budget: int | None = None,
    steps: int = 40,
    driver_sources: int = 10_000,
) -> Mix:
    """The exponent and the sources' budgets.

    target_entropy: in nats; None means halfway from the shares' own entropy to that of
    equal weights.  budget: tokens in all; None means the least with which every document
    is read at least once.  Up to `driver_sources` sources are bisected on the driver (a
    number and a count each); with more, each step is an aggregate over the sources' table.
    """
    sources = settle(counted.groupBy("__source").agg(F.sum("__times").alias("__docs"), F.sum(F.col("__tokens") * F.col("__times")).alias("__tokens")), "sources")
    n, total, least, most = sources.agg(F.count("*"), F.sum("__tokens"), F.min("__tokens"), F.max("__tokens")).first()
    if not n:
        return Mix(1.0, 0.0, 0, sources.withColumns({"__weight": F.lit(0.0), "__budget": F.lit(0), "__last": F.lit(0)}), True)
    small = n <= driver_sources
    held = [r[0] / total for r in sources.select("__tokens").collect()] if small else []

    def moments(a: float) -> tuple[float, float]:
        """sum of p**a, and the entropy of the weights."""
        if small:
            z = sum(p**a for p in held)
            return z, -sum(p**a / z * math.log(p**a / z) for p in held)
        p = F.col("__tokens") / total
        z, plogp = sources.agg(F.sum(p**a), F.sum(p**a * F.log(p))).first()
        return z, math.log(z) - a * plogp / z

    natural = moments(1.0)[1]
    target = (natural + math.log(n)) / 2 if target_entropy is None else target_entropy

    def fits(a: float) -> bool:
        z, entropy = moments(a)
        # Repeats of a source are weight * budget / tokens: the most for the least source.
        whole = budget or (most / total) ** (1 - a) * z * total
        repeats = (least / total) ** (a - 1) / z * whole / total
        return entropy <= target + 1e-9 and repeats <= max_repeats + 1e-9

    low, high = 0.0, 1.0
    if fits(low):
        high = low
    for _ in range(steps if high > low else 0):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    z, entropy = moments(high)
    whole = budget or math.ceil((most / total) ** (1 - high) * z * total)
    weight = F.pow(F.col("__tokens") / F.lit(float(total)), F.lit(high)) / z
    share = F.floor(weight * whole + 1e-6).cast("long")
    # Without a stated budget no source gets less than its own tokens.
    share = share if budget else F.greatest(share, "__tokens")
    planned = sources.withColumns({"__weight": weight, "__budget": share}).withColumn(
        "__last", (F.ceil(F.col("__budget") / F.col("__tokens")) - 1).cast("int")
    )
    return Mix(high, entropy, int(whole), planned, small)


def _draws(counted: DataFrame, mix: Mix, seed: int) -> DataFrame:
    """A row a document and pass that falls in its source's budget, with its token offset there."""
    sources = mix.sources.withColumnRenamed("__source", "__s").withColumnRenamed("__tokens", "__of")
    sources = F.broadcast(sources) if mix.small else sources
    joined = counted.join(sources, counted["__source"].eqNullSafe(sources["__s"])).drop("__s")
    passes = joined.withColumn("__pass", F.explode(F.sequence(F.lit(0), F.greatest(F.col("__last"), F.lit(0)))))
    passes = passes.withColumn("__u", _place_of(F.col("__id"), F.col("__text"), F.col("__nth"), F.col("__pass"), seed))
    passes = passes.withColumn("__bucket", F.floor(F.col("__u") * F.ceil(F.sqrt(F.col("__docs")))).cast("int"))
    key = ["__source", "__pass", "__bucket"]
    running = Window.partitionBy("__source").orderBy("__pass", "__bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = passes.groupBy(*key).agg(F.sum("__tokens").alias("__n"))
    buckets = buckets.select(*[F.col(k).alias(f"{k}_b") for k in key], F.coalesce(F.sum("__n").over(running), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*key).orderBy("__u", "__id", "__text", "__nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = passes.withColumn("__before", F.coalesce(F.sum("__tokens").over(inside), F.lit(0)))
    same = placed["__source"].eqNullSafe(buckets["__source_b"])
    same &= (placed["__pass"] == buckets["__pass_b"]) & (placed["__bucket"] == buckets["__bucket_b"])
    located = placed.join(buckets, same).withColumn("__at", F.col("__offset") + F.col("__before"))
    return located.where(F.col("__at") < F.col("__budget"))


def _place_of(doc_id: Column, text_hash: Column, nth: Column, turn: Column, seed: int) -> Column:
    """Where in its source a document is read in a pass: in [0, 1)."""
    return unit(doc_id, text_hash, nth.cast("long"), turn.cast("int"), F.lit(seed))


def schedule(docs: DataFrame, block_tokens: int = 1_000_000, seed: int = 7, **limits) -> DataFrame:
    """The order of reading: doc_id, source, n_tokens, weight, pass, block, place.

    docs: doc_id, source, text.  limits: as in `plan_mix`.  A document stands once for each
    pass in which its source's budget reaches it; place counts from 0 within the block, in
    an order drawn by hash.  Blocks have about `block_tokens` tokens.  The order depends on ids,
    sources and texts alone, not on how the rows are dealt.  A null source is a
    source of its own; null and empty texts count one token; null and repeated ids and repeated
    rows are documents of their own (rows of equal id, source and text are counted, then numbered);
    no rows give none.
    """
    counted = settle(count_tokens(docs), "token-counts")
    mix = plan_mix(counted, **limits)
    blocks = max(1, math.ceil(mix.budget / block_tokens))
    each = counted.withColumn("__nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__times") - 1)))
    drawn = _draws(each, mix, seed).withColumn("__block", F.floor(F.col("__at") * blocks / F.col("__budget")).cast("int"))
    document = ["__id", "__pass", "__text", "__nth"]
    shuffled = Window.partitionBy("__block").orderBy(F.xxhash64(*document, F.lit(seed)), *document, "__source")
    return drawn.select(
        F.col("__id").alias("doc_id"),
        F.col("__source").alias("source"),
        F.col("__tokens").alias("n_tokens"),
        F.col("__weight").alias("weight"),
        F.col("__pass").alias("pass"),
        F.col("__block").alias("block"),
        (F.row_number().over(shuffled) - 1).cast("long").alias("place"),
    )


def remix(docs: DataFrame, seed: int = 7, **limits) -> DataFrame:
    """`docs` with each row repeated as often as its source's budget asks for; the same columns, whatever their names.

    Whole passes follow from the source; in its last pass, a source's documents up to one
    value of their random order are taken, so that texts need no shuffle.  Rows of equal id, source and
    text share that value: the last pass takes all of them or none, so a budget is met within one
    such class.  A null source is a source of its own; null and empty texts count one token;
    null and repeated ids are documents by their texts; no rows give none.
    """
    counted = settle(count_tokens(docs), "token-counts")
    mix = plan_mix(counted, **limits)
    classes = counted.withColumn("__tokens", F.col("__tokens") * F.col("__times")).withColumn("__nth", F.lit(0).cast("long"))
    last = _draws(classes, mix, seed).where(F.col("__pass") == F.col("__last"))
    upto = last.groupBy(F.col("__source").alias("__of")).agg(F.max("__u").alias("__upto"))
    cut = mix.sources.join(upto, F.col("__source").eqNullSafe(F.col("__of")), "left").select(F.col("__source").alias("__s"), "__last", "__upto")
    cut = settle(cut, "mix-cuts")
    cut = F.broadcast(cut) if mix.small else cut
    rows = docs.select(F.struct("*").alias("__row"))  # the caller's columns apart from those here
    joined = rows.join(cut, F.col("__row.source").eqNullSafe(F.col("__s")))
    text = F.xxhash64(F.coalesce(F.col("__row.text"), F.lit("")))
    in_last = _place_of(F.col("__row.doc_id"), text, F.lit(0), F.col("__last"), seed) <= F.col("__upto")
    times = F.col("__last") + F.when(in_last, 1).otherwise(0)
    return joined.select("__row", F.explode(F.when(times >= 1, F.sequence(F.lit(1), times)))).select("__row.*")


def op9_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
