"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, ranges.

The records are put into one order, by a hash of the text and then by a hash of the id,
so that equal texts stand together.  A sample whose chances follow the records' sizes gives
the boundaries of many ranges of near equal bytes; a range that has too many rows is
subdivided by a second sample of its keys.  Boundaries fall between texts; only a text that
alone fills several ranges has boundaries among its ids.  Offsets inside ranges and offsets
of ranges together give every record its exact place in the order, from which shard and slot
follow.

Groups of equal texts stay whole.  Those that would be felt in a shard's size are dealt first, the
largest to the emptiest shard; the other records then fill the shards up in their order.

Everything is DataFrame functions; texts are never shuffled.  The driver sees only the
sampled keys (about ``oversample`` a range), a row a range and a row a large group, and no
row of the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.shared import free, settle, table, unit

LAW = "bytes"


def _order_key(hash_: Column, tie: Column) -> Column:
    """32 hex digits that sort as (hash, tie) do."""
    return F.concat(F.lpad(F.hex(hash_), 16, "0"), F.lpad(F.hex(tie), 16, "0"))


def _cuts(sample: list[str], parts: int) -> list[str]:
    """The boundaries of about `parts` equal parts of a sample of keys."""
    sample = sorted(sample)
    picked = [sample[len(sample) * i // parts] for i in range(1, parts)] if len(sample) >= parts else sample
    heads: dict[str, int] = {}
    for k in picked:
        heads[k[:16]] = heads.get(k[:16], 0) + 1
    # A range begins at the first record of its text, but for texts that fill several ranges.
    return sorted({x for k in picked for x in ((k[:16], k) if heads[k[:16]] > 1 else (k[:16],))})


def _place(bounds: Column, n: Column | int, most: int, key: Column) -> Column:
    """How many of the first `n` (at most `most`) sorted `bounds` are at or below `key`, by halving steps."""
    width = 1 << most.bit_length()
    steps = F.array(*[F.lit(width >> i) for i in range(1, width.bit_length())])
    step = lambda at, w: F.when((at + w <= n) & (F.get(bounds, at + w - 1) <= key), at + w).otherwise(at)
    return F.aggregate(steps, F.lit(0), step)


def _ranged(keyed: DataFrame, splitters: list[str]) -> DataFrame:
    """`keyed` with range: the number of splitters at or below the key.

    The splitters lie in two levels of about the square root of their number each: the upper
    ones are a literal, the lower ones a broadcast table of sorted arrays.
    """
    if not splitters:
        return keyed.withColumn("range", F.lit(0))
    width = math.isqrt(len(splitters) - 1) + 1
    blocks = [splitters[i : i + width] for i in range(0, len(splitters), width)]
    upper = [b[0] for b in blocks]
    rows = [(0, 0, [])] + [(k + 1, k * width, b) for k, b in enumerate(blocks)]
    lower = F.broadcast(keyed.sparkSession.createDataFrame(rows, "__block int, __from int, __bounds array<string>"))
    block = _place(F.array(*[F.lit(x) for x in upper]), len(upper), len(upper), F.col("key"))
    # Generated, so that the optimizer copies the expression to neither side of the join.
    joined = keyed.withColumn("__block", F.explode(F.array(block))).join(lower, "__block")
    inner = _place(F.col("__bounds"), F.size("__bounds"), width, F.col("key"))
    return joined.withColumn("range", (F.col("__from") + inner).cast("int")).drop("__block", "__from", "__bounds")


def _deal(groups: list[tuple[str, int]], rest: int, shards: int) -> tuple[dict[str, int], list[int]]:
    """The shard of each group (head, bytes), and where in the other records' bytes the shards from the second on begin."""
    filled, at = [0] * shards, {}
    for head, n in sorted(groups, key=lambda g: (-g[1], g[0])):
        at[head] = min(range(shards), key=lambda k: (filled[k], k))
        filled[at[head]] += n
    # The level up to which `rest` bytes fill the shards that are under it.
    order, level, left = sorted(filled), 0.0, rest
    for k, lowest in enumerate(order, 1):
        level = lowest + left / k
        if k == shards or level <= order[k]:
            break
        left -= k * (order[k] - lowest)
    bounds, upto = [], 0.0
    for n in filled[:-1]:
        upto += max(0.0, level - n)
        bounds.append(min(rest, round(upto)))
    return at, bounds


def shard(docs: DataFrame, shards: int = 8, ranges: int = 256, oversample: int = 32, most_rows: int = 1_000_000, group_part: float = 1e-3) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null) for each row of `docs`.

    docs: doc_id, text (other columns are ignored).  Law: the shards' bytes are near equal.
    ranges: sorting ranges, more where the rows are over `most_rows` a range; oversample:
    sampled keys a range; most_rows: rows of a range above which it is subdivided;
    group_part: groups of equal texts with more than this part of a shard's bytes are dealt before the
    other records; there are shards / group_part of them at most.

    A group of equal texts lies in one shard, unless it has more bytes than an equal share:
    then its records are cut by their ids.  So rows of one id stay together where their texts are
    equal, and not where they differ.  Null text: size 1, crc32 0, as the empty text.
    Null or repeated ids and repeated rows each get a slot.  No rows: an empty result.  Shard
    sizes differ by no more than the largest group that is kept whole, and mostly
    by less than 2 * group_part of a shard plus twice the largest record.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = settle(
        docs.select(
            F.col("doc_id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            _order_key(F.xxhash64(text), F.xxhash64(F.col("doc_id"))).alias("key"),
        ),
        "shard-keys",
    )
    total, rows = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    total = max(total, 1)
    ranges = max(ranges, -(-rows // most_rows))
    drawn = lambda df, chance: df.where(unit(F.col("doc_id"), F.col("key"), F.lit("sample")) < chance)
    by_size = F.col("size").cast("double") * ranges * oversample / total
    splitters = _cuts([r[0] for r in drawn(keyed, by_size).select("key").collect()], ranges)

    def overfull(ranged: DataFrame) -> dict[int, int]:
        """Ranges of over `most_rows` rows: fewer than rows / most_rows."""
        return {r[0]: r[1] for r in ranged.groupBy("range").count().where(F.col("count") > most_rows).collect()}

    # Many small records fill no range by bytes: they are sampled by rows.
    ranged = _ranged(keyed, splitters)
    full = overfull(ranged)
    if full:
        table_ = F.broadcast(spark.createDataFrame([(k, oversample * -(-n // most_rows) / n) for k, n in full.items()], "range int, chance double"))
        sample: dict[int, list[str]] = {}
        for r in drawn(ranged.join(table_, "range"), F.col("chance")).select("range", "key").collect():
            sample.setdefault(r[0], []).append(r[1])
        more = [x for k, found in sample.items() for x in _cuts(found, -(-full[k] // most_rows))]
        splitters = sorted(set(splitters) | set(more))
        ranged = _ranged(keyed, splitters)
    head = F.substring("key", 1, 16)
    ranged = ranged.withColumn("head", head)
    # Texts that lie in several ranges: as many as there are splitters among ids at most.
    cut = spark.createDataFrame([(x,) for x in sorted({k[:16] for k in splitters if len(k) > 16})], "head string")
    several = ranged.join(F.broadcast(cut), "head", "left_semi").groupBy("head").agg(F.sum("size").alias("head_bytes"))
    ranged = ranged.join(F.broadcast(settle(several, "shard-cut-texts")), "head", "left")
    whole = Window.partitionBy("range", "head")
    ranged = ranged.repartition("range").withColumn("group_bytes", F.coalesce("head_bytes", F.sum("size").over(whole)))
    # large: dealt as a group; of the others, loose records go by their own places.
    share = total / shards
    ranged = ranged.withColumn("loose", F.col("group_bytes") > share).withColumn("large", (F.col("group_bytes") > share * group_part) & ~F.col("loose"))
    ranged = ranged.withColumn("counted", F.when(F.col("large"), 0).otherwise(F.col("size")))
    inside = Window.partitionBy("range", "large").orderBy("key", "doc_id", "size")
    ordered = settle(
        ranged.withColumn("nth", F.row_number().over(inside) - 1)
        .withColumn("before", F.coalesce(F.sum("counted").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("group_before", F.min("before").over(Window.partitionBy("range", "large", "head")))
        .withColumn("group_nth", F.min("nth").over(Window.partitionBy("range", "large", "head")))
        .drop("key", "counted", "head_bytes"),
        "shard-order",
    )
    free(keyed)
    # A row a range, with running sums, and a row a range and large group, on the driver.
    offsets, at_bytes, at_rows = [], 0, 0
    for k, n_bytes, n in ordered.where("not large").groupBy("range").agg(F.sum("size"), F.count("*")).orderBy("range").collect():
        offsets.append((k, at_bytes, at_rows))
        at_bytes, at_rows = at_bytes + n_bytes, at_rows + n
    groups = ordered.where("large").groupBy("head", "range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).orderBy("head", "range").collect()
    sums: dict[str, int] = {}
    for g in groups:
        sums[g["head"]] = sums.get(g["head"], 0) + g["bytes"]
    dealt, bounds = _deal(list(sums.items()), at_bytes, shards)

    located = ordered.where("not large").join(F.broadcast(spark.createDataFrame(offsets, "range int, bytes_before long, rows_before long")), "range")
    start = F.col("bytes_before") + F.col("group_before")
    # A text in several ranges that stays whole goes by its first range.
    first = located.join(F.broadcast(cut), "head", "left_semi").groupBy("head").agg(F.min(start).alias("head_before"))
    located = located.join(F.broadcast(first), "head", "left")
    at = F.when(F.col("loose"), F.col("bytes_before") + F.col("before")).otherwise(F.coalesce("head_before", start))
    number = _place(F.array(*[F.lit(b) for b in bounds]), len(bounds), len(bounds), at) if bounds else F.lit(0)
    columns = ["doc_id", "size", "text_crc32"]
    placed = located.select(*columns, number.cast("int").alias("shard"), (F.col("rows_before") + F.col("nth")).alias("at"))
    firsts = {r[0]: (r[1], r[2]) for r in placed.groupBy("shard").agg(F.min("at"), F.count("*")).collect()}  # a row a shard
    taken = {k: n for k, (_, n) in firsts.items()}
    begins = []
    for g in groups:
        k = dealt[g["head"]]
        begins.append((g["head"], g["range"], k, taken.get(k, 0)))
        taken[k] = taken.get(k, 0) + g["rows"]
    shard_first = F.broadcast(spark.createDataFrame([(k, n) for k, (n, _) in firsts.items()], "shard int, first long"))
    loose = placed.join(shard_first, "shard").select(*columns, "shard", (F.col("at") - F.col("first")).alias("slot"))
    heads = F.broadcast(spark.createDataFrame(begins, "head string, range int, shard int, begin long"))
    large = ordered.where("large").join(heads, ["head", "range"]).select(*columns, "shard", (F.col("begin") + F.col("nth") - F.col("group_nth")).alias("slot"))
    return loose.unionByName(large).select(
        *columns[:3],
        F.lit(LAW).alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
