"""Near-duplicate documents by min-max hashing of word shingles.

Each random permutation of the shingles gives two signature values, the least and the
greatest, so a signature needs half as many hash evaluations as min-wise hashing.  Bands of
signature values put texts into buckets; texts of one bucket are candidates, and a candidate
pair is a link only if the full shingle sets confirm it.

Work grows with the texts, not with the squares of groups:

* texts with equal shingle sets are one node (their class); classes that share an id are joined;
* in a hub round every node is compared with one hub of each of its buckets, and only in
  buckets that still hold nodes of different components;
* what the rounds leave is compared in full: in each bucket the nodes outside its largest
  component against all of its nodes, in blocks of bounded size that are compared as a
  whole by matrix products and return nothing but links.

So every pair of nodes that share a bucket is either compared or already in one component.
Two texts at the threshold share no bucket with a chance of (1 - threshold ** (2 *
band_permutations)) ** bands; with 3 and 48 at 0.8 that is 5e-7.

The signatures are made by numpy inside Spark tasks; everything else is joins and
aggregates.  Nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm import bytewords
from quantloom.llm.shared import free, settle, table

_THREE = np.uint64(3)


def shingles(words: bytewords.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every shingle; a text of fewer words, but not none, has one: all its words."""
    h = words.hashes()
    row, first, counts = words.row, words.first, words.counts
    value = bytewords.mix(h + np.uint64(size))
    for k in range(1, size):
        nxt = np.zeros_like(h)
        nxt[: max(len(h) - k, 0)] = h[k:]
        left = first[row + 1] - np.arange(len(h)) > k if len(h) else np.zeros(0, bool)
        step = bytewords.mix(value * _THREE + nxt)
        value = np.where(left, step, value)  # only a short text keeps a value of fewer words
    place = np.arange(len(h)) - first[row] if len(h) else np.zeros(0, np.int64)
    keep = (place <= counts[row] - size) | (place == 0) if len(h) else np.zeros(0, bool)
    return value[keep], row[keep]


def distinct_shingles(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text, sorted, one text after the other; and where each text begins."""
    bounds = np.searchsorted(row, np.arange(rows + 1))
    parts = [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    counts = np.array([len(p) for p in parts], dtype=np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)])


def _signer(size: int, bands: int, permutations: int, seed: int):
    """A mapInArrow function: doc_id, text, text_hash -> doc_id, text_hash, n_shingles, set_a, set_b, bands."""
    draw = np.random.default_rng(seed)
    factors = draw.integers(0, 1 << 31, bands * permutations, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = draw.integers(0, 1 << 32, bands * permutations, dtype=np.uint32)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, body, offsets in bytewords.slices(batch.column("text")):
                rows = end - start
                values, begins = distinct_shingles(*shingles(bytewords.Words(body, offsets), size), rows)
                counts = np.diff(begins)
                full = np.flatnonzero(counts)
                firsts = begins[:-1][full]
                keys = np.zeros((rows, bands), dtype=np.uint64)
                sums = np.zeros((2, rows), dtype=np.uint64)
                if len(full):
                    short = (values >> np.uint64(32)).astype(np.uint32)
                    for b in range(bands):
                        key = np.full(len(full), b + 1, dtype=np.uint64)
                        for p in range(b * permutations, (b + 1) * permutations):
                            x = short * factors[p] + shifts[p]
                            low, high = np.minimum.reduceat(x, firsts), np.maximum.reduceat(x, firsts)
                            key = bytewords.mix(key * _THREE + ((low.astype(np.uint64) << np.uint64(32)) | high))
                        keys[full, b] = key
                    sums[0, full] = np.add.reduceat(values, firsts)
                    sums[1, full] = np.add.reduceat(bytewords.mix(values ^ np.uint64(0x5BD1E995)), firsts)
                held = np.repeat(counts > 0, bands).reshape(rows, bands)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.where(counts > 0, bands, 0))]).astype(np.int32)),
                    pa.array(keys[held].astype(np.int64, copy=False).view(np.int64)),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, rows),
                        batch.column("text_hash").slice(start, rows),
                        pa.array(counts),
                        pa.array(sums[0].view(np.int64)),
                        pa.array(sums[1].view(np.int64)),
                        lists,
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "bands"],
                )

    return sign


def signatures(docs: DataFrame, size: int = 5, bands: int = 48, permutations: int = 3, seed: int = 11) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_a and set_b (128 bits of the set), bands (a key for each band; none if empty)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>"
    return docs.select("doc_id", "text", "text_hash").mapInArrow(_signer(size, bands, permutations, seed), schema)


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    for start, end, body, offsets in bytewords.slices(column):
        values, begins = distinct_shingles(*shingles(bytewords.Words(body, offsets), size), end - start)
        yield from (values[x:y] for x, y in zip(begins[:-1], begins[1:], strict=True))


def _confirmer(size: int, percent: int):
    """A mapInArrow function: a, b, text_a, text_b -> a, b, linked."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(_sets(batch.column("text_a"), size), _sets(batch.column("text_b"), size), strict=True)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - both
                linked[i] = union > 0 and 100 * both >= percent * union
            yield batch.select(["a", "b"]).append_column("linked", pa.array(linked))

    return confirm


def _block_comparer(size: int, percent: int, slab: int = 4096):
    """An applyInArrow function: the nodes of a block (node, outer, text) -> its links (a, b).

    Every node with outer set is compared with every node that has it not set.
    Intersections are counted by products of 0/1 matrices, a slab of shingles at a time.
    """

    def compare(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        node, outer = block.column("node"), block.column("outer").to_numpy(zero_copy_only=False)
        sets = list(_sets(block.column("text").combine_chunks(), size))
        n = np.array([len(x) for x in sets])
        row = np.repeat(np.arange(len(sets)), n)
        _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        order = np.argsort(code, kind="stable")
        order = order[times[code[order]] > 1]  # a shingle of one node is in no intersection
        code, row = code[order], row[order]
        new = np.concatenate([[0], np.cumsum(np.diff(code) != 0)]) if len(code) else code
        one, two = np.flatnonzero(outer), np.flatnonzero(~outer)
        place = np.zeros(len(sets), dtype=np.int64)
        place[one], place[two] = np.arange(len(one)), np.arange(len(two))
        both = np.zeros((len(one), len(two)), dtype=np.float32)
        for low in range(0, int(new[-1]) + 1 if len(new) else 0, slab):
            a, b = np.searchsorted(new, [low, low + slab])
            columns, rows = new[a:b] - low, row[a:b]
            parts = []
            for mask, count in ((outer[rows], len(one)), (~outer[rows], len(two))):
                m = np.zeros((count, slab), dtype=np.float32)
                m[place[rows[mask]], columns[mask]] = 1
                parts.append(m)
            both += parts[0] @ parts[1].T
        union = n[one][:, None] + n[two][None, :] - both
        i, j = np.nonzero((100 * both >= percent * union) & (union > 0))
        return pa.table({"a": node.take(pa.array(one[i])), "b": node.take(pa.array(two[j]))}).select(["a", "b"])

    return compare


def spread_join(rows: DataFrame, keyed: DataFrame, key: str | list[str], count: str, total: int, parts: int = 1000) -> DataFrame:
    """Inner join of `rows` with the unique keys of `keyed`, where no key gathers in one task.

    count: a column of `keyed`, the number of rows of a key; total: at least their sum.  Keys of
    more than total / parts rows are fewer than `parts`, and are broadcast; the others shuffle.
    """
    hot = F.broadcast(keyed.where(F.col(count) * parts > total))
    rest = keyed.where(F.col(count) * parts <= total)
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(rest, key))


def components(edges: DataFrame, name: str) -> DataFrame:
    """node and component (the least node that it is connected with) for the nodes of `edges` (a, b).

    Alternates large-star and small-star steps, each a grouped minimum and a join, until the
    edges stop changing.  Minima are pre-aggregated, and a hub's minimum is broadcast to its edges.
    """
    current = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-edges")
    before, here = None, current.count()
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("k"))
        large = spread_join(both, least, "u", "k", 2 * here).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large.where("u <> v").distinct(), f"{name}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
        small = spread_join(large, least, "u", "k", large.count())
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        previous, current = current, settle(small.where("u <> v").distinct(), f"{name}-stars")
        free(previous, large)
        # Done when every node hangs on one root that hangs on nothing, and the last step kept the edges.
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if state == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before, here = state, state[0]


def _compare_blocks(current: DataFrame, texts: DataFrame, size: int, percent: int, block: int) -> DataFrame:
    """The links (a, b) between the nodes outside the largest component of each bucket and all of its nodes."""
    outside = F.col("all") - F.col("main.k")
    parts = current.withColumns({"p": F.ceil(outside / block).cast("int"), "q": F.ceil(F.col("all") / (2 * block)).cast("int")})
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outer = parts.where(F.col("component") != F.col("main.component")).select("bucket", "node", F.lit(True).alias("outer"), deal("p").alias("i"), every("q").alias("j"))
    inner = parts.select("bucket", "node", F.lit(False).alias("outer"), deal("q").alias("j"), every("p").alias("i"))
    rows = outer.unionByName(inner).join(texts, "node")
    blocks = rows.groupBy("bucket", "i", "j")
    links = blocks.applyInArrow(_block_comparer(size, percent), "a long, b long").where("a <> b")
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int, parts: int = 1000) -> DataFrame:
    """a, b and linked for each pair of `pairs` (node, hub), by the full sets; a hub with many pairs is salted."""
    total = pairs.count()
    hot = pairs.groupBy("hub").agg(F.count("*").alias("k")).where(F.col("k") * parts > total)
    hot = F.broadcast(hot.select("hub", F.ceil(F.col("k") * parts / max(total, 1)).cast("int").alias("salts")))  # fewer than `parts`
    salts = F.coalesce("salts", F.lit(1))
    dealt = pairs.join(hot, "hub", "left").select("hub", "node", F.pmod(F.xxhash64("node"), salts).cast("int").alias("salt"))
    hubs = texts.select(F.col("node").alias("hub"), F.col("text").alias("text_b")).join(pairs.select("hub").distinct(), "hub", "left_semi")
    hubs = hubs.join(hot, "hub", "left").select("hub", "text_b", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    one = texts.select("node", F.col("text").alias("text_a"))
    full = dealt.join(one, "node").join(hubs, ["hub", "salt"]).select(F.col("node").alias("a"), F.col("hub").alias("b"), "text_a", "text_b")
    return full.mapInArrow(_confirmer(size, percent), "a long, b long, linked boolean")


def link(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    bands: int = 48,
    permutations: int = 3,
    rounds: int = 3,
    few_pairs: int = 20_000_000,
    block: int = 512,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs` (doc_id, text).

    Texts are linked if 100 * |intersection| >= percent * |union| of their shingle sets
    (`size` words after A-Z lower-casing; a text of fewer words is one shingle).
    component_id: the least doc_id reachable over links; kept: doc_id = component_id.
    rounds: hub rounds at most; they end when no more than `few_pairs` pairs are left for the
    full comparison, which is done in blocks of about `block` by 2 * `block` nodes.

    Null and empty texts have no shingles and no links.  Rows with one id are one document:
    they share the component of all their texts.  A row with a null id links nothing and is kept,
    with a null component.  No rows give none.
    """
    # Row numbers stay as they are once the table is written.
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    signed = settle(signatures(docs, size, bands, permutations).withColumn("row", F.monotonically_increasing_id()), "signatures")
    of_set = ["set_a", "set_b", "n_shingles"]
    linkable = signed.where("n_shingles > 0 and doc_id is not null")
    # A node is a class of equal sets, named by its first row; an id may have several.
    classes = linkable.groupBy(*of_set).agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("members"))
    classes = settle(classes, "classes")
    n_rows, n_classes = classes.agg(F.coalesce(F.sum("members"), F.lit(0)), F.count("*")).first()
    in_class = spread_join(linkable.select("doc_id", *of_set), classes.drop("least"), of_set, "members", n_rows)
    in_class = settle(in_class.select("doc_id", "node").distinct(), "class-ids")
    several = in_class.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a")
    same_id = settle(in_class.join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b")), "same-id")

    firsts = signed.join(classes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "doc_id", "text_hash", F.col("n_shingles").alias("n"), "bands")
    firsts = settle(firsts, "class-bands")
    keyed = firsts.select("node", "n", F.explode("bands").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    members = settle(spread_join(keyed, shared, "bucket", "members", n_classes * bands).drop("members"), "bucket-members")

    involved = firsts.join(members.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "text_hash")
    # Id and text hash name a node, so rows that repeat lie side by side already.
    texts = docs.join(involved, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    texts = settle(texts.select("node", "text"), "bucket-texts")
    close = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))

    def labelled(found: DataFrame | None) -> DataFrame:
        if found is None:
            return members.withColumn("component", F.col("node"))
        return members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def open_buckets(of: DataFrame, name: str) -> DataFrame:
        """The members of buckets with more than one component, with the bucket's size, open pairs, and largest component."""
        of = settle(of, f"{name}-labels") if found is not None else of
        sizes = of.groupBy("bucket", "component").agg(F.count("*").alias("k"))
        several = sizes.groupBy("bucket").agg(
            F.sum("k").alias("all"), F.sum(F.col("k") * F.col("k")).alias("squares"), F.max(F.struct("k", "component")).alias("main")
        )
        several = several.where("all * all > squares").select("bucket", "all", "main", ((F.col("all") * F.col("all") - F.col("squares")) / 2).alias("pairs"))
        return settle(spread_join(of, several, "bucket", "all", n_classes * bands), name)

    links = tried = found = None
    for turn in range(rounds + 1):
        current = open_buckets(labelled(found), f"open-{turn}")
        if turn:  # a bucket of two has had its one comparison
            current = current.where(F.col("all") > 2)
        left = current.select("bucket", "pairs").distinct().agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
        if not left:
            break
        full = turn == rounds or (turn > 0 and left <= few_pairs)
        if full:
            new = settle(_compare_blocks(current, texts, size, percent, block), "block-links")
        else:
            # The first round's hub is the least node; later ones differ by bucket and round.
            rank = F.col("node") if turn == 0 else F.xxhash64("node", "bucket", F.lit(turn))
            hub = current.groupBy("bucket", "all").agg(F.min(F.struct(rank.alias("rank"), "node", "n", "component")).alias("hub"))
            pairs = spread_join(current.drop("all"), hub, "bucket", "all", n_classes * bands)
            pairs = pairs.where((F.col("component") != F.col("hub.component")) & close(F.col("n"), F.col("hub.n")))
            pairs = pairs.groupBy(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).agg(F.min("hub.node").alias("hub"))
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = settle(pairs.select((F.when(F.col("a") == F.col("hub"), F.col("b")).otherwise(F.col("a"))).alias("node"), "hub"), f"pairs-{turn}")
            result = settle(_confirmed(pairs, texts, size, percent), f"compared-{turn}")
            result = result.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "linked")
            tried = result.select("a", "b") if tried is None else tried.union(result.select("a", "b"))
            new = result.where("linked").select("a", "b")
        links = new if links is None else links.union(new)
        if full:
            break
        found = components(links, f"links-{turn}")
    every = components(same_id if links is None else same_id.union(links), "all-links")
    every = every.union(every.select("component", "component").distinct())
    # Each component is named by the least id of its classes.
    least = every.join(classes.select("node", "least"), "node")
    names = least.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("k"))
    of_node = spread_join(every, names, "component", "k", n_classes).select("node", "component_id")
    of_node = classes.select("node", "members", "least").join(of_node, "node", "left")
    of_node = settle(of_node.select("node", "members", F.coalesce("component_id", "least").alias("component")), "class-components")
    moved = spread_join(in_class, of_node, "node", "members", n_rows).where("doc_id <> component")
    moved = moved.groupBy("doc_id").agg(F.min("component").alias("component"))
    out = settle(signed.select("doc_id", "n_shingles").join(moved, "doc_id", "left"), "components")
    free(signed, classes, in_class, same_id, firsts, members, texts, of_node)
    component = F.coalesce("component", "doc_id").alias("component_id")
    return out.select("doc_id", "n_shingles", component).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one row of each group of near duplicates: the one with the least id.

    Of several rows with that id one stays (the one whose text has the least hash); rows with
    a null id all stay.
    """
    kept = link(docs.select("doc_id", "text"), size, percent).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__text_hash"))
    with_id = packed.where(F.col("__id").isNotNull())
    once = with_id.join(kept, with_id["__id"] == kept["__kept"], "left_semi")
    once = once.withColumn("__nth", F.row_number().over(Window.partitionBy("__id").orderBy("__text_hash"))).where("__nth = 1")
    return once.select("row.*").unionByName(docs.where(F.col("doc_id").isNull()))


def op8_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents").select("doc_id", "text"), size=2)


OP8_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (
  select distinct doc_id, g from (
    select doc_id, ws[i] || ' ' || ws[i + 1] as g from (select doc_id, ws, unnest(range(1, len(ws))) as i from w where len(ws) >= 2)
    union all select doc_id, ws[1] from w where len(ws) = 1)),
n as (select doc_id, count(*) as n from s group by doc_id),
k as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select x, y from k join n p on p.doc_id = x join n q on q.doc_id = y where 100 * k >= 80 * (p.n + q.n - k)),
reach(a, b) as (select doc_id, doc_id from w union select a, y from reach join links on b = x)
select w.doc_id, coalesce(n, 0)::bigint as n_shingles, c.component_id, w.doc_id = c.component_id as kept
from w left join n using (doc_id) join (select a, min(b) as component_id from reach group by a) c on c.a = w.doc_id
"""
