"""Merkle manifest of a dataset: leaves by row, a tree a group, a tree over the groups.

A leaf is the hash of a row's fields.  The leaves of a group stand in order of their ids, and every
eight consecutive nodes become the hash of their digests until one node, the group's subroot, is
left; the subroots, in order of their groups, likewise give the root.

Each level is a window: rows are partitioned by group and parent index, and an ordered
``collect_list`` over the full frame gives a row both its parent's preimage and its siblings; one row
a parent goes on to the next level.  No partition of these windows has over eight rows, so a group may
hold all rows.  Indexes come from ranges of (group, id): rows are sorted in ranges, counted a
range, and a range's offset is added, so that no task sorts a group.

Paths go down from the root: a node's path is its siblings and its parent's path.  Only rows
of (id, digests) are shuffled, never texts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.shared import remainder, settle, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of (range, group) up to which offsets are broadcast.
BROADCAST_ROWS = 100_000


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    """The leaf of a row with these field values, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256))


def folded(leaf: Column, path: Column) -> Column:
    """The root (hex) that a leaf (hex) leads to along `path`."""
    return F.aggregate(path, leaf, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """The hash (hex) of all siblings of a path, level by level, left to right."""
    return F.sha2(F.aggregate(path, F.lit(""), lambda text, s: F.concat(text, s["left"], s["right"])).cast("binary"), 256)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _joined(digests: Column) -> Column:
    return F.array_join(F.transform(digests, _hex), "")


def _indexed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`rows` (settled; g: group) with i, the place in the group by `keys` from 0, and n, the group's rows."""
    tied = settle(rows.withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves")  # fixed once it is written
    order = ["g", *keys, "tie"]
    ranged = settle(tied.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "merkle-ranges")
    ranged = ranged.withColumn("range", F.shiftright("place", 33))
    counts = ranged.groupBy("g", "range").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy("g")
    offset = F.coalesce(F.sum("rows").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = settle(counts.select("g", "range", (offset - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("n")), "merkle-offsets")
    if counts.count() <= BROADCAST_ROWS:
        counts = F.broadcast(counts)
    return ranged.join(counts, ["g", "range"]).withColumn("i", F.col("place") + F.col("shift")).drop("range", "place", "shift", "tie")


def _with_runs(nodes: DataFrame, arity: int) -> DataFrame:
    """`nodes` (g, i, digest, n and others) with parent, at (its place among the siblings) and run (the siblings with itself)."""
    nodes = nodes.withColumns({"parent": F.floor(F.col("i") / arity), "at": F.pmod("i", F.lit(arity)).cast("int")})
    full = Window.partitionBy("g", "parent").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return nodes.withColumn("run", F.collect_list("digest").over(full))


def _parents(runs: DataFrame) -> DataFrame:
    """One node a run: the nodes of the next level."""
    digest = F.unhex(F.sha2(_joined(F.col("run")).cast("binary"), 256))
    return runs.where("at = 0").select("g", F.col("parent").alias("i"), digest.alias("digest"), "n")


def _step() -> Column:
    run, at = F.col("run"), F.col("at")
    left, right = F.slice(run, F.lit(1), at), F.slice(run, at + 2, F.size(run) - at - 1)
    return F.struct(_joined(F.when(at > 0, left).otherwise(F.array())).alias("left"), _joined(right).alias("right"))


def _levels(leaves: DataFrame, arity: int) -> list[DataFrame]:
    """The nodes of each level from the leaves up; a group takes part until it has one node.

    At level k a group of n leaves has ceil(n / arity**k) nodes, so it ends where n <= arity**k.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, size = [leaves], 1
    while size < most:
        runs = _with_runs(levels[-1].where(F.col("n") > size).select("g", "i", "digest", "n"), arity)
        levels.append(settle(_parents(runs), "merkle-level"))
        size *= arity
    return levels


def _ends(levels: list[DataFrame], arity: int) -> DataFrame:
    """g and digest of the node that is left of each group."""
    found = None
    for k, nodes in enumerate(levels):
        ends = nodes.where(F.col("n") <= arity**k).select("g", "digest")
        found = ends if found is None else found.unionByName(ends)
    return found


def _paths(levels: list[DataFrame], above: DataFrame, arity: int) -> DataFrame:
    """The leaves with path and end, down from `above` (g, path, end: what holds for the group's last node)."""
    upper = None
    for k, nodes in reversed(list(enumerate(levels))):
        found = nodes.where(F.col("n") <= arity**k).join(above, "g")  # a row a group that ends here
        if upper is not None:
            runs = _with_runs(nodes.where(F.col("n") > arity**k), arity).join(upper, ["g", "parent"])
            runs = runs.withColumn("path", F.concat(F.array(_step()), F.col("rest"))).drop("parent", "at", "run", "rest")
            found = found.unionByName(runs)
        upper = found.select("g", F.col("i").alias("parent"), F.col("path").alias("rest"), "end")
    return found


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    group: str = "lang",
    order: str = "doc_id",
    carry: Mapping[str, Column] | None = None,
    arity: int = 8,
) -> DataFrame:
    """A row for each row of `docs`: id, group, leaf, subroot, root (hex), path, and the columns of `carry`.

    path: an array of (left, right), the digests before and after the node in its run, from the
    leaf's level to the root's; ``folded(leaf, path)`` is the root.  carry: columns of `docs` to bring
    along, for instance the digest of a copy that is to be verified.

    A null group is a group of its own and comes first.  Null ids come first in their group; rows of
    one id stand by their leaves, and equal rows beside each other.  Null fields hash as ``-``, an
    empty text as ``0:``.  A group with one row has its leaf as subroot; with one group the
    subroot is the root.  No rows give none.  Columns of `docs` that are not named are ignored.
    """
    columns = {f"carried_{k}": c for k, c in (carry or {}).items()}
    name = F.col(group).cast("string")
    rows = docs.select(
        F.when(name.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), name)).alias("g"),
        F.col(order).alias("id"),
        F.col(group).alias("group"),
        leaf_digest([F.col(f) for f in fields]).alias("digest"),
        *[c.alias(k) for k, c in columns.items()],
    )
    levels = _levels(_indexed(rows, ["id", "digest"]), arity)
    subroots = _ends(levels, arity).select(F.lit("").alias("g"), F.col("g").alias("id"), "digest")
    top = _levels(_indexed(subroots, ["id"]), arity)
    no_step = F.expr("cast(array() as array<struct<left: string, right: string>>)")
    root = _ends(top, arity).select("g", no_step.alias("path"), F.col("digest").alias("end"))
    above = _paths(top, root, arity)
    above = above.select(F.col("id").alias("g"), "path", F.struct(F.col("digest").alias("subroot"), F.col("end").alias("root")).alias("end"))
    above = settle(above, "merkle-groups")  # each level reads it
    placed = _paths(levels, above, arity)
    return placed.select(
        "id",
        "group",
        _hex(F.col("digest")).alias("leaf"),
        _hex(F.col("end.subroot")).alias("subroot"),
        _hex(F.col("end.root")).alias("root"),
        "path",
        *[F.col(k).alias(k.removeprefix("carried_")) for k in columns],
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.when(remainder("doc_id", 3) == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    shown = leaf_digest([text if f == "text" else F.col(f) for f in FIELDS])
    found = manifest(docs, carry={"shown": shown}).withColumn("folded_root", folded(_hex(F.col("shown")), F.col("path")))
    return found.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _sql(depth: int = 7, top_depth: int = 4) -> str:
    """The same in SQL, a step a level: for up to 8**depth rows a group and 8**top_depth groups.

    t0 ... are the nodes of the groups' trees, u0 ... of the tree of subroots; a tree that has one
    node keeps it as it is through the levels above.  l and r: the siblings before and after.
    """
    step = "list_reduce(list_prepend(xor(crc, code), range(8)), lambda x, bit: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    codes = "list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda ch: ascii(ch)::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda crc, code: {step}), 4294967295)"
    sized = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(sized(text if f == 'text' else f) for f in FIELDS)})"
    run = lambda k, bounds: f"coalesce(string_agg(d, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN {bounds}), '')"
    parts = [
        f"shown AS (SELECT *, CASE WHEN {crc} % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS changed FROM documents)",
        f"leaves AS (SELECT doc_id, coalesce('1' || lang, '0') AS g, {leaf('text')} AS leaf, {leaf('changed')} AS other FROM shown)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves)",
        "t0 AS (SELECT g, i, n, leaf AS d FROM placed)",
    ]

    def levels(name: str, n: int) -> None:
        for k in range(n):
            parts.append(f"{name}s{k} AS (SELECT g, i, {run(k, 'UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {run(k, '1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM {name}{k} WHERE n > {8**k})")
            node = f"CASE WHEN n > {8**k} THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END"
            parts.append(f"{name}{k + 1} AS (SELECT g, i // 8 AS i, n, {node} AS d FROM {name}{k} GROUP BY g, i // 8, n)")

    levels("t", depth)
    parts.append(f"u0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, d, g AS of FROM t{depth})")
    levels("u", top_depth)
    at, joins, fold, proof = "p.i", [], "other", []
    for name, n, g, start in (("t", depth, "p.g", "p.i"), ("u", top_depth, "''", "u0.i")):
        for k in range(n):
            a = f"{name}s{k}"
            joins.append(f"LEFT JOIN {a} ON {a}.g = {g} AND {a}.i = {start} // {8**k}")
            proof.append(f"coalesce({a}.l || {a}.r, '')")
        if name == "t":
            joins.append("JOIN u0 ON u0.of = p.g")
    parts.append(f"joined AS (SELECT p.doc_id, p.leaf, u0.d AS subroot, (SELECT d FROM u{top_depth}) AS root, sha256({' || '.join(proof)}) AS proof_sha256, p.other, " + ", ".join(f"{a}.l AS {a}_l, {a}.r AS {a}_r" for a in [f"ts{k}" for k in range(depth)] + [f"us{k}" for k in range(top_depth)]) + " FROM placed p " + " ".join(joins) + ")")
    names = [f"ts{k}" for k in range(depth)] + [f"us{k}" for k in range(top_depth)]
    parts.append("f0 AS (SELECT *, other AS h FROM joined)")
    for k, a in enumerate(names):
        parts.append(f"f{k + 1} AS (SELECT * REPLACE (CASE WHEN {a}_l IS NULL THEN h ELSE sha256({a}_l || h || {a}_r) END AS h) FROM f{k})")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, proof_sha256, h AS folded_root, h = root AS verified FROM f{len(names)}"


OP11_SQL = _sql()
