"""Merkle manifest against a plain tree."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quantloom.llm import merkle
from tests.llm.texts import SCHEMA, edge_docs, edge_rows, fold


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row: dict) -> str:
    return digest(*("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in merkle.FIELDS))


def climb(nodes: list[str], arity: int = 8) -> tuple[str, list[list[tuple[str, str]]]]:
    """The last node, and for each first node its (left, right) siblings a level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // arity * arity : (i // arity + 1) * arity]
            paths[k].append(("".join(run[: i % arity]), "".join(run[i % arity + 1 :])))
            at[k] = i // arity
        nodes = [digest(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
    return nodes[0], paths


def plain_manifest(rows: list[dict]) -> list[tuple]:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), sorted."""
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for members in groups.values():
        members.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
    climbed = {g: climb([leaf_of(r) for r in groups[g]]) for g in names}
    root, above = climb([climbed[g][0] for g in names])
    out = []
    for g, upper in zip(names, above, strict=True):
        for r, path in zip(groups[g], climbed[g][1], strict=True):
            path = path + upper
            tampered = zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 3 == 0
            node = leaf_of(r | {"text": fold(r["text"])}) if tampered and r["text"] is not None else leaf_of(r)
            for left, right in path:
                node = digest(left, node, right)
            out.append((r["doc_id"], leaf_of(r), climbed[g][0], root, digest(*(x + y for x, y in path)), node, node == root))
    return sorted(out, key=str)


def found(spark, docs) -> list[tuple]:
    docs.write.mode("overwrite").parquet(f"{spark.conf.get('spark.checkpoint.dir')}/manifest/documents.parquet")
    got = merkle.op11_merkle_manifest(spark, f"{spark.conf.get('spark.checkpoint.dir')}/manifest").collect()
    return sorted((tuple(r) for r in got), key=str)


def test_edge_rows(spark):
    rows = [dict(zip([c.split()[0] for c in SCHEMA.split(", ")], r, strict=True)) for r in edge_rows()]
    assert found(spark, edge_docs(spark)) == plain_manifest(rows)


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (8, 9), (64, 65, 1), (513, 7)])
def test_sizes_at_the_borders_of_levels(spark, sizes):
    rows = [{"doc_id": g * 10_000 + i, "source": "s", "lang": (None, "b", "ä")[g], "n_chars": i, "text": f"Text {i}"} for g, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(spark, docs) == plain_manifest(rows)


def test_no_rows_and_a_changed_field(spark):
    docs = edge_docs(spark)
    assert merkle.manifest(docs.limit(0)).count() == 0
    changed = merkle.leaf_digest([F.when(F.col("doc_id") == 5, F.lit("x")).otherwise(F.col(f)) if f == "source" else F.col(f) for f in merkle.FIELDS])
    got = merkle.manifest(docs, carry={"shown": changed}).withColumn("same", merkle.folded(F.lower(F.hex("shown")), F.col("path")) == F.col("root"))
    assert [r["id"] for r in got.where("not same").collect()] == [5]


def test_other_fields_groups_and_arities(spark):
    docs = spark.createDataFrame([(f"k{i:03}", i % 3, i * 1.5) for i in range(50)], "key string, part int, value double")
    got = merkle.manifest(docs, fields=("key", "value"), group="part", order="key", arity=2)
    assert got.count() == 50 and got.select("root").distinct().count() == 1
    assert got.where(merkle.folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    assert got.agg(F.max(F.size("path"))).first()[0] == 5 + 2
