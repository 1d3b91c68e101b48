"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns: every operator and stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quantloom.llm import bigru, decontamination, host_rules, minmax, mixing, pii, secrets, sharding, toxicity
from tests.llm.texts import SCHEMA, edge_docs, edge_rows, kept_whole, prose


@pytest.fixture(scope="module")
def docs(spark):
    return edge_docs(spark).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_sharding(docs, none):
    got = sharding.shard(docs, shards=4, ranges=8)
    assert got.count() == docs.count()
    per = got.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("k"), F.min("slot").alias("a"), F.max("slot").alias("z")).collect()
    assert all(r["n"] == r["k"] == r["z"] + 1 and r["a"] == 0 for r in per)
    assert got.where("doc_id = 1").first()["size"] == 1 and got.where("doc_id = 1").first()["text_crc32"] == 0
    assert sharding.shard(none).count() == 0
    assert got.where("doc_id in (6, 7) or (doc_id is null and size > 1)").select("shard").distinct().count() == 1


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, prose(80, 2)), (2, ""), (3, None), (4, "single"), (None, "single"), (5, "東京 😀 Z"), (6, prose(12, 77))], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.decontaminate(docs, bench).collect()}
    assert got[6]["_n_hit"] == got[6]["_n_words"] == 80 and got[6]["_items"] == ["1"]
    assert got[8]["_contaminated"] and got[4]["_items"] == ["4"] and got[9]["_items"] == ["5"]
    assert got[1]["_n_words"] == 0 and not got[1]["_contaminated"] and not got[5]["_items"]
    assert decontamination.decontaminate(docs, bench).count() == docs.count()
    assert decontamination.decontaminate(docs, bench, broadcast_bytes=0).where("_contaminated").count() == decontamination.decontaminate(docs, bench).where("_contaminated").count()
    assert decontamination.decontaminate(docs, bench.limit(0)).where("_contaminated").count() == 0
    assert decontamination.decontaminate(none, bench).count() == 0
    kept = decontamination.remove_documents(docs, bench)
    assert kept.columns == docs.columns and kept.where("doc_id in (4, 6, 7, 8, 9)").count() == 0 and kept.where("doc_id = 1").count() == 1
    assert kept.where("_n_hit <> 1 or _items <> 1 or __text_hash <> 1 or row <> 1").count() == 0
    cut = {r["doc_id"]: r["text"] for r in decontamination.remove_spans(docs, bench).collect()}
    assert cut[6] == "" and "東京" not in cut[9] and "Straße" not in cut[9] and "straße" in cut[9] and cut[5] == edge_rows()[4][1]


def test_host_rules(docs, none):
    got = host_rules.judge_hosts(docs)
    assert got.count() == docs.count()
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[1]["n_words"] == rows[2]["n_words"] == rows[3]["n_words"] == 0 and rows[1]["base_failed"]
    assert rows[5]["n_words"] == 30_000 and rows[8]["n_words"] == 80
    assert host_rules.judge_hosts(none).count() == 0
    assert got.columns[: len(docs.columns) - 3] == [c for c in docs.columns if c not in ("text", "n_words", "kept")]
    held = got.drop("n_words", "kept").withColumns({"n_words": F.lit(1), "kept": F.lit(1)})
    assert kept_whole(held)


def test_host_rules_reject_a_bad_host_only(spark):
    good = [(i, prose(80, i), f"h{i % 4}") for i in range(80)]
    bad = [(1000 + i, "###! " * 60, "junk") for i in range(20)] + [(2000, prose(80, 9), "junk")]
    rows = {r["doc_id"]: r for r in host_rules.judge_hosts(spark.createDataFrame(good + bad, "doc_id long, text string, source string")).collect()}
    assert rows[2000]["host_rejected"] and not rows[2000]["kept"] and not rows[2000]["base_failed"]
    assert all(rows[i]["kept"] for i in range(80))


def test_minmax(docs, none):
    got = minmax.link(docs, size=2)
    rows = {r["doc_id"]: r for r in got.where("doc_id is not null").collect()}
    assert got.count() == docs.count()
    assert rows[7]["component_id"] == rows[8]["component_id"] == 6 and rows[6]["kept"] and not rows[7]["kept"]
    assert rows[1]["n_shingles"] == 0 and rows[1]["component_id"] == 1 and rows[4]["n_shingles"] == 1
    assert got.where("doc_id is null and kept and component_id is null").count() == 2
    assert minmax.link(none).count() == 0
    kept = minmax.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (6, 7, 8)").count() == 1 and kept.where("doc_id is null").count() == 2


def test_mixing(docs, none):
    got = mixing.schedule(docs, block_tokens=2_000)
    assert got.where("pass = 0").count() == docs.count()
    assert got.groupBy("block").agg((F.max("place") + 1 - F.count("*")).alias("gap"), F.countDistinct("place").alias("k"), F.count("*").alias("n")).where("gap <> 0 or k <> n").count() == 0
    assert mixing.schedule(none).count() == 0 and mixing.remix(none).count() == 0
    again = mixing.remix(docs)
    assert again.columns == docs.columns and again.count() == got.count()
    assert kept_whole(again) and kept_whole(mixing.remix(docs, max_repeats=1.0))
    less = mixing.remix(docs, budget=2_000, max_repeats=100.0)
    assert 0 < less.count() < docs.count()


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100, 160)] + [(None, 1, 1), (5, None, None)], "doc_id long, toxic int, quality int")
    for known in (labels, labels.limit(0)):
        model = toxicity.train(docs, toxicity.learnable(known))
        got = toxicity.score(docs, model)
        assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
        assert toxicity.reject_toxic(docs, model, 2.0).count() == docs.count()
        assert toxicity.reject_toxic(docs, model).columns == docs.columns and kept_whole(toxicity.reject_toxic(docs, model, 2.0))
    assert toxicity.score(none, model).count() == 0


def test_language(docs, none):
    network = bigru.train(docs, steps=20)
    got = {r["doc_id"]: r for r in bigru.identify(docs, network).collect()}
    assert all(got[i]["lang_pred"] == "und" for i in (1, 2, 3, 11)) and got[9]["lang_pred"] in network.languages
    assert bigru.identify(docs, network).count() == docs.count()
    assert bigru.train(none) is None and bigru.identify(docs, None).where("lang_pred <> 'und'").count() == 0
    assert bigru.identify(none, network).count() == 0


def test_pii(docs, none):
    detector = pii.train(docs)
    got = {r["doc_id"]: r for r in pii.find(docs, detector).collect()}
    assert got[1]["base"] == got[2]["base"] == "" and got[11]["base"].startswith("ip:8:15")
    assert pii.find(docs, detector).count() == docs.count() and pii.find(none, pii.train(none)).count() == 0
    assert kept_whole(pii.redact(docs, detector))
    assert pii.redact(docs, detector).columns == docs.columns and pii.redact(docs, detector).where("doc_id = 1 and text is null").count() == 1


def test_secrets(docs, none):
    scanner = secrets.train(docs)
    assert secrets.scan(docs, scanner).where("end <= start").count() == 0
    assert secrets.scan(none, secrets.train(none)).count() == 0


def test_every_stage_takes_them(spark, docs, tmp_path):
    spark.createDataFrame([(i, i % 2, 0) for i in range(100, 160)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(30, 5)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table_ in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, table_, str(tmp_path))
            got.count()
            if name != "sharding":
                assert got.columns == docs.columns and kept_whole(got)


def test_rows_of_the_edge_table():
    assert len(SCHEMA.split(",")) == len(edge_rows()[0])
