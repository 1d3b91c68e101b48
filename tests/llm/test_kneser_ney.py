from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from quantloom.llm import kneser_ney
from tests.llm.texts import SCHEMA, edge_docs, edge_rows, prose, space_words


def brute(train: list[str | None], texts: list[str | None]) -> list[tuple]:
    runs = [[*space_words(t), None] for t in train]
    count = Counter(w for r in runs for w in r)
    pairs = Counter((a, b) for r in runs for a, b in zip([None, *r], r, strict=False))
    total, kinds = sum(count.values()), len(count)

    def discounts(values):
        n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
        if not all(n[:3]):
            return [0, 0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        return [0, *[min(max(d, 0.05), k) for d, k in zip(raw, (0.95, 1.95, 2.95), strict=True)]]

    before, after = Counter(b for _, b in pairs), defaultdict(list)
    for (a, _), c in pairs.items():
        after[a].append(c)
    d, e = discounts(pairs.values()), discounts(before.values())
    handed = {a: sum(d[min(c, 3)] for c in cs) / sum(cs) for a, cs in after.items()}
    left = sum(e[min(c, 3)] for c in before.values()) / max(len(pairs), 1) if pairs else 1.0

    def low(w):
        n = before[w]
        return (n - e[min(n, 3)]) / max(len(pairs), 1) + left / (kinds + 1)

    def p(a, w):
        if a not in after:
            return low(w)
        c = pairs[(a, w)]
        return (c - d[min(c, 3)]) / sum(after[a]) + handed[a] * low(w)

    out = []
    for t in texts:
        r = [*space_words(t), None]
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in r)
        out.append((len(r), sum(count[w] > 0 for w in r), base, sum(math.log10(p(a, w)) for a, w in zip([None, *r], r, strict=False))))
    vocabulary = list(count)
    for a in list(after)[:5]:
        assert sum(p(a, w) for w in vocabulary) + p(a, "never seen") == pytest.approx(1)
    return out, total


def test_equals_a_plain_model(spark):
    rows = [r for r in edge_rows() if r[0] is not None and r[0] != 5] + [(500 + i, prose(30, i), "en", "a", 0) for i in range(100)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = kneser_ney.train(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 10 <> 0"))
    got = sorted(tuple(r) for r in kneser_ney.score(docs, model).collect())
    rows.sort(key=lambda r: r[0])
    want, total = brute([r[1] for r in rows if zlib.crc32(str(r[0]).encode()) % 10], [r[1] for r in rows])
    assert model.train_tokens == total
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[1:3] == w[:2]
        assert g[3:5] == (pytest.approx(w[2]), pytest.approx(w[3]))


def test_edge_rows_and_nothing_to_learn(spark):
    docs = edge_docs(spark)
    scored = kneser_ney.score(docs, kneser_ney.train(docs))
    assert scored.count() == docs.count()
    assert scored.where("score > 0 or score is null or isnan(score)").count() == 0
    untrained = kneser_ney.train(docs.limit(0))
    assert kneser_ney.score(docs, untrained).where(F.col("n_known") > 0).count() == 0
    assert kneser_ney.score(docs.limit(0), untrained).count() == 0


@pytest.mark.parametrize(("width", "bits"), [(32, 2), (32, 9), (33, 2), (40, 16), (40, 20)])
def test_pairs_are_packed_and_unpacked(width, bits):
    draw = np.random.default_rng(width)
    pairs = kneser_ney.Pairs(width, bits)
    left, right = (draw.integers(0, 1 << width, 5000) for _ in range(2))
    bucket, key = pairs.pack(left, right)
    assert bucket.min() >= 0 and bucket.max() < 1 << bits and (bits > 9 or len(set(bucket)) == 1 << bits)
    for b in np.unique(bucket)[:200]:
        x, y = pairs.unpack(int(b), key[bucket == b])
        assert (x == left[bucket == b]).all() and (y == right[bucket == b]).all()
    twice = lambda a: np.concatenate([a, a[::-1]])
    b, k, back = pairs.distinct(twice(bucket), twice(key))
    assert (b[back] == twice(bucket)).all() and (k[back] == twice(key)).all() and len(set(zip(b, k, strict=True))) == len(k)
    assert list(zip(b, k, strict=True)) == sorted(zip(b, k, strict=True))
    assert kneser_ney.Pairs.of(1000, 1e9).bits == 30 and kneser_ney.Pairs.of(5 << 32, 1) == kneser_ney.Pairs(35, 6)


def test_wide_ids_many_buckets_and_few_open_files_give_the_same_scores(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(40, i)) for i in range(60)], "doc_id long, text string")
    scores = lambda model: [tuple(r) for r in kneser_ney.score(docs, model).orderBy("doc_id").collect()]
    plain = scores(kneser_ney.train(docs))
    for model in (kneser_ney.train(docs, width=33), kneser_ney.train(docs, per_bucket=20, texts_per_bucket=2)):
        assert all(a[:3] == b[:3] and a[3:] == pytest.approx(b[3:]) for a, b in zip(plain, scores(model), strict=True))
    files = kneser_ney.Files(model.uri, most_open=2)
    for b in range(6):
        files.read(f"pairs-{b}", np.uint64)
    assert len(files.maps) == 2
    assert kneser_ney._slim(np.array([1, 1 << 33])).tolist() == [1, 1 << 33] and kneser_ney._slim(np.array([1, 2])).dtype == np.uint32

    class Far(kneser_ney.Files):
        def _at(self, name):
            fs, path = super()._at(name)
            return pyarrow.fs.SubTreeFileSystem("/", fs), path

    name = next(f"pairs-{b}" for b in range(6) if len(files.read(f"pairs-{b}", np.uint64)))
    far = [Far(model.uri).read(name, np.uint64) for _ in range(2)]
    assert (far[0] == files.read(name, np.uint64)).all() and far[0].filename == far[1].filename != files.read(name, np.uint64).filename
