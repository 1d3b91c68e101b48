"""Operators against plain Python on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quantloom.llm import bigru, bytewords, catalog, decontamination, mixing, pii, secrets, sharding, shared, toxicity, trees
from tests.llm.texts import WORDS, edge_docs, edge_rows, fold, prose, space_words

SMALL = "/root/testdata/sf0.001"


def rows_of(spark, name="documents"):
    return spark.read.parquet(f"{SMALL}/{name}.parquet").collect()


# Words -------------------------------------------------------------------------------------


def test_words_and_hashes():
    import pyarrow as pa

    texts = [r[1] for r in edge_rows()] + ["a", " a", "a ", "A b\tA"]
    words, hashes = [], {}
    for start, end, body, offsets in bytewords.slices(pa.array(texts), limit=1000):
        w = bytewords.Words(body, offsets)
        h = w.hashes()
        for i in range(end - start):
            found = [bytes(body[w.starts[k] : w.ends[k]]).decode() for k in range(w.first[i], w.first[i + 1])]
            words.append(found)
            for k, x in zip(range(w.first[i], w.first[i + 1]), found, strict=True):
                assert hashes.setdefault(fold(x), h[k]) == h[k]
    assert [[fold(x) for x in ws] for ws in words] == [space_words(t) for t in texts]
    assert len(set(hashes.values())) == len(hashes)


# Near duplicates ---------------------------------------------------------------------------


def components_of(texts: dict[int, str | None], size: int, percent: int = 80) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = space_words(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1))} if w else set()
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in texts}


def family(n: int, edits: int, seed: int) -> list[str]:
    draw = random.Random(seed)
    base = prose(150, seed, [f"w{k}" for k in range(400)]).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(draw.randrange(edits)):
            w[draw.randrange(len(w))] = f"e{draw.randrange(10_000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("few_pairs", [0, 20_000_000])
def test_near_duplicates_in_families(spark, few_pairs):
    from quantloom.llm import minmax

    texts = family(120, 14, 1) + family(60, 30, 2) + [prose(40, k) for k in range(50)] + ["one", "ONE", "one two", ""] + [prose(60, 3)] * 20
    rows = list(enumerate(random.Random(4).sample(texts, len(texts))))
    got = minmax.link(spark.createDataFrame(rows, "doc_id long, text string"), size=2, few_pairs=few_pairs, block=16).collect()
    want = components_of(dict(rows), 2)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_on_the_small_table(spark):
    got = catalog.QUERIES["op8_minmax_dedup"](spark, SMALL).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == components_of({r["doc_id"]: r["text"] for r in rows_of(spark)}, 2)


def test_rows_of_one_id_share_the_component_of_all_their_texts(spark):
    from quantloom.llm import minmax

    a, b = prose(60, 1), prose(60, 2)
    rows = [(1, a), (1, b), (2, b + " x y"), (3, a + " u v"), (4, ""), (5, ""), (5, a), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minmax.link(docs, size=2).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 1, False), (None, None, True)}
    kept = minmax.keep_one(docs, size=2).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 1, 4]

    draw = random.Random(9)
    texts = family(60, 12, 5) + family(40, 40, 6) + [prose(40, k) for k in range(30)]
    rows = [(draw.randrange(90), draw.choice(texts)) for _ in range(200)]
    linked = components_of({n: t for n, (_, t) in enumerate(rows)}, 2)
    parent = {i: i for i, _ in rows}
    for _ in rows:  # ids that share a component of texts, until nothing changes
        for c in set(linked.values()):
            low = min(parent[i] for n, (i, _) in enumerate(rows) if linked[n] == c)
            for n, (i, _) in enumerate(rows):
                parent[i] = min(parent[i], low) if linked[n] == c else parent[i]
    got = minmax.link(spark.createDataFrame([(f"id{i:03d}", t) for i, t in rows], "doc_id string, text string"), size=2, block=16).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {f"id{i:03d}": f"id{c:03d}" for i, c in parent.items()}


def test_a_hot_key_is_joined_and_salted_whole(spark):
    from quantloom.llm import minmax

    rows = spark.createDataFrame([(k % 7 if k % 2 else 100, k) for k in range(500)], "key long, v long")
    keyed = rows.groupBy("key").agg(F.count("*").alias("n")).where("key <> 3")
    for parts in (1, 4, 1000):
        got = minmax.spread_join(rows, keyed, "key", "n", 500, parts).collect()
        assert sorted((r["key"], r["v"]) for r in got) == sorted((k, v) for k, v in ((k % 7 if k % 2 else 100, k) for k in range(500)) if k != 3)
    texts = {k: t for k, t in enumerate([prose(60, 1)] + family(30, 20, 3))}
    pairs = [(k, 1) for k in range(2, 31)] + [(0, 1), (2, 3)]
    for parts in (1, 5, 1000):
        got = minmax._confirmed(spark.createDataFrame(pairs, "node long, hub long"), spark.createDataFrame(list(texts.items()), "node long, text string"), 2, 80, parts)
        got = {(r["a"], r["b"]): r["linked"] for r in got.collect()}
        assert set(got) == set(pairs)
        for (a, b), linked in got.items():
            x, y = ({tuple(w[k : k + 2]) for k in range(len(w) - 1)} for w in (space_words(texts[a]), space_words(texts[b])))
            assert linked == (100 * len(x & y) >= 80 * len(x | y))


# Personal data -----------------------------------------------------------------------------


def base_of(t: str) -> str:
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


def test_personal_data_base_spans(spark):
    got = {r["doc_id"]: r for r in catalog.QUERIES["op2_boosted_pii"](spark, SMALL).collect()}
    for r in rows_of(spark):
        want = base_of(r["text"] or "")
        g = got[r["doc_id"]]
        assert g["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(g["spans"].split(","))
        assert [g[f"n_{k}"] for k in pii.KINDS] == [sum(s.startswith(k + ":") for s in want.split(",")) for k in pii.KINDS]


def test_personal_data_odd_texts():
    draw = random.Random(8)
    for _ in range(3000):
        t = "".join(draw.choice("a1@.+-() 5%é9 ") for _ in range(draw.randrange(60)))
        got = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in sorted(pii.base_spans(t)))
        assert got == base_of(t), t


def test_boosted_trees_find_loosened_formats(spark):
    rows, draw = [], random.Random(3)
    for i in range(400):
        text = prose(30, i)
        if i % 4 == 0:
            text += f" write to user{i}@mail{i}.example.org or call +1 ({draw.randrange(200, 999)}) 555-{draw.randrange(1000, 9999)} " + prose(10, i)
        if i % 4 == 1:
            text += f" see version {draw.randrange(9)}.{draw.randrange(9)} of section {draw.randrange(999)} " + prose(10, i)
        rows.append((i, text))
    detector = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    base, added = detector.spans(prose(10, 1) + " write to jane42(at)mail7(dot)example(dot)org now " + prose(10, 2))
    assert not base and [pii.KINDS[k] for k, _, _ in added] == ["email"]


def test_spans_that_overlap_no_base_span():
    draw = random.Random(2)
    for _ in range(500):
        of = lambda n: [(draw.randrange(4), s, s + draw.randrange(1, 9)) for s in (draw.randrange(60) for _ in range(n))]
        spans, base = of(8), of(draw.randrange(8))
        assert pii.apart(spans, base) == [x for x in spans if not any(x[1] < e and s < x[2] for _, s, e in base)]


def test_generators_take_long_and_dotted_addresses():
    host = " dot ".join(["part", *[f"label{k}" for k in range(9)], "org"])
    for s in ("john.doe at example dot org", "j" * 300 + ".k(at)" + "h" * 200 + "(dot)com", f"a.b at {host}"):
        assert (0, 3, 3 + len(s)) in pii.candidates("to " + s + ", or")
        assert pii.plain_form(0, s).count("@") == 1 and pii.unsure("to " + s + ", or", 0, 3, 3 + len(s))
    assert not pii.unsure("met at noon.Then we", 0, 0, 16) and not pii.unsure("see isbn 978-3-16-148410", 3, 9, 24)


def test_redaction_of_one_text_with_very_many_numbers_is_linear(spark):
    import time

    detector = pii.train(spark.createDataFrame([(i, t) for i, t in enumerate(planted(300, 1)[0])], "doc_id long, text string"))
    seconds = []
    for n in (12_500, 100_000):
        text = " ".join(f"10.0.{k % 256}.{k % 99} 555-{k % 1000:03d}-{k % 10000:04d}" for k in range(n // 2))
        began = time.perf_counter()
        base, added = detector.spans(text)
        seconds.append(time.perf_counter() - began)
        assert len(base) == n // 2 and all(a[2] <= b[1] for a, b in zip(added, added[1:], strict=False))
    assert seconds[1] < 24 * seconds[0]  # 8 times the numbers


def planted(n: int, seed: int) -> tuple[list[str], list[list[tuple[int, int, int]]], list[bool]]:
    """Texts, their loosened spans, and whether a text has a look-alike that is no personal data."""
    draw = random.Random(seed)
    digits = lambda k: "".join(draw.choices("0123456789", k=k))

    def card() -> str:
        d = "4" + digits(14)
        return d + next(x for x in "0123456789" if pii.luhn(d + x))

    texts, spans, alike = [], [], []
    for i in range(n):
        name = f"{draw.choice('jane john maria wei'.split())}{draw.choice(['.', '_', ''])}{draw.choice('doe smith lopez'.split())}{draw.choice(['', digits(2)])}"
        host = f"{draw.choice('mail post corp'.split())}{draw.choice(['', digits(1)])}.example.{draw.choice(['org', 'com', 'de'])}"
        c, ip, tel = card(), ".".join(str(draw.randrange(256)) for _ in range(4)), (digits(3), digits(3), digits(4))
        plain = [(0, f"{name}@{host}"), (1, ip), (2, " ".join(c[k : k + 4] for k in range(0, 16, 4))), (3, f"+1 {tel[0]} {tel[1]} {tel[2]}")]
        loose = [(0, f"{name} at {host.replace('.', ' dot ')}"), (0, f"{name}(at){host.replace('.', '(dot)')}"), (1, ip.replace(".", "[.]")), (2, ".".join(c[k : k + 4] for k in range(0, 16, 4))), (3, f"({tel[0]}) {tel[1]}-{tel[2]}"), (3, "-".join(tel))]
        not_any = ["we met at noon.Then left", f"see version {draw.randrange(9)}.{draw.randrange(9)}.{draw.randrange(9)}", f"on 20{digits(2)}-0{draw.randrange(1, 9)}-1{draw.randrange(9)}", f"sum {draw.randrange(300, 999)},{draw.randrange(300, 999)},{draw.randrange(300, 999)},{draw.randrange(300, 999)}", f"number {c[:12]}.{int(c[12:]) ^ 1:04d}", f"isbn 978-3-16-{digits(6)}-0"]
        what = i % 3
        kind, s = draw.choice(plain) if what == 0 else draw.choice(loose) if what == 1 else (-1, draw.choice(not_any))
        head = prose(10 + i % 20, i + seed) + draw.choice([" write to ", " reach ", " contact: ", " here "])
        texts.append(head + s + " " + prose(12, i + seed + 1))
        spans.append([(kind, len(head), len(head) + len(s))] if what == 1 else [])
        alike.append(what == 2)
    return texts, spans, alike


def test_recall_and_precision_of_added_spans(spark):
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(planted(1500, 1)[0])], "doc_id string, text string")
    detector = pii.train(docs)
    texts, spans, alike = planted(900, 77)
    right = wrong = of = marked = 0
    for t, want, other in zip(texts, spans, alike, strict=True):
        _, added = detector.spans(t)
        of += len(want)
        right += len(set(added) & set(want))
        wrong += len(set(added) - set(want))
        marked += other and bool(added)
    print(f"added spans: recall {right / of:.3f}, precision {right / (right + wrong):.3f}, look-alikes marked {marked} of {sum(alike)}")
    assert right / of >= 0.9 and right / (right + wrong) >= 0.9
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(docs, detector).collect()}
    dotted = [(i, t) for i, t in enumerate(planted(1500, 1)[0]) if re.search(r"[a-z]\.[a-z]+\d* at [a-z0-9]+ dot ", t)]
    assert np.mean(["[email]" in redacted[f"d{i}"] and ". [" not in redacted[f"d{i}"] and ".[" not in redacted[f"d{i}"] for i, _ in dotted]) > 0.9


# Toxicity, language, secrets ---------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    bad = ["vile", "scumbag", "idiot"]
    rows = [(i, prose(40, i) + (f" {bad[i % 3]} " if i % 3 == 0 else " ") + prose(40, i + 5000), int(i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scored = toxicity.score(docs, toxicity.train(docs, toxicity.learnable(docs.select("doc_id", "toxic"))))
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    got = {r["doc_id"]: r["score"] >= 0.3 for r in scored.collect()}
    assert np.mean([got[i] == (i % 3 == 0) for i in held]) > 0.98


def test_ftrl_equals_a_plain_loop():
    draw = np.random.default_rng(4)
    rows = [(np.unique(draw.integers(0, 40, 8)).astype(np.int32), int(draw.random() < 0.4)) for _ in range(120)]
    alpha, beta, l1, l2, cost = 0.7, 1.0, 0.3, 0.1, (1.0, 2.5)
    z, n = Counter(), Counter()

    def weight(c):
        if c != "bias" and abs(z[c]) <= l1:
            return 0.0
        sign = 0.0 if c == "bias" else math.copysign(l1, z[c])
        return -(z[c] - sign) / ((beta + math.sqrt(n[c])) / alpha + l2)

    order = np.random.default_rng(3)
    for _ in range(3):
        for i in order.permutation(len(rows)):
            codes, y = rows[i]
            names = [*codes.tolist(), "bias"]
            w = {c: weight(c) for c in names}
            g = (1 / (1 + math.exp(-sum(w.values()))) - y) * cost[y]
            for c in names:
                sigma = (math.sqrt(n[c] + g * g) - math.sqrt(n[c])) / alpha
                z[c] += g - sigma * w[c]
                n[c] += g * g
    model = toxicity.ftrl(rows, cost, epochs=3, alpha=alpha, beta=beta, l1=l1, l2=l2, least_rows=1)
    want = {c: weight(c) for c in range(40) if weight(c)}
    assert dict(zip(model.coordinates.tolist(), model.weights, strict=True)) == pytest.approx(want)
    assert model.bias == pytest.approx(weight("bias")) and len(want) < 40


def test_toxicity_scores_equal_plain_features(spark):
    texts = {i: t for i, t in enumerate(["Vile vile SCUMBAG, you are vile", "", "one", "a b c d e f g", prose(300, 4), None])}
    words = lambda t: re.findall(r"[A-Za-z\x80-\U0010ffff]+", fold(t))
    h = lambda ws: bytewords.Words(np.frombuffer(" ".join(ws).encode(), np.uint8), np.array([0, len(" ".join(ws).encode())])).hashes()

    def coordinates(t):
        ws = words(t or "")
        k = h(ws) if ws else np.zeros(0, np.uint64)
        pairs = [bytewords.mix(k[i : i + 1] * np.uint64(2 * gap + 1) + k[i + gap : i + gap + 1])[0] for gap in (1, 2, 3) for i in range(len(k) - gap)]
        return {int(x) >> (64 - toxicity.BITS) for x in [*k, *pairs]}

    every = sorted(set().union(*map(coordinates, texts.values())))[::2]
    model = toxicity.Model(np.array(every, np.int32), np.linspace(-0.3, 0.3, len(every)), -0.1, 2)
    weights = dict(zip(every, model.weights, strict=True))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect()}
    for i, t in texts.items():
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(-0.1 + sum(weights.get(c, 0) for c in coordinates(t))))))


def test_toxicity_features_on_the_driver_are_bounded(spark):
    rows = [(i, prose(200, i) + " vile" * (i % 2), i % 2) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    seen = []
    real = toxicity.ftrl
    try:
        toxicity.ftrl = lambda rows, *a, **k: seen.append(sum(4 * len(c) for c, _ in rows)) or real(rows, *a, **k)
        for bound in (64_000, 256 << 20):
            toxicity.train(docs, docs.select("doc_id", "y"), driver_bytes=bound)
    finally:
        toxicity.ftrl = real
    assert seen[0] < 2 * 64_000 < seen[1]


def test_language_on_held_out_rows(spark):
    got = {r["doc_id"]: r for r in catalog.QUERIES["op7_bigru_language"](spark, SMALL).collect()}
    held = [r for r in rows_of(spark) if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(got[r["doc_id"]]["held_out"] for r in held)
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.9


@pytest.mark.parametrize("n", [0, 1, 60, 61, 119, 179, 1000])
def test_training_words_spread_over_the_whole_text(n):
    got = bigru.spread(list(range(n)), 60)
    assert len(got) == min(n, 60) and got == sorted(set(got))
    assert n <= 60 or (got[0] == 0 and got[-1] >= n - 1 - n / 60 and max(b - a for a, b in zip(got, got[1:], strict=False)) <= n // 60 + 1)


def test_backpropagation_equals_differences():
    net = bigru.Network(["a", "b", "c"], hidden=3).start()
    x, mask = bigru._padded([b"abc", b"zq", b"hello", b"a"])
    y = np.array([0, 1, 2, 1])
    _, g = net.gradients(x, mask, y)
    draw = np.random.default_rng(0)
    for name, w in net.weights.items():
        for _ in range(6):
            at = tuple(draw.integers(0, s) for s in w.shape)
            old, ends = w[at], []
            for step in (1e-2, -1e-2):
                w[at] = old + step
                ends.append(net.gradients(x, mask, y)[0])
            w[at] = old
            assert (ends[0] - ends[1]) / 2e-2 == pytest.approx(g[name][at], abs=3e-4)


def test_words_read_once_count_as_often_as_they_stand():
    net = bigru.Network(["a", "b"], hidden=4).start()
    text = "some words some some words and averyveryverylongwordthatissplitintopieces"
    body = np.frombuffer(text.encode(), np.uint8)
    got = bigru.Reader(net).read(body, np.array([0, len(body)]))[0]
    sums = sum(net.positions(np.frombuffer(w[i : i + bigru.PIECE].encode(), np.uint8)[None, :].astype(np.int64)).sum((0, 1)) for w in text.split() for i in range(0, len(w), bigru.PIECE))
    assert got == pytest.approx(sums / len(text.replace(" ", "")), abs=1e-5)


def test_secret_findings(spark):
    key = "AKIA" + "Q7" * 8
    rows = [(i, prose(20, i) + [f" {key[:-2]}{i % 90 + 10} ", f' token = "{hashlib.sha1(str(i).encode()).hexdigest()}" ', f" user{i}.x@mail.example.com ", f" {4_000_000_000_000_000 + i} ", " "][i % 5] + prose(20, i), "src") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = secrets.scan(docs, secrets.train(docs)).collect()
    assert {r["doc_id"] for r in got if r["kept"]} == {i for i in range(300) if i % 5 in (0, 1)}
    texts = {i: t for i, t, _ in rows}
    assert all(texts[r["doc_id"]][r["start"] : r["end"]] == r["token"] for r in got)


def found(text: str) -> dict[str, bool]:
    """Token -> assigned, of the candidates in a text."""
    body = text.encode()
    return {body[s:e].decode(): assigned for _, s, e, _, _, assigned in secrets.findings(np.frombuffer(body, np.uint8), np.array([0, len(body)]))}


def test_long_tokens_are_findings(spark):
    draw = random.Random(8)
    some = lambda n: "".join(draw.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=n))
    jwt, key = f"eyJ{some(33)}.{some(519)}.{some(43)}", some(2048)
    assert len(jwt) == 600 and found(f"see {jwt} and key={key}.") == {jwt: False, key + ".": True}
    docs = spark.createDataFrame([(1, f"see {jwt} here", "a"), (2, f'key = "{key}"', "a")], "doc_id long, text string, source string")
    got = secrets.scan(docs, secrets.train(docs)).collect()
    assert sorted((r["doc_id"], r["token"], r["end"] - r["start"]) for r in got) == [(1, jwt, 600), (2, key, 2048)]
    assert secrets.seed_label(jwt, "see ", False) == 1 and secrets.seed_label("a@b.c.d@" + ".x" * 50_000, "", False) is None
    assert secrets.seed_label("x" * 200_000 + "1", "", False) == 0 and secrets.seed_label("anexample_", "", False) == secrets.seed_label("a@b.c", "", False) == 0


def test_values_assigned_to_compound_names_are_findings():
    lines = {"DB_PASSWORD=hunter": "hunter", 'client_secret: "s3cr3t!x"': "s3cr3t!x", "aws_secret_access_key=abcdef": "abcdef", "dbPassword = 'qwerty'": "qwerty", "my-api-key: zyxwvu": "zyxwvu", "app.token.value=abcabc": "abcabc", "DBPasswords: lmnopq": "lmnopq", "dbpassword=rstuvw": "rstuvw", "password=ghijkl": "ghijkl"}
    for line, value in lines.items():
        assert found(f"some words\n{line}\nmore") == {value: True}
        token, before = value, "some words\n" + line[: line.index(value)]
        assert secrets.features(token, before, "", True, None, secrets.Background.of(Counter()))[14:16] == [1.0 if "token.value" not in line else 0.0, 1.0]
    assert found("monkey: banana and turkey = dinner, title: something") == {} and found("password hunter2") == {}
    digest = hashlib.sha1(b"x").hexdigest()
    assert [secrets.seed_label(digest, f"{name} = ", True) for name in ("token", "DB_PASSWORD", "key", "cache_key", "token_sha1")] == [1, 1, 1, None, None]


def test_background_counts_every_document(spark):
    rows = [(i, "the hot text of copies") for i in range(4000)] + [(4000 + i, f"zyxwv{chr(97 + i % 5)} Zyxwva") for i in range(40)]
    base = secrets.background(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert base.dictionary == {"the", "hot", "text", "copies"} | {f"zyxwv{c}" for c in "abcde"}
    words = Counter(w for _, t in rows for w in t.lower().split())
    table = np.full((64, 64), 0.5)
    for w, n in words.items():
        for a, b in zip(w, w[1:], strict=False):
            table[ord(a) - 97, ord(b) - 97] += n
    assert base.transitions == pytest.approx(np.log(table / table.sum(1, keepdims=True)))
    assert secrets.background(spark.createDataFrame(rows, "doc_id long, text string"), frequent=1).dictionary == {"copies"}


def test_rare_and_only_labels_train_the_forest(spark):
    key = "AKIA" + "Q7" * 8
    hot = [(i, prose(5, 1) + " 4000000000000001 " + prose(5, 2), "src") for i in range(200)]
    rows = hot + [(1000 + i, prose(8, i) + f" {4_000_000_000_000_000 + i} or qwe{i}rtyuiop12 " + prose(8, i + 1), "src") for i in range(200)]
    secret = [(5000 + i, prose(20, i) + f" {key[:-1]}{i} " + prose(20, i + 9), "src") for i in range(3)]
    docs, alone = (spark.createDataFrame(r, "doc_id long, text string, source string") for r in (rows + secret, secret))
    kept = lambda d, scanner: {r["doc_id"] for r in secrets.scan(d, scanner).where("kept").collect()}
    scanner = secrets.train(docs, most=20)
    assert scanner.forest is not None and {5000, 5001, 5002} <= kept(docs, scanner) <= {5000, 5001, 5002} | set(range(1000, 1200))
    assert kept(alone, secrets.train(alone)) == {5000, 5001, 5002}
    given = spark.createDataFrame([(key, "", "", False, None, 1)], "token string, before string, after string, assigned boolean, path string, label int")
    assert kept(alone, secrets.train(alone, labelled=given)) == {5000, 5001, 5002}


def test_forest_votes_equal_walks_down_its_trees():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(300, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    forest = trees.Forest().fit(x[:200], y[:200], count=9)

    def walk(t, row):
        at = 0
        while t.feature[at] >= 0:
            at = t.left[at] if row[t.feature[at]] <= t.threshold[at] else t.right[at]
        return t.value[at]

    assert forest.probability(x[200:]) == pytest.approx([sum(walk(t, row) for t in forest.trees) / 9 for row in x[200:]])
    one = forest.trees[0]  # a leaf is the mean label of the rows drawn into it, each as often as drawn
    weight = np.bincount(np.random.default_rng(5).integers(0, 200, 200), minlength=200)
    leaf = np.array([walk(one, row) for row in x[:200]])
    for v in np.unique(leaf):
        at = leaf == v
        assert v == pytest.approx((weight[at] * y[:200][at]).sum() / weight[at].sum(), abs=1e-9) or len(np.unique(leaf)) < len(one.value[one.feature < 0])


def labelled_lines(n: int, seed: int) -> list[tuple[int, str, str, int]]:
    """(id, text, path, label): labels come from how a line was made, not from any rule of the operator."""
    draw = random.Random(seed)
    some = lambda k, a="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": "".join(draw.choices(a, k=k))
    hexed = lambda k: some(k, "0123456789abcdef")
    word = lambda: draw.choice(WORDS)
    secret = [lambda: f"{word()}_secret = '{some(draw.randrange(18, 40))}'", lambda: f"api_key: {some(32)}", lambda: f"using {some(40)} to log in", lambda: f"token={hexed(40)}", lambda: f"AUTH {some(24)}-{some(12)}"]
    plain = [
        lambda: f"commit {hexed(40)}", lambda: f"sha256 {hexed(64)}", lambda: f"name{draw.randrange(10**6)}@{word()}.example.org", lambda: f"see {word()}{word().title()}{word().title()}{draw.randrange(10)}",
        lambda: f"token: {word()}_{word()}_{draw.randrange(100)}", lambda: f"password = {word()}{word()}", lambda: f"https://{word()}.org/{word()}/{word()}{draw.randrange(1000)}", lambda: f"id {draw.randrange(10**15)}",
    ]
    out = []
    for i in range(n):
        label = int(draw.random() < 0.4)
        line = draw.choice(secret if label else plain)()
        out.append((i, f"{prose(6, seed + i)} {line} {prose(6, seed + i + 1)}", draw.choice(["src/app.py", "conf/prod.env", "docs/test.md", None]), label))
    return out


def test_forest_on_held_out_findings_with_labels_that_are_no_rules(spark):
    rows = labelled_lines(1600, 21)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, label int")
    kinds = docs.select("doc_id", "label")
    seen = secrets._scan(docs.where("doc_id < 1000"), "source").join(kinds, "doc_id").select("token", "before", "after", "assigned", "path", "label")
    scanner = secrets.train(docs.where("doc_id < 1000"), labelled=seen)
    got = secrets.scan(docs.where("doc_id >= 1000"), scanner).join(kinds, "doc_id").collect()
    right, kept, true = sum(r["kept"] and r["label"] for r in got), sum(r["kept"] for r in got), sum(r[3] for r in rows[1000:])
    print(f"held-out findings: precision {right / kept:.3f}, recall {right / true:.3f}, of {len(got)} findings")
    assert right / kept > 0.9 and right / true > 0.9
    base = secrets.Background.of(Counter(), ["extraordinarily", "the"])
    assert base.coverage("extraordinarilythe") == 1.0 and base.coverage("") == 0.0


def test_forest_and_boosting_learn():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(600, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    assert np.mean((trees.Forest().fit(x[:400], y[:400]).probability(x[400:]) > 0.5) == y[400:]) > 0.85
    assert np.mean((trees.Boosted().fit(x[:400], y[:400], held=np.arange(400) % 3 == 0).probability(x[400:]) > 0.5) == y[400:]) > 0.85


# Decontamination, rules, mixing, shards ----------------------------------------------------


def ascii_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))


def test_decontamination(spark):
    got = {r["doc_id"]: r for r in catalog.QUERIES["op5_benchmark_windows"](spark, SMALL).collect()}
    grams: dict[tuple, set] = {}
    for r in rows_of(spark, "benchmark"):
        w = ascii_words(r["text"])
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(r["item_id"])
    lengths = {len(g) for g in grams}
    for r in rows_of(spark):
        w, hit, items = ascii_words(r["text"]), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    items |= grams[tuple(w[k : k + n])]
        g = got[r["doc_id"]]
        ids = ",".join(sorted(map(str, items)))
        assert (g["n_words"], g["n_hit"], g["n_items"], g["items_sha256"]) == (len(w), len(hit), len(items), hashlib.sha256(ids.encode()).hexdigest())


def test_decontamination_with_items_of_one_to_twelve_words(spark):
    draw = random.Random(12)
    texts = {i: prose(60, 700 + i) for i in range(80)}
    bench = {}
    for n in range(1, 13):
        for k in range(2):
            at, words = draw.randrange(40), texts[draw.randrange(20)].split()
            bench[10 * n + k] = " ".join(words[at : at + n]) if n > 1 else f"only{k}"
    texts |= {200: "Only0", 201: "said only1, said", 202: "", 203: None, 204: " ".join(bench[n] for n in bench)}
    want = {}
    for i, t in texts.items():
        w, hit, items = ascii_words(t), set(), set()
        for item, b in bench.items():
            g = ascii_words(b)
            n = min(10, len(g))
            for x in range(len(g) - n + 1):
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == g[x : x + n]:
                        hit |= set(range(k, k + n))
                        items.add(str(item))
        want[i] = (sorted(hit), sorted(items))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame(list(bench.items()), "item_id long, text string")
    for few in (0, 64 << 20):
        got = {r["doc_id"]: r for r in decontamination.decontaminate(docs, items, broadcast_bytes=few).collect()}
        assert {i: ([x for s in r["_hit_spans"] for x in range(s["start"], s["end"])], r["_items"]) for i, r in got.items()} == want
        assert all(r["_n_hit"] == len(want[i][0]) and r["_contaminated"] == bool(want[i][0]) for i, r in got.items())
        assert all(a["end"] < b["start"] for r in got.values() for a, b in zip(r["_hit_spans"], r["_hit_spans"][1:], strict=False))
    cut = {r["doc_id"]: r["text"] for r in decontamination.remove_spans(docs, items).collect()}
    assert all(cut[i] == (" ".join(w for k, w in enumerate(ascii_words(t)) if k not in want[i][0]) if want[i][0] else t) for i, t in texts.items())


def test_lower_case_beyond_ascii_is_kept_apart(spark):
    docs = spark.createDataFrame([(1, "É A b"), (2, "é a B"), (3, "xΑΣ' y"), (4, "\u212a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "é a b"), (8, "xας y"), (7, "k b")], "item_id long, text string")
    got = {r["doc_id"]: r["_items"] for r in decontamination.decontaminate(docs, bench).collect()}
    assert got == {1: [], 2: ["9"], 3: [], 4: []}


def test_quality_measures(spark):
    got = {r["doc_id"]: r for r in catalog.QUERIES["op6_host_rules"](spark, SMALL).collect()}
    for r in rows_of(spark):
        t = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        g3 = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        c = Counter(g3)
        cover = {k + j for k, x in enumerate(g3) if c[x] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        g = got[r["doc_id"]]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert g["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w))


def test_priors_of_hosts():
    from quantloom.llm.host_rules import prior_of

    draw = np.random.default_rng(8)
    for strength, mean in ((4.0, 0.3), (30.0, 0.1)):
        n = draw.integers(1, 200, 4000)
        x = draw.binomial(n, draw.beta(strength * mean, strength * (1 - mean), len(n)))
        got = prior_of(len(n), float(n.sum()), float((n.astype(float) ** 2).sum()), int(x.sum()), float((x.astype(float) ** 2 / n).sum()))
        assert got[0] == pytest.approx(mean, abs=0.02) and got[1] == pytest.approx(strength, rel=0.15)
    x = draw.binomial(n, 0.2)  # no spread beyond chance
    assert prior_of(len(n), float(n.sum()), float((n.astype(float) ** 2).sum()), int(x.sum()), float((x.astype(float) ** 2 / n).sum()))[1] > 300
    assert prior_of(0, 0.0, 0.0, 0, 0.0) == (0.0, 1.0) and prior_of(1, 10.0, 100.0, 3, 0.9)[1] == 1.0 and prior_of(5, 5.0, 5.0, 2, 2.0)[1] == 1.0


def test_mixing_keeps_budgets(spark):
    rows = [(i, prose(20 + i % 30, i), "big" if i % 3 else f"s{i % 7}") for i in range(900)] + [(5000 + i, prose(25, i), None) for i in range(15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    counted = mixing.count_tokens(docs).cache()
    mix = mixing.plan_mix(counted, max_repeats=2.0)
    plan = {r["__source"]: r for r in mix.sources.collect()}
    tokens = {i: len(space_words(t)) + 1 for i, t, _ in rows}
    total = sum(tokens.values())
    share = {s: sum(tokens[i] for i, _, x in rows if x == s) / total for s in plan}
    z = sum(p**mix.exponent for p in share.values())
    got = mixing.schedule(docs, block_tokens=3000).collect()
    for s, r in plan.items():
        assert r["__weight"] == pytest.approx(share[s] ** mix.exponent / z)
        read = sum(g["n_tokens"] for g in got if g["source"] == s)
        assert r["__budget"] <= read < r["__budget"] + 60  # the last document ends past the budget
        assert r["__tokens"] <= r["__budget"] <= 2 * r["__tokens"]
    assert {(g["doc_id"]) for g in got} == set(tokens)
    blocks: dict = {}
    for g in got:
        blocks.setdefault(g["block"], Counter())[g["source"]] += g["n_tokens"]
    for b in blocks.values():
        assert b["big"] / sum(b.values()) == pytest.approx(plan["big"]["__weight"], abs=0.06)
    assert Counter(g["doc_id"] for g in got) == Counter(r["doc_id"] for r in mixing.remix(docs).select("doc_id").collect())


def test_bisection_on_the_driver_equals_bisection_in_spark(spark):
    counted = spark.createDataFrame([(i, f"s{i}", 10 * 2**i, 1) for i in range(8)], "__id long, __source string, __tokens long, __times long")
    a, b = (mixing.plan_mix(counted, max_repeats=50.0, driver_sources=n, steps=12) for n in (100, 0))
    assert a.exponent == b.exponent and a.entropy == pytest.approx(b.entropy)
    flat = mixing.plan_mix(counted, target_entropy=10.0, max_repeats=1e9)
    assert flat.exponent == 0 and mixing.plan_mix(counted, max_repeats=1.0).exponent == pytest.approx(1)


def test_schedule_does_not_depend_on_how_rows_are_dealt(spark):
    rows = [((None, 1, 2, 3, 4)[i % 5], prose(5 + i % 40, i // 2), "ab"[i % 9 == 0]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    order = ["block", "place", "doc_id", "n_tokens", "pass"]
    one, two = (mixing.schedule(docs.repartition(n), block_tokens=2000).orderBy(*order).collect() for n in (3, 7))
    assert one == two and len(one) >= 400
    assert Counter((r["doc_id"], r["n_tokens"]) for r in one if r["pass"] == 0) == Counter((i, len(space_words(t)) + 1) for i, t, _ in rows)
    none = [(None, prose(30, i), "ab"[i % 9 == 0]) for i in range(500)]  # ids say nothing: a last pass still takes a part
    mixed = mixing.remix(spark.createDataFrame(none, "doc_id long, text string, source string"), max_repeats=1.5).groupBy("source").count().collect()
    assert 55 < {r[0]: r[1] for r in mixed}["b"] < 112


@pytest.mark.parametrize(("most_rows", "part"), [(40, 1e-3), (1_000_000, 1e-3), (1_000_000, 0.1)])
def test_shards_with_a_hot_group(spark, most_rows, part):
    hot = [(i, prose(50, 1)) for i in range(700)] + [(10_000 + i, (None, "")[i % 2]) for i in range(900)]
    rows = hot + [(1000 + i, prose(20 + i % 80, 5000 + i // 3)) for i in range(1400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(docs, shards=8, ranges=32, most_rows=most_rows, group_part=part).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in rows)
    size, groups = Counter(), Counter()
    texts, spread = dict(rows), {}
    for r in got:
        size[r["shard"]] += r["size"]
        groups[texts[r["doc_id"]] or ""] += r["size"]
    mean = sum(size.values()) / 8
    assert max(abs(v - mean) for v in size.values()) < (0.2 if part == 0.1 else 0.02) * mean
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    for r in got:
        spread.setdefault(texts[r["doc_id"]] or "", set()).add(r["shard"])
    assert {t for t, v in spread.items() if len(v) > 1} == {t for t, n in groups.items() if n > mean} == {prose(50, 1)}
    assert all(r["size"] == len((texts[r["doc_id"]] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in got)


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_shards_of_the_tables_keep_groups_whole(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    got = sharding.shard(docs).join(docs.select("doc_id", F.xxhash64("text").alias("h")), "doc_id").cache()
    groups = got.groupBy("h").agg(F.countDistinct("shard").alias("n"), F.sum("size").alias("bytes")).agg(F.max("n"), F.max("bytes")).first()
    size = [r[1] for r in got.groupBy("shard").agg(F.sum("size")).collect()]
    assert groups[0] == 1 and len(size) == 8 and max(size) - min(size) <= max(groups[1], 1)
    assert got.groupBy("shard").agg((F.max("slot") + 1 - F.count("*")).alias("gap"), F.min("slot").alias("a"), (F.countDistinct("slot") - F.count("*")).alias("d")).where("gap <> 0 or a <> 0 or d <> 0").count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_dealing_fills_shards_to_one_level(seed):
    draw = random.Random(seed)
    shards = draw.randint(1, 9)
    groups = [(str(i), draw.randint(1, 200)) for i in range(draw.randint(0, 30))]
    rest = draw.randint(0, 3000)
    at, bounds = sharding._deal(groups, rest, shards)
    filled = [sum(n for g, n in groups if at[g] == k) for k in range(shards)]
    cuts = [0, *bounds, rest]
    sizes = [f + b - a for f, a, b in zip(filled, cuts, cuts[1:], strict=False)]
    assert cuts == sorted(cuts) and sum(sizes) == rest + sum(n for _, n in groups)
    assert max(sizes) <= max(max(filled), sum(sizes) / shards + 2 + max((f for f in filled if f > sum(sizes) / shards), default=0) * 0)
    grown = [s for s, f, a, b in zip(sizes, filled, cuts, cuts[1:], strict=False) if b > a]
    assert not grown or max(grown) - min(grown) <= 2


def test_ranges_hold_few_rows_and_split_no_text_that_fits(spark):
    draw = random.Random(6)
    heads = [f"{draw.getrandbits(64):016X}" for _ in range(200)]
    keys = [(h, h + f"{draw.getrandbits(64):016X}") for h in heads for _ in range(draw.choice([1, 2, 30]))] + [(heads[0], heads[0] + f"{draw.getrandbits(64):016X}") for _ in range(900)]
    cuts = sharding._cuts([k for _, k in draw.sample(keys, 600)], 40)
    assert {k[:16] for k in cuts if len(k) > 16} == {heads[0]} and heads[0] in cuts
    got = sharding._ranged(spark.createDataFrame(keys, "head string, key string"), cuts).collect()
    assert all(r["range"] == sum(c <= r["key"] for c in cuts) for r in got)
    assert max(Counter(r["range"] for r in got).values()) < 4 * len(keys) / 40
    assert sharding._ranged(spark.createDataFrame(keys[:5], "head string, key string"), []).where("range <> 0").count() == 0


# Pipeline ----------------------------------------------------------------------------------


def test_pipeline_against_plain_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.train(docs, toxicity.learnable(spark.read.parquet(f"{SMALL}/labels.parquet")))
    toxic = {r["doc_id"] for r in toxicity.score(docs, model).where("score >= 0.3").collect()}
    left = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in toxic}
    left = {i: left[i] for i, c in components_of(left, 5).items() if i == c}
    grams = set()
    for r in rows_of(spark, "benchmark"):
        w = ascii_words(r["text"])
        n = min(10, len(w))
        grams |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1 if n else 0)}
    lengths = {len(g) for g in grams}
    clean = lambda w: not any(tuple(w[k : k + n]) in grams for n in lengths for k in range(len(w) - n + 1))
    left = {i: t for i, t in left.items() if clean(ascii_words(t))}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in got} == set(left)
    times = Counter(r["doc_id"] for r in got)
    assert max(times.values()) <= 2
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_tables_in_the_shared_folder_can_be_deleted(spark):
    docs = edge_docs(spark, clashes=False).select(F.col("doc_id"))
    at = lambda df: Path(df._settled.removeprefix("file:"))
    df = shared.settle(docs, "probe")
    assert df.count() == len(edge_rows()) and at(df).exists() and shared.shared_folder(spark).startswith("file:")
    with shared.scratch() as made:
        one, two = shared.settle(docs, "one"), shared.settle(docs, "two")
        made.remove(two)
    assert not at(one).exists() and at(two).exists() and at(df).exists() and two.count() == len(edge_rows())
    shared.free(df, df)
    assert not at(df).exists() and at(two).exists()
    shared.release(spark)
    assert not at(two).exists() and not at(two).parent.exists()
    assert shared.settle(docs, "again").count() == len(edge_rows())


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://somewhere:7077", raising=False)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(spark)


def test_without_a_shared_folder_a_temporary_one_is_kept(spark, monkeypatch):
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    first = shared.shared_folder(spark)
    assert first == shared.shared_folder(spark) and "quantloom-" in first
