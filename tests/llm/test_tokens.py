"""Packing and alignment against plain loops over whole tokenised texts."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantloom.llm import alignment, packing, units
from quantloom.llm.bytewords import slices
from tests.llm.texts import edge_docs, edge_rows, prose

P = pytest.importorskip("public_tokenizers")
WORDS, BYTES, PIECES = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
#: Letters with case or normal forms of their own, white space of all kinds, signs, special strings.
ODD = ["a", "B", "É", "é", "H", "ẖ", "H̱", "T̈", "İ", "ı", "ß", "ſ", "ŉ", "ǅ", "Σ", "ς", "東京", "😀", "ﬁ", "Å", "́", "̸"]
ODD += [" ", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "​", "\x00", "\x7f"]
ODD += [".", ",", "'", "'s", "'S", "'re", "!", "<", "=", ">", "|", "_", "-", "×", "÷", "—", "“", "”", "▁", "1", "23", "²", "ª"]
ODD += ["<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "<0x41>"]


def odd_texts(n: int, most: int) -> list[str]:
    draw = random.Random(n)
    return ["".join(draw.choice(ODD) for _ in range(draw.randint(0, most))) for _ in range(n)]


def tokenizer(path: str, plain: bool):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = plain
    return t


def test_ids_by_units_are_those_of_whole_texts():
    texts = odd_texts(8000, 30) + [r[1] or "" for r in edge_rows()]
    words, got = packing.WordTokenizer(WORDS), []
    for _, _, body, offsets in slices(pa.array(texts), 20_000):
        ids, n = words.encode(body, offsets)
        ends = np.cumsum(n)
        got += [ids[e - k : e].tolist() for e, k in zip(ends, n, strict=True)]
    assert got == [e.ids for e in tokenizer(WORDS, False).encode_batch(texts, add_special_tokens=False)]


def test_a_worker_that_forgets_finds_the_same(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    words, whole = packing.WordTokenizer(WORDS), tokenizer(WORDS, False)
    for text in odd_texts(200, 40):
        body = np.frombuffer(text.encode(), np.uint8)
        ids, _ = words.encode(body, np.array([0, len(body)]))
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids


def served(tokens, quanta, cell) -> list[tuple[int, int]]:
    """(queue, token) in the order of deficit round-robin, a round at a time."""
    counters, at, order = [0] * len(tokens), [0] * len(tokens), []
    while sum(at) < sum(tokens):
        for q, (total, quantum) in enumerate(zip(tokens, quanta, strict=True)):
            counters[q] += quantum
            while counters[q] >= cell * packing.ONE and at[q] < total:
                counters[q] -= cell * packing.ONE
                n = min(cell, total - at[q])
                order += [(q, at[q] + j) for j in range(n)]
                at[q] += n
    return order


@pytest.mark.parametrize(("tokens", "weights"), [((1000, 5_000, 0, 7, 90_123), None), ((3_000, 3_000, 3_000), (1, 2, 5)), ((0,), None), ((1,), None)])
def test_places_equal_a_round_robin_loop(tokens, weights):
    share = weights or [t / max(sum(tokens), 1) for t in tokens]
    quanta = [max(1, int(w / max(sum(share), 1e-9) * 256 * packing.ONE)) for w in share]
    rounds = packing.Rounds(np.array(tokens), np.array(quanta), 256, 16)
    place = {x: i for i, x in enumerate(served(tokens, quanta, 16))}
    draw, docs = random.Random(3), []
    for q, total in enumerate(tokens):
        at = 0
        while at < total:
            n = min(draw.choice([1, 5, 16, 300, 2000]), total - at)
            docs.append((q, at, n))
            at += n
    draw.shuffle(docs)
    if not docs:
        return
    queue, start, n = (np.array(x) for x in zip(*docs, strict=True))
    doc, low, length, at = rounds.place(queue, start, n)
    assert all(place[queue[d], start[d] + a + j] == p + j for d, a, m, p in zip(doc, low, length, at, strict=True) for j in range(m))
    piece, inner, size, sequence, offset = rounds.cut(at, length)
    assert sum(size) == sum(tokens) and all(o + s <= 256 for o, s in zip(offset, size, strict=True))
    filled = Counter()
    for s, m in zip(sequence.tolist(), size.tolist(), strict=True):
        filled[s] += m
    full, rest = divmod(sum(tokens), 256)
    assert [filled[k] for k in range(len(filled))] == [256] * full + [1 << b for b in range(8, -1, -1) if rest >> b & 1]


def test_packing(spark):
    docs = edge_docs(spark).repartition(3)
    got = packing.pack(docs, WORDS, length=256, with_ids=True).cache()
    whole = Counter()
    for r in edge_rows():
        ids = (*tokenizer(WORDS, False).encode(r[1] or "", add_special_tokens=False).ids, 1)
        whole[r[0], len(ids), ids] += 1
    rows = [r.asDict() for r in got.collect()]
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in rows)
    for (doc_id, n, ids), times in whole.items():
        mine = [r for r in rows if r["doc_id"] == doc_id and r["doc_tokens"] == n]
        if len([k for k in whole if k[:2] == (doc_id, n)]) == 1:
            covered = Counter(r["start"] + j for r in mine for j in range(r["length"]))
            assert covered == Counter({j: times for j in range(n)})
            assert all(tuple(r["ids"]) == ids[r["start"] : r["start"] + r["length"]] for r in mine)
    in_order: dict = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == in_order.get(r["sequence_id"], 0)
        in_order[r["sequence_id"]] = r["offset"] + r["length"]
    lengths = [in_order[k] for k in sorted(in_order)]
    assert sorted(in_order) == list(range(len(in_order)))
    assert all(n == 256 or n & (n - 1) == 0 for n in lengths) and sum(n < 256 for n in lengths) <= 8
    assert packing.sequences(got).where(F.size("ids") > 256).count() == 0
    assert packing.sequences(got).agg(F.sum(F.size("ids"))).first()[0] == sum(lengths)
    assert packing.pack(docs.limit(0), WORDS).count() == 0


def test_windows_hold_the_sources_by_their_shares(spark):
    rows = [(i, prose(20 + i % 60, i), "abc"[0 if i % 10 < 6 else 1 + i % 2]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = packing.pack(docs, WORDS, length=1024, cell=32).join(docs.select("doc_id", "source"), "doc_id")
    table = {(r[0], r[1]): r[2] for r in got.groupBy("sequence_id", "source").agg(F.sum("length")).collect()}
    totals = Counter()
    for (_, s), n in table.items():
        totals[s] += n
    last = max(k for k, _ in table)
    for k in range(last - 11):  # all but the tail
        for s, n in totals.items():
            assert abs(table.get((k, s), 0) - 1024 * n / totals.total()) <= 2 * 32 + 3
    few = packing.pack(docs, WORDS, length=1024, queues=2, targets={"a": 0.5, "b": 0.25, "c": 0.25})
    assert few.agg(F.sum("length")).first()[0] == totals.total()


def test_offsets_by_join_or_broadcast_are_the_same(spark, monkeypatch):
    docs = edge_docs(spark).repartition(3, "doc_id", "text")
    order = ["doc_id", "start", "sequence_id", "offset"]
    one = packing.pack(docs, WORDS).orderBy(order).collect()
    monkeypatch.setattr(packing, "BROADCAST_ROWS", -1)
    assert packing.pack(docs, WORDS).orderBy(order).collect() == one


def test_small_numbers_are_packed_whole():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2097151, 2097152, (1 << 28) - 1])
    assert units.unpack_small(units.pack_small(values)).tolist() == values.tolist()
    assert units.unpack_small(units.pack_small(values[:0])).tolist() == []


# Alignment ---------------------------------------------------------------------------------


def plain_alignment(texts: list[str | None]) -> list[tuple]:
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each text, from whole texts and byte ranges."""
    import sentencepiece

    a, b = tokenizer(BYTES, True), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    byte = {c: i for i, c in enumerate(units.byte_letters())}
    counts, best, each = Counter(), Counter(), []
    for text in texts:
        each.append(None)
        if not text:
            continue
        whole = a.encode(" " + text, add_special_tokens=False)
        side_a = [(i, bytes(byte[c] for c in t)) for i, t in zip(whole.ids, whole.tokens, strict=True)]
        side_b = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        if any(b"".join(x for _, x in side) != (" " + text).encode() for side in (side_a, side_b)):
            continue
        owners = [[k for k, (_, x) in enumerate(side) for _ in x] for side in (side_a, side_b)]
        links = [(side_a[i][0], side_b[j][0]) for i, j in sorted(set(zip(*owners, strict=True)))]
        groups, at, done = [], [0, 0], [0, 0]
        for k in range(len(owners[0])):
            last = k + 1 == len(owners[0])
            if last or (owners[0][k] != owners[0][k + 1] and owners[1][k] != owners[1][k + 1]):
                at = [owners[0][k] + 1, owners[1][k] + 1]
                groups.append("|".join(",".join(str(i) for i, _ in side[x:y]) for side, x, y in zip((side_a, side_b), done, at, strict=True)))
                done = at
        counts.update(links)
        each[-1] = (len(side_a), len(side_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [(0, 0, 0, 0, 0, 0, "") if x is None else (*x[:3], len(x[3]), sum(counts[p] == best[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), x[4]) for x in each]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("block", [300, alignment.BLOCK_BYTES])
def test_alignment_of_odd_texts(spark, monkeypatch, block):
    texts = [*odd_texts(600, 12), None, "", " ", "  ", "a ", " a", "a  ", prose(3000, 4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    size = block

    def aligned(batches, a, b, schema):
        alignment.BLOCK_BYTES = alignment.STEP_BYTES = size  # in the worker
        yield from plain(batches, a, b, schema)

    plain = alignment._aligned
    monkeypatch.setattr(alignment, "_aligned", aligned)
    got = alignment.align(docs, BYTES, PIECES).orderBy("doc_id").select(*COLUMNS).collect()
    assert [tuple(r) for r in got] == plain_alignment(texts)


def test_alignment_of_edge_rows(spark):
    docs = edge_docs(spark)
    got = sorted((tuple(r) for r in alignment.align(docs, BYTES, PIECES).select("doc_id", *COLUMNS).collect()), key=str)
    rows = edge_rows()
    assert got == sorted(((r[0], *x) for r, x in zip(rows, plain_alignment([r[1] for r in rows]), strict=True)), key=str)
    assert alignment.align(docs.limit(0), BYTES, PIECES).count() == 0


def test_an_aligner_that_forgets_finds_the_same(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED_BYTES", 40)
    held, fresh = alignment.Aligner(BYTES, PIECES), alignment.Aligner(BYTES, PIECES)
    for k in range(30):
        body = np.frombuffer((" " + prose(20, k)).encode(), np.uint8)
        starts = alignment.unit_starts(body, np.array([0, len(body)]))
        ends = np.append(starts[1:], len(body))
        for x in (held, fresh):
            x.make_room()
            entries = x.entries(body, starts, ends)
            said = "".join(x.text[i] for i in entries)
            assert x is held or said == known
            known = said
