"""Mixture-controlled packing: deficit round-robin over source queues fills token windows.

Each source is a queue of tokens.  In every round a queue's deficit counter grows by its quantum, its
target part of a window, and the queue hands on as many cells (runs of ``cell`` tokens) as the
counter holds; what is left of the counter is carried to the next round.  The rounds' tokens, one after the
other, are cut into windows, so every window holds the sources by their proportions, within a
cell each, until a queue is empty.

After r rounds a queue has handed on floor(r * quantum / cell) cells whatever the windows were, so the
counters at any round are known without the rounds before it: a task places its documents
on its own, and deficits carry over windows and partitions.  Document order in a queue is that
of the input (task, then row), so token ids are written once and never shuffled; only counts a
(task, source) are.

No window is padded: the last one is cut at powers of two.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.bytewords import FOLD, slices
from quantloom.llm.shared import settle, table
from quantloom.llm.units import Memo, Ragged, byte_letters, hashes, spread

#: Text bytes that one step tokenises, tokens that one step places.
STEP_BYTES, STEP_TOKENS = 4 << 20, 1 << 20
#: A quantum's unit is 1 / ONE token; up to 2**63 / ONE tokens a source.
ONE = 1 << 16
#: Entries that a worker remembers, and rows of (task, source) up to which offsets are broadcast.
REMEMBERED, BROADCAST_ROWS = 2_000_000, 200_000

_SPACE, _LETTER, _SIGN, _GLUE = range(4)
_CLASS = np.full(256, _GLUE, np.uint8)
_CLASS[[9, 10, 13, 32]] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum() and b != 39]] = _SIGN
#: Multiplication and division signs, and the capital I with a dot, whose lower case ends in a mark.
_NO_LETTER = [0xC397, 0xC3B7, 0xC4B0]


class WordTokenizer:
    """Ids of texts by a lower-casing word BPE file, unit by unit.

    Such a tokenizer drops white space and never joins an ASCII or Latin letter with an ASCII sign
    other than the apostrophe, so texts are cut there.  Units of plain letters go to the
    vocabulary's merges at once; others go through the whole tokenizer.  Texts that hold the
    string of a special token go through it whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.letters = {i: c for i, c in enumerate(byte_letters())}
        self.clear()

    def clear(self) -> None:
        self.memo, self.ids = Memo(), Ragged(np.uint32)

    def _spans(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes after folding, and where units start and end."""
        kind = _CLASS[body]
        lead = np.flatnonzero((body >= 0xC3) & (body <= 0xC5))
        pair = body[lead].astype(np.int32) << 8 | body[lead + 1]
        lead = lead[~np.isin(pair, _NO_LETTER)]
        kind[lead], kind[lead + 1] = _LETTER, _LETTER
        cut = np.zeros(len(body) + 1, bool)
        cut[offsets] = True
        a, b = kind[:-1], kind[1:]
        cut[1:-1] |= ((a == _SPACE) != (b == _SPACE)) | ((a == _LETTER) & (b == _SIGN)) | ((a == _SIGN) & (b == _LETTER))
        at = np.flatnonzero(cut)
        starts, ends = at[:-1], at[1:]
        word = kind[starts] != _SPACE
        starts, ends = starts[word], ends[word]
        folded = FOLD[body]
        odd = np.concatenate([[0], np.cumsum((body >= 128) & (kind != _LETTER))])
        odd = odd[ends] > odd[starts]  # other letters may compose with A-Z
        if odd.any():
            back = spread(starts[odd], (ends - starts)[odd])
            folded[back] = body[back]
        return folded, starts, ends

    def _new(self, texts: list[str]) -> list[list[int]]:
        out: list = [None] * len(texts)
        rest = []
        merge = self.whole.model.tokenize
        for i, t in enumerate(texts):
            if t.isalpha() and max(t) < "ɐ" and (w := t.lower()).isalpha():  # letters that NFC leaves as they are
                out[i] = [x.id for x in merge(w.encode().decode("latin-1").translate(self.letters))]
            else:
                rest.append(i)
        for i, e in zip(rest, self.whole.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def encode(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each text has."""
        if len(self.memo) > REMEMBERED:
            self.clear()
        if not len(body):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        folded, starts, ends = self._spans(body, offsets)
        keys, at, back = np.unique(hashes(folded, starts, ends), return_index=True, return_inverse=True)
        entries = self.memo.find(keys)
        new = np.flatnonzero(entries < 0)
        if len(new):
            raw = folded.tobytes()
            found = self._new([raw[starts[k] : ends[k]].decode() for k in at[new]])
            entries[new] = self.memo.add(keys[new])
            self.ids.extend(np.fromiter((x for ids in found for x in ids), np.uint32), np.fromiter(map(len, found), np.int64))
        ids, lengths = self.ids.take(entries[back])
        sums = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, offsets)]
        raw = body.tobytes()
        if any(s in raw for s in self.special):
            each = []
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                text = raw[a:b]
                special = any(s in text for s in self.special)
                each.append(np.array(self.whole.encode(text.decode(), add_special_tokens=False).ids, np.uint32) if special else ids[sums[i] : sums[i + 1]])
            return np.concatenate(each), np.array([len(x) for x in each], np.int64)
        return ids, np.diff(sums)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenized(batches: Iterator[pa.RecordBatch], path: str, end_id: int, kind: type, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """doc_id, source, task, before (tokens of the source before it in this task), n and ids of each row."""
    from pyspark import TaskContext

    tokenizer = _TOKENIZERS.get(path) or _TOKENIZERS.setdefault(path, WordTokenizer(path))
    task, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        for row, end, body, offsets in slices(batch.column("text"), STEP_BYTES):
            ids, n = tokenizer.encode(body, offsets)
            ends = np.cumsum(n + 1)
            full = np.full(int(ends[-1]), end_id, kind)
            keep = np.ones(len(full), bool)
            keep[ends - 1] = False
            full[keep] = ids
            n = n + 1
            codes = batch.column("source").slice(row, end - row).dictionary_encode("encode")
            code = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(code, kind="stable")
            run = np.cumsum(n[order]) - n[order]
            heads = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) != 0]))
            before = np.empty(len(n), np.int64)
            sizes = np.diff(np.concatenate([heads, [len(n)]]))
            names = codes.dictionary.to_pylist()
            start = np.array([seen.get(names[code[order[h]]], 0) for h in heads])
            before[order] = run - np.repeat(run[heads] - start, sizes)
            for h, s in zip(heads, np.add.reduceat(n[order], heads), strict=True):
                name = names[code[order[h]]]
                seen[name] = seen.get(name, 0) + int(s)
            places = np.concatenate([[0], ends * full.itemsize]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(places), pa.py_buffer(full.view(np.uint8))])
            slot = [batch.column("doc_id").slice(row, end - row), batch.column("source").slice(row, end - row), pa.array(np.full(len(n), task, np.int32)), pa.array(before), pa.array(n), packed]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(slot, schema, strict=True)], schema=schema)


@dataclass(frozen=True)
class Rounds:
    """The queues' tokens and quanta (of 1 / ONE token), the length of a window and of a cell."""

    tokens: np.ndarray
    quanta: np.ndarray
    length: int
    cell: int

    def handed(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens that each queue has handed on after so many rounds: a row a number of rounds."""
        unit = self.cell * ONE
        last = -(-(-(-self.tokens // self.cell) * unit) // self.quanta)
        return np.minimum(self.tokens, np.minimum(rounds[:, None], last) * self.quanta // unit * self.cell)

    def place(self, queue: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pieces of documents that hold tokens start to start + n of their queue: (document, start in it, length, place of its first token among all)."""
        first, last = start // self.cell, (start + n - 1) // self.cell
        cells = last - first + 1
        doc = np.repeat(np.arange(len(n)), cells)
        k = spread(first, cells)
        low, high = np.maximum(k * self.cell, start[doc]), np.minimum((k + 1) * self.cell, (start + n)[doc])
        rounds, back = np.unique(-(-(k + 1) * self.cell * ONE // self.quanta[queue[doc]]), return_inverse=True)
        done, then = self.handed(rounds - 1), self.handed(rounds)
        share = then - done
        base = done.sum(1)[:, None] + np.cumsum(share, 1) - share - done
        at = base[back, queue[doc]] + low
        join = np.concatenate([[False], (doc[1:] == doc[:-1]) & (at[1:] == (at + high - low)[:-1])])
        heads = np.flatnonzero(~join)
        return doc[heads], (low - start[doc])[heads], np.add.reduceat(high - low, heads), at[heads]

    def cut(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pieces cut at the ends of windows: (piece, its start in it, length, sequence, offset there)."""
        total = int(self.tokens.sum())
        full, rest = divmod(total, self.length)
        powers = [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
        tail = full * self.length + np.concatenate([[0], np.cumsum(powers, dtype=np.int64)])
        inside = full * self.length
        sequence = lambda x: np.where(x < inside, x // self.length, full + np.searchsorted(tail, x, side="right") - 1)
        begin = lambda s: np.where(s < full, s * self.length, tail[np.clip(s - full, 0, len(tail) - 1)])
        first = sequence(at)
        times = sequence(at + n - 1) - first + 1
        piece = np.repeat(np.arange(len(n)), times)
        s = spread(first, times)
        low, high = np.maximum(at[piece], begin(s)), np.minimum((at + n)[piece], begin(s + 1))
        return piece, low - at[piece], high - low, s, low - begin(s)


def _pieces(batches: Iterator[pa.RecordBatch], rounds: Rounds, kind: type, with_ids: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.column("n").to_numpy()
        step = np.cumsum(n) // STEP_TOKENS
        heads = np.flatnonzero(np.concatenate([[True], np.diff(step) != 0])) if len(n) else np.zeros(0, int)
        for a, b in zip(heads, [*heads[1:], len(n)], strict=True):
            part = batch.slice(a, b - a)
            m = n[a:b]
            queue, start = part.column("queue").to_numpy().astype(np.int64), part.column("start").to_numpy()
            doc, low, length, at = rounds.place(queue, start, m)
            piece, inner, size, sequence, offset = rounds.cut(at, length)
            doc, low = doc[piece], low[piece] + inner
            _, places, data = part.column("ids").buffers()
            places = np.frombuffer(places, np.int32)[part.column("ids").offset :][: b - a + 1]
            ids = np.frombuffer(data, np.uint8)[places[0] : places[-1]].view(kind).astype("<u4")
            begins = ((places[:-1] - places[0]) // np.dtype(kind).itemsize)[doc] + low
            view = memoryview(ids.view(np.uint8))
            checks = np.fromiter((zlib.crc32(view[4 * x : 4 * (x + y)]) for x, y in zip(begins.tolist(), size.tolist(), strict=True)), np.int64, len(doc))
            out = [part.column("doc_id").take(pa.array(doc)), pa.array(low), pa.array(size), pa.array(checks), pa.array(m[doc]), pa.array(sequence), pa.array(offset)]
            if with_ids:
                values = ids[spread(begins, size)].astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(values)))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, schema, strict=True)], schema=schema)


def pack(
    docs: DataFrame,
    tokenizer: str,
    length: int = 2048,
    end_id: int = 1,
    cell: int = 64,
    queues: int = 256,
    targets: Mapping[str | None, float] | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; ids (array) if asked for.

    docs: doc_id, text, source (others are ignored).  tokenizer: the file of a lower-casing word BPE
    (``WordTokenizer``), which every worker can open.  length: tokens of a window; cell: the least
    run that a queue hands on, but at a document's or a queue's end.  targets: weights of
    sources in a window (those not named weigh their share of the tokens); None: all weigh their shares, so
    that all queues end together.  The `queues` - 1 sources with the most tokens have queues of
    their own, the others share one, for a window holds no more of them than a token each.

    A null or empty text has one token, the end id.  A null source is a source of its own.  Null and
    repeated ids and repeated rows are documents of their own.  No rows give none.  Sequences
    are full, but for at most log2(length) last ones whose lengths are powers of two.
    """
    spark = docs.sparkSession
    kept = docs.select("doc_id", F.col("text").cast("string"), F.col("source").cast("string").alias("source"))
    written = T.StructType([kept.schema["doc_id"], kept.schema["source"]]).add("task", "integer").add("before", "long").add("n", "long").add("ids", "binary")
    arrow = _arrow_schema(written)
    kind = np.uint16 if max(end_id + 1, WordTokenizer(tokenizer).whole.get_vocab_size()) <= 1 << 16 else np.uint32
    tokens = settle(kept.mapInArrow(lambda it: _tokenized(it, tokenizer, end_id, kind, arrow), written), "packing-tokens")

    counts = settle(tokens.groupBy("task", "source").agg(F.sum("n").alias("tokens")), "packing-counts")
    largest = counts.groupBy("source").agg(F.sum("tokens").alias("tokens")).orderBy(F.desc("tokens"), F.asc_nulls_first("source")).limit(queues - 1).collect()
    whole = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    rest = whole - sum(r["tokens"] for r in largest)
    named = {} if targets is None else dict(targets)
    weights = [named.get(r["source"], r["tokens"] / whole) for r in largest] + [rest / max(whole, 1)]
    quanta = [max(1, -int(-w * length * ONE // sum(weights))) if whole else 1 for w in weights]
    rounds = Rounds(np.array([*[r["tokens"] for r in largest], rest], np.int64), np.array(quanta, np.int64), length, cell)

    # Where each (task, source) begins in its queue: in the task first, then over the tasks.
    numbers = F.broadcast(spark.createDataFrame([(r["source"], k) for k, r in enumerate(largest)], T.StructType([T.StructField("name", kept.schema["source"].dataType)]).add("queue", "integer")))
    found = counts.join(numbers, F.col("source").eqNullSafe(F.col("name")), "left").drop("name").withColumn("queue", F.coalesce("queue", F.lit(len(largest))))
    inside = Window.partitionBy("task", "queue").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    over = Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = found.groupBy("task", "queue").agg(F.sum("tokens").alias("tokens"))
    tasks = tasks.select("task", "queue", F.coalesce(F.sum("tokens").over(over), F.lit(0)).alias("over"))
    begins = settle(found.join(tasks, ["task", "queue"]).select(F.col("task").alias("t"), F.col("source").alias("s"), "queue", (F.col("inside") + F.col("over")).alias("begin")), "packing-begins")
    if begins.count() <= BROADCAST_ROWS:
        begins = F.broadcast(begins)
    placed = tokens.join(begins, (F.col("task") == F.col("t")) & F.col("source").eqNullSafe(F.col("s")))
    placed = placed.select("doc_id", "n", "ids", "queue", (F.col("begin") + F.col("before")).alias("start"))

    result = T.StructType([kept.schema["doc_id"]])
    for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        result = result.add(name, "long")
    result = result.add("ids", T.ArrayType(T.IntegerType())) if with_ids else result
    final = _arrow_schema(result)
    return placed.mapInArrow(lambda it: _pieces(it, rounds, kind, with_ids, final), result)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id and ids (array) of each sequence, from pieces with ids; a sequence has at most a window of tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op12_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
