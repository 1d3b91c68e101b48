"""Cross-tokenizer alignment: which tokens of two tokenizers share bytes of a text.

Byte-owner arrays: the token indices of A and of B are repeated over their bytes.  Where the pair
of owners changes from a byte to the next, a new overlap (link) begins; where both change at once,
both tokenizers cut the text, and a new group begins.

Both tokenizers are run and aligned once a unit (a word with the white space before it), for
neither has a token that reaches from a letter or sign into a space after it; a worker remembers
units.  Counts of id pairs are summed over the corpus by a shuffle of (block, pair) rows: a block is a
few megabytes of text that a task read together.  The sums go back to the blocks that hold the pair, and
each block's documents add up theirs.  Texts are not shuffled, only a number for each unit.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.bytewords import slices
from quantloom.llm.shared import settle, table
from quantloom.llm.units import Memo, Ragged, byte_letters, hashes, pack_small, spread, unpack_small

#: Text bytes of a block and of a step of it; bytes of unit texts that a worker remembers.
BLOCK_BYTES, STEP_BYTES, REMEMBERED_BYTES = 8 << 20, 1 << 20, 4 << 20
_DOC, _UNITS, _PAIR = range(3)
ROWS = "kind integer, block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, units binary, pair long, place integer, n long"


def unit_starts(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units begin in texts that begin with a space each.

    A unit begins at a space that follows anything but white space and control characters, and
    does not end its text.  Characters of the blocks that hold Unicode's spaces count as such.
    """
    begins = np.zeros(len(body), bool)
    at = np.flatnonzero(body == 32)
    at = at[at > 0]
    a, b, c = body[at - 1], body[at - 2], body[at - 3]  # of a text's first bytes: its own, or a false alarm that splits less
    plain = (a > 32) & (a != 127)
    plain &= ~((b == 0xC2) & ((a == 0x85) | (a == 0xA0)))
    plain &= ~(((c == 0xE1) & (b == 0x9A)) | ((c == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((c == 0xE3) & (b == 0x80)))
    begins[at[plain]] = True
    held = offsets[:-1][np.diff(offsets) > 0]
    begins[offsets[1:][np.diff(offsets) > 0] - 1] = False
    begins[held] = True
    return np.flatnonzero(begins)


class Aligner:
    """Aligned units: their numbers of tokens, groups and links, groups as text, and links as pairs of ids."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = {c: i for i, c in enumerate(byte_letters())}
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in side]) for side in (self.bytes_a, self.bytes_b))
        self.clear()

    def clear(self) -> None:
        self.memo, self.links, self.text, self.held = Memo(), Ragged(np.int64), [], 0
        self.numbers = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links; n_groups is 0 where a side's bytes differ

    def make_room(self) -> None:
        """Forgets all units where they are too many; entries given before are void then."""
        if self.held > REMEMBERED_BYTES:
            self.clear()

    def entries(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of each unit of `body`; those not known are aligned."""
        keys, at, back = np.unique(hashes(body, starts, ends), return_index=True, return_inverse=True)
        found = self.memo.find(keys)
        new = np.flatnonzero(found < 0)
        raw = body.tobytes()
        for k in range(0, len(new), 50_000):
            some = new[k : k + 50_000]
            self._align([raw[starts[i] : ends[i]] for i in at[some]])
        if len(new):
            found[new] = self.memo.add(keys[new])
        return found[back]

    def _align(self, units: list[bytes]) -> None:
        """Appends entries for units, each with a space before it."""
        self.held += sum(map(len, units))
        texts = [u.decode() for u in units]
        tokens_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        tokens_b = self.b.encode([t[1:] for t in texts], num_threads=1)  # B adds the space
        joined = lambda ids, each: b"".join([each[i] for i in ids])
        good = np.array([joined(a, self.bytes_a) == u == joined(b, self.bytes_b) for a, b, u in zip(tokens_a, tokens_b, units, strict=True)])
        tokens_a = [a for a, ok in zip(tokens_a, good, strict=True) if ok]
        tokens_b = [b for b, ok in zip(tokens_b, good, strict=True) if ok]
        n_a, n_b = np.array([len(a) for a in tokens_a], np.int64), np.array([len(b) for b in tokens_b], np.int64)
        a, b = (np.fromiter((i for ids in x for i in ids), np.int64) for x in (tokens_a, tokens_b))
        owner_a, owner_b = np.repeat(np.arange(len(a)), self.size_a[a]), np.repeat(np.arange(len(b)), self.size_b[b])
        first = np.ones(1 if len(a) else 0, bool)
        new_a, new_b = (np.concatenate([first, x[1:] != x[:-1]]) for x in (owner_a, owner_b))
        cut = new_a & new_b
        link = np.flatnonzero(new_a | new_b)
        group = np.cumsum(cut) - 1
        pairs = a[owner_a[link]] * len(self.bytes_b) + b[owner_b[link]]
        # Numbers a unit: units begin where the A tokens before them end.
        unit_a = np.repeat(np.arange(len(n_a)), n_a)
        unit = unit_a[owner_a]
        n_groups, n_links = np.bincount(unit[cut], minlength=len(n_a)), np.bincount(unit[link], minlength=len(n_a))
        numbers = np.zeros((len(units), 4), np.int64)
        numbers[good] = np.stack([n_a, n_b, n_groups, n_links], 1)
        # Tokens in order of (group, side), each with what follows it.
        side_a, side_b = group[new_a], group[new_b]
        ends = lambda g: np.concatenate([g[1:] != g[:-1], first])
        written = [f"{i}|" if e else f"{i}," for i, e in zip(a.tolist(), ends(side_a).tolist(), strict=True)]
        written += [f"{i};" if e else f"{i}," for i, e in zip(b.tolist(), ends(side_b).tolist(), strict=True)]
        order = np.argsort(np.concatenate([side_a * 2, side_b * 2 + 1]), kind="stable").tolist()
        written = [written[i] for i in order]
        bounds = np.zeros(len(units) + 1, np.int64)
        bounds[1:] = np.cumsum(numbers[:, 0] + numbers[:, 1])
        bounds = bounds.tolist()
        self.text += ["".join(written[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        self.numbers = np.concatenate([self.numbers, numbers])
        self.links.extend(pairs, numbers[:, 3])


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligned(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of documents, a row a block with its units' links, and rows of the block's pairs."""
    from pyspark import TaskContext

    aligner = _ALIGNERS.get((path_a, path_b)) or _ALIGNERS.setdefault((path_a, path_b), Aligner(path_a, path_b))
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        ids, parts, size, begin = batch.column("doc_id"), [], 0, 0
        for row, end, body, offsets in slices(batch.column("text"), STEP_BYTES):
            if not parts:
                aligner.make_room()  # never between the steps of a block
            parts.append(_step(aligner, body, offsets))
            size += len(body)
            if size >= BLOCK_BYTES or end == len(ids):
                yield from _block(aligner, block, ids.slice(begin, end - begin), parts, schema)
                block, parts, size, begin = block + 1, [], 0, end


def _step(aligner: Aligner, body: np.ndarray, offsets: np.ndarray) -> tuple:
    """Of each text: entries of its units (none where a tokenizer changes a byte), numbers, and the hash of its groups."""
    held = np.diff(offsets) > 0
    body = np.insert(body, offsets[:-1][held], 32)
    offsets = offsets + np.concatenate([[0], np.cumsum(held)])
    starts = unit_starts(body, offsets)
    entries = aligner.entries(body, starts, np.concatenate([starts[1:], offsets[-1:]])[: len(starts)])
    first = np.searchsorted(starts, offsets)
    per = np.diff(first)
    bad = np.zeros(len(per), bool)
    bad[np.repeat(np.arange(len(per)), per)[aligner.numbers[entries, 2] == 0]] = True
    numbers = np.zeros((len(per), 4), np.int64)
    for k in range(4):
        sums = np.concatenate([[0], np.cumsum(aligner.numbers[entries, k])])
        numbers[:, k] = np.where(bad, 0, sums[first[1:]] - sums[first[:-1]])
    listed, text, hashed = entries.tolist(), aligner.text, []
    for a, b, wrong in zip(first[:-1].tolist(), first[1:].tolist(), bad.tolist(), strict=True):
        hashed.append("" if a == b or wrong else hashlib.sha256("".join([text[i] for i in listed[a:b]])[:-1].encode()).hexdigest())
    return entries[np.repeat(~bad, per)].astype(np.int32), np.where(bad, 0, per), numbers, hashed


def _block(aligner: Aligner, block: int, ids: pa.Array, parts: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    entries, per, numbers = (np.concatenate([p[k] for p in parts]) for k in range(3))
    # The most frequent units first, so that most numbers take a byte or two.
    known, local, times = np.unique(entries, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    local = rank[local]
    links, each = aligner.links.take(known[order])
    pairs, places = np.unique(links, return_inverse=True)
    counts = np.bincount(places, np.repeat(times[order], each), len(pairs)).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(per)]).tolist()
    units = [pack_small(local[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    n, m = len(per), len(pairs)
    named = dict(zip(("n_a", "n_b", "n_groups", "n_links"), numbers.T, strict=True))
    yield _record(schema, n, ids, kind=np.full(n, _DOC), block=np.full(n, block), **named, groups_sha256=[x for p in parts for x in p[3]], units=units)
    if m:
        yield _record(schema, 1, None, kind=[_UNITS], block=[block], units=[pack_small(np.concatenate([[len(each)], each, places]))])
        yield _record(schema, m, None, kind=np.full(m, _PAIR), block=np.full(m, block), pair=pairs, place=np.arange(m), n=counts)


def _record(schema: pa.Schema, rows: int, doc_id: pa.Array | None, **columns) -> pa.RecordBatch:
    """A batch of `schema`, null where nothing is given."""
    columns |= {} if doc_id is None else {"doc_id": doc_id}
    made = [pa.nulls(rows, f.type) if f.name not in columns else pa.array(columns[f.name]).cast(f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema]
    return pa.RecordBatch.from_arrays(made, schema=schema)


def _summed(block: pa.Table, pairs: pa.Table, schema: pa.Schema) -> pa.Table:
    """A block's documents with n_best and count_sum, from the corpus-wide counts of its pairs."""
    kind = block.column("kind").to_numpy()
    docs = block.filter(pa.array(kind == _DOC))
    place = pairs.column("place").to_numpy()
    total, top = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    total[place], top[place] = pairs.column("total").to_numpy(), pairs.column("top").to_numpy()
    values = np.zeros((0, 2), np.int64)
    if len(place):
        packed = unpack_small(block.filter(pa.array(kind == _UNITS)).column("units")[0].as_py())
        each, places = packed[1 : packed[0] + 1], packed[packed[0] + 1 :]
        starts = np.cumsum(each) - each  # no unit is without links
        values = np.stack([np.add.reduceat(top[places], starts), np.add.reduceat(total[places], starts)], 1)
    sums = np.zeros((len(docs), 2), np.int64)
    for i, units in enumerate(docs.column("units").to_pylist()):
        if units:
            sums[i] = values[unpack_small(units)].sum(0)
    out = {f.name: docs.column(f.name) for f in schema if f.name in docs.column_names} | {"n_best": pa.array(sums[:, 0]), "count_sum": pa.array(sums[:, 1])}
    return pa.table([out[f.name].cast(f.type) for f in schema], schema=schema)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    docs: doc_id, text (others are ignored).  path_a: a byte-level BPE file, run on the text after a space;
    path_b: a sentencepiece BPE file that adds that space and keeps white space.  Every worker can
    open both.  n_links: pairs of an A and a B token that share bytes; n_groups: pieces between
    places where tokens of both end; n_best: links whose pair of ids is linked as often in the corpus as any pair with
    its B id; count_sum: those counts, over the links.

    Null and empty texts, and texts of which a tokenizer changes a byte, have no tokens: zeros, and ''
    for the hash.  Null and repeated ids and repeated rows are documents of their own.  No rows give none.
    """
    kept = docs.select("doc_id", F.col("text").cast("string"))
    identity = kept.schema["doc_id"]
    made = T.StructType([identity, *T._parse_datatype_string(ROWS).fields])
    arrow = _arrow(made)
    rows = settle(kept.mapInArrow(lambda it: _aligned(it, path_a, path_b, arrow), made), "aligned-blocks")
    pairs = rows.where(F.col("kind") == _PAIR).select("block", "pair", "place", "n")
    counts = settle(pairs.groupBy("pair").agg(F.sum("n").alias("total")), "pair-counts")
    b = F.pmod("pair", F.lit(_pieces(path_b)))
    best = counts.groupBy(b.alias("b")).agg(F.max("total").alias("most"))  # a row an id of B at most
    counted = counts.withColumn("b", b).join(F.broadcast(best), "b").select("pair", "total", (F.col("total") == F.col("most")).cast("long").alias("top"))
    located = pairs.join(counted, "pair").select(F.col("block").alias("at"), "place", "total", "top")
    result = T.StructType([identity])
    for name in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"):
        result = result.add(name, "long")
    result = result.add("groups_sha256", "string")
    final = _arrow(result)
    left = rows.where(F.col("kind") != _PAIR).drop("pair", "place", "n")
    return left.groupBy("block").cogroup(located.groupBy("at")).applyInArrow(lambda x, y: _summed(x, y, final), result)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _pieces(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


def op13_byte_owner_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
