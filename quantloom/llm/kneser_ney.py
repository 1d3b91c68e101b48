"""An interpolated modified Kneser-Ney model of words, counted in Spark.

Counting: each task reduces its texts to sorted arrays of distinct keys with counts, deals
them out by a hash of the key, and one task a bucket merges what it gets.  Buckets are
chosen by key, not by context, so a frequent word's continuations are spread over all of
them; the number of buckets follows the tokens.

Storage: the vocabulary is a sorted array of word hashes, with a word's place as its id; the
bigrams are sorted arrays of hashes of id pairs (a bijection, so nothing collides), each with
its counts beside it.  The files lie in the shared folder, one set a bucket; neither buckets,
ids nor counts have a limit.

Scoring: workers map the files into memory, a bounded number at a time, and look tokens up by
binary search.  On a shared folder that is not a mounted file system an executor fetches a
file once, into the folder that Spark keeps for it, and its workers map that copy.

The order is two.  The end of a document is a token, and stands as the context of the next
document's first word.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import bytewords
from quantloom.llm.shared import free, own_folder, remainder, settle, table

END = np.uint64(0x00E0D0FD0C0DE001)
#: Tokens that a counting task holds before it reduces them.
HOLD = 1 << 23
#: Tokens after which it reduces them in any case, so that a count has 4 bytes.
MOST_TOKENS = 1 << 31


def tokens(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens of a run of texts (each text's words, then END), and where each text begins."""
    words = bytewords.Words(body, offsets)
    begins = words.first + np.arange(len(words.first))
    out = np.full(begins[-1], END, dtype=np.uint64)
    out[np.arange(len(words.starts)) + words.row] = words.hashes()
    return out, begins


def contexts(token: np.ndarray, begins: np.ndarray, end: int | np.uint64) -> np.ndarray:
    """The token before each; before a text's first, `end`."""
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[begins[:-1]] = end
    return before


def _counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of the counts of each."""
    if counts is None:
        values, n = np.unique(keys, return_counts=True)
        return values, n.astype(np.uint32)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts.astype(np.int64), first) if len(first) else counts.astype(np.int64)


def _dealt(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row a bucket: bucket, and the bytes of each array's part in it (order within a bucket stays)."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.concatenate([cuts[1:], [len(bucket)]])
    if len(cuts):
        columns = [pa.array([a[order[x:y]].tobytes() for x, y in zip(cuts, ends, strict=True)], pa.large_binary()) for a in arrays]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), *columns], names=["bucket", *[f"a{i}" for i in range(len(arrays))]])


def _joined(block: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in block.column(name)), dtype=kind)


class Files:
    """The model's arrays: written under a name in one step, read as memory maps, at most `most_open` of them."""

    def __init__(self, uri: str, most_open: int = 256):
        self.uri, self.most_open, self.maps = uri, most_open, OrderedDict()

    def _at(self, name: str):
        return pyarrow.fs.FileSystem.from_uri(f"{self.uri}/{name}")

    def write(self, name: str, array: np.ndarray) -> None:
        """A task that runs again finds its file there; the content is the same."""
        fs, path = self._at(name)
        if fs.get_file_info(path).type == pyarrow.fs.FileType.File:
            return
        fs.create_dir(os.path.dirname(path), recursive=True)
        draft = f"{path}.{uuid.uuid4().hex}"  # under its name it is always whole
        with fs.open_output_stream(draft) as out:
            out.write(np.ascontiguousarray(array).tobytes())
        fs.move(draft, path)

    def read(self, name: str, kind) -> np.ndarray:
        if name not in self.maps:
            self.maps[name] = self._map(name, kind)
            if len(self.maps) > self.most_open:
                self.maps.popitem(last=False)
        self.maps.move_to_end(name)
        return self.maps[name]

    def _map(self, name: str, kind) -> np.ndarray:
        fs, path = self._at(name)
        info = fs.get_file_info(path)
        if info.type == pyarrow.fs.FileType.NotFound or not info.size:
            return np.zeros(0, dtype=kind)
        if not isinstance(fs, pyarrow.fs.LocalFileSystem):
            own = os.path.join(SparkFiles.getRootDirectory(), os.path.basename(self.uri), name)
            if not os.path.exists(own):
                os.makedirs(os.path.dirname(own), exist_ok=True)
                draft = f"{own}.{uuid.uuid4().hex}"
                with open(draft, "wb") as out, fs.open_input_stream(path) as source:
                    while piece := source.read(1 << 22):
                        out.write(piece)
                os.replace(draft, own)  # workers that fetch it at once end with the same file
            path = own
        return np.memmap(path, dtype=kind, mode="r")


def _top(bits: int, keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _runs(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The buckets of a sorted array, and where each stands."""
    cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]) if len(bucket) else [0]
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(bucket[x]), slice(int(x), int(y))


class Vocabulary:
    """Word ids: places in the sorted hashes, bucket after bucket."""

    def __init__(self, files: Files, bits: int, sizes: np.ndarray):
        self.files, self.bits, self.starts = files, bits, np.concatenate([[0], np.cumsum(sizes)])

    def ids(self, h: np.ndarray) -> np.ndarray:
        """The id of each hash; the number of words for one that is not there."""
        distinct, back = np.unique(h, return_inverse=True)
        out = np.full(len(distinct), self.starts[-1], dtype=np.int64)
        for b, at in _runs(_top(self.bits, distinct)):
            held = self.files.read(f"words-{b}", np.uint64)
            if len(held):
                place = np.minimum(np.searchsorted(held, distinct[at]), len(held) - 1)
                out[at] = np.where(held[place] == distinct[at], self.starts[b] + place, self.starts[-1])
        return out[back]

    def values(self, name: str, kind, ids: np.ndarray, unknown: float) -> np.ndarray:
        """What the files of that name hold for sorted ids."""
        out = np.full(len(ids), unknown, dtype=np.float64)
        known = int(np.searchsorted(ids, self.starts[-1]))
        for b, at in _runs(np.searchsorted(self.starts, ids[:known], side="right") - 1):
            out[at] = self.files.read(f"{name}-{b}", kind)[ids[at] - self.starts[b]]
        return out


@dataclass(frozen=True)
class Pairs:
    """Pairs of ids of `width` bits as (bucket, key): a bijection of 2 * width bits, of which the first `bits` are the bucket.

    The key is the last 64 bits; those above, with ids of over 32 bits, are known from the bucket.
    """

    width: int
    bits: int

    @staticmethod
    def of(words: int, buckets: float) -> Pairs:
        width = max(32, int(words + 1).bit_length())  # one id more is for the unknown word
        return Pairs(width, max(_bits(buckets), 2 * width - 64))

    def _rounds(self, left: np.ndarray, right: np.ndarray, order: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        mask, two = np.uint64((1 << self.width) - 1), [left.astype(np.uint64), right.astype(np.uint64)]
        for k in order:
            two[k % 2] = two[k % 2] ^ (bytewords.mix(two[1 - k % 2] + np.uint64(k + 1)) & mask)
        return two[0], two[1]

    def pack(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = self._rounds(left, right, (0, 1, 2))
        return (x >> np.uint64(self.width - self.bits)).astype(np.int64), x << np.uint64(self.width) | y

    def unpack(self, bucket: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        above = np.uint64((bucket >> (self.bits - (2 * self.width - 64))) << (64 - self.width))
        x, y = self._rounds(above | key >> np.uint64(self.width), key & np.uint64((1 << self.width) - 1), (2, 1, 0))
        return x.astype(np.int64), y.astype(np.int64)

    def distinct(self, bucket: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs, sorted by bucket and key, and the place of each pair among them."""
        if self.width == 32:  # the key has the bucket in it
            key, back = np.unique(key, return_inverse=True)
            return _top(self.bits, key), key, back
        order = np.lexsort((key, bucket))
        bucket, key = bucket[order], key[order]
        new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1])]) if len(key) else np.zeros(0, bool)
        back = np.empty(len(key), dtype=np.int64)
        back[order] = np.cumsum(new) - 1
        return bucket[new], key[new], back


@dataclass(frozen=True)
class Model:
    """What the driver keeps: a few numbers and where the files are."""

    uri: str
    word_bits: int
    word_sizes: np.ndarray
    pairs: Pairs
    train_tokens: int
    discounts: tuple[float, float, float]
    low_discounts: tuple[float, float, float]
    kinds: int
    low_kinds: tuple[int, int, int]

    @property
    def vocabulary(self) -> int:
        return int(self.word_sizes.sum())


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts from the numbers of n-grams that occur once, twice, three and four times."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k) for d, k in zip(raw, (0.95, 1.95, 2.95), strict=True))


def _minus(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """The discount of each count."""
    return np.array([0.0, *d])[np.minimum(c, 3).astype(np.int64)]


def _bits(buckets: float) -> int:
    return max(2, int(np.ceil(np.log2(max(buckets, 1)))))


def _slim(counts: np.ndarray) -> np.ndarray:
    """Counts in 4 bytes each, or in 8 where one needs them."""
    return counts.astype(np.uint32 if not len(counts) or counts.max() < 1 << 32 else np.uint64)


def train(docs: DataFrame, per_bucket: int = 4_000_000, texts_per_bucket: int = 20_000, width: int | None = None) -> Model:
    """Counts `docs` (text) and leaves the model's files in the shared folder.

    per_bucket: about as many tokens' pairs are merged by one task, and texts_per_bucket texts'
    words; the buckets grow with the input without limit.  width: bits of a word id, by
    default 32 or as many as the words need.  Null and empty texts count one token each;
    without any rows the model is empty, and every token is unknown to it.
    """
    spark = docs.sparkSession
    files = Files(f"{own_folder(spark)}/kneser-ney-{uuid.uuid4().hex}")
    texts = docs.select("text")
    rows = texts.count()
    word_bits = _bits(rows / texts_per_bucket)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen = [], 0, 0

        def dealt() -> Iterator[pa.RecordBatch]:
            keys, counts = _counted(*map(np.concatenate, zip(*held, strict=True)))
            yield from _dealt(_top(word_bits, keys), keys, counts.astype(np.uint32))

        for batch in batches:
            for _, _, body, offsets in bytewords.slices(batch.column("text")):
                h, _ = tokens(body, offsets)
                held.append(_counted(h))
                n, seen = n + len(held[-1][0]), seen + len(h)
                if n > HOLD or seen > MOST_TOKENS:
                    yield from dealt()
                    held, n, seen = [], 0, 0
        if held:
            yield from dealt()

    def merge_words(block: pa.Table) -> pa.Table:
        b = block.column("bucket")[0].as_py()
        keys, counts = _counted(_joined(block, "a0", np.uint64), _joined(block, "a1", np.uint32))
        files.write(f"words-{b}", keys)
        files.write(f"counts-{b}", counts)
        return pa.table({"bucket": pa.array([b], pa.int32()), "words": [len(keys)], "tokens": [int(counts.sum())]})

    dealt = texts.mapInArrow(count_words, "bucket int, a0 binary, a1 binary")
    found = dealt.groupBy("bucket").applyInArrow(merge_words, "bucket int, words long, tokens long").collect()  # a row a bucket
    sizes = np.zeros(1 << word_bits, dtype=np.int64)
    for r in found:
        sizes[r["bucket"]] = r["words"]
    total = sum(r["tokens"] for r in found)
    pairs = Pairs.of(int(sizes.sum()), total / per_bucket)
    if width is not None:
        pairs = Pairs(width, max(pairs.bits, 2 * width - 64))

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, n, seen = Vocabulary(files, word_bits, sizes), [], 0, 0
        end = words.ids(np.array([END]))[0]

        def dealt() -> Iterator[pa.RecordBatch]:
            bucket, key, counts = map(np.concatenate, zip(*held, strict=True))
            bucket, key, at = pairs.distinct(bucket, key)
            yield from _dealt(bucket, key, np.bincount(at, counts, len(key)).astype(np.uint32))

        for batch in batches:
            for _, _, body, offsets in bytewords.slices(batch.column("text")):
                h, begins = tokens(body, offsets)
                ids = words.ids(h)
                bucket, key, at = pairs.distinct(*pairs.pack(contexts(ids, begins, end), ids))
                held.append((bucket.astype(np.int32), key, np.bincount(at, minlength=len(key)).astype(np.uint32)))
                n, seen = n + len(key), seen + len(h)
                if n > HOLD or seen > MOST_TOKENS:
                    yield from dealt()
                    held, n, seen = [], 0, 0
        if held:
            yield from dealt()

    word_starts = np.concatenate([[0], np.cumsum(sizes)])

    def merge_pairs(block: pa.Table) -> pa.Table:
        """Writes the bucket's pairs; returns what it adds to its contexts and words, by their buckets."""
        b = block.column("bucket")[0].as_py()
        keys, counts = _counted(_joined(block, "a0", np.uint64), _joined(block, "a1", np.uint32))
        files.write(f"pairs-{b}", keys)
        files.write(f"pair-counts-{b}", _slim(counts))
        left, right = pairs.unpack(b, keys)
        level = np.minimum(counts, 3)
        ids, at = np.unique(np.concatenate([left, right]), return_inverse=True)
        sums = np.zeros((4, len(ids)), dtype=np.uint32)  # each at most the bucket's pairs
        for k in (1, 2, 3):
            sums[k - 1] = np.bincount(at[: len(left)][level == k], minlength=len(ids))
        sums[3] = np.bincount(at[len(left) :], minlength=len(ids))
        where = np.searchsorted(word_starts, ids, side="right") - 1
        out = list(_dealt(where, ids.astype(np.uint64), *sums))
        times = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        head = pa.RecordBatch.from_arrays(
            [pa.array([-1], pa.int32()), pa.array([np.array([len(keys), *times], np.int64).tobytes()], pa.large_binary()), *[pa.array([b""], pa.large_binary())] * 4],
            names=out[0].schema.names,
        )
        return pa.Table.from_batches([head, *out]).cast(pa.schema([("bucket", pa.int32()), *[(f"a{i}", pa.binary()) for i in range(5)]]))

    dealt = texts.mapInArrow(count_pairs, "bucket int, a0 binary, a1 binary")
    fields = "bucket int, a0 binary, a1 binary, a2 binary, a3 binary, a4 binary"
    merged = settle(dealt.groupBy("bucket").applyInArrow(merge_pairs, fields), "pair-sums")
    heads = [np.frombuffer(r[0], np.int64) for r in merged.where("bucket = -1").select("a0").collect()]
    kinds, *times = np.sum(heads, axis=0).tolist() if heads else [0] * 5
    d = discounts(times)

    def merge_sums(block: pa.Table) -> pa.Table:
        """Writes, for each word of a bucket, the weight that it hands down as a context, and its contexts' number."""
        b = block.column("bucket")[0].as_py()
        at = _joined(block, "a0", np.uint64).astype(np.int64) - word_starts[b]
        n = [np.bincount(at, _joined(block, f"a{k}", np.uint32), sizes[b]) for k in (1, 2, 3, 4)]
        counts = np.asarray(files.read(f"counts-{b}", np.int64))
        files.write(f"handed-{b}", ((d[0] * n[0] + d[1] * n[1] + d[2] * n[2]) / np.maximum(counts, 1)).astype(np.float32))
        files.write(f"before-{b}", n[3].astype(np.int64))
        return pa.table({f"n{k}": [int((n[3] == k).sum())] for k in (1, 2, 3, 4)} | {"words": [int((n[3] > 0).sum())]})

    low = merged.where("bucket >= 0").groupBy("bucket").applyInArrow(merge_sums, "n1 long, n2 long, n3 long, n4 long, words long").collect()
    free(merged)
    n = [sum(r[f"n{k}"] for r in low) for k in (1, 2, 3, 4)]
    several = sum(r["words"] for r in low) - n[0] - n[1]
    return Model(files.uri, word_bits, sizes, pairs, total, d, discounts(n), kinds, (n[0], n[1], several))


class Scorer:
    """Token probabilities by the model's mapped files."""

    def __init__(self, model: Model):
        self.files = Files(model.uri)
        self.model, self.words = model, Vocabulary(self.files, model.word_bits, model.word_sizes)
        self.end = self.words.ids(np.array([END]))[0]

    def _seen(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The count of each pair of ids."""
        bucket, key, back = self.model.pairs.distinct(*self.model.pairs.pack(left, right))
        out = np.zeros(len(key))
        for b, at in _runs(bucket):
            held = self.files.read(f"pairs-{b}", np.uint64)
            if len(held):
                place = np.minimum(np.searchsorted(held, key[at]), len(held) - 1)
                counts = self.files.read(f"pair-counts-{b}", np.uint32)
                counts = counts if len(counts) == len(held) else counts.view(np.uint64)
                out[at] = np.where(held[place] == key[at], counts[place], 0)
        return out[back]

    def score(self, body: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """n_tokens, n_known, base_score and score of each text of a run."""
        m = self.model
        h, begins = tokens(body, offsets)
        ids = self.words.ids(h)
        distinct, at = np.unique(np.append(ids, self.end), return_inverse=True)
        at, end_at = at[:-1], at[-1]
        count = self.words.values("counts", np.int64, distinct, 0.0)
        handed = self.words.values("handed", np.float32, distinct, 1.0)
        before = self.words.values("before", np.int64, distinct, 0.0)
        base = np.log10((count + 0.1) / (m.train_tokens + 0.1 * (m.vocabulary + 1)))
        kinds = max(m.kinds, 1)
        left = sum(k * v for k, v in zip(m.low_kinds, m.low_discounts, strict=True)) / kinds if m.kinds else 1.0
        low = (before - _minus(before, m.low_discounts)) / kinds + left / (m.vocabulary + 1)
        context = contexts(at, begins, end_at)
        c = self._seen(distinct[context], distinct[at])
        known = count[context]
        p = np.where(known > 0, (c - _minus(c, m.discounts)) / np.maximum(known, 1) + handed[context] * low[at], low[at])
        firsts = begins[:-1]
        return [np.diff(begins), np.add.reduceat((count > 0)[at].astype(np.int64), firsts), np.add.reduceat(base[at], firsts), np.add.reduceat(np.log10(p), firsts)]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (log10 of the text's probability), perplexity, for each row of `docs`.

    Null and empty texts have one token, the end.  A context that training never saw hands all
    its weight to the lower order; an unknown word gets the share that the lower order keeps.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for start, end, body, offsets in bytewords.slices(batch.column("text")):
                n, known, base, total = scorer.score(body, offsets)
                columns = [n, known, base, total, 10 ** (-total / n)]
                names = ["n_tokens", "n_known", "base_score", "score", "perplexity"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, end - start), *map(pa.array, columns)], names=["doc_id", *names])

    schema = f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double, perplexity double"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(remainder("doc_id", 10) != 0))
    return score(docs, model).select(
        "doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity"
    )
