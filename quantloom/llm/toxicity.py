"""Toxicity: logistic regression over hashed word n-grams and skip-grams, fitted by FTRL-proximal.

Every coordinate has its own learning rate, and the L1 term leaves most weights at zero, so
the model is a short list of (coordinate, weight) that each task holds whole.  Features are
the words, the word pairs, and the pairs that skip one or two words, as present or absent.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm import bytewords
from quantloom.llm.shared import free, remainder, settle, table, unit

BITS = 24

_NOT_LETTER = np.ones(256, dtype=bool)
_NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _features(body: np.ndarray, offsets: np.ndarray, skips: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(coordinate, text) of the words, then of the pairs at each distance from 1 to skips + 1."""
    words = bytewords.Words(body, offsets, _NOT_LETTER)
    h, row = words.hashes(), words.row
    shift = np.uint64(64 - BITS)
    yield (h >> shift).astype(np.int32), row
    for gap in range(1, skips + 2):
        if len(h) <= gap:
            return
        pair = bytewords.mix(h[:-gap] * np.uint64(2 * gap + 1) + h[gap:])
        same = row[:-gap] == row[gap:]
        yield (pair[same] >> shift).astype(np.int32), row[:-gap][same]


def _gather(skips: int):
    """A mapInArrow function: doc_id, text, y -> doc_id, the sorted distinct coordinates (int32 bytes) of each text, y."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, body, offsets in bytewords.slices(batch.column("text")):
                found = list(_features(body, offsets, skips))
                codes = np.unique(np.concatenate([r.astype(np.int64) << BITS | c for c, r in found])) if found else np.zeros(0, np.int64)
                bounds = np.searchsorted(codes >> BITS, np.arange(end - start + 1))
                low = (codes & ((1 << BITS) - 1)).astype(np.int32)
                rows = [low[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                cut = lambda c: batch.column(c).slice(start, end - start)
                yield pa.RecordBatch.from_arrays([cut("doc_id"), pa.array(rows, pa.binary()), cut("y")], names=["doc_id", "codes", "y"])

    return gather


@dataclass(frozen=True)
class Model:
    """coordinates (sorted int32), their weights, and the bias."""

    coordinates: np.ndarray
    weights: np.ndarray
    bias: float
    skips: int


def ftrl(rows: list[tuple[np.ndarray, int]], importance: tuple[float, float], epochs: int = 5, alpha: float = 3.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1, least_rows: int = 3, skips: int = 2) -> Model:
    """FTRL-proximal over (coordinates, label) rows, in a fixed random order.

    importance: weights of labels 0 and 1.  Coordinates of fewer than `least_rows` rows are
    left out.  `alpha` and `l1` made the fewest mistakes in three folds of the learnable labels.
    """
    size = 1 << BITS
    seen = np.zeros(size, dtype=np.uint8)
    for codes, _ in rows:
        seen[codes] += seen[codes] < 255
    used = np.flatnonzero(seen >= least_rows).astype(np.int32)
    place = np.full(size, -1, dtype=np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    rows = [(at[at >= 0], y) for at, y in ((place[codes], y) for codes, y in rows)]
    del seen, place
    z, n = np.zeros(len(used) + 1), np.zeros(len(used) + 1)  # the last is the bias, without L1
    order = np.random.default_rng(3)

    def weights(zs: np.ndarray, ns: np.ndarray, penalty: float) -> np.ndarray:
        return np.where(np.abs(zs) <= penalty, 0.0, -(zs - np.sign(zs) * penalty) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, y = rows[i]
            w = weights(z[at], n[at], l1)
            bias = weights(z[-1:], n[-1:], 0.0)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias[0], -30, 30)))
            g = (p - y) * importance[y]
            for where, ws in ((at, w), (slice(-1, None), bias)):
                sigma = (np.sqrt(n[where] + g * g) - np.sqrt(n[where])) / alpha
                z[where] += g - sigma * ws
                n[where] += g * g
    final = weights(z[:-1], n[:-1], l1)
    keep = np.flatnonzero(final)
    return Model(used[keep], final[keep], float(weights(z[-1:], n[-1:], 0.0)[0]), skips)


def train(docs: DataFrame, known: DataFrame, most: tuple[int, int] = (5000, 3000), skips: int = 2, driver_bytes: int = 256 << 20) -> Model:
    """The model of `docs` (doc_id, text) and `known` (doc_id, y: 0 or 1; other values are left out).

    most: labels of 0 and of 1 taken, chosen by a hash of the id, so that about that many
    ids are broadcast and that many texts' features reach the driver; rows of a label that
    has more are weighted up to stand for all of its rows.  driver_bytes: where the features
    have more bytes, so many texts are taken, by another hash of the id, as fit.  Repeated
    rows teach as often as they stand.  Without any rows of one of the labels the model has no
    weights.
    """
    known = known.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    count = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    chance = F.when(F.col("y") == 1, min(1.0, most[1] / max(count.get(1, 0), 1))).otherwise(min(1.0, most[0] / max(count.get(0, 0), 1)))
    picked = known.where(unit(F.col("doc_id"), F.lit("toxicity")) < chance).select("doc_id", F.col("y").cast("int").alias("y"))
    chosen = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y")
    kind = docs.schema["doc_id"].dataType.simpleString()
    features = settle(chosen.mapInArrow(_gather(skips), f"doc_id {kind}, codes binary, y int"), "toxicity-features")
    size = features.agg(F.sum(F.octet_length("codes") + 16)).first()[0] or 0
    fits = unit(F.col("doc_id"), F.lit("bytes")) < min(1.0, driver_bytes / max(size, 1))
    # By id, so that the order of learning is the same on every run.
    got = features.where(fits).orderBy("doc_id", "y", F.xxhash64("codes")).select("codes", "y").toArrow()
    free(features)
    held = got["codes"].combine_chunks().cast(pa.large_binary())
    body = np.frombuffer(held.buffers()[2] or b"", dtype=np.uint8)
    offs = np.frombuffer(held.buffers()[1], dtype=np.int64)[held.offset :] if len(held) else []
    # Views of the Arrow buffer: the driver holds the sample's features once.
    rows = [(body[offs[i] : offs[i + 1]].view(np.int32), y) for i, y in enumerate(got["y"].to_pylist())]
    here = [sum(y == k for _, y in rows) for k in (0, 1)]
    if not all(here):
        return Model(np.zeros(0, np.int32), np.zeros(0), -2.0 if not here[1] else 2.0, skips)
    model = ftrl(rows, tuple(count[k] / here[k] / max(1.0, sum(count.values()) / sum(here)) for k in (0, 1)), skips=skips)
    del rows, body, offs, held, got
    _give_back()
    return model


def _give_back() -> None:
    """Returns freed memory to the system: a driver lives on for long after it has trained."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def _scorer(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.zeros(1 << 18, dtype=bool)  # a first test by the leading bits of a coordinate
        low[model.coordinates >> (BITS - 18)] = True
        for batch in batches:
            parts = []
            for start, end, body, offsets in bytewords.slices(batch.column("text")):
                hits = []
                for codes, row in _features(body, offsets, model.skips):
                    maybe = np.flatnonzero(low[codes >> (BITS - 18)])
                    hits.append(row[maybe].astype(np.int64) << BITS | codes[maybe])
                hits = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
                codes = (hits & ((1 << BITS) - 1)).astype(np.int32)
                at = np.searchsorted(model.coordinates, codes)
                at[at == len(model.coordinates)] = 0
                true = model.coordinates[at] == codes if len(model.coordinates) else np.zeros(len(codes), bool)
                margin = model.bias + np.bincount((hits >> BITS)[true], model.weights[at[true]], end - start)
                parts.append(1 / (1 + np.exp(-np.clip(margin, -30, 30))))
            scores = np.concatenate(parts) if parts else np.zeros(0)
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(scores)], names=[*names, "score"])

    return score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) for each row of `docs` (doc_id, text); null and empty texts get the bias alone."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scorer(model), f"doc_id {kind}, score double")


def learnable(labels: DataFrame) -> DataFrame:
    """doc_id and y (`toxic`) of the labels that may be learnt from: crc32(doc_id) mod 4 is not 2.

    A document with several labels counts as toxic if any label says so.
    """
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    return known.where(remainder("doc_id", 4) != 2)


def reject_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` (any columns) that score below the threshold; the same columns."""

    rows = docs.select(F.struct("*").alias("row"), F.col("text"))  # names of any kind stay inside

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner = _scorer(model)
        for batch in batches:
            scored = next(inner(iter([batch.select(["text"])])))
            good = pa.array(scored.column("score").to_numpy() < threshold)
            yield batch.select(["row"]).filter(good)

    return rows.mapInArrow(select, T.StructType([T.StructField("row", docs.schema)])).select("row.*")


def op3_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, learnable(table(spark, sf_dir, "labels")))
    scored = score(docs, model)
    return scored.select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
