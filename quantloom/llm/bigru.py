"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word from both ends and labels every byte's position with
probabilities of the languages; a document's probabilities are the mean over all positions
of all its words.  It is trained here, in numpy, by backpropagation through time, on words of
a bounded sample of labelled documents.

A sequence is one word (at most PIECE bytes; a longer word is several), so equal words have
equal labels, and a task runs the network once for each distinct word that it meets.  Every
word of every text is read and counts as often as it stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import bytewords
from quantloom.llm.shared import remainder, table, unit

PIECE = 24
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Network:
    """Parameters: for each direction an input row a byte, recurrent weights; and the output layer.

    The three blocks of 3 * hidden columns are the update gate, the reset gate and the candidate.
    """

    languages: list[str]
    hidden: int = 16
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, seed: int = 1) -> Network:
        draw, h, c = np.random.default_rng(seed), self.hidden, len(self.languages)
        for way in ("f", "b"):
            self.weights[f"in_{way}"] = draw.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.weights[f"re_{way}"] = draw.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(np.float32)
        self.weights["out"] = draw.normal(0, 0.3, (2 * h, c)).astype(np.float32)
        self.weights["bias"] = np.zeros(c, dtype=np.float32)
        return self

    def _step(self, way: str, byte: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        k = self.hidden
        x, u = self.weights[f"in_{way}"][byte], h @ self.weights[f"re_{way}"]
        gates = _sigmoid(x[:, : 2 * k] + u[:, : 2 * k])
        z, r, q = gates[:, :k], gates[:, k:], u[:, 2 * k :]
        n = np.tanh(x[:, 2 * k :] + r * q)
        return n + z * (h - n), z, r, n, q

    def _states(self, x: np.ndarray, mask: np.ndarray | None, keep: bool) -> tuple[dict[str, np.ndarray], dict[str, list]]:
        """Hidden states of each direction, (time, rows, hidden); and what the backward pass needs."""
        rows, time = x.shape
        states, kept = {}, {"f": [], "b": []}
        for way, order in (("f", range(time)), ("b", range(time - 1, -1, -1))):
            h = np.zeros((rows, self.hidden), dtype=np.float32)
            out = np.zeros((time, rows, self.hidden), dtype=np.float32)
            for t in order:
                new, z, r, n, q = self._step(way, x[:, t], h)
                if mask is not None:
                    new = np.where(mask[:, t, None], new, h)
                if keep:
                    kept[way].append((t, h, z, r, n, q))
                h = out[t] = new
            states[way] = out
        return states, kept

    def positions(self, x: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """Probabilities of the languages at each position: (time, rows, languages)."""
        states, _ = self._states(x, mask, keep=False)
        k = self.hidden
        logits = states["f"] @ self.weights["out"][:k] + states["b"] @ self.weights["out"][k:] + self.weights["bias"]
        p = np.exp(logits - logits.max(-1, keepdims=True))
        return p / p.sum(-1, keepdims=True)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over the positions, and its gradient by backpropagation through time."""
        k, w = self.hidden, self.weights
        states, kept = self._states(x, mask, keep=True)
        both = np.concatenate([states["f"], states["b"]], axis=2)
        logits = both @ w["out"] + w["bias"]
        p = np.exp(logits - logits.max(-1, keepdims=True))
        p /= p.sum(-1, keepdims=True)
        on = mask.T.astype(np.float32)
        total = on.sum()
        rows = np.arange(len(y))
        loss = float(-(np.log(p[:, rows, y] + 1e-12) * on).sum() / total)
        d = p
        d[:, rows, y] -= 1
        d *= (on / total)[:, :, None]
        g = {"out": np.tensordot(both, d, ([0, 1], [0, 1])), "bias": d.sum((0, 1))}
        upper = d @ w["out"].T
        for way, part in (("f", upper[:, :, :k]), ("b", upper[:, :, k:])):
            into, recurrent = np.zeros_like(w[f"in_{way}"]), np.zeros_like(w[f"re_{way}"])
            after = np.zeros((len(y), k), dtype=np.float32)
            bytes_, deltas = [], []
            for t, h, z, r, n, q in reversed(kept[way]):
                dh = part[t] + after
                m = mask[:, t, None]
                dn_ = np.where(m, dh, 0)
                dn = dn_ * (1 - z) * (1 - n * n)
                dz = dn_ * (h - n) * z * (1 - z)
                dr = dn * q * r * (1 - r)
                delta = np.concatenate([dz, dr, dn * r], axis=1)
                recurrent += h.T @ delta
                after = np.where(m, dn_ * z, dh) + delta @ w[f"re_{way}"].T
                bytes_.append(x[:, t])
                deltas.append(np.concatenate([dz, dr, dn], axis=1))
            at, rows_ = np.concatenate(bytes_), np.concatenate(deltas)
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) != 0]))
            into[at[order][first]] = np.add.reduceat(rows_[order], first)
            g[f"in_{way}"], g[f"re_{way}"] = into, recurrent
        return loss, g

    def fit(self, words: list[bytes], labels: np.ndarray, steps: int = 900, batch: int = 256, rate: float = 0.01, seed: int = 2) -> Network:
        """Adam on random batches, each with as many words of every language as of the others."""
        draw = np.random.default_rng(seed)
        of = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        of = [(k, rows) for k, rows in enumerate(of) if len(rows)]
        first = {n: np.zeros_like(v) for n, v in self.weights.items()}
        second = {n: np.zeros_like(v) for n, v in self.weights.items()}
        for step in range(1, steps + 1):
            pick = np.concatenate([draw.choice(rows, max(1, batch // len(of))) for _, rows in of])
            x, mask = _padded([words[i] for i in pick])
            _, g = self.gradients(x, mask, labels[pick])
            now = rate * (1 - step / (steps + 1))
            for n, v in g.items():
                v = np.clip(v, -1, 1)
                first[n] += 0.1 * (v - first[n])
                second[n] += 0.001 * (v * v - second[n])
                self.weights[n] -= now * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
        return self


def _padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(w) for w in words])
    x = np.zeros((len(words), int(n.max())), dtype=np.int64)
    mask = np.arange(x.shape[1])[None, :] < n[:, None]
    x[mask] = np.frombuffer(b"".join(words), dtype=np.uint8)
    return x, mask


def _pieces(words: bytewords.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and text of the words' pieces of at most PIECE bytes."""
    n = words.ends - words.starts
    several = (n + PIECE - 1) // PIECE
    row = words.row
    if (several <= 1).all():
        return words.starts, n, row
    which = np.repeat(np.arange(len(n)), several)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(several) - several, several)
    starts = words.starts[which] + nth * PIECE
    return starts, np.minimum(words.ends[which] - starts, PIECE), row[which]


class Reader:
    """Runs a network over texts, once a distinct word; `hold` words' results are kept between slices."""

    def __init__(self, network: Network, hold: int = 400_000):
        self.network, self.hold = network, hold
        self.keys, self.sums = np.zeros(0, np.uint64), np.zeros((0, len(network.languages)), np.float32)

    def _learn(self, keys: np.ndarray, body: np.ndarray, starts: np.ndarray, n: np.ndarray) -> None:
        sums = np.zeros((len(keys), self.sums.shape[1]), dtype=np.float32)
        order = np.argsort(n, kind="stable")
        cuts = np.flatnonzero(np.diff(n[order])) + 1
        for rows in np.split(order, cuts) if len(order) else []:
            for low in range(0, len(rows), 8192):
                part = rows[low : low + 8192]
                x = bytewords.FOLD[body[starts[part][:, None] + np.arange(n[part[0]])]]
                sums[part] = self.network.positions(x).sum(0)
        every = np.concatenate([self.keys, keys])
        at = np.argsort(every, kind="stable")
        self.keys, self.sums = every[at], np.concatenate([self.sums, sums])[at]

    def read(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The mean probabilities of each text of a run; zeros without words."""
        words = bytewords.Words(body, offsets)
        starts, n, row = _pieces(words)
        words.starts, words.ends = starts, starts + n
        h = words.hashes()
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.hold:
            self.keys, self.sums = self.keys[:0], self.sums[:0]
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), dtype=bool)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != keys
        if new.any():
            self._learn(keys[new], body, starts[first[new]], n[first[new]])
        sums = self.sums[np.searchsorted(self.keys, keys)]
        out = np.zeros((len(offsets) - 1, sums.shape[1]))
        for k in range(sums.shape[1]):
            out[:, k] = np.bincount(row, sums[back, k], len(out))
        return out / np.maximum(np.bincount(row, n, len(out)), 1)[:, None]


def spread(words: list[bytes], most: int) -> list[bytes]:
    """At most `most` of the words, evenly over all of them."""
    return words if len(words) <= most else [words[i * len(words) // most] for i in range(most)]


def train(docs: DataFrame, per_language: int = 1000, words_per_doc: int = 60, steps: int = 900) -> Network | None:
    """A network from `docs` (doc_id, text, lang); rows without lang or words teach nothing.

    per_language: about so many documents of each language are taken, by a hash of the id,
    and words_per_doc of each one's words, evenly over the whole text.  Without any rows
    there is no network.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    count = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not count:
        return None
    chance = F.lit(0.0)
    for lang, n in count.items():
        chance = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(chance)
    sample = known.where(unit(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("lang")) < chance)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = [], []
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                words = text.as_py().encode().split()
                texts.append(b" ".join(spread(words, words_per_doc)))
                langs.append(lang.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(langs, pa.string())], names=["words", "lang"])

    got = sample.select("text", "lang").mapInArrow(take, "words binary, lang string").orderBy(F.xxhash64("words", "lang")).toArrow()
    languages = sorted(set(got["lang"].to_pylist()))
    words, labels = [], []
    for line, lang in zip(got["words"].to_pylist(), got["lang"].to_pylist(), strict=True):
        for w in bytes(bytewords.FOLD[np.frombuffer(line, np.uint8)]).split():
            words += [w[i : i + PIECE] for i in range(0, len(w), PIECE)]
            labels += [languages.index(lang)] * (len(words) - len(labels))
    if not words:
        return None
    return Network(languages).start().fit(words, np.array(labels), steps=steps)


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, lang_pred and score (the pooled probability of lang_pred) for each row of `docs` (doc_id, text).

    `und` with score 0 for null texts, texts without a letter, and without a network.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(network) if network is not None else None
        for batch in batches:
            for start, end, body, offsets in bytewords.slices(batch.column("text")):
                rows = end - start
                langs, scores = ["und"] * rows, np.zeros(rows)
                if reader is not None:
                    p = reader.read(body, offsets)
                    best = p.argmax(1)
                    letters = np.concatenate([[0], np.cumsum(_LETTER[body])])
                    plain = letters[offsets[1:]] > letters[offsets[:-1]]
                    for i in range(rows):
                        if plain[i] or any(c.isalpha() for c in bytes(body[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace")):
                            langs[i], scores[i] = network.languages[best[i]], p[i, best[i]]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, rows), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op7_bigru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    network = train(docs.where(remainder("doc_id", 5) != 0))
    return identify(docs, network).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
