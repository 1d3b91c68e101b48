"""Secret scans: a random forest that removes false positives from high-recall findings.

A generator proposes every token that could be a credential: long ones with digits or mixed
case, and any value assigned to a name with a word like "password" in it.  The forest judges a finding by its
length, its character transitions (classes, and a transition model of ordinary words),
its dictionary coverage, its path and the words beside it.  It is trained from labelled
findings; where none are given, rules of well-known formats label those of the corpus that
they are sure of.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import bytewords
from quantloom.llm.shared import settle, table
from quantloom.llm.trees import Forest

#: Words that a secret is assigned to, or that stand before one.
KEYWORDS = ("password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "access_key", "secret_key", "auth", "bearer", "credential", "private_key")
#: Words that stand beside hashes and numbers that are no secrets.
HARMLESS = re.compile(r"sha|md5|commit|checksum|digest|version|isbn|licen[cs]e|uuid|example|sample|test|mail|phone", re.I)
_PATH_TEST = re.compile(r"test|example|sample|mock|fixture|docs?/", re.I)
_PATH_CONF = re.compile(r"\.(env|ya?ml|json|toml|ini|cfg|conf|properties|pem|tf)$", re.I)

_SPLIT = np.zeros(256, dtype=bool)
_SPLIT[[*range(0, 33), *b"\"'`=:,;()<>[]{}|"]] = True
_DIGIT, _UPPER, _LOWER = (np.zeros(256, dtype=np.int64) for _ in range(3))
_DIGIT[48:58], _UPPER[65:91], _LOWER[97:123] = 1, 1, 1

#: Formats whose findings the seed rules call true.
_SURE = (
    re.compile(r"AKIA[A-Z0-9]{16}"),
    re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
    re.compile(r"sk-[A-Za-z0-9]{20,}"),
    re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
)
_HEX = re.compile(r"[0-9a-f]{16,64}")
#: Formats whose findings they call false; each is matched in time linear in the token.
_NEVER = (
    re.compile(r"[^@]++@(?=[^@]++\Z)[^@]+\.[^@]+"),
    re.compile(r"[0-9+().,/%-]+"),
    re.compile(r"(?=[A-Za-z_]++\Z)[A-Za-z]*(example|changeme|placeholder|xxxx|your)[A-Za-z_]*", re.I),
    re.compile(r"(https?://|www\.|/)\S+"),
    re.compile(r"(.)\1{7,}.*"),
)


#: Parts of a name: cut at signs, digits and changes of case.
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_LONG = tuple(k.replace("_", "") for k in KEYWORDS if k not in ("key", "auth", "token"))
_NAME = re.compile(r"[^\x00-\x20\"'`=:,;()<>\[\]{}|]+")


def names_secret(name: str) -> int:
    """2 if `name` is or ends with a keyword (a last part "key" alone does not do), 1 if it has one elsewhere, 0 without any.

    DB_PASSWORD, client-secret, dbPassword, dbpassword and aws_secret_access_key end with one.
    """
    parts = [p.lower().removesuffix("s") for p in _PART.findall(name)]
    if not parts:
        return 0
    if name.lower() in KEYWORDS or "_".join(parts[-2:]) in KEYWORDS or (parts[-1] in KEYWORDS and parts[-1] != "key") or parts[-1].endswith(_LONG):
        return 2
    return int(any(p in KEYWORDS or p.endswith(_LONG) for p in parts))


def findings(body: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, str, str, bool]]:
    """(text, start, end, before, after, assigned) of each candidate token; byte offsets within its text.

    before, after: up to 40 bytes beside it.
    """
    words = bytewords.Words(body, offsets, _SPLIT)
    if not len(words.starts):
        return
    count = lambda flag: np.add.reduceat(np.append(flag[body], 0), np.stack([words.starts, words.ends], 1).ravel())[::2]
    n, digits, upper, lower = words.ends - words.starts, count(_DIGIT), count(_UPPER), count(_LOWER)
    row = words.row
    assigns = np.append(0, np.cumsum((body == ord("=")) | (body == ord(":"))))
    assigned = np.zeros(len(n), dtype=bool)
    assigned[1:] = (assigns[words.starts[1:]] > assigns[words.ends[:-1]]) & (row[1:] == row[:-1]) & (words.starts[1:] - words.ends[:-1] <= 5) & (n[1:] >= 6)
    for i in np.flatnonzero(assigned):
        assigned[i] = names_secret(bytes(body[words.starts[i - 1] : words.ends[i - 1]]).decode("utf-8", "replace")) > 0
    mixed = ((digits >= 1) & (n >= 12)) | ((upper >= 3) & (lower >= 3) & (n >= 16))
    for i in np.flatnonzero(mixed | assigned):
        low, high = offsets[row[i]], offsets[row[i] + 1]
        s, e = words.starts[i], words.ends[i]
        text = lambda a, b: bytes(body[a:b]).decode("utf-8", "replace")
        yield int(row[i]), int(s - low), int(e - low), text(max(low, s - 40), s), text(e, min(high, e + 40)), bool(assigned[i])


@dataclass(frozen=True)
class Background:
    """What ordinary words look like: log probabilities of character transitions, and frequent words."""

    transitions: np.ndarray
    dictionary: frozenset[str]

    @staticmethod
    def of(pairs: dict[str, int], words: Iterable[str] = ()) -> Background:
        """From the counts of pairs of letters that stand together, and the frequent words."""
        table_ = np.full((64, 64), 0.5)
        for pair, n in pairs.items():
            table_[tuple(_codes(pair))] += n
        return Background(np.log(table_ / table_.sum(1, keepdims=True)), frozenset(w for w in words if len(w) >= 3))

    def coverage(self, s: str) -> float:
        """The part of `s` that dictionary words cover, the longest first at each place."""
        s, i, covered, longest = s.lower(), 0, 0, max(map(len, self.dictionary), default=0)
        while i < len(s):
            for k in range(min(longest, len(s) - i), 2, -1):
                if s[i : i + k] in self.dictionary:
                    covered += k
                    i += k
                    break
            else:
                i += 1
        return covered / max(len(s), 1)


_CODE = np.append(np.full(128, 62), 63)
_CODE[97:123], _CODE[48:58], _CODE[65:91] = np.arange(26), np.arange(26, 36), np.arange(36, 62)


def _codes(s: str) -> np.ndarray:
    """0-25 letters, 26-35 digits, 36-61 capitals, 62 signs, 63 all else."""
    return _CODE[np.minimum(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


def features(token: str, before: str, after: str, assigned: bool, path: str | None, background: Background) -> list[float]:
    codes = _codes(token)
    kind = np.digitize(codes, [26, 36, 62, 63])
    n = len(codes)
    change = kind[1:] != kind[:-1] if n > 1 else np.zeros(0, bool)
    p = np.bincount(codes, minlength=64) / n
    named = [names_secret(w) for w in re.findall(r"\w+", before)[-3:]]
    path = path or ""
    return [
        n,
        float(np.log(n)),
        float(change.mean()) if n > 1 else 0.0,
        *[float((kind == k).mean()) for k in range(5)],
        float(background.transitions[codes[:-1], codes[1:]].mean()) if n > 1 else 0.0,
        float(-(p[p > 0] * np.log2(p[p > 0])).sum()),
        float(p.max()),
        background.coverage(token),
        float(bool(_HEX.fullmatch(token))),
        float(assigned),
        float(bool(named) and named[-1] > 0),
        float(any(named)),
        float(bool(HARMLESS.search(before[-24:]))),
        float(before[-1:] in "\"'`" if before else 0),
        float(after[:1] in "\"'`" if after else 0),
        float(bool(_PATH_TEST.search(path))),
        float(bool(_PATH_CONF.search(path))),
        float(path.count("/")),
    ]


def seed_label(token: str, before: str, assigned: bool) -> int | None:
    """1, 0, or None where the rules are not sure."""
    if any(r.fullmatch(token) for r in _NEVER):
        return 0
    if any(r.fullmatch(token) for r in _SURE):
        return 1
    if _HEX.fullmatch(token):
        if assigned:
            return 1 if names_secret((_NAME.findall(before) or [""])[-1]) == 2 else None
        return 0 if HARMLESS.search(before[-24:]) else None
    return 0 if token.isalpha() and not assigned else None


@dataclass(frozen=True)
class Scanner:
    """Scores findings by the forest or, without one, by what the seed rules call true."""

    forest: Forest | None
    background: Background

    def judge(self, rows: list[tuple[str, str, str, bool, str | None]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        if self.forest is None:
            return np.array([float(seed_label(token, before, assigned) == 1) for token, before, _, assigned, _ in rows])
        return self.forest.probability(np.array([features(*r, self.background) for r in rows]))


_EXAMPLE = "key binary, label int, x array<double>"


def _scan(docs: DataFrame, path: str, judge: Scanner | None = None, seeds: Background | None = None) -> DataFrame:
    """The findings of `docs`: doc_id, start, end (code points), token, before, after, assigned, path and score.

    With `seeds`, the examples (key, label, x) of those that the seed rules label, instead.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, paths = batch.column("doc_id"), batch.column("path")
            for start, _, body, offsets in bytewords.slices(batch.column("text")):
                found, rows = list(findings(body, offsets)), []
                for r, s, e, before, after, assigned in found:
                    text = body[offsets[r] : offsets[r + 1]]
                    place = int((text[:s] & 0xC0 != 0x80).sum())
                    token = bytes(text[s:e]).decode("utf-8", "replace")
                    rows.append((start + r, place, place + len(token), token, before, after, assigned, paths[start + r].as_py()))
                if seeds:
                    labels = [seed_label(x[3], x[4], x[6]) for x in rows]
                    yield _examples([(*x[3:], y) for x, y in zip(rows, labels, strict=True) if y is not None], seeds)
                    continue
                at = [x[0] for x in rows]
                score = judge.judge([x[3:] for x in rows]) if judge else np.zeros(len(rows))
                columns = [ids.take(pa.array(at, pa.int64())), *[pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()), 1)], pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "end", "token", "before", "after", "assigned", "path", "score"])

    fields = f"doc_id {kind}, start long, end long, token string, before string, after string, assigned boolean, path string, score double"
    return docs.select("doc_id", "text", F.col(path).cast("string").alias("path")).mapInArrow(run, _EXAMPLE if seeds else fields)


def background(docs: DataFrame, frequent: int = 5000) -> Background:
    """From the words, of 2 to 30 letters, of all texts; the `frequent` most frequent ones are the dictionary."""
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("w")).where("length(w) between 2 and 30")
    counts = settle(words.groupBy("w").count(), "words")
    pair = F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring("w", i, F.lit(2)))
    pairs = counts.select(F.explode(pair).alias("pair"), "count").groupBy("pair").agg(F.sum("count"))
    top = counts.orderBy(F.desc("count"), "w").limit(frequent)
    return Background.of({r[0]: r[1] for r in pairs.collect()}, [r["w"] for r in top.collect()])


def _examples(rows: list[tuple], base: Background) -> pa.RecordBatch:
    """key (a digest of token, before and after), label and features of (token, before, after, assigned, path, label)."""
    keys = [hashlib.blake2b("\0".join(r[:3]).encode("utf-8", "surrogatepass"), digest_size=16).digest() for r in rows]
    x = [features(*r[:5], base) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([int(r[5]) for r in rows], pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["key", "label", "x"])


def train(docs: DataFrame, path: str = "source", labelled: DataFrame | None = None, most: int = 20_000) -> Scanner:
    """A scanner from labelled findings (token, before, after, assigned, path, label: 0 or 1).

    Without `labelled`, the findings of all `docs` that the seed rules are sure of.  Findings are
    labelled in the tasks; those of equal token, before and after count once (with the lesser
    label where they differ), and at most most / 2 of each label are taken, by a hash of the
    three.  Where a label has none, the scanner keeps what the seed rules call true.
    """
    base = background(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("token", "before", "after", "assigned", "path", "label")), strict=True)
            yield _examples([r for r in rows if r[5] is not None], base)

    if labelled is None:
        known = _scan(docs, path, seeds=base)
    else:
        columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("token", "before", "after")]
        known = labelled.where("token <> ''").select(*columns, F.coalesce("assigned", F.lit(False)).alias("assigned"), F.col("path").cast("string"), F.col("label").cast("int")).mapInArrow(run, _EXAMPLE)
    once = settle(known.groupBy("key").agg(F.min(F.struct("label", "x")).alias("v")).select("key", "v.label", "v.x"), "secrets")
    rows = [r for y in (0, 1) for r in once.where(F.col("label") == y).orderBy("key").limit(most // 2).collect()]
    y = np.array([r["label"] for r in rows], float)
    return Scanner(Forest().fit(np.array([r["x"] for r in rows]), y) if len(set(y)) == 2 else None, base)


def scan(docs: DataFrame, scanner: Scanner, path: str = "source", keep: float = 0.5) -> DataFrame:
    """A row a finding: doc_id, start, end (code points, end exclusive), token, path, score, kept (score >= keep).

    docs: doc_id, text and the path column.  Null and empty texts have no findings; a null
    path is an empty one; repeated rows have theirs again.  A token may be of any length.
    """
    return _scan(docs, path, scanner).select("doc_id", "start", "end", "token", "path", "score", (F.col("score") >= keep).alias("kept"))


def op1_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return scan(docs, train(docs))
