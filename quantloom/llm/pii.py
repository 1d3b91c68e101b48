"""Personal data: candidate spans, judged by gradient-boosted trees.

Base spans (e-mail, IPv4, card and phone numbers in their plain formats) are found by
pattern and check and always kept.  High-recall generators propose further spans, which may
overlap, in looser formats ("name at host dot org", numbers with other separators or none).
Boosted trees judge each candidate by its format and by the words around it; a threshold per
kind, on calibrated probabilities, selects what is redacted besides.

There are no hand labels, so the trees learn from the corpus itself.  Positives are base
spans and what the generators propose for loosened copies of them in their own context
(separators changed, prefix dropped, "@" and "." spelled out).  Negatives are candidates whose
plain form fails the base checks (Luhn, ranges, lengths), addresses whose last part is no
top-level domain, dates, versions and other numbered things, and bare numbers.  A candidate whose plain form passes may
well be personal data: it teaches nothing, unless a word like "version" stands beside it.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.shared import free, settle, table, unit
from quantloom.llm.trees import Boosted

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits begins: a later start fails as the first did.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Generators of looser candidates, with the kind that they propose.
_LOOSE = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+(?: ?[\[(]at[\])] ?| at |@)[A-Za-z0-9-]++(?:(?: ?[\[(]dot[\])] ?| dot |\.)[A-Za-z0-9-]++)+")),
    ("ip", re.compile(r"(?<![0-9])[0-9]{1,3}(?:[.,:_-]| ?[\[(](?:\.|dot)[\])] ?)[0-9]{1,3}(?:(?:[.,:_-]| ?[\[(](?:\.|dot)[\])] ?)[0-9]{1,3}){2}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20./_-]{0,2}[0-9]{2,6}){2,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9])(?:\+|00|\()?[0-9]{1,4}[)]?(?:[\x20./()-]{1,2}[0-9]{2,5}){2,5}(?![0-9])")),
)


#: Common top-level domains besides two-letter ones (fixed values).
_DOMAINS = frozenset("com org net edu gov mil int info biz name pro dev app io ai example test invalid local".split())
#: Words right before a number that is no personal data.
_NUMBERED = re.compile(r"(version|licen[cs]e|section|chapter|page|isbn|issn|rfc|article|figure|fig\.?|table|no\.?|nr\.?|§)\s*[:#]?\s*\Z", re.I)


_DATE = re.compile(r"(?:(?:1[6-9]|20)[0-9]{2}([-./ ])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-./ ])[0-9]{1,2}\2(?:1[6-9]|20)[0-9]{2})(?![0-9]).*")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of the plain formats: leftmost, non-overlapping per kind."""
    out: list[tuple[int, int, int]] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if not _DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) that the generators propose; they may overlap."""
    digits, at = _DIGIT.search(text) is not None, any(x in text for x in ("@", " at ", "at)", "at]"))
    out = []
    for kind, pattern in _LOOSE:
        if at if kind == "email" else digits:
            out += [(KINDS.index(kind), m.start(), m.end()) for m in pattern.finditer(text)]
    return out


#: Words near a number or an address that say what it is, in the languages of the corpus.
_CUES = (
    re.compile(r"mail|contact|correo|courriel|write|schreib", re.I),
    re.compile(r"\bip\b|host|server|addr", re.I),
    re.compile(r"card|visa|karte|carte|tarjeta|iban|konto", re.I),
    re.compile(r"phone|tel|call|fax|mobil|llam|appel", re.I),
    re.compile(r"version|licen[cs]e|\bv\b|section|chapter|page|isbn|§", re.I),
    re.compile(r"token|password|hash|key|secret|\bid\b", re.I),
)


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context of a span; nothing here tells where in the text it stands."""
    s = text[start:end]
    digits = "".join(c for c in s if "0" <= c <= "9")
    groups = re.findall(r"[0-9]+", s)
    around = text[max(0, start - 40) : start] + " " + text[end : end + 40]
    before, after = text[start - 1 : start] or " ", text[end : end + 1] or " "
    return [
        kind,
        len(s),
        len(digits),
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        float(sum(c.isalpha() for c in s)) / len(s),
        len(set(re.findall(r"[^A-Za-z0-9]", s))),
        float("@" in s or " at " in s or "at)" in s or "at]" in s),
        float(s.count(".") + s.count(" dot ")),
        float(s[0] == "+" or s.startswith("00")),
        float("(" in s),
        float(luhn(digits)) if len(digits) >= 12 else -1.0,
        float(max((int(g[:6]) for g in groups), default=0) <= 255),
        float(bool(_NUMBERED.search(text[max(0, start - 24) : start]))),
        float(bool(_DATE.match(text, start, end))),
        float(before.isalnum() or before in "=/#_"),
        float(after.isalnum() or after in "=/_"),
        *[float(bool(c.search(around))) for c in _CUES],
    ]


def _loosen(kind: int, s: str, k: int) -> str:
    """One of a few looser spellings of a base span."""
    if kind == 0:
        user, host = s.split("@", 1)
        return (f"{user} at {host}", f"{user}(at){host.replace('.', '(dot)')}", f"{user} at {host.replace('.', ' dot ')}")[k % 3]
    if kind == 1:
        return (s.replace(".", "[.]"), s.replace(".", "-"), s.replace(".", "(dot)"))[k % 3]
    digits = "".join(c for c in s if c.isdigit())
    if kind == 2:
        return (".".join(digits[i : i + 4] for i in range(0, len(digits), 4)), "/".join(digits[i : i + 4] for i in range(0, len(digits), 4)), "  ".join(digits[i : i + 4] for i in range(0, len(digits), 4)))[k % 3]
    tail = [digits[-10:-7], digits[-7:-4], digits[-4:]]
    return ("-".join(tail), f"({tail[0]}) {tail[1]}-{tail[2]}", "00" + digits[:-10] + " " + " ".join(tail))[k % 3]


def apart(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of `spans` that overlap none of `base`: by binary search over sorted starts."""
    ordered = sorted(base, key=lambda x: x[1])
    starts, upto = [s for _, s, _ in ordered], []
    for _, _, e in ordered:
        upto.append(max(e, upto[-1] if upto else 0))
    free = []
    for x in spans:
        k = bisect.bisect_left(starts, x[2])  # those before it begin before x ends
        if not k or upto[k - 1] <= x[1]:
            free.append(x)
    return free


def plain_form(kind: int, s: str) -> str:
    """A candidate with its separators as the plain format has them."""
    if kind == 0:
        s = re.sub(r" ?[\[(]at[\])] ?| at ", "@", s)
        return re.sub(r" ?[\[(]dot[\])] ?| dot ", ".", s)
    if kind == 1:
        return ".".join(re.findall(r"[0-9]+", s))
    return ("" if kind == 2 else "+") + "".join(re.findall(r"[0-9]", s))


def unsure(text: str, kind: int, start: int, end: int) -> bool:
    """A candidate that may be personal data: its plain form passes the base checks, and nothing beside it denies it."""
    s = plain_form(kind, text[start:end])
    if (kind, 0, len(s)) not in base_spans(s):
        return False
    if kind == 0:
        top = s.rpartition(".")[2].lower()
        return (len(top) == 2 and top.isalpha()) or top in _DOMAINS
    return not (_NUMBERED.search(text[max(0, start - 24) : start]) or _DATE.match(text, start, end))


def examples(text: str) -> list[tuple[list[float], float]]:
    """Training rows of one text: (features, label)."""
    out = []
    base = base_spans(text)
    for n, (kind, start, end) in enumerate(base):
        out.append((features(text, kind, start, end), 1.0))
        loose, low = _loosen(kind, text[start:end], n), max(0, start - 60)
        near, span = text[low:start] + loose + text[end : end + 60], (kind, start - low, start - low + len(loose))
        if span in candidates(near):  # as it is served, or not at all
            out.append((features(near, *span), 1.0))
    found = apart(candidates(text), base)
    # Bare numbers, versions and dates are looked at as cards and as phone numbers in turn.
    bare = [(2 + n % 2, m.start(), m.end()) for n, m in enumerate(re.finditer(r"(?<![0-9A-Za-z])[0-9][0-9.,/-]*", text))]
    for span in found + apart(bare, base + found):
        if not unsure(text, *span):
            out.append((features(text, *span), 0.0))
    return out


@dataclass(frozen=True)
class Detector:
    """Boosted trees and a threshold a kind, on calibrated probabilities."""

    trees: Boosted | None
    thresholds: tuple[float, ...]

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans, and the spans that the trees add: by falling probability, none overlapping another or a base span."""
        base = base_spans(text)
        if self.trees is None:
            return base, []
        loose = apart(candidates(text), base)
        if not loose:
            return base, []
        p = self.trees.probability(np.array([features(text, *c) for c in loose]))
        added: list[tuple[int, int, int]] = []  # sorted by start; none overlaps another
        for i in np.argsort(-p, kind="stable"):
            kind, start, end = loose[i]
            if p[i] < self.thresholds[kind]:
                continue
            at = bisect.bisect_left(added, start, key=lambda x: x[1])
            if (at == len(added) or added[at][1] >= end) and (not at or added[at - 1][2] <= start):
                added.insert(at, loose[i])
        return base, added


def train(docs: DataFrame, texts: int = 20_000, rows: int = 40_000, precision: float = 0.98) -> Detector:
    """A detector from about `texts` texts (chosen by a hash of the id, a null one as empty) and their candidates.

    At most rows / 2 of each label are taken, by a hash of id and place; rows of one text and
    id are repeated as often as they stand, and ties in the hash are broken by the features.
    Each kind's threshold is the least at which `precision` holds on the calibration third.
    Without positives or without negatives there are no trees, and only base spans are found.
    """
    count = docs.count()
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    sample = docs.where(unit(key, F.lit("pii")) < min(1.0, texts / max(count, 1))).select(key.alias("key"), "text")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                got = examples(text.as_py() or "")
                columns = [pa.array([key] * len(got), pa.string()), pa.array(range(len(got)), pa.int64()), pa.array([r[0] for r in got], pa.list_(pa.float64())), pa.array([r[1] for r in got], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "nth", "x", "y"])

    known = settle(sample.mapInArrow(gather, "key string, nth long, x array<double>, y double"), "pii-examples")
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("key", "nth"), "x").limit(rows // 2).select("x", "y").toArrow() for y in (0, 1)]
    free(known)
    got = pa.concat_tables(parts)
    if not got.num_rows:
        return Detector(None, (1.0,) * 4)
    x, y = np.array(got["x"].to_pylist()), got["y"].to_numpy()
    if y.min() == y.max():
        return Detector(None, (1.0,) * 4)
    held = np.arange(len(y)) % 3 == 0  # of each label, as the rows of one follow the other's
    trees = Boosted().fit(x, y, held=held)
    p, hy, hk = trees.probability(x[held]), y[held], x[held][:, 0]
    thresholds = []
    for kind in range(4):
        pk, yk = p[hk == kind], hy[hk == kind]
        order = np.argsort(-pk)
        good = np.cumsum(yk[order]) / np.arange(1, len(yk) + 1) >= precision if len(yk) else np.zeros(0, bool)
        thresholds.append(float(max(pk[order][np.flatnonzero(good).max()], 0.5)) if good.any() else 1.1)
    return Detector(trees, tuple(thresholds))


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find(docs: DataFrame, detector: Detector) -> DataFrame:
    """doc_id, base and added: the spans of each text, as "kind:start:end" in code points, joined by commas.

    Null and empty texts have none.  Repeated rows each get their row.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, added = [], []
            for t in batch.column("text"):
                b, a = detector.spans(t.as_py() or "")
                base.append(_written(b))
                added.append(_written(a))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, pa.string()), pa.array(added, pa.string())], names=["doc_id", "base", "added"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, base string, added string")


def redact(docs: DataFrame, detector: Detector) -> DataFrame:
    """`docs` with every span of the text replaced by its kind in square brackets; the same columns, null stays null."""
    at = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        base, added = detector.spans(text)
        out, upto = [], 0
        for k, s, e in sorted(base + added, key=lambda x: x[1:]):
            if s >= upto:
                out += [text[upto:s], f"[{KINDS[k]}]"]
            upto = max(upto, e)
        return "".join(out) + text[upto:]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            fields = row.flatten()
            fields[at] = pa.array([clean(t.as_py()) for t in fields[at]], pa.string())
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, fields=list(row.type))], names=["row"])

    rows = docs.select(F.struct("*").alias("row"))  # names of any kind stay inside
    return rows.mapInArrow(scan, T.StructType([T.StructField("row", docs.schema)])).select("row.*")


def op2_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, train(docs))
    every = F.filter(F.concat(F.split("base", ","), F.split("added", ",")), lambda s: s != "")
    order = lambda s: F.struct(
        F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.split_part(s, F.lit(":"), F.lit(1))).alias("k"), F.split_part(s, F.lit(":"), F.lit(2)).cast("int").alias("start"), s.alias("s")
    )
    number = lambda k: F.size(F.filter(F.split("base", ","), lambda s: s.startswith(f"{k}:"))).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[number(k) for k in KINDS],
        F.sha2(F.col("base"), 256).alias("base_sha256"),
        F.array_join(F.transform(F.sort_array(F.transform(every, order)), lambda x: x["s"]), ",").alias("spans"),
    )
