"""Small tables with the cases that every operator has to take."""

from __future__ import annotations

import random
import re

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(n: int, seed: int, words=WORDS) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(words) for _ in range(n))


def space_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", fold(text))


def fold(text: str | None) -> str:
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def edge_rows() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): nulls, empty, one word, very long, repeated rows, ties, odd letters."""
    long = prose(30_000, 1)
    same = prose(80, 2)
    rows = [
        (1, None, "en", "a", None),
        (2, "", None, None, 0),
        (3, "   \n\t ", "en", "a", 6),
        (4, "single", "en", "b", 6),
        (5, long, "en", "a", len(long)),
        (6, same, "en", "a", len(same)),
        (7, same, "de", "b", len(same)),
        (7, same, "de", "b", len(same)),
        (8, same.upper(), "en", None, len(same)),
        (9, "Ünïcödé ΑΣ Straße K elvin İ x y 東京 \U0001f600 z", "de", "c", 40),
        (10, "x" * 50_000, "en", "a", 50_000),
        (11, "@@@ +++ 1.2.3.4.5 " * 50, "en", "c", 900),
        (None, same, "en", "a", len(same)),
        (None, None, None, None, None),
    ]
    return rows + [(100 + i, prose(60 + i % 40, 1000 + i), ("en", "de", "fr")[i % 3], "abc"[i % 3], 0) for i in range(60)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with names that operators use inside.
CLASHES = "_n_words, _n_hit, _hit_spans, _items, _contaminated, __text_hash, row, __nth, set, text_hash, hub, salt, hits, words, key, size, node, component, bucket, range, y, score, kept, n_words, _words, __id, __source, h, at, bands, __last, __upto, __copy, __row, __hr_words, __hr_windows, __hr_host, __hr_row, __hr_of, group, g, i, n, digest, tie, parent, run, path, task, queue, start, before, ids, block, kind, units"


def edge_docs(spark, clashes: bool = True):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(edge_rows(), SCHEMA)
    if not clashes:
        return docs
    quoted = F.struct(F.lit(2).alias("a b"), F.lit(3).alias("c`d"))
    return docs.withColumns({c: F.lit(1) for c in CLASHES.split(", ")}).select("*", quoted.alias("has a space"), F.lit(4).alias("e`f.g"))


def kept_whole(df) -> bool:
    """Whether the columns that `edge_docs` adds still hold what they held."""
    wrong = df.where(" or ".join(f"coalesce(`{c}`, 0) <> 1" for c in CLASHES.split(", ")) + " or `has a space`.`a b` <> 2 or `has a space`.`c``d` <> 3 or `e``f.g` <> 4")
    return wrong.count() == 0
