"""Benchmark decontamination: training windows looked up in a set of benchmark word n-grams.

A window is `window` consecutive words of a benchmark item (a shorter item is one window).
One pass over the training texts takes the windows of all lengths: a position is hashed in
full only if a table of 65,536 slots holds the first two words of some benchmark window (or
the one word of an item of one word).  The hashes are looked up in the set of benchmark
windows, which is broadcast while its bytes are few (they are counted first) and joined by
shuffle otherwise.  Hits are then verified word by word, only on the texts that have any,
and mark spans of words.

All steps are DataFrame functions.  Texts are shuffled only if they have a hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.shared import free, settle, table


def _ascii_class(keep) -> str:
    """The ASCII characters that `keep` accepts, each on its own: the matcher then tests a bit, not a chain of ranges."""
    return "".join(f"\\x{i:02X}" for i in range(128) if keep(chr(i)))


#: Words are runs of digits, a-z and all characters beyond ASCII; what stands between them:
_SEPARATORS = f"[{_ascii_class(lambda c: not (c.isdigit() or c.islower()))}]+"
#: The same with A-Z among the words, for texts not yet lower-cased.
_RAW_SEPARATORS = f"[{_ascii_class(lambda c: not c.isalnum())}]+"
_RAW_WORD = f"[{_ascii_class(str.isalnum)}\\x{{80}}-\\x{{10FFFF}}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The columns that `decontaminate` adds; columns of `docs` with these names are replaced.
ADDED = ("_n_words", "_n_hit", "_hit_spans", "_items", "_contaminated")
_SLOT_BITS = 16


def _words(text: Column, separators: str) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")


def exact_words(text: Column) -> Column:
    """The normalised words: A-Z lower-cased, other letters as they are."""
    return _words(F.translate(text, _UPPER, _LOWER), _SEPARATORS)


def _word_hashes(text: Column) -> Column:
    """A hash for each word.  Words that are equal after A-Z lower-casing have equal hashes.

    lower() also folds other letters, so some unequal words share a hash; the verification
    tells them apart.
    """
    return F.transform(_words(text, _RAW_SEPARATORS), lambda w: F.xxhash64(F.lower(w)))


def _slot(hash_: Column) -> Column:
    return F.shiftrightunsigned(hash_, 64 - _SLOT_BITS).cast("int")


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, length, gram (the words, joined by spaces), h and slot (of the first two words) for each distinct window of each item."""
    words = benchmark.select("item_id", exact_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    length = F.least(F.lit(window), F.size("words"))
    starts = words.select("item_id", "words", length.alias("length"), F.explode(F.sequence(F.lit(0), F.size("words") - length)).alias("at"))
    grams = starts.select("item_id", "length", F.slice("words", F.col("at") + 1, F.col("length")).alias("gram")).distinct()
    hashed = grams.withColumn("hashes", F.transform("gram", lambda w: F.xxhash64(F.lower(w))))
    by_length = F.lit(None).cast("bigint")
    for k in range(1, window + 1):
        by_length = F.when(F.col("length") == k, F.xxhash64(*[F.get("hashes", F.lit(i)) for i in range(k)])).otherwise(by_length)
    slot = _slot(F.when(F.col("length") == 1, F.get("hashes", F.lit(0))).otherwise(F.xxhash64(F.get("hashes", F.lit(0)), F.get("hashes", F.lit(1)))))
    return hashed.select("item_id", "length", F.array_join("gram", " ").alias("gram"), by_length.alias("h"), slot.alias("slot"))


def _slots(windows: DataFrame) -> Column:
    """A byte a slot, 1 where a window of `windows` begins: a binary literal of fixed size."""
    table_ = bytearray(1 << _SLOT_BITS)
    for (slot,) in windows.select("slot").distinct().collect():
        table_[slot] = 1
    return F.lit(bytes(table_))


def _candidates(hashes: str, windows: DataFrame, lengths: list[int]) -> Column:
    """An array of (at, length, h): the windows of a text that may be among `windows`."""
    taken = lambda slots, h: F.substring(slots, _slot(h) + 1, F.lit(1)) == F.lit(b"\x01")
    singles = _slots(windows.where("length = 1")) if 1 in lengths else None
    longer = _slots(windows.where("length > 1")) if lengths[-1] > 1 else None

    def maybe(i: Column) -> Column:
        one = taken(singles, F.get(hashes, i)) if singles is not None else F.lit(False)
        return one | taken(longer, F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1))) if longer is not None else one

    places = F.when(F.size(hashes) > 0, F.sequence(F.lit(0), F.size(hashes) - 1)).otherwise(F.array().cast("array<int>"))
    of = lambda i, k: F.struct(i.alias("at"), F.lit(k).alias("length"), F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]).alias("h"))
    return F.flatten(F.transform(F.filter(places, maybe), lambda i: F.array(*[of(i, k) for k in lengths])))


def _spans(places: str) -> Column:
    """The runs of consecutive numbers of a sorted array without repeats, as (start, end), end exclusive."""
    first = F.filter(places, lambda x, i: F.coalesce(F.get(places, i - 1), F.lit(-9)) != x - 1)
    last = F.filter(places, lambda x, i: F.coalesce(F.get(places, i + 1), F.lit(-9)) != x + 1)
    return F.zip_with(first, last, lambda x, y: F.struct(x.alias("start"), (y + 1).alias("end")))


def _marked(docs: DataFrame, benchmark: DataFrame, window: int, broadcast_bytes: int) -> DataFrame:
    """row (a struct of the columns of `docs`, whatever their names) and the columns ADDED."""
    keys = [F.col("doc_id").alias("__id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("__text_hash")]
    same = ["__id", "__text_hash"]

    def on(left: DataFrame, right: DataFrame) -> Column:
        return left["__id"].eqNullSafe(right["__id"]) & (left["__text_hash"] == right["__text_hash"])

    def small(table_: DataFrame, row_bytes: Column) -> bool:
        return (table_.agg(F.sum(row_bytes)).first()[0] or 0) <= broadcast_bytes

    windows = settle(benchmark_windows(benchmark.select("item_id", "text"), window), "benchmark-windows")
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # at most `window` values
    few = small(windows, F.octet_length("gram") + F.octet_length(F.coalesce(F.col("item_id").cast("string"), F.lit(""))) + 64)
    keep = F.broadcast if few else (lambda x: x)
    if lengths:
        hashed = docs.select(*keys, _word_hashes(F.col("text")).alias("hashes"))
        at = hashed.select(*same, F.explode(_candidates("hashes", windows, lengths)).alias("w")).select(*same, "w.*")
        found = at.join(keep(windows.select("length", "h").distinct()), ["length", "h"]).select(*same, "at", "length")
    else:
        found = docs.select(*keys, F.lit(0).alias("at"), F.lit(0).alias("length")).limit(0)
    found = settle(found.distinct(), "window-hits")

    # Verification reads again only the texts with a hit.
    hit_keys = settle(found.select(*same).distinct(), "hit-texts")
    keyed = docs.select(*keys, "text")
    id_bytes = F.octet_length(F.coalesce(F.col("__id").cast("string"), F.lit(""))) + 64
    suspects = keyed.join(F.broadcast(hit_keys) if small(hit_keys, id_bytes) else hit_keys, on(keyed, hit_keys), "left_semi").dropDuplicates(same)
    suspects = suspects.select(*same, exact_words(F.col("text")).alias("words"))
    per_text = found.groupBy(*same).agg(F.collect_list(F.struct("at", "length")).alias("hits"))
    joined = suspects.join(per_text, on(suspects, per_text)).select(suspects["__id"], suspects["__text_hash"], "words", "hits")
    read = lambda x: F.struct(x["at"].alias("at"), x["length"].alias("length"), F.array_join(F.slice("words", x["at"] + 1, x["length"]), " ").alias("gram"))
    read_hits = joined.select(*same, F.explode(F.transform("hits", read)).alias("x")).select(*same, "x.*")
    verified = settle(read_hits.join(keep(windows.select("gram").distinct()), "gram", "left_semi"), "verified-hits")
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["at"], x["at"] + x["length"] - 1)))))
    spans = verified.groupBy(*same).agg(F.collect_list(F.struct("at", "length")).alias("hits")).select(*same, covered.alias("places"))
    spans = spans.select(*same, F.size("places").cast("long").alias("_n_hit"), _spans("places").alias("_hit_spans"))
    item_grams = windows.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "gram")
    occurring = verified.select(*same, "gram").distinct().join(keep(item_grams), "gram")
    items = occurring.groupBy(*same).agg(F.sort_array(F.collect_set("item")).alias("_items"))
    marks = spans.join(items, on(spans, items), "left").select(spans["__id"], spans["__text_hash"], "_n_hit", "_hit_spans", "_items")
    marks = settle(marks, "marks")
    free(windows, found, hit_keys, verified)
    mark_bytes = id_bytes + 16 * F.size("_hit_spans") + F.octet_length(F.array_join(F.coalesce("_items", F.array().cast("array<string>")), ", "))
    if small(marks, mark_bytes):
        marks = F.broadcast(marks)
    n_words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(_RAW_WORD)).cast("long")
    rows = docs.select(F.struct("*").alias("row"), n_words.alias("_n_words"), *keys)
    return rows.join(marks, on(rows, marks), "left").select(
        "row",
        "_n_words",
        F.coalesce("_n_hit", F.lit(0).cast("long")).alias("_n_hit"),
        F.coalesce("_hit_spans", F.array().cast("array<struct<start:int,end:int>>")).alias("_hit_spans"),
        F.coalesce("_items", F.array().cast("array<string>")).alias("_items"),
        F.col("_n_hit").isNotNull().alias("_contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """The columns of `docs` and, for each row, what of it stands in the benchmark.

    Added: _n_words, _n_hit (words inside any window), _hit_spans (the runs of such words,
    as places from 0, end exclusive), _items (ids of the items with an occurring window, as
    sorted strings), _contaminated.

    docs: doc_id, text and any other columns; benchmark: item_id, text.  Windows, ids of texts
    with hits and marks are broadcast up to `broadcast_bytes` each; beyond that they are
    joined by shuffle.  Null and empty texts have no words and no hits; items with a null id
    mark words but are no item.  Repeated rows each get their row; no rows give none.
    """
    return _marked(docs, benchmark, window, broadcast_bytes).select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in ADDED], *ADDED)


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of `docs` without any benchmark window; all columns as they were."""
    return _marked(docs, benchmark, window, 64 << 20).where(~F.col("_contaminated")).select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """`docs` with the words inside benchmark windows cut out of the texts.

    A text with a hit comes back as its remaining words, normalised and joined by spaces;
    other texts, and all other columns, are unchanged.
    """
    marked = _marked(docs, benchmark, window, 64 << 20)
    words, n = exact_words(F.col("row.text")), F.size("_hit_spans")
    end = lambda k: F.coalesce(F.get("_hit_spans", k - 1)["end"], F.lit(0))
    start = lambda k: F.coalesce(F.get("_hit_spans", k)["start"], F.size("__w"))
    rest = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda k: F.slice("__w", end(k) + 1, start(k) - end(k))))
    clean = F.when(F.col("_contaminated"), F.array_join(rest, " ")).otherwise(F.col("row.text"))
    columns = [F.col("row").getField(c).alias(c) if c != "text" else clean.alias(c) for c in docs.columns]
    return marked.withColumn("__w", F.when(F.col("_contaminated"), words)).select(*columns)


def op5_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        F.col("_contaminated").alias("contaminated"),
    )


OP5_SQL = r"""
with d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as words from documents),
b as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as words from benchmark),
g as (
  select distinct item_id, n, array_to_string(words[i:i + n - 1], ' ') as gram
  from (select item_id, words, least(10, len(words)) as n, unnest(range(1, len(words) - least(10, len(words)) + 2)) as i
        from b where len(words) > 0)),
lengths as (select distinct n from g),
w as (
  select doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') as gram
  from (select doc_id, words, n, unnest(range(1, len(words) - n + 2)) as i from d, lengths where len(words) >= n)),
hits as (select doc_id, w.n, i, gram, item_id from w join g using (gram) where w.n = g.n),
places as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items,
                 array_to_string(list_sort(list(distinct item_id::varchar)), ',') as ids from hits group by doc_id)
select d.doc_id, len(d.words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join places using (doc_id) left join items using (doc_id)
"""
