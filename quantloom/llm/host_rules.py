"""Host-level quality rules: failure rates of hosts, shrunk by an empirical beta prior.

Every text is measured once; each rule is a test of the measures.  Rule failures are summed
by host.  Over all hosts the failure rates of a rule give the two parameters of a beta
prior (method of moments: hosts weighted by their documents, the binomial noise of their
counts taken off), and a host's rate is its posterior mean, so that a small host needs more
evidence than a large one.  A host whose
shrunk rate of any rule reaches `reject` is rejected with its documents.

All steps are DataFrame functions.  No text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.shared import settle, table

_SPACE = r"[\x20\x09-\x0D]+"


#: The columns that the operators here add, measures first; columns of the input with these names are replaced, others stay.
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rejected", "kept")


def measures(text: Column) -> dict[str, Column]:
    """Columns that `with_measures` adds, from the text alone (null: as empty)."""
    text = F.coalesce(text, F.lit(""))
    return {
        "__hr_words": F.filter(F.split(text, _SPACE), lambda w: w != ""),
        "__hr_n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "__hr_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    }


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without its text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; other columns of any name stay."""
    return _spread(_measured(docs, text), [])


def _measured(docs: DataFrame, text: str, **more: Column) -> DataFrame:
    """The measures, `more`, and __hr_row, a struct of the caller's columns."""
    rest = [docs[_quoted(c)] for c in docs.columns if c != text and c not in ADDED]
    packed = F.struct(*rest) if rest else F.lit(None).cast("struct<none: int>")
    docs = docs.select(packed.alias("__hr_row"), docs[_quoted(text)].alias("__hr_text"), *[c.alias(k) for k, c in more.items()])
    raw = docs.withColumns(measures(F.col("__hr_text")))
    at = F.when(F.size("__hr_words") >= 3, F.sequence(F.lit(0), F.size("__hr_words") - 3)).otherwise(F.array().cast("array<int>"))
    windows = raw.withColumns(
        {
            "__hr_chars": F.aggregate("__hr_words", F.lit(0), lambda n, w: n + F.length(w)),
            "__hr_hashes": F.transform("__hr_words", lambda w: F.xxhash64(w)),
        }
    ).withColumn("__hr_windows", F.transform(at, lambda i: F.xxhash64(F.get("__hr_hashes", i), F.get("__hr_hashes", i + 1), F.get("__hr_hashes", i + 2))))
    # Equal windows stand side by side once sorted; each then knows from its neighbours if it is repeated.
    ordered = windows.withColumn(
        "__hr_sorted",
        F.when(
            F.size(F.array_distinct("__hr_windows")) < F.size("__hr_windows"),
            F.sort_array(F.transform("__hr_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    repeated = F.filter(
        "__hr_sorted", lambda x, k: (F.get("__hr_sorted", k - 1)["h"] == x["h"]) | (F.get("__hr_sorted", k + 1)["h"] == x["h"])
    )
    places = F.array_distinct(F.flatten(F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return ordered.select(
        *[c for c in docs.columns if c != "__hr_text"],
        F.size("__hr_words").cast("long").alias("n_words"),
        F.col("__hr_chars").cast("long").alias("word_chars"),
        F.col("__hr_n_symbols").alias("n_symbols"),
        (F.size("__hr_lines") - F.size(F.array_distinct("__hr_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("__hr_sorted").isNull(), 0).otherwise(F.size(places)).cast("long").alias("n_repeat_words"),
    )


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def _spread(measured: DataFrame, more: list[str]) -> DataFrame:
    """The caller's columns, the measures and `more`."""
    own = [] if measured.schema["__hr_row"].dataType.names == ["none"] else ["__hr_row.*"]
    return measured.select(*own, *ADDED[:5], *more)


def rules() -> dict[str, Column]:
    """Name and test (true: failed) of each rule, on the measures."""
    n = F.col("n_words")
    return {
        "short": n < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "dup_lines": F.col("n_dup_lines") >= 10,
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
    }


def prior_of(hosts: int, docs: float, squares: float, failures: int, spread: float) -> tuple[float, float]:
    """Mean and weight in documents of a rule's beta prior.

    squares: the sum of the hosts' documents squared; spread: that of failures**2 / documents.
    """
    mean = failures / docs if docs else 0.0
    room = docs - squares / docs - (hosts - 1) if docs else 0.0
    if not 0 < mean < 1 or room <= 0:
        return mean, 1.0
    rho = ((spread - failures * mean) / (mean * (1 - mean)) - (hosts - 1)) / room
    return mean, min(max(1 / rho - 1, 1.0), 1e6) if rho > 0 else 1e6


def host_rates(measured: DataFrame, host: str = "source") -> DataFrame:
    """A row a host: __hr_host, __hr_docs, and shrunk_<rule> for each rule.

    Rows are pre-aggregated before the shuffle, so a host with most rows costs no more than
    others.  A rule's prior has the weight of 1 / rho - 1 documents, from 1 to a million, rho
    being the correlation of two documents of one host: what the hosts' weighted spread has
    beyond chance.  Without such a spread it is a million documents; with fewer than two hosts,
    one document each, or a rule that all or no documents fail, one document.
    """
    failed = {k: F.sum(F.when(v, 1).otherwise(0)).alias(f"failed_{k}") for k, v in rules().items()}
    hosts = settle(measured.groupBy(F.col(host).alias("__hr_host")).agg(F.count("*").alias("__hr_docs"), *failed.values()), "hosts")
    docs = F.col("__hr_docs").cast("double")
    moments = [F.count("*").alias("hosts"), F.sum(docs).alias("docs"), F.sum(docs * docs).alias("squares")]
    for k in failed:
        moments += [F.sum(f"failed_{k}").alias(f"sum_{k}"), F.sum(F.col(f"failed_{k}") * F.col(f"failed_{k}") / docs).alias(f"spread_{k}")]
    prior = hosts.agg(*moments).first()
    out = hosts
    for k in failed:
        mean, strength = prior_of(prior["hosts"], prior["docs"] or 0.0, prior["squares"] or 0.0, prior[f"sum_{k}"] or 0, prior[f"spread_{k}"] or 0.0)
        out = out.withColumn(f"shrunk_{k}", (F.col(f"failed_{k}") + strength * mean) / (F.col("__hr_docs") + strength))
    return out.select("__hr_host", "__hr_docs", *[f"shrunk_{k}" for k in failed])


def judge_hosts(docs: DataFrame, host: str = "source", text: str = "text", reject: float = 0.5, broadcast_hosts: int = 100_000) -> DataFrame:
    """The columns of `docs` but the text, the measures, base_failed, host_rejected and kept.

    kept: false if the document fails a base rule (fewer than 50 words; more than half of
    the words in repeated 3-word windows) or its host is rejected.  A null host is a host of
    its own, judged like any other.  Null and empty texts have no words and fail.  Repeated
    rows count as often as they stand; no rows give none.  Only rejected hosts are joined
    back: broadcast up to `broadcast_hosts` of them, otherwise by shuffle.
    """
    measured = settle(_measured(docs, text, __hr_host=docs[_quoted(host)]), "measures")
    rates = settle(host_rates(measured, "__hr_host"), "host-rates").withColumnRenamed("__hr_host", "__hr_of")
    worst = F.greatest(*[F.col(f"shrunk_{k}") for k in rules()])
    rejected = rates.where(worst >= reject).select("__hr_of", F.lit(True).alias("host_rejected"))
    if rejected.count() <= broadcast_hosts:
        rejected = F.broadcast(rejected)
    test = rules()
    base = test["short"] | test["repeats"]
    joined = measured.join(rejected, F.col("__hr_host").eqNullSafe(F.col("__hr_of")), "left")
    joined = joined.withColumns({"base_failed": base, "host_rejected": F.coalesce("host_rejected", F.lit(False))})
    return _spread(joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")), list(ADDED[5:]))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_hosts(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected")


_HOST_RULES = ("short", "repeats", "symbols", "dup_lines", "word_length")

OP6_SQL = (
    r"""
with w as (
  select doc_id, source, coalesce(text, '') as t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from documents),
g as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3)),
c as (select doc_id, i, count(*) over (partition by doc_id, g) as n from g),
r as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from c where n > 1) group by doc_id),
m as (
  select w.doc_id, source, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words
  from w left join r using (doc_id)),
f as (
  select *, n_words < 50 as short, 100 * n_repeat_words > 50 * n_words as repeats, 10 * n_symbols > n_words as symbols, n_dup_lines >= 10 as dup_lines,
         word_chars < 2 * n_words or word_chars > 20 * n_words as word_length from m),
h as (select source, count(*) as docs, """
    + ", ".join(f"sum({k}::int) as {k}" for k in _HOST_RULES)
    + " from f group by source),\np as (select count(*) as hosts, sum(docs)::double as n, sum(docs::double * docs) as squares, "
    + ", ".join(f"sum({k})::double as sum_{k}, sum({k}::double * {k} / docs) as spread_{k}" for k in _HOST_RULES)
    + " from h),\nq as (select *, n - squares / n - (hosts - 1) as room, "
    + ", ".join(f"sum_{k} / n as mean_{k}" for k in _HOST_RULES)
    + " from p),\nrho as (select *, "
    + ", ".join(f"case when mean_{k} > 0 and mean_{k} < 1 and room > 0 then ((spread_{k} - sum_{k} * mean_{k}) / (mean_{k} * (1 - mean_{k})) - (hosts - 1)) / room end as rho_{k}" for k in _HOST_RULES)
    + " from q),\nj as (select source, greatest("
    + ", ".join(f"({k} + s_{k} * mean_{k}) / (docs + s_{k})" for k in _HOST_RULES)
    + ") >= 0.5 as host_rejected from h, (select *, "
    + ", ".join(f"case when rho_{k} is null then 1.0 when rho_{k} > 0 then least(greatest(1 / rho_{k} - 1, 1.0), 1e6) else 1e6 end as s_{k}" for k in _HOST_RULES)
    + """ from rho))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short or repeats as base_failed,
       not (short or repeats) and not host_rejected as kept, host_rejected
from f join j on f.source is not distinct from j.source
"""
)
