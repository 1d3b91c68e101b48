"""The run store: list queries, upserts, deletes, ranking, JSON, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import search as V
from quantloom.operators import store as S
from quantloom.plans import _inputs as I
from quantloom.plans._registry import Registry
from quantloom.sources.market import newer
from quantloom.streaming import market as M

query = Registry()


def runs(spark, d):
    """customer as runs: every third stands alone, the others belong to a nation's sweep."""
    return I.table(spark, d, "customer").select(
        F.col("c_custkey").alias("run_id"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey")).alias("sweep_id"), F.col("c_name").alias("symbol"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal") / 1000).alias("sharpe"),
        (F.col("c_acctbal") / 100).alias("total_return"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).alias("tags"), F.col("c_custkey").alias("created_at"),
    )


RUNS = """runs as (select c_custkey as run_id, case when c_custkey % 3 > 0 then c_nationkey end as sweep_id, c_name as symbol, case when c_custkey % 5 > 0 then c_acctbal / 1000 end as sharpe,
  c_acctbal / 100 as total_return, case when c_custkey % 4 > 0 then c_mktsegment end as tags, c_custkey as created_at from customer),
  sweeps as (select n_nationkey as sweep_id, n_name as name, n_nationkey * 7::bigint as created_at from nation),
  valid as (select o_custkey as run_id, o_totalprice / 1e6 as p from orders)"""


def sweeps(spark, d):
    return I.table(spark, d, "nation").select(F.col("n_nationkey").alias("sweep_id"), F.col("n_name").alias("name"), (F.col("n_nationkey") * F.lit(7).cast("bigint")).alias("created_at"))


def validations(spark, d):
    return I.table(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), (F.col("o_totalprice") / 1e6).alias("p"))


@query("j12_best_of_sweeps", f"""with {RUNS}, b as (select sweep_id, count(*) as runs, max(sharpe) as best_sharpe, arg_max(run_id, (sharpe, run_id)) filter (sharpe is not null) as best_run, min(total_return) as worst_return from runs group by 1),
  v as (select sweep_id, min(p) as least_p from valid join runs using (run_id) group by 1)
  select s.sweep_id, name, created_at, coalesce(runs, 0)::bigint as runs, best_sharpe, best_run, worst_return, least_p from sweeps s left join b using (sweep_id) left join v using (sweep_id)""")
def j12(spark, d):
    return S.best_of_sweeps(sweeps(spark, d), runs(spark, d), validations(spark, d))


@query("f13_tag_search", f"with {RUNS} select run_id, tags from runs where lower(coalesce(tags, '')) like '%build%'")
def f13(spark, d):
    return S.with_tag(runs(spark, d), "Build").select("run_id", "tags")


@query("a14_overview", f"with {RUNS} select count(*)::bigint as runs, count(distinct sweep_id)::bigint as sweeps, max(sharpe) as best_sharpe, round(avg(total_return), 6) as mean_return from runs")
def a14(spark, d):
    return S.overview(runs(spark, d)).withColumn("mean_return", F.round("mean_return", 6))


@query("u2_listing", f"with {RUNS} select 'sweep' as kind, sweep_id::varchar as id, name as title, created_at from sweeps union all select 'run', run_id::varchar, symbol, created_at from runs where sweep_id is null")
def u2(spark, d):
    return S.listing(sweeps(spark, d), runs(spark, d))


@query("t5_page", f"with {RUNS} select run_id, sharpe from runs order by sharpe desc nulls last, run_id limit 25 offset 50")
def t5(spark, d):
    return S.page(runs(spark, d), 25, 50).select("run_id", "sharpe")


@query("t4_ranked", f"with {RUNS} select sweep_id, run_id as combo, sharpe, row_number() over (partition by sweep_id order by sharpe desc nulls last, run_id)::int as rank from runs where sweep_id is not null")
def t4(spark, d):
    r = runs(spark, d).where("sweep_id is not null").withColumnRenamed("run_id", "combo")
    return S.ranked(r, "cagr", ["sweep_id"]).select("sweep_id", "combo", "sharpe", "rank")


@query("a13_sensitivity", f"""with {RUNS} select name, value, count(*)::bigint as n, round(avg(sharpe), 6) as mean from (
  select 'fast' as name, (run_id % 7)::double as value, sharpe from runs union all select 'slow', (run_id % 3)::double, sharpe from runs) group by 1, 2""")
def a13(spark, d):
    r = runs(spark, d).withColumn("params", F.create_map(F.lit("fast"), (F.col("run_id") % 7).cast("double"), F.lit("slow"), (F.col("run_id") % 3).cast("double")))
    return S.sensitivity(r).withColumn("mean", F.round("mean", 6))


@query("a15_distinct_dates", "select distinct cast(o_orderdate as date) as day from orders")
def a15(spark, d):
    return I.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()


@query("t1_sorted_bars", f"with {I.BARS} select symbol, ts, close from bars")
def t1(spark, d):
    return I.daily(spark, d).select("symbol", "ts", "close").orderBy("symbol", "ts")


@query("sc12_append_newer", """with s as (select event_type as symbol, ts, event_id from events where ts < timestamp '2024-01-20'), l as (select symbol, max(ts) as last from s group by 1)
  select e.event_id, e.ts, l.symbol from events e join l on e.event_type = l.symbol where e.ts > l.last""")
def sc12(spark, d):
    e = I.table(spark, d, "events").select(F.col("event_type").alias("symbol"), "ts", "event_id")
    return newer(e, e.where("ts < timestamp_ntz'2024-01-20'")).select("event_id", "ts", "symbol")


@query("sc15_upsert", """with s as (select event_id as id, event_id % 10 as ver, value from events), n as (select c_custkey as id, c_custkey % 7 as ver, c_acctbal as value from customer)
  select id, max(ver)::bigint as ver, arg_max(value, (ver, fresh)) as value from (select *, 0 as fresh from s union all select *, 1 from n) group by id""")
def sc15(spark, d):
    old = I.table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 10).alias("ver"), "value")
    new = I.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 7).alias("ver"), F.col("c_acctbal").alias("value"))
    return S.upsert(old, new, ["id"], "ver")


@query("sc16_cascade_delete", f"""with {RUNS}, gone as (select run_id from runs where sweep_id in (select n_nationkey from nation where n_regionkey = 1))
  select 'sweep' as kind, count(*)::bigint as n from sweeps where sweep_id not in (select n_nationkey from nation where n_regionkey = 1)
  union all select 'run', count(*) from runs where run_id not in (from gone) union all select 'trade', count(*) from orders where o_custkey not in (from gone)""")
def sc16(spark, d):
    doomed = I.table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("sweep_id"))
    trades = I.table(spark, d, "orders").select(F.col("o_custkey").alias("run_id"))
    left = S.cascade_delete(sweeps(spark, d), runs(spark, d), trades, doomed)
    out = None
    for kind, t in zip(("sweep", "run", "trade"), left, strict=True):
        one = t.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
        out = one if out is None else out.unionAll(one)
    return out


@query("x8_json_fields", "select event_id, (props->>'$.k')::bigint as k from events")
def x8(spark, d):
    return I.table(spark, d, "events").select("event_id", S.json_field("props", "$.k", "bigint").alias("k"))


@query("x6_dates", """select l_orderkey, l_partkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') as day, epoch(l_shipdate)::bigint as seconds, date '2002-01-01' - 5 * 365 <= cast(l_shipdate as date) as recent from lineitem""")
def x6(spark, d):
    t = I.table(spark, d, "lineitem")
    return t.select("l_orderkey", "l_partkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("seconds"), (F.date_sub(F.lit("2002-01-01").cast("date"), 5 * 365) <= F.to_date("l_shipdate")).alias("recent"))


@query("x4_math", "select event_id, abs(value - 50) as a, greatest(value, 50.0)::double as b, least(value, 50.0)::double as c, floor(value)::bigint as d, ceil(value)::bigint as e from events")
def x4(spark, d):
    v = F.col("value")
    return I.table(spark, d, "events").select("event_id", F.abs(v - 50).alias("a"), F.greatest(v, F.lit(50.0)).alias("b"), F.least(v, F.lit(50.0)).alias("c"), F.floor(v).alias("d"), F.ceil(v).alias("e"))


@query("x7_text", "select c_custkey, upper(trim(c_name)) as name, concat(c_mktsegment, ':', c_nationkey) as tag, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) as title from customer")
def x7(spark, d):
    return I.table(spark, d, "customer").select("c_custkey", F.upper(F.trim("c_name")).alias("name"), F.concat("c_mktsegment", F.lit(":"), F.col("c_nationkey").cast("string")).alias("tag"), F.initcap("c_mktsegment").alias("title"))


_LEGS = I.CHAIN + ", pos as (select symbol, ts, expiration, list(struct_pack(delta := delta, bid := bid) order by id) as legs from quotes group by 1, 2, 3)"


@query("f16_leg_quantifiers", f"""with {_LEGS} select symbol, ts, expiration, len(list_filter(legs, lambda x: x.delta < -0.5)) > 0 as any_short, len(list_filter(legs, lambda x: not (x.bid > 1))) = 0 as all_valid,
  len(list_filter(legs, lambda x: x.delta > 0))::int as calls, round(list_sum(list_transform(legs, lambda x: x.bid)), 4) as premium, list_min(list_transform(legs, lambda x: x.bid)) as least, list_max(list_transform(legs, lambda x: x.bid)) as most from pos""")
def f16(spark, d):
    pos = I.chain(spark, d).groupBy("symbol", "ts", "expiration").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "delta", "bid"))), lambda x: F.struct(x["delta"].alias("delta"), x["bid"].alias("bid"))).alias("legs"))
    bids = F.transform("legs", lambda x: x["bid"])
    return pos.select(
        "symbol", "ts", "expiration", F.exists("legs", lambda x: x["delta"] < -0.5).alias("any_short"), F.forall("legs", lambda x: x["bid"] > 1).alias("all_valid"), F.size(F.filter("legs", lambda x: x["delta"] > 0)).alias("calls"),
        F.round(F.aggregate(bids, F.lit(0.0), lambda a, x: a + x), 4).alias("premium"), F.array_min(bids).alias("least"), F.array_max(bids).alias("most"),
    )


@query("j13_parameter_grid", "select (a.i * 4 + b.i)::int as combo, round(0.1 + a.i * 0.05, 4)::double as delta, round(7.0 + b.i * 7, 4)::double as dte from (select unnest(range(5)) as i) a, (select unnest(range(4)) as i) b")
def j13(spark, d):
    g = V.grid(spark, {"delta": V.steps(0.1, 0.3, 0.05), "dte": V.steps(7, 28, 7)})
    return g.select("combo", V.parameter("delta").alias("delta"), V.parameter("dte").alias("dte"))


@query("st1_tumbling_bars", """select event_type as symbol, time_bucket(interval 1 hour, ts) as start, min(ts) as ts, arg_min(value, ts) as open, max(value) as high, min(value) as low, arg_max(value, ts) as close, sum(user_id)::bigint as volume from events group by 1, 2""")
def st1(spark, d):
    t = I.table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), F.col("value").alias("price"), F.col("user_id").alias("volume"))
    return M.live_bars(t).withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "start": F.col("start").cast("timestamp_ntz")})


@query("st1_sessions", """with g as (select event_type as symbol, ts, case when ts - lag(ts) over w < interval 2 hour then 0 else 1 end as fresh from events window w as (partition by event_type order by ts)),
  s as (select *, sum(fresh) over (partition by symbol order by ts) as k from g) select symbol, min(ts) as start, max(ts) + interval 2 hour as "end", count(*)::bigint as n from s group by symbol, k""")
def st1s(spark, d):
    t = I.table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"))
    return M.sessions(t).withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("st3_drift", """with b as (select s_nationkey as session, avg(s_acctbal) / 1000 as sharpe, count(*) as n from supplier group by 1), c as (select c_nationkey as session, avg(c_acctbal) / 1000 as sharpe, count(*)::bigint as trades from customer group by 1)
  select session, round((c.sharpe - b.sharpe) / abs(b.sharpe), 6) as change, case when (c.sharpe - b.sharpe) / abs(b.sharpe) <= -0.5 then 'alert' when (c.sharpe - b.sharpe) / abs(b.sharpe) <= -0.25 then 'warning' else 'ok' end as level,
  case when trades >= 30 then 'comparable' when trades >= 20 then 'preliminary' else 'insufficient' end as confidence from b join c using (session)""")
def st3(spark, d):
    figures = lambda x: [(F.avg(x) / 1000).alias("sharpe"), F.lit(0.5).alias("win_rate"), F.lit(0.1).alias("max_drawdown")]
    base = I.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("session")).agg(*figures("s_acctbal"))
    now = I.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("session")).agg(F.count("*").alias("trades"), *figures("c_acctbal"))
    return M.drift(now, base).where("figure = 'sharpe'").select("session", F.round("change", 6).alias("change"), "level", "confidence")


@query("st2_forward_step", """select event_type as session, ts, value as equity from events where ts > (select max(ts) from events x where x.event_type = events.event_type and x.ts < timestamp '2024-01-15')""")
def st2(spark, d):
    e = I.table(spark, d, "events").select(F.col("event_type").alias("session"), "ts", F.col("value").alias("equity"))
    return M.forward_step(e.where("ts < timestamp_ntz'2024-01-15'"), e)
