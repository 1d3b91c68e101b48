"""Option filters, contract choice, leg joins, lookups, fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions import pricing as P
from quantloom.operators import options as O
from quantloom.plans import _inputs as I
from quantloom.plans._registry import Registry

query = Registry()
Q = I.CHAIN
DTE = Q + ", dq as (select *, datediff('day', cast(ts as date), expiration) as dte from quotes)"


@query("f1_dte", f"with {DTE} select id, dte::int as dte from dq")
def f1(spark, d):
    return O.with_dte(I.chain(spark, d)).select("id", "dte")


@query("f2_dte_range", f"with {DTE} select id, dte::int as dte from dq where dte between 20 and 40")
def f2(spark, d):
    return O.candidates(I.chain(spark, d), min_dte=20, max_dte=40).select("id", "dte")


@query("f3_option_type", f"with {Q} select id, strike from quotes where option_type = 'p'")
def f3(spark, d):
    return O.candidates(I.chain(spark, d), "p").select("id", "strike")


@query("f4_valid_quotes", f"with {Q} select id, bid, ask from quotes where bid > 5 and ask > 5")
def f4(spark, d):
    return O.candidates(I.chain(spark, d), min_price=5.0).select("id", "bid", "ask")


@query("f5_leg_candidates", f"with {DTE} select id, dte::int as dte, strike, bid, ask from dq where option_type = 'c' and dte between 15 and 45 and bid > 0.05 and ask > 0.05")
def f5(spark, d):
    return O.candidates(I.chain(spark, d), "c", 15, 45, 0.05).select("id", "dte", "strike", "bid", "ask")


def _closest(type_: str, target: float, low: float, high: float, more: str = "") -> str:
    return f"""select * from dq where option_type = '{type_}' and abs(delta) between {low} and {high} {more}
  qualify row_number() over (partition by symbol, ts, expiration order by abs(abs(delta) - {target}), strike, id) = 1"""


@query("f6_closest_delta", f"with {DTE} select symbol, ts, expiration, strike, delta, id from ({_closest('c', 0.3, 0.1, 0.6)})")
def f6(spark, d):
    return O.closest_delta(O.candidates(I.chain(spark, d), "c"), 0.3, 0.1, 0.6).select("symbol", "ts", "expiration", "strike", "delta", "id")


@query("f7_default_leg", f"with {DTE} select symbol, ts, expiration, strike, id from ({_closest('p', 0.4, 0.30000000000000004, 0.5, 'and dte between 15 and 45 and bid > 0.05 and ask > 0.05')})")
def f7(spark, d):
    return O.leg(I.chain(spark, d), "p", 0.4, 30).select("symbol", "ts", "expiration", "strike", "id")


@query("f8_weekly", f"with {Q} select id, expiration from quotes where isodow(expiration) = 5")
def f8w(spark, d):
    return O.expirations(I.chain(spark, d), "weekly").select("id", "expiration")


@query("f8_monthly", f"with {Q} select id, expiration from quotes where isodow(expiration) = 5 and day(expiration) between 15 and 21")
def f8m(spark, d):
    return O.expirations(I.chain(spark, d), "monthly").select("id", "expiration")


@query("f11_leg_columns", f"with {Q} select symbol, ts, expiration as expiration_primary, strike as strike_2, bid as bid_2, ask as ask_2, delta as delta_2 from quotes where option_type = 'c'")
def f11(spark, d):
    return O.leg_columns(O.candidates(I.chain(spark, d), "c"), 2, expiration="expiration_primary")


_LEGS = f"with {DTE}, a as ({_closest('c', 0.5, 0.0, 1.0)}), b as ({_closest('p', 0.5, 0.0, 1.0)})"


@query("j1_join_legs", _LEGS + """ select symbol, ts, expiration, a.strike as strike_0, a.bid as bid_0, a.ask as ask_0, a.delta as delta_0,
  b.strike as strike_1, b.bid as bid_1, b.ask as ask_1, b.delta as delta_1 from a join b using (symbol, ts, expiration)""")
def j1(spark, d):
    q = I.chain(spark, d)
    return O.join_legs([O.closest_delta(O.candidates(q, t), 0.5, 0.0, 1.0) for t in "cp"])


@query("j2_two_expirations", _LEGS + """ select symbol, ts, a.expiration as expiration_primary, b.expiration as expiration_secondary, a.strike as strike_0, a.bid as bid_0, a.ask as ask_0,
  a.delta as delta_0, b.strike as strike_1, b.bid as bid_1, b.ask as ask_1, b.delta as delta_1 from a join b using (symbol, ts) where b.expiration > a.expiration""")
def j2(spark, d):
    q = I.chain(spark, d)
    near, far = (O.closest_delta(O.candidates(q, t), 0.5, 0.0, 1.0) for t in "cp")
    return O.join_two_expirations([near], [far])


_PRICES = Q + ", prices as (select * from quotes qualify row_number() over (partition by symbol, expiration, strike, option_type, cast(ts as date) order by id desc) = 1)"


@query("j10_price_lookup", f"with {_PRICES} select symbol, expiration, strike, option_type, cast(ts as date) as day, bid, ask, delta from prices")
def j10(spark, d):
    q = I.chain(spark, d)
    wanted = q.select(*O.CONTRACT, F.to_date("ts").alias("day")).distinct()
    return O.lookup(wanted, O.price_table(q, "id")).select(*O.CONTRACT, "day", "bid", "ask", "delta")


@query("j6_last_known_quote", f"""with {_PRICES}, w as (select distinct symbol, expiration, strike, option_type, ts + interval 3 day as ts from quotes)
  select w.symbol, w.expiration, w.strike, w.option_type, w.ts, p.bid, p.ask from w asof left join prices p
  on w.symbol = p.symbol and w.expiration = p.expiration and w.strike = p.strike and w.option_type = p.option_type and w.ts >= p.ts""")
def j6(spark, d):
    q = I.chain(spark, d)
    wanted = q.select("symbol", "expiration", "strike", "option_type", (F.col("ts") + F.expr("interval 3 days")).alias("ts")).distinct()
    return O.last_known(wanted, O.price_table(q, "id")).select("symbol", "expiration", "strike", "option_type", "ts", "bid", "ask")


for _how, _order in {"nearest_dte": "abs(dte - 30)", "first": "0", "highest_premium": "-abs((bid + ask) / 2)", "lowest_premium": "abs((bid + ask) / 2)"}.items():
    query(f"t6_candidate_{_how}", f"with {DTE} select symbol, ts, id from dq qualify row_number() over (partition by symbol, ts order by {_order}, expiration, strike, option_type, id) = 1")(
        lambda spark, d, how=_how: O.select_candidate(O.with_dte(I.chain(spark, d)), how, 30).select("symbol", "ts", "id")
    )


@query("x1_fill_prices", f"""with {Q} select id, round((bid + ask) / 2, 6) as mid, case when delta > 0.5 then ask else bid end as spread,
  round(case when delta > 0.5 then bid + (ask - bid) * 0.75 else ask - (ask - bid) * 0.75 end, 6) as liquidity,
  round(case when delta > 0.5 then bid + (ask - bid) * 0.25 else ask - (ask - bid) * 0.25 end, 6) as travel,
  round(case when delta > 0.5 then (bid + ask) / 2 + 0.02 else (bid + ask) / 2 - 0.02 end, 6) as per_leg from quotes""")
def x1(spark, d):
    q, long = I.chain(spark, d), F.col("delta") > 0.5
    fill = lambda *m: F.round(P.fill_price(F.col("bid"), F.col("ask"), long, *m), 6)
    return q.select("id", fill("mid").alias("mid"), fill("spread").alias("spread"), fill("liquidity", 0.75).alias("liquidity"), fill("bid_ask_travel", 0.25).alias("travel"), fill("per_leg", 0.02).alias("per_leg"))


@query("x2_leg_pnl", f"with {Q} select id, round(case when delta > 0.5 then ask - bid else bid - ask end * (1 + id % 3) * 100, 4) as pnl from quotes")
def x2(spark, d):
    return I.chain(spark, d).select("id", F.round(P.leg_pnl(F.col("bid"), F.col("ask"), F.col("delta") > 0.5, 1 + F.col("id") % 3), 4).alias("pnl"))


@query("x3_commission", f"with {Q} select id, round(greatest(0.5 + 0.65 * abs(id % 5 - 2), 1.0)::double, 6) as fee from quotes")
def x3(spark, d):
    return I.chain(spark, d).select("id", F.round(P.commission(F.col("id") % 5 - 2, 0.65, 0.5, 1.0), 6).alias("fee"))


@query("x5_sizing", f"""with {Q} select id, floor(100000 * 0.1 / bid)::bigint as by_equity, case when ask <> bid then floor(100000 * 0.01 / abs(bid - ask))::bigint else 0 end as by_risk,
  case when strike > 0 and bid > 0 then least(floor(100000 * 0.01 / (bid * 2.0)), floor(100000 / strike))::bigint else 0 end as by_volatility from quotes""")
def x5(spark, d):
    e = F.lit(100000.0)
    return I.chain(spark, d).select(
        "id", P.size_by_equity(e, F.col("bid"), 0.1).alias("by_equity"), P.size_by_risk(e, 0.01, F.col("bid"), F.col("ask")).alias("by_risk"), P.size_by_volatility(e, F.col("strike"), F.col("bid"), 0.01).alias("by_volatility")
    )


@query("sc17_finite_or_null", "select l_orderkey, l_linenumber, l_partkey, case when l_discount > 0 then round(l_extendedprice / l_discount, 4) end as x from lineitem")
def sc17(spark, d):
    x = F.when(F.col("l_discount") > 0, F.col("l_extendedprice") / F.col("l_discount")).otherwise(float("inf"))
    return I.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(P.finite(x), 4).alias("x"))
