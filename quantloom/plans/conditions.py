"""Conditions as text, over daily and hourly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import bars as B
from quantloom.operators import conditions as C
from quantloom.plans import _inputs as I
from quantloom.plans import indicators as N
from quantloom.plans._registry import Registry

query = Registry()
_BY_TIME = "(partition by symbol order by ts)"


def mean(n: int) -> str:
    return f"case when count(*) over w{n} = {n} then avg(close) over w{n} end"


def frames(*ns: int) -> str:
    return "window " + ", ".join(f"w{n} as (partition by symbol order by ts rows between {n - 1} preceding and current row)" for n in ns)


@query("f15_crosses", f"""with {I.BARS}, m as (select symbol, ts, close, {mean(10)} as fast, {mean(30)} as slow from bars {frames(10, 30)}),
  p as (select *, lag(fast) over v as pf, lag(slow) over v as ps, lag(close) over v as pc from m window v as {_BY_TIME})
  select symbol, ts, coalesce(fast > slow and pf <= ps, false) as up, coalesce(fast < slow and pf >= ps, false) as down,
    coalesce(close > 200000 and pc <= 200000, false) or coalesce(close < 50000 and pc >= 50000, false) as level from p""")
def crosses(spark, d):
    texts = {"up": "sma(fast) crosses above sma(slow)", "down": "sma(10) crosses below sma(30)", "level": "close crosses above 200000 or close crosses below 50000"}
    return C.add(I.daily(spark, d), texts, values={"fast": 10, "slow": 30}).select("symbol", "ts", *texts)


@query("f15_lookback", f"""with {I.BARS}, m as (select symbol, ts, high, low, close, {mean(20)} as s from bars {frames(20)}),
  p as (select *, lag(close) over v as c1, lag(close, 2) over v as c2, lag(s, 5) over v as s5, lag(high, 3) over v as h3 from m window v as {_BY_TIME})
  select symbol, ts, coalesce(close > c1, false) and coalesce(c1 > c2, false) as rising, not coalesce(s > s5, false) and coalesce(close != c2, false) as flat,
    round((close - c2) / c2 * 100 + h3 % 7, 4) as change from p""")
def lookback(spark, d):
    texts = {"rising": "close > close[1] and close[1] > close[2]", "flat": "not sma(20) > sma(20)[5] and close != close[2]", "change": "(close - close[2]) / close[2] * 100 + high[3] % 7"}
    return C.add(I.daily(spark, d), texts).select("symbol", "ts", "rising", "flat", F.round("change", 4).alias("change"))


@query("f15_calendar", f"""with {I.TICKS}, h as (select symbol, date_trunc('hour', ts) as ts, arg_min(price, id) as open, arg_max(price, id) as close from ticks group by 1, 2),
  k as (select *, lag(cast(ts as date)) over v as before, lead(cast(ts as date)) over v as after, strftime(ts, '%H:%M') as t from h window v as {_BY_TIME})
  select symbol, ts, t >= '10:00' and t < '15:30' and isodow(ts) <> 5 as session, month(ts) in (1, 12) or isodow(ts) >= 6 as rare,
    not (before is null or before <> cast(ts as date)) and (after is null or after <> cast(ts as date)) as closing,
    day(cast(ts as date) + cast(5 - isodow(ts) as integer)) between 15 and 21 as expiry from k""")
def calendar(spark, d):
    texts = {
        "session": "time >= 10:00 and time < 15:30 and day_of_week != friday", "rare": "month == january or month == december or day_of_week >= saturday",
        "closing": "not is_first_bar and is_last_bar", "expiry": "is_expiry_week",
    }
    bars = B.resample(I.ticks(spark, d), "1h", tie="id")
    # Bars bear the time of their first tick; conditions read the hour.
    return C.add(bars.withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz")), texts).select("symbol", "ts", *texts)


@query("f15_inline_if", f"""with {I.BARS}, m as (select symbol, ts, open, high, low, close, {mean(20)} as s from bars {frames(20)})
  select symbol, ts, round(case when coalesce(close > s, false) then close else case when coalesce(close > open, false) then (high + low) / 2 else -1 * low end end, 4) as price,
    coalesce(close * (case when coalesce(high > 2 * low, false) then 1.5 else 0.5 end) > open, false) and not (s is null) as wide from m""")
def inline_if(spark, d):
    texts = {"price": "close if close > sma(20) else (high + low) / 2 if close > open else -low", "wide": "close * (1.5 if high > 2 * low else 0.5) > open and sma(20) == sma(20)"}
    return C.add(I.daily(spark, d), texts).select("symbol", "ts", F.round("price", 4).alias("price"), "wide")


@query("f15_precedence", f"""with {N._C}, k as (select symbol, ts, close, i, {mean(5)} as s, {mean(50)} as l from c {frames(5, 50)}),
  p as (select *, lag(close, 4) over v as c4 from k window v as {_BY_TIME})
  select symbol, ts, coalesce(s > l, false) or coalesce(close < s, false) and not coalesce(close > c4 * 2 - 1000, false) as mixed,
    (coalesce(s > l, false) or coalesce(close < s, false)) and not coalesce(close > c4 * (2 - 1000), false) as grouped from p""")
def precedence(spark, d):
    texts = {"mixed": "sma(5) > sma(50) or close < sma(5) and not close > close[4] * 2 - 1000", "grouped": "(sma(5) > sma(50) or close < sma(5)) and not close > close[4] * (2 - 1000)"}
    return C.add(I.daily(spark, d), texts).select("symbol", "ts", *texts)
