"""Market operators against hand-computed values, plain loops and invariants."""

from __future__ import annotations

import datetime as dt
import math
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import distributions as D
from quantloom.functions import pricing as P
from quantloom.operators import bars as B
from quantloom.operators import indicators as N
from quantloom.operators import metrics, patterns, portfolio, regimes, resampling, search, simulation, stats
from quantloom.operators import options as O
from quantloom.operators import windows as W
from quantloom.sources import market
from quantloom.streaming import market as live


def series(spark, closes, symbol="X", start="2024-01-01", **columns):
    days = pd.date_range(start, periods=len(closes))
    pdf = pd.DataFrame({"symbol": symbol, "ts": days, "close": np.asarray(closes, float)})
    for c in ("open", "high", "low"):
        pdf[c] = np.asarray(columns.get(c, closes), float)
    pdf["volume"] = columns.get("volume", 100)
    df = spark.createDataFrame(pdf)
    return df.withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "volume": F.col("volume").cast("bigint")})


def one(spark, values):
    return spark.createDataFrame([("X", float(v)) for v in values], "symbol string, v double")


@pytest.mark.parametrize("values, skew, kurtosis", [([1, 2, 2, 3, 10], 1.451619, None), ([1, 2, 3, 4, 5], 0.0, -3.648), ([1, 1, 1, 1, 10], None, 0.32), ([1, 2, 3, 4, 10], 1.2143, -0.8627), ([1, 2], 0.0, 0.0), ([3, 3, 3, 3, 3], 0.0, 0.0)])
def test_skew_and_kurtosis(spark, values, skew, kurtosis):
    got = stats.describe(one(spark, values), "v", ["symbol"]).first()
    if skew is not None:
        assert got["skew"] == pytest.approx(skew, abs=1e-4)
    if kurtosis is not None:
        assert got["kurtosis"] == pytest.approx(kurtosis, abs=1e-4)


def test_histogram(spark):
    got = sorted(stats.histogram(one(spark, range(1, 11)), "v", 5, ["symbol"]).collect(), key=lambda r: r["bin"])
    assert [r["n"] for r in got] == [2] * 5 and got[0]["high"] == pytest.approx(2.8) and got[0]["frequency"] == pytest.approx(0.2)
    flat = stats.histogram(one(spark, [4, 4]), "v", 5, ["symbol"]).collect()
    assert len(flat) == 1 and flat[0]["n"] == 2


def test_distributions():
    assert D.normal_cdf(np.array([0, 1.959963985]))[1] == pytest.approx(0.975, abs=1e-9)
    assert D.t_two_sided(np.array([2.228138852]), np.array([10.0]))[0] == pytest.approx(0.05, abs=1e-8)
    assert D.f_upper(np.array([4.102821]), np.array([2.0]), np.array([10.0]))[0] == pytest.approx(0.05, abs=1e-6)
    assert D.chi2_upper(5.991464547, 2) == pytest.approx(0.05, abs=1e-9)
    assert np.isnan(D.t_two_sided(np.array([np.nan]), np.array([3.0])))[0]


def test_fill_prices(spark):
    row = spark.createDataFrame([(2.0, 2.5)], "bid double, ask double")
    f = lambda long, *m: row.select(P.fill_price(F.col("bid"), F.col("ask"), F.lit(long), *m)).first()[0]
    assert f(True, "liquidity", 0.75) == 2.375 and f(False, "liquidity", 0.75) == 2.125 and f(True, "spread") == 2.5 and f(True) == 2.25 and f(False, "per_leg", 0.1) == pytest.approx(2.15)


#: bar (open, high, low), kind, buy, limit, stop, fill
FILLS = [
    ((100, 105, 95), "market", True, None, None, 100), ((100, 105, 95), "limit", True, 97, None, 97), ((94, 105, 90), "limit", True, 97, None, 94), ((100, 105, 98), "limit", True, 97, None, None),
    ((100, 105, 95), "limit", False, 103, None, 103), ((106, 108, 104), "limit", False, 103, None, 106), ((100, 102, 95), "limit", False, 103, None, None), ((100, 105, 95), "stop", True, None, 103, 103),
    ((104, 105, 103), "stop", True, None, 103, 104), ((100, 105, 95), "stop", False, None, 97, 97), ((96, 99, 95), "stop", False, None, 97, 96), ((100, 105, 98), "stop", False, None, 97, None),
    ((100, 105, 95), "stop_limit", True, 104, 102, 102), ((103, 105, 101), "stop_limit", True, 104, 102, 103), ((106, 107, 103), "stop_limit", True, 104, 102, 104), ((100, 105, 95), "stop_limit", True, 100, 102, None),
    ((100, 105, 95), "stop_limit", False, 96, 98, 98), ((100, 105, 95), "stop_limit", False, 99, 98, None),
]


@pytest.mark.parametrize("bar, kind, buy, limit, stop, want", FILLS)
def test_order_fills(spark, bar, kind, buy, limit, stop, want):
    row = spark.createDataFrame([tuple(map(float, bar))], "open double, high double, low double")
    lit = lambda x: F.lit(None if x is None else float(x)).cast("double")
    assert row.select(simulation.fill(kind, F.lit(buy), lit(limit), lit(stop))).first()[0] == want


def walked(spark, closes, enter, leave=(), opens=None, highs=None, lows=None, **rules):
    bars = series(spark, closes, open=opens or closes, high=highs or closes, low=lows or closes)
    i = F.row_number().over(W.order()) - 1
    bars = bars.withColumn("i", i).withColumns({"combo": F.lit(0), "enter": F.col("i").isin(list(enter)), "leave": F.col("i").isin([-1, *leave])})
    return simulation.backtest(bars, simulation.Rules(capital=1000.0, **rules)).orderBy("entry_ts").collect()


def test_orders_fill_on_the_next_bar(spark):
    t, = walked(spark, [10, 11, 12, 13, 14, 15], [0], [3], opens=[10, 10.5, 11.5, 12.5, 13.5, 14.5])
    assert (t["entry_price"], t["exit_price"], t["quantity"], t["reason"]) == (10.5, 13.5, 95, "signal")
    assert not walked(spark, [10, 11, 12], [2])
    t, = walked(spark, [10, 11, 12, 13], [0], [1])
    assert t["reason"] == "end_of_data"  # the exit on the day of the fill does not count


def test_stops_and_targets(spark):
    t, = walked(spark, [10, 10, 10, 10], [0], lows=[10, 10, 8, 10], highs=[10, 10, 12, 10], stop_loss=0.1, profit_target=0.1)
    assert (t["exit_price"], t["reason"]) == (9.0, "stop_loss")
    t, = walked(spark, [10, 10, 10, 10], [0], highs=[10, 10, 12, 10], profit_target=0.1)
    assert (t["exit_price"], t["reason"]) == (11.0, "profit_target")
    t, = walked(spark, [10, 10, 12, 14, 12, 12], [0], trailing_stop=0.1)
    assert (t["exit_price"], t["reason"]) == (12.0, "trailing_stop")
    t, = walked(spark, [10] * 8, [0], days=3)
    assert t["days"] == 3 and t["reason"] == "max_hold"


def test_equity_follows_trades(spark):
    bars = series(spark, [10, 10, 12, 11, 13, 20])
    trades = simulation.backtest(bars.withColumns({"combo": F.lit(0), "enter": F.dayofmonth("ts") == 1, "leave": F.dayofmonth("ts") == 4}), simulation.Rules(capital=1000.0))
    curve = [r["equity"] for r in simulation.equity(trades, bars, 1000.0).orderBy("ts").collect()]
    assert curve == [1000, 1000, 1200, 1100, 1300, 1300]


def chain(spark):
    """48 quotes: two types, four strikes, three days, two expirations."""
    near = {"c": {95: (0.7, 8, 7, 5), 100: (0.5, 5, 4, 2), 105: (0.35, 3, 2.2, 1), 110: (0.2, 1.5, 1, 0.3)}, "p": {95: (-0.2, 1, 0.8, 0.2), 100: (-0.4, 2.5, 2, 1), 105: (-0.55, 4.5, 3.8, 2.5), 110: (-0.7, 7, 6.2, 4.5)}}
    far = {"c": {95: (0.72, 10, 9.2, 7), 100: (0.52, 7, 6.3, 4.5), 105: (0.37, 4.5, 3.9, 2.8), 110: (0.22, 2.8, 2.3, 1.5)}, "p": {95: (-0.22, 2, 1.7, 1), 100: (-0.42, 4, 3.5, 2.5), 105: (-0.57, 6.5, 5.8, 4.3), 110: (-0.72, 9, 8.3, 6.5)}}
    days, rows = [dt.datetime(2024, 1, 15), dt.datetime(2024, 1, 22), dt.datetime(2024, 2, 11)], []
    for expiration, table in ((dt.date(2024, 2, 16), near), (dt.date(2024, 3, 15), far)):
        for kind, strikes in table.items():
            for strike, (delta, *bids) in strikes.items():
                rows += [("SPY", day, expiration, kind, float(strike), float(bid), bid + 0.5, delta, len(rows) + k) for k, (day, bid) in enumerate(zip(days, bids, strict=True))]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, expiration date, option_type string, strike double, bid double, ask double, delta double, id long")


def test_option_filters_and_joins(spark):
    q = chain(spark)
    assert q.count() == 48 and sorted({r["dte"] for r in O.with_dte(q).collect()}) == [5, 25, 32, 33, 53, 60]
    assert O.expirations(q, "monthly").count() == 48 and O.candidates(q, "c", 20, 40, 0.05).count() == 12
    best = O.closest_delta(O.candidates(q, "c"), 0.5, 0.2, 0.7)
    assert {r["strike"] for r in best.collect()} == {100.0} and best.count() == 6
    puts = O.closest_delta(O.candidates(q, "p"), 0.4, 0.1, 0.7)
    assert O.join_legs([best, puts]).count() == 6
    both = O.join_two_expirations([best], [puts])
    assert both.count() == 3 and both.where("expiration_secondary <= expiration_primary").count() == 0


def test_strategies(spark):
    assert len(simulation.STRATEGIES) == 31
    legs = simulation.strategy("iron_condor", 0.4, 0.2, 0.35, 0.2, dte=32)
    assert [(x.long, x.kind, x.delta) for x in legs] == [(True, "p", 0.2), (False, "p", 0.4), (False, "c", 0.35), (True, "c", 0.2)]
    with pytest.raises(ValueError):
        simulation.strategy("long_call", 0.3, 0.4)
    q = chain(spark)
    found = simulation.resolve(q.where("expiration = date'2024-02-16'"), legs)
    first = found.orderBy("ts").first()
    assert [x["strike"] for x in first["legs"]] == [95.0, 100.0, 105.0, 110.0]
    closes = spark.createDataFrame([("SPY", dt.datetime(2024, 2, 16), 98.0)], "symbol string, ts timestamp_ntz, close double")
    held = simulation.hold_to_expiration(found, closes).orderBy("ts").first()
    # credit at mid: -(1.25) + 2.75 + 3.25 - 1.75 = 3.00; the short put is 2 in the money
    assert held["cost"] == pytest.approx(-300) and held["pnl"] == pytest.approx(100) and held["exit"] == "assignment"


def test_wheel(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(n)
    leg = lambda n, strike, until, bid: ("X", day(n), [(0, False, "p", 1, float(strike), day(until).date(), bid, bid + 0.2, -0.3)])
    schema = "symbol string, ts timestamp_ntz, legs array<struct<number:int,long:boolean,kind:string,quantity:int,strike:double,expiration:date,bid:double,ask:double,delta:double>>"
    puts = spark.createDataFrame([leg(0, 90, 10, 1.0), leg(5, 92, 15, 1.0), leg(11, 100, 20, 2.0), leg(41, 99, 50, 1.0), leg(45, 99, 80, 1.0)], schema)
    calls = spark.createDataFrame([leg(1, 99, 9, 9.0), leg(21, 110, 30, 1.5), leg(31, 105, 40, 1.0)], schema)
    prices = spark.createDataFrame([("X", day(n), float(c)) for n, c in ((10, 95), (20, 97), (30, 104), (40, 107), (60, 98))], "symbol string, ts timestamp_ntz, close double")
    got = [(r["kind"], r["strike"], r["exit"], round(r["stock_pnl"], 2), round(r["credit"], 2)) for r in simulation.wheel(puts, calls, prices).orderBy("entry_ts").collect()]
    assert got == [("p", 90, "expiration", 0, 110), ("p", 100, "assignment", 0, 210), ("c", 110, "expiration", 0, 160), ("c", 105, "called_away", 500, 110), ("p", 99, "expiration", 0, 110)]


def test_resample_and_lookups(spark):
    ticks = spark.createDataFrame([("A", dt.datetime(2024, 1, 1, 9, m), m, float(v), float(v), float(v), float(v), 1) for m, v in ((31, 5), (33, 9), (34, 2), (36, 4))], "symbol string, ts timestamp_ntz, id long, open double, high double, low double, close double, volume long")
    got = [(r["ts"].minute, r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in B.resample(ticks, "5m", tie="id").orderBy("ts").collect()]
    assert got == [(31, 5.0, 9.0, 2.0, 2.0, 3), (36, 4.0, 4.0, 4.0, 4.0, 1)]
    assert B.resample(ticks, "5m", label="boundary").agg(F.min("ts")).first()[0].minute == 30
    with pytest.raises(ValueError):
        B.resample(ticks, "7m")
    left, right = series(spark, [1, 2, 3], start="2024-01-01"), series(spark, [10, 20], start="2024-01-02")
    value = lambda **k: [r["x_close"] for r in B.asof_join(left, right, ["symbol"], ["close"], prefix="x_", **k).orderBy("ts").collect()]
    assert value() == [None, 10, 20] and value(backfill=True) == [10, 10, 20] and value(strict=True) == [None, None, 10]


def test_adjustment_factors(spark):
    closes = spark.createDataFrame([("X", dt.date(2024, 1, d), 100.0) for d in range(1, 11)], "symbol string, date date, close double")
    splits = spark.createDataFrame([("X", dt.date(2024, 1, 5), 2.0)], "symbol string, date date, ratio double")
    dividends = spark.createDataFrame([("X", dt.date(2024, 1, 8), 1.0), ("X", dt.date(2024, 1, 9), 500.0)], "symbol string, date date, amount double")
    factors = B.adjustment_factors(splits, dividends, closes)
    got = {r["ts"].day: r["adj_factor"] for r in B.adjust(closes.withColumn("ts", F.col("date").cast("timestamp_ntz")).drop("date"), factors).collect()}
    assert got[4] == pytest.approx(0.495) and got[5] == pytest.approx(0.99) and got[7] == pytest.approx(0.99) and got[8] == 1 and got[10] == 1


def test_drawdown_episodes(spark):
    got = W.drawdown_episodes(series(spark, [10, 8, 9, 10, 11, 10, 9])).orderBy("start").collect()
    assert [(r["start"].day, r["trough"].day, r["end"].day if r["end"] else None, round(r["depth"], 3), r["duration"], r["recovery"]) for r in got] == [(2, 2, 4, -20.0, 2, 2), (6, 7, None, -18.182, 2, 0)]


def test_purge_overlaps(spark):
    rows = spark.createDataFrame([("X", i) for i in (1, 2, 3, 7, 8, 20)], "symbol string, i bigint")
    assert sorted(r["i"] for r in W.purge_overlaps(rows, 5).collect()) == [1, 7, 20]
    assert sorted(r["i"] for r in W.purge_overlaps(rows, 1).collect()) == [1, 2, 3, 7, 8, 20]


def test_walk_forward_windows(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(k),) for k in range(100)], "day date")
    for mode in ("rolling", "anchored"):
        rows = W.walk_forward_windows(days, 4, 0.7, mode).orderBy("window").collect()
        assert len(rows) == 4 and all(r["train_start"] <= r["train_end"] < r["test_start"] <= r["test_end"] for r in rows)
        assert all(a["test_start"] < b["test_start"] for a, b in zip(rows, rows[1:], strict=False))
        assert mode == "rolling" or len({r["train_start"] for r in rows}) == 1


def test_indicator_names_and_warm_up(spark):
    assert len(N.NAMES) == 40 and [n for n, _ in N.parse("macd")] == ["macd_line", "macd_signal", "macd_hist"]
    for bad in ("nothing", "sma:1:2", "sma:0"):
        with pytest.raises(ValueError):
            N.parse(bad)
    draw = np.random.default_rng(1)
    closes = 100 + draw.normal(size=60).cumsum()
    bars = series(spark, closes, high=closes + 1, low=closes - 1)
    got = N.add(bars, ["rsi:14", "macd", "sma:20", "psar", "supertrend", "ema:5"]).orderBy("ts").toPandas()
    first = lambda c: int(got[c].first_valid_index())
    assert first("rsi_14") == 13 and first("macd_signal_12_26_9") == 33 and first("sma_20") == 19 and first("psar_2_20") == 0 and first("supertrend_10_30") == 9
    weights = (1 - 2 / 6) ** np.arange(5)[::-1]
    assert got["ema_5"].iloc[30] == pytest.approx((closes[26:31] * weights).sum() / weights.sum())
    below = got["psar_2_20"] < got["high"]
    assert below.any() and (got["rsi_14"].dropna().between(0, 100)).all()


def test_regression_granger_and_cointegration(spark):
    draw = np.random.default_rng(2)
    x, e = draw.normal(size=300), draw.normal(size=300) * 0.1
    y = np.concatenate([[0], 0.8 * x[:-1]]) + e
    walk = draw.normal(size=300).cumsum() + 100
    pdf = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=300), "x": x, "y": y, "a": walk, "b": 2 * walk + 5 + draw.normal(size=300) * 0.5})
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert stats.granger(df, "x", "y", 1)["p"] < 1e-6 < 0.01 < stats.granger(df, "y", "x", 1)["p"]
    fit = stats.ols(df, ["a"], "b")
    want = np.polyfit(walk, pdf["b"], 1)
    assert fit["coefficients"] == pytest.approx(want[::-1])
    found = portfolio.engle_granger(df)
    assert found["cointegrated"] and found["beta"] == pytest.approx(2, abs=0.05) and found["half_life"] is None or found["half_life"] < 5


def test_weights_sum_to_one(spark):
    draw = np.random.default_rng(3)
    rows = [(s, d.to_pydatetime(), float(v)) for s in "ABC" for d, v in zip(pd.date_range("2024-01-01", periods=80), draw.normal(size=80) * (1 + ord(s) - 65), strict=True)]
    got = portfolio.optimize(spark.createDataFrame(rows, "symbol string, ts timestamp, ret double")).groupBy("method").agg(F.sum("weight").alias("w"), F.min("weight").alias("m")).collect()
    assert len(got) == 3 and all(r["w"] == pytest.approx(1) and r["m"] >= 0 for r in got)


def test_numbers_and_lags_across_spans_and_blocks(spark):
    days = pd.date_range("2020-01-15", periods=200, freq="D").to_numpy().astype("datetime64[us]")
    shuffled = np.random.default_rng(3).permutation(200)
    df = spark.createDataFrame([(pd.Timestamp(days[i]).to_pydatetime(), int(i)) for i in shuffled], "ts timestamp_ntz, v int")
    assert all(r["k"] == r["v"] + 1 for r in stats.numbered(df, "k").collect())
    for block in (3, 7, 1000):
        got = stats.lagged(df, {"one": ("v", 1), "five": ("v", 5)}, block=block).collect()
        assert len(got) == 200
        assert {r["v"]: (r["one"], r["five"]) for r in got} == {v: (v - 1 if v >= 1 else None, v - 5 if v >= 5 else None) for v in range(200)}
    assert stats.lagged(df.where("v < 0"), {"one": ("v", 1)}).count() == 0
    untimed = df.union(spark.createDataFrame([(None, -1)], df.schema))
    assert {r["v"]: r["k"] for r in stats.numbered(untimed, "k").collect()} == {v: v + 2 for v in range(-1, 200)}


def test_lead_lag_counts_rows_that_are_there(spark):
    x = np.random.default_rng(4).normal(size=80)
    y = np.roll(x, 2)
    ts = [d.to_pydatetime() for d in pd.date_range("2020-01-30", periods=80, freq="D")]
    df = spark.createDataFrame(list(zip(ts, x.tolist(), y.tolist(), strict=True)), "ts timestamp_ntz, a double, b double")
    got = {r["lag"]: r for r in stats.lead_lag(df, "a", "b", 3).collect()}
    assert sorted(got) == list(range(-3, 4)) and all(got[k]["n"] == 80 - abs(k) for k in got)
    assert got[2]["correlation"] == pytest.approx(1) and got[-1]["correlation"] == pytest.approx(np.corrcoef(x[1:], y[:-1])[0, 1])


def test_covariance_of_a_pair_both_ways(spark):
    ts = [d.to_pydatetime() for d in pd.date_range("2020-01-01", periods=30, freq="D")]
    x = np.random.default_rng(5).normal(size=(3, 30))
    rows = [(s, t, float(v)) for s, line in zip("pqr", x, strict=True) for t, v in zip(ts, line, strict=True)]
    got = {(r["a"], r["b"]): r for r in stats.covariance_matrix(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, ret double"), factor=1.0).collect()}
    assert len(got) == 9 and all(got[a, b]["covariance"] == got[b, a]["covariance"] for a in "pqr" for b in "pqr")
    assert got["r", "p"]["covariance"] == pytest.approx(np.cov(x)[0, 2]) and got["q", "q"]["correlation"] == pytest.approx(1)


def test_walk_forward_keeps_names_with_any_signs(spark):
    closes = 100 + np.sin(np.arange(90) / 3) * 5
    bars = series(spark, closes, symbol="a~b|c").union(series(spark, closes, symbol="plain"))
    days = bars.select(F.to_date("ts").alias("day")).distinct()

    def signal(rows):
        before = F.lag("close").over(W.order())
        return rows.withColumns({"enter": F.coalesce(F.col("close") > before, F.lit(False)), "leave": F.coalesce(F.col("close") < before, F.lit(False))})

    got = search.walk_forward(bars, W.walk_forward_windows(days, 2), search.grid(spark, {"w": [1.0]}), signal, simulation.Rules()).toPandas()
    assert set(got.symbol) == {"a~b|c", "plain"} and sorted(got.window) == [0, 0, 1, 1]
    one, other = (got[got.symbol == s].sort_values("window").out_of_sample.values for s in ("a~b|c", "plain"))
    assert one == pytest.approx(other)


def test_hidden_markov_model_finds_two_regimes():
    draw = np.random.default_rng(4)
    state = (np.arange(400) // 100) % 2
    x = np.where(state == 0, draw.normal(-1, 0.5, 400), draw.normal(1, 0.5, 400))
    model = regimes.hmm_fit(x, 2)
    assert np.mean(regimes.viterbi(x, *model) == state) > 0.97 and np.mean(regimes.online_filter(x, *model) == state) > 0.9
    assert model[1].sum(1) == pytest.approx([1, 1]) and not regimes.overlapping(model[2], model[3])


def test_transition_rows(spark):
    states = regimes.volatility_clusters(series(spark, 100 + np.random.default_rng(5).normal(size=200).cumsum()), 3)
    got = regimes.transitions(states, 3).groupBy("symbol", "from").agg(F.sum("probability").alias("p")).collect()
    assert len(got) == 3 and all(r["p"] == pytest.approx(1) for r in got)


def test_planted_weekday_effect_is_found(spark):
    draw, close, closes = np.random.default_rng(6), 100.0, []
    for d in pd.date_range("2020-01-01", periods=1500):
        close *= 1 + draw.normal() * 0.002 + (0.02 if d.weekday() == 2 else -0.005)
        closes.append(close)
    got = patterns.scan(series(spark, closes, start="2020-01-01"), horizons=(1,)).where("significant").collect()
    assert any(r["pattern"] == "seasonality/tue" for r in got)


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5]
    got = {r["label"]: r for r in stats.benjamini_hochberg(spark.createDataFrame([(str(i), v) for i, v in enumerate(p)], "label string, p double")).collect()}
    assert [got[str(i)]["adjusted"] for i in range(5)] == pytest.approx([0.025, 0.05, 0.05, 0.025, 0.5])


def test_chance_tests_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([("X", i, float(v)) for i, v in enumerate(np.random.default_rng(7).normal(0.8, 1, 40))], "symbol string, id long, pnl double")
    a, b = (resampling.sign_flip_test(rows.repartition(n), 300).first() for n in (1, 7))
    assert a == b and a["p"] < 0.05 and resampling.sign_flip_test(rows.limit(5), 10).first()["p"] == 1.0
    returns = series(spark, range(60)).select("ts", (F.col("close") / 1000 - 0.03).alias("ret"))
    c, d = (sorted(map(tuple, resampling.bootstrap_paths(r, paths=40, horizon=30).collect())) for r in (returns, returns.repartition(5)))
    assert c == d and len(c) == 40
    with pytest.raises(ValueError):
        resampling.bootstrap_paths(returns.limit(10), paths=2)


def test_bootstrap_paths_use_the_whole_series_of_every_symbol(spark):
    n, capital = 25_000, 100_000.0
    x = np.random.default_rng(9).normal(0, 0.01, n)
    x[:20_000] = 0.0
    rows = spark.createDataFrame(pd.DataFrame({"symbol": ["A"] * n + ["B"] * 40 + ["C"] * 20, "ts": [*range(n), *range(40), *range(20)], "ret": [*x, *x[-40:], *x[-20:]]}))
    got = {(r["symbol"], r["path"]): (r["terminal"], r["max_drawdown"]) for r in resampling.bootstrap_paths(rows.repartition(5), paths=30, horizon=50, key="symbol").collect()}
    assert set(got) == {(s, k) for s in "AB" for k in range(30)}
    for (symbol, k), (terminal, drawdown) in got.items():
        series = {"A": x, "B": x[-40:]}[symbol]
        starts = np.random.Generator(np.random.Philox(key=[42, k])).integers(0, len(series) - resampling.BLOCK, 3)
        value = capital * np.cumprod(1 + np.concatenate([series[s : s + resampling.BLOCK] for s in starts])[:50])
        peak = np.maximum.accumulate(np.append(capital, value))[1:]
        assert (terminal, drawdown) == pytest.approx((value[-1], ((peak - value) / peak).max()))
    assert len({terminal for (s, _), (terminal, _) in got.items() if s == "A"}) > 1
    summary = resampling.path_summary(rows.sparkSession.createDataFrame([(s, *v) for (s, _), v in got.items()], "symbol string, terminal double, max_drawdown double"), key="symbol").collect()
    assert {r["symbol"]: r["n"] for r in summary} == {"A": 30, "B": 30}


def test_search(spark):
    assert search.steps(0.1, 0.3, 0.1) == [0.1, 0.2, 0.3]
    assert search.grid(spark, {}).count() == 1 and search.grid(spark, {"a": [1, 2], "b": [3, 4, 5]}).count() == 6
    calls = []

    def evaluate(points):
        calls.append(len(points))
        return [-((p["x"] - 0.3) ** 2) - (p["y"] - 0.6) ** 2 for p in points]

    tried = search.bayesian(evaluate, {"x": (0.0, 1.0, 0.05), "y": (0.0, 1.0, 0.05)}, evaluations=40)
    best = max(tried, key=lambda t: t[1])
    assert best[1] > -0.02 and len(tried) <= 40 and max(calls) <= 10


def test_metrics_without_losses(spark):
    got = metrics.trade_metrics(spark.createDataFrame([("X", 5.0, 1), ("X", 0.0, 2)], "symbol string, pnl double, days int")).first()
    assert got["profit_factor"] == metrics.CAP and got["win_rate"] == 0.5 and got["trades"] == 2


def test_sources(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("SPY_full.txt", "2024-01-02,1,2,0.5,1.5,100\n2024-01-03,x,2,1,2\nbad line\n")
    lines = market.zip_lines(spark, str(tmp_path / "*.zip"))
    got = market.bar_lines(lines).orderBy("ts").collect()
    assert [r["symbol"] for r in got] == ["SPY", "SPY"] and got[0]["volume"] == 100 and math.isnan(got[1]["open"]) and got[1]["volume"] == 0
    for folder, close in (("etf", 1.0), ("stocks", 2.0)):
        bars = series(spark, [close] * 3).select("ts", "open", "high", "low", "close", "volume").withColumnRenamed("ts", "datetime")
        bars.write.parquet(f"{tmp_path}/data/{folder}/AB.parquet")
    catalog = market.catalog(spark, f"file://{tmp_path}/data")
    assert catalog.count() == 2 and market.search(catalog, "a").count() == 2
    chosen, = market.resolve(catalog).collect()
    assert chosen["category"] == "etf" and market.bars(spark, chosen["path"]).where("close = 1.0").count() == 3
    with pytest.raises(ValueError):
        market.safe_symbol("../x")
    actions = market.corporate_actions(spark.createDataFrame([("aapl,2020-08-31,4",), ("aapl,2020,4",), ("aapl,2020-08-30,-1",)], "value string"), "ratio").collect()
    assert [(a["symbol"], a["ratio"]) for a in actions] == [("AAPL", 4.0)]
    market.write_sorted(series(spark, [1, 2, 3]), f"{tmp_path}/sorted", ["ts"])
    assert spark.read.parquet(f"{tmp_path}/sorted").count() == 3


def test_stream_equals_batch(spark, tmp_path):
    rows = [("A", dt.datetime(2024, 1, 1, 9 + k // 20, (k * 3) % 60), k, float(k % 7), 1) for k in range(60)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp, id long, price double, volume long")
    ticks.write.parquet(f"{tmp_path}/ticks")
    stream = live.live_bars(live.tick_stream(spark, f"{tmp_path}/ticks", ticks.schema.simpleString()[7:-1].replace(":", " ")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("live_bars").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("live_bars").collect())) == sorted(map(tuple, live.live_bars(ticks).collect()))


def test_forward_step_refuses_a_shorter_replay(spark):
    rows = [("s", dt.datetime(2024, 1, d), float(d)) for d in range(1, 5)]
    full = spark.createDataFrame(rows, "session string, ts timestamp_ntz, equity double")
    assert live.forward_step(full.where("equity < 3"), full).count() == 2
    with pytest.raises(ValueError):
        live.forward_step(full, full.where("equity < 3"))


@pytest.mark.parametrize("h, least_span", [(1, 4), (5, 8), (20, 1), (7, 1000)])
def test_spaced_places_equal_a_plain_loop(spark, h, least_span):
    draw = np.random.default_rng(h)
    places = {k: sorted(set(draw.integers(0, 400, n).tolist())) for k, n in (("a", 200), ("b", 30), ("c", 1))} | {"d": list(range(100))}
    rows = spark.createDataFrame([(k, i, h) for k, v in places.items() for i in v], "symbol string, i int, h int")
    want = set()
    for k, v in places.items():
        last = None
        for i in v:
            if last is None or i - last >= h:
                want.add((k, last := i))
    for given in (h, "h"):
        got = W.spaced(rows, ["symbol"], given, h, least_span).collect()
        assert {(r["symbol"], r["i"]) for r in got if r["kept"]} == want and len(got) == sum(map(len, places.values()))
    assert W.spaced(rows.limit(0), ["symbol"], "h", h).count() == 0


def test_sign_flips_equal_a_plain_loop(spark):
    import hashlib

    draw = np.random.default_rng(3)
    trades = {"a": draw.normal(5, 20, 40), "b": draw.normal(-5, 20, 12), "few": np.array([3.0] * 9), "flat": np.array([2.0] * 15), "one": np.array([1.0])}
    rows = [(k, i, float(x)) for k, v in trades.items() for i, x in enumerate(v)]
    got = {r["symbol"]: r for r in resampling.sign_flip_test(spark.createDataFrame(rows, "symbol string, id long, pnl double"), 150).collect()}
    value = lambda x: x.mean() / x.std(ddof=1) if len(x) > 1 and x.std(ddof=1) > 0 else 0.0
    for k, v in trades.items():
        bits = [[int(hashlib.md5(f"42:{b}:{i}".encode()).hexdigest()[:15], 16) for i in range(len(v))] for b in range(3)]
        signs = [np.array([1 - 2 * (w >> (p % 60) & 1) for w in bits[p // 60]]) for p in range(150)]
        hits = sum(value(v * s) >= value(v) for s in signs)
        assert (got[k]["n"], got[k]["hits"], got[k]["observed"]) == (len(v), hits, pytest.approx(value(v)))
        assert got[k]["p"] == (pytest.approx((hits + 1) / 151) if len(v) >= 10 else 1.0)


def test_path_summary_takes_values_at_floor_indices(spark):
    values = [90_000.0 + 137.0 * (k * 7 % 50) for k in range(50)]
    paths = spark.createDataFrame([(k, v, 0.01 * k) for k, v in enumerate(values)], "path long, terminal double, max_drawdown double")
    got = resampling.path_summary(paths).first()
    assert [got[f"p{q}"] for q in (5, 25, 50, 75, 95)] == [sorted(values)[int(50 * q / 100)] for q in (5, 25, 50, 75, 95)]
    counts, edges = np.histogram(values, 30)
    assert [c["n"] for c in got["histogram"]] == counts.tolist() and [c["low"] for c in got["histogram"]] == pytest.approx(edges[:-1].tolist())
    flat = resampling.path_summary(spark.createDataFrame([(1, 5.0, 0.0), (2, 5.0, 0.0)], "path long, terminal double, max_drawdown double")).first()
    assert [(c["low"], c["n"]) for c in flat["histogram"]] == [(5.0, 2)] and flat["p95"] == 5.0


def test_adjustment_takes_the_first_later_event(spark):
    import datetime as dt

    bars = series(spark, range(1, 41))
    days = [dt.date(2024, 1, 5), dt.date(2024, 1, 20), dt.date(2024, 2, 1)]
    factors = spark.createDataFrame([("X", day, f) for day, f in zip(days, (0.125, 0.25, 0.5), strict=True)], "symbol string, date date, factor double")
    got = B.adjust(bars, factors).collect()
    for r in got:
        assert r["adj_factor"] == next((f for day, f in zip(days, (0.125, 0.25, 0.5), strict=True) if day > r["ts"].date()), 1.0)
    assert len(got) == 40 and B.adjust(bars, factors.where("symbol = 'Y'")).where("adj_factor <> 1").count() == 0


def test_a_chain_of_similar_patterns_is_one_group(spark):
    names = [f"p{k:02d}" for k in range(40)]
    scanned = spark.createDataFrame([("X", n, 5, float(k)) for k, n in enumerate(names)] + [("Y", "p00", 5, 1.0)], "symbol string, pattern string, horizon int, dsr double")
    pairs = spark.createDataFrame([("X", a, b, 0.9) for a, b in zip(names, names[1:], strict=False)], "symbol string, a string, b string, similarity double")
    assert sorted((r["symbol"], r["pattern"]) for r in patterns.deduplicate(scanned, pairs).collect()) == [("X", "p39"), ("Y", "p00")]


def test_too_many_symbols_are_an_error(spark):
    rows = spark.createDataFrame([(f"s{k:02d}", float(k + t % 3)) for k in range(21) for t in range(5)], "symbol string, ret double").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    with pytest.raises(ValueError, match="21 symbols"):
        portfolio.optimize(rows)
