"""Every registered market query runs on the smallest tables; those with SQL equal DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from quantloom import plans

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, name):
    got = QUERIES[name](spark, SMALL).toArrow()
    db.register("got", got)
    columns = ", ".join(f'"{c}"' for c in sorted(got.column_names))
    assert sorted(db.sql(SQL[name]).columns) == sorted(got.column_names)
    db.sql(f"create or replace table want_ as select {columns} from ({SQL[name]})")
    db.sql(f"create or replace table got_ as select {columns} from got")
    assert db.sql("from want_ except all from got_").fetchall() == []
    assert db.sql("from got_ except all from want_").fetchall() == []


def bars_of(db):
    return db.sql("select o_orderpriority as symbol, o_orderdate as ts, arg_min(o_totalprice, o_orderkey) as open, max(o_totalprice) as high, min(o_totalprice) as low, arg_max(o_totalprice, o_orderkey) as close from orders group by 1, 2 order by 1, 2").df()


def check_b1_backtest_trades(got, db):
    assert ((got.exit_price - got.entry_price) * got.quantity - got.pnl).abs().max() < 0.01
    # A position entered on the last bar ends there.
    assert ((got.exit_ts > got.entry_ts) | ((got.exit_ts == got.entry_ts) & (got.reason == "end_of_data"))).all() and set(got.reason) <= {"profit_target", "stop_loss", "signal", "end_of_data"}
    opens = bars_of(db).set_index(["symbol", "ts"]).open
    assert all(opens[(t.symbol, t.entry_ts)] == pytest.approx(t.entry_price) for t in got.itertuples())
    for _, one in got.sort_values("entry_ts").groupby("symbol"):
        assert (one.entry_ts.values[1:] >= one.exit_ts.values[:-1]).all()


def check_b8_equity_curve(got, db):
    bars = bars_of(db)
    assert len(got) == len(bars) and not got.equity.isna().any()
    assert (got.sort_values("ts").groupby("symbol").equity.first() == 100_000).all()


def check_b7_wheel(got, db):
    for _, one in got.sort_values("entry_ts").groupby("symbol"):
        held = False
        for t in one.itertuples():
            assert t.kind == ("c" if held else "p") and t.exit_ts > t.entry_ts
            assert t.exit in (("expiration", "called_away") if held else ("expiration", "assignment"))
            assert t.exit == "called_away" or t.stock_pnl == 0
            held = {"assignment": True, "called_away": False}.get(t.exit, held)


def check_i_all_at_once(got, db):
    db.register("got_all", got)
    want = db.sql("""select symbol, ts, avg(close) over w as sma, max(high) over w as top, stddev_pop(close) over w as sd, count(*) over w as n, (close / lag(close, 12) over v - 1) * 100 as roc
      from got_all window w as (partition by symbol order by ts rows 19 preceding), v as (partition by symbol order by ts)""").df()
    both = got.merge(want, on=["symbol", "ts"])
    full = both[both.n == 20]
    assert len(both) == len(got) and len(full) and both[both.n < 20].sma_20.isna().all()
    for column, plain in (("sma_20", full.sma), ("donchian_upper_20", full.top), ("bbands_upper_20_20", full.sma + 2 * full.sd), ("roc_12", full.roc), ("std_20", full.sd)):
        assert full[column].values == pytest.approx(plain.values, nan_ok=True)
    for name, sql in SQL.items():  # the walks, as their own queries have them
        if name in ("i17_psar", "i19_supertrend"):
            column = {"i17_psar": "psar_2_20", "i19_supertrend": "supertrend_10_30"}[name]
            one = got[["symbol", "ts", column]].merge(db.sql(sql).df(), on=["symbol", "ts"])
            assert one[column].round(4).values == pytest.approx(one.value.values, abs=1e-3, nan_ok=True)


def check_p11_hmm_states(got, db):
    assert set(got.state) <= {0, 1} and set(got.online) <= {0, 1} and len(got) == len(bars_of(db)) - got.symbol.nunique()
    for _, one in got.groupby("symbol"):  # states are ordered by their mean return
        assert one[one.state == 0].ret.mean() < one[one.state == 1].ret.mean()


def check_p12_hmm_online(got, db):
    assert got.n.sum() == len(bars_of(db)) - got.symbol.nunique() and not got.duplicated(["symbol", "online"]).any()


def check_p18_monte_carlo(got, db):
    assert (got.n == 2000).all() and ((got.p5 <= got.p25) & (got.p25 <= got.p50) & (got.p50 <= got.p75) & (got.p75 <= got.p95)).all()
    assert all(sum(c["n"] for c in h) == 2000 and len(h) == 30 for h in got.histogram)
    assert ((got.below_50 <= got.below_75) & (got.below_75 <= got.below_90) & (got.below_90 <= got.below_100)).all() and (got.median_drawdown <= got.p95_drawdown).all()
    assert got.symbol.nunique() == len(got) == 5


def check_v2_grid_sweep(got, db):
    assert len(got) == 4 * bars_of(db).symbol.nunique() and not got.duplicated(["symbol", "combo"]).any()
    traded = got[got.trades > 0]
    assert ((traded.win_rate >= 0) & (traded.win_rate <= 1) & (traded.max_drawdown <= 1)).all()
    assert (traded.avg_pnl * traded.trades / 100_000).values == pytest.approx(traded.total_return.values, rel=1e-3)


def check_v3_bayesian_search(got, db):
    assert len(got) == got.window.nunique() <= 8 and set(got.window) <= set(range(5, 46, 5)) and not got.sharpe.isna().any()


def check_v4_walk_forward(got, db):
    assert not got.duplicated(["symbol", "window"]).any() and set(got.combo) <= {0, 1} and set(got.window) <= {0, 1, 2, 3}


def check_v5_gates(got, db):
    assert len(got) == bars_of(db).symbol.nunique() and got.p.between(1 / 201, 1).all() and set(got.stability.dropna()) <= {"stable", "moderate", "unstable"}


def check_v6_evaluation(got, db):
    assert len(got) == 6 * bars_of(db).symbol.nunique() and set(got.verdict) <= {"strong", "acceptable", "weak"} and not got.duplicated(["symbol", "variant"]).any()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_values_without_sql(spark, db, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert len(got)
    globals()[f"check_{name}"](got, db)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
