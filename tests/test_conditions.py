"""Conditions as text: forms, missing values, block borders, and what is said of texts that cannot be read."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quantloom.operators import conditions as C

CLOSES = [10.0, 11.0, 9.0, 12.0, None, 8.0, 8.0, 13.0, 7.0, 14.0]


@pytest.fixture(scope="module")
def bars(spark):
    rows = [("s", datetime(2024, 3, 11, 9, 30) + timedelta(hours=9 * i), x, float((x or 0) + i % 3), x, x, i, i % 2) for i, x in enumerate(CLOSES)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long, position_count int").cache()


def of(bars, text: str, **more) -> list:
    return [r["x"] for r in C.add(bars, {"x": text}, **more).orderBy("ts").select("x").collect()]


def each(f) -> list:
    """f(i) of each bar, False where a value is missing."""
    out = []
    for i in range(len(CLOSES)):
        try:
            out.append(bool(f(i)))
        except (TypeError, IndexError):
            out.append(False)
    return out


def at(i: int, back: int = 0):
    if i - back < 0:
        raise IndexError
    return CLOSES[i - back]


def high(i: int, back: int):
    if i - back < 0:
        raise IndexError
    return (CLOSES[i - back] or 0) + (i - back) % 3


@pytest.mark.parametrize("size", [1, 3])
@pytest.mark.parametrize(
    ("text", "plain"),
    [
        ("close > close[1]", lambda i: at(i) > at(i, 1)),
        ("close crosses above 10", lambda i: at(i) > 10 and at(i, 1) <= 10),
        ("close crosses below close[3]", lambda i: at(i) < at(i, 3) and at(i, 1) >= at(i, 4)),
        ("close + 1 crosses above high[2] * 1.1", lambda i: at(i) + 1 > high(i, 2) * 1.1 and at(i, 1) + 1 <= high(i, 3) * 1.1),
        ("close[2] - close[1] * 2 < -10 / 1", lambda i: at(i, 2) - at(i, 1) * 2 < -10),
        ("sma(2) > 10 and volume % 2 == 1", lambda i: (at(i) + at(i, 1)) / 2 > 10 and i % 2 == 1),
        ("close[0] >= close", lambda i: at(i) >= at(i)),
        ("volume == 3 or volume == 5 and close == 8 and not volume == 9", lambda i: i == 3 or i == 5),
    ],
)
def test_lookbacks_over_block_borders(bars, text, plain, size):
    assert of(bars, text, size=size) == each(plain)


def test_missing_values_compare_as_false(bars):
    assert of(bars, "close == close")[4] is False and of(bars, "not close > 0")[4] is True
    assert of(bars, "close > 0 or true")[4] is True
    assert of(bars, "close + 1")[4] is None and of(bars, "volume / 0")[2] is None and of(bars, "volume % 0 == 0")[2] is False
    assert of(bars, "1 if close > 0 else 2")[4] == 2
    assert of(bars, "close[100] < 1") == [False] * len(CLOSES)


def test_calendar_names_and_times(bars):
    stamps = [r["ts"] for r in bars.orderBy("ts").collect()]
    assert of(bars, "day_of_week == monday or day_of_week > 6") == [t.isoweekday() in (1, 7) for t in stamps]
    assert of(bars, "time >= 9:30 and time < 18:00 and month == march") == [(t.hour, t.minute) >= (9, 30) and t.hour < 18 for t in stamps]
    days = [t.date() for t in stamps]
    assert of(bars, "is_first_bar") == [i == 0 or days[i] != days[i - 1] for i in range(len(days))]
    assert of(bars, "is_last_bar[1]")[1:] == [i + 1 == len(days) or days[i] != days[i + 1] for i in range(len(days) - 1)]
    left = sorted(set(days), reverse=True)
    assert of(bars, "trading_days_left") == [left.index(d) for d in days]
    assert of(bars, "is_expiry_week") == [d <= datetime(2024, 3, 17).date() for d in days]  # the third Friday is the 15th
    assert of(bars, "minutes_since_open == 0") == [t.hour == 9 and t.minute == 30 for t in stamps]


def test_nesting_parameters_and_calls(bars):
    assert of(bars, "1 if volume > 7 else 2 if volume > 3 else (3 if volume > 1 else 4) * 10") == [40, 40, 30, 30, 2, 2, 2, 2, 1, 1]
    assert of(bars, "2 + 3 * 4 - -1 == 15 and not (1 > 2 or false)") == [True] * 10
    assert of(bars, "least(volume, edge) + abs(-edge)", values={"edge": 4}) == [min(i, 4) + 4 for i in range(10)]
    assert of(bars, "sma(n) == sma(2)", values={"n": 2}) == of(bars, "sma(2) == sma(2)")
    assert of(bars, "has positions") == [i % 2 == 1 for i in range(10)] and of(bars, "no positions") == [i % 2 == 0 for i in range(10)]
    assert of(bars, "not not has positions") == of(bars, "has positions")
    got = C.add(bars, {"a": "sma(2) > 9", "b": "sma(2)[1] > 9", "c": 'time == "09:30"'})
    assert got.columns == [*bars.columns, "a", "b", "c"] and C.add(bars, {}).columns == bars.columns
    assert C.add(bars.limit(0), {"a": "sma(2) > close[3] and is_first_bar"}).count() == 0


@pytest.mark.parametrize(
    ("text", "place", "why"),
    [
        ("close >", 7, "expected a value"),
        ("", 0, "expected a value"),
        ("close & 1", 6, "cannot read"),
        ("close > 1 2", 10, "does not belong"),
        ("clsoe > 1", 0, "not known"),
        ("(close > 1", 10, "expected ')'"),
        ("close crosses over 1", 14, "above"),
        ("close < 1 < 2", 10, "do not chain"),
        ("time > 25:00", 7, "no time of day"),
        ("close[-1] > 1", 6, "whole number"),
        ("close[1.5] > 1", 6, "whole number"),
        ("sma(close) > 1", 0, "whole numbers"),
        ("sma(2, 3) > 1", 0, "too many"),
        ("sma(0) > 1", 0, "1 or more"),
        ("bbands(20) > 1", 0, "several"),
        ("abs(1, 2) > 1", 0, "takes 1"),
        ("1 if close > 2", 14, "expected 'else'"),
        ("close and", 9, "expected a value"),
        ("no positionz", 0, "not known"),
        ("3x > 1", 0, "cannot read"),
    ],
)
def test_bad_texts_name_the_place(bars, text, place, why):
    with pytest.raises(C.ConditionError, match=why.replace("(", r"\(").replace(")", r"\)")) as e:
        C.add(bars, {"x": text})
    assert e.value.place == place and repr(text) in str(e.value)


def test_a_position_needs_its_column(bars):
    with pytest.raises(C.ConditionError, match="position_count"):
        C.add(bars.drop("position_count"), {"x": "close > 1 and has positions"})


def test_equal_lookbacks_and_indicators_are_computed_once(bars):
    got = C.add(bars, {"a": "sma(3)[1] > close", "b": "close > sma(3)[1] and sma(3)[1] > 0", "c": "sma(3) crosses above close"})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lag(sma_3") == 1 and plan.count("lag(close") == 1
    assert "ArrowEval" not in plan and "Python" not in plan and F is not None
