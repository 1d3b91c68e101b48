"""Conditions as text, compiled to columns: "sma(50) crosses above sma(200) and rsi(14)[1] < 30".

``add`` gives bars a column for each condition.  The text becomes one column expression that
Catalyst optimises with the rest of the plan; indicators and lookbacks that several conditions name are computed once,
in blocks of bars.  Conditions look at bars only; what depends on an open position reads the column of that name, if the
bars have one.

Forms, from the loosest to the tightest: ``A if C else B``; ``or``; ``and``; ``not``; ``==`` ``!=`` ``<`` ``<=`` ``>``
``>=`` ``crosses above`` ``crosses below``; ``+`` ``-``; ``*`` ``/`` ``%``; ``-x``; numbers, ``HH:MM``, "text", true,
false, names, ``f(x, ...)``, ``x[N]`` (x, N bars ago) and parentheses.

A comparison or crossing with a missing value is false, and so is a missing condition; a missing number makes a
sum or product missing.  Division by 0 is missing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators import blocks, indicators
from quantloom.operators.windows import order

#: Names that stand for numbers (fixed values): Monday is 1, January is 1.
DAYS = {d: k for k, d in enumerate("monday tuesday wednesday thursday friday saturday sunday".split(), 1)}
MONTHS = {m: k for k, m in enumerate("january february march april may june july august september october november december".split(), 1)}

_OWN: dict[str, Callable[[], Column]] = {
    "day_of_week": lambda: F.weekday("ts") + 1,
    "month": lambda: F.month("ts"),
    "day_of_month": lambda: F.dayofmonth("ts"),
    "hour": lambda: F.hour("ts"),
    "minute": lambda: F.minute("ts"),
    "week_of_year": lambda: F.weekofyear("ts"),
    "time": lambda: F.date_format("ts", "HH:mm"),
    "minutes_since_open": lambda: F.hour("ts") * 60 + F.minute("ts") - 570,
    # The week from Monday to Sunday that holds the third Friday, the one from the 15th to the 21st.
    "is_expiry_week": lambda: F.dayofmonth(F.date_add(F.to_date("ts"), 4 - F.weekday("ts"))).between(15, 21),
}
#: Those that look at the bars beside: one back, one ahead.
_BESIDE: dict[str, Callable[[], Column]] = {
    "is_first_bar": lambda: F.coalesce(F.lag(F.to_date("ts")).over(order()) != F.to_date("ts"), F.lit(True)),
    "is_last_bar": lambda: F.coalesce(F.lead(F.to_date("ts")).over(order()) != F.to_date("ts"), F.lit(True)),
    "is_quarter_end": lambda: F.coalesce(F.quarter(F.lead("ts").over(order())) != F.quarter("ts"), F.lit(True)),
}
_MONTHLY = "trading_days_left"
_FUNCTIONS: dict[str, tuple[int, Callable[..., Column]]] = {"abs": (1, F.abs), "floor": (1, F.floor), "ceil": (1, F.ceil), "sqrt": (1, F.sqrt), "greatest": (2, F.greatest), "least": (2, F.least)}
_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}
_COMPUTE: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": F.try_divide, "%": lambda a, b: F.when(b != 0, a % F.when(b != 0, b)),
}
_TOKEN = re.compile(r"\s*(?:(?P<time>\d{1,2}:\d\d(?![\w:]))|(?P<number>\d+\.?\d*|\.\d+)(?![\w:])|(?P<name>[A-Za-z_]\w*)|(?P<text>\"[^\"]*\")|(?P<sign>==|!=|<=|>=|[-+*/%<>()\[\],]))")
_WORDS = {"if", "else", "or", "and", "not", "crosses", "above", "below", "true", "false"}


class ConditionError(ValueError):
    """What is wrong with a condition, and where: `place` counts characters from 0."""

    def __init__(self, text: str, place: int, why: str):
        super().__init__(f"{why}, at character {place + 1} of {text!r}")
        self.text, self.place = text, place


@dataclass(frozen=True)
class Leaf:
    """A column of the bars, `back` bars ago."""

    column: str
    back: int


class _Reader:
    """Reads one text from left to right; each method reads what its name says, and its operands before."""

    def __init__(self, text: str, columns: set[str], values: Mapping[str, float]):
        self.text, self.columns, self.values = text, columns, values
        self.declared: list[str] = []
        self.tokens: list[tuple[str, str, int]] = []
        at, end = 0, len(text.rstrip())
        while at < end:
            m = _TOKEN.match(text, at)
            if not m:
                at += len(text[at:]) - len(text[at:].lstrip())
                raise ConditionError(text, at, f"cannot read {text[at]!r}")
            kind = m.lastgroup
            word = m[kind]
            self.tokens.append(("word" if kind == "name" and word in _WORDS else kind, word, m.start(kind)))
            at = m.end()
        self.tokens.append(("end", "the end", end))
        self.k = 0

    def wrong(self, why: str, place: int | None = None) -> ConditionError:
        return ConditionError(self.text, self.tokens[self.k][2] if place is None else place, why)

    def has(self, *words: str) -> str | None:
        """Steps over the next token if it is one of `words`."""
        kind, word, _ = self.tokens[self.k]
        if kind in ("word", "sign") and word in words:
            self.k += 1
            return word
        return None

    def need(self, word: str) -> None:
        if not self.has(word):
            raise self.wrong(f"expected {word!r} and found {self.tokens[self.k][1]!r}")

    def whole(self):
        node = self.choice()
        if self.tokens[self.k][0] != "end":
            raise self.wrong(f"{self.tokens[self.k][1]!r} does not belong here")
        return node

    def choice(self):
        value = self.either()
        if not self.has("if"):
            return value
        condition = self.either()
        self.need("else")
        return ("choice", condition, value, self.choice())

    def either(self):
        node = self.both()
        while self.has("or"):
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.has("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self):
        return ("not", self.negated()) if self.has("not") else self.compared()

    def compared(self):
        left = self.added()
        if sign := self.has(*_COMPARE):
            node = ("compare", sign, left, self.added())
        elif self.has("crosses"):
            way = self.has("above", "below")
            if not way:
                raise self.wrong("expected 'above' or 'below'")
            node = ("cross", way, left, self.added())
        else:
            return left
        if self.tokens[self.k][1] in _COMPARE or self.tokens[self.k][1] == "crosses":
            raise self.wrong("comparisons do not chain")
        return node

    def added(self):
        node = self.multiplied()
        while sign := self.has("+", "-"):
            node = ("compute", sign, node, self.multiplied())
        return node

    def multiplied(self):
        node = self.signed()
        while sign := self.has("*", "/", "%"):
            node = ("compute", sign, node, self.signed())
        return node

    def signed(self):
        return ("compute", "-", ("value", 0), self.signed()) if self.has("-") else self.single()

    def single(self):
        kind, word, place = self.tokens[self.k]
        self.k += 1
        if kind == "number":
            return ("value", float(word) if "." in word else int(word))
        if kind == "text":
            return ("value", word[1:-1])
        if kind == "time":
            hour, minute = map(int, word.split(":"))
            if hour > 23 or minute > 59:
                raise self.wrong(f"{word} is no time of day", place)
            return ("value", f"{hour:02}:{minute:02}")
        if word in ("true", "false"):
            return ("value", word == "true")
        if word == "(" and kind == "sign":
            node = self.choice()
            self.need(")")
            return node
        if kind != "name":
            raise self.wrong(f"expected a value and found {word!r}", place)
        if word in ("has", "no") and self.tokens[self.k][1] == "positions":
            self.k += 1
            if "position_count" not in self.columns:
                raise self.wrong("the bars have no column position_count", place)
            return ("compare", ">" if word == "has" else "==", Leaf("position_count", 0), ("value", 0))
        return self.named(word, place)

    def named(self, word: str, place: int):
        if self.has("("):
            arguments = [] if self.has(")") else [self.choice()]
            while arguments and not self.has(")"):
                self.need(",")
                arguments.append(self.choice())
            if word in _FUNCTIONS:
                if len(arguments) != _FUNCTIONS[word][0]:
                    raise self.wrong(f"{word} takes {_FUNCTIONS[word][0]} value(s)", place)
                return ("call", word, *arguments)
            return self.ago(self.indicator(word, arguments, place))
        if word in self.columns or word in _OWN or word in _BESIDE or word == _MONTHLY:
            return self.ago(Leaf(word, 0))
        if word in self.values:
            return ("value", self.values[word])
        if word in DAYS or word in MONTHS:
            return ("value", (DAYS | MONTHS)[word])
        if word in indicators.DEFAULTS:
            return self.ago(self.indicator(word, [], place))
        raise self.wrong(f"{word!r} is not known", place)

    def indicator(self, word: str, arguments: list, place: int) -> Leaf:
        if any(not isinstance(a, tuple) or a[0] != "value" or not isinstance(a[1], int) or isinstance(a[1], bool) for a in arguments):
            raise self.wrong(f"{word} takes whole numbers", place)
        try:
            found, *more = indicators.parse(":".join([word, *[str(a[1]) for a in arguments]]))
        except ValueError as e:
            raise self.wrong(str(e), place) from None
        if more:
            raise self.wrong(f"{word} names several indicators", place)
        self.declared.append(":".join([found[0], *map(str, found[1])]))
        return Leaf(indicators.column_name(*found), 0)

    def ago(self, leaf: Leaf) -> Leaf:
        if not self.has("["):
            return leaf
        kind, word, place = self.tokens[self.k]
        if kind != "number" or "." in word:
            raise self.wrong("expected a whole number of bars", place)
        self.k += 1
        self.need("]")
        return Leaf(leaf.column, int(word))


def _shifted(node, by: int):
    """The node as it was `by` bars ago."""
    if isinstance(node, Leaf):
        return Leaf(node.column, node.back + by)
    return tuple(_shifted(x, by) if isinstance(x, (tuple, Leaf)) else x for x in node) if node[0] != "value" else node


def _leaves(node) -> set[Leaf]:
    if isinstance(node, Leaf):
        return {node}
    if node[0] == "value":
        return set()
    found = set().union(*[_leaves(x) for x in node[1:] if isinstance(x, (tuple, Leaf))])
    return found | {Leaf(x.column, x.back + 1) for x in found} if node[0] == "cross" else found


def _column(node, of: Callable[[Leaf], Column]) -> Column:
    if isinstance(node, Leaf):
        return of(node)
    kind, *rest = node
    true = lambda x: F.coalesce(_column(x, of).cast("boolean"), F.lit(False))
    if kind == "value":
        return F.lit(rest[0])
    if kind == "choice":
        return F.when(true(rest[0]), _column(rest[1], of)).otherwise(_column(rest[2], of))
    if kind in ("and", "or"):
        return true(rest[0]) & true(rest[1]) if kind == "and" else true(rest[0]) | true(rest[1])
    if kind == "not":
        return ~true(rest[0])
    if kind == "call":
        return _FUNCTIONS[rest[0]][1](*[_column(x, of) for x in rest[1:]])
    sign, a, b = rest
    if kind == "compute":
        return _COMPUTE[sign](_column(a, of), _column(b, of))
    if kind == "compare":
        return F.coalesce(_COMPARE[sign](_column(a, of), _column(b, of)), F.lit(False))
    now, then = (">", "<=") if sign == "above" else ("<", ">=")
    before = [_column(_shifted(x, 1), of) for x in (a, b)]
    return F.coalesce(_COMPARE[now](_column(a, of), _column(b, of)) & _COMPARE[then](*before), F.lit(False))


def add(bars: DataFrame, conditions: Mapping[str, str], values: Mapping[str, float] | None = None, span: str = "month", size: int | None = None) -> DataFrame:
    """`bars` (symbol, ts, prices) with a column for each condition.

    values: numbers by name, for conditions and for indicators' parameters.  Names are looked up among the bars'
    columns, the calendar, `values`, days and months, indicators.  A text that cannot be read is a ConditionError.
    span, size: as in `blocks`.
    """
    readers = {k: _Reader(text, set(bars.columns), dict(values or {})) for k, text in conditions.items()}
    trees = {k: r.whole() for k, r in readers.items()}
    leaves = set().union(*[_leaves(t) for t in trees.values()]) if trees else set()
    named = {x.column for x in leaves} - set(bars.columns)
    declared = list(dict.fromkeys(d for r in readers.values() for d in r.declared))
    place = {"span": span, "size": size}
    rows = indicators.add(bars, declared, **place) if declared else bars
    rows = rows.withColumns({k: f() for k, f in _OWN.items() if k in named})
    if _MONTHLY in named:  # days of the month with bars that are still to come
        month = Window.partitionBy("symbol", F.date_trunc("month", "ts"))
        rows = rows.withColumn(_MONTHLY, F.dense_rank().over(month.orderBy(F.desc(F.to_date("ts")))) - 1)
    rows = blocks.placed(rows, span=span)
    beside = {k: f() for k, f in _BESIDE.items() if k in named}
    if beside:
        rows = blocks.in_blocks(rows, lambda b: b.withColumns(beside), 1, 1, **place)
    held = {x: f"__ago_{k}" for k, x in enumerate(sorted((x for x in leaves if x.back), key=lambda x: (x.column, x.back)))}
    if held:
        ago = {name: F.lag(x.column, x.back).over(order()) for x, name in held.items()}
        rows = blocks.in_blocks(rows, lambda b: b.withColumns(ago), max(x.back for x in held), **place)
    of = lambda x: F.col(f"`{held.get(x, x.column)}`")
    truth = lambda t: F.coalesce(_column(t, of), F.lit(False)) if not isinstance(t, Leaf) and t[0] in ("and", "or", "not", "compare", "cross") else _column(t, of)
    return rows.select(*bars.columns, *[truth(t).alias(k) for k, t in trees.items()])
