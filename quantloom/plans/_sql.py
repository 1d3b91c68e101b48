"""Pieces of DuckDB SQL for what DuckDB has no function for: distribution tails, linear systems."""

from __future__ import annotations

STEPS = 2000


def _simpson(f: str, upper: str) -> str:
    """The integral of f (an expression of @) from 0 to `upper`."""
    x = f"(k * ({upper}) / {STEPS})"
    weight = f"case when k in (0, {STEPS}) then 1 when k % 2 = 1 then 4 else 2 end"
    return f"(({upper}) / {3 * STEPS} * list_sum(list_transform(range({STEPS + 1}), lambda k: ({weight}) * {f.replace('@', x)})))"


def t_two_sided(t: str, df: str) -> str:
    """Two-sided p of Student's t, by Simpson's rule."""
    front = f"2 * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(({df}) * pi())"
    return f"greatest(1 - {front} * {_simpson(f'pow(1 + pow(@, 2) / ({df}), -(({df}) + 1) / 2.0)', f'abs({t})')}, 0)"


def normal_cdf(z: str) -> str:
    """The normal distribution function, by Simpson's rule; beyond 9 deviations 0 or 1."""
    return f"(0.5 + sign({z}) * {_simpson('exp(-pow(@, 2) / 2)', f'least(abs({z}), 9)')} / sqrt(2 * pi()))"


def inverse(name: str, source: str, k: int, keep: str = "") -> str:
    """CTEs that end in `name`: w_i_j, the inverse of the k x k matrix m_i_j of `source`, by elimination; columns `keep` go along."""
    cells = [(i, j) for i in range(k) for j in range(k)]
    out = [f"{name}_0 as (select *, {', '.join(f'{float(i == j)!r} as w_{i}_{j}' for i, j in cells)} from {source})"]
    keep = f", {keep}" if keep else ""
    for p in range(k):
        of = lambda x, i, j, p=p: f"{x}_{i}_{j} / m_{p}_{p} as {x}_{i}_{j}" if i == p else f"{x}_{i}_{j} - m_{i}_{p} * {x}_{p}_{j} / m_{p}_{p} as {x}_{i}_{j}"
        out.append(f"{name}_{p + 1} as (select {', '.join(of(x, i, j) for x in 'mw' for i, j in cells)}{keep} from {name}_{p})")
    return ",\n  ".join([*out, f"{name} as (select * from {name}_{k})"])


def ols(name: str, source: str, xs: list[str], y: str, by: str = "") -> str:
    """CTEs that end in `name`: b0 (the constant's) ... bk, their errors e0 ... ek, rss, tss, n of a least-squares fit over the whole rows, one for each `by`."""
    columns, k = ["1.0", *xs], len(xs) + 1
    sums = [f"sum({columns[i]} * {columns[j]}) as m_{i}_{j}" for i in range(k) for j in range(k)] + [f"sum({c} * {y}) as v_{i}" for i, c in enumerate(columns)]
    whole = " and ".join(f"{c} is not null" for c in [*xs, y])
    keep = ", ".join([*[f"v_{i}" for i in range(k)], "yy", "tss", "n", *([by] if by else [])])
    first = f"{name}_s as (select {by + ', ' if by else ''}{', '.join(sums)}, sum({y} * {y}) as yy, var_pop({y}) * count(*) as tss, count(*) as n from {source} where {whole}{f' group by {by}' if by else ''})"
    b = [" + ".join(f"w_{i}_{j} * v_{j}" for j in range(k)) for i in range(k)]
    fit = f"{name}_b as (select *, {', '.join(f'{x} as b{i}' for i, x in enumerate(b))} from {name}_i)"
    rss = f"{name}_r as (select *, yy - ({' + '.join(f'b{i} * v_{i}' for i in range(k))}) as rss from {name}_b)"
    errors = ", ".join(f"sqrt(rss / (n - {k}) * w_{i}_{i}) as e{i}" for i in range(k))
    return ",\n  ".join([first, inverse(f"{name}_i", f"{name}_s", k, keep), fit, rss, f"{name} as (select *, {errors} from {name}_r)"])
