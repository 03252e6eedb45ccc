"""DuckDB SQL for recursions over samples and for geometry of 2 x 2 matrices, which the catalog's SQL is put together from.

Written from definitions, not from the library's code: filters as state recursions sample by sample, matrix functions through
the eigenvalues of a 2 x 2 matrix, means as fixed points of the Karcher flow.
"""

from __future__ import annotations

from collections.abc import Sequence

Section = tuple[Sequence[float], Sequence[float]]
Symmetric = tuple[str, str, str]


def number(x: float) -> str:
    return f"({float(x)!r}::double)"


# ---- filters: tables with trial_id, ch, s (from 0) and v ----


def filtered(source: str, name: str, sections: Sequence[Section], first: str | None = None) -> str:
    """CTEs that end in ``name``: ``source`` through sections (b, a), from rest, or with ``first`` (a table of each line's first
    value u) from the state that this value for ever has led to."""
    keys = "trial_id, ch"
    states, starts, gain = [], [], 1.0
    for i, (b, a) in enumerate(sections):
        order = max(len(a), len(b)) - 1
        b, a = ([float(v) / float(a[0]) for v in c] + [0.0] * (order + 1 - len(c)) for c in (b, a))
        own = sum(b) / sum(a)
        states.append((b, a, order))
        starts += [gain * sum(b[j] - a[j] * own for j in range(k, order + 1)) for k in range(1, order + 1)]
        gain *= own
    held = [f"z{i}_{k}" for i, (_, _, order) in enumerate(states) for k in range(1, order + 1)]
    columns, y = [], "u"
    for i, (b, a, order) in enumerate(states):
        columns.append(f"{number(b[0])} * {y} + z{i}_1 as y{i}" if order else f"{number(b[0])} * {y} as y{i}")
        for k in range(1, order + 1):
            more = f" + z{i}_{k + 1}" if k < order else ""
            columns.append(f"{number(b[k])} * {y} - {number(a[k])} * y{i}{more} as n{i}_{k}")
        y = f"y{i}"
    new = ", ".join(h.replace("z", "n", 1) for h in held)
    begin = ", ".join(f"{number(z)} * u as {h}" if first else f"0.0::double as {h}" for h, z in zip(held, starts))
    return f"""{name}_r as (
    select {keys}, -1::bigint as s, 0.0::double as v, {begin} from {first or f'(select distinct {keys} from {source})'}
    union all
    select {keys}, s, {y}, {new} from (
      select *, {', '.join(columns)} from (select r.{keys.replace(', ', ', r.')}, x.s, x.v as u, {', '.join('r.' + h for h in held)}
        from {name}_r r join {source} x on r.trial_id = x.trial_id and r.ch = x.ch and x.s = r.s + 1))),
  {name} as (select {keys}, s, v from {name}_r where s >= 0)"""


def there_and_back(source: str, name: str, sections: Sequence[Section], samples: int, pad: int) -> str:
    """CTEs that end in ``name``: forward-backward filtering with odd extensions of ``pad`` samples."""
    n = samples + 2 * pad
    ends = f"(select l.trial_id, l.ch, l.v as v0, r.v as v1 from {source} l join {source} r on l.trial_id = r.trial_id and l.ch = r.ch where l.s = 0 and r.s = {samples - 1})"
    extended = f"""{name}_e as (
    select e.trial_id, e.ch, q.s::bigint as s, case when q.s < {pad} then 2 * e.v0 - x.v when q.s < {pad + samples} then x.v else 2 * e.v1 - x.v end as v
    from {ends} e cross join range({n}) as q(s)
    join {source} x on x.trial_id = e.trial_id and x.ch = e.ch
      and x.s = case when q.s < {pad} then {pad} - q.s when q.s < {pad + samples} then q.s - {pad} else {2 * samples - 2 + pad} - q.s end)"""
    first = lambda t: f"(select trial_id, ch, v as u from {t} where s = 0)"
    back = f"{name}_b as (select trial_id, ch, {n - 1} - s as s, v from {name}_f)"
    last = f"{name} as (select trial_id, ch, {n - 1 - pad} - s as s, v from {name}_g where s between {pad} and {n - 1 - pad})"
    return ",\n  ".join([extended, filtered(f"{name}_e", f"{name}_f", sections, first(f"{name}_e")), back, filtered(f"{name}_b", f"{name}_g", sections, first(f"{name}_b")), last])


# ---- symmetric 2 x 2 matrices as three expressions: (1, 1), (1, 2), (2, 2) ----


def function_of(m: Symmetric, f: str) -> Symmetric:
    """f(M) by the eigenvalues; ``f`` is SQL with {} for its argument."""
    a, b, c = m
    mid, half = f"((({a}) + ({c})) / 2)", f"sqrt((({a}) - ({c})) * (({a}) - ({c})) / 4 + ({b}) * ({b}))"
    upper, lower = f.format(f"({mid} + {half})"), f.format(f"({mid} - {half})")
    slope = f"(case when {half} > 1e-14 then (({upper}) - ({lower})) / (2 * {half}) else 0 end)"
    level = f"((({upper}) + ({lower})) / 2 - {slope} * {mid})"
    return f"({level} + {slope} * ({a}))", f"({slope} * ({b}))", f"({level} + {slope} * ({c}))"


def about(w: Symmetric, x: Symmetric) -> Symmetric:
    """W X W."""
    (a, b, c), (p, q, r) = w, x
    top, side = f"(({a}) * ({p}) + ({b}) * ({q}))", f"(({a}) * ({q}) + ({b}) * ({r}))"
    left, low = f"(({b}) * ({p}) + ({c}) * ({q}))", f"(({b}) * ({q}) + ({c}) * ({r}))"
    return f"({top} * ({a}) + {side} * ({b}))", f"({top} * ({b}) + {side} * ({c}))", f"({left} * ({b}) + {low} * ({c}))"


LOG, EXP, ROOT, INVERSE_ROOT = "ln({})", "exp({})", "sqrt({})", "(1 / sqrt({}))"


def named(m: Symmetric, names: str) -> str:
    return ", ".join(f"{e} as {n}" for e, n in zip(m, names.split()))


def squared_distance(m: Symmetric, x: Symmetric) -> str:
    """Squared affine-invariant distance, through the eigenvalues of M^-1 X."""
    (a, b, c), (p, q, r) = m, x
    det = f"(({a}) * ({c}) - ({b}) * ({b}))"
    trace = f"((({c}) * ({p}) - 2 * ({b}) * ({q}) + ({a}) * ({r})) / {det})"
    whole = f"((({p}) * ({r}) - ({q}) * ({q})) / {det})"
    half = f"sqrt(greatest({trace} * {trace} / 4 - {whole}, 0))"
    return f"(pow(ln({trace} / 2 + {half}), 2) + pow(ln({whole} / ({trace} / 2 + {half})), 2))"


def karcher(source: str, name: str, rounds: int = 40) -> str:
    """CTEs that end in ``name`` (g, a, b, c): means of the matrices (g, a, b, c) of ``source`` for each g."""
    return f"""{name}_r as (
    select g, 0 as n, avg(a) as a, avg(b) as b, avg(c) as c from {source} group by g
    union all
    select g, n + 1, {named(about(('ra', 'rb', 'rc'), function_of(('ja', 'jb', 'jc'), EXP)), 'a b c')} from (
      select g, n, any_value(ra) as ra, any_value(rb) as rb, any_value(rc) as rc, avg(la) as ja, avg(lb) as jb, avg(lc) as jc from (
        select g, n, ra, rb, rc, {named(function_of(('xa', 'xb', 'xc'), LOG), 'la lb lc')} from (
          select g, n, ra, rb, rc, {named(about(('wa', 'wb', 'wc'), ('a', 'b', 'c')), 'xa xb xc')} from (
            select m.g, m.n, m.ra, m.rb, m.rc, m.wa, m.wb, m.wc, x.a, x.b, x.c from (
              select g, n, {named(function_of(('a', 'b', 'c'), ROOT), 'ra rb rc')}, {named(function_of(('a', 'b', 'c'), INVERSE_ROOT), 'wa wb wc')}
              from {name}_r where n < {rounds}) m join {source} x on x.g = m.g))) group by g, n)),
  {name} as (select g, a, b, c from {name}_r where n = {rounds})"""
