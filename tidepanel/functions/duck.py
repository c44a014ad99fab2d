"""The same expressions as SQL text for DuckDB, to check results against another engine.

Every function has its own SQL here; nothing is shared with the Spark side but the
expression itself.
"""

from __future__ import annotations

from .expr import NUDGE, Expr

W = "(PARTITION BY code ORDER BY date ROWS BETWEEN {p} PRECEDING AND CURRENT ROW)"
_PLAIN = {
    "add": "({0} + {1})", "sub": "({0} - {1})", "mul": "({0} * {1})", "div": "(CAST({0} AS DOUBLE) / nullif(CAST({1} AS DOUBLE), 0))",
    "lt": "({0} < {1})", "le": "({0} <= {1})", "gt": "({0} > {1})", "ge": "({0} >= {1})", "and": "({0} AND {1})", "or": "({0} OR {1})", "same": "({0} = {1})",
    "abs": "abs({0})", "log": "CASE WHEN {0} > 0 THEN ln({0}) END", "exp": "exp({0})", "sqrt": "CASE WHEN {0} >= 0 THEN sqrt({0}) END", "sign": "CAST(sign({0}) AS DOUBLE)", "cbrt": "cbrt({0})", "sin": "sin({0})", "acos": "CASE WHEN abs({0}) <= 1 THEN acos({0}) END", "atan2": "CASE WHEN {0} <> 0 OR {1} <> 0 THEN atan2({0}, {1}) END",
    "pow": "pow({0}, {1})", "spow": "(sign({0}) * pow(abs({0}), {1}))", "max2": "CASE WHEN {0} IS NOT NULL AND {1} IS NOT NULL THEN greatest({0}, {1}) END", "min2": "CASE WHEN {0} IS NOT NULL AND {1} IS NOT NULL THEN least({0}, {1}) END",
    "where": "CASE WHEN {0} THEN {1} ELSE {2} END", "coalesce": "coalesce({0}, {1})",
}
_ROLLING = {"ts_sum": "sum({0})", "ts_mean": "avg({0})", "ts_min": "min({0})", "ts_max": "max({0})", "stddev": "stddev_pop({0})", "stddev_s": "stddev_samp({0})", "variance": "var_pop({0})", "ts_median": "quantile_cont({0}, 0.5)"}
_PAIRED = {"covariance": "covar_pop({a}, {b})", "std_x": "stddev_pop({a})", "slope": "regr_slope({a}, {b})", "intercept": "regr_intercept({a}, {b})"}
_CROSS = {"cs_mean": "avg({0})", "cs_sum": "sum({0})", "cs_std": "stddev_pop({0})", "cs_std_s": "stddev_samp({0})", "cs_min": "min({0})", "cs_max": "max({0})", "cs_count": "count({0})"}


def _text(e: Expr, a: list[str]) -> str:
    n, p = e.name, e.params
    if n == "col":
        return p[0]
    if n == "lit":
        return f"CAST({p[0]!r} AS DOUBLE)"
    if n in _PLAIN:
        return _PLAIN[n].format(*a)
    if n in _ROLLING:
        w = W.format(p=p[0] - 1)
        return f"CASE WHEN count({a[0]}) OVER {w} >= {p[1]} THEN {_ROLLING[n].format(a[0])} OVER {w} END"
    if n in _PAIRED:
        w, both = W.format(p=p[0] - 1), f"{a[0]} IS NOT NULL AND {a[1]} IS NOT NULL"
        x, y = (f"CASE WHEN {both} THEN {v} END" for v in a)
        return f"CASE WHEN count(CASE WHEN {both} THEN 1 END) OVER {w} = {p[0]} THEN {_PAIRED[n].format(a=x, b=y)} OVER {w} END"
    if n == "nearest":
        return f"round({a[0]}, {p[0]})"
    if n == "null":
        return "CAST(NULL AS DOUBLE)"
    if n == "row_index":
        return "CAST(row_number() OVER (PARTITION BY code ORDER BY date) AS DOUBLE)"
    if n == "groups":
        return f"list_filter(list_sort(list(DISTINCT CASE WHEN {a[2]} > 0 AND {a[0]} IS NOT NULL THEN struct_pack(g := {a[0]}, s := {a[1]}, n := {a[2]}) END) OVER (PARTITION BY date)), lambda q: q IS NOT NULL)"
    if n == "neutralize":
        return f"({a[0]} - list_reduce({a[1]}, lambda c, q: c + (q.s - q.n * c) / nullif({a[2]}, 0), CAST(0 AS DOUBLE)))"
    if n == "history":
        return f"list({a[0]}) FILTER ({a[0]} IS NOT NULL) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING)"
    if n == "known":
        return f"count({a[0]}) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING)"
    if n == "exponential":
        return f"CASE WHEN {a[0]} IS NOT NULL AND {a[2]} >= {p[0]} THEN list_reduce({a[1]}[{p[0] + 1}:], lambda y, q: y * {1 - p[1]!r} + q * {p[1]!r}, list_sum({a[1]}[:{p[0]}]) / {p[0]}) END"
    if n in ("picked_low", "picked_high"):
        w = W.format(p=p[0] - 1)
        both = f"{a[0]} IS NOT NULL AND {a[1]} IS NOT NULL"
        pairs = f"list(struct_pack(b := {'' if n == 'picked_low' else '-'}{a[1]}, t := date, a := {a[0]})) FILTER ({both}) OVER {w}"
        return f"CASE WHEN len({pairs}) = {p[0]} THEN list_sum(list_transform(list_sort({pairs})[:{p[1]}], lambda q: q.a)) END"
    if n in ("ts_skew", "ts_kurt"):
        # Population moments about the window's mean, from the collected window.
        w = W.format(p=p[0] - 1)
        every = f"list({a[0]}) FILTER ({a[0]} IS NOT NULL) OVER {w}"
        mean, var, power, less = f"avg({a[0]}) OVER {w}", f"var_pop({a[0]}) OVER {w}", 3 if n == "ts_skew" else 4, 0 if n == "ts_skew" else 3
        return f"CASE WHEN count({a[0]}) OVER {w} >= {p[1]} THEN list_sum(list_transform({every}, lambda q: pow(q - {mean}, {power}))) / len({every}) / nullif(pow({var}, {power / 2}), 0) - {less} END"
    if n == "ts_count":
        return f"sum(CASE WHEN {a[0]} THEN 1.0 ELSE 0.0 END) OVER {W.format(p=p[0] - 1)}"
    if n in ("delay", "lead"):
        return f"{'lag' if n == 'delay' else 'lead'}({a[0]}, {p[0]}) OVER (PARTITION BY code ORDER BY date)"
    if n in ("ts_rank", "ts_argmax", "ts_argmin"):
        w = W.format(p=p[0] - 1)
        every, count = f"list({a[0]}) OVER {w}", f"count({a[0]}) OVER {w}"
        if n == "ts_rank":
            value = f"CASE WHEN {a[0]} IS NULL THEN NULL WHEN {count} = 1 THEN 0.5 ELSE (len(list_filter({every}, lambda q: q < {a[0]})) + 0.5 * (len(list_filter({every}, lambda q: q = {a[0]})) - 1)) / ({count} - 1) END"
        else:
            value = f"(list_position(list_reverse({every}), {'max' if n == 'ts_argmax' else 'min'}({a[0]}) OVER {w}) - 1) / {float(p[0])!r}"
        return f"CASE WHEN {count} >= {p[1]} THEN {value} END"
    if n in ("ffill", "cumsum", "cummax"):
        call = {"ffill": "last_value({0} IGNORE NULLS)", "cumsum": "sum({0})", "cummax": "max({0})"}[n].format(a[0])
        return f"{call} OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING)"
    by = ", ".join(("date", *p))
    if n in _CROSS:
        return f"{_CROSS[n].format(a[0])} OVER (PARTITION BY {by})"
    if n.startswith("cs_q"):
        return f"quantile_cont({a[0]}, {n[4:]}) OVER (PARTITION BY {by})"
    if n == "average_rank":
        return f"CASE WHEN {a[0]} IS NOT NULL THEN rank() OVER (PARTITION BY {by}, {a[0]} IS NULL ORDER BY {a[0]}) + (count(*) OVER (PARTITION BY {by}, {a[0]}) - 1) / 2.0 END"
    raise KeyError(n)


def sql(panel: str, factors: dict[str, Expr], keep: tuple[str, ...] = ("date", "code"), digits: int = 6) -> str:
    """SQL for the rounded factors over ``panel``, a query that gives (date, code, ...): one subquery per window call's depth."""
    depth: dict[Expr, int] = {}

    def dig(e: Expr) -> int:
        if e not in depth:
            depth[e] = max(map(dig, e.args), default=0) + e.window
        return depth[e]

    for e in factors.values():
        dig(e)
    calls = sorted((e for e in depth if e.window), key=lambda e: depth[e])
    names = {e: f"t{i}" for i, e in enumerate(calls)}
    text = lambda e, inside=None: names[e] if e.window and e is not inside else _text(e, [text(x) for x in e.args])
    query = panel
    for d in sorted({depth[e] for e in calls}):
        query = f"SELECT *, {', '.join(f'{text(e, e)} AS {names[e]}' for e in calls if depth[e] == d)} FROM ({query})"
    # Adding zero turns a negative zero, which Spark's round never gives, into zero.
    return f"SELECT {', '.join(keep)}, {', '.join(f'round({text(e)} + {NUDGE!r}, {digits}) + 0.0 AS {name}' for name, e in factors.items())} FROM ({query})"
