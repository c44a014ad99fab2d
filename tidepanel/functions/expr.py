"""Panel expressions: lazily composed, evaluated as few window stages over a DataFrame.

``x = col("close"); rank(delta(x, 1))`` builds an expression.  ``with_factors``
adds expressions to a panel (date, code, ...): window calls cannot nest inside one
column, so each is a column of its own, and all that share a depth are added at once.
Those of one axis then share one exchange and sort.  Equal sub-expressions are
computed once.

Time-series functions see the rows of a code in the order of dates; on a dense
panel (see ``sources.panels.densify``) a lag is a lag of the calendar.  Cross-section functions see the
rows of a date.  Missing values are null, never NaN; division by zero is null.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import decayed, decayed_mean, span_of

CODE, DATE = "code", "date"


@dataclass(frozen=True)
class Expr:
    """``build`` makes a Column of the arguments' Columns; ``window`` marks calls that need a column of their own.

    ``instead`` makes an equal expression of the arguments that Spark evaluates in the call's place: the same values by other steps.
    """

    name: str
    args: tuple = ()
    params: tuple = ()
    window: bool = False
    build: Callable[..., Column] = field(default=None, compare=False, repr=False)
    instead: Callable[..., Expr] = field(default=None, compare=False, repr=False)

    def __hash__(self):
        if "_hash" not in self.__dict__:
            object.__setattr__(self, "_hash", hash((self.name, self.args, self.params)))
        return self._hash

    def __add__(self, o): return _call("add", lambda a, b: a + b, self, o)
    def __radd__(self, o): return lit(o) + self
    def __sub__(self, o): return _call("sub", lambda a, b: a - b, self, o)
    def __rsub__(self, o): return lit(o) - self
    def __mul__(self, o): return _call("mul", lambda a, b: a * b, self, o)
    def __rmul__(self, o): return lit(o) * self
    def __truediv__(self, o): return _call("div", lambda a, b: F.try_divide(a.cast("double"), b.cast("double")), self, o)
    def __rtruediv__(self, o): return lit(o) / self
    def __neg__(self): return lit(-1.0) * self
    def __lt__(self, o): return _call("lt", lambda a, b: a < b, self, o)
    def __le__(self, o): return _call("le", lambda a, b: a <= b, self, o)
    def __gt__(self, o): return _call("gt", lambda a, b: a > b, self, o)
    def __ge__(self, o): return _call("ge", lambda a, b: a >= b, self, o)
    def __and__(self, o): return _call("and", lambda a, b: a & b, self, o)
    def __or__(self, o): return _call("or", lambda a, b: a | b, self, o)
    def same(self, o): return _call("same", lambda a, b: a == b, self, o)


def col(name: str) -> Expr:
    return Expr("col", params=(name,), build=lambda: F.col(name))


def lit(x) -> Expr:
    if x is None:
        return Expr("null", build=lambda: F.lit(None).cast("double"))
    return x if isinstance(x, Expr) else Expr("lit", params=(float(x),), build=lambda: F.lit(float(x)))


def _call(name: str, build, *args, params: tuple = (), window: bool = False, instead=None) -> Expr:
    return Expr(name, tuple(lit(a) for a in args), params, window, build, instead)


# Elementwise.


def absolute(x): return _call("abs", F.abs, x)
def log(x): return _call("log", lambda a: F.when(a > 0, F.ln(a)), x)
def exp(x): return _call("exp", F.exp, x)
def sqrt(x): return _call("sqrt", lambda a: F.when(a >= 0, F.sqrt(a)), x)
def sign(x): return _call("sign", F.signum, x)
def sine(x): return _call("sin", F.sin, x)
def arc_cosine(x): return _call("acos", lambda a: F.when(F.abs(a) <= 1, F.acos(a)), x)
def angle(y, x): return _call("atan2", lambda a, b: F.when((a != 0) | (b != 0), F.atan2(a, b)), y, x)
def cube_root(x): return _call("cbrt", F.cbrt, x)
def power(x, y): return _call("pow", F.pow, x, y)
def signed_power(x, a): return _call("spow", lambda v, e: F.signum(v) * F.pow(F.abs(v), e), x, a)
def clip(x, lo, hi): return minimum(maximum(x, lo), hi)
def maximum(x, y): return _call("max2", lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)), x, y)
def minimum(x, y): return _call("min2", lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)), x, y)
def where(c, x, y): return _call("where", lambda a, b, d: F.when(a, b).otherwise(d), c, x, y)
def number(c): return where(c, 1.0, 0.0)
def coalesce(x, y): return _call("coalesce", F.coalesce, x, y)


# Time series: the rows of a code.


def _by_code():
    return Window.partitionBy(CODE).orderBy(DATE)


def _by_block(block: Column):
    """The order of dates, by blocks that follow each other: that in which windows of a block leave the rows, so that they need no sort."""
    return Window.partitionBy(CODE).orderBy(block, DATE)


def trailing(d: int):
    return _by_code().rowsBetween(-(int(d) - 1), 0)


#: A window of this many rows or more is put together of two running aggregates, as a moving frame is aggregated anew for each row.
WIDE = 40


def _halves(name: str, states: Callable[..., list[Column]], args: tuple, d: int) -> tuple[Expr, Expr]:
    """Aggregates of a window of d rows in two parts: of the row's block of d rows up to the row, and of the block before from the window's first row on.

    A code is cut into blocks of d rows; both parts are running aggregates, one in the order of dates and one against it.
    """
    at = row_index()
    block = _call("wide_block", lambda i: F.floor((i - 1) / d), at, params=(d,))
    within = lambda b, order: Window.partitionBy(CODE, b).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    running = lambda w, a: F.struct(*[s.over(w).alias(f"s{k}") for k, s in enumerate(states(*a))])
    rest = _call(f"{name}_onward", lambda b, *a: running(within(b, F.desc(DATE)), a), block, *args, params=(d,), window=True)
    # Reads the other part only to come after it, beside its lag, which has the same order.
    first = _call(f"{name}_upto", lambda b, _, *a: running(within(b, F.col(DATE)), a), block, rest, *args, params=(d,), window=True)
    # The window of a block's last row is the block.
    lagged = lambda b, i, r: F.when(F.pmod(i, F.lit(d)) != 0, F.lag(r, d - 1).over(_by_block(b)))
    return first, _call(f"{name}_before", lagged, block, at, rest, params=(d,), window=True)


def _moments(a: Column, b: Column | None = None) -> list[Column]:
    """Count; mean, variance, least and greatest of each; covariance."""
    one = lambda v: [F.avg(v), F.var_pop(v), F.min(v), F.max(v)]
    return [F.count(a), *one(a)] if b is None else [F.count(a), *one(a), *one(b), F.covar_pop(a, b)]


def _joined(p: Column, q: Column, pair: bool) -> list[Column]:
    """Of two parts together the count; mean, sum of squares about it, least and greatest of each; sum of products about the means.

    A part without values adds nothing, and values that are all equal have no spread.
    """
    n, m = F.coalesce(p["s0"], F.lit(0)), F.coalesce(q["s0"], F.lit(0))
    both, total = (n > 0) & (m > 0), n + m
    share = n * m / total.cast("double")
    gap = lambda k: q[f"s{k}"] - p[f"s{k}"]
    mean = lambda k: F.when(both, p[f"s{k}"] + gap(k) * (m / total)).when(n > 0, p[f"s{k}"]).otherwise(q[f"s{k}"])
    products = lambda k, i, j: F.when(both, p[f"s{k}"] * n + q[f"s{k}"] * m + gap(i) * gap(j) * share).when(n > 0, p[f"s{k}"] * n).otherwise(q[f"s{k}"] * m)
    out, flat = [total], F.lit(False)
    for k in (1, 5) if pair else (1,):
        lo, hi = F.least(p[f"s{k + 2}"], q[f"s{k + 2}"]), F.greatest(p[f"s{k + 3}"], q[f"s{k + 3}"])
        out += [mean(k), F.when(lo == hi, 0.0).otherwise(products(k + 1, k, k)), lo, hi]
        flat = flat | (lo == hi)
    return [*out, F.when(flat, 0.0).otherwise(products(9, 1, 5))] if pair else out


def _wide(name: str, x, d: int, least: int) -> Expr | None:
    """A long window's aggregate of its two parts, for those that can be put together."""
    if name in ("stddev", "stddev_s", "variance"):
        p, q = _halves("moments", _moments, (x,), d)
        spread = {"stddev": lambda s, n: F.sqrt(s / n), "variance": lambda s, n: s / n, "stddev_s": lambda s, n: F.when(n > 1, F.sqrt(s / (n - 1)))}[name]

        def build(a, b):
            n, _, s, _, _ = _joined(a, b, False)
            return F.when((n >= least) & (n > 0), spread(s, n))

        return _call(f"wide_{name}", build, p, q, params=(d, least))
    zero = lambda v: F.coalesce(v, F.lit(0))
    of = {"ts_sum": F.sum, "ts_mean": F.sum, "ts_min": F.min, "ts_max": F.max}[name]
    p, q = _halves(name, lambda a: [F.count(a), of(a)], (x,), d)

    def whole(a, b):
        n = zero(a["s0"]) + zero(b["s0"])
        extreme = {"ts_min": F.least, "ts_max": F.greatest}.get(name)
        v = extreme(a["s1"], b["s1"]) if extreme else zero(a["s1"]) + zero(b["s1"])
        return F.when((n >= least) & (n > 0), v / n if name == "ts_mean" else v)

    return _call(f"wide_{name}", whole, p, q, params=(d, least))


def _rolling(name: str, agg, x, d: int, least: int | None):
    d, least = int(d), max(1, int(d) // 2) if least is None else least

    def build(a):
        w = trailing(d)
        return F.when(F.count(a).over(w) >= least, agg(a).over(w))

    wide = (lambda a: _wide(name, a, d, least)) if d >= WIDE and name in ("ts_sum", "ts_mean", "ts_min", "ts_max", "stddev", "stddev_s", "variance") else None
    return _call(name, build, x, params=(d, least), window=True, instead=wide)


def delay(x, d: int): return _call("delay", lambda a: F.lag(a, int(d)).over(_by_code()), x, params=(int(d),), window=True)
def lead(x, d: int): return _call("lead", lambda a: F.lead(a, int(d)).over(_by_code()), x, params=(int(d),), window=True)


def delta(x, d: int = 1, order: bool = True):
    """The d-th order difference; with ``order`` off, the difference to the value d rows before."""
    if not order or d == 1:
        return lit(x) - delay(x, d)
    terms = [delay(x, k) * float((-1) ** k * math.comb(d, k)) if k else lit(x) for k in range(d + 1)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def returns(x, d: int = 1): return lit(x) / delay(x, d) - 1.0
def ts_sum(x, d, least=None): return _rolling("ts_sum", F.sum, x, d, least)
def ts_mean(x, d, least=None): return _rolling("ts_mean", F.avg, x, d, least)
def ts_min(x, d, least=None): return _rolling("ts_min", F.min, x, d, least)
def ts_max(x, d, least=None): return _rolling("ts_max", F.max, x, d, least)
def stddev(x, d, least=None): return _rolling("stddev", F.stddev_pop, x, d, least)
def sample_std(x, d, least=None): return _rolling("stddev_s", F.stddev_samp, x, d, d if least is None else least)
def variance(x, d, least=None): return _rolling("variance", F.var_pop, x, d, d if least is None else least)
def ts_median(x, d, least=None): return _rolling("ts_median", lambda a: F.percentile(a, F.lit(0.5)), x, d, d if least is None else least)
def ts_count(c, d): return _call("ts_count", lambda a: F.sum(F.when(a, 1.0).otherwise(0.0)).over(trailing(d)), c, params=(d,), window=True)
def product(x, d): return exp(ts_sum(log(x), d))
def adv(money, d): return ts_mean(money, d)


def _paired(name: str, agg, x, y, d: int, turned: bool = False):
    """Of pairs without a null; null where the window is not full of pairs.  ``turned`` marks a call on a pair that others read the other way."""

    def build(a, b):
        w, both = trailing(d), a.isNotNull() & b.isNotNull()
        return F.when(F.count(F.when(both, 1)).over(w) == int(d), agg(F.when(both, a), F.when(both, b)).over(w))

    return _call(name, build, x, y, params=(int(d),), window=True, instead=(lambda a, b: _wide_pair(name, a, b, int(d), turned)) if d >= WIDE else None)


def _wide_pair(name: str, x: Expr, y: Expr, d: int, turned: bool) -> Expr:
    """``_paired`` of a long window's two parts, which the calls on a pair share."""
    if x == y and name == "covariance":
        # That of a series with itself is its variance: half of what a pair's parts hold.
        p, q = _halves("moments", _moments, (x,), d)
        return _call("wide_self", lambda a, b: F.when(_joined(a, b, False)[0] == d, _joined(a, b, False)[2] / d), p, q, params=(d,))
    both = lambda a, b: (F.when(b.isNotNull(), a).cast("double"), F.when(a.isNotNull(), b).cast("double"))
    p, q = _halves("pair", lambda a, b: _moments(*both(a, b)), (y, x) if turned else (x, y), d)

    def build(a, b):
        n, mean_x, xx, _, _, mean_y, yy, _, _, xy = _joined(a, b, True)
        # regr functions take y first.
        slope = F.when(yy > 0, xy / yy)
        of = {"covariance": xy / n, "std_x": F.sqrt((yy if turned else xx) / n), "slope": slope, "intercept": mean_x - slope * mean_y}[name]
        return F.when(n == d, of)

    return _call(f"wide_{name}", build, p, q, params=(d, turned))


def nearest(x, digits: int): return _call("nearest", lambda a: F.round(a, digits), x, params=(digits,))


def correlation(x, y, d):
    """Pearson correlation, to nine digits: windows of ranks often tie, and a sum's last bits shall not part them."""
    return nearest(_paired("covariance", F.covar_pop, x, y, d) / (_paired("std_x", lambda a, _: F.stddev_pop(a), x, y, d) * _paired("std_x", lambda a, _: F.stddev_pop(a), y, x, d, turned=True)), 9)


def covariance(x, y, d): return nearest(_paired("covariance", F.covar_pop, x, y, d), 9)
def regression_slope(y, x, d): return _paired("slope", F.regr_slope, y, x, d)
def regression_intercept(y, x, d): return _paired("intercept", F.regr_intercept, y, x, d)


def decay_linear(x, d: int):
    """Mean with weights 1 to d, the newest heaviest; null if any value is."""
    total = lit(x) * float(d)
    for k in range(1, d):
        total = total + delay(x, k) * float(d - k)
    return total / float(d * (d + 1) / 2)


def _listed(name: str, of, x, d: int, least: int | None = None):
    least = max(1, int(d) // 2) if least is None else least

    def build(a):
        w = trailing(d)
        return F.when(F.count(a).over(w) >= least, of(a, w))

    return _call(name, build, x, params=(int(d), least), window=True)


def ts_rank(x, d: int):
    """Rank of the newest value among the window, 0 to 1, ties in the middle; one value alone is 0.5.

    On Spark the newest is compared with the rows before, each a lag, as a moving frame would collect its values anew for each row.
    """
    d, least = int(d), max(1, int(d) // 2)

    def build(a, *before):
        n = F.count(a).over(trailing(d))
        # Twice the places that the newest is above, one for a tie.
        above = F.aggregate(F.array(*before), F.lit(0), lambda t, v: t + F.when(v < a, 2).when(v == a, 1).otherwise(0)) if before else F.lit(0)
        return F.when(a.isNotNull() & (n >= least), F.when(n == 1, 0.5).otherwise(0.5 * above / (n - 1)))

    return _call("ts_rank", None, x, params=(d, least), window=True, instead=lambda a: _call("ts_rank_of", build, a, *[delay(a, k) for k in range(1, d)], params=(d, least), window=True))


def _newest_first(a: Column, w) -> Column:
    return F.reverse(F.collect_list(F.struct(a.alias("v"))).over(w).getField("v"))


def ts_argmax(x, d: int):
    """Rows since the newest highest value, over d."""
    return _listed("ts_argmax", lambda a, w: (F.array_position(_newest_first(a, w), F.max(a).over(w)) - 1) / float(d), x, d)


def ts_argmin(x, d: int):
    return _listed("ts_argmin", lambda a, w: (F.array_position(_newest_first(a, w), F.min(a).over(w)) - 1) / float(d), x, d)


def forward_fill(x): return _call("ffill", lambda a: F.last(a, ignorenulls=True).over(_by_code().rowsBetween(Window.unboundedPreceding, 0)), x, window=True)
def running_sum(x): return _call("cumsum", lambda a: F.sum(a).over(_by_code().rowsBetween(Window.unboundedPreceding, 0)), x, window=True)
def running_max(x): return _call("cummax", lambda a: F.max(a).over(_by_code().rowsBetween(Window.unboundedPreceding, 0)), x, window=True)
def row_index(): return _call("row_index", lambda: F.row_number().over(_by_code()).cast("double"), window=True)
def positive_variance(x, d: int): return ts_count(lit(x) > 0, d) * _rolling("variance", F.var_pop, where(lit(x) > 0, x, None), d, 1) / float(d)
def negative_variance(x, d: int): return positive_variance(-lit(x), d)
def ts_skew(x, d: int): return _rolling("ts_skew", F.skewness, x, d, d)
def ts_kurt(x, d: int): return _rolling("ts_kurt", F.kurtosis, x, d, d)


def exponential(x, period: int, alpha: float | None = None):
    """Exponential mean seeded with the mean of the first ``period`` known values; null before, and where x is.

    On Spark a running sum of decaying terms by blocks of known values (``operators.scan.decayed``), so a row costs the same however
    long the history and however many values are missing.
    """
    alpha = alpha or 2.0 / (period + 1)
    rows = period + (1 if alpha >= 1 else math.ceil(36.8 / -math.log1p(-alpha)))
    history = _call("history", None, x, params=(rows,), window=True)  # of the SQL only
    known = _call("known", lambda a: F.count(a).over(_by_code().rowsBetween(Window.unboundedPreceding, 0)), x, window=True)
    decay, span = max(0.0, 1 - alpha), span_of(max(0.0, 1 - alpha))

    def instead(a, _, n):
        def total(v, k, b):
            _, _, term = decayed(v, k, period, alpha)
            return F.sum(term).over(Window.partitionBy(CODE, b).orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0))

        def before(v, k, b, s):
            _, place, _ = decayed(v, k, period, alpha)
            ends = F.when(v.isNotNull() & (k >= period) & (place == span - 1), s * F.pow(F.lit(decay), place))
            return F.last(ends, ignorenulls=True).over(_by_block(b).rowsBetween(Window.unboundedPreceding, -1))

        block = _call("decay_block", lambda k: decayed(k, k, period, alpha)[0], n, params=(period, alpha))
        summed = _call("decayed", total, a, n, block, params=(period, alpha), window=True)
        ended = _call("ended", before, a, n, block, summed, params=(period, alpha), window=True)
        return _call("decayed_mean", lambda v, k, s, e: F.when(v.isNotNull(), decayed_mean(v, k, period, s, e, alpha)), a, n, summed, ended, params=(period, alpha))

    return _call("exponential", None, x, history, known, params=(period, alpha), instead=instead)


def sma(x, n: int, m: int = 1):
    """Exponential mean whose period is that of the weight m / n, cut to whole rows."""
    return exponential(x, int(2 / (m / n) - 1))


def picked_sum(x, by, d: int, k: int, lowest: bool = True):
    """Sum of x at the k rows of the last d with the lowest (highest) ``by``; ties go to the older row; null where the window is not full."""

    def build(a, b):
        w = trailing(d)
        pairs = F.collect_list(F.when(a.isNotNull() & b.isNotNull(), F.struct((b if lowest else -b).alias("b"), F.struct(DATE).alias("t"), a.alias("a")))).over(w)
        return F.when(F.size(pairs) == int(d), F.aggregate(F.slice(F.array_sort(pairs), 1, int(k)), F.lit(0.0), lambda t, q: t + q["a"]))

    return _call("picked_low" if lowest else "picked_high", build, x, by, params=(int(d), int(k)), window=True)


# Cross-section: the rows of a date.


def _over(name: str, agg, *args, by: tuple[str, ...] = ()):
    return _call(name, lambda *a: agg(*a).over(Window.partitionBy(DATE, *by)), *args, params=by, window=True)


def cs_mean(x, by=()): return _over("cs_mean", F.avg, x, by=tuple(by))
def cs_sum(x, by=()): return _over("cs_sum", F.sum, x, by=tuple(by))
def cs_std(x, by=(), sample: bool = False): return _over("cs_std_s" if sample else "cs_std", F.stddev_samp if sample else F.stddev_pop, x, by=tuple(by))
def cs_min(x, by=()): return _over("cs_min", F.min, x, by=tuple(by))
def cs_max(x, by=()): return _over("cs_max", F.max, x, by=tuple(by))
def cs_count(x, by=()): return _over("cs_count", F.count, x, by=tuple(by))
def cs_quantile(x, q: float, by=()): return _over(f"cs_q{q}", lambda a: F.percentile(a, F.lit(q)), x, by=tuple(by))
def cs_median(x, by=()): return cs_quantile(x, 0.5, by)


def average_rank(x, by: tuple[str, ...] = ()):
    """1 to n, ties share their mean; nulls have no rank."""

    def build(a):
        # One partitioning for all ranks of a date: nulls come last rather than apart, and a default frame ends with the row's ties.
        up = Window.partitionBy(DATE, *by).orderBy(a.asc_nulls_last())
        return F.when(a.isNotNull(), (F.rank().over(up) + F.count(a).over(up)) / 2)

    return _call("average_rank", build, x, params=tuple(by), window=True)


def rank(x, by=()):
    """Average rank over the greatest average rank of the date."""
    r = average_rank(x, tuple(by))
    return r / cs_max(r, by)


def scale(x, a: float = 1.0): return lit(x) * a / cs_mean(absolute(x))
def demean(x, by=()): return lit(x) - cs_mean(x, by)
def zscore(x, by=(), sample: bool = False): return demean(x, by) / cs_std(x, by, sample)
def min_max(x, by=()): return (lit(x) - cs_min(x, by)) / (cs_max(x, by) - cs_min(x, by))


def neutralize(x, group: str):
    """Subtracts one shift from all of a date: group after group, the mean over all values of what the group's members have left."""

    def build(g, s, n):
        return F.array_sort(F.collect_set(F.when((n > 0) & g.isNotNull(), F.struct(g.alias("g"), s.alias("s"), n.alias("n")))).over(Window.partitionBy(DATE)))

    groups = _call("groups", build, col(group), cs_sum(x, (group,)), cs_count(x, (group,)), window=True)
    fold = lambda a, q, total: a - F.aggregate(q, F.lit(0.0), lambda c, e: c + F.try_divide(e["s"] - e["n"] * c, total))
    return _call("neutralize", fold, x, groups, cs_count(x))


def mad_clip(x, k: float = 3.0):
    m = cs_median(x)
    spread = cs_median(absolute(lit(x) - m))
    return clip(x, m - spread * k, m + spread * k)


# Evaluation.


def _lowered(e: Expr, seen: dict[Expr, Expr]) -> Expr:
    """The expression with what Spark evaluates instead of its calls."""
    if e not in seen:
        if e.instead:
            seen[e] = _lowered(e.instead(*e.args), seen)
        else:
            seen[e] = Expr(e.name, tuple(_lowered(a, seen) for a in e.args), e.params, e.window, e.build)
    return seen[e]


def _across(e: Expr) -> bool:
    """Whether the call's window is a date's rows rather than a code's."""
    return e.name.startswith("cs_") or e.name in ("average_rank", "groups")


def _stages(calls: dict[Expr, set[Expr]], across: bool) -> list[tuple[bool, list[Expr]]]:
    """(axis, calls) in turn, from one axis on: all that can be computed along an axis comes before the next exchange."""
    done: set[Expr] = set()
    out: list[tuple[bool, list[Expr]]] = []
    while len(done) < len(calls):
        while now := [e for e, below in calls.items() if e not in done and _across(e) == across and below <= done]:
            out.append((across, now))
            done |= set(now)
        across = not across
    return out


def with_factors(panel: DataFrame, factors: dict[str, Expr]) -> DataFrame:
    """The panel with a column for each expression."""
    seen: dict[Expr, Expr] = {}
    factors = {name: _lowered(e, seen) for name, e in factors.items()}
    below: dict[Expr, set[Expr]] = {}  # of each expression the window calls that it reads

    def dig(e: Expr) -> set[Expr]:
        if e not in below:
            below[e] = set().union(*[{a} if a.window else dig(a) for a in e.args]) if e.args else set()
            for a in e.args:
                dig(a)
        return below[e]

    for e in factors.values():
        dig(e)
    calls = {e: d for e, d in below.items() if e.window}
    turns = lambda stages: sum(a[0] != b[0] for a, b in zip(stages, stages[1:]))
    stages = min((_stages(calls, across) for across in (False, True)), key=turns)
    names = {e: f"_{i}" for i, e in enumerate(e for _, now in stages for e in now)}

    def column(e: Expr, inside: Expr | None = None) -> Column:
        if e in names and e is not inside:
            return F.col(names[e])
        return e.build(*[column(a, inside) for a in e.args])

    df = panel
    for i, (across, now) in enumerate(stages):
        # What the calls read is a column: written into each call it is evaluated for each, and what it reads would go through the exchange.
        read = {a: f"_r{i}_{k}" for k, a in enumerate(dict.fromkeys(a for e in now for a in e.args if a.args and a not in names))}
        df = df.withColumns({name: column(a) for a, name in read.items()}) if read else df
        names |= read
        if i and across and not stages[i - 1][0]:
            # Groups of a date and whole dates share this exchange.
            run = [e for turn, es in itertools.takewhile(lambda s: s[0], stages[i:]) for e in es]
            df = df.repartition(DATE) if any(e.params for e in run) else df
        df = df.withColumns({names[e]: column(e, e) for e in now})
    return df.withColumns({name: column(e) for name, e in factors.items()}).drop(*names.values())


#: Ratios of ranks are often exact halves of the last digit kept; this decides them before a sum's last bits do.
NUDGE = 3e-8


def rounded(c: str, digits: int) -> Column:
    return F.round(F.col(c) + NUDGE, digits)


def factor(panel: DataFrame, e: Expr, name: str = "value", digits: int | None = None) -> DataFrame:
    """(date, code, value) of one expression, without nulls."""
    df = with_factors(panel, {name: e}).select(DATE, CODE, name).filter(F.col(name).isNotNull())
    return df.withColumn(name, rounded(name, digits)) if digits is not None else df
