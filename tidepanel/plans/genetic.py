"""Factors found by genetic programming: on bars, and on features of slices of a day's trades."""

from __future__ import annotations

from ..functions.expr import Expr, col, correlation, covariance, cube_root, power, rank, sqrt, stddev, ts_max, ts_mean, ts_min, ts_sum, where

#: Features that ``on_slices`` reads: name -> (slice, column).  Names end in the function, avg or std.
FEATURES = {
    "swapstd": ("all", "swap"),
    "retavg": ("all", "ret"),
    "open_retavg": ("open", "ret"),
    "open_priceavg": ("open", "price"),
    "close_retavg": ("close", "ret"),
    "close_swapstd": ("close", "swap"),
    "high_retstd": ("high", "ret"),
    "high_swapavg": ("high", "swap"),
    "high_swapstd": ("high", "swap"),
}


def on_bars(price: Expr = col("high"), other: Expr = col("low"), unit: Expr = col("close")) -> dict[str, Expr]:
    """Six factors on a price, another one, the money traded and its mean price."""
    m, vw = col("money"), col("vwap")
    return {
        "genetic_bars_1": correlation(vw / price, price, 10),
        "genetic_bars_2": ts_sum(rank(correlation(price, other, 20)), 20),
        "genetic_bars_3": -stddev(m, 5),
        "genetic_bars_4": -(rank(covariance(price, m, 10)) * rank(stddev(price, 10))),
        "genetic_bars_5": -(ts_sum(rank(covariance(price, m, 5)), 10) * rank(stddev(price, 5))),
        "genetic_bars_6": ts_sum((price + other) / unit, 5),
    }


def _full(e: Expr, d: int) -> Expr:
    return ts_mean(e, d, d)


def _cube(e: Expr) -> Expr:
    return power(e, 3.0)


def _root(e: Expr) -> Expr:
    """Cube root; of a negative number there is none."""
    return where(e >= 0, cube_root(e), None)


def _norm(e: Expr, d: int) -> Expr:
    return (e - ts_min(e, d)) / (ts_max(e, d) - ts_min(e, d))


def on_slices(mean: int = 5) -> dict[str, Expr]:
    """Eight factors on ``FEATURES`` and corrpriceswap, and the mean of each over ``mean`` rows (_mean)."""
    f = {name: col(name) for name in (*FEATURES, "corrpriceswap")}
    late, late_std = f["close_retavg"], f["close_swapstd"]
    made = {
        "genetic_slices_1": _cube(ts_max(late_std, 3)) + f["corrpriceswap"] * _full(late, 3),
        "genetic_slices_2": _full(late_std, 3) * ts_max(f["corrpriceswap"], 3) + (late - ts_min(f["open_retavg"], 3)),
        "genetic_slices_3": _full(late, 3) * ts_max(late, 3) * _cube(_full(f["swapstd"], 5)),
        "genetic_slices_4": ts_max(late_std, 3) * _full(late, 3) / _root(_full(f["open_priceavg"], 3)),
        "genetic_slices_5": _cube(_cube(_full(f["high_retstd"], 3)) + (late + ts_max(late_std, 3))),
        "genetic_slices_6": ts_max(late_std, 3) * _full(f["retavg"], 3) / sqrt(ts_min(f["open_retavg"], 3)),
        "genetic_slices_7": _cube(ts_max(f["high_swapstd"], 3)) + _root(_norm(late, 3)),
        "genetic_slices_8": ts_max(f["high_swapavg"], 3) * ts_max(late_std, 3) * (f["high_swapstd"] * _norm(late, 10)),
    }
    return made | {f"{name}_mean": _full(e, mean) for name, e in made.items()}
