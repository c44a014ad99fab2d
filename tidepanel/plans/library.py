"""Momentum, reversal, volatility, liquidity, candle and indicator factors on bars, as expressions."""

from __future__ import annotations

from ..functions.expr import (
    Expr,
    absolute,
    col,
    covariance,
    cs_mean,
    delay,
    exponential,
    forward_fill,
    lead,
    log,
    maximum,
    minimum,
    number,
    picked_sum,
    positive_variance,
    rank,
    regression_intercept,
    regression_slope,
    returns,
    row_index,
    running_sum,
    sample_std,
    sign,
    stddev,
    ts_argmax,
    ts_argmin,
    ts_count,
    ts_kurt,
    ts_max,
    ts_mean,
    ts_min,
    ts_rank,
    ts_skew,
    ts_sum,
    where,
)

o, h, lo, c, v, m, vw = (col(x) for x in ("open", "high", "low", "close", "volume", "money", "vwap"))
r, c1, typical = returns(c), delay(c, 1), (h + lo + c) / 3


def mean(x: Expr, d: int) -> Expr:
    return ts_mean(x, d, d)


def wilder(x: Expr, d: int) -> Expr:
    return exponential(x, d, 1.0 / d)


def true_range() -> Expr:
    return maximum(maximum(h - lo, absolute(h - c1)), absolute(lo - c1))


def relative_strength(x: Expr, d: int) -> Expr:
    step = x - delay(x, 1)
    up, down = wilder(maximum(step, 0.0), d), wilder(maximum(-step, 0.0), d)
    return up * 100.0 / (up + down)


def low_range_momentum(d: int, share: float) -> Expr:
    """Sum of returns on the rows of the window with the smallest range."""
    return picked_sum(r, h / lo - 1.0, d, int(d * share))


def slope_z(n: int, d: int) -> Expr:
    """How far the slope of high on low stands from its mean, in deviations."""
    b = regression_slope(h, lo, n)
    return (b - mean(b, d)) / stddev(b, d, d)


def market_residual(d: int) -> Expr:
    market = cs_mean(r)
    return r - (regression_slope(r, market, d) * market + regression_intercept(r, market, d))


def convexity(d: int) -> Expr:
    """1, 0.5, -0.5 or -1 by the sign of the bend of the last d closes and of the return over them."""
    half = d // 2
    bend = (c - delay(c, half)) - (delay(c, half) - delay(c, 2 * half))
    over = returns(c, d)
    return where(bend >= 0, where(over >= 0, 1.0, 0.5), where(over >= 0, -0.5, -1.0))


def groups(cap: str = "cap") -> dict[str, dict[str, Expr]]:
    """Factors by family."""
    upper, lower = h - maximum(o, c), minimum(o, c) - lo
    upper_needle, lower_needle = upper / mean(upper, 5), lower / mean(lower, 5)
    market = cs_mean(r)
    resid = market_residual(12)
    turnover = v / col(cap)
    top, bottom = maximum(o, c), minimum(o, c)
    atr = wilder(true_range(), 6)
    flow = lambda cond: ts_sum(where(cond, typical * m, 0.0), 6, 6)
    ema12, ema26 = exponential(c, 12), exponential(c, 26)
    triple = exponential(exponential(exponential(c, 4), 4), 4)
    hd, ld = h - delay(h, 1), delay(lo, 1) - lo
    plus = wilder(where((hd > ld) & (hd > 0), hd, 0.0), 6) * 100.0 / wilder(true_range(), 6)
    minus = wilder(where((ld > hd) & (ld > 0), ld, 0.0), 6) * 100.0 / wilder(true_range(), 6)
    rsi = relative_strength(c, 6)
    up_sum, down_sum = ts_sum(maximum(c - c1, 0.0), 6, 6), ts_sum(maximum(c1 - c, 0.0), 6, 6)
    dema = exponential(c, 6) * 2.0 - exponential(exponential(c, 6), 6)
    slope = regression_slope(c, row_index(), 12)
    body, span = absolute(c - o), h - lo
    usual_body, usual_span = delay(mean(body, 6), 1), delay(mean(span, 6), 1)
    white, black, long_body, small_body = c >= o, c < o, body > usual_body, body <= usual_body
    doji = body <= usual_span * 0.1
    o1, h1, lo1 = delay(o, 1), delay(h, 1), delay(lo, 1)
    was_white, was_black = delay(number(white), 1) > 0, delay(number(black), 1) > 0
    was_long, was_small = delay(number(long_body), 1) > 0, delay(number(small_body), 1) > 0
    before = delay(c, 2)
    return {
        "needles": {"upper": upper_needle, "lower": lower_needle, "upper_mean": mean(upper_needle, 6), "upper_std": sample_std(upper_needle, 6), "lower_mean": mean(lower_needle, 6), "lower_std": sample_std(lower_needle, 6)},
        "momentum": {"skipped": delay(c, 2) / delay(c, 12) - 1.0, "reversal": c / delay(c, 6) - 1.0, "rate_of_change": (c / delay(c, 12) - 1.0) * 100.0, "return_rank": 1.0 - rank((c - delay(c, 6)) / delay(c, 6)), "close_rank": ts_rank(c, 24), "z": (c - mean(c, 6)) / stddev(c, 6, 6), "volume_momentum": mean(m / c, 6) / mean(m / c, 12), "volume_return": m / mean(m, 6) * mean(r, 6), "price_trend": mean(m * r, 6) / 1e4, "convexity": convexity(10), "slope": slope},
        "range_momentum": {"quiet": low_range_momentum(12, 0.7), "quiet_skipping": delay(low_range_momentum(10, 0.7), 2), "quiet_less_recent": low_range_momentum(12, 0.7) - ts_sum(r, 3, 3), "quiet_plus_recent": low_range_momentum(12, 0.7) / 8.0 + mean(r, 3), "busy_less_quiet": picked_sum(r, m, 12, 6, lowest=False) - picked_sum(r, m, 12, 6)},
        "aroon_power": {"aroon_up": (12.0 - ts_argmax(h, 13) * 13.0) / 12.0, "aroon_down": (12.0 - ts_argmin(lo, 13) * 13.0) / 12.0, "bull": (h - exponential(c, 6)) / c, "bear": (lo - exponential(c, 6)) / c, "bias_mean": (c - mean(c, 6)) * 100.0 / mean(c, 6), "bias_ema": (c - exponential(c, 6)) / exponential(c, 6), "bias_dema": (c - dema) / dema},
        "liquidity": {"night": mean(absolute(log(o / c1)), 6), "value_rank": 1.0 - rank(ts_mean(m, 6, 1)), "value_raw": ts_mean(m, 6, 1), "amihud": mean(absolute(r) / m, 6) * 1e6, "size": log(col(cap) * c), "turnover": turnover, "log_turnover": log(turnover), "abnormal": mean(turnover, 3) / mean(turnover, 12), "turnover_std": sample_std(turnover, 6), "turnover_skew": ts_skew(turnover, 6), "turnover_kurt": ts_kurt(turnover, 6), "ideal_turnover": (picked_sum(turnover, c, 12, 3, lowest=False) - picked_sum(turnover, c, 12, 3)) / 3.0},
        "market_model": {"beta": regression_slope(r, market, 12), "alpha": regression_intercept(r, market, 12), "residual": resid, "idiosyncratic": sample_std(resid, 6), "residual_momentum": delay(mean(resid, 6) / sample_std(resid, 6), 1), "slope_z": slope_z(6, 12), "up_variance": positive_variance(r, 12), "down_variance": positive_variance(-r, 12), "co_skew": covariance(r, market * market, 12) * 1e3},
        "support": {"pivot_high": forward_fill(where((delay(top, 2) <= delay(top, 1)) & (top <= delay(top, 1)), delay(top, 1), None)) / c - 1.0, "pivot_low": c / forward_fill(where((delay(bottom, 2) >= delay(bottom, 1)) & (bottom >= delay(bottom, 1)), delay(bottom, 1), None)) - 1.0, "average": c / mean(c, 6) - 1.0, "exponential": c / exponential(c, 6) - 1.0, "overbought": forward_fill(where(rsi >= 80.0, top, None)) / c - 1.0, "oversold": c / forward_fill(where(rsi <= 20.0, bottom, None)) - 1.0, "channel": (c - ts_min(lo, 12, 12)) / (ts_max(h, 12, 12) - ts_min(lo, 12, 12))},
        "volatility": {"atr": atr, "natr": atr / c * 100.0, "bollinger_up": mean(c, 6) + stddev(c, 6, 6) * 2.0, "bollinger_down": mean(c, 6) - stddev(c, 6, 6) * 2.0, "bandwidth": stddev(c, 6, 6) * 4.0 / mean(c, 6), "return_std": sample_std(r, 12), "return_skew": ts_skew(r, 12), "return_kurt": ts_kurt(r, 12), "parkinson": mean(log(h / lo) * log(h / lo), 6), "true_range": true_range()},
        "oscillators": {"rsi": rsi, "macd": ema12 - ema26, "macd_signal": exponential(ema12 - ema26, 9), "ppo": (ema12 - ema26) / ema26 * 100.0, "trix": returns(triple) * 100.0, "cci": (typical - mean(typical, 6)) / (mean(absolute(typical - mean(typical, 6)), 6) * 0.015), "williams": (ts_max(h, 6, 6) - c) / (ts_max(h, 6, 6) - ts_min(lo, 6, 6)) * -100.0, "stochastic": mean((c - ts_min(lo, 6, 6)) / (ts_max(h, 6, 6) - ts_min(lo, 6, 6)) * 100.0, 3), "chande": (up_sum - down_sum) / (up_sum + down_sum) * 100.0, "money_flow": 100.0 - 100.0 / (1.0 + flow(typical > delay(typical, 1)) / flow(typical < delay(typical, 1))), "plus_di": plus, "minus_di": minus, "adx": wilder(absolute(plus - minus) / (plus + minus) * 100.0, 6), "balance": (c - o) / (h - lo)},
        "volume": {"on_balance": running_sum(where(c > c1, v, where(c < c1, -v, 0.0))), "accumulation": running_sum((c - lo - (h - c)) / (h - lo) * v), "ease": mean(((h + lo) / 2 - (h1 + lo1) / 2) * (h - lo) / v, 6), "force": exponential((c - c1) * v, 6) / 1e3, "up_share": ts_count(c > c1, 12) / 12.0, "sign_run": ts_sum(sign(c - c1), 6, 6)},
        "candles": {
            "doji": number(doji),
            "marubozu": number(long_body & (upper < usual_span * 0.1) & (lower < usual_span * 0.1)) * sign(c - o),
            "hammer": number(small_body & (lower > body * 2.0) & (upper < usual_span * 0.1)),
            "shooting_star": number(small_body & (upper > body * 2.0) & (lower < usual_span * 0.1)),
            "spinning_top": number(small_body & (upper > body) & (lower > body)),
            "engulfing": where(white & was_black & (c > o1) & (o < c1), 1.0, where(black & was_white & (c < o1) & (o > c1), -1.0, 0.0)),
            "harami": where(was_long & small_body & (top < maximum(o1, c1)) & (bottom > minimum(o1, c1)), where(was_black, 1.0, -1.0), 0.0),
            "piercing": number(was_black & was_long & white & (o < lo1) & (c > (o1 + c1) / 2) & (c < o1)),
            "dark_cloud": number(was_white & was_long & black & (o > h1) & (c < (o1 + c1) / 2) & (c > o1)),
            "three_soldiers": number((ts_count(white, 3) > 2.5) & (c > c1) & (c1 > before)),
            "three_crows": number((ts_count(black, 3) > 2.5) & (c < c1) & (c1 < before)),
            "morning_star": number((before < delay(o, 2)) & was_small & white & (c > (before + delay(o, 2)) / 2)),
            "evening_star": number((before > delay(o, 2)) & was_small & black & (c < (before + delay(o, 2)) / 2)),
        },
        "labels_ahead": {"demeaned": lead(c, 1) / c - 1.0 - cs_mean(lead(c, 1) / c - 1.0), "sharpe": lead(mean(r, 6), 6) / lead(sample_std(r, 6), 6), "double_mean": lead(mean(c, 3), 3) / mean(c, 3) - 1.0},
    }
