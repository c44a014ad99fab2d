"""More candle patterns and moving-average indicators on bars, as expressions.

Long, short and small are measured against the mean of the six rows before; 1 is a rising sign, -1 a falling one, 0 none.
"""

from __future__ import annotations

from ..functions.expr import Expr, absolute, col, correlation, decay_linear, delay, exponential, maximum, minimum, number, regression_intercept, regression_slope, returns, row_index, stddev, ts_argmax, ts_argmin, ts_max, ts_mean, ts_min, ts_sum, where

o, h, lo, c, v = (col(x) for x in ("open", "high", "low", "close", "volume"))


def mean(x: Expr, d: int) -> Expr:
    return ts_mean(x, d, d)


def was(condition: Expr, d: int) -> Expr:
    return delay(number(condition), d) > 0.5


def sign_of(up: Expr, down: Expr) -> Expr:
    return where(up, 1.0, where(down, -1.0, 0.0))


def patterns() -> dict[str, dict[str, Expr]]:
    body, span, top, bottom = absolute(c - o), h - lo, maximum(o, c), minimum(o, c)
    upper, lower = h - top, bottom - lo
    usual_body, usual_span = delay(mean(body, 6), 1), delay(mean(span, 6), 1)
    white, black = c >= o, c < o
    long, small, doji = body > usual_body, body <= usual_body, body <= usual_span * 0.1
    tiny_up, tiny_down = upper < usual_span * 0.1, lower < usual_span * 0.1
    near = usual_span * 0.05
    o1, h1, lo1, c1, o2, c2 = delay(o, 1), delay(h, 1), delay(lo, 1), delay(c, 1), delay(o, 2), delay(c, 2)
    top1, bottom1, top2, bottom2 = maximum(o1, c1), minimum(o1, c1), maximum(o2, c2), minimum(o2, c2)
    white1, black1, white2, black2 = was(white, 1), was(black, 1), was(white, 2), was(black, 2)
    long1, long2, small1, doji1 = was(long, 1), was(long, 2), was(small, 1), was(doji, 1)
    full, full1 = long & tiny_up & tiny_down, was(long & tiny_up & tiny_down, 1)
    equal_close, equal_open = absolute(c - c1) <= near, absolute(o - o1) <= near
    inside1 = (top1 < top2) & (bottom1 > bottom2)
    return {
        "one_row": {
            "dragonfly": number(doji & tiny_up & (lower > usual_span * 0.1)),
            "gravestone": number(doji & tiny_down & (upper > usual_span * 0.1)),
            "long_legged": number(doji & ((upper > body) | (lower > body))),
            "rickshaw": number(doji & (upper > body) & (lower > body) & (absolute((o + c) / 2 - (h + lo) / 2) <= span * 0.1)),
            "takuri": number(doji & tiny_up & (lower > body * 2.0) & (lower > usual_span * 0.5)),
            "high_wave": number(small & (upper > body * 2.0) & (lower > body * 2.0)) * sign_of(white, black),
            "belt_hold": sign_of(white & long & tiny_down, black & long & tiny_up),
            "closing_marubozu": sign_of(white & long & tiny_up, black & long & tiny_down),
            "long_line": number(long & (upper < body * 0.5) & (lower < body * 0.5)) * sign_of(white, black),
            "short_line": number(small & (upper < usual_span * 0.25) & (lower < usual_span * 0.25)) * sign_of(white, black),
        },
        "two_rows": {
            "hanging_man": number(small & (lower > body * 2.0) & tiny_up & (bottom >= h1 - near)) * -1.0,
            "inverted_hammer": number(small & (upper > body * 2.0) & tiny_down & (top < bottom1)),
            "doji_star": where(long1 & doji, sign_of(black1 & (top < bottom1), white1 & (bottom > top1)), 0.0),
            "harami_cross": where(long1 & doji & (top < top1) & (bottom > bottom1), sign_of(black1, white1), 0.0),
            "homing_pigeon": number(black1 & black & long1 & small & (o < o1) & (c > c1)),
            "matching_low": number(black1 & black & equal_close),
            "counterattack": where(long1 & long & equal_close, sign_of(black1 & white, white1 & black), 0.0),
            "kicking": where(full1 & full, sign_of(black1 & white & (lo > h1), white1 & black & (h < lo1)), 0.0),
            "separating_lines": where(long & equal_open, sign_of(black1 & white & tiny_down, white1 & black & tiny_up), 0.0),
            "in_neck": number(black1 & long1 & white & (o < lo1) & (c >= c1) & (c <= c1 + near)) * -1.0,
            "on_neck": number(black1 & long1 & white & (o < lo1) & (absolute(c - lo1) <= near)) * -1.0,
            "thrusting": number(black1 & long1 & white & (o < lo1) & (c > c1 + near) & (c <= (o1 + c1) / 2)) * -1.0,
        },
        "three_rows": {
            "three_inside": where(long2 & small1 & inside1, sign_of(black2 & white & (c > o2), white2 & black & (c < o2)), 0.0),
            "three_outside": sign_of(black2 & white1 & (c1 > o2) & (o1 < c2) & (c > c1), white2 & black1 & (c1 < o2) & (o1 > c2) & (c < c1)),
            "abandoned_baby": where(long2 & doji1, sign_of(black2 & white & (h1 < delay(lo, 2)) & (h1 < lo), white2 & black & (lo1 > delay(h, 2)) & (lo1 > h)), 0.0),
            "morning_doji_star": number(black2 & long2 & doji1 & (top1 < c2) & white & (c > (o2 + c2) / 2)),
            "evening_doji_star": number(white2 & long2 & doji1 & (bottom1 > c2) & black & (c < (o2 + c2) / 2)) * -1.0,
            "tri_star": where(doji & doji1 & was(doji, 2), sign_of((top1 < bottom2) & (bottom > top1), (bottom1 > top2) & (top < bottom1)), 0.0),
            "stick_sandwich": number(black2 & white1 & black & (lo1 > c2) & (absolute(c - c2) <= near)),
            "tasuki_gap": sign_of((bottom1 > top2) & white1 & black & (o < c1) & (o > o1) & (c < o1) & (c > top2), (top1 < bottom2) & black1 & white & (o > c1) & (o < o1) & (c > o1) & (c < bottom2)),
            "two_crows": number(white2 & long2 & black1 & (bottom1 > c2) & black & (o < o1) & (o > c1) & (c < c2) & (c > o2)) * -1.0,
            "identical_crows": number(black2 & black1 & black & (c < c1) & (c1 < c2) & (absolute(o - c1) <= near) & (absolute(o1 - c2) <= near)) * -1.0,
            "advance_block": number(white2 & white1 & white & (c > c1) & (c1 > c2) & (body < absolute(c1 - o1)) & (absolute(c1 - o1) < absolute(c2 - o2)) & (upper > delay(upper, 1))) * -1.0,
            "unique_river": number(black2 & long2 & black1 & (c1 > c2) & (o1 <= o2) & (lo1 < delay(lo, 2)) & white & small & (o > lo1) & (c < c1)),
        },
    }


def averages(d: int = 6) -> dict[str, dict[str, Expr]]:
    e1 = exponential(c, d)
    e2 = exponential(e1, d)
    e3 = exponential(e2, d)
    c1 = delay(c, 1)
    low, true_high = minimum(lo, c1), maximum(h, c1)
    pressure = lambda n: ts_sum(c - low, n, n) / ts_sum(true_high - low, n, n)
    slope, start = regression_slope(c, row_index(), d), regression_intercept(c, row_index(), d)
    fast = (c - ts_min(lo, d, d)) / (ts_max(h, d, d) - ts_min(lo, d, d)) * 100.0
    r = returns(c)
    rsi = exponential(maximum(c - c1, 0.0), d, 1.0 / d) / exponential(absolute(c - c1), d, 1.0 / d) * 100.0
    line = (c - lo - (h - c)) / (h - lo) * v
    return {
        "overlap": {
            "weighted": decay_linear(c, d),
            "triangular": mean(mean(c, d // 2), d // 2 + 1),
            "double": e1 * 2.0 - e2,
            "triple": e1 * 3.0 - e2 * 3.0 + e3,
            "midpoint": (ts_max(c, d, d) + ts_min(c, d, d)) / 2,
            "midprice": (ts_max(h, d, d) + ts_min(lo, d, d)) / 2,
            "hull": decay_linear(decay_linear(c, d // 2) * 2.0 - decay_linear(c, d), 2),
        },
        "price_forms": {"average": (o + h + lo + c) / 4, "median": (h + lo) / 2, "typical": (h + lo + c) / 3, "weighted_close": (h + lo + c * 2.0) / 4},
        "fits": {"line_end": start + slope * row_index(), "line_next": start + slope * (row_index() + 1.0), "deviation": stddev(c, d, d), "high_low_corr": correlation(h, lo, d), "high_low_beta": regression_slope(h, lo, d)},
        "strength": {
            "rate": returns(c, d),
            "ratio": c / delay(c, d),
            "ratio_100": c / delay(c, d) * 100.0,
            "oscillator": exponential(c, d // 2) - e1,
            "aroon": ts_argmin(lo, d + 1) * float(d + 1) / float(d) * 100.0 - ts_argmax(h, d + 1) * float(d + 1) / float(d) * 100.0,
            "fast_k": fast,
            "slow_k": mean(fast, 3),
            "slow_d": mean(mean(fast, 3), 3),
            "strength_stochastic": (rsi - ts_min(rsi, d, d)) / (ts_max(rsi, d, d) - ts_min(rsi, d, d)) * 100.0,
            "ultimate": (pressure(d // 2) * 4.0 + pressure(d) * 2.0 + pressure(d * 2)) / 7 * 100.0,
            "momentum": c - delay(c, d),
            "return_z": (r - mean(r, d)) / stddev(r, d, d),
        },
        "flow": {"chaikin": ts_sum(line, d, d) / ts_sum(v, d, d), "line_oscillator": exponential(line, 3) - exponential(line, d), "volume_rate": returns(v, d)},
    }


def channels(d: int = 6, factor: float = 0.7) -> dict[str, dict[str, Expr]]:
    """Channels, crossings of means, and prices over their means."""
    c1 = delay(c, 1)
    step = maximum(maximum(h - lo, absolute(h - c1)), absolute(lo - c1))
    atr, middle = exponential(step, d, 1.0 / d), exponential(c, d)
    reach = delay(maximum(ts_max(h, d, d) - ts_min(c, d, d), ts_max(c, d, d) - ts_min(lo, d, d)), 1)
    e1 = exponential(c, d)
    e2 = exponential(e1, d)
    e3 = exponential(e2, d)
    damped = lambda e: exponential(e, d // 2) * (1.0 + factor) - exponential(exponential(e, d // 2), d // 2) * factor
    short, mid, far = mean(c, 3), mean(c, d), mean(c, d * 2)
    macd = exponential(c, 12) - exponential(c, 26)
    up, down = h - delay(h, 1), delay(lo, 1) - lo
    plus = exponential(where((up > down) & (up > 0), up, 0.0), d, 1.0 / d)
    minus = exponential(where((down > up) & (down > 0), down, 0.0), d, 1.0 / d)
    adx = exponential(absolute(plus - minus) / (plus + minus), d, 1.0 / d)
    return {
        "bands": {"keltner_up": middle + atr * 2.0, "keltner_down": middle - atr * 2.0, "bollinger_up": mid + stddev(c, d, d) * 2.0, "bollinger_down": mid - stddev(c, d, d) * 2.0, "thrust_up": o + reach * 0.1, "thrust_down": o - reach * 0.1},
        "crossings": {"two_means": sign_of(short >= far, short < far), "three_means": number(c >= short) + number(short >= mid) + number(mid >= far), "macd_history": (macd - exponential(macd, 9)) / c, "rating": (adx + delay(adx, d)) / 2, "power": mean((c - o) / (h - lo + 0.01), d), "oscillator_norm": macd / c},
        "over_means": {"simple": c / mid, "exponential": c / e1, "double": c / (e1 * 2.0 - e2), "triple": c / (e1 * 3.0 - e2 * 3.0 + e3), "weighted": c / decay_linear(c, d), "damped": c / damped(damped(damped(c)))},
        "bars_by_close": {"open": o / c1 - 1.0, "high": h / c1 - 1.0, "low": lo / c1 - 1.0, "close": c / c1 - 1.0, "volume": v / mean(v, d)},
    }
