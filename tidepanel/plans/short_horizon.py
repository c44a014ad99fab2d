"""The 191 short-horizon price and volume factors of a broker's report (2017), as expressions.

Trading activity is the money traded.  A maximum or minimum of a series and a number is taken row by row; ``mean`` needs
its whole window, sums and deviations half of it.  The market is the mean of a date's instruments.  Formulas that the
report leaves undefined are taken by their published definition.  21, 116 and 147 are slopes on the row's number, 143 is a
running product of rises, 150 is in millions.
"""

from __future__ import annotations

from ..functions.expr import (
    Expr,
    absolute,
    col,
    correlation,
    covariance,
    cs_mean,
    decay_linear,
    delay,
    delta,
    exp,
    log,
    maximum,
    minimum,
    number,
    power,
    rank,
    regression_intercept,
    regression_slope,
    returns,
    row_index,
    running_sum,
    sign,
    sma,
    stddev,
    ts_argmax,
    ts_argmin,
    ts_count,
    ts_max,
    ts_mean,
    ts_min,
    ts_rank,
    ts_sum,
    where,
)

o, h, lo, c, v, m, vw = (col(x) for x in ("open", "high", "low", "close", "volume", "money", "vwap"))
r, mid, typical, c1 = returns(c), (h + lo) / 2, (h + lo + c) / 3, delay(c, 1)

#: Formulas whose windows need more rows than a few years of months.
LONG = tuple(f"short_{n:03}" for n in (22, 23, 25, 26, 30, 33, 39, 45, 61, 75, 92, 98, 101, 108, 123, 125, 138, 140, 146, 149, 151, 152, 154, 160, 164, 174, 181, 184))


def mean(x: Expr, d: int) -> Expr:
    return ts_mean(x, d, d)


def change(x: Expr, d: int) -> Expr:
    return (x - delay(x, d)) / delay(x, d)


def stochastic(d: int) -> Expr:
    return (c - ts_min(lo, d)) / (ts_max(h, d) - ts_min(lo, d)) * 100.0


def fallen(d: int) -> Expr:
    return (ts_max(h, d) - c) / (ts_max(h, d) - ts_min(lo, d)) * 100.0


def strength(x: Expr, n: int) -> Expr:
    """Share of rises among all moves, smoothed."""
    d = x - delay(x, 1)
    return sma(maximum(d, 0.0), n, 1) / sma(absolute(d), n, 1) * 100.0


def formulas() -> dict[str, Expr]:
    """Expressions by name."""
    up, down, d1 = c > c1, c < c1, c - c1
    range_place = (c - lo - (h - c)) / (h - lo)
    signed_money = where(up, m, where(down, -m, 0.0))
    true_range = maximum(maximum(h - lo, absolute(c1 - h)), absolute(c1 - lo))
    band = where(c.same(c1), 0.0, c - where(up, minimum(lo, c1), maximum(h, c1)))
    rises, falls = where(d1 > 0, d1, 0.0), where(d1 < 0, absolute(d1), 0.0)
    open_up = where(o <= delay(o, 1), 0.0, maximum(h - o, o - delay(o, 1)))
    open_down = where(o >= delay(o, 1), 0.0, maximum(o - lo, o - delay(o, 1)))
    moved = maximum(absolute(h - delay(h, 1)), absolute(lo - delay(lo, 1)))
    both = h + lo - (delay(h, 1) + delay(lo, 1))
    sunk, lifted = where(both >= 0, 0.0, moved), where(both <= 0, 0.0, moved)
    up_dev, down_dev = where(up, stddev(c, 20), 0.0), where(c <= c1, stddev(c, 20), 0.0)
    slowdown = (delay(c, 20) - delay(c, 10)) / 10 - (delay(c, 10) - c) / 10
    market_open, market = cs_mean(o), cs_mean(c)
    market_ret, market_down = returns(market), market < delay(market, 1)
    log3 = sma(sma(sma(log(c), 13, 2), 13, 2), 13, 2)
    gap = sma(c, 13, 2) - sma(c, 27, 2)
    money_gap = sma(m, 13, 2) - sma(m, 27, 2)
    center = (mid - (delay(h, 1) + delay(lo, 1)) / 2) * (h - lo) / m
    k9, k3 = stochastic(9), sma(stochastic(9), 3, 1)
    hd, ld = h - delay(h, 1), delay(lo, 1) - lo
    plus, minus, span = ts_sum(where((hd > 0) & (hd > ld), hd, 0.0), 14) * 100.0, ts_sum(where((ld > 0) & (ld > hd), ld, 0.0), 14) * 100.0, ts_sum(true_range, 14)
    directional = absolute(minus / span - plus / span) / (minus / span + plus / span) * 100.0
    adx = mean(directional, 6)
    low_base, high_base = minimum(lo, c1), maximum(h, c1)
    oscillator = lambda d: (c - ts_sum(low_base, d)) / ts_sum(high_base - low_base, d)
    a_h, a_l, a_hl, a_co = absolute(h - c1), absolute(lo - c1), absolute(h - delay(lo, 1)), absolute(c1 - delay(o, 1))
    swing_base = where((a_h > a_l) & (a_h > a_hl), a_h + a_l / 2 + a_co / 4, where((a_l > a_hl) & (a_l > a_h), a_l + a_h / 2 + a_co / 4, a_hl + a_co / 4))
    swing = (d1 + (c - o) / 2 + c1 - delay(o, 1)) * 16.0 / swing_base * maximum(a_h, a_l)
    ret_dev = r - sma(r, 61, 2)
    inverse_rise = where(up, 1.0 / d1, 1.0)
    dev = lambda d: running_sum(c - mean(c, d))
    ret20 = c / c1 - 1.0 - mean(c / c1 - 1.0, 20)
    residual = r - (regression_slope(r, market_ret, 60) * market_ret + regression_intercept(r, market_ret, 60))
    market_dev = market_ret - mean(market_ret, 20)
    f: dict[int, Expr] = {
        1: -correlation(rank(delta(log(m), 1)), rank((c - o) / o), 6),
        2: -delta(range_place, 1),
        3: ts_sum(band, 6),
        4: where(mean(c, 8) + stddev(c, 8) < mean(c, 2), -1.0, where(mean(c, 2) < mean(c, 8) - stddev(c, 8), 1.0, where(m / mean(m, 20) >= 1, 1.0, -1.0))),
        5: -ts_max(correlation(ts_rank(m, 5), ts_rank(h, 5), 5), 3),
        6: -rank(sign(delta(o * 0.85 + h * 0.15, 4))),
        7: (rank(maximum(vw - c, 3.0)) + rank(minimum(vw - c, 3.0))) * rank(delta(m, 3)),
        8: rank(-delta(mid * 0.2 + vw * 0.8, 4)),
        9: sma(center, 7, 2),
        10: rank(maximum(power(where(r < 0, stddev(r, 20), c), 2.0), 5.0)),
        11: ts_sum(range_place * m, 6),
        12: rank(o - ts_sum(vw, 10) / 10) * -rank(absolute(c - vw)),
        13: power(h * lo, 0.5) - vw,
        14: c - delay(c, 5),
        15: o / c1 - 1.0,
        16: -ts_max(rank(correlation(rank(m), rank(vw), 5)), 5),
        17: power(rank(vw - maximum(vw, 15.0)), delta(c, 5) / c),
        18: c / delay(c, 5),
        19: where(c < delay(c, 5), change(c, 5), where(c.same(delay(c, 5)), 0.0, (c - delay(c, 5)) / c)),
        20: change(c, 6) * 100.0,
        21: regression_slope(mean(c, 6), row_index(), 6),
        22: sma((c - mean(c, 6)) / mean(c, 6) - delay((c - mean(c, 6)) / mean(c, 6), 3), 12, 1),
        23: sma(up_dev, 20, 1) / (sma(up_dev, 20, 1) + sma(down_dev, 20, 1)) * 100.0,
        24: sma(c - delay(c, 5), 5, 1),
        25: -rank(delta(c, 7) * (1.0 - rank(decay_linear(m / mean(m, 20), 9)))) * (1.0 + rank(ts_sum(r, 250))),
        26: ts_sum(c, 7) / 7 - c + correlation(vw, delay(c, 5), 230),
        27: decay_linear(change(c, 3) * 100.0 + change(c, 6) * 100.0, 12),
        28: k3 * 3.0 - sma(k3, 3, 1) * 2.0,
        29: change(c, 6) * m,
        30: decay_linear(power(residual, 2.0), 20) * 1000.0,
        31: (c - mean(c, 12)) / mean(c, 12) * 100.0,
        32: -ts_sum(rank(correlation(rank(h), rank(m), 3)), 3),
        33: (delay(ts_min(lo, 5), 5) - ts_min(lo, 5)) * rank((ts_sum(r, 240) - ts_sum(r, 20)) / 220) * ts_rank(m, 5),
        34: mean(c, 12) / c,
        35: -minimum(rank(decay_linear(delta(o, 1), 15)), rank(decay_linear(correlation(m, o, 17), 7))),
        36: rank(ts_sum(correlation(rank(m), rank(vw), 6), 2)),
        37: -rank(ts_sum(o, 5) * ts_sum(r, 5) - delay(ts_sum(o, 5) * ts_sum(r, 5), 10)),
        38: where(ts_sum(h, 20) / 20 < h, -delta(h, 2), 0.0),
        39: -(rank(decay_linear(delta(c, 2), 8)) - rank(decay_linear(correlation(vw * 0.3 + o * 0.7, ts_sum(mean(m, 180), 37), 14), 12))),
        40: ts_sum(where(up, m, 0.0), 26) / ts_sum(where(c <= c1, m, 0.0), 26) * 100.0,
        41: -rank(maximum(delta(vw, 3), 5.0)),
        42: -rank(stddev(h, 10)) * correlation(h, m, 10),
        43: ts_sum(signed_money, 6),
        44: ts_rank(decay_linear(correlation(lo, mean(m, 10), 7), 6), 4) + ts_rank(decay_linear(delta(vw, 3), 10), 15),
        45: rank(delta(c * 0.6 + o * 0.4, 1)) * rank(correlation(vw, mean(m, 150), 15)),
        46: (mean(c, 3) + mean(c, 6) + mean(c, 12) + mean(c, 24)) / (c * 4.0),
        47: sma(fallen(6), 9, 1),
        48: -(rank(sign(d1) + sign(c1 - delay(c, 2)) + sign(delay(c, 2) - delay(c, 3))) * ts_sum(m, 5)) / ts_sum(m, 20),
        49: ts_sum(sunk, 12) / (ts_sum(sunk, 12) + ts_sum(lifted, 12)),
        50: ts_sum(lifted, 12) / (ts_sum(lifted, 12) + ts_sum(sunk, 12)) - ts_sum(sunk, 12) / (ts_sum(sunk, 12) + ts_sum(lifted, 12)),
        51: ts_sum(lifted, 12) / (ts_sum(lifted, 12) + ts_sum(sunk, 12)),
        52: ts_sum(maximum(h - delay(typical, 1), 0.0), 26) / ts_sum(maximum(delay(typical, 1) - lo, 0.0), 26) * 100.0,
        53: ts_count(up, 12) / 12.0 * 100.0,
        54: -rank(stddev(absolute(c - o), 20) + (c - o) + correlation(c, o, 10)),
        55: ts_sum(swing, 20),
        56: number(rank(o - ts_min(o, 12)) < rank(power(rank(correlation(ts_sum(mid, 19), ts_sum(mean(m, 40), 19), 13)), 5.0))),
        57: k3,
        58: ts_count(up, 20) / 20.0 * 100.0,
        59: ts_sum(band, 20),
        60: ts_sum(range_place * m, 20),
        61: -maximum(rank(decay_linear(delta(vw, 1), 12)), rank(decay_linear(rank(correlation(lo, mean(m, 80), 8)), 17))),
        62: -correlation(h, rank(v), 5),
        63: strength(c, 6),
        64: -maximum(rank(decay_linear(correlation(rank(vw), rank(m), 4), 4)), rank(decay_linear(maximum(correlation(rank(c), rank(mean(m, 60)), 4), 13.0), 14))),
        65: mean(c, 6) / c,
        66: (c - mean(c, 6)) / mean(c, 6) * 100.0,
        67: strength(c, 24),
        68: sma(center, 15, 2),
        69: where(ts_sum(open_up, 20) > ts_sum(open_down, 20), (ts_sum(open_up, 20) - ts_sum(open_down, 20)) / ts_sum(open_up, 20), where(ts_sum(open_up, 20).same(ts_sum(open_down, 20)), 0.0, (ts_sum(open_up, 20) - ts_sum(open_down, 20)) / ts_sum(open_down, 20))),
        70: stddev(m, 6),
        71: (c - mean(c, 24)) / mean(c, 24) * 100.0,
        72: sma(fallen(6), 15, 1),
        73: -(ts_rank(decay_linear(decay_linear(correlation(c, m, 10), 16), 4), 5) - rank(decay_linear(correlation(vw, mean(m, 30), 4), 3))),
        74: rank(correlation(ts_sum(lo * 0.35 + vw * 0.65, 20), ts_sum(mean(m, 40), 20), 7)) + rank(correlation(rank(vw), rank(m), 6)),
        75: ts_count((c > o) & (market < market_open), 50) / ts_count(market < market_open, 50),
        76: stddev(absolute(r) / m, 20) / mean(absolute(r) / m, 20),
        77: minimum(rank(decay_linear(mid + h - (vw + h), 20)), rank(decay_linear(correlation(mid, mean(m, 40), 3), 6))),
        78: (typical - mean(typical, 12)) / (mean(absolute(c - mean(typical, 12)), 12) * 0.015),
        79: strength(c, 12),
        80: change(m, 5) * 100.0,
        81: sma(m, 21, 2),
        82: sma(fallen(6), 20, 1),
        83: -rank(covariance(rank(h), rank(m), 5)),
        84: ts_sum(signed_money, 20),
        85: ts_rank(m / mean(m, 20), 20) * ts_rank(-delta(c, 7), 8),
        86: where(slowdown > 0.25, -1.0, where(slowdown < 0, 1.0, -d1)),
        87: -(rank(decay_linear(delta(vw, 4), 7)) + ts_rank(decay_linear((lo - vw) / (o - mid), 11), 7)),
        88: change(c, 20) * 100.0,
        89: (gap - sma(gap, 10, 2)) * 2.0,
        90: -rank(correlation(rank(vw), rank(m), 5)),
        91: -rank(c - maximum(c, 5.0)) * rank(correlation(mean(m, 40), lo, 5)),
        92: -maximum(rank(decay_linear(delta(c * 0.35 + vw * 0.65, 2), 3)), ts_rank(decay_linear(absolute(correlation(mean(m, 180), c, 13)), 5), 15)),
        93: ts_sum(open_down, 20),
        94: ts_sum(signed_money, 30),
        95: stddev(m, 20),
        96: sma(k3, 3, 1),
        97: stddev(m, 10),
        98: where(delta(ts_sum(c, 100) / 100, 100, order=False) / delay(c, 100) <= 0.05, -(c - ts_min(c, 100)), -delta(c, 3)),
        99: -rank(covariance(rank(c), rank(m), 5)),
        100: stddev(m, 20),
        101: -number(rank(correlation(c, ts_sum(mean(v, 30), 37), 15)) < rank(correlation(rank(h * 0.1 + vw * 0.9), rank(m), 11))),
        102: strength(m, 6),
        103: (1.0 - ts_argmin(lo, 20)) * 100.0,
        104: -(delta(correlation(h, m, 5), 5) * rank(stddev(c, 20))),
        105: -correlation(rank(o), rank(m), 10),
        106: c - delay(c, 20),
        107: -rank(o - delay(h, 1)) * rank(o - c1) * rank(o - delay(lo, 1)),
        108: -power(rank(h - minimum(h, 2.0)), rank(correlation(vw, mean(m, 120), 6))),
        109: sma(h - lo, 10, 2) / sma(sma(h - lo, 10, 2), 10, 2),
        110: ts_sum(maximum(h - c1, 0.0), 20) / ts_sum(maximum(c1 - lo, 0.0), 20) * 100.0,
        111: sma(m * range_place, 11, 2) - sma(m * range_place, 4, 2),
        112: (ts_sum(rises, 12) - ts_sum(falls, 12)) / (ts_sum(rises, 12) + ts_sum(falls, 12)) * 100.0,
        113: -(rank(ts_sum(delay(c, 5), 20) / 20) * correlation(c, m, 2) * rank(correlation(ts_sum(c, 5), ts_sum(c, 20), 2))),
        114: rank(delay((h - lo) / (ts_sum(c, 5) / 5), 2)) * rank(rank(m)) / ((h - lo) / (ts_sum(c, 5) / 5) / (vw - c)),
        115: power(rank(correlation(h * 0.9 + c * 0.1, mean(m, 30), 10)), rank(correlation(ts_rank(mid, 4), ts_rank(m, 10), 7))),
        116: regression_slope(c, row_index(), 20),
        117: ts_rank(m, 32) * (1.0 - ts_rank(c + h - lo, 16)) * (1.0 - ts_rank(r, 32)),
        118: ts_sum(h - o, 20) / ts_sum(o - lo, 20) * 100.0,
        119: rank(decay_linear(correlation(vw, ts_sum(mean(m, 5), 26), 5), 7)) - rank(decay_linear(ts_rank(minimum(correlation(rank(o), rank(mean(m, 15)), 21), 9.0), 7), 8)),
        120: rank(vw - c) / rank(vw + c),
        121: -power(rank(vw - minimum(vw, 12.0)), ts_rank(correlation(ts_rank(vw, 20), ts_rank(mean(m, 60), 2), 18), 3)),
        122: (log3 - delay(log3, 1)) / delay(log3, 1) * 100.0,
        123: -number(rank(correlation(ts_sum(mid, 20), ts_sum(mean(m, 60), 20), 9)) < rank(correlation(lo, m, 6))),
        124: (c - vw) / decay_linear(rank(ts_max(c, 30)), 2),
        125: rank(decay_linear(correlation(vw, mean(m, 80), 17), 20)) / rank(decay_linear(delta(c * 0.5 + vw * 0.5, 3), 16)),
        126: typical,
        127: power(mean(power((c - ts_max(c, 12)) / ts_max(c, 12) * 100.0, 2.0), 12), 0.5),
        128: 100.0 - 100.0 / (1.0 + ts_sum(where(typical > delay(typical, 1), typical * m, 0.0), 14) / ts_sum(where(typical < delay(typical, 1), typical * m, 0.0), 14)),
        129: ts_sum(falls, 12),
        130: rank(decay_linear(correlation(mid, mean(m, 40), 9), 10)) / rank(decay_linear(correlation(rank(vw), rank(m), 7), 3)),
        131: power(rank(delta(vw, 1)), ts_rank(correlation(c, mean(m, 50), 18), 18)),
        132: mean(m, 20),
        133: (1.0 - ts_argmax(h, 20)) * 100.0 - (1.0 - ts_argmin(lo, 20)) * 100.0,
        134: change(c, 12) * m,
        135: sma(delay(c / delay(c, 20), 1), 20, 1),
        136: -rank(delta(r, 3)) * correlation(o, m, 10),
        137: swing,
        138: -(rank(decay_linear(delta(lo * 0.7 + vw * 0.3, 3), 20)) - ts_rank(decay_linear(ts_rank(correlation(ts_rank(lo, 8), ts_rank(mean(m, 60), 17), 5), 19), 16), 7)),
        139: -correlation(o, m, 10),
        140: minimum(rank(decay_linear(rank(o) + rank(lo) - (rank(h) + rank(c)), 8)), ts_rank(decay_linear(correlation(ts_rank(c, 8), ts_rank(mean(m, 60), 20), 8), 7), 3)),
        141: -rank(correlation(rank(h), rank(mean(m, 15)), 9)),
        142: -rank(ts_rank(c, 10)) * rank(delta(delta(c, 1), 1)) * rank(ts_rank(m / mean(m, 20), 5)),
        143: exp(running_sum(where(up, log(r), 0.0)) / 10.0),
        144: ts_sum(where(down, absolute(r) / m, 0.0), 20) / ts_count(down, 20) * 1e6,
        145: (mean(m, 9) - mean(m, 26)) / mean(m, 12) * 100.0,
        146: mean(ret_dev, 20) * ret_dev / sma(power(r - ret_dev, 2.0), 61, 2),
        147: regression_slope(mean(c, 12), row_index(), 12),
        148: -number(rank(correlation(o, ts_sum(mean(m, 60), 9), 6)) < rank(o - ts_min(o, 14))),
        149: covariance(where(market_down, r, 0.0), where(market_down, market_ret, 0.0), 252) / covariance(where(market_down, market_ret, 0.0), where(market_down, market_ret, 0.0), 252),
        150: typical * m / 1e6,
        151: sma(c - delay(c, 20), 20, 1),
        152: sma(mean(delay(sma(delay(c / delay(c, 9), 1), 9, 1), 1), 12) - mean(delay(sma(delay(c / delay(c, 9), 1), 9, 1), 1), 26), 9, 1),
        153: (mean(c, 3) + mean(c, 6) + mean(c, 12) + mean(c, 24)) / 4,
        154: number(vw - minimum(vw, 16.0) < correlation(vw, mean(m, 180), 18)),
        155: money_gap - sma(money_gap, 10, 2),
        156: -maximum(rank(decay_linear(delta(vw, 5), 3)), rank(decay_linear(-(delta(o * 0.15 + lo * 0.85, 2) / (o * 0.15 + lo * 0.85)), 3))),
        157: minimum(rank(rank(log(ts_sum(ts_min(rank(rank(-rank(delta(c - 1.0, 5)))), 2), 1)))), 5.0) + ts_rank(delay(-r, 6), 5),
        158: (h - sma(c, 15, 2) - (lo - sma(c, 15, 2))) / c,
        159: (oscillator(6) * 288.0 + oscillator(12) * 144.0 + oscillator(24) * 144.0) * 100.0 / 504.0,
        160: sma(down_dev, 20, 1),
        161: mean(true_range, 12),
        162: (strength(c, 12) - minimum(strength(c, 12), 12.0)) / (maximum(strength(c, 12), 12.0) - minimum(strength(c, 12), 12.0)),
        163: rank(-r * mean(m, 20) * vw * (h - c)),
        164: sma((inverse_rise - minimum(inverse_rise, 12.0)) / (h - lo) * 100.0, 13, 2),
        165: ts_max(dev(48), 48) - ts_min(dev(48), 48) / stddev(c, 48),
        166: ts_sum(ret20, 20) * (-20.0 * 19.0**1.5) / (power(ts_sum(power(c / c1, 2.0), 20), 1.5) * (19.0 * 18.0)),
        167: ts_sum(rises, 12),
        168: -m / mean(m, 20),
        169: sma(mean(delay(sma(d1, 9, 1), 1), 12) - mean(delay(sma(d1, 9, 1), 1), 26), 10, 1),
        170: rank(1.0 / c) * m / mean(m, 20) * (h * rank(h - c) / (ts_sum(h, 5) / 5)) - rank(vw - delay(vw, 5)),
        171: -((lo - c) * power(o, 5.0)) / ((c - h) * power(c, 5.0)),
        172: adx,
        173: sma(c, 13, 2) * 3.0 - sma(sma(c, 13, 2), 13, 2) * 2.0 + log3,
        174: sma(up_dev, 20, 1),
        175: mean(true_range, 6),
        176: correlation(rank((c - ts_min(lo, 12)) / (ts_max(h, 12) - ts_min(lo, 12))), rank(m), 6),
        177: (1.0 - ts_argmax(h, 20)) * 100.0,
        178: r * m,
        179: rank(correlation(vw, m, 4)) * rank(correlation(rank(lo), rank(mean(m, 50)), 12)),
        180: where(mean(m, 20) < m, -ts_rank(absolute(delta(c, 7)), 60) * sign(delta(c, 7)), -m),
        181: ts_sum(ret20 - power(market_dev, 2.0), 20) / (absolute(ts_sum(power(market_dev, 3.0), 20)) + 1e-3),
        182: ts_count(((c > o) & (market > market_open)) | ((c < o) & (market < market_open)), 20) / 20.0,
        183: ts_max(dev(24), 24) - ts_min(dev(24), 24) / stddev(c, 24),
        184: rank(correlation(delay(o - c, 1), c, 200)) + rank(o - c),
        185: rank(-power(1.0 - o / c, 2.0)),
        186: (adx + delay(adx, 6)) / 2,
        187: ts_sum(open_up, 20),
        188: (h - lo - sma(h - lo, 11, 2)) / sma(h - lo, 11, 2) * 100.0,
        189: mean(absolute(c - mean(c, 6)), 6),
        190: log((ts_count(r > 0, 20) + 1.0) / (ts_count(r < 0, 20) + 1.0)),
        191: correlation(mean(m, 20), lo, 5) + mid - c,
    }
    return {f"short_{n:03}": e for n, e in f.items()}
