"""Formulaic factors from Z. Kakushadze, "101 Formulaic Alphas" (2015), and others of that kind, as expressions.

Only columns of bars are needed.  Windows are in rows of the panel; where the paper has fractions they are cut to whole
rows.  Trading activity is the money traded, but for alpha_044, which takes the volume.
"""

from __future__ import annotations

from ..functions.expr import (
    Expr,
    absolute,
    adv,
    clip,
    col,
    correlation,
    covariance,
    decay_linear,
    delay,
    delta,
    demean,
    log,
    maximum,
    minimum,
    neutralize,
    number,
    rank,
    returns,
    scale,
    sign,
    signed_power,
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
r = returns(c)


def formulas(industry: str = "industry") -> dict[str, Expr]:
    """Expressions by name."""
    up = c > delay(c, 1)
    down = c < delay(c, 1)
    true_range = maximum(maximum(h - lo, absolute(h - delay(c, 1))), absolute(lo - delay(c, 1)))
    return {
        # Of the 101.
        "alpha_001": rank(ts_argmax(signed_power(where(r < 0, stddev(r, 20), c), 2.0), 5)) - 0.5,
        "alpha_002": -correlation(rank(delta(log(m), 2)), rank((c - o) / o), 6),
        "alpha_003": -correlation(rank(o), rank(m), 10),
        "alpha_004": -ts_rank(rank(lo), 9),
        "alpha_005": rank(o - ts_sum(vw, 10) / 10) * (-absolute(rank(c - vw))),
        "alpha_006": -correlation(o, m, 10),
        "alpha_007": where(adv(m, 20) < m, -ts_rank(absolute(delta(c, 7)), 60) * sign(delta(c, 7)), -1.0),
        "alpha_008": -rank(ts_sum(o, 5) * ts_sum(r, 5) - delay(ts_sum(o, 5) * ts_sum(r, 5), 10)),
        "alpha_009": where(ts_min(delta(c, 1), 5) > 0, delta(c, 1), where(ts_max(delta(c, 1), 5) < 0, delta(c, 1), -delta(c, 1))),
        "alpha_010": rank(where(ts_min(delta(c, 1), 4) > 0, delta(c, 1), where(ts_max(delta(c, 1), 4) < 0, delta(c, 1), -delta(c, 1)))),
        "alpha_011": (rank(ts_max(vw - c, 3)) + rank(ts_min(vw - c, 3))) * rank(delta(m, 3)),
        "alpha_012": sign(delta(m, 1)) * (-delta(c, 1)),
        "alpha_013": -rank(covariance(rank(c), rank(m), 5)),
        "alpha_014": -rank(delta(r, 3)) * correlation(o, m, 10),
        "alpha_015": -ts_sum(rank(correlation(rank(h), rank(m), 3)), 3),
        "alpha_016": -rank(covariance(rank(h), rank(m), 5)),
        "alpha_017": -rank(ts_rank(c, 10)) * rank(delta(delta(c, 1), 1)) * rank(ts_rank(m / adv(m, 20), 5)),
        "alpha_018": -rank(stddev(absolute(c - o), 5) + (c - o) + correlation(c, o, 10)),
        "alpha_019": -sign(c - delay(c, 7) + delta(c, 7)) * (rank(ts_sum(r, 24) + 1.0) + 1.0),
        "alpha_020": -rank(o - delay(h, 1)) * rank(o - delay(c, 1)) * rank(o - delay(lo, 1)),
        "alpha_022": -delta(correlation(h, m, 5), 5) * rank(stddev(c, 20)),
        "alpha_023": where(ts_mean(h, 20) < h, -delta(h, 2), 0.0),
        "alpha_024": where(delta(ts_mean(c, 24), 12) / delay(c, 12) <= 0.05, -(c - ts_min(c, 24)), -delta(c, 3)),
        "alpha_025": rank(-r * adv(m, 20) * vw * (h - c)),
        "alpha_026": -ts_max(correlation(ts_rank(m, 5), ts_rank(h, 5), 5), 3),
        "alpha_028": scale(correlation(adv(m, 20), lo, 5) + (h + lo) / 2 - c),
        "alpha_030": (1.0 - rank(sign(delta(c, 1)) + sign(delay(delta(c, 1), 1)) + sign(delay(delta(c, 1), 2)))) * ts_sum(m, 5) / ts_sum(m, 20),
        "alpha_032": scale(ts_mean(c, 7) - c) + scale(correlation(vw, delay(c, 5), 23)) * 20.0,
        "alpha_033": rank(-(1.0 - o / c)),
        "alpha_034": rank(1.0 - rank(stddev(r, 2) / stddev(r, 5)) + 1.0 - rank(delta(c, 1))),
        "alpha_035": ts_rank(m, 32) * (1.0 - ts_rank(c + h - lo, 16)) * (1.0 - ts_rank(r, 32)),
        "alpha_037": rank(correlation(delay(o - c, 1), c, 20)) + rank(o - c),
        "alpha_038": -rank(ts_rank(c, 10)) * rank(c / o),
        "alpha_040": -rank(stddev(h, 10)) * correlation(h, m, 10),
        "alpha_041": signed_power(h * lo, 0.5) - vw,
        "alpha_042": rank(vw - c) / rank(vw + c),
        "alpha_043": ts_rank(m / adv(m, 20), 20) * ts_rank(-delta(c, 7), 8),
        "alpha_044": -correlation(h, rank(v), 5),
        "alpha_045": -rank(ts_mean(delay(c, 5), 20)) * correlation(c, m, 2) * rank(correlation(ts_sum(c, 5), ts_sum(c, 20), 2)),
        "alpha_046": where((delay(c, 20) - delay(c, 10)) / 10 - (delay(c, 10) - c) / 10 > 0.25, -1.0, where((delay(c, 20) - delay(c, 10)) / 10 - (delay(c, 10) - c) / 10 < 0, 1.0, -(c - delay(c, 1)))),
        "alpha_049": where((delay(c, 20) - delay(c, 10)) / 10 - (delay(c, 10) - c) / 10 < -0.1, 1.0, -(c - delay(c, 1))),
        "alpha_050": -ts_max(rank(correlation(rank(m), rank(vw), 5)), 5),
        "alpha_052": (delay(ts_min(lo, 5), 5) - ts_min(lo, 5)) * rank((ts_sum(r, 40) - ts_sum(r, 20)) / 20) * ts_rank(m, 5),
        "alpha_053": -delta((c - lo - (h - c)) / (c - lo), 9),
        "alpha_054": -((lo - c) * signed_power(o, 5.0)) / ((lo - h) * signed_power(c, 5.0)),
        "alpha_055": -correlation(rank((c - ts_min(lo, 12)) / (ts_max(h, 12) - ts_min(lo, 12))), rank(m), 6),
        "alpha_057": -(c - vw) / decay_linear(rank(ts_argmax(c, 30)), 2),
        "alpha_058": -ts_rank(decay_linear(correlation(neutralize(vw, industry), m, 4), 8), 6),
        "alpha_060": -(scale(rank((c - lo - (h - c)) / (h - lo) * m)) * 2.0 - scale(rank(ts_argmax(c, 10)))),
        "alpha_066": -(rank(decay_linear(delta(vw, 4), 7)) + ts_rank(decay_linear((lo - vw) / (o - (h + lo) / 2), 11), 7)),
        "alpha_072": rank(decay_linear(correlation((h + lo) / 2, adv(m, 40), 9), 10)) / rank(decay_linear(correlation(ts_rank(vw, 4), ts_rank(m, 19), 7), 3)),
        "alpha_077": minimum(rank(decay_linear((h + lo) / 2 + h - (vw + h), 20)), rank(decay_linear(correlation((h + lo) / 2, adv(m, 40), 3), 6))),
        "alpha_083": rank(delay((h - lo) / (ts_sum(c, 5) / 5), 2)) * rank(rank(m)) / ((h - lo) / (ts_sum(c, 5) / 5) / (vw - c)),
        "alpha_084": signed_power(ts_rank(vw - ts_max(vw, 15), 21), 2.0),
        "alpha_085": signed_power(rank(correlation(h * 0.876703 + c * 0.123297, adv(m, 30), 10)), rank(correlation(ts_rank((h + lo) / 2, 4), ts_rank(m, 10), 7))),
        "alpha_101": (c - o) / (h - lo + 0.001),
        # Short-horizon price and volume factors.
        "short_momentum": c - delay(c, 5),
        "short_reversal": -delta(c, 5, order=False) / delay(c, 5),
        "price_position": ((c - lo) - (h - c)) / (h - lo) * v,
        "up_volume_share": ts_sum(where(up, v, 0.0), 12) / ts_sum(v, 12),
        "up_days": ts_count(up, 12) / 12.0 * 100.0,
        "down_pressure": ts_sum(where(down, v, 0.0), 12) / ts_sum(v, 12),
        "true_range_mean": ts_mean(true_range, 6),
        "bias_6": (c - ts_mean(c, 6)) / ts_mean(c, 6) * 100.0,
        "bias_12": (c - ts_mean(c, 12)) / ts_mean(c, 12) * 100.0,
        "stochastic_9": (c - ts_min(lo, 9)) / (ts_max(h, 9) - ts_min(lo, 9)) * 100.0,
        "williams_6": (ts_max(h, 6) - c) / (ts_max(h, 6) - ts_min(lo, 6)) * 100.0,
        "on_balance_change": ts_sum(where(up, v, where(down, -v, 0.0)), 6),
        "volume_variation": stddev(v, 20) / ts_mean(v, 20),
        "money_variation": stddev(m, 20) / ts_mean(m, 20),
        "high_age": ts_argmax(h, 20),
        "low_age": ts_argmin(lo, 20),
        "channel_width": (ts_max(h, 20) - ts_min(lo, 20)) / c,
        "momentum_gap": returns(c, 12) - r,
        "illiquidity": ts_mean(absolute(r) / m, 6),
        "price_volume_slope": correlation(c, v, 12) * stddev(c, 12) / stddev(v, 12),
        "gap_open": o / delay(c, 1) - 1.0,
        "range_skew": (h + lo - c * 2.0) / (h - lo),
        "industry_relative": demean(r, (industry,)),
        "industry_rank": rank(r, (industry,)),
        "bounded_return": clip(r, -0.1, 0.1),
        "new_high": number(c >= ts_max(h, 12)),
    }
