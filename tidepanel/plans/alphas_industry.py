"""The rest of "101 Formulaic Alphas": those that compare with long averages of trading or take out industries."""

from __future__ import annotations

from ..functions.expr import Expr, absolute, adv, col, correlation, decay_linear, delay, delta, log, maximum, minimum, neutralize, number, power, product, rank, returns, scale, sign, stddev, ts_argmax, ts_argmin, ts_max, ts_mean, ts_min, ts_rank, ts_sum, where

o, h, lo, c, m, vw = (col(x) for x in ("open", "high", "low", "close", "money", "vwap"))
r, mid = returns(c), (h + lo) / 2

#: Formulas whose windows need more rows than a few years of months.
LONG = ("alpha_036", "alpha_039", "alpha_048", "alpha_061", "alpha_063", "alpha_064", "alpha_071", "alpha_076", "alpha_079", "alpha_081", "alpha_087", "alpha_093", "alpha_097")


def mixed(a: Expr, b: Expr, share: float) -> Expr:
    return a * share + b * (1 - share)


def formulas(industry: str = "industry", sector: str = "sector", cap: str = "cap") -> dict[str, Expr]:
    """Expressions by name."""
    out = lambda e: neutralize(e, industry)
    adv20, adv30, adv40, adv60 = (adv(m, d) for d in (20, 30, 40, 60))
    slowdown = (delay(c, 20) - delay(c, 10)) / 10 - (delay(c, 10) - c) / 10
    trade = correlation(rank(vw), rank(m), 5)
    a73, a92 = mixed(o, lo, 0.147155), number(mid + c < lo + o)
    return {
        "alpha_021": where(ts_mean(c, 8) + stddev(c, 8) < ts_mean(c, 2), -1.0, where(ts_mean(c, 2) < ts_mean(c, 8) - stddev(c, 8), 1.0, where(m / adv20 >= 1, 1.0, -1.0))),
        "alpha_027": where(rank(ts_sum(correlation(rank(m), rank(vw), 6), 2) / 2) > 0.5, -1.0, 1.0),
        "alpha_029": ts_min(product(rank(rank(scale(log(ts_sum(ts_min(rank(rank(-rank(delta(c - 1.0, 5)))), 2), 1))))), 1), 5) + ts_rank(delay(-r, 6), 5),
        "alpha_031": rank(rank(rank(decay_linear(-rank(rank(delta(c, 10))), 10)))) + rank(-delta(c, 3)) + sign(scale(correlation(adv20, lo, 12))),
        "alpha_036": rank(correlation(c - o, delay(m, 1), 15)) * 2.21 + rank(o - c) * 0.7 + rank(ts_rank(delay(-r, 6), 5)) * 0.73 + rank(absolute(correlation(vw, adv20, 6))) + rank((ts_mean(c, 200) - o) * (c - o)) * 0.6,
        "alpha_039": -rank(delta(c, 7) * (1.0 - rank(decay_linear(m / adv20, 9)))) * (1.0 + rank(ts_sum(r, 250))),
        "alpha_047": rank(1.0 / c) * m / adv20 * (h * rank(h - c) / ts_mean(h, 5)) - rank(vw - delay(vw, 5)),
        "alpha_048": out(correlation(delta(c, 1), delta(delay(c, 1), 1), 250) * delta(c, 1) / c) / ts_sum(power(delta(c, 1) / delay(c, 1), 2.0), 250),
        "alpha_051": where(slowdown < -0.05, 1.0, -(c - delay(c, 1))),
        "alpha_056": -(rank(ts_sum(r, 10) / ts_sum(ts_sum(r, 2), 3)) * rank(r * col(cap))),
        "alpha_059": -ts_rank(decay_linear(correlation(out(vw), m, 4), 16), 8),
        "alpha_061": number(rank(vw - ts_min(vw, 16)) < rank(correlation(vw, adv(m, 180), 17))),
        "alpha_062": -number(rank(correlation(vw, ts_sum(adv20, 22), 9)) < rank(number(rank(o) + rank(o) < rank(mid) + rank(h)))),
        "alpha_063": -(rank(decay_linear(delta(out(c), 2), 8)) - rank(decay_linear(correlation(mixed(vw, o, 0.318108), ts_sum(adv(m, 180), 37), 13), 12))),
        "alpha_064": -number(rank(correlation(ts_sum(mixed(o, lo, 0.178404), 12), ts_sum(adv(m, 120), 12), 16)) < rank(delta(mixed(mid, vw, 0.178404), 3))),
        "alpha_065": -number(rank(correlation(mixed(o, vw, 0.00817205), ts_sum(adv60, 8), 6)) < rank(o - ts_min(o, 13))),
        "alpha_067": -power(rank(h - ts_min(h, 2)), rank(correlation(neutralize(vw, sector), out(adv20), 6))),
        "alpha_068": -number(ts_rank(correlation(rank(h), rank(adv(m, 15)), 8), 13) < rank(delta(mixed(c, lo, 0.518371), 1))),
        "alpha_069": -power(rank(ts_max(delta(out(vw), 2), 4)), ts_rank(correlation(mixed(c, vw, 0.490655), adv20, 4), 9)),
        "alpha_070": -power(rank(delta(vw, 1)), ts_rank(correlation(out(c), adv(m, 50), 17), 17)),
        "alpha_071": maximum(ts_rank(decay_linear(correlation(ts_rank(c, 3), ts_rank(adv(m, 180), 12), 18), 4), 15), ts_rank(decay_linear(power(rank(lo + o - (vw + vw)), 2.0), 16), 4)),
        "alpha_073": -maximum(rank(decay_linear(delta(vw, 4), 2)), ts_rank(decay_linear(-(delta(a73, 2) / a73), 3), 16)),
        "alpha_074": -number(rank(correlation(c, ts_sum(adv30, 37), 15)) < rank(correlation(rank(mixed(h, vw, 0.0261661)), rank(m), 11))),
        "alpha_075": number(rank(correlation(vw, m, 4)) < rank(correlation(rank(lo), rank(adv(m, 50)), 12))),
        "alpha_076": -maximum(rank(decay_linear(delta(vw, 1), 11)), ts_rank(decay_linear(ts_rank(correlation(out(lo), adv(m, 81), 8), 19), 17), 19)),
        "alpha_078": power(rank(correlation(ts_sum(mixed(lo, vw, 0.352233), 19), ts_sum(adv40, 19), 6)), rank(trade)),
        "alpha_079": number(rank(delta(out(mixed(c, o, 0.60733)), 1)) < rank(correlation(ts_rank(vw, 3), ts_rank(adv(m, 150), 9), 14))),
        "alpha_080": -power(rank(sign(delta(out(mixed(o, h, 0.868128)), 4))), ts_rank(correlation(h, adv(m, 10), 5), 5)),
        "alpha_081": -number(rank(log(product(rank(power(rank(correlation(vw, ts_sum(adv(m, 10), 49), 8)), 4.0)), 14))) < rank(trade)),
        "alpha_082": -minimum(rank(decay_linear(delta(o, 1), 14)), ts_rank(decay_linear(correlation(out(m), o, 17), 6), 13)),
        "alpha_086": -number(ts_rank(correlation(c, ts_sum(adv20, 14), 6), 20) < rank(o + c - (vw + o))),
        "alpha_087": -maximum(rank(decay_linear(delta(mixed(c, vw, 0.369701), 1), 2)), ts_rank(decay_linear(absolute(correlation(out(adv(m, 81)), c, 13)), 4), 14)),
        "alpha_088": minimum(rank(decay_linear(rank(o) + rank(lo) - (rank(h) + rank(c)), 8)), ts_rank(decay_linear(correlation(ts_rank(c, 8), ts_rank(adv60, 20), 8), 6), 2)),
        "alpha_089": ts_rank(decay_linear(correlation(lo, adv(m, 10), 6), 5), 3) - ts_rank(decay_linear(delta(out(vw), 3), 10), 15),
        "alpha_090": -power(rank(c - ts_max(c, 4)), ts_rank(correlation(out(adv40), lo, 5), 3)),
        "alpha_091": -(ts_rank(decay_linear(decay_linear(correlation(out(c), m, 9), 16), 3), 4) - rank(decay_linear(correlation(vw, adv30, 4), 2))),
        "alpha_092": minimum(ts_rank(decay_linear(a92, 14), 18), ts_rank(decay_linear(correlation(rank(lo), rank(adv30), 7), 6), 6)),
        "alpha_093": ts_rank(decay_linear(correlation(out(vw), adv(m, 81), 17), 19), 7) / rank(decay_linear(delta(mixed(c, vw, 0.524434), 2), 16)),
        "alpha_094": -power(rank(vw - ts_min(vw, 11)), ts_rank(correlation(ts_rank(vw, 19), ts_rank(adv60, 4), 18), 2)),
        "alpha_095": number(rank(o - ts_min(o, 12)) < ts_rank(power(rank(correlation(ts_sum(mid, 19), ts_sum(adv40, 19), 12)), 5.0), 11)),
        "alpha_096": -maximum(ts_rank(decay_linear(correlation(rank(vw), rank(m), 3), 4), 8), ts_rank(decay_linear(ts_argmax(correlation(ts_rank(c, 7), ts_rank(adv60, 4), 3), 12), 14), 13)),
        "alpha_097": -(rank(decay_linear(delta(out(mixed(lo, vw, 0.721001)), 3), 20)) - ts_rank(decay_linear(ts_rank(correlation(ts_rank(lo, 7), ts_rank(adv60, 17), 4), 18), 15), 6)),
        "alpha_098": rank(decay_linear(correlation(vw, ts_sum(adv(m, 5), 26), 4), 7)) - rank(decay_linear(ts_rank(ts_argmin(correlation(rank(o), rank(adv(m, 15)), 20), 8), 6), 8)),
        "alpha_099": -number(rank(correlation(ts_sum(mid, 19), ts_sum(adv60, 19), 8)) < rank(correlation(lo, m, 6))),
        "alpha_100": -(scale(out(out(rank((c - lo - (h - c)) / (h - lo) * m)))) * 1.5 - scale(out(correlation(c, rank(adv20), 5) - rank(ts_argmin(c, 30))))) * (m / adv20),
    }
