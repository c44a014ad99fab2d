"""Factors on money flow by order size, on accounts and on forecasts, as expressions."""

from __future__ import annotations

from ..functions.expr import Expr, absolute, average_rank, col, correlation, cs_count, delay, delta, lit, log, number, picked_sum, rank, regression_slope, returns, sample_std, ts_mean, ts_rank, ts_sum, where, zscore


def mean(x: Expr, d: int) -> Expr:
    return ts_mean(x, d, d)


def money_flow(d: int = 6) -> dict[str, dict[str, Expr]]:
    """On buy_ and sell_ of sm, md and lg, close and money."""
    buy, sell = ({k: col(f"{s}_{k}") for k in ("sm", "md", "lg")} for s in ("buy", "sell"))
    net = {k: buy[k] - sell[k] for k in buy}
    gross = {k: buy[k] + sell[k] for k in buy}
    total = gross["sm"] + gross["md"] + gross["lg"]
    every = net["sm"] + net["md"] + net["lg"]
    r = returns(col("close"))
    pct = {k: net[k] / total for k in net}
    return {
        "shares": {**{f"net_{k}": pct[k] for k in pct}, "net_all": every / total, "large_share": gross["lg"] / total, "small_share": gross["sm"] / total, "large_over_small": net["lg"] / gross["sm"]},
        "trailing": {
            **{f"mean_{k}": mean(pct[k], d) for k in pct},
            **{f"strength_{k}": ts_sum(net[k], d, d) / ts_sum(absolute(net[k]), d, d) for k in net},
            "persistence": mean(pct["lg"], d) / sample_std(pct["lg"], d),
            "large_rank": ts_rank(pct["lg"], d * 2),
        },
        "with_price": {
            "corr_large": correlation(pct["lg"], r, d),
            "corr_small": correlation(pct["sm"], r, d),
            "corr_ahead": correlation(delay(pct["lg"], 1), r, d),
            "slope_large": regression_slope(r, pct["lg"], d),
            "residual_small": zscore(pct["sm"]) - zscore(r),
            "divergence": rank(pct["lg"]) - rank(r),
            "return_on_large": picked_sum(r, gross["lg"] / total, d * 2, d, lowest=False),
            "return_on_small": picked_sum(r, gross["lg"] / total, d * 2, d),
        },
    }


def accounts() -> dict[str, dict[str, Expr]]:
    """On quarters of revenue, cost, cash, receivable, assets, equity: trailing years are the last four rows."""
    revenue, cost, cash, receivable, assets, equity = (col(k) for k in ("revenue", "cost", "cash", "receivable", "assets", "equity"))
    profit = revenue - cost
    year = lambda e: ts_sum(e, 4, 4)
    usual = lambda e: (e + delay(e, 4)) / 2
    roe, roa, margin = year(profit) / equity, year(profit) / usual(assets), profit / revenue
    debt = assets - equity
    return {
        "profit": {"roe": roe, "roa": roa, "gross_margin": margin, "year_margin": year(profit) / year(revenue), "margin_change": delta(margin, 4, order=False), "cost_ratio": year(cost) / year(revenue)},
        "growth": {"revenue_growth": returns(revenue, 4), "profit_growth": delta(profit, 4, order=False) / absolute(delay(profit, 4)), "asset_growth": returns(assets, 4), "growth_change": delta(returns(revenue, 4), 1), "trend": regression_slope(log(revenue), delay(log(revenue), 1), 8)},
        "operation": {"asset_turnover": year(revenue) / usual(assets), "receivable_turnover": year(revenue) / usual(receivable), "turnover_change": delta(year(revenue) / assets, 4, order=False), "receivable_share": receivable / assets},
        "cashflow": {"cash_to_revenue": year(cash) / year(revenue), "cash_to_profit": year(cash) / absolute(year(profit)), "accruals": (year(profit) - year(cash)) / usual(assets), "accrual_rank": 1.0 - rank((profit - cash) / assets)},
        "leverage": {"debt_ratio": debt / assets, "multiplier": assets / equity, "cover": year(cash) / debt},
        "quality": {
            "stability": mean(profit, 8) / sample_std(profit, 8),
            "revenue_noise": sample_std(returns(revenue), 8),
            "signals": number(year(profit) > 0) + number(year(cash) > 0) + number(year(cash) > year(profit)) + number(delta(roa, 4, order=False) > 0) + number(delta(margin, 4, order=False) > 0) + number(delta(year(revenue) / assets, 4, order=False) > 0),
            "du_pont": (year(profit) / year(revenue)) * (year(revenue) / assets) * (assets / equity),
        },
    }


def forecasts() -> dict[str, dict[str, Expr]]:
    """On mean, std and n of a monthly consensus."""
    m, s, n = col("mean"), col("std"), col("n") * lit(1.0)
    spread = sample_std(m, 6)
    return {
        "consensus": {
            "level_rank": rank(m),
            "change_1": returns(m, 1),
            "change_3": returns(m, 3),
            "dispersion": s / absolute(m),
            "coverage": log(n),
            "coverage_rank": average_rank(n) / cs_count(n),
            "coverage_change": delta(n, 3, order=False),
            "up_share": mean(number(m > delay(m, 1)), 6),
            "surprise": where(spread > 1e-3, (m - mean(m, 6)) / spread, None),
            "agreement": zscore(returns(m, 1)) - zscore(s / absolute(m)),
        }
    }
