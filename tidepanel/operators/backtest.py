"""A backtest that depends on its own path: cash, whole shares, fees, suspended codes.

Each strategy is one group; its rows are the bars of the codes that it ever selects,
so a group is bounded by the calendar and the selection, and strategies run side by side.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "strategy {s}, date {d}, cash double, holdings double, nav double, fee double, n_held long, n_unfilled long"


def _trade(held: dict, cash: float, want: dict, price: dict, open_: set, buy_fee: float, sell_fee: float) -> tuple[float, float]:
    """Moves the holdings toward the wanted shares, sales first; buys shrink to the whole shares that the cash pays.  Codes that cannot trade stay."""
    fees = 0.0
    moves = sorted((want.get(k, 0) - held.get(k, 0), k) for k in want.keys() | held.keys() if k in open_)
    for n, k in moves:
        if n > 0:
            n = min(n, int(max(cash, 0.0) / (price[k] * (1 + buy_fee)) + 1e-9))
        fee = abs(n) * price[k] * (buy_fee if n > 0 else sell_fee)
        cash -= n * price[k] + fee
        fees += fee
        held[k] = held.get(k, 0) + n
        if not held[k]:
            del held[k]
    return cash, fees


def backtest(targets: DataFrame, bars: DataFrame, cash: float = 1e6, buy_fee: float = 0.0002, sell_fee: float = 0.0012, stop: float | None = None, price: str = "close") -> DataFrame:
    """One row for each strategy and date: cash, value held, fees, positions, positions that could not be sold.

    ``targets`` (strategy, date, code, weight) tells what to hold from a date on; ``bars`` (date, code, price, tradable).  Dates
    without a target hold.  Weights are shares of the value at the date's prices.  With ``stop`` a holding that has
    lost that share since its purchase is sold.  A code without a price keeps its last one and does not trade.
    """
    chosen = targets.select("strategy", "code").distinct()
    rows = bars.select("date", "code", F.col(price).cast("double").alias("price"), F.coalesce("tradable", F.lit(True)).alias("tradable")).join(chosen, "code")
    rows = rows.join(targets.select("strategy", "date", "code", "weight"), ["strategy", "date", "code"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict = {}
        cost: dict = {}
        last: dict = {}
        money, out = cash, []
        for date, day in pdf.sort_values(["date", "code"]).groupby("date", sort=True):
            good = day["price"].notna() & (day["price"] > 0)
            now = dict(zip(day["code"][good], day["price"][good], strict=True))
            last.update(now)
            tradable = set(day["code"][good & day["tradable"]])
            value = money + sum(n * last[k] for k, n in held.items())
            want, due = dict(held), day["weight"].notna()
            if due.any():
                want = {k: int(w * value / last[k]) for k, w in zip(day["code"][due], day["weight"][due], strict=True) if k in last}
            elif stop is not None:
                want = {k: n for k, n in held.items() if last[k] > cost[k] * (1 - stop)}
            before = dict(held)
            money, fees = _trade(held, money, want, last, tradable, buy_fee, sell_fee)
            for k, n in held.items():  # mean cost of what was bought
                more = n - before.get(k, 0)
                if more > 0:
                    cost[k] = (cost.get(k, 0.0) * before.get(k, 0) + last[k] * more) / n
            worth = sum(n * last[k] for k, n in held.items())
            stuck = sum(held.get(k, 0) > want.get(k, 0) for k in held)
            out.append((pdf["strategy"].iloc[0], date, money, worth, money + worth, fees, len(held), stuck))
        return pd.DataFrame(out, columns=["strategy", "date", "cash", "holdings", "nav", "fee", "n_held", "n_unfilled"])

    kinds = SCHEMA.format(s=targets.schema["strategy"].dataType.simpleString(), d=bars.schema["date"].dataType.simpleString())
    return rows.groupBy("strategy").applyInPandas(run, kinds)
