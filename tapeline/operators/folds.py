"""Order-dependent folds that SQL cannot express: one account, symbol or profile per group, each bounded by what it holds in time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

FEE = 1.15


def paper_fills(orders: DataFrame, cash: float = 1000.0, fee: float = FEE) -> DataFrame:
    """Orders (account, seq, symbol, action, quantity, price) in order: buys are clamped to the cash, sells to the position, nothing left is rejected."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        held, money, out = {}, cash, []
        for o in rows.sort_values("seq").itertuples(index=False):
            q = min(o.quantity, max(0.0, (money - fee) / o.price) if o.price > 0 else 0.0) if o.action == "buy" else min(o.quantity, held.get(o.symbol, 0.0))
            filled = q > 0
            if filled:
                sign = 1 if o.action == "buy" else -1
                held[o.symbol] = held.get(o.symbol, 0.0) + sign * q
                money -= sign * q * o.price + fee
            out.append((o.account, o.seq, o.symbol, o.action, q if filled else 0.0, "filled" if filled else "rejected", money, held.get(o.symbol, 0.0)))
        return pd.DataFrame(out, columns=["account", "seq", "symbol", "action", "filled", "status", "cash_after", "position_after"])

    return orders.groupBy("account").applyInPandas(fold, "account string, seq long, symbol string, action string, filled double, status string, cash_after double, position_after double")


def suppress_neighbours(peaks: DataFrame, width: int = 5, keys: list[str] | None = None) -> DataFrame:
    """Peaks (keys, by default symbol; i, v): by falling volume, each suppresses those within `width` positions; ties by position."""
    keys = keys or ["symbol"]

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        chosen: set[int] = set()
        for i in rows.sort_values(["v", "i"], ascending=[False, True])["i"]:
            if chosen.isdisjoint(range(i - width, i + width + 1)):
                chosen.add(i)
        return rows[rows["i"].isin(chosen)]

    narrow = peaks.select(*keys, "i", "v")
    return narrow.groupBy(*keys).applyInPandas(keep, narrow.schema)


def value_area(profile: DataFrame, share: float = 0.7) -> DataFrame:
    """Profile (symbol, bin, v): grown from the fullest bin (lowest of equals) by the fuller neighbour, the upper on a tie, until `share` of the volume is inside."""

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        v = rows.sort_values("bin")["v"].tolist()
        lo = hi = v.index(max(v))
        total, inside = sum(v), v[lo]
        while inside < share * total:
            up, down = v[hi + 1] if hi + 1 < len(v) else -1, v[lo - 1] if lo else -1
            if up >= down:
                hi, inside = hi + 1, inside + up
            else:
                lo, inside = lo - 1, inside + down
        return pd.DataFrame({"symbol": [rows["symbol"].iloc[0]], "low_bin": [lo], "high_bin": [hi], "inside": [inside]})

    return profile.groupBy("symbol").applyInPandas(grow, "symbol string, low_bin int, high_bin int, inside long")
