"""Signed trades, safe quotients and the flat test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# An amount closer to zero than this is a closed position: allocation shares such as 1/3
# leave residues of the order 1e-16 per fill.
FLAT_TOLERANCE = 1e-9


def signed_cost() -> Column:
    """Cash paid for a fill: price times quantity, negative for sells, plus commission."""
    gross = F.col("avgPrice") * F.col("tradeQty")
    return F.when(F.col("side") == "BUY", gross).otherwise(-gross) + F.col("commission")


def signed_qty() -> Column:
    """Quantity of a fill, negative unless bought."""
    return F.when(F.col("side") == "BUY", F.col("tradeQty")).otherwise(-F.col("tradeQty"))


def snap_flat(amount: Column) -> Column:
    """The amount, exactly zero when the position is closed."""
    return F.when(F.abs(amount) < FLAT_TOLERANCE, F.lit(0.0)).otherwise(amount)


def trade_price(cost: Column, qty: Column) -> Column:
    """Average price of a trade; NULL when its fills net to zero."""
    return F.try_divide(cost, snap_flat(qty))
