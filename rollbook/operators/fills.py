"""Fills to trades: signing, netting, allocation over portfolios."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.money import signed_cost, signed_qty, snap_flat, trade_price
from rollbook.functions.ranking import latest_per_key
from rollbook.functions.times import ntz
from rollbook.operators.grid import Grid, assign_steps


def in_interval(fills: DataFrame, after: dt.datetime | None, upto: dt.datetime | None) -> DataFrame:
    """Fills with `after < fill_timestamp <= upto`."""
    when = F.col("fill_timestamp")
    if after is not None:
        fills = fills.where(when > ntz(after))
    if upto is not None:
        fills = fills.where(when <= ntz(upto))
    return fills


def signed_by_order(fills: DataFrame) -> DataFrame:
    """Signed cost and quantity summed per security and order."""
    return (
        fills.select(
            "secType", "secId", "order_itag",
            signed_cost().alias("cost"), signed_qty().alias("qty"))
        .groupBy("secType", "secId", "order_itag")
        .agg(F.sum("cost").alias("trade_cost_basis"), F.sum("qty").alias("amount_variation")))


def current_allocation(alloc: DataFrame) -> DataFrame:
    """The last allocation recorded per order and portfolio."""
    return latest_per_key(alloc, ["order_itag", "port"], ["timestamp"]).drop("timestamp")


def _by_amount() -> Column:
    return F.col("typeAlloc") == "amount"


def processed_fills(
    fills: DataFrame,
    alloc: DataFrame,
    after: dt.datetime | None = None,
    upto: dt.datetime | None = None,
) -> DataFrame:
    """Trades of one interval per order and portfolio.

    An `amount` allocation hands each portfolio a fixed number of shares in the direction of
    the trade, any other a share of it. Orders without allocation keep a NULL portfolio.
    """
    qty, cost = F.col("amount_variation"), F.col("trade_cost_basis")
    per_port = signed_by_order(in_interval(fills, after, upto)).join(
        current_allocation(alloc), "order_itag", "left")
    cost_p = F.when(
        _by_amount(), F.abs(F.try_divide(F.col("Alloc"), qty)) * cost).otherwise(
        F.col("Alloc") * cost)
    qty_p = F.when(_by_amount(), F.signum(qty) * F.col("Alloc")).otherwise(qty * F.col("Alloc"))
    return (
        per_port.select(
            "secType", "secId", "order_itag", "port", "typeAlloc",
            cost_p.alias("trade_cost_basis"), qty_p.alias("amount_variation"))
        .withColumn("trade_avgPrice", trade_price(cost, qty)))


def unallocated(fills: DataFrame, alloc: DataFrame) -> DataFrame:
    """Fills whose order was never allocated; they move no position."""
    return fills.join(alloc.select("order_itag"), "order_itag", "left_anti")


def step_trades(fills: DataFrame, alloc: DataFrame, grid: Grid, keys: DataFrame | None = None) -> DataFrame:
    """Net trade per (ticker, port, step).

    Each fill takes its share of the order's allocation (`Alloc / totalQty` of it under an
    `amount` allocation), so an order filled over several steps is allocated once. The share is
    linear in the fill, hence fills meet their allocation unaggregated and are summed straight
    to the netted trades, partially before the shuffle.

    `keys` (fill_timestamp at least) may name the fills' times, or more, where that is cheaper than
    to read the fills a second time.
    """
    qty, cost = F.col("_qty"), F.col("_cost")
    placed = assign_steps(
        fills.select(
            "order_itag", F.col("secId").alias("ticker"), "totalQty", "fill_timestamp",
            signed_cost().alias("_cost"), signed_qty().alias("_qty")),
        "fill_timestamp", grid, keys).drop("fill_timestamp")

    def share(x: Column) -> Column:
        return F.when(
            _by_amount(), F.try_divide(x * F.col("Alloc"), F.col("totalQty"))).otherwise(
            x * F.col("Alloc"))

    return (
        placed.join(current_allocation(alloc), "order_itag")
        .select("ticker", "port", "step", share(qty).alias("dq"), share(cost).alias("cost"))
        .groupBy("ticker", "port", "step")
        .agg(snap_flat(F.sum("dq")).alias("dq"), F.sum("cost").alias("cost")))
