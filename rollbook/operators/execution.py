"""Execution: the order record, matching broker fills, status updates and confirmations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.times import to_stamp
from rollbook.schemas import FILLS, ORDERS, conform

LEG = ["api_internal_tag", "api_clientId", "secId"]


def placed_orders(bodies: DataFrame, session: str, client_id: int, now: Column,
                  client: str = "IB") -> DataFrame:
    """Order-record rows for orders handed to a broker; `bodies` brings the broker's order id."""
    return conform(bodies.select(
        F.lit(session).alias("sessionId"), "api_internal_tag", F.lit(client).alias("api_client"),
        F.lit(client_id).alias("api_clientId"), F.col("symbol").alias("secId"), "secType",
        "orderType", F.col("action").alias("side"), F.col("totalQuantity").alias("totalQty"),
        "order_itag", now.alias("placed_timestamp"), F.lit("open").alias("status"),
        F.lit(None).alias("status_timestamp"), "reply_to"), ORDERS)


def open_orders(orders: DataFrame, client: str = "IB", session: Column | None = None) -> DataFrame:
    """Open orders of a client, of one session if given."""
    rows = orders.where((F.col("api_client") == client) & (F.col("status") == "open"))
    if session is not None:
        rows = rows.where(F.col("sessionId") == session)
    return rows.drop("status", "status_timestamp", "reply_to")


def filled_totals(fills: DataFrame) -> DataFrame:
    """Shares filled per broker order and security."""
    return fills.groupBy(*LEG).agg(F.sum("tradeQty").alias("totalQty"))


def match_fills(open_: DataFrame, fills: DataFrame) -> DataFrame:
    """Fills of orders that are completely filled, as fill-record rows.

    Totals are aggregated and joined to the orders first; an order with very many fills meets
    them in a join, which AQE can split, not in a window.
    """
    done = open_.join(filled_totals(fills), [*LEG, "totalQty"])
    return conform(done.join(fills, LEG), FILLS)


def filled_tags(matched: DataFrame) -> DataFrame:
    return matched.select("order_itag").distinct()


def mark_filled(orders: DataFrame, matched: DataFrame, now: Column) -> DataFrame:
    """The order record with matched orders set to filled."""
    hits = filled_tags(matched).withColumn("_hit", F.lit(True))
    joined = orders.join(hits, "order_itag", "left")
    return joined.withColumns({
        "status": F.when(F.col("_hit"), "filled").otherwise(F.col("status")),
        "status_timestamp": F.when(F.col("_hit"), now).otherwise(F.col("status_timestamp")),
    }).select(*orders.columns)


def filled_counts(orders: DataFrame, matched: DataFrame) -> DataFrame:
    """One row: orders to update and distinct filled tags, which must agree."""
    tags = filled_tags(matched)
    n_tags = tags.agg(F.count(F.lit(1))).scalar()
    return (
        orders.join(tags, "order_itag", "left_semi")
        .agg(F.count(F.lit(1)).alias("n_orders"))
        .withColumn("n_tags", n_tags)
        .withColumn("consistent", F.col("n_orders") == F.col("n_tags")))


def check_filled_counts(orders: DataFrame, matched: DataFrame) -> None:
    row = filled_counts(orders, matched).first()
    if not row["consistent"]:
        raise ValueError(f"{row['n_orders']} orders to update for {row['n_tags']} filled tags")


def confirmations(matched: DataFrame) -> DataFrame:
    """One fill event per order with its distinct fill times, sorted.

    Orders are good for a day, so their second-precision times are at most 86,400.
    """
    return (
        matched.select("order_itag", "sessionId", to_stamp(F.col("fill_timestamp")).alias("t"))
        .groupBy("order_itag", "sessionId")
        .agg(F.array_sort(F.collect_set("t")).alias("fill_timestamps")))
