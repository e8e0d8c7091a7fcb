"""Broker reports: nested fills and open trades to flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.functions.times import DESK_ZONE, instant_in_zone, millis, utc_in_zone


def flatten_fills(reports: DataFrame, zone: str = DESK_ZONE) -> DataFrame:
    """One flat row per fill in desk wall clock.

    `time` is an instant, or a UTC wall clock when it has no zone. Side, account and cumulative
    fields are the broker's own and are left out; the order record brings ours.
    """
    naive = reports.schema["time"].dataType == T.TimestampNTZType()
    wall = utc_in_zone(F.col("time"), zone) if naive else instant_in_zone(F.col("time"), zone)
    return reports.select(
        millis(wall).alias("fill_timestamp"),
        F.col("contract.symbol").alias("secId"),
        F.col("execution.orderId").alias("api_internal_tag"),
        F.col("execution.clientId").alias("api_clientId"),
        F.col("execution.shares").alias("tradeQty"),
        F.col("execution.avgPrice").alias("avgPrice"),
        F.col("commissionReport.commission").alias("commission"))


def open_trades(trades: DataFrame, zone: str = DESK_ZONE) -> DataFrame:
    """Summary of trades still open at the broker, with the time of their last log entry.

    `trades` nests order, contract, orderStatus and log (an array of structs with `time`).
    """
    last = F.try_element_at("log", F.lit(-1))["time"]
    wall = instant_in_zone(last, zone)
    return trades.select(
        "order.clientId", "order.orderId", "order.action", "order.totalQuantity",
        "order.orderType", "order.lmtPrice", "contract.symbol",
        "orderStatus.status", "orderStatus.filled", "orderStatus.remaining",
        F.coalesce(F.date_format(wall, "yyMMdd-HH:mm:ss"), F.lit("")).alias("lastLog"))
