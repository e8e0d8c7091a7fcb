"""Order intake: numbering, blotter, allocations, status log and risk check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.ranking import blocked_row_number
from rollbook.functions.times import from_stamp
from rollbook.schemas import BLOTTER, BLOTTER_ALLOC, BLOTTER_LOG, conform

SUPPORTED_TYPE = "STK"

# Statuses an order passes through.
RECEIVED = "receivedByAutoPort"
DENIED = "deniedByRiskManager"
NOT_SENT = "orderNotSent"
DISPATCHED = "dispatchedToAutoExec"
CONFIRMED = "fill_confirmed"
CLIENT_CLOSED = "AutoExec client is closed"


def day_of(itag: Column) -> Column:
    return F.substring(itag, 1, 6)


def last_numbers(orders: DataFrame) -> DataFrame:
    """The highest order number used per day (yyMMdd), from the order tags."""
    number = F.substring("order_itag", 7, 20).try_cast("long")
    return (
        orders.select(day_of(F.col("order_itag")).alias("day"), number.alias("n"))
        .groupBy("day").agg(F.coalesce(F.max("n"), F.lit(0)).alias("last_number")))


def last_number(orders: DataFrame, day: str) -> DataFrame:
    """The highest order number of one day; 0 if there is none."""
    return last_numbers(orders.where(F.col("order_itag").startswith(day))).where(
        F.col("day") == day).agg(F.coalesce(F.max("last_number"), F.lit(0)).alias("last_number"))


def numbered(signals: DataFrame, used: DataFrame | None = None, arrival: str = "arrival",
             block: Column | None = None) -> DataFrame:
    """Add `order_itag`: the signal's day and a counter running on from the day's last number.

    Signals of a day are ordered by time and arrival, and counted minute by minute. When one
    minute may hold too many signals, pass a finer non-decreasing `block`.
    """
    minute = F.substring("signal_timestamp", 1, 12)
    rows = signals.withColumn("_day", F.substring("signal_timestamp", 3, 6))
    rows = blocked_row_number(
        rows, ["_day"], ["signal_timestamp", arrival], minute if block is None else block, "_n")
    if used is not None:
        rows = rows.join(used.withColumnRenamed("day", "_day"), "_day", "left").withColumn(
            "_n", F.col("_n") + F.coalesce("last_number", F.lit(0))).drop("last_number")
    number = F.col("_n").cast("string")
    padded = F.when(F.length(number) < 8, F.lpad(number, 8, "0")).otherwise(number)
    return rows.withColumn("order_itag", F.concat("_day", padded)).drop("_day", "_n")


def received_at() -> Column:
    return from_stamp(F.col("signal_timestamp"))


def blotter_rows(orders: DataFrame, now: Column | None = None) -> DataFrame:
    """Orders as blotter rows."""
    return conform(orders.select(
        (received_at() if now is None else now).alias("timestamp"), "order_itag",
        F.col("symbol").alias("secId"), "secType", F.col("action").alias("side"),
        F.col("totalQuantity").alias("tradeQty"), "orderType",
        F.col("lmtPrice").cast("string").alias("orderParams"), "placerId"), BLOTTER)


def allocation_rows(orders: DataFrame, now: Column | None = None) -> DataFrame:
    """One row per portfolio of each order's allocation map."""
    return conform(orders.select(
        (received_at() if now is None else now).alias("timestamp"), "order_itag",
        F.explode("portAlloc").alias("port", "Alloc"), "typeAlloc"), BLOTTER_ALLOC)


def passes_risk(pass_through: bool = True) -> Column:
    """Only supported security types pass, and only while orders are let through."""
    return (F.col("secType") == SUPPORTED_TYPE) & F.lit(pass_through)


def risk_split(orders: DataFrame, pass_through: bool = True) -> tuple[DataFrame, DataFrame]:
    """(confirmed, denied)."""
    checked = orders.withColumn("_ok", F.coalesce(passes_risk(pass_through), F.lit(False)))
    return checked.where("_ok").drop("_ok"), checked.where(~F.col("_ok")).drop("_ok")


def order_bodies(orders: DataFrame, confirmed_at: Column) -> DataFrame:
    """What execution gets of a confirmed order."""
    return orders.select(
        "symbol", "orderType", "action", "totalQuantity", "lmtPrice", "secType",
        F.col("signal_timestamp").alias("origination_time_stamp"),
        F.date_format(confirmed_at, "yyMMddHHmmss").alias("confirmation_time_stamp"),
        "order_itag")


def status_log(orders: DataFrame, pass_through: bool = True, client_open: bool = True,
               now: Column | None = None) -> DataFrame:
    """Status rows an order leaves on intake: received, then denied, not sent or dispatched."""
    def entry(status: Column | str, note: Column | str = "") -> Column:
        as_col = [F.lit(x) if isinstance(x, str) else x for x in (status, note)]
        return F.struct(as_col[0].alias("status"), as_col[1].alias("note"))

    ok = F.coalesce(passes_risk(pass_through), F.lit(False))
    sent = entry(DISPATCHED) if client_open else entry(NOT_SENT, CLIENT_CLOSED)
    entries = F.array(entry(RECEIVED), F.when(ok, sent).otherwise(entry(DENIED)))
    return conform(
        orders.select("order_itag", F.explode(entries).alias("e"),
                      (received_at() if now is None else now).alias("timestamp"))
        .select("order_itag", "e.status", "e.note", "timestamp"), BLOTTER_LOG)


def confirmation_log(fill_events: DataFrame, now: Column) -> DataFrame:
    """Log rows for fill confirmations."""
    return conform(fill_events.select(
        "order_itag", F.lit(CONFIRMED).alias("status"), F.lit("").alias("note"),
        now.alias("timestamp")), BLOTTER_LOG)
