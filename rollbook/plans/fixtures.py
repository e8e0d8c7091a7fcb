"""Views with the engine's table schemas over the given test tables.

`sql` texts of the same views for the oracle are in `oracle.py`. Prices and commissions are cut
to binary fractions, so sums of doubles do not depend on their order.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions.times import ntz
from rollbook.session import spread

# Opening time of the books, before the first shipment.
OPENED = dt.datetime(1994, 12, 1)


# Columns of the test tables in use; a given schema spares reading the files' footers first.
TABLES = {
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey long, p_name string, p_size int, p_retailprice double",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _ticker() -> Column:
    return F.concat(F.lit("P"), F.col("l_partkey").cast("string"))


def _tick_price() -> Column:
    return F.floor(F.try_divide("l_extendedprice", "l_quantity") * 64) / F.lit(64.0)


def _month(c: str) -> Column:
    return F.trunc(F.col(c).cast("date"), "month").cast("timestamp_ntz")


def _side() -> Column:
    bought = (F.col("l_returnflag") == "A") | (
        (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"))
    return F.when(bought, "BUY").otherwise("SELL")


def _trade_qty() -> Column:
    return (F.lit(4) * (1 + F.col("l_quantity") % 3)).cast("double")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


def raw_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lineitem row as one fill."""
    return _lines(spark, sf_dir).select(
        F.lit("STK").alias("secType"),
        _ticker().alias("secId"),
        F.col("l_orderkey").cast("string").alias("order_itag"),
        _side().alias("side"),
        _trade_qty().alias("tradeQty"),
        _tick_price().alias("avgPrice"),
        (F.floor(F.col("l_tax") * 128) / F.lit(128.0)).alias("commission"),
        F.col("l_shipdate").alias("fill_timestamp"))


def fill_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order and time of every fill, without the fill record's join."""
    return raw_fills(spark, sf_dir).select("order_itag", "fill_timestamp")


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills with their order's total quantity, as the fill record stores them."""
    totals = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_itag"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 16.0)
        .when(F.col("o_orderpriority") == "2-HIGH", 8.0)
        .otherwise(32.0).alias("totalQty"))
    return raw_fills(spark, sf_dir).join(totals, "order_itag")


def alloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allocations: fixed shares for urgent orders, percentages else, none for low priority.

    Pending orders also have an older record with other values.
    """
    orders = table(spark, sf_dir, "orders")
    fixed = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    kind = F.when(fixed, "amount").otherwise("percent")

    def ports(one: Column, two: Column) -> Column:
        return F.array(
            F.struct(F.lit("1").alias("port"), one.alias("Alloc")),
            F.struct(F.lit("2").alias("port"), two.alias("Alloc")))

    now = ports(F.when(fixed, 2.0).otherwise(0.75), F.when(fixed, 1.0).otherwise(0.25))
    old = ports(F.lit(0.5), F.lit(0.5))
    base = orders.where(F.col("o_orderpriority") != "5-LOW").select(
        F.col("o_orderdate").alias("timestamp"),
        F.col("o_orderkey").cast("string").alias("order_itag"),
        kind.alias("typeAlloc"), "o_orderstatus", F.explode(now).alias("p"))
    older = orders.where(
        (F.col("o_orderpriority") != "5-LOW") & (F.col("o_orderstatus") == "P")).select(
        (F.col("o_orderdate") - F.expr("INTERVAL 1 DAY")).alias("timestamp"),
        F.col("o_orderkey").cast("string").alias("order_itag"),
        F.lit("percent").alias("typeAlloc"), "o_orderstatus", F.explode(old).alias("p"))
    return base.unionByName(older).select(
        "timestamp", "order_itag", "p.port", "p.Alloc", "typeAlloc")


def price_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lineitem row as a write of its part's price for the month."""
    return _lines(spark, sf_dir).select(
        _month("l_shipdate").alias("date"), _ticker().alias("ticker"),
        _tick_price().alias("price"), F.col("l_shipdate").alias("timestamp_write"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One price per part and month with shipments."""
    return price_writes(spark, sf_dir).groupBy("date", "ticker").agg(
        F.max("price").alias("price"), F.max("timestamp_write").alias("timestamp_write"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times to mark at: the start of every month shipped in, and of the next."""
    days = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("day")).distinct()
    return days.select(_month("day").alias("m")).distinct().select(
        F.explode(F.array("m", F.col("m") + F.expr("INTERVAL 1 MONTH"))).alias("event_ts")
    ).distinct()


def opening_cash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cash of ports 1 and 2 in USD and of port 1 in EUR, before the first event."""
    def rows(name: str, balance: str, *held: tuple[str, str]) -> DataFrame:
        total = table(spark, sf_dir, name).agg(
            F.sum(F.floor(balance)).cast("double").alias("amount"))
        pairs = F.array(*[
            F.struct(F.lit(p).alias("port"), F.lit(c).alias("ccy")) for p, c in held])
        return total.select(F.explode(pairs).alias("h"), "amount")

    both = rows("customer", "c_acctbal", ("1", "USD"), ("1", "EUR")).unionByName(
        rows("supplier", "s_acctbal", ("2", "USD")))
    return both.select(
        ntz(OPENED).alias("timestamp"), "h.port", "h.ccy", "amount",
        F.col("amount").alias("cost_basis"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as prices: ticker = user, date = time, price = value."""
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("date"), F.col("user_id").cast("string").alias("ticker"),
        F.col("value").alias("price"), F.col("event_type").alias("kind"),
        F.col("event_id").alias("tick_id"))


def order_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order per (order, part) leg; medium-priority orders want one share more than filled."""
    legs = _lines(spark, sf_dir).select(
        "l_orderkey", "l_partkey", _trade_qty().alias("q")).groupBy("l_orderkey", "l_partkey").agg(
        F.sum("q").alias("q"))
    orders = table(spark, sf_dir, "orders")
    return legs.join(orders, legs.l_orderkey == orders.o_orderkey).select(
        F.date_format("o_orderdate", "yyMMdd").alias("sessionId"),
        F.col("l_orderkey").alias("api_internal_tag"),
        F.lit("IB").alias("api_client"), F.lit(3).cast("long").alias("api_clientId"),
        _ticker().alias("secId"), F.lit("STK").alias("secType"), F.lit("LMT").alias("orderType"),
        F.when(F.col("o_custkey") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        F.when(F.col("o_orderpriority") == "3-MEDIUM", F.col("q") + 1).otherwise(
            F.col("q")).alias("totalQty"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"))
        .alias("order_itag"),
        F.col("o_orderdate").alias("placed_timestamp"),
        F.when(F.col("o_orderstatus") == "O", "open").otherwise("filled").alias("status"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("status_timestamp"),
        F.concat(F.lit("desk-"), F.col("o_custkey").cast("string")).alias("reply_to"))


def broker_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills as the broker reports them: nested, UTC instants."""
    return _lines(spark, sf_dir).select(
        F.col("l_shipdate").alias("time"),
        F.struct(_ticker().alias("symbol")).alias("contract"),
        F.struct(
            F.lit("A1").alias("acctNumber"), F.lit("SMART").alias("exchange"),
            F.when(_side() == "BUY", "BOT").otherwise("SLD").alias("side"),
            _trade_qty().alias("shares"), _tick_price().alias("price"),
            F.col("l_suppkey").alias("permId"), F.lit(3).cast("long").alias("clientId"),
            F.col("l_orderkey").alias("orderId"), _trade_qty().alias("cumQty"),
            _tick_price().alias("avgPrice")).alias("execution"),
        F.struct((F.floor(F.col("l_tax") * 128) / F.lit(128.0)).alias("commission"))
        .alias("commissionReport"))


def signals_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as strategy signals awaiting a number."""
    fixed = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"),
        F.lit("LMT").alias("orderType"),
        (F.floor(F.col("o_totalprice")) / F.lit(64.0)).alias("lmtPrice"),
        F.date_format("o_orderdate", "yyyyMMddHHmmss").alias("signal_timestamp"),
        F.when(F.col("o_orderpriority") == "5-LOW", "OPT").otherwise("STK").alias("secType"),
        F.lit(3.0).alias("totalQuantity"),
        F.create_map(
            F.lit("1"), F.when(fixed, 2.0).otherwise(0.75),
            F.lit("2"), F.when(fixed, 1.0).otherwise(0.25)).alias("portAlloc"),
        F.when(fixed, "amount").otherwise("percent").alias("typeAlloc"),
        F.when(F.col("o_orderstatus") == "F", "BUY").otherwise("SELL").alias("action"),
        F.lit("dumb_strat").alias("placerId"),
        F.col("o_orderkey").alias("arrival"))
