"""Registered queries: each operator over the whole given tables."""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook import schemas
from rollbook.functions.ranking import latest_per_key
from rollbook.functions.times import from_stamp, instant_of_utc, ntz, to_stamp
from rollbook.operators import cash as cash_ops
from rollbook.operators import execution, fills, grid, orders, positions, reports, signals
from rollbook.plans import fixtures as fx
from rollbook.plans.portfolio import Update, plan_grid, replace_suffix, roll, update
from rollbook.session import materialize, scratch_path
from rollbook.sources import broker, messages, prices, relational, tables
from rollbook.streaming import executions
from rollbook.streaming import portfolio as stream_book
from rollbook.streaming import replay
from rollbook.streaming.signals import SIGNAL, signal_stream, throttled_stream

Query = Callable[[SparkSession, str], DataFrame]

DAY = dt.date(2024, 1, 15)
RESTART = dt.datetime(1998, 6, 15)
BEFORE_OPENING = dt.datetime(1994, 10, 17, 9, 30)
THROTTLE = dt.timedelta(hours=6)
# Sums of doubles that are not exact depend on their order in the last digits.
DIGITS = 4


def _cents(c: str | Column) -> Column:
    """To cents, cut off the points where exact tick fractions lie."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 100 + 0.37) / F.lit(100.0)


def _grid(spark: SparkSession, d: str) -> grid.Grid:
    return plan_grid(fx.opening_cash(spark, d), fx.events(spark, d))


def _trades(spark: SparkSession, d: str, g: grid.Grid) -> DataFrame:
    return fills.step_trades(fx.fills(spark, d), fx.alloc(spark, d), g, fx.fill_keys(spark, d))


def _update(spark: SparkSession, d: str) -> Update:
    return update(None, fx.opening_cash(spark, d), fx.fills(spark, d), fx.alloc(spark, d),
                  fx.prices(spark, d), fx.events(spark, d), fill_keys=fx.fill_keys(spark, d))


def _sum(c: str) -> Column:
    return F.round(F.sum(c), DIGITS).alias(c)


# -- scans and sources ----------------------------------------------------------------------------

def scan_prices_day(spark: SparkSession, d: str) -> DataFrame:
    return reports.on_day(fx.ticks(spark, d), "date", DAY).select("date", "ticker", "price")


def price_last_date(spark: SparkSession, d: str) -> DataFrame:
    return reports.last_date(fx.prices(spark, d), "date")


def price_union_dedupe(spark: SparkSession, d: str) -> DataFrame:
    ticks = fx.ticks(spark, d).select(
        F.date_trunc("hour", "date").cast("timestamp_ntz").alias("date"), "ticker",
        F.col("price").alias("close"), F.col("date").alias("loaded"), "kind")
    frames = [ticks.where(F.col("kind") == "click"), ticks.where(F.col("kind") != "click")]
    return prices.stack(frames, ["loaded"]).select("date", "ticker", "close")


def price_upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    writes = fx.price_writes(spark, d)
    odd = F.dayofmonth("timestamp_write") % 2 == 1
    return tables.upsert_rows(
        writes.where(odd), writes.where(~odd), ["date", "ticker"], ["timestamp_write", "price"])


def price_conform(spark: SparkSession, d: str) -> DataFrame:
    raw = fx.ticks(spark, d).withColumnRenamed("price", "close")
    return prices.conform_prices(raw, ntz(dt.datetime(2024, 2, 1)))


def csv_ingest_ny(spark: SparkSession, d: str) -> DataFrame:
    """Ticks written as CSV price files of a ticker; a second load, with its columns in another
    order, corrects all prices of one ticker."""
    path = scratch_path(spark, "price-csv")
    text = F.concat(F.date_format("date", "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00"))
    rows = fx.ticks(spark, d).select(text.alias("date"), F.col("price").alias("close"), F.col("tick_id").alias("average"), "kind")
    rows.write.partitionBy("kind").option("header", True).csv(f"{path}/first")
    rows.where("kind = 'view'").select("average", F.col("close") - 1.0, "date", "kind").toDF(
        "average", "close", "date", "kind").write.partitionBy("kind").option("header", True).csv(f"{path}/second")
    files = [
        prices.PriceFile(r.kind, f"{path}/first/kind={r.kind}")
        for r in fx.ticks(spark, d).select("kind").distinct().orderBy("kind").collect()]
    return prices.read_price_files(spark, [*files, prices.PriceFile("view", f"{path}/second/kind=view")])


def price_manifest(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with price files: a path without its ticker, an unknown format, missing fields."""
    path = scratch_path(spark, "price-csv")
    rows = fx.ticks(spark, d).select("date", F.col("price").alias("close"), "kind")
    rows.write.partitionBy("kind").option("header", True).csv(f"{path}/good")
    rows.drop("close").write.partitionBy("kind").parquet(f"{path}/parquet")
    return prices.manifest_report(spark, [
        prices.PriceFile("view", f"{path}/good/kind=view"), prices.PriceFile("sale", f"{path}/good/kind=view"),
        prices.PriceFile("click", f"{path}/parquet/kind=click"), prices.PriceFile("click", "/data/click.xlsx")])


def price_files_stacked(spark: SparkSession, d: str) -> DataFrame:
    """Ticks written as one zoned Parquet file per kind, taken in as price files of a ticker."""
    path = scratch_path(spark, "price-parquet")
    fx.ticks(spark, d).select(
        instant_of_utc(F.col("date")).alias("date"), F.col("price").alias("close"), "kind",
    ).write.partitionBy("kind").parquet(path)
    files = [
        prices.PriceFile(r.kind, f"{path}/kind={r.kind}")
        for r in fx.ticks(spark, d).select("kind").distinct().orderBy("kind").collect()]
    return prices.read_price_files(spark, files)


def csv_mapped_file(spark: SparkSession, d: str) -> DataFrame:
    """Ticks written as CSV to the shared folder and read back under other names."""
    path = scratch_path(spark, "ticks-csv")
    fx.ticks(spark, d).select(
        F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("Time"),
        F.col("ticker").alias("Symbol"), F.col("price").alias("Last"), "kind",
    ).write.option("header", True).csv(path)
    return prices.read_mapped_csv(
        spark, path, {"date": "Time", "ticker": "Symbol", "price": "Last"},
        {"date": "timestamp_ntz", "price": "double"})


def broker_fills_flat(spark: SparkSession, d: str) -> DataFrame:
    return broker.flatten_fills(fx.broker_fills(spark, d))


def broker_open_trades(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "orders")
    nested = o.select(
        F.struct(
            F.lit(3).cast("long").alias("clientId"), F.col("o_orderkey").alias("orderId"),
            F.when(F.col("o_orderstatus") == "F", "BUY").otherwise("SELL").alias("action"),
            F.lit(3.0).alias("totalQuantity"), F.lit("LMT").alias("orderType"),
            F.col("o_totalprice").alias("lmtPrice")).alias("order"),
        F.struct(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"))
        .alias("contract"),
        F.struct(
            F.col("o_orderstatus").alias("status"), F.lit(0.0).alias("filled"),
            F.lit(3.0).alias("remaining")).alias("orderStatus"),
        F.when(
            F.col("o_orderpriority") == "5-LOW",
            F.array().cast("array<struct<time:timestamp>>"))
        .otherwise(F.array(F.struct(instant_of_utc(F.col("o_orderdate")).alias("time"))))
        .alias("log"))
    return broker.open_trades(nested)


def _valuation(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers as holdings and nations as securities, under the source system's names."""
    c, n = fx.table(spark, d, "customer"), fx.table(spark, d, "nation")
    money = F.col("c_acctbal")
    holdings = c.select(
        (F.lit(1.0) + F.col("c_custkey") % 8).alias("Cantidad"),
        F.col("c_nationkey").cast("long").alias("CodigoPortafolioSBS"),
        F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("CodigoMnemonico"),
        money.alias("ValorCausadoOriginal"), money.alias("ValorCausadoLocal"),
        money.alias("VPNOriginal"), money.alias("VPNLocal"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "TEST").otherwise("REAL").alias("Escenario"),
        F.lit(20250122).alias("FechaValoracion"))
    securities = n.where(F.col("n_regionkey") != 0).select(
        F.col("n_name").alias("CodigoNemonico"),
        F.concat(F.lit("ISIN"), F.col("n_nationkey").cast("string")).alias("CodigoISIN"),
        F.col("n_nationkey").cast("string").alias("CodigoSBS"),
        F.col("n_regionkey").cast("string").alias("TipoRenta"),
        F.lit(1.0).alias("ValorUnitario"),
        F.when(F.col("n_regionkey") == 1, "DOL").when(F.col("n_regionkey") == 2, "NSOL")
        .otherwise("EUR").alias("CodigoMoneda"),
        F.lit("20301231").alias("FechaVencimiento"))
    return holdings, securities


def snapshot_join_recode(spark: SparkSession, d: str) -> DataFrame:
    return relational.snapshot(spark, *_valuation(spark, d), day=20250122)


def nav_by_fund(spark: SparkSession, d: str) -> DataFrame:
    indicators = fx.table(spark, d, "orders").select(
        F.col("o_totalprice").alias("Valor"),
        F.substring("o_orderpriority", 1, 1).alias("CodigoPortafolioSBS"),
        F.date_format("o_orderdate", "yyyyMM").cast("int").alias("Fecha"),
        F.when(F.col("o_orderstatus") == "P", "OTHER").otherwise("VALFON")
        .alias("CodigoIndicador"))
    return relational.nav(indicators, 199806, ["1", "2", "3"])


def unit_cost(spark: SparkSession, d: str) -> DataFrame:
    parts = fx.table(spark, d, "part").select(
        F.col("p_partkey").alias("Portafolio"), F.col("p_size").cast("double").alias("Cantidad"),
        F.col("p_name").alias("Name"), F.col("p_retailprice").alias("VPNOriginal"))
    return relational.fund_lots(parts, ["ring", "bolt"], rename={"red ring": "RING"})


def seed_cash(spark: SparkSession, d: str) -> DataFrame:
    return tables.restamped_head(
        fx.opening_cash(spark, d), 2, ["port", "ccy"], dt.datetime(2025, 2, 20))


def append_rows(spark: SparkSession, d: str) -> DataFrame:
    log = orders.status_log(orders.numbered(fx.signals_in(spark, d)))
    more = fx.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("order_itag"), F.lit(orders.CONFIRMED).alias("status"),
        F.lit("").alias("note"), F.col("l_shipdate").alias("timestamp"))
    return tables.append_rows(log, more, {"order_itag": "string"}).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"))


def schema_check(spark: SparkSession, d: str) -> DataFrame:
    required = schemas.FILLS
    rows = fx.fills(spark, d).drop("totalQty")
    return schemas.field_completeness(
        rows, type(required)([f for f in required if f.name in rows.columns]), "fills")


# -- fills ----------------------------------------------------------------------------------------

def fills_signed(spark: SparkSession, d: str) -> DataFrame:
    return fills.signed_by_order(fx.raw_fills(spark, d))


def processed_fills(spark: SparkSession, d: str) -> DataFrame:
    out = fills.processed_fills(fx.raw_fills(spark, d), fx.alloc(spark, d))
    return out.drop("order_itag", "typeAlloc").select(
        "secType", "secId", "port", "trade_cost_basis", "amount_variation", "trade_avgPrice")


def processed_fills_interval(spark: SparkSession, d: str) -> DataFrame:
    out = fills.processed_fills(
        fx.raw_fills(spark, d), fx.alloc(spark, d), dt.datetime(1997, 1, 1), RESTART)
    return out.select("secId", "order_itag", "port", "trade_cost_basis", "amount_variation")


def alloc_percent_amount(spark: SparkSession, d: str) -> DataFrame:
    out = fills.processed_fills(fx.raw_fills(spark, d), fx.alloc(spark, d))
    return out.groupBy("typeAlloc", "port").agg(
        F.count(F.lit(1)).alias("n"), _sum("trade_cost_basis"), _sum("amount_variation"))


def alloc_latest(spark: SparkSession, d: str) -> DataFrame:
    return fills.current_allocation(fx.alloc(spark, d))


def trade_avg_price(spark: SparkSession, d: str) -> DataFrame:
    out = fills.processed_fills(fx.raw_fills(spark, d), fx.alloc(spark, d))
    return out.select("secId", "order_itag", "port", "trade_avgPrice")


def unallocated_fills(spark: SparkSession, d: str) -> DataFrame:
    return fills.unallocated(fx.raw_fills(spark, d), fx.alloc(spark, d)).select(
        "order_itag", "secId", "side", "tradeQty", "avgPrice", "fill_timestamp")


def fills_grid_assign(spark: SparkSession, d: str) -> DataFrame:
    placed = grid.assign_steps(fx.raw_fills(spark, d), "fill_timestamp", _grid(spark, d))
    return placed.select("order_itag", "secId", "fill_timestamp", "tradeQty", "step")


def fills_uneven_grid(spark: SparkSession, d: str) -> DataFrame:
    """Fills placed on the days shipped in during January and the first days of the other months."""
    days = fx.raw_fills(spark, d).select(F.col("fill_timestamp").alias("ts")).where(
        F.month("ts") == 1).distinct()
    months = fx.events(spark, d).select(F.col("event_ts").alias("ts"))
    uneven = grid.build_grid(days.union(months).distinct())
    placed = grid.assign_steps(fx.raw_fills(spark, d), "fill_timestamp", uneven)
    return placed.select("order_itag", "secId", "fill_timestamp", "tradeQty", "step")


def net_step_trades(spark: SparkSession, d: str) -> DataFrame:
    return _trades(spark, d, _grid(spark, d))


# -- positions and cash ---------------------------------------------------------------------------

def positions_rollforward(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d)
    return positions.roll_amounts(_trades(spark, d, g), g)


def positions_priced(spark: SparkSession, d: str) -> DataFrame:
    return _update(spark, d).equity


def positions_in_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The same with windows cut into blocks of nine steps, as on a very long grid."""
    g = dataclasses.replace(_grid(spark, d), block=9)
    done = roll(g, None, fx.opening_cash(spark, d), fx.fills(spark, d), fx.alloc(spark, d), fx.prices(spark, d),
                fill_keys=fx.fill_keys(spark, d))
    return done.equity


def positions_open_carry(spark: SparkSession, d: str) -> DataFrame:
    """Restart in mid-history from stored positions; history before it stays."""
    first = _update(spark, d)
    equity = materialize(first.equity, "equity")
    opening = fx.opening_cash(spark, d)
    cash = materialize(opening.unionByName(first.cash), "cash")
    again = update(
        equity, cash, fx.fills(spark, d), fx.alloc(spark, d), fx.prices(spark, d),
        fx.events(spark, d).where(F.col("event_ts") >= ntz(RESTART)), fill_keys=fx.fill_keys(spark, d))
    return replace_suffix(equity, again.equity, again.grid).select(
        "timestamp", "port", "ticker", "amount",
        _cents("avgPrice").alias("avgPrice"), _cents("price").alias("price"),
        "price_source", _cents("mtm").alias("mtm"))


def positions_mirrored(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d)
    return reports.mirrored(positions.roll_amounts(_trades(spark, d, g), g)).select(
        "timestamp", "port", "ticker", "amount", "avgPrice", "price")


def positions_full_join(spark: SparkSession, d: str) -> DataFrame:
    """Positions of the trades up to a step, full-joined with the trades of the next."""
    g = _grid(spark, d)
    trades = materialize(_trades(spark, d, g), "trades")
    cut = g.last_step // 2
    held = positions.held_at(trades, g, cut)
    out = positions.carry_full(held, trades.where(F.col("step") == cut + 1))
    return out.withColumn("avgPrice", _cents("avgPrice"))


def cash_rollforward(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d)
    return cash_ops.roll_cash(_trades(spark, d, g), fx.opening_cash(spark, d), g)


def net_cost_by_port(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d)
    return positions.at_time(cash_ops.net_cost(_trades(spark, d, g)), g)


def ports_without_cash(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d)
    only_one = fx.opening_cash(spark, d).where(F.col("port") == "1")
    return cash_ops.ports_without_cash(_trades(spark, d, g), only_one)


# -- reports --------------------------------------------------------------------------------------

def pnl_pivot(spark: SparkSession, d: str) -> DataFrame:
    returns = materialize(reports.interval_returns(_update(spark, d).intervals), "returns")
    ports = [r.port for r in returns.select("port").distinct().orderBy("port").collect()]
    wide = reports.pnl_by_port(returns, ports)
    return wide.select("ticker", *[
        _cents(f"{p}_{v}").alias(f"{v}_{p}") for p in ports for v in ("pnl", "ret")])


def ret_slice_sum(spark: SparkSession, d: str) -> DataFrame:
    done = _update(spark, d)
    steps = reports.between(
        done.grid.steps, "ts", dt.datetime(1997, 1, 1), dt.datetime(1998, 12, 1)).agg(
        F.min("step").alias("lo"), F.max("step").alias("hi")).first()
    returns = reports.interval_returns(done.intervals, steps.lo, steps.hi)
    return returns.groupBy("ticker").agg(_sum("ret"), F.sum("n").alias("n"))


def price_source_count(spark: SparkSession, d: str) -> DataFrame:
    return reports.source_counts(_update(spark, d).intervals)


def _quoted_intervals(spark: SparkSession, d: str, g: grid.Grid) -> DataFrame:
    trades = materialize(_trades(spark, d, g), "trades")  # read for the positions and the spans of their quotes
    return positions.quoted_intervals(trades, fx.prices(spark, d), g)


def price_fill_group_mean(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d)
    held = materialize(_quoted_intervals(spark, d, g), "held")  # read for the means and the rows
    out = reports.fill_with_group_mean(held, g)
    return out.select("timestamp", "port", "ticker", _cents("price").alias("price"))


def positions_market_join(spark: SparkSession, d: str) -> DataFrame:
    """Positions with the market price at exactly their time."""
    g = _grid(spark, d)
    held = positions.quoted_every_step(_quoted_intervals(spark, d, g), F.lit(None).cast("double"), g)
    return held.select("timestamp", "port", "ticker", (F.col("amount") * F.col("price")).alias("mtm"))


def offgrid_timestamps(spark: SparkSession, d: str) -> DataFrame:
    return reports.off_grid(fx.ticks(spark, d), "date")


def timestamp_set_diff(spark: SparkSession, d: str) -> DataFrame:
    li = fx.table(spark, d, "lineitem")
    return reports.time_set_diff(
        reports.distinct_times((fx.table(spark, d, "orders"), "o_orderdate")),
        reports.distinct_times((li, "l_shipdate")))


def distinct_times(spark: SparkSession, d: str) -> DataFrame:
    return reports.distinct_times(
        (fx.table(spark, d, "orders"), "o_orderdate"), (fx.table(spark, d, "lineitem"),
                                                         "l_shipdate"))


def event_range(spark: SparkSession, d: str) -> DataFrame:
    return reports.event_range(fx.ticks(spark, d).select(F.col("date").alias("event_ts")))


def ticks_head(spark: SparkSession, d: str) -> DataFrame:
    return reports.head(fx.ticks(spark, d), 10, "date", "tick_id").select("date", "ticker", "price")


def ticks_tail(spark: SparkSession, d: str) -> DataFrame:
    return reports.tail(fx.ticks(spark, d), 10, "date", "tick_id").select("date", "ticker", "price")


def ticks_slice(spark: SparkSession, d: str) -> DataFrame:
    return reports.slice_rows(fx.ticks(spark, d), 5, 10, "date", "tick_id").select(
        "date", "ticker", "price")


# -- grid -----------------------------------------------------------------------------------------

def start_ts(spark: SparkSession, d: str) -> DataFrame:
    stored = fx.table(spark, d, "orders").select(F.col("o_orderdate").alias("timestamp"))
    late = fx.table(spark, d, "lineitem").where(F.col("l_shipdate") >= ntz(RESTART)).select(
        F.col("l_shipdate").alias("event_ts"))
    return grid.start_before(stored, late)


def timestamps_to_update(spark: SparkSession, d: str) -> DataFrame:
    stored = fx.table(spark, d, "orders").select(F.col("o_orderdate").alias("timestamp"))
    late = fx.table(spark, d, "lineitem").where(F.col("l_shipdate") >= ntz(RESTART)).select(
        F.col("l_shipdate").alias("event_ts"))
    start = grid.start_before(stored, late).first()["start_ts"]
    return grid.times_to_update(stored, late, None if start is None else ntz(start))


def grid_steps(spark: SparkSession, d: str) -> DataFrame:
    return grid.number_steps(
        reports.distinct_times((fx.ticks(spark, d), "date"))).select("step", "ts", "prev_ts")


# -- signals --------------------------------------------------------------------------------------

def calibration_mean(spark: SparkSession, d: str) -> DataFrame:
    return signals.calibration(fx.ticks(spark, d)).select(
        "ticker", "day", F.round("day_mean", DIGITS).alias("day_mean"), "first_ts")


def _directed(spark: SparkSession, d: str) -> DataFrame:
    ticks = fx.ticks(spark, d)
    means = signals.calibration_of(ticks, DAY).withColumn("day_mean", F.round("day_mean", DIGITS))
    return signals.directed(ticks, means)


def signals_directed(spark: SparkSession, d: str) -> DataFrame:
    return _directed(spark, d).select("tick_id", "ticker", "date", "price", "action")


def signals_throttled(spark: SparkSession, d: str) -> DataFrame:
    rows = _directed(spark, d)
    started = rows.select("ticker", F.col("first_ts").alias("start_ts")).distinct()
    return signals.throttled(rows, THROTTLE, started=started).select(
        "tick_id", "ticker", "date", "price", "action")


def signals_throttled_all(spark: SparkSession, d: str) -> DataFrame:
    return signals.throttled(fx.ticks(spark, d), THROTTLE).select("tick_id", "ticker", "date")


def signal_messages(spark: SparkSession, d: str) -> DataFrame:
    bodies = signals.signal_bodies(_directed(spark, d), {"1": 2.0, "2": 1.0})
    return messages.encode(bodies, "symbol", "signal_timestamp", "action", "typeAlloc", "portAlloc")


def signal_price_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The price each data event's strategy sees: the one at the event's time and ticker."""
    ticks = fx.ticks(spark, d)
    asked = ticks.where(F.col("kind") == "purchase").select("date", "ticker").distinct()
    return latest_per_key(
        asked.join(ticks.select("date", "ticker", "price", "tick_id"), ["date", "ticker"]),
        ["date", "ticker"], ["tick_id"]).select("date", "ticker", "price")


# -- orders ---------------------------------------------------------------------------------------

def _used(spark: SparkSession, d: str) -> DataFrame:
    """Tags already given out: one per earlier lineitem of the signal's day."""
    return fx.table(spark, d, "lineitem").select(F.concat(
        F.date_format("l_shipdate", "yyMMdd"),
        F.lpad((F.col("l_linenumber") * 100).cast("string"), 8, "0")).alias("order_itag"))


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    return orders.numbered(fx.signals_in(spark, d), orders.last_numbers(_used(spark, d)))


def last_order_numbers(spark: SparkSession, d: str) -> DataFrame:
    return orders.last_numbers(_used(spark, d))


def last_order_number_day(spark: SparkSession, d: str) -> DataFrame:
    return orders.last_number(_used(spark, d), "980615")


def order_numbers(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(spark, d).select("arrival", "order_itag")


def blotter_rows(spark: SparkSession, d: str) -> DataFrame:
    return orders.blotter_rows(_numbered(spark, d))


def alloc_explode(spark: SparkSession, d: str) -> DataFrame:
    return orders.allocation_rows(_numbered(spark, d))


def status_log(spark: SparkSession, d: str) -> DataFrame:
    return orders.status_log(_numbered(spark, d))


def status_log_client_closed(spark: SparkSession, d: str) -> DataFrame:
    return orders.status_log(_numbered(spark, d), client_open=False).groupBy("status", "note").agg(
        F.count(F.lit(1)).alias("n"))


def risk_split(spark: SparkSession, d: str) -> DataFrame:
    ok, denied = orders.risk_split(_numbered(spark, d))
    sides = ok.withColumn("confirmed", F.lit(True)).unionByName(
        denied.withColumn("confirmed", F.lit(False)))
    return sides.groupBy("confirmed", "secType").agg(F.count(F.lit(1)).alias("n"))


def order_bodies(spark: SparkSession, d: str) -> DataFrame:
    ok, _ = orders.risk_split(_numbered(spark, d))
    return orders.order_bodies(ok, from_stamp(F.col("signal_timestamp")))


# -- execution ------------------------------------------------------------------------------------

def _matched(spark: SparkSession, d: str) -> DataFrame:
    return execution.match_fills(
        execution.open_orders(fx.order_record(spark, d)),
        broker.flatten_fills(fx.broker_fills(spark, d)))


def fill_match_session(spark: SparkSession, d: str) -> DataFrame:
    """The match for the orders of one session."""
    session = fx.table(spark, d, "orders").where(F.col("o_orderstatus") == "O").agg(
        F.date_format(F.min("o_orderdate"), "yyMMdd")).first()[0]
    return execution.match_fills(
        execution.open_orders(fx.order_record(spark, d), session=F.lit(session)),
        broker.flatten_fills(fx.broker_fills(spark, d)))


def confirmation_log(spark: SparkSession, d: str) -> DataFrame:
    """Log rows of the fill confirmations."""
    return orders.confirmation_log(
        execution.confirmations(_matched(spark, d)), ntz(dt.datetime(2025, 2, 20)))


def fill_record_rows(spark: SparkSession, d: str) -> DataFrame:
    """Matched fills appended to a record of the bought ones, row by row."""
    new = materialize(_matched(spark, d), "matched")
    return tables.append_rows(new.where(F.col("side") == "BUY"), new)


def status_log_rows(spark: SparkSession, d: str) -> DataFrame:
    """What intake logs while the execution client is closed, row by row."""
    return orders.status_log(_numbered(spark, d), client_open=False)


def blotter_of_order(spark: SparkSession, d: str) -> DataFrame:
    """Blotter rows of the day's first order, and no rows of an empty table."""
    blotter = orders.blotter_rows(_numbered(spark, d))
    one = blotter.where(F.col("order_itag") == blotter.agg(F.min("order_itag")).scalar())
    return one.unionByName(tables.empty_like(blotter))


def placed_orders(spark: SparkSession, d: str) -> DataFrame:
    ok, _ = orders.risk_split(_numbered(spark, d))
    bodies = ok.withColumn("api_internal_tag", F.col("arrival")).withColumn(
        "reply_to", F.col("placerId"))
    return execution.placed_orders(bodies, "250220", 3, orders.received_at()).select(
        "sessionId", "api_internal_tag", "api_client", "api_clientId", "secId", "secType",
        "orderType", "side", "totalQty", "order_itag", "placed_timestamp", "status", "reply_to")


def open_orders(spark: SparkSession, d: str) -> DataFrame:
    record = fx.order_record(spark, d)
    session = fx.table(spark, d, "orders").where(F.col("o_orderstatus") == "O").agg(
        F.date_format(F.max("o_orderdate"), "yyMMdd")).first()[0]
    return execution.open_orders(record, session=F.lit(session)).select(
        "sessionId", "order_itag", "secId", "totalQty", "placed_timestamp")


def filled_totals(spark: SparkSession, d: str) -> DataFrame:
    return execution.filled_totals(broker.flatten_fills(fx.broker_fills(spark, d)))


def fill_match(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d)


def order_status_update(spark: SparkSession, d: str) -> DataFrame:
    record = fx.order_record(spark, d)
    return execution.mark_filled(record, _matched(spark, d), ntz(dt.datetime(2025, 2, 20))).select(
        "order_itag", "status", "status_timestamp")


def filled_count_check(spark: SparkSession, d: str) -> DataFrame:
    matched = materialize(_matched(spark, d), "matched")  # read for the tags and the orders
    return execution.filled_counts(fx.order_record(spark, d), matched)


def fill_record_append(spark: SparkSession, d: str) -> DataFrame:
    """Matched fills appended to a record of the bought ones, counted per security."""
    new = materialize(_matched(spark, d), "matched")
    stored = new.where(F.col("side") == "BUY")
    return tables.append_rows(stored, new).groupBy("secId").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tradeQty").alias("tradeQty"))


def fill_confirmations(spark: SparkSession, d: str) -> DataFrame:
    return execution.confirmations(_matched(spark, d)).select(
        "order_itag", "sessionId", F.array_join("fill_timestamps", ",").alias("fill_timestamps"))


def fill_events_encoded(spark: SparkSession, d: str) -> DataFrame:
    return messages.encode(
        execution.confirmations(_matched(spark, d)), "order_itag", "sessionId", "fill_timestamps")


# -- messages -------------------------------------------------------------------------------------

def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Ticks as data events; errors are cut off in mid-text, logins are plain text."""
    stamp = F.date_format("date", "yyyyMMddHHmmss")
    body = F.to_json(F.struct(
        stamp.alias("timestamp"),
        F.when(F.col("kind") == "view", "bonds").otherwise("us_equity").alias("table_name"),
        F.array("ticker").alias("tickers"), F.lit("new_data").alias("event")))
    return fx.ticks(spark, d).select(
        "tick_id", "date", "ticker", "kind",
        F.when(F.col("kind") == "error", F.substring(body, 1, 20)).otherwise(body).alias("body"),
        F.when(F.col("kind") == "click", "text/plain").otherwise(messages.JSON)
        .alias("content_type"),
        F.concat(F.lit("data_csv."), F.when(
            F.col("kind") == "view", "bonds.daily").otherwise("us_equity")).alias("topic"))


def event_decode(spark: SparkSession, d: str) -> DataFrame:
    out = messages.decode(_messages(spark, d), schemas.DATA_EVENT)
    return out.select(
        "tick_id", "rejected", F.col("msg.timestamp").alias("stamp"),
        F.col("msg.table_name").alias("table_name"),
        F.array_join("msg.tickers", ",").alias("tickers"),
        from_stamp(F.col("msg.timestamp")).alias("event_ts"))


def event_admission(spark: SparkSession, d: str) -> DataFrame:
    out = messages.decode(_messages(spark, d), schemas.DATA_EVENT)
    return out.where(F.col("rejected").isNull()).select(
        "tick_id", messages.routed(F.col("topic")).alias("routed"),
        messages.admitted(F.col("msg.table_name"), F.col("msg.tickers")).alias("admitted"),
        messages.triggers(F.col("msg.table_name"), F.col("msg.tickers"), F.lit("7"))
        .alias("triggers"))


def event_times(spark: SparkSession, d: str) -> DataFrame:
    """Distinct times of admitted data events and of fill confirmations."""
    out = messages.decode(_messages(spark, d), schemas.DATA_EVENT)
    data = out.where(F.col("rejected").isNull()).select("msg.*")
    return messages.event_times(data, execution.confirmations(_matched(spark, d)))


def data_event_encode(spark: SparkSession, d: str) -> DataFrame:
    events = messages.data_events(fx.ticks(spark, d))
    return messages.encode(events, "timestamp", "table_name", "tickers", "event")


def event_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Do the tickers shipped in a month cover all that are held?"""
    p = fx.prices(spark, d)
    events = p.groupBy(F.date_format("date", "yyyyMMdd").alias("timestamp")).agg(
        F.collect_set("ticker").alias("tickers"))
    return messages.event_coverage(p.select("ticker"), events)


def missing_tickers(spark: SparkSession, d: str) -> DataFrame:
    p = fx.prices(spark, d)
    last_month = p.where(F.col("date") >= ntz(dt.datetime(2001, 10, 1)))
    return messages.missing_tickers(p, last_month)


def events_newer(spark: SparkSession, d: str) -> DataFrame:
    ships = fx.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("event_ts"))
    return messages.newer_than(
        ships, fx.table(spark, d, "orders").where(F.col("o_orderstatus") == "F").select(
            (F.col("o_orderdate") - F.expr("INTERVAL 90 DAY")).alias("timestamp")))


def events_accepted(spark: SparkSession, d: str) -> DataFrame:
    """Days after the last position whose ticks name every ticker held then."""
    ticks = fx.ticks(spark, d)
    day = F.date_trunc("day", "date").cast("timestamp_ntz")
    held = ticks.where(F.col("date") < ntz(dt.datetime(2024, 1, 10))).select(
        F.col("date").alias("timestamp"), "ticker")
    events = ticks.groupBy(day.alias("event_ts")).agg(F.collect_set("ticker").alias("tickers"))
    return messages.accepted(events, held).select("event_ts", F.size("tickers").alias("n_tickers"))


# -- streams --------------------------------------------------------------------------------------

def _book(spark: SparkSession, d: str, root: str) -> stream_book.Book:
    return stream_book.open_book(
        spark, f"{root}/book", fx.opening_cash(spark, d),
        lambda lo, hi: fills.in_interval(fx.fills(spark, d), lo, hi), lambda: fx.alloc(spark, d),
        lambda lo, hi: fills.in_interval(fx.fill_keys(spark, d), lo, hi))


def _replayed(spark: SparkSession, d: str, files: int, late_first: bool,
              more: list[dt.datetime] | None = None) -> stream_book.Book:
    """Prices and bare events replayed through the streaming portfolio."""
    quotes = fx.prices(spark, d)
    times = fx.events(spark, d)
    if more:
        times = times.union(spark.createDataFrame([(t,) for t in more], "event_ts timestamp_ntz"))
    bare = times.select(
        F.col("event_ts").alias("date"), F.lit(None).cast("string").alias("ticker"),
        F.lit(None).cast("double").alias("price"),
        F.lit(None).cast("timestamp_ntz").alias("timestamp_write"))
    rows = quotes.unionByName(bare)
    root = scratch_path(spark, "stream")
    replay.write_replay(rows, f"{root}/in", "date", files, late_first)
    book = _book(spark, d, root)
    stream_book.start(
        book, replay.read_replay(spark, f"{root}/in", rows), f"{root}/checkpoint", every=None
    ).awaitTermination()
    return book


def _stored_equity(book: stream_book.Book) -> DataFrame:
    return book.equity.read().select(
        "timestamp", "port", "ticker", "amount", _cents("avgPrice").alias("avgPrice"),
        _cents("price").alias("price"), "price_source", _cents("mtm").alias("mtm"))


def stream_replay_positions(spark: SparkSession, d: str) -> DataFrame:
    return _stored_equity(_replayed(spark, d, 3, late_first=False))


def stream_late_recompute(spark: SparkSession, d: str) -> DataFrame:
    return _stored_equity(_replayed(spark, d, 2, late_first=True))


def stream_before_opening(spark: SparkSession, d: str) -> DataFrame:
    """The last batch holds an event before all stored rows: everything is rolled again from there."""
    return _replayed(spark, d, 2, late_first=True, more=[BEFORE_OPENING]).equity.read()


def stream_before_opening_cash(spark: SparkSession, d: str) -> DataFrame:
    return _replayed(spark, d, 2, late_first=True, more=[BEFORE_OPENING]).cash.read()


def stream_events_positions(spark: SparkSession, d: str) -> DataFrame:
    """Messages of two topics as one stream: data events in order, fill events the latest first.

    A fill event names the last fill of each quarter, so fill events arrive years late.
    """
    root = scratch_path(spark, "stream")
    book = _book(spark, d, root)
    book.prices.append(fx.prices(spark, d), "prices")
    data = messages.encode(fx.events(spark, d).select(
        to_stamp(F.col("event_ts")).alias("timestamp"), F.lit("us_equity").alias("table_name"),
        F.array(F.lit("any")).alias("tickers"), F.lit("new_data").alias("event"),
    ), "timestamp", "table_name", "tickers", "event").withColumn("topic", F.lit("data_csv.us_equity"))
    quarter = F.date_trunc("quarter", "fill_timestamp")
    filled = fx.raw_fills(spark, d).groupBy(quarter.alias("quarter")).agg(F.max("fill_timestamp").alias("t"))
    confirmed = messages.encode(filled.select(
        F.date_format("quarter", "yyMMdd").alias("order_itag"), F.lit("s").alias("sessionId"),
        F.array(to_stamp(F.col("t"))).alias("fill_timestamps"),
    ), "order_itag", "sessionId", "fill_timestamps").withColumn("topic", F.lit("fills"))
    streams = []
    for name, df, late_first in (("data", data, False), ("fills", confirmed, True)):
        df = df.withColumn("content_type", F.lit(messages.JSON))
        replay.write_replay(df, f"{root}/{name}", "body", 2, late_first)
        streams.append(replay.read_replay(spark, f"{root}/{name}", df))
    stream_book.start_messages(book, *streams, f"{root}/checkpoint", every=None).awaitTermination()
    return _stored_equity(book)


def stream_signals_throttled(spark: SparkSession, d: str) -> DataFrame:
    """Ticks replayed in several batches; a last row far ahead lets the watermark pass all."""
    ticks = fx.ticks(spark, d).select("date", "ticker", "tick_id")
    last = ticks.agg(
        (F.max("date") + F.expr("INTERVAL 10 DAY")).alias("date"), F.lit("close").alias("ticker"),
        F.lit(-1).cast("long").alias("tick_id"))
    root = scratch_path(spark, "stream")
    replay.write_replay(ticks.unionByName(last), f"{root}/in", "date", 3)
    out = throttled_stream(
        replay.read_replay(spark, f"{root}/in", ticks), THROTTLE, "1 hour")
    (
        out.writeStream.format("parquet").option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        .awaitTermination())
    passed = spark.read.parquet(f"{root}/out")
    return passed.select(F.col("id").alias("tick_id"), "ticker")


def stream_signal_messages(spark: SparkSession, d: str) -> DataFrame:
    """Signals with price and action out of a stream that plays the last days first, and their messages."""
    ticks = fx.ticks(spark, d).select("date", "ticker", "price", "tick_id")
    means = signals.calibration_of(ticks, DAY).withColumn("day_mean", F.round("day_mean", DIGITS))
    root = scratch_path(spark, "stream")
    replay.write_replay(ticks, f"{root}/in", "date", 3, late_first=True)
    # Closing rows come in a second run, as they would at the end of a session.
    closing = ticks.select(
        (F.col("date") + F.expr("INTERVAL 100 DAY")).alias("date"), "ticker",
        F.lit(None).cast("double").alias("price"), F.lit(None).cast("long").alias("tick_id")
    ).groupBy("ticker", "price", "tick_id").agg(F.max("date").alias("date")).select(*ticks.columns)

    def run() -> None:
        out = signal_stream(replay.read_replay(spark, f"{root}/in", ticks), means, THROTTLE, dt.timedelta(days=60))
        (
            out.writeStream.format("parquet").option("path", f"{root}/out")
            .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
            .awaitTermination())

    run()
    closing.write.mode("append").parquet(f"{root}/in")
    run()
    sent = spark.read.parquet(f"{root}/out").where(F.col("event") == SIGNAL)
    bodies = signals.signal_bodies(sent, {"1": 2.0, "2": 1.0})
    fields = ["symbol", "lmtPrice", "signal_timestamp", "action"]
    sent = messages.encode(bodies, *fields, "typeAlloc", "portAlloc")
    return sent.select(*[F.get_json_object("body", f"$.{f}").alias(f) for f in fields]).select(
        F.col("symbol").alias("ticker"), F.col("lmtPrice").cast("double").alias("price"), "action", "signal_timestamp")


def _executions(spark: SparkSession, d: str) -> executions.Desk:
    """Orders and fills as two streams, the fills of the last months first."""
    root = scratch_path(spark, "stream")
    streams = []
    tables_ = (("orders", fx.order_record(spark, d), "placed_timestamp", False),
               ("fills", broker.flatten_fills(fx.broker_fills(spark, d)), "fill_timestamp", True))
    for name, df, ts, late_first in tables_:
        replay.write_replay(df, f"{root}/{name}", ts, 2, late_first)
        streams.append(replay.read_replay(spark, f"{root}/{name}", df))
    desk = executions.Desk(f"{root}/desk")
    executions.start_matching(desk, *streams, f"{root}/checkpoint", every=None).awaitTermination()
    return desk


def stream_fill_match(spark: SparkSession, d: str) -> DataFrame:
    """What the stream released as fill-record rows."""
    return _executions(spark, d).events(spark)


def stream_fill_confirmations(spark: SparkSession, d: str) -> DataFrame:
    """The confirmations that the stream sent."""
    sent = _executions(spark, d).sent(spark).select(
        F.from_json("value", "order_itag string, sessionId string, fill_timestamps array<string>").alias("m"))
    return sent.select("m.order_itag", "m.sessionId", F.array_join("m.fill_timestamps", ",").alias("fill_timestamps"))


def queries() -> dict[str, Query]:
    listed = [
        scan_prices_day, price_last_date, price_union_dedupe, price_upsert_latest, price_conform,
        csv_ingest_ny, csv_mapped_file, price_files_stacked, price_manifest, broker_fills_flat,
        broker_open_trades,
        snapshot_join_recode, nav_by_fund, unit_cost, seed_cash, append_rows,
        schema_check,
        fills_signed, processed_fills, processed_fills_interval, alloc_percent_amount,
        alloc_latest, trade_avg_price, unallocated_fills, fills_grid_assign,
        fills_uneven_grid, net_step_trades,
        positions_rollforward, positions_priced, positions_in_blocks, positions_open_carry, positions_mirrored,
        positions_full_join, cash_rollforward, net_cost_by_port, ports_without_cash,
        pnl_pivot, ret_slice_sum, price_source_count, price_fill_group_mean,
        positions_market_join, offgrid_timestamps, timestamp_set_diff, distinct_times,
        event_range, ticks_head, ticks_tail, ticks_slice,
        start_ts, timestamps_to_update, grid_steps,
        calibration_mean, signals_directed, signals_throttled, signals_throttled_all,
        signal_messages, signal_price_lookup,
        last_order_numbers, last_order_number_day, order_numbers, blotter_rows, alloc_explode,
        status_log, status_log_client_closed, risk_split, order_bodies,
        placed_orders, open_orders, filled_totals, fill_match, fill_match_session, confirmation_log,
        fill_record_rows, status_log_rows, blotter_of_order, order_status_update,
        filled_count_check, fill_record_append, fill_confirmations, fill_events_encoded,
        event_decode, event_admission, event_times, data_event_encode, event_coverage,
        missing_tickers, events_newer, events_accepted,
        stream_replay_positions, stream_late_recompute, stream_before_opening,
        stream_before_opening_cash, stream_events_positions, stream_signals_throttled,
        stream_signal_messages,
        stream_fill_match, stream_fill_confirmations,
    ]
    return {f.__name__: f for f in listed}


