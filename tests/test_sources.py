import datetime as dt
import time

import books
import pytest
from books import alloc, at, fill
from pyspark.sql import functions as F

from rollbook import schemas
from rollbook.plans.portfolio import plan_grid, update
from rollbook.schemas import SchemaError, validate_holdings
from rollbook.session import materialize
from rollbook.sources import broker, prices, relational, tables
from rollbook.sources.holdings import PositionTable
from rollbook.sources.prices import ManifestError, PriceFile
from rollbook.sources.tables import BatchTable
from rollbook.streaming import replay


def test_price_files(spark, tmp_path):
    zoned = tmp_path / "AAPL-parquet"
    spark.sql("SELECT TIMESTAMP'2025-02-20 14:30:00Z' AS date, 10.5D AS close, 1 AS other"
              ).write.parquet(str(zoned))
    text = tmp_path / "qqq.csv"
    text.write_text(
        "date,open,close\n2025-02-20 09:30:00-0500,1,20.5\n2025-07-01 13:30:00+00:00,1,21.5\n"
        "2025-02-20 14:30:00+00:00,1,19.5\n")
    df = prices.read_price_files(
        spark, [PriceFile("AAPL", str(zoned)), PriceFile("QQQ", str(text))])
    got = {(r.ticker, r.date): r.close for r in df.collect()}
    assert got == {
        ("AAPL", dt.datetime(2025, 2, 20, 9, 30)): 10.5,
        ("QQQ", dt.datetime(2025, 2, 20, 9, 30)): 20.5,
        ("QQQ", dt.datetime(2025, 7, 1, 9, 30)): 21.5}
    conformed = prices.conform_prices(df, F.current_timestamp())
    assert books.fields(conformed.schema) == books.fields(schemas.PRICES)


def test_price_file_checks(spark, tmp_path):
    with pytest.raises(ManifestError, match="not in path"):
        prices.check_manifest([PriceFile("SPY", "/x/qqq.csv")])
    with pytest.raises(ManifestError, match="extension"):
        prices.check_manifest([PriceFile("SPY", "/x/spy.txt")])
    path = tmp_path / "spy.csv"
    path.write_text("date,open\n2025-02-20 09:30:00-05:00,1\n")
    with pytest.raises(ManifestError, match="missing"):
        prices.read_price_files(spark, [PriceFile("SPY", str(path))])


def test_stack_keeps_the_latest(spark):
    """The surviving duplicate is the latest, not an arbitrary one (D8)."""
    schema = "date timestamp_ntz, ticker string, close double, loaded int"
    one = books.frame(spark, [(at(1), "A", 5.0, 1), (at(2), "A", 6.0, 1)], schema)
    two = books.frame(spark, [(at(1), "A", 4.0, 2)], schema)
    assert {r.date: r.close for r in prices.stack([two, one], ["loaded"]).collect()} == {
        at(1): 4.0, at(2): 6.0}


def test_holdings_validation(spark):
    cash = books.frame(spark, books.cash_rows(["1"]), schemas.CASH)
    validate_holdings({"cash": cash})
    with pytest.raises(SchemaError, match="bonds"):
        validate_holdings({"bonds": cash})
    with pytest.raises(SchemaError, match="amount"):
        validate_holdings({"cash": cash.withColumn("amount", F.lit(1))})


def test_broker_fills_in_desk_time(spark):
    row = [(dt.datetime(2025, 2, 20, 15, 0), ("AAPL",),
            ("acc", "SMART", "BOT", 3.0, 10.0, 1, 2, 3, 3.0, 10.0), (0.5,))]
    df = broker.flatten_fills(spark.createDataFrame(row, schemas.BROKER_FILL))
    (r,) = df.collect()
    assert r.asDict() == {
        "fill_timestamp": dt.datetime(2025, 2, 20, 10, 0), "secId": "AAPL",
        "api_internal_tag": 3, "api_clientId": 2, "tradeQty": 3.0, "avgPrice": 10.0,
        "commission": 0.5}


def test_snapshot_is_parametrised(spark):
    holdings = spark.sql("""
        SELECT 2D AS Cantidad, 1L AS CodigoPortafolioSBS, 'QQQ INVESCO' AS CodigoMnemonico,
               1D AS ValorCausadoOriginal, 1D AS ValorCausadoLocal, 8D AS VPNOriginal,
               1D AS VPNLocal, s AS Escenario, 20250122 AS FechaValoracion
        FROM VALUES ('REAL'), ('TEST') t(s)""")
    securities = spark.sql("""
        SELECT 'QQQ INVESCO' AS CodigoNemonico, 'i' AS CodigoISIN, 'c' AS CodigoSBS,
               '2' AS TipoRenta, 1D AS ValorUnitario, 'DOL' AS CodigoMoneda, '20300101' AS FechaVencimiento
        """)
    snap = relational.snapshot(spark, holdings, securities, 20250122)
    assert books.fields(snap.schema) == books.fields(schemas.SNAPSHOT)
    assert [r.Moneda for r in snap.collect()] == ["USD"]
    lots = relational.fund_lots(snap, ["QQQ", "SPY"], rename={"QQQ INVESCO": "QQQ"})
    assert [(r.port, r.ticker, r.cost_basis) for r in lots.collect()] == [("1", "QQQ", 4.0)]


def test_append_seed_and_empty(spark):
    cash = books.frame(spark, books.cash_rows(["1", "2", "3"]), schemas.CASH)
    new = spark.sql("SELECT '2025-01-01' AS timestamp, '4' AS port, 'USD' AS ccy, 1 AS amount, 2 AS cost_basis")
    both = tables.append_rows(cash, new, {"timestamp": "timestamp_ntz"})
    assert both.schema == schemas.CASH and both.count() == 4
    seeded = tables.restamped_head(cash, 2, ["port"], at(9)).collect()
    assert [(r.port, r.timestamp) for r in seeded] == [("1", at(9)), ("2", at(9))]
    assert tables.empty_like(cash).count() == 0


def price(hour, ticker, x, written):
    return (at(hour), ticker, float(x), at(written))


def contents(table):
    return {(r.date, r.ticker): r.price for r in table.read().collect()}


def test_batch_table(spark, tmp_path):
    keys, order = ["date", "ticker"], ["timestamp_write"]
    table = BatchTable(spark, str(tmp_path / "prices"), schemas.PRICES, "date", keys, order)
    assert not table.exists() and table.read().count() == 0

    def rows(*r):
        return books.frame(spark, list(r), schemas.PRICES)

    table.append(rows(price(1, "A", 1, 0), price(30, "A", 2, 0), price(60, "A", 3, 0)), "b1")
    written = sorted(str(f) for f in tmp_path.rglob("*.parquet"))
    table.append(rows(price(30, "A", 9, 1), price(30, "B", 8, 1), price(31, "A", 7, 1)), "b2")
    assert contents(table) == {
        (at(1), "A"): 1.0, (at(30), "A"): 9.0, (at(30), "B"): 8.0, (at(31), "A"): 7.0,
        (at(60), "A"): 3.0}
    table.append(rows(price(1, "A", 99, 9)), "b2")  # a repeated batch does nothing
    assert contents(table)[at(1), "A"] == 1.0
    table.append(rows(price(1, "A", 0, -5)), "b3")  # an older write loses
    assert contents(table)[at(1), "A"] == 1.0

    assert {r.date for r in table.read_from_before(at(31)).collect()} == {at(30), at(31), at(60)}
    assert {r.date for r in table.read_from_before(at(0.5)).collect()} == {at(1), at(30), at(31), at(60)}
    assert {r.date for r in table.read(at(30.5), at(60)).collect()} == {at(31), at(60)}

    table.replace_suffix(at(30), rows(price(32, "A", 5, 2)), "b4")
    assert contents(table) == {
        (at(1), "A"): 1.0, (at(30), "A"): 9.0, (at(30), "B"): 8.0, (at(32), "A"): 5.0}
    table.replace_suffix(at(1), rows(price(2, "C", 4, 2)), "b5")  # earlier than the one before
    table.replace_suffix(at(40), rows(price(41, "C", 6, 2)), "b6")
    assert contents(table) == {(at(1), "A"): 1.0, (at(2), "C"): 4.0, (at(41), "C"): 6.0}
    assert set(written) <= {str(f) for f in tmp_path.rglob("*.parquet")}  # nothing was rewritten
    table.compact("b7")
    assert contents(table) == {(at(1), "A"): 1.0, (at(2), "C"): 4.0, (at(41), "C"): 6.0}
    assert [r.batch for r in table.live().collect()] == ["b7"]
    table.overwrite(table.read().where("ticker = 'C'"), "b8")  # reads what it replaces
    assert contents(table) == {(at(2), "C"): 4.0, (at(41), "C"): 6.0}


def test_rows_without_their_log_row_are_not_seen(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "cash"), schemas.CASH, "timestamp")
    table.overwrite(books.frame(spark, books.cash_rows(["1"]), schemas.CASH), "b1")
    lost = books.frame(spark, books.cash_rows(["2"], hour=5), schemas.CASH)
    lost.write.parquet(f"{table.path}/rows/batch=b2")  # failed before its log row
    assert [r.port for r in table.read().collect()] == ["1"]
    table.replace_suffix(at(0), books.frame(spark, books.cash_rows(["3"], hour=6), schemas.CASH), "b2")
    assert sorted(r.port for r in table.read().collect()) == ["1", "3"]


def test_positions_are_stored_by_interval(spark, tmp_path):
    """A held position is one stored row however many steps it is listed at; later batches cut it short."""
    f, a, p = [fill(0.5, "A", "o", "BUY", 4, 10)], [alloc("o", "1", 1.0)], []
    fills, allocs, prices = books.tables(spark, f, a, p)
    cash = books.frame(spark, books.cash_rows(["1"]), schemas.CASH)
    hours = books.frame(spark, [(at(h),) for h in range(1, 9)], "event_ts timestamp_ntz")
    done = update(None, cash, fills, allocs, prices, hours)
    table = PositionTable(spark, str(tmp_path / "equity"))
    table.put(done.intervals, done.grid, "one")
    assert spark.read.parquet(f"{tmp_path}/equity/rows").count() == 1
    want = sorted(done.equity.collect())
    assert sorted(table.read().collect()) == want and len(want) == 8
    assert sorted(table.read(at(2), at(4)).collect()) == [r for r in want if at(2) <= r.timestamp <= at(4)]
    late = plan_grid(cash.unionByName(done.cash), hours.where("hour(event_ts) > 5"))
    again = update(done.equity, cash.unionByName(done.cash), fills, allocs, prices, hours.where("hour(event_ts) > 5"))
    assert late.start == again.grid.start == at(5)
    table.put(again.intervals, again.grid, "two")
    assert sorted((r.timestamp, r.amount, r.mtm) for r in table.read().collect()) == [
        (r.timestamp, r.amount, r.mtm) for r in want]
    table.compact("whole")
    assert sorted((r.timestamp, r.amount, r.mtm) for r in table.read().collect()) == [
        (r.timestamp, r.amount, r.mtm) for r in want]


def test_writes_leave_no_shuffles(spark, tmp_path):
    """What a batch stores keeps only its rows on the disks, whenever the driver collects its garbage."""
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = (files.apply(i).getName() for i in range(files.size()))
        return {name for name in names if name.startswith("shuffle_")}

    def left():
        for _ in range(25):  # executors remove their files in the background
            if not shuffles() - before:
                break
            time.sleep(0.2)
        return shuffles() - before

    cash = books.frame(spark, books.cash_rows(["1", "2"]), schemas.CASH)
    summed = cash.groupBy("timestamp", "port", "ccy").agg(*[F.sum(c).alias(c) for c in ("amount", "cost_basis")])
    writes = {
        "materialize": lambda: materialize(summed, "test-dropped"),
        "batch": lambda: BatchTable(spark, f"{tmp_path}/cash", schemas.CASH, "timestamp")._written(summed, "one"),
        "replay": lambda: replay.write_replay(summed, f"{tmp_path}/replay", "timestamp", 2)}
    for name, write in writes.items():
        before = shuffles()
        write()
        assert not left(), name
