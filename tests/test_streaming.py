import datetime as dt
import json
import random
import time

import books
from books import alloc, at, fill
from pyspark.sql import functions as F

from rollbook import schemas
from rollbook.operators.execution import match_fills, open_orders
from rollbook.sources import messages
from rollbook.streaming import executions, portfolio, replay, signals


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    f = [fill(0.5, "A", "o", "BUY", 4, 10)]
    a = [alloc("o", "1", 1.0)]
    fills, allocs, _ = books.tables(spark, f, a, [])
    book = portfolio.open_book(
        spark, str(tmp_path / "book"), books.frame(spark, books.cash_rows(["1"]), schemas.CASH),
        lambda lo, hi: fills, lambda: allocs)
    p = [(at(h), "A", float(10 + h), at(h)) for h in (1, 2)]
    portfolio.handle(book, books.frame(spark, p, schemas.PRICES), 0)
    first = book.equity.log().collect()
    portfolio.handle(book, books.frame(spark, p, schemas.PRICES), 0)
    assert book.equity.log().collect() == first
    late = [(at(0.75), "A", 10.75, at(3))]
    portfolio.handle(book, books.frame(spark, late, schemas.PRICES), 1)
    books.assert_same(
        books.collected(book.equity.read()),
        books.loop([at(h) for h in (0, 0.75, 1, 2)], f, a, [*p, *late]))
    assert {(r.timestamp, r.amount) for r in book.cash.read().collect()} == {
        (at(0), 1000.0), (at(0.75), 960.0), (at(1), 960.0), (at(2), 960.0)}
    sent = [json.loads(r.value) for r in spark.read.text(f"{book.outbox}/batch=0000000000").collect()]
    assert sorted(m["timestamp"] for m in sent) == ["20250101010000", "20250101020000"]


def message(kind, stamp, content=messages.JSON, **other):
    if kind == "data":
        body = {"timestamp": stamp, "table_name": "us_equity", "tickers": ["A"], "event": "new_data"} | other
        return (json.dumps(body), content, "data_csv.us_equity")
    return (json.dumps({"order_itag": "o", "sessionId": "s", "fill_timestamps": stamp}), content, "fills")


MESSAGE = "body string, content_type string, topic string"


def test_messages_of_both_streams(spark, tmp_path):
    """Late and repeated events lose nothing; bad messages go to quarantine, foreign topics nowhere."""
    f = [fill(0.5, "A", "o", "BUY", 4, 10), fill(2.25, "A", "o2", "SELL", 2, 12)]
    a = [alloc("o", "1", 1.0), alloc("o2", "1", 1.0)]
    p = [(at(h), "A", float(10 + h), at(h)) for h in (1, 2, 3)]
    fills, allocs, prices = books.tables(spark, f, a, p)
    book = portfolio.open_book(
        spark, str(tmp_path / "book"), books.frame(spark, books.cash_rows(["1"]), schemas.CASH),
        lambda lo, hi: fills, lambda: allocs)
    book.prices.append(prices, "prices")

    def batch(i, data, filled):
        for name, rows in (("data", data), ("fills", filled)):
            books.frame(spark, rows, MESSAGE).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        streams = [spark.readStream.schema(MESSAGE).parquet(str(tmp_path / n)) for n in ("data", "fills")]
        portfolio.start_messages(book, *streams, str(tmp_path / "checkpoint"), every=None).awaitTermination()

    batch(0, [message("data", "20250101030000"), message("data", "20250101030000"), ("{", messages.JSON, "data_csv.us_equity"),
              message("data", "20250101024000", table_name="bonds"),
              (message("data", "20250101024500")[0], messages.JSON, "other.us_equity")],
          [message("fill", ["20250101021500"]), message("fill", [], content="text/plain")])
    batch(1, [message("data", "20250101010000")], [message("fill", ["20250101003000", "20250101021500"])])  # hours late
    batch(2, [message("data", "20241231230000")], [])  # before the opening balance
    hours = [-1, 0, 0.5, 1, 2.25, 3]
    books.assert_same(books.collected(book.equity.read()), books.loop([at(h) for h in hours], f, a, p))
    spent = {-1: 0.0, 0: 0.0, 0.5: 40.0, 1: 40.0, 2.25: 16.0, 3: 16.0}
    assert {(r.timestamp, r.amount) for r in book.cash.read().collect()} == {(at(h), 1000.0 - s) for h, s in spent.items()}
    bad = spark.read.parquet(f"{book.quarantine}").collect()
    assert sorted((r.kind, r.rejected) for r in bad) == [("data", "not json"), ("fill", "content type")]


def test_timed_batches(spark, tmp_path):
    """The timed trigger takes what has arrived at each pulse."""
    f = [fill(0.5, "A", "o", "BUY", 4, 10)]
    a = [alloc("o", "1", 1.0)]
    fills, allocs, _ = books.tables(spark, f, a, [])
    book = portfolio.open_book(
        spark, str(tmp_path / "book"), books.frame(spark, books.cash_rows(["1"]), schemas.CASH),
        lambda lo, hi: fills, lambda: allocs)
    rows = [(at(h), "A", float(10 + h), at(h)) for h in (1, 2)]
    folder = str(tmp_path / "in")
    books.frame(spark, rows[:1], schemas.PRICES).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(schemas.PRICES).parquet(folder)
    query = portfolio.start(book, stream, str(tmp_path / "checkpoint"), every="1 second")
    try:
        query.processAllAvailable()
        books.frame(spark, rows[1:], schemas.PRICES).coalesce(1).write.mode("append").parquet(folder)
        query.processAllAvailable()
    finally:
        query.stop()
    assert query.exception() is None
    books.assert_same(books.collected(book.equity.read()), books.loop([at(h) for h in (0, 1, 2)], f, a, rows))


def _legs():
    """Orders and fills: complete, short, filled beyond the total, without an order, without a fill."""
    order = lambda i, qty, status="open": (
        "250101", i, "IB", 3, "A", "STK", "LMT", "BUY", float(qty), f"o{i}", at(0), status, None, "desk")
    placed = [order(1, 10), order(2, 5), order(3, 4), order(4, 7), order(5, 6), order(6, 3, "filled")]
    filled = lambda i, h, qty: (at(h), "A", i, 3, float(qty), 10.0 + h, 0.5)
    done = [filled(1, 1, 4), filled(1, 2, 4), filled(1, 3, 2), filled(2, 1, 5), filled(3, 2, 3), filled(5, 1, 1), filled(5, 4, 5)]
    return placed, [*done, filled(9, 1, 2), filled(6, 1, 3)]


FLAT = ("fill_timestamp timestamp_ntz, secId string, api_internal_tag long, api_clientId long, "
        "tradeQty double, avgPrice double, commission double")


def _play(spark, root, desk, placed, filled, keep=executions.KEEP):
    """Add one file to each stream and run what is available."""
    for name, rows, schema in (("orders", placed, schemas.ORDERS), ("fills", filled, FLAT)):
        books.frame(spark, rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/{name}")
    streams = [spark.readStream.schema(s).parquet(f"{root}/{n}") for n, s in (("orders", schemas.ORDERS), ("fills", FLAT))]
    executions.start_matching(desk, *streams, f"{root}/checkpoint", every=None, keep=keep).awaitTermination()


def test_fills_match_in_any_arrival_order(spark, tmp_path):
    """Several runs over one checkpoint, in several orders of arrival, release what the batch match does."""
    placed, filled = _legs()
    want = match_fills(open_orders(books.frame(spark, placed, schemas.ORDERS)), books.frame(spark, filled, FLAT))
    for seed in range(2):
        rng = random.Random(seed)
        o, f = rng.sample(placed, len(placed)), rng.sample(filled, len(filled))
        desk = executions.Desk(str(tmp_path / f"desk{seed}"))
        for k in range(3):
            _play(spark, tmp_path / f"in{seed}", desk, o[2 * k : 2 * k + 2], f[3 * k : 3 * k + 3])
        assert sorted(desk.events(spark).collect()) == sorted(want.collect())
        assert desk.events(spark, executions.OVER).count() == 0
        sent = [json.loads(r.value) for r in desk.sent(spark).collect()]
        assert sorted(m["order_itag"] for m in sent) == ["o1", "o2", "o5"]
        assert {m["order_itag"]: len(m["fill_timestamps"]) for m in sent} == {"o1": 3, "o2": 1, "o5": 2}
        assert sorted(r.order_itag for r in desk.log(spark).collect()) == ["o1", "o2", "o5"]


def test_a_batch_is_matched_as_a_whole(spark, tmp_path):
    """Thousands of legs in one batch; one run again starts from the same state."""
    n = 3000
    orders = books.frame(spark, [
        ("250101", i, "IB", 3, "A", "STK", "LMT", "BUY", 2.0, f"o{i}", at(0), "open", None, "desk") for i in range(n)], schemas.ORDERS)
    fills = books.frame(spark, [(at(1 + k), "A", i, 3, 1.0, 10.0, 0.5) for i in range(n) for k in range(2)], FLAT)
    desk = executions.Desk(str(tmp_path / "desk"))
    both = executions.offered(orders, fills)
    first = both.where("fill IS NULL OR hour(fill.fill_timestamp) = 1")
    desk.match(first, 0)
    assert desk.events(spark).count() == 0
    for _ in range(2):
        desk.match(both.where("hour(fill.fill_timestamp) = 2 AND api_internal_tag % 3 > 0"), 1)
        assert desk.events(spark).count() == n // 3 * 4
    desk.match(both.where("hour(fill.fill_timestamp) = 2"), 2)
    assert desk.events(spark).count() == 2 * n
    assert desk.events(spark, executions.OVER).count() == n // 3 * 2


def test_late_fills_and_expired_orders(spark, tmp_path):
    """A fill of a released order is handed on; so is what still waits when its time is over."""
    placed, filled = _legs()
    desk = executions.Desk(str(tmp_path / "desk"))
    keep = dt.timedelta(seconds=20)
    _play(spark, tmp_path / "in", desk, placed, filled, keep)
    _play(spark, tmp_path / "in", desk, placed[:1], [(at(5), "A", 2, 3, 1.0, 11.0, 0.5)], keep)
    over = desk.events(spark, executions.OVER).collect()
    assert [(r.order_itag, r.tradeQty) for r in over] == [("o2", 1.0)]
    assert desk.events(spark).count() == 6
    time.sleep(20)
    _play(spark, tmp_path / "in", desk, [], [(at(6), "A", 77, 3, 1.0, 11.0, 0.5)], keep)
    expired = desk.events(spark, executions.EXPIRED).collect()
    assert sorted((r.api_internal_tag, r.order_itag, r.tradeQty) for r in expired if r.tradeQty) == [
        (3, "o3", 3.0), (6, None, 3.0), (9, None, 2.0)]
    assert [(r.order_itag, r.totalQty) for r in expired if r.tradeQty is None] == [("o4", 7.0)]


def _spaced(batches, means, freq, delay):
    """Signals and late rows by a loop over batches, tickers and rows."""
    signal, late = set(), set()
    state = {}
    for batch in batches:
        for ticker in {r[1] for r in batch} & set(means):
            mean, first = means[ticker]
            last, released, waiting = state.get(ticker, (first, None, []))
            own = [r for r in batch if r[1] == ticker]
            for r in own:
                if r[2] is None or r[2] == mean:
                    continue
                if released is not None and r[0] <= released:
                    late.add(r[3])
                else:
                    waiting = [*waiting, r]
            seen = max(r[0] for r in own + waiting)
            released = seen - delay if released is None else max(released, seen - delay)
            taken = last
            for r in sorted((r for r in waiting if r[0] <= released), key=lambda r: r[0]):
                if r[0] > taken + freq:
                    taken = r[0]
                if r[0] == taken:
                    signal.add(r[3])
            state[ticker] = (taken, released, [r for r in waiting if r[0] > released])
    return signal, late


def test_signal_stream_loses_no_row(spark, tmp_path):
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 2)
    second = dt.timedelta(seconds=1)
    freq, delay = 30 * second, 200 * second
    batches, n = [], 0
    for b in range(4):
        batch = []
        for _ in range(120):
            n += 1
            # Most rows come in their time, some long after it.
            t = start + second * max(1, 300 * b + rng.randrange(300) - rng.choice([0, 0, 0, 150, 500]))
            price = rng.choice([9.0, 10.0, 11.0, 12.5, None])
            batch.append((t, rng.choice(["A", "A", "A", "B", "no mean"]), price, n))
        batches.append(batch)
    batches.append([(start + dt.timedelta(days=1), t, None, None) for t in ("A", "B")])
    means = {"A": (10.0, start), "B": (11.0, start)}
    calibrated = spark.createDataFrame(
        [(t, *m) for t, m in means.items()], "ticker string, day_mean double, first_ts timestamp_ntz")
    schema = "date timestamp_ntz, ticker string, price double, tick_id long"
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = signals.signal_stream(
            spark.readStream.schema(schema).parquet(str(tmp_path / "in")), calibrated, freq, delay)
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    signal, late = _spaced(batches, means, freq, delay)
    assert {r.id for r in got if r.event == signals.SIGNAL} == signal
    assert {r.id for r in got if r.event == signals.LATE} == late
    assert signal and late and len(got) == len(signal) + len(late)
    rows = {r[3]: r for b in batches for r in b}
    for r in got:
        t, ticker, price, _ = rows[r.id]
        assert (r.date, r.ticker, r.price) == (t, ticker, price)
        assert r.action == ("BUY" if price > means[ticker][0] else "SELL")


def test_a_replayed_file_is_read_by_many_tasks(spark, tmp_path):
    """A batch is one file, and all that a batch stores has as many tasks as that file has row groups."""
    rows = spark.range(1_500_000).select(
        (F.lit(books.T0).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id"))).alias("date"),
        F.rand(3).alias("price"))
    replay.write_replay(rows, str(tmp_path / "in"), "date", 2)
    seen = []

    def take(batch, batch_id):
        sizes = [n for n in batch.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect() if n]
        seen.append((batch_id, len(sizes), sum(sizes)))

    replay.read_replay(spark, str(tmp_path / "in"), rows).writeStream.foreachBatch(take).option(
        "checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert [batch_id for batch_id, *_ in seen] == [0, 1]
    assert sum(n for *_, n in seen) == 1_500_000
    assert all(tasks > 1 for _, tasks, _ in seen), seen
