import datetime as dt
import json

import books
import numpy as np
import pytest
from books import at
from pyspark.sql import functions as F

from rollbook import schemas
from rollbook.functions.times import ntz
from rollbook.operators import execution, orders, reports, signals
from rollbook.sources import messages


def signal(n, stamp, kind="STK", action="BUY"):
    return ("AAPL", "LMT", 10.5, stamp, kind, 3.0, {"1": 2.0, "2": 1.0}, "amount", action,
            "dumb_strat", n)


SIGNAL = ("symbol string, orderType string, lmtPrice double, signal_timestamp string, "
          "secType string, totalQuantity double, portAlloc map<string,double>, "
          "typeAlloc string, action string, placerId string, arrival long")


@pytest.fixture(scope="module")
def intake(spark):
    return books.frame(spark, [
        signal(1, "20250220100000"), signal(2, "20250220100000"),
        signal(3, "20250220095959", kind="OPT"), signal(4, "20250221100000")], SIGNAL)


def test_numbers_run_on(spark, intake):
    used = books.frame(spark, [("25022000000007",), ("25022000000005",), ("25022x",)],
                       "order_itag string")
    assert orders.last_number(used, "250220").first()[0] == 7
    assert orders.last_number(used, "250221").first()[0] == 0
    got = {r.arrival: r.order_itag
           for r in orders.numbered(intake, orders.last_numbers(used)).collect()}
    assert got == {3: "25022000000008", 1: "25022000000009", 2: "25022000000010",
                   4: "25022100000001"}


def test_intake_tables(spark, intake):
    rows = orders.numbered(intake)
    blot = orders.blotter_rows(rows)
    assert books.fields(blot.schema) == books.fields(schemas.BLOTTER)
    assert {r.orderParams for r in blot.collect()} == {"10.5"}
    allocs = orders.allocation_rows(rows)
    assert books.fields(allocs.schema) == books.fields(schemas.BLOTTER_ALLOC) and allocs.count() == 8
    log = {(r.order_itag, r.status) for r in orders.status_log(rows).collect()}
    opt = "25022000000001"
    assert (opt, orders.DENIED) in log and (opt, orders.DISPATCHED) not in log
    assert sum(s == orders.DISPATCHED for _, s in log) == 3
    closed = orders.status_log(rows, client_open=False).where("status = 'orderNotSent'")
    assert [(r.note) for r in closed.collect()] == [orders.CLIENT_CLOSED] * 3  # D15
    ok, denied = orders.risk_split(rows)
    assert (ok.count(), denied.count()) == (3, 1)
    assert orders.risk_split(rows, pass_through=False)[0].count() == 0
    assert orders.order_bodies(ok, ntz(at(0))).first().confirmation_time_stamp == "250101000000"


def test_fill_matching(spark):
    """Totals are per order (D10), statuses follow, confirmations list the fill times (D12)."""
    def order(tag, itag, total, status="open"):
        return ("s1", tag, "IB", 3, "A", "STK", "LMT", "BUY", float(total), itag, at(0), status,
                None, f"desk{tag}")

    record = books.frame(spark, [
        order(1, "x1", 5), order(2, "x2", 4), order(3, "x3", 9), order(4, "x4", 2, "filled")],
        schemas.ORDERS)
    fills = books.frame(spark, [
        (at(1), "A", 1, 3, 2.0, 10.0, 0.0), (at(2), "A", 1, 3, 3.0, 11.0, 0.0),
        (at(1), "A", 2, 3, 1.0, 10.0, 0.0), (at(1), "A", 4, 3, 2.0, 10.0, 0.0)],
        "fill_timestamp timestamp_ntz, secId string, api_internal_tag long, api_clientId long, "
        "tradeQty double, avgPrice double, commission double")
    matched = execution.match_fills(
        execution.open_orders(record, session=F.lit("s1")), fills)
    assert books.fields(matched.schema) == books.fields(schemas.FILLS)
    assert sorted((r.order_itag, r.tradeQty) for r in matched.collect()) == [
        ("x1", 2.0), ("x1", 3.0)]
    after = {r.order_itag: (r.status, r.status_timestamp)
             for r in execution.mark_filled(record, matched, ntz(at(9))).collect()}
    assert after["x1"] == ("filled", at(9)) and after["x2"] == ("open", None)
    execution.check_filled_counts(record, matched)
    with pytest.raises(ValueError, match="2 orders"):
        execution.check_filled_counts(
            record.unionByName(record.where("order_itag = 'x1'")), matched)
    (event,) = execution.confirmations(matched).collect()
    assert event.fill_timestamps == ["20250101010000", "20250101020000"]
    log = orders.confirmation_log(execution.confirmations(matched), ntz(at(9))).first()
    assert (log.order_itag, log.status) == ("x1", orders.CONFIRMED)


def greedy(times, freq, last=None):
    taken = []
    for t in sorted(set(times)):
        if last is None or last + freq < t:
            taken.append(t)
            last = t
    return taken


@pytest.mark.parametrize("blocks,groups,rows", [
    (1, 2, 0), (2, 3, 0), (3, 1, 0), (2, 256, 10**6), (256, 256, 10**6)])
def test_spacing_in_blocks_equals_a_scan(spark, blocks, groups, rows):
    rng = np.random.default_rng(blocks)
    ticks, want = [], set()
    for k in range(6):
        # Seconds with ties, exact spacings, bursts and gaps.
        t = np.unique(rng.integers(0, 4000 * (k + 1), 300))
        t = np.concatenate([t, t[:5] + 30, [10_000 * (k + 1) + 30 * i for i in range(9)]])
        ticks += [(f"k{k}", at(int(x) / 3600), i) for i, x in enumerate(t)]
        want |= {(f"k{k}", x) for x in greedy([int(x) for x in t], 30, 50)}
    df = books.frame(spark, ticks, "ticker string, date timestamp_ntz, i int")
    started = books.frame(
        spark, [(f"k{k}", at(50 / 3600)) for k in range(6)], "ticker string, start_ts timestamp_ntz")
    out = signals.throttled(
        df, dt.timedelta(seconds=30), started=started, block_spacings=blocks,
        group_blocks=groups, link_rows=rows)
    got = {(r.ticker, round((r.date - at(0)).total_seconds())) for r in out.collect()}
    assert got == want


def test_direction_drops_ties(spark):
    """A price at the mean gives no signal (D14)."""
    ticks = books.frame(spark, [
        (at(1), "A", 10.0), (at(2), "A", 20.0), (at(30), "A", 15.0), (at(31), "A", 16.0),
        (at(32), "A", 1.0)], "date timestamp_ntz, ticker string, price double")
    means = signals.calibration_of(ticks, at(0).date())
    assert means.first().asDict() == {"ticker": "A", "day_mean": 15.0, "first_ts": at(1)}
    got = {r.date: r.action for r in signals.directed(ticks, means).collect()}
    assert got == {at(1): "SELL", at(2): "BUY", at(31): "BUY", at(32): "SELL"}
    body = signals.signal_bodies(
        signals.directed(ticks, means), {"1": 2.0, "2": 1.0}).where("action = 'BUY'")
    assert body.schema.fieldNames() == schemas.SIGNAL.fieldNames()


def test_messages(spark):
    good = json.dumps({"timestamp": "20250220100000", "table_name": "us_equity",
                       "tickers": ["A", "B"], "event": "new_data"})
    raw = books.frame(spark, [
        (1, good, messages.JSON), (2, good[:30], messages.JSON), (3, good, "text/plain"),
        (4, '{"timestamp":"x","table_name":"bonds"}', messages.JSON)],
        "id int, body string, content_type string")
    out = {r.id: r for r in messages.decode(raw, schemas.DATA_EVENT).collect()}
    assert out[1].msg.tickers == ["A", "B"] and out[1].rejected is None
    assert (out[2].rejected, out[3].rejected) == ("not json", "content type")
    fine = messages.decode(raw, schemas.DATA_EVENT).where("rejected IS NULL").select("msg.*")
    fills = books.frame(spark, [("o", "s", ["20250220100000", "20250220100010"])],
                        schemas.FILL_EVENT)
    times = sorted(r.event_ts for r in messages.event_times(fine, fills).collect())
    assert times == [dt.datetime(2025, 2, 20, 10), dt.datetime(2025, 2, 20, 10, 0, 10)]  # D13
    held = books.frame(spark, [("A",), ("B",), ("C",)], "ticker string")
    assert [r.complete for r in messages.event_coverage(held, fine).collect()] == [False, False]
    listed = fine.select(F.explode("tickers").alias("ticker"))
    assert [r.ticker for r in messages.missing_tickers(held, listed).collect()] == ["C"]


def test_reports(spark):
    df = books.frame(spark, [(at(h), h) for h in (1.0, 2.0, 2.001, 5.0)], "ts timestamp_ntz, h double")
    assert [r.h for r in reports.slice_rows(df, 1, 2, "ts").collect()] == [2.0, 2.001]
    assert [r.h for r in reports.tail(df, 2, "ts").collect()] == [5.0, 2.001]
    assert [r.ts for r in reports.off_grid(df, "ts").collect()] == [at(2.001)]
    diff = reports.time_set_diff(df.select("ts"), df.where("h > 2").select("ts")).first()
    assert tuple(diff) == (2, 2, 0)
