import dataclasses

import books
import pytest
from books import alloc, at, fill
from pyspark.sql import functions as F

from rollbook import schemas
from rollbook.operators import cash as cash_ops
from rollbook.operators import fills as fill_ops
from rollbook.operators import grid as grid_ops
from rollbook.operators import positions, reports
from rollbook.plans.portfolio import plan_grid, replace_suffix, update


def events(spark, hours):
    return books.frame(spark, [(at(h),) for h in hours], "event_ts timestamp_ntz")


def run(spark, f, a, p, hours, cash=None, equity=None):
    cash = cash or books.frame(spark, books.cash_rows(["1", "2"]), schemas.CASH)
    return update(equity, cash, *books.tables(spark, f, a, p), events(spark, hours))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_windows_equal_a_loop(spark, seed):
    f, a, p = books.random_book(seed)
    done = run(spark, f, a, p, range(1, 12))
    want = books.loop([at(h) for h in range(12)], f, a, p)
    got = books.collected(done.equity)
    books.assert_same(got, want)
    assert any(r[0] == 0.0 for r in want.values())
    # Profit of an episode is its final value less what was paid, so over a closed book the
    # profits sum to minus the cost.
    last = max(k[0] for k in got)
    value = sum(r[5] for k, r in got.items() if k[0] == last)
    assert sum(r[6] for r in got.values()) == pytest.approx(
        value - sum(r[2] for r in got.values()))
    spent = {r.port: r.c for r in done.trades.groupBy("port").agg(F.sum("cost").alias("c")).collect()}
    final = done.cash.where(F.col("timestamp") == at(11)).collect()
    assert {r.port: round(1000 - r.amount, 6) for r in final} == {
        k: round(v, 6) for k, v in spent.items()}


@pytest.mark.parametrize("seed", [4, 5])
def test_restart_from_stored_rows(spark, seed):
    f, a, p = books.random_book(seed)
    first = run(spark, f, a, p, range(1, 12))
    equity = books.frame(
        spark, [tuple(r) for r in first.equity.collect()], schemas.EQUITY)
    cash0 = books.frame(spark, books.cash_rows(["1", "2"]), schemas.CASH)
    cash = books.frame(
        spark, [tuple(r) for r in cash0.unionByName(first.cash).collect()], schemas.CASH)
    again = run(spark, f, a, p, [6.5, 7], cash=cash, equity=equity)
    assert again.grid.start == at(6)
    hours = [*range(7), 6.5, *range(7, 12)]
    books.assert_same(
        books.collected(replace_suffix(equity, again.equity, again.grid)),
        books.loop([at(h) for h in hours], f, a, p))


def test_late_fill_repairs_history(spark):
    """A stale result is repaired by recomputing from the time before the late event."""
    f, a, p = books.random_book(6)
    late = fill(3.5, "T0", "late", "BUY", 8, 55)
    a = [*a, alloc("late", "1", 1.0)]
    stale = run(spark, f, a, p, range(1, 12))
    equity = books.frame(spark, [tuple(r) for r in stale.equity.collect()], schemas.EQUITY)
    cash0 = books.frame(spark, books.cash_rows(["1", "2"]), schemas.CASH)
    cash = books.frame(
        spark, [tuple(r) for r in cash0.unionByName(stale.cash).collect()], schemas.CASH)
    fixed = run(spark, [*f, late], a, p, [3.5], cash=cash, equity=equity)
    hours = [0, 1, 2, 3, 3.5, *range(4, 12)]
    books.assert_same(
        books.collected(replace_suffix(equity, fixed.equity, fixed.grid)),
        books.loop([at(h) for h in hours], [*f, late], a, p))


def test_cases(spark):
    """Two orders in a step (D1), a short, a reopened and a netted position, a boundary fill."""
    f = [
        fill(0.5, "A", "a1", "BUY", 4, 10), fill(0.6, "A", "a2", "BUY", 4, 20),
        fill(2, "A", "a3", "SELL", 8, 30),  # exactly at step 2: belongs to it
        fill(3.5, "A", "a4", "BUY", 4, 40),
        fill(0.5, "S", "s1", "SELL", 4, 10),
        fill(0.5, "N", "n1", "BUY", 4, 10), fill(0.6, "N", "n2", "SELL", 4, 11),  # nets to 0 (D6)
        fill(0.2, "M", "m1", "BUY", 4, 10),
        fill(1.2, "M", "m2", "BUY", 4, 12), fill(1.4, "M", "m3", "SELL", 4, 13),
    ]
    a = [alloc(x[2], "1", 1.0) for x in f]
    done = run(spark, f, a, [], range(1, 6))
    got = books.collected(done.equity)
    books.assert_same(got, books.loop([at(h) for h in range(6)], f, a, []))
    assert got[at(1), "1", "A"][:2] == (8.0, 15.0)
    assert got[at(2), "1", "A"][0] == 0.0
    assert (at(3), "1", "A") not in got
    assert got[at(4), "1", "A"][:2] == (4.0, 40.0)
    assert got[at(5), "1", "S"][0] == -4.0
    n = got[at(1), "1", "N"]
    assert n[0] == 0.0 and n[3] is None and n[6] == pytest.approx(4.0)
    assert got[at(2), "1", "M"][4] == "last_mtm"  # no trade price where fills cancel


def test_partial_fills_share_one_allocation(spark):
    """An order filled over several steps is allocated once (D3)."""
    f = [fill(h, "A", "o", "BUY", 4, 10, total=12) for h in (0.5, 1.5, 2.5)]
    a = [alloc("o", "1", 2, "amount"), alloc("o", "2", 1, "amount")]
    rows = books.collected(run(spark, f, a, [], range(1, 4)).equity)
    assert rows[at(3), "1", "A"][0] == pytest.approx(2.0)
    assert rows[at(3), "2", "A"][0] == pytest.approx(1.0)


def test_latest_allocation_counts_and_missing_is_reported(spark):
    f = [fill(0.5, "A", "o", "BUY", 4, 10), fill(0.5, "A", "none", "BUY", 4, 10)]
    a = [alloc("o", "1", 0.5), alloc("o", "1", 1.0, hour=1)]
    df, al, _ = books.tables(spark, f, a, [])
    rows = books.collected(run(spark, f, a, [], [1]).equity)
    assert rows[at(1), "1", "A"][0] == 4.0  # D21
    assert [r.order_itag for r in fill_ops.unallocated(df, al).collect()] == ["none"]  # D4


def test_only_trade_currency_pays(spark):
    """Other currencies carry on, untracked portfolios are reported (D9, D19)."""
    cash = books.frame(spark, [
        (at(0), "1", "USD", 100.0, 100.0), (at(0), "1", "EUR", 50.0, 50.0)], schemas.CASH)
    f = [fill(0.5, "A", "o", "BUY", 4, 10)]
    a = [alloc("o", "1", 0.5), alloc("o", "2", 0.5)]
    done = run(spark, f, a, [], [1, 2], cash=cash)
    assert {(r.ccy, r.timestamp): r.amount for r in done.cash.collect()} == {
        ("USD", at(1)): 80.0, ("USD", at(2)): 80.0, ("EUR", at(1)): 50.0, ("EUR", at(2)): 50.0}
    assert [r.port for r in cash_ops.ports_without_cash(done.trades, cash).collect()] == ["2"]


def test_start_is_the_exact_time_before(spark):
    """Sub-second neighbours are told apart (D5); without one the first event is the start (D17)."""
    stored = books.frame(spark, [(at(0),), (at(1),), (at(1 + 1e-4),)], "timestamp timestamp_ntz")
    assert grid_ops.start_before(stored, events(spark, [1 + 1e-4, 3])).first()[0] == at(1)
    grid = plan_grid(stored, events(spark, [0, 2]))
    assert (grid.start, grid.last_step) == (at(0), 3)


def test_full_join_step(spark):
    held = books.frame(
        spark, [("A", "1", 4.0, 10.0), ("Z", "1", 0.0, 0.0), ("B", "1", 2.0, 5.0)],
        "ticker string, port string, amount double, avgPrice double")
    trades = books.frame(
        spark, [("A", "1", -4.0, -50.0), ("C", "1", 1.0, 7.0)],
        "ticker string, port string, dq double, cost double")
    got = {r.ticker: (r.amount_prev, r.amount, r.avgPrice)
           for r in positions.carry_full(held, trades).collect()}
    assert got == {"A": (4.0, 0.0, 0.0), "B": (2.0, 2.0, 5.0), "C": (0.0, 1.0, 7.0)}


@pytest.mark.parametrize("pitch", [1e-4, 0.01, 1, 24, 700])
def test_steps_by_any_pitch(spark, pitch):
    hours = [0, *[pitch * (i + 1) ** 1.3 for i in range(20)]]
    grid = grid_ops.build_grid(books.frame(spark, [(at(h),) for h in hours], "ts timestamp_ntz"))
    times = sorted({*hours, *[h * 0.77 for h in hours], hours[-1] * 1.1, -1.0})
    df = books.frame(spark, [(i, at(h)) for i, h in enumerate(times)], "i int, t timestamp_ntz")
    got = {r.i: r.step for r in grid_ops.assign_steps(df, "t", grid).collect()}
    stamps = [at(h) for h in hours]
    want = {}
    for i, h in enumerate(times):
        for s in range(1, len(stamps)):
            if stamps[s - 1] < at(h) <= stamps[s]:
                want[i] = s
    assert got == want


@pytest.mark.parametrize("seed,block", [(1, 1), (2, 3), (7, 5)])
def test_blocks_equal_a_loop(spark, monkeypatch, seed, block):
    """A long grid is ordered in blocks; the result is the same."""
    monkeypatch.setattr(grid_ops, "WINDOW_STEPS", 0)
    monkeypatch.setattr(grid_ops, "BLOCK_STEPS", block)
    f, a, p = books.random_book(seed)
    done = run(spark, f, a, p, range(1, 12))
    books.assert_same(
        books.collected(done.equity), books.loop([at(h) for h in range(12)], f, a, p))
    plain = {(r.timestamp, r.port): r.amount for r in done.cash.collect()}
    monkeypatch.undo()
    again = run(spark, f, a, p, range(1, 12))
    assert plain == {(r.timestamp, r.port): r.amount for r in again.cash.collect()}


def test_no_interval_leaves_its_block(spark, monkeypatch):
    """Positions are listed where their block is ordered; a held position begins each block anew."""
    monkeypatch.setattr(grid_ops, "WINDOW_STEPS", 0)
    monkeypatch.setattr(grid_ops, "BLOCK_STEPS", 3)
    f = [fill(0.5, "A", "o", "BUY", 4, 10), fill(9.5, "A", "p", "SELL", 4, 11)]
    done = run(spark, f, [alloc("o", "1", 1.0), alloc("p", "1", 1.0)], [], range(1, 12))
    found = [(r.step, r.until, r.amount) for r in done.intervals.collect()]
    assert sorted(found) == [(1, 2, 4.0), (3, 5, 4.0), (6, 8, 4.0), (9, 9, 4.0), (10, 10, 0.0)]
    assert done.equity.count() == 10


def test_blocks_shuffle_rows_once_at_the_end(spark, monkeypatch):
    """What blocks take over is stored: its shuffles are not kept beside those of the rows."""
    monkeypatch.setattr(grid_ops, "WINDOW_STEPS", 0)
    monkeypatch.setattr(grid_ops, "BLOCK_STEPS", 3)
    f, a, p = books.random_book(2)
    plan = run(spark, f, a, p, range(1, 12)).intervals._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("block", [None, 3])
def test_quotes_by_interval_equal_a_join_of_all_steps(spark, block):
    """Quotes at exactly a step, and the mean of all steps, without a join of the rows by step."""
    f, a, p = books.random_book(8)
    f += [("STK", "U", "u", "BUY", None, 50.0, 0.0, at(0.5), 4.0), fill(4.5, "U", "v", "BUY", 4, 52),
          ("STK", "W", "w", "BUY", None, 50.0, 0.0, at(0.5), 4.0),  # an amount that never gets known
          fill(1.5, None, "n", "BUY", 4, 50)]
    a += [alloc(o, "1", 1.0) for o in "uvwn"]
    p += [(at(s), t, 40.0 + s, at(s)) for s in (1, 3, 7) for t in ("U", "W")]
    fills, allocs, prices = books.tables(spark, f, a, p)
    g = dataclasses.replace(plan_grid(
        books.frame(spark, books.cash_rows(["1", "2"]), schemas.CASH), events(spark, range(1, 12))), block=block)
    trades = fill_ops.step_trades(fills, allocs, g)
    if block:  # in blocks, rows without a ticker are left out
        trades = trades.where("ticker IS NOT NULL")
    rows = positions.roll_amounts(trades, g).collect()
    quotes = {(d, t): x for d, t, x, _ in p}
    averages = {t: [r.avgPrice for r in rows if r.ticker == t] for t in {r.ticker for r in rows}}
    means = {t: sum(x) / len(x) for t, x in averages.items()}
    intervals = positions.quoted_intervals(trades, prices, g)

    def found(df):
        return sorted(map(repr, ((r.timestamp, r.port, r.ticker, r.amount, r.price and round(r.price, 6)) for r in df.collect())))

    want = [(r.timestamp, r.port, r.ticker, r.amount, quotes.get((r.timestamp, r.ticker))) for r in rows]
    assert found(positions.quoted_every_step(intervals, F.lit(None).cast("double"), g)) == sorted(map(repr, want))
    want = [(*r[:4], round(means[r[2]] if r[4] is None else r[4], 6)) for r in want if r[2] is not None]
    assert found(reports.fill_with_group_mean(intervals, g)) == sorted(map(repr, want))
    assert {r.ticker for r in rows} >= {"T0", "U", "W"} and any(r.amount is None for r in rows)


def test_returns_need_no_window_by_episode(spark):
    """Episodes are told in the order of the steps: sums of P&L sort the rows of a position once."""
    f, a, p = books.random_book(1)
    done = run(spark, f, a, p, range(1, 12))
    plan = reports.interval_returns(done.intervals)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if " Window [" in x]
    assert windows and not any("episode" in x.split("], ")[-2] for x in windows)
