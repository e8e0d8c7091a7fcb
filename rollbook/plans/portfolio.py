"""The portfolio update: events in, recomputed equity and cash out."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions.times import ntz
from rollbook.operators.cash import roll_cash
from rollbook.operators.fills import step_trades
from rollbook.operators.grid import Grid, build_grid, start_before, times_to_update
from rollbook.operators.positions import at_time, every_step, roll_intervals
from rollbook.schemas import EQUITY
from rollbook.session import materialize


@dataclass(frozen=True)
class Update:
    """What one update recomputes: everything after `grid.start`.

    `intervals` are the equity positions as long as nothing changes; `equity` lists every step.
    """

    grid: Grid
    trades: DataFrame
    intervals: DataFrame
    cash: DataFrame

    @property
    def equity(self) -> DataFrame:
        return at_time(every_step(self.intervals, self.grid), self.grid).select(*EQUITY.fieldNames())


def plan_grid(cash: DataFrame, events: DataFrame) -> Grid:
    """Grid from the latest stored time before the first event; the cash table is never empty.

    Without an earlier time the first event itself is the start, and the run is opened by the
    earliest stored rows: what was held first is taken to have been held then.
    """
    events = materialize(events.select("event_ts").distinct(), "events")  # read for the start and the times
    start = start_before(cash, events).first()["start_ts"]
    grid = build_grid(times_to_update(cash, events, None if start is None else ntz(start)))
    opened = start if start is not None else cash.agg(F.min("timestamp")).first()[0]
    return replace(grid, opened=opened)


def opening_rows(stored: DataFrame, grid: Grid) -> DataFrame:
    """The stored rows that open the run, at its start time."""
    if grid.opened is None:
        return stored.where(F.lit(False))
    return stored.where(F.col("timestamp") == ntz(grid.opened)).withColumn("timestamp", ntz(grid.start))


def roll(
    grid: Grid,
    equity: DataFrame | None,
    cash: DataFrame,
    fills: DataFrame,
    alloc: DataFrame,
    prices: DataFrame,
    trade_ccy: str = "USD",
    fill_keys: DataFrame | None = None,
) -> Update:
    """Equity and cash after `grid.start`, opened by the rows stored at `grid.opened`.

    Netted trades are written once, as equity, its prices and cash all read them. For `fill_keys`
    see `step_trades`.
    """
    trades = materialize(step_trades(fills, alloc, grid, fill_keys), "trades")
    opening = None if equity is None else opening_rows(equity, grid)
    return Update(
        grid, trades,
        roll_intervals(trades, prices, grid, opening),
        roll_cash(trades, opening_rows(cash, grid), grid, trade_ccy))


def update(
    equity: DataFrame | None,
    cash: DataFrame,
    fills: DataFrame,
    alloc: DataFrame,
    prices: DataFrame,
    events: DataFrame,
    trade_ccy: str = "USD",
    fill_keys: DataFrame | None = None,
) -> Update:
    """Roll the stored equity and cash tables forward over the events.

    Rows at the latest time before the first event open the run, rows after it are recomputed.
    """
    return roll(plan_grid(cash, events), equity, cash, fills, alloc, prices, trade_ccy, fill_keys)


def replace_suffix(stored: DataFrame, recomputed: DataFrame, grid: Grid) -> DataFrame:
    """History before the start time, the rows that opened the run, and the recomputed ones."""
    kept = stored.where(F.col("timestamp") < ntz(grid.start))
    return kept.unionByName(opening_rows(stored, grid)).unionByName(recomputed.select(*stored.columns))
