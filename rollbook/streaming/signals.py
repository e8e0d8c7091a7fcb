"""Signal spacing on a stream of prices."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rollbook.functions.times import micros
from rollbook.operators.signals import accepted, throttle_batch

STATE = "last long, us array<long>, id array<long>"
OUT = "ticker string, us long, id long"


def throttled_stream(
    ticks: DataFrame, freq: dt.timedelta, late: str, ts: str = "date", key: str = "ticker",
    row_id: str = "tick_id",
) -> DataFrame:
    """Rows (ticker, us, id) that pass the spacing, whatever their order of arrival.

    The outcome depends on time order, so rows wait until the watermark has passed them and are
    then released in order. The state of a key is its last accepted time and the rows waiting.
    """
    spacing = int(freq / dt.timedelta(microseconds=1))

    def step(ids: tuple, frames: Iterator[pd.DataFrame], state: GroupState
             ) -> Iterator[pd.DataFrame]:
        last, us, waiting = state.get if state.exists else (None, [], [])
        frames = [pd.DataFrame({"us": list(us), "id": list(waiting)}, dtype="int64"),
                  *[f[["us", "id"]] for f in frames]]
        rows = pd.concat(frames, ignore_index=True)
        watermark = state.getCurrentWatermarkMs() * 1000
        due = rows["us"] < watermark
        passed, last = throttle_batch(rows[due], last, spacing)
        kept = rows[~due]
        if len(kept) or last is not None:
            state.update((last, kept["us"].tolist(), kept["id"].tolist()))
        if len(kept):
            # The timeout must lie ahead of the watermark.
            state.setTimeoutTimestamp(max(
                int(np.min(kept["us"])) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield passed.assign(ticker=ids[0])[["ticker", "us", "id"]]

    timed = ticks.select(
        F.col(key).cast("string").alias("ticker"), micros(F.col(ts)).alias("us"),
        F.col(row_id).alias("id"), F.timestamp_micros(micros(F.col(ts))).alias("event_time"))
    return (
        timed.withWatermark("event_time", late).groupBy("ticker")
        .applyInPandasWithState(
            step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout))


#: Kinds of rows that `signal_stream` releases.
SIGNAL, LATE = "signal", "late"

_ROW = ["us", "id", "price", "action"]
_SIGNAL_STATE = ("last long, released long, us array<long>, id array<long>, price array<double>, "
                 "action array<string>")
_SIGNAL_OUT = "event string, ticker string, us long, id long, price double, action string"


def _releaser(spacing: int, delay: int, idle: int | None):
    """One ticker's batch by arrays: there may be very many tickers with few rows each."""
    kinds = ("int64", "int64", "float64", "object")

    def step(ids: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, released, *waiting = state.get if state.exists else (None, None, [], [], [], [])
        kept = [[np.array(w, k)] for w, k in zip(waiting, kinds)]
        seen = max(waiting[0], default=None)
        late = []
        for f in frames:
            if last is None:
                last = int(f["start_us"].iloc[0])
            columns = [f[c].to_numpy(k) for c, k in zip(_ROW, kinds)]
            newest = int(columns[0].max())
            seen = newest if seen is None else max(seen, newest)
            acts = pd.notna(columns[3])
            behind = columns[0] <= released if released is not None else np.zeros(len(acts), bool)
            late.append([c[acts & behind] for c in columns])
            for k, c in zip(kept, columns):
                k.append(c[acts & ~behind])
        rows = [np.concatenate(k) for k in kept]
        if seen is not None:
            # A ticker that stayed silent has nothing more to wait for.
            upto = seen if state.hasTimedOut else seen - delay
            released = upto if released is None else max(released, upto)
        due = rows[0] <= released if released is not None else np.zeros(len(rows[0]), bool)
        taken = accepted(np.unique(rows[0][due]), spacing, last)
        last = int(taken[-1]) if len(taken) else last
        passed = [c[due & np.isin(rows[0], taken)] for c in rows]
        rows = [c[~due] for c in rows]
        state.update((last, released, *[c.tolist() for c in rows]))
        if idle is not None and len(rows[0]):
            state.setTimeoutDuration(idle)
        for event, out in ((SIGNAL, passed), *[(LATE, x) for x in late]):
            if len(out[0]):
                yield pd.DataFrame({"event": event, "ticker": ids[0]} | dict(zip(_ROW, out)))

    return step


def signal_stream(
    ticks: DataFrame, means: DataFrame, freq: dt.timedelta, delay: dt.timedelta,
    idle: dt.timedelta | None = None, row_id: str = "tick_id",
) -> DataFrame:
    """Rows (event, ticker, date, id, price, action) out of a stream of (ticker, date, price, id).

    `means` is the calibration: (ticker, day_mean, first_ts); the first spacing counts from first_ts
    and tickers without a calibration have no signals. A ticker's rows wait until one `delay` later
    has come and are then spaced in time order, so that arrival within the delay does not matter.
    There is no watermark and nothing is dropped: a row that comes when its time has been released
    is an event LATE, with everything it carried, for whoever has to know; it changes no signal that
    is out already. Rows at the mean or without a price give no signal but let time pass; a closing
    row without a price releases what a ticker still has. A null id counts as -1; rows without a ticker
    or time are no ticks. With `idle`, a ticker that stays silent
    for so long is released too, which takes a timed trigger.

    State is per ticker: its last signal, the time released and the rows of one delay.
    """
    def count(t: dt.timedelta, unit: dt.timedelta) -> int:
        return int(t / unit)

    action = F.when(F.col("price") > F.col("day_mean"), "BUY").when(F.col("price") < F.col("day_mean"), "SELL")
    placed = ticks.join(means.select("ticker", "day_mean", "first_ts"), "ticker").select(
        F.col("ticker").cast("string").alias("ticker"), micros(F.col("date")).alias("us"),
        F.coalesce(F.col(row_id), F.lit(-1)).cast("long").alias("id"), F.col("price").cast("double").alias("price"), action.alias("action"),
        micros(F.col("first_ts")).alias("start_us"))
    micro = dt.timedelta(microseconds=1)
    step = _releaser(
        max(1, count(freq, micro)), count(delay, micro),
        None if idle is None else max(1, count(idle, dt.timedelta(milliseconds=1))))
    released = placed.where(F.col("us").isNotNull()).groupBy("ticker").applyInPandasWithState(
        step, _SIGNAL_OUT, _SIGNAL_STATE, "append",
        GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout)
    return released.select(
        "event", "ticker", F.timestamp_micros("us").cast("timestamp_ntz").alias("date"), "id", "price", "action")
