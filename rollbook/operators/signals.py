"""Strategy signals: calibration, direction and the minimum spacing between signals.

Spacing is greedy: a signal passes if the last one passed lies more than `freq` before it. That
is a chain through the whole history of a ticker, yet it is cut into time blocks here. What a
block passes on depends only on the last time accepted before it, so each block first reports,
for every event that could be its first accepted one, where the chain leaves the block; a short
pass over these reports links the blocks; then every block marks its own events. Reports are
counted, and where one ticker has too many for a task they are first joined group by group.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions.times import micros, to_stamp
from rollbook.session import materialize

BLOCK_SPACINGS = 256  # spacings in a block
GROUP_BLOCKS = 256  # blocks in a group
LINK_ROWS = 2_000_000  # report rows of one ticker linked in a single task


def calibration(prices: DataFrame) -> DataFrame:
    """Mean price and first time per ticker and day."""
    return prices.groupBy("ticker", F.to_date("date").alias("day")).agg(
        F.avg("price").alias("day_mean"), F.min("date").alias("first_ts"))


def calibration_of(prices: DataFrame, day: dt.date) -> DataFrame:
    """The same for one calibration day."""
    start = dt.datetime(day.year, day.month, day.day)
    lo, hi = (F.lit(str(t)).cast("timestamp_ntz") for t in (start, start + dt.timedelta(days=1)))
    return calibration(prices.where((F.col("date") >= lo) & (F.col("date") < hi))).drop("day")


def directed(prices: DataFrame, means: DataFrame) -> DataFrame:
    """BUY above the calibration mean, SELL below, no signal at it."""
    action = F.when(F.col("price") > F.col("day_mean"), "BUY").when(
        F.col("price") < F.col("day_mean"), "SELL")
    return prices.join(means, "ticker").withColumn("action", action).where(
        F.col("action").isNotNull())


def _successors(ts: np.ndarray, freq: int) -> np.ndarray:
    """Index of the first later time more than `freq` away; len(ts) if there is none."""
    return np.searchsorted(ts, ts + freq, side="right")


def _chain_exits(ts: np.ndarray, freq: int, entries: int) -> np.ndarray:
    """For each of the first `entries` events: the last time accepted if the chain enters there.

    All entries hop together; a block of n spacings takes at most n hops.
    """
    after = np.append(_successors(ts, freq), len(ts))
    at = np.arange(entries)
    while True:
        onward = after[at]
        moving = onward < len(ts)
        if not moving.any():
            return ts[at]
        at = np.where(moving, onward, at)


def accepted(ts: np.ndarray, freq: int, last: int | None) -> np.ndarray:
    """Times the chain accepts in the block, entering after `last`."""
    after = _successors(ts, freq)
    i = 0 if last is None else int(np.searchsorted(ts, last + freq, side="right"))
    taken = []
    while i < len(ts):
        taken.append(ts[i])
        i = after[i]
    return np.asarray(taken, dtype="int64")


def _pieces(rows: pa.Table, unit: str) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(unit, times, leaves) of each reported block or group, in order."""
    rows = rows.sort_by([(unit, "ascending"), ("us", "ascending")])
    ids, t, leave = (rows[c].to_numpy() for c in (unit, "us", "leave"))
    names, first = np.unique(ids, return_index=True)
    ends = np.append(first[1:], len(ids))
    return [(n, t[lo:hi], leave[lo:hi]) for n, lo, hi in zip(names, first, ends)]


def _follow(pieces: list, last: int | None, freq: int) -> list[int | None]:
    """The last accepted time before each piece, starting with `last`."""
    before = []
    for _, t, leave in pieces:
        before.append(last)
        at = 0 if last is None else int(np.searchsorted(t, last + freq, side="right"))
        if at < len(t):
            last = int(leave[at])
    return before


def _joined(pieces: list, freq: int) -> tuple[np.ndarray, np.ndarray]:
    """One report for consecutive blocks: possible entries and where the chain leaves them.

    The chain enters through the first block, or, if that lies within one spacing of the last
    accepted time, with the first event of the second.
    """
    entries, at = pieces[0][1], pieces[0][2]
    for n, (_, t, leave) in enumerate(pieces[1:]):
        if n == 0:
            entries, at = np.append(entries, t[0]), np.append(at, t[0] - freq - 1)
        on = np.searchsorted(t, at + freq, side="right")
        at = np.where(on < len(t), leave[np.minimum(on, len(t) - 1)], at)
    return entries, at


def throttled(
    events: DataFrame, freq: dt.timedelta, ts: str = "date", key: str = "ticker",
    started: DataFrame | None = None, block_spacings: int = BLOCK_SPACINGS,
    group_blocks: int = GROUP_BLOCKS, link_rows: int = LINK_ROWS,
) -> DataFrame:
    """Events that pass the spacing. Events of a key at the same time pass or fail together.

    `started` gives (key, start_ts), the time the first spacing counts from; keys without one
    have no signals. When it is not given at all, a key's first event passes.
    """
    spacing = max(1, int(freq / dt.timedelta(microseconds=1)))
    width = spacing * block_spacings
    timed = events.withColumn("_us", micros(F.col(ts)))
    if started is not None:
        first = started.select(key, micros(F.col("start_ts")).alias("_start")).distinct()
        timed = timed.join(first, key).where(
            F.col("_us") > F.col("_start") + F.lit(spacing)).drop("_start")
    blocks = timed.select(
        F.col(key).alias("k"), F.floor(F.col("_us") / F.lit(width)).cast("long").alias("b"),
        F.col("_us").alias("us")).distinct()

    def report(rows: pa.Table) -> pa.Table:
        t = np.sort(rows["us"].to_numpy())
        b = rows["b"][0].as_py()
        # The chain enters within one spacing of the block's start, or at the first event beyond.
        n = min(len(t), int(np.searchsorted(t, b * width + spacing, side="right")) + 1)
        return _columns(
            rows, n, b=np.full(n, b), g=np.full(n, b // group_blocks), us=t[:n],
            leave=_chain_exits(t, spacing, n))

    def join_up(rows: pa.Table) -> pa.Table:
        us, leave = _joined(_pieces(rows, "b"), spacing)
        rows = pa.concat_tables([rows.slice(0, 1)] * len(us))
        return _columns(rows, len(us), g=rows["g"].to_numpy(), us=us, leave=leave)

    def link(unit: str) -> Callable[[pa.Table], pa.Table]:
        def run(rows: pa.Table) -> pa.Table:
            pieces = _pieces(rows, unit)
            return _columns(rows, len(pieces), **{
                unit: np.array([p[0] for p in pieces]), "last": _follow(pieces, None, spacing)})
        return run

    def link_blocks(rows: pa.Table, entry: pa.Table) -> pa.Table:
        pieces = _pieces(rows, "b")
        return _columns(
            rows, len(pieces), b=np.array([p[0] for p in pieces]),
            last=_follow(pieces, entry["last"][0].as_py(), spacing))

    def mark(rows: pa.Table, entry: pa.Table) -> pa.Table:
        taken = accepted(np.sort(rows["us"].to_numpy()), spacing, entry["last"][0].as_py())
        return _columns(rows, len(taken), us=taken)

    kind = f"k {events.schema[key].dataType.simpleString()}"
    # Counted, then read again; small against the events.
    reports = materialize(blocks.groupBy("k", "b").applyInArrow(
        report, f"{kind}, b long, g long, us long, leave long"), "reports")
    most = reports.groupBy("k").count().agg(F.max("count")).first()[0] or 0
    if most <= link_rows:
        entries = reports.groupBy("k").applyInArrow(link("b"), f"{kind}, b long, last long")
    else:
        groups = reports.groupBy("k", "g").applyInArrow(
            join_up, f"{kind}, g long, us long, leave long")
        group_entries = groups.groupBy("k").applyInArrow(
            link("g"), f"{kind}, g long, last long")
        entries = reports.groupBy("k", "g").cogroup(
            group_entries.groupBy("k", "g")).applyInArrow(
            link_blocks, f"{kind}, b long, last long")
    passed = blocks.groupBy("k", "b").cogroup(entries.groupBy("k", "b")).applyInArrow(
        mark, f"{kind}, us long").withColumnsRenamed({"k": key, "us": "_us"})
    return timed.join(passed, [key, "_us"], "left_semi").drop("_us")


def _columns(rows: pa.Table, n: int, **columns) -> pa.Table:
    """The key of the first `n` rows with 64-bit columns."""
    out = rows.slice(0, n).select(["k"])
    for name, values in columns.items():
        out = out.append_column(name, pa.array(values, pa.int64()))
    return out


def signal_bodies(accepted: DataFrame, alloc: dict[str, float], type_alloc: str = "amount",
                  quantity: float = 1.0) -> DataFrame:
    """Signal messages for accepted prices."""
    pairs = [F.lit(x) for kv in alloc.items() for x in kv]
    return accepted.select(
        F.col("ticker").alias("symbol"), F.lit("LMT").alias("orderType"),
        F.col("price").alias("lmtPrice"), to_stamp(F.col("date")).alias("signal_timestamp"),
        F.lit("STK").alias("secType"), F.lit(quantity).alias("totalQuantity"),
        F.create_map(*pairs).alias("portAlloc"), F.lit(type_alloc).alias("typeAlloc"), "action")


def throttle_batch(
    pdf: pd.DataFrame, last: int | None, spacing: int
) -> tuple[pd.DataFrame, int | None]:
    """Spacing of one in-order batch of rows with `us`, for the streaming form."""
    pdf = pdf.sort_values("us", kind="stable")
    t = np.unique(pdf["us"].to_numpy("int64"))
    taken = accepted(t, spacing, last)
    if len(taken):
        last = int(taken[-1])
    return pdf[pdf["us"].isin(taken)], last
