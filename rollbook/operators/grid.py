"""The timestamp grid along which positions are rolled, and placing fills on it."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.times import ntz
from rollbook.operators.asof import last_before
from rollbook.session import materialize

# Up to this many steps, all netted rows of one ticker and portfolio are ordered in one task.
# On a longer grid they are ordered in blocks of `BLOCK_STEPS` and the blocks are linked.
WINDOW_STEPS = 1_000_000
BLOCK_STEPS = 100_000

# Where a monotonically increasing id holds the partition.
_PART_BITS = 33


@dataclass(frozen=True)
class Grid:
    """Steps numbered from 0 (the opening time) in time order: step, ts, prev_ts.

    `block` is the number of steps in a block of a window, or None when the grid is short enough
    for one. `opened` is the time whose stored rows open the run, the start unless nothing is
    stored before it.
    """

    steps: DataFrame
    start: dt.datetime
    end: dt.datetime
    last_step: int
    block: int | None = None
    opened: dt.datetime | None = None


def start_before(existing: DataFrame, events: DataFrame, ts: str = "timestamp") -> DataFrame:
    """One row: the latest existing time strictly before the earliest event (NULL if none)."""
    first = events.agg(F.min("event_ts").alias("first")).scalar()
    return existing.where(F.col(ts) < first).agg(F.max(ts).alias("start_ts"))


def times_to_update(
    existing: DataFrame, events: DataFrame, start_ts: Column | None, ts: str = "timestamp"
) -> DataFrame:
    """Distinct times to recompute: those stored from `start_ts` on, and the events."""
    kept = existing.select(F.col(ts).alias("ts"))
    if start_ts is not None:
        kept = kept.where(F.col("ts") >= start_ts)
    return kept.union(events.select(F.col("event_ts").alias("ts"))).distinct()


def number_steps(times: DataFrame) -> DataFrame:
    """Number distinct times from 0 and attach the time before each: step, ts, prev_ts.

    Times are cut into range partitions, numbered each by itself; only one summary row for each
    partition meets the others.
    """
    part = F.shiftright("_id", _PART_BITS).alias("_part")
    ranged = materialize(
        times.repartitionByRange("ts").sortWithinPartitions("ts")
        .select("ts", F.monotonically_increasing_id().alias("_id")), "times")
    parts = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last")).orderBy("_part").collect()
    begun, before, last = [], 0, None
    for p in parts:
        begun.append((p["_part"], before, last))
        before, last = before + p["n"], p["last"]
    offsets = times.sparkSession.createDataFrame(begun, "_part long, _before long, _last timestamp_ntz")
    inside = F.col("_id").bitwiseAND((1 << _PART_BITS) - 1)
    within = Window.partitionBy("_part").orderBy("_id")
    return (
        ranged.withColumn("_part", part).join(F.broadcast(offsets), "_part")
        .select(
            (inside + F.col("_before")).alias("step"), "ts",
            F.coalesce(F.lag("ts").over(within), "_last").alias("prev_ts")))


def build_grid(times: DataFrame) -> Grid:
    """The numbered grid of the times, written to the shared folder and measured."""
    steps = materialize(number_steps(times), "grid")
    found = steps.agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.max("step").alias("last")).first()
    if found["last"] is None:
        raise ValueError("no times to update")
    block = None if found["last"] <= WINDOW_STEPS else BLOCK_STEPS
    return Grid(steps, found["start"], found["end"], found["last"], block)


def assign_steps(df: DataFrame, ts: str, grid: Grid, times: DataFrame | None = None) -> DataFrame:
    """Add the step whose interval (prev_ts, ts] holds each row's time.

    That is the one after the last step before the time. Rows outside the grid are left out. Only
    the distinct times are merged with the steps; the rows then meet one row of their own time.
    `times` holds at least the times of `df`, in a column of the same name; `df` if not given.
    """
    in_grid = (F.col(ts) > ntz(grid.start)) & (F.col(ts) <= ntz(grid.end))
    inside = df.where(in_grid)
    found = (df if times is None else times).where(in_grid).select(ts).distinct()
    following = grid.steps.select(F.col("ts").alias(ts), (F.col("step") + 1).alias("step"))
    return inside.join(last_before(found, following, ts), ts)


def expand_steps(df: DataFrame, lo: Column, hi: Column, out: str, block: int | None,
                 key: list[str]) -> DataFrame:
    """One row per step from `lo` to `hi`.

    With `block`, intervals are first cut at block borders and spread by key and block, so that
    neither an array nor a task spans a long grid.
    """
    if block is None:
        return df.withColumn(out, F.explode(F.sequence(lo, hi)))
    size = F.lit(block)
    first = F.col("_part") * size
    return (
        df.withColumns({"_lo": lo, "_hi": hi})
        .withColumn("_part", F.explode(F.sequence(
            F.floor(F.col("_lo") / size), F.floor(F.col("_hi") / size))))
        .repartition(*key, "_part")
        .withColumn(out, F.explode(F.sequence(
            F.greatest("_lo", first), F.least("_hi", first + size - 1))))
        .drop("_lo", "_hi", "_part"))
