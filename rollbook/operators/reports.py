"""Reports and checks over stored tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.times import ntz
from rollbook.operators.grid import Grid
from rollbook.operators.positions import quoted_every_step, unchanged_pnl, unchanged_ret


def between(df: DataFrame, ts: str, lo: dt.datetime, hi: dt.datetime) -> DataFrame:
    """Rows in a closed interval."""
    return df.where(F.col(ts).between(ntz(lo), ntz(hi)))


def on_day(df: DataFrame, ts: str, day: dt.date) -> DataFrame:
    """Rows of one calendar day, as a range so that it reaches the files."""
    lo = dt.datetime(day.year, day.month, day.day)
    return df.where((F.col(ts) >= ntz(lo)) & (F.col(ts) < ntz(lo + dt.timedelta(days=1))))


def last_date(df: DataFrame, ts: str) -> DataFrame:
    return df.agg(F.max(ts).alias("last_date"))


def interval_returns(intervals: DataFrame, lo: int = 1, hi: int | None = None) -> DataFrame:
    """(ticker, port, pnl, ret, n): sums over the steps `lo` .. `hi` of positions by interval.

    Nothing is expanded: the steps after an interval's first add nothing, or NULL where it has no
    price. `n` counts the steps.
    """
    until = F.col("until") if hi is None else F.least("until", F.lit(hi))
    first = F.greatest("step", F.lit(lo))
    listed = intervals.withColumns({"_first": first, "_until": until}).where(F.col("_first") <= F.col("_until"))
    own = F.col("step") >= lo
    still = F.col("_until") > F.when(own, F.col("step")).otherwise(F.lit(lo - 1))

    def total(name: str, unchanged: Column) -> Column:
        return F.coalesce(F.sum(F.when(own, F.col(name))), F.sum(F.when(still, unchanged))).alias(name)

    return listed.groupBy("ticker", "port").agg(
        total("pnl", unchanged_pnl()), total("ret", unchanged_ret()),
        F.sum(F.col("_until") - F.col("_first") + 1).alias("n"))


def pnl_by_port(returns: DataFrame, ports: Sequence[str]) -> DataFrame:
    """P&L and summed return, one row per ticker and a pair of columns per portfolio."""
    return returns.groupBy("ticker").pivot("port", list(ports)).agg(
        F.sum("pnl").alias("pnl"), F.sum("ret").alias("ret"))


def source_counts(intervals: DataFrame) -> DataFrame:
    """Steps and flat steps by price source, over positions by interval."""
    moved = F.col("step") > 0
    after = F.col("until") - F.col("step")
    flat = F.when(F.col("amount") == 0.0, F.col("n")).otherwise(F.lit(0))
    parts = F.array(
        F.struct("price_source", F.when(moved, 1).otherwise(0).cast("long").alias("n")),
        F.struct(F.lit("last_mtm").alias("price_source"), after.alias("n")))
    return (
        intervals.select("amount", F.inline(parts)).groupBy("price_source")
        .agg(F.sum("n").alias("n"), F.sum(flat).alias("n_flat")).where(F.col("n") > 0))


def distinct_times(*columns: tuple[DataFrame, str]) -> DataFrame:
    """Distinct times over one or several tables."""
    frames = [df.select(F.col(c).alias("ts")) for df, c in columns]
    times = frames[0]
    for frame in frames[1:]:
        times = times.union(frame)
    return times.distinct()


def fill_with_group_mean(intervals: DataFrame, grid: Grid) -> DataFrame:
    """`positions.quoted_intervals` by step, where missing prices become the ticker's mean average price.

    Every interval counts with its steps from step 1 on, so only the result lists them. The mean is
    aggregated and joined back: no task holds a whole ticker. Rows without a ticker are of no group.
    """
    n = F.greatest(F.col("until") - F.greatest("step", F.lit(1)) + 1, F.lit(0))
    total = intervals.withColumn("_n", F.when(F.col("avgPrice").isNotNull(), n)).groupBy("ticker").agg(
        F.sum(F.col("avgPrice") * F.col("_n")).alias("_sum"), F.sum("_n").alias("_n"))
    means = total.select("ticker", F.try_divide("_sum", "_n").alias("_mean"))
    return quoted_every_step(intervals.join(means, "ticker"), F.col("_mean"), grid)


def off_grid(df: DataFrame, ts: str, seconds: int = 5) -> DataFrame:
    """Distinct times whose second is no multiple of `seconds`."""
    return df.where(F.second(ts) % seconds != 0).select(F.col(ts).alias("ts")).distinct()


def time_set_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Times in both, only left and only right: counts."""
    sides = (
        left.select("ts", F.lit(1).alias("l"), F.lit(0).alias("r"))
        .union(right.select("ts", F.lit(0).alias("l"), F.lit(1).alias("r")))
        .groupBy("ts").agg(F.max("l").alias("l"), F.max("r").alias("r")))
    return sides.agg(
        F.count_if(F.expr("l = 1 AND r = 1")).alias("n_both"),
        F.count_if(F.expr("l = 1 AND r = 0")).alias("n_left"),
        F.count_if(F.expr("l = 0 AND r = 1")).alias("n_right"))


def event_range(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count("event_ts").alias("n_events"), F.min("event_ts").alias("first_event"),
        F.max("event_ts").alias("last_event"))


def head(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first `n` rows in an explicit order."""
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The last `n` rows in an explicit order."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def slice_rows(df: DataFrame, start: int, length: int, *order: str) -> DataFrame:
    """Rows `start` .. `start + length - 1` (from 0) in an explicit order."""
    return df.orderBy(*order).offset(start).limit(length)


def mirrored(positions: DataFrame, price_factor: float = 0.7) -> DataFrame:
    """Test positions: sign flipped, price scaled, one day earlier."""
    amount, price = -F.col("amount"), F.col("avgPrice") * price_factor
    return positions.withColumns({
        "amount": amount, "avgPrice": price, "price": price,
        "timestamp": F.col("timestamp") - F.expr("INTERVAL 1 DAY"),
        "trade_cost_basis": price * amount, "mtm": price * amount})
