"""The position roll-forward: amount, average price, mark, P&L and return per grid step.

Positions change at few steps: those with a trade, and those with a quote of the ticker. Both are
netted to at most one row per (ticker, port, step) and ordered together in one set of windows. What
holds from one such step until the next is an interval; sums of P&L are taken over intervals, and
only a result that lists every step expands them, once, at its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rollbook.functions.money import snap_flat, trade_price
from rollbook.functions.times import ntz
from rollbook.operators.grid import Grid, expand_steps
from rollbook.schemas import EQUITY
from rollbook.session import materialize

KEY = ["ticker", "port"]


def opening_trades(opening: DataFrame) -> DataFrame:
    """Open positions at the start time as trades of step 0 that carry their mark."""
    return (
        opening.where(F.col("amount") != 0.0)
        .select(
            "ticker", "port", F.lit(0).cast("long").alias("step"),
            F.col("amount").alias("dq"),
            (F.col("amount") * F.col("avgPrice")).alias("cost"),
            F.try_divide(F.col("mtm"), F.col("amount")).alias("paid")))


def all_trades(trades: DataFrame, opening: DataFrame | None) -> DataFrame:
    """Netted trades with their average price, opening positions first."""
    rows = trades.withColumn("paid", trade_price(F.col("cost"), F.col("dq")))
    if opening is None:
        return rows
    return rows.unionByName(opening_trades(opening))


def quoted_steps(prices: DataFrame, grid: Grid) -> DataFrame:
    """(ticker, step, price) of the prices at exactly a grid time.

    A quote at the opening time is already in the opening mark.
    """
    later = grid.steps.where(F.col("step") > 0).select("step", "ts")
    quoted = prices.where((F.col("date") > ntz(grid.start)) & (F.col("date") <= ntz(grid.end)))
    return quoted.select("ticker", F.col("date").alias("ts"), "price").join(later, "ts").select(
        "ticker", "step", "price")


def with_quotes(trades: DataFrame, quotes: DataFrame | None) -> DataFrame:
    """Trades, and the quotes of a position's ticker while it may be open.

    Quotes before a position's first trade, or after the trade that closes it for good, are left out.
    """
    rows = trades.select(
        *KEY, "step", "dq", "cost", "paid", F.lit(None).cast("double").alias("quoted"), F.lit(True).alias("traded"))
    if quotes is None:
        return rows
    spans = _spans(trades)
    return rows.unionByName(_marks(quotes, spans, (F.col("_left") != 0.0) | (F.col("step") <= F.col("_last")), F.lit(0.0)))


def _spans(trades: DataFrame) -> DataFrame:
    """Per position: first and last step traded, first with a known amount, and what is left at the end."""
    return trades.groupBy(*KEY).agg(
        F.min("step").alias("_first"), F.max("step").alias("_last"), snap_flat(F.sum("dq")).alias("_left"),
        F.min(F.when(F.col("dq").isNotNull(), F.col("step"))).alias("_known"))


def _marks(quotes: DataFrame, spans: DataFrame, may_be_open: Column, dq: Column) -> DataFrame:
    """Quotes of the positions' tickers as rows that trade nothing."""
    return quotes.join(spans, "ticker").where((F.col("step") >= F.col("_first")) & may_be_open).select(
        *KEY, "step", dq.alias("dq"), F.lit(0.0).alias("cost"), F.lit(None).cast("double").alias("paid"),
        F.col("price").alias("quoted"), F.lit(False).alias("traded"))


def trade_states(rows: DataFrame, grid: Grid) -> DataFrame:
    """Position after each step of `with_quotes`.

    `mark` is the last trade price of the episode, `mark_step` the step from which a market
    quote overrides it, `quote` the last quote; `mark_prev`, `mark_prev_step` and `quote_prev` say
    the same of the step before. An episode ends with the step at which the amount returns to
    zero; cost basis and marks do not pass from one episode to the next.

    On a grid with blocks, no task orders more than one block of steps of a position: what a block
    takes over from those before it comes from one summary row per block. An open position has a
    row at the start of each block (`_taken_over`) that changes nothing, so no interval leaves its
    block.
    """
    if grid.block is None:
        return _states(_own(_netted(rows, KEY)), KEY)  # netted first, as narrow rows
    group = [*KEY, "block"]
    # Both are stored, so that the shuffles which tell them are gone before the next ones are written.
    # Rows without a ticker, portfolio or step belong to no block.
    rows = materialize(rows.dropna(subset=[*KEY, "step"]), "block-rows")
    rows = _own(rows).withColumn("block", F.floor(F.col("step") / F.lit(grid.block)))
    taken = materialize(_taken_over(rows, grid), "taken-over")
    states = _states(_netted(rows.unionByName(taken), group), group)
    states = states.withColumn("next_step", F.coalesce("next_step", (F.col("block") + 1) * F.lit(grid.block)))
    return states.where(F.col("next_step") > F.col("step")).drop("block")


def _own(rows: DataFrame) -> DataFrame:
    """Rows of `with_quotes` in the form they share with those a block takes over."""
    return rows.select(
        *KEY, "step", "dq", "cost", "paid", F.when(F.col("paid").isNotNull(), F.col("step")).alias("paid_step"),
        "quoted", F.when(F.col("quoted").isNotNull(), F.col("step")).alias("quoted_step"),
        *_nothing("opened long", "listed double", "listed_basis double"), "traded", F.lit(False).alias("taken"))


def _nothing(*columns: str) -> list[Column]:
    return [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in columns]


def _netted(rows: DataFrame, group: list[str]) -> DataFrame:
    """One row per step, in the partitions of the windows over `group`."""
    key = [c for c in (*group, "step", "taken") if c in rows.columns]
    return rows.repartition(*group).groupBy(*key).agg(
        F.sum("dq").alias("dq"), F.sum("cost").alias("cost"),
        *[F.max(c).alias(c) for c in rows.columns if c not in (*key, "dq", "cost")])


def _states(rows: DataFrame, group: list[str]) -> DataFrame:
    """States by windows over `group`; a row taken over comes before the group's own rows.

    Episodes are told from the step at which they open, in the order of the steps. Only the cost
    basis has a window by episode; results without `basis` do without that window and its sort.
    """
    taken = F.col("taken")
    order = ["step", F.desc("taken")] if "block" in group else ["step"]
    by_step = Window.partitionBy(*group).orderBy(*order)
    sofar = by_step.rowsBetween(Window.unboundedPreceding, 0)
    before = by_step.rowsBetween(Window.unboundedPreceding, -1)

    def last(name: str | Column, over: WindowSpec) -> Column:
        return F.last(name, ignorenulls=True).over(over)

    held = _taken_sum("dq", sofar, group)
    rows = rows.select(
        *group, "step", "taken", "cost", "paid", "traded", "listed_basis",
        _amount(sofar, group).alias("amount"),
        snap_flat(held + F.coalesce(F.sum(F.when(~taken, F.col("dq"))).over(before), F.lit(0.0))).alias("amount_prev"),
        F.lead("step").over(by_step).alias("next_step"), F.first(F.coalesce("opened", "step")).over(sofar).alias("_first"),
        *[last(c, over).alias(f"{name}_{c}") for name, over in (("_last", sofar), ("_prev", before))
          for c in ("paid", "paid_step", "quoted", "quoted_step")])
    is_closed = (F.col("amount") == 0.0) & ~taken
    rows = rows.withColumns({
        "episode": F.coalesce(F.sum(F.when(is_closed, 1).otherwise(0)).over(before), F.lit(0)),
        "opened": F.coalesce(last(F.when(is_closed, F.col("next_step")), before), F.col("_first"))})

    upto = Window.partitionBy(*group, "episode").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    basis = _taken_sum("cost", upto, group) + F.sum(F.when(~taken, F.col("cost"))).over(upto)

    def of_episode(name: str) -> tuple[Column, Column]:
        """Last trade price of the episode, and its step or else that of the opening."""
        own = F.col(f"{name}_paid_step") >= F.col("opened")
        return F.when(own, F.col(f"{name}_paid")), F.when(own, F.col(f"{name}_paid_step")).otherwise(F.col("opened"))

    def quote(name: str) -> Column:
        return F.struct(F.col(f"{name}_quoted_step").alias("step"), F.col(f"{name}_quoted").alias("price"))

    def prev(own: Column, taken_over: Column) -> Column:
        return F.when(taken, taken_over).otherwise(own)

    (mark, mark_step), (mark_prev, mark_prev_step) = of_episode("_last"), of_episode("_prev")
    return rows.select(
        *group, "step", "next_step", F.when(taken, F.lit(0.0)).otherwise(F.col("cost")).alias("cost"),
        F.when(~taken, F.col("paid")).alias("paid"), (F.col("traded") | taken).alias("traded"), "amount",
        prev(F.col("amount_prev"), F.col("amount")).alias("amount_prev"), quote("_last").alias("quote"),
        prev(quote("_prev"), quote("_last")).alias("quote_prev"),
        prev(basis, F.col("listed_basis")).alias("basis"), mark.alias("mark"), mark_step.alias("mark_step"),
        prev(mark_prev, mark).alias("mark_prev"), prev(mark_prev_step, mark_step).alias("mark_prev_step"))


def _taken_sum(name: str, over: WindowSpec, group: list[str]) -> Column:
    """What the row taken over brings; zero without one."""
    if "block" not in group:
        return F.lit(0.0)
    return F.coalesce(F.sum(F.when(F.col("taken"), F.col(name))).over(over), F.lit(0.0))


def _amount(sofar: WindowSpec, group: list[str]) -> Column:
    own = snap_flat(_taken_sum("dq", sofar, group) + F.sum(F.when(~F.col("taken"), F.col("dq"))).over(sofar))
    return F.when(F.col("taken"), F.col("listed")).otherwise(own)


def _taken_over(rows: DataFrame, grid: Grid) -> DataFrame:
    """A row for each open position and block that its earlier blocks leave it open in."""
    group = [*KEY, "block"]
    begin = (F.col("block") * F.lit(grid.block)).alias("step")
    no = F.lit(False)
    over_blocks = Window.partitionBy(*KEY).orderBy("block")
    quote = F.when(F.col("quoted").isNotNull(), F.struct("step", "quoted"))
    sums = rows.groupBy(*group).agg(F.sum("dq").alias("dq"), F.max(quote).alias("quote"))
    held = sums.select(
        *group, begin, F.coalesce(F.sum("dq").over(
            over_blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("dq"),
        F.lit(0.0).alias("cost"), *_nothing("paid double", "paid_step long"),
        F.col("quote.quoted").alias("quoted"), F.col("quote.step").alias("quoted_step"),
        *_nothing("opened long", "listed double", "listed_basis double"), no.alias("traded"), F.lit(True).alias("taken"))
    after = grid.last_step // grid.block + 1
    ends = _block_ends(_netted(rows.unionByName(held), group), group).select(
        *group, "dq", "listed", "listed_basis", "basis", "paid", "paid_step", "opened", F.max("quote").over(over_blocks).alias("quote"),
        F.coalesce(F.lead("block").over(over_blocks), F.lit(after)).alias("following"))
    later = F.sequence(F.col("block") + 1, F.col("following"))
    ends = ends.where(F.col("listed").isNull() | (F.col("listed") != 0.0)).withColumn("block", F.explode(later))
    return ends.where(F.col("block") < after).select(
        *KEY, begin, "dq", F.col("basis").alias("cost"), "paid", "paid_step",
        F.col("quote.quoted").alias("quoted"), F.col("quote.step").alias("quoted_step"), "opened", "listed", "listed_basis",
        no.alias("traded"), F.lit(True).alias("taken"), "block")


def _block_ends(rows: DataFrame, group: list[str]) -> DataFrame:
    """Per block: shares held, last quote, and of the episode open at its end basis, last trade price and opening.

    `listed` and `listed_basis` are the last row's own, NULL where it knows none.
    """
    order = ["step", F.desc("taken")]
    by_step = Window.partitionBy(*group).orderBy(*order)
    amount = _amount(by_step.rowsBetween(Window.unboundedPreceding, 0), group)
    own_step = F.when(~F.col("taken"), F.col("step"))
    closed = F.when((F.col("amount") == 0.0) & ~F.col("taken"), 1).otherwise(0)
    rows = rows.withColumn("amount", amount).withColumn("episode", F.coalesce(
        F.sum(closed).over(by_step.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # The rows after a block's last close; they are its last episode unless that closes too.
    quote = F.when(F.col("quoted").isNotNull(), F.struct(F.col("quoted_step").alias("step"), "quoted"))
    tails = (
        rows.groupBy(*group, "episode")
        .agg(
            F.max(F.col("episode") + closed).alias("closes"), F.sum(F.when(~F.col("taken"), F.col("cost"))).alias("basis"),
            F.max_by("paid", "paid_step").alias("paid"), F.max("paid_step").alias("paid_step"),
            F.min(own_step).alias("opened"), F.max(own_step).alias("last"), F.max_by("amount", own_step).alias("listed"),
            F.sum("dq").alias("dq"), F.max(quote).alias("quote"))
        .groupBy(*group)
        .agg(F.max(F.struct("episode", "closes", "basis", "paid", "paid_step", "opened")).alias("t"),
             F.max_by("listed", "last").alias("listed"), F.sum("dq").alias("dq"), F.max("quote").alias("quote"))
        .select(*group, "dq", "listed", "quote", "t.*"))
    still_open = F.col("episode") == F.col("closes")
    tails = tails.select(
        *group, "dq", "listed", "quote", "closes", *[
            F.when(still_open, F.col(c)).alias(c) for c in ("basis", "paid", "paid_step", "opened")])
    # Blocks without a close lengthen the episode begun before them.
    over_blocks = Window.partitionBy(*KEY).orderBy("block")
    tails = tails.withColumn("run", F.sum(F.when(F.col("closes") > 0, 1).otherwise(0)).over(
        over_blocks))
    in_run = Window.partitionBy(*KEY, "run").orderBy("block")
    basis = F.coalesce(F.sum("basis").over(in_run), F.lit(0.0))
    return tails.select(
        *group, "dq", "listed", "quote", basis.alias("basis"),
        F.when(F.col("basis").isNotNull(), basis).alias("listed_basis"),
        F.last("paid", ignorenulls=True).over(in_run).alias("paid"),
        F.last("paid_step", ignorenulls=True).over(in_run).alias("paid_step"),
        F.first("opened", ignorenulls=True).over(in_run).alias("opened"))


def avg_price() -> Column:
    """Cost basis per share; zero for a closed position."""
    return F.coalesce(F.try_divide(F.col("basis"), F.col("amount")), F.lit(0.0))


def _until(grid: Grid) -> Column:
    """The last step at which what a row says still holds; a closed position is listed once."""
    return F.when(F.col("amount") == 0.0, F.col("step")).otherwise(
        F.least(F.col("next_step") - 1, F.lit(grid.last_step))).alias("until")


def _mark(quote: str, mark: Column, mark_step: Column) -> Column:
    """The quote if it is as new as the episode's last trade price, else that price."""
    return F.when(F.col(f"{quote}.step") >= mark_step, F.col(f"{quote}.price")).otherwise(mark)


def _value(price: Column, amount: Column) -> Column:
    return F.when(amount == 0.0, F.lit(0.0)).otherwise(price * amount)


def marked_intervals(states: DataFrame, grid: Grid) -> DataFrame:
    """Positions by interval `step` .. `until` in which nothing changes.

    Cost, price source, P&L and return are those of `step`; at the steps after it nothing is paid
    or gained. An interval from step 0 is the opening position: its own step is not to be listed.
    """
    amount, amount_prev, cost = F.col("amount"), F.col("amount_prev"), F.col("cost")
    mark_prev = _mark("quote_prev", F.col("mark_prev"), F.col("mark_prev_step"))
    source = (
        F.when(F.col("quote.step") == F.col("step"), "vector")
        .when(F.col("paid").isNotNull(), "trade")
        .otherwise("last_mtm"))
    return (
        states.where(F.col("traded") | (amount_prev != 0.0))
        .select(
            *KEY, "step", _until(grid), "amount", "amount_prev", avg_price().alias("avgPrice"),
            cost.alias("trade_cost_basis"),
            _mark("quote", F.col("mark"), F.col("mark_step")).alias("price"),
            source.alias("price_source"), _value(mark_prev, amount_prev).alias("mtm_prev"))
        .withColumn("mtm", _value(F.col("price"), amount))
        .withColumn("pnl", F.col("mtm") - F.col("trade_cost_basis") - F.col("mtm_prev"))
        .withColumn("ret", F.when(
            amount_prev == 0.0, F.try_divide(F.col("mtm"), F.col("trade_cost_basis")) - 1.0).otherwise(
            F.try_divide(F.col("pnl"), F.col("mtm_prev"))))
        .drop("amount_prev", "mtm_prev"))


def unchanged_pnl() -> Column:
    """P&L of a step at which nothing changes: zero, or NULL without a price."""
    return F.col("mtm") - F.col("mtm")


def unchanged_ret() -> Column:
    return F.try_divide(unchanged_pnl(), F.col("mtm"))


def listed(intervals: DataFrame, lo: Column, hi: Column, more: list[str] | None = None) -> DataFrame:
    """One row per step from `lo` to `hi`, which lie in the interval; none where `lo` is beyond `hi`.

    What differs at the interval's first step is in `change`, NULL at others, to keep the many
    copied rows narrow. `more` columns go along.
    """
    change = F.struct("trade_cost_basis", "price_source", "pnl", "ret")
    held = intervals.select(
        *(more or []), *KEY, "step", lo.alias("_lo"), hi.alias("_hi"), "amount", "avgPrice", "price", "mtm",
        change.alias("change")).where(F.col("_lo") <= F.col("_hi"))
    # No interval leaves its block.
    rows = expand_steps(held, F.col("_lo"), F.col("_hi"), "at", None, KEY)
    own = F.col("at") == F.col("step")

    def changed(name: str, otherwise: Column) -> Column:
        return F.when(own, F.col(f"change.{name}")).otherwise(otherwise).alias(name)

    return rows.select(
        *(more or []), *KEY, F.col("at").alias("step"), "amount", "avgPrice", changed("trade_cost_basis", F.lit(0.0)),
        "price", changed("price_source", F.lit("last_mtm")), "mtm", changed("pnl", unchanged_pnl()),
        changed("ret", unchanged_ret()))


def every_step(intervals: DataFrame, grid: Grid) -> DataFrame:
    """One row per step of each interval; step 0 is the opening time itself."""
    return listed(intervals, F.greatest("step", F.lit(1)), F.col("until"))


def at_time(df: DataFrame, grid: Grid) -> DataFrame:
    """Replace the step number by its timestamp."""
    return df.join(grid.steps.select("step", F.col("ts").alias("timestamp")), "step").drop("step")


def roll_intervals(
    trades: DataFrame, prices: DataFrame, grid: Grid, opening: DataFrame | None = None
) -> DataFrame:
    """Equity positions by interval (see `marked_intervals`).

    `trades` is read twice (positions, and the spans in which prices matter): pass a written table.
    """
    rows = with_quotes(all_trades(trades, opening), quoted_steps(prices, grid))
    return marked_intervals(trade_states(rows, grid), grid)


def roll_positions(
    trades: DataFrame, prices: DataFrame, grid: Grid, opening: DataFrame | None = None
) -> DataFrame:
    """Equity positions at every grid step after the opening one."""
    intervals = roll_intervals(trades, prices, grid, opening)
    return at_time(every_step(intervals, grid), grid).select(*EQUITY.fieldNames())


def roll_amounts(trades: DataFrame, grid: Grid, opening: DataFrame | None = None) -> DataFrame:
    """Amount and average price only, without marks."""
    states = trade_states(with_quotes(all_trades(trades, opening), None), grid)
    held = states.select(
        *KEY, "step", "amount", avg_price().alias("avgPrice"), "cost", _until(grid))
    dense = expand_steps(held, F.col("step"), F.col("until"), "at", None, KEY).where(
        F.col("at") > 0).withColumn(
        "trade_cost_basis", F.when(F.col("at") == F.col("step"), F.col("cost")).otherwise(F.lit(0.0)))
    return at_time(dense.withColumn("step", F.col("at")), grid).select(
        "timestamp", "port", "ticker", "amount", "avgPrice", "trade_cost_basis")


def quoted_intervals(
    trades: DataFrame, prices: DataFrame, grid: Grid, opening: DataFrame | None = None
) -> DataFrame:
    """Amounts and average prices by interval `step` .. `until`, and the quote at exactly `step` as `price`.

    At the steps after it, an interval has no quote. The rows are those of `roll_amounts`: a quote
    neither marks a position nor makes an unknown amount a known one.
    """
    rows = all_trades(trades, opening)
    # Nothing is held from the last trade on only if what is left is known to be nothing.
    may_be_open = ~F.col("_left").eqNullSafe(0.0) | (F.col("step") <= F.col("_last"))
    marks = _marks(quoted_steps(prices, grid), _spans(rows), may_be_open, F.when(F.col("step") >= F.col("_known"), 0.0))
    states = trade_states(with_quotes(rows, None).unionByName(marks), grid)
    return states.where(F.col("traded") | ~F.col("amount").eqNullSafe(0.0)).select(
        *KEY, "step", _until(grid), "amount", avg_price().alias("avgPrice"),
        F.when(F.col("quote.step") == F.col("step"), F.col("quote.price")).alias("price"))


def quoted_every_step(intervals: DataFrame, otherwise: Column, grid: Grid) -> DataFrame:
    """One row per step of `quoted_intervals`; steps without a quote have `otherwise` as their price."""
    held = intervals.select(
        *KEY, "step", "until", "amount", "avgPrice", F.col("price").alias("quoted"), otherwise.alias("otherwise"))
    held = held.where(F.col("until") > 0)  # step 0 is the opening time itself
    rows = expand_steps(held, F.greatest("step", F.lit(1)), F.col("until"), "at", None, KEY)
    quoted = F.when(F.col("at") == F.col("step"), F.col("quoted"))
    return at_time(rows.select(
        F.col("at").alias("step"), *KEY, "amount", "avgPrice", F.coalesce(quoted, "otherwise").alias("price")), grid).select(
        "timestamp", "port", "ticker", "amount", "avgPrice", "price")


def held_at(trades: DataFrame, grid: Grid, step: int, opening: DataFrame | None = None) -> DataFrame:
    """(ticker, port, amount, avgPrice) of the positions open after a step."""
    states = trade_states(with_quotes(all_trades(trades, opening), None), grid)
    now = (F.col("step") <= step) & (F.col("next_step").isNull() | (F.col("next_step") > step))
    return states.where(now & (F.col("amount") != 0.0)).select(
        *KEY, "amount", avg_price().alias("avgPrice"))


def carry_full(previous: DataFrame, trades: DataFrame) -> DataFrame:
    """One step by itself: open positions full-joined with new trades."""
    kept = previous.where(F.col("amount") != 0.0).select(
        *KEY, F.col("amount").alias("amount_prev"), F.col("avgPrice").alias("avg_prev"))
    prev, dq = F.coalesce("amount_prev", F.lit(0.0)), F.coalesce("dq", F.lit(0.0))
    cost = F.coalesce("cost", F.lit(0.0))
    after = snap_flat(prev + dq)
    basis = prev * F.coalesce("avg_prev", F.lit(0.0)) + cost
    return kept.join(trades.select(*KEY, "dq", "cost"), KEY, "full").select(
        *KEY, prev.alias("amount_prev"), after.alias("amount"),
        F.coalesce(F.try_divide(basis, after), F.lit(0.0)).alias("avgPrice"),
        cost.alias("trade_cost_basis"))
