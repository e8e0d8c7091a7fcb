"""Fill matching on two streams, placed orders and broker fills, whatever their order of arrival.

A desk keeps for each leg (broker's order id, client, security) its order, the shares filled so far and
the fills that wait. A fill may come before its order. When the shares add up to the order's, all
its fills are released in that batch as fill-record rows, once. Nothing is dropped: a fill that comes
for an order already released is handed on as `over`, and what is still waiting when `keep` has passed
since a leg was first heard of (orders are good for a day) is handed on as `expired`, its order too
where no fill came. There is no watermark; time here is that of the machine.

A batch is matched as a whole: its rows and the legs kept by the batch before are grouped by leg, and
the fills join what became of their leg. What is kept is written anew by each batch, so a batch that is
run again starts from the same state. No leg's fills meet in one task's memory.

An order told again is the same order. Shares are whole numbers, so sums do not depend on arrival.
"""

from __future__ import annotations

import datetime as dt
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rollbook.operators import orders as order_flow
from rollbook.operators.execution import LEG, confirmations, open_orders
from rollbook.schemas import FILLS, conform
from rollbook.sources import messages
from rollbook.streaming.portfolio import batch_name

FILLED, OVER, EXPIRED = "filled", "over", "expired"
KEEP = dt.timedelta(days=1)

_ORDER = ["sessionId", "api_client", "secType", "orderType", "side", "totalQty", "order_itag", "placed_timestamp"]
_FILL = ["fill_timestamp", "avgPrice", "commission", "tradeQty"]
_TYPES = {f.name: f.dataType for f in FILLS}
# Kinds of rows in a batch; a pulse only lets time pass.
_PLACED, _FILL_ROW, _PULSE = "order", "fill", "pulse"


def _struct(names: list[str]) -> Column:
    return F.struct(*[F.col(c).cast(_TYPES[c]).alias(c) for c in names])


def _none(names: list[str]) -> Column:
    return F.lit(None).cast("struct<" + ",".join(f"{c}:{_TYPES[c].simpleString()}" for c in names) + ">")


def _leg() -> list[Column]:
    return [F.col(c).cast(_TYPES[c]).alias(c) for c in LEG]


def offered(orders: DataFrame, fills: DataFrame, client: str = "IB") -> DataFrame:
    """Both streams as one: the leg, `kind`, and an `order` or a `fill`.

    `orders` are order-record rows, of which the open ones of `client` count; `fills` flat broker fills.
    A pulse a second lets the legs of silent streams expire.
    """
    placed = open_orders(orders, client).select(
        *_leg(), F.lit(_PLACED).alias("kind"), _struct(_ORDER).alias("order"), _none(_FILL).alias("fill"))
    filled = fills.select(
        *_leg(), F.lit(_FILL_ROW).alias("kind"), _none(_ORDER).alias("order"), _struct(_FILL).alias("fill"))
    both = placed.unionByName(filled)
    if not both.isStreaming:
        return both
    pulse = orders.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load().select(
        *[F.lit(None).cast(_TYPES[c]).alias(c) for c in LEG], F.lit(_PULSE).alias("kind"),
        _none(_ORDER).alias("order"), _none(_FILL).alias("fill"))
    return both.unionByName(pulse)


def match_legs(kept: DataFrame, waiting: DataFrame, batch: DataFrame, now_ms: int, keep_ms: int) -> DataFrame:
    """What becomes of each leg in a batch.

    `kept` are the legs of the batch before (as returned here), `waiting` its fills (leg, fill). Comes out:
    the leg's order, shares filled and `until` when it is kept; `was_done` says that it was released in
    an earlier batch, `done` that it is now, `expired` that its time is over.
    """
    n = F.lit(0).cast("long")
    some = kept.select(*LEG, "order", "done", "until", "filled", n.alias("waits"), F.lit(False).alias("heard"))
    some = some.unionByName(waiting.select(
        *LEG, _none(_ORDER).alias("order"), F.lit(False).alias("done"), F.lit(None).cast("long").alias("until"),
        F.lit(0.0).alias("filled"), F.lit(1).cast("long").alias("waits"), F.lit(False).alias("heard")))
    is_fill = F.col("kind") == _FILL_ROW
    some = some.unionByName(batch.select(
        *LEG, "order", F.lit(False).alias("done"), F.lit(None).cast("long").alias("until"),
        F.when(is_fill, F.coalesce("fill.tradeQty", F.lit(0.0))).otherwise(0.0).alias("filled"),
        F.when(is_fill, 1).otherwise(0).cast("long").alias("waits"), F.lit(True).alias("heard")))
    # The order known before stays; of several told in one batch any is the same.
    held = F.when(F.col("order").isNotNull(), F.struct((~F.col("heard")).alias("before"), "order"))
    legs = some.groupBy(*LEG).agg(
        F.max(held).alias("order"), F.max("done").alias("was_done"), F.max("until").alias("until"),
        F.sum("filled").alias("filled"), F.sum("waits").alias("waits"), F.max("heard").alias("heard"))
    known = F.col("order").isNotNull()
    full = known & (F.col("waits") > 0) & (F.col("filled") == F.col("order.totalQty"))
    return legs.withColumn("order", F.col("order.order")).select(
        *LEG, "order", "was_done", (F.col("was_done") | F.coalesce(full, F.lit(False))).alias("done"),
        F.coalesce("until", F.lit(now_ms + keep_ms)).alias("until"), "filled", "waits",
        (~F.col("heard") & (F.col("until") <= now_ms)).alias("expired"))


def match_fills_of(legs: DataFrame, waiting: DataFrame, batch: DataFrame) -> DataFrame:
    """The waiting fills and those of the batch with their leg's order and `event`, NULL while they wait."""
    fills = waiting.select(*LEG, "fill").unionByName(batch.where(F.col("kind") == _FILL_ROW).select(*LEG, "fill"))
    named = legs.select(*[F.col(c).alias(f"_{c}") for c in LEG], "order", "was_done", "done", "expired")
    same = F.lit(True)
    for c in LEG:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    event = F.when(F.col("was_done"), OVER).when(F.col("done"), FILLED).when(F.col("expired"), EXPIRED)
    return fills.join(named, same).select(event.alias("event"), *LEG, "order", "fill")


def _records(rows: DataFrame) -> DataFrame:
    return rows.select("event", *LEG, "order.*", "fill.*").select("event", *FILLS.fieldNames())


@dataclass(frozen=True)
class Desk:
    """Folders of what matching leaves: every event, log rows and confirmations to send.

    Each batch writes its own folder; one that is run again writes the same rows there again. `state`
    holds what the last two batches kept.
    """

    path: str

    def _read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")

    def events(self, spark: SparkSession, event: str = FILLED) -> DataFrame:
        """Fill-record rows of one kind of event."""
        return conform(self._read(spark, "events").where(F.col("event") == event), FILLS)

    def log(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "log").drop("batch")

    def sent(self, spark: SparkSession) -> DataFrame:
        """Encoded confirmations, one per order."""
        return spark.read.schema("value string").text(f"{self.path}/outbox")

    def _state(self, batch: DataFrame, batch_id: int) -> str:
        return f"{self.path}/state/batch={batch_name(batch, batch_id)}"

    def match(self, batch: DataFrame, batch_id: int, keep: dt.timedelta = KEEP) -> None:
        """One batch of `offered` rows: matched with what the batch before kept, and its events taken."""
        spark, now = batch.sparkSession, int(time.time() * 1000)
        batch = batch.where(F.col("kind") != _PULSE)
        here, last, older = (self._state(batch, batch_id - i) for i in range(3))
        fs = spark._jvm.org.apache.hadoop.fs
        folder = fs.Path(last)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        waiting = batch.where(F.lit(False)).select(*LEG, "fill")
        kept = batch.where(F.lit(False)).select(
            *LEG, "order", F.lit(False).alias("done"), F.lit(0).cast("long").alias("until"), F.lit(0.0).alias("filled"))
        if batch_id > 0 and files.exists(folder):
            waiting = spark.read.schema(waiting.schema).parquet(f"{last}/waiting")
            kept = spark.read.schema(f"{kept._jdf.schema().toDDL()}, expired boolean").parquet(f"{last}/legs").where(
                ~F.col("expired")).drop("expired")
        legs = match_legs(kept, waiting, batch, now, int(keep / dt.timedelta(milliseconds=1)))
        legs.write.mode("overwrite").parquet(f"{here}/legs")
        legs = spark.read.schema(legs.schema).parquet(f"{here}/legs")
        fills = match_fills_of(legs, waiting, batch)
        silent = legs.where(F.col("expired") & ~F.col("done") & (F.col("waits") == 0) & F.col("order").isNotNull())
        self.take(_records(fills.where(F.col("event").isNotNull())).unionByName(_records(silent.select(
            F.lit(EXPIRED).alias("event"), *LEG, "order", _none(_FILL).alias("fill")))), batch_id)
        fills.where(F.col("event").isNull()).select(*LEG, "fill").write.mode("overwrite").parquet(f"{here}/waiting")
        if batch_id > 1:  # a batch that is run again needs no more than the one before it
            files.delete(fs.Path(older), True)

    def take(self, batch: DataFrame, batch_id: int) -> None:
        """One batch of events: kept, then logged and confirmed from what was kept."""
        name = f"batch={batch_name(batch, batch_id)}"
        batch.write.mode("overwrite").parquet(f"{self.path}/events/{name}")
        kept = batch.sparkSession.read.schema(batch.schema).parquet(f"{self.path}/events/{name}")
        done = confirmations(kept.where(F.col("event") == FILLED))
        log = order_flow.confirmation_log(done, F.localtimestamp())
        log.write.mode("overwrite").parquet(f"{self.path}/log/{name}")
        sent = messages.encode(done, "order_itag", "sessionId", "fill_timestamps")
        sent.write.mode("overwrite").text(f"{self.path}/outbox/{name}")


def start_matching(
    desk: Desk, orders: DataFrame, fills: DataFrame, checkpoint: str, every: str | None = "10 seconds",
    client: str = "IB", keep: dt.timedelta = KEEP,
) -> StreamingQuery:
    """Match as fills come in; with `every=None`, what is available now and then stop.

    A timed query looks at every pulse for what has expired, the other one in each of its batches.
    """
    writer = offered(orders, fills, client).writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: desk.match(batch, batch_id, keep))
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.start()
