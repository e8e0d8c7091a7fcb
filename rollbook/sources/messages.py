"""JSON messages: decoding with quarantine, encoding, routing and admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.functions.times import from_stamp, to_stamp

JSON = "application/json"

# The one table whose events the portfolio takes, and its topic family.
PORTFOLIO_TABLES = ("us_equity",)
DATA_TOPIC = r"^data_csv\.[^.]+$"


def decode(messages: DataFrame, schema: T.StructType, body: str = "body",
           content_type: str = "content_type") -> DataFrame:
    """Add `msg` (the decoded struct) and `rejected` (a reason, NULL for good messages).

    Streams split the result on `rejected` into the data and a quarantine sink.
    """
    shape = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json(body, shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = messages.withColumn("_parsed", parsed)
    reason = (
        F.when(F.col(content_type).isNull() | (F.col(content_type) != JSON), "content type")
        .when(F.col("_parsed").isNull() | F.col("_parsed._bad").isNotNull(), "not json"))
    msg = F.struct(*[F.col(f"_parsed.{f.name}").alias(f.name) for f in schema.fields])
    return out.withColumn("rejected", reason).withColumn(
        "msg", F.when(F.col("rejected").isNull(), msg)).drop("_parsed")


def routed(topic: Column, pattern: str = DATA_TOPIC) -> Column:
    """Does a message on `topic` reach a listener bound to the pattern?"""
    return topic.rlike(pattern)


def admitted(table_name: Column, tickers: Column) -> Column:
    """Portfolio events: a known table and a list of tickers."""
    return table_name.isin(*PORTFOLIO_TABLES) & tickers.isNotNull()


def triggers(table_name: Column, tickers: Column, ticker: Column) -> Column:
    """Strategy events: the price table, with the strategy's ticker in the list."""
    return (table_name == "us_equity") & F.array_contains(tickers, ticker)


def data_events(prices: DataFrame, table_name: str = "us_equity") -> DataFrame:
    """One "new data" event per price time with its tickers."""
    stamped = prices.select(to_stamp(F.col("date")).alias("timestamp"), "ticker").distinct()
    return stamped.groupBy("timestamp").agg(
        F.array_sort(F.collect_list("ticker")).alias("tickers")
    ).select("timestamp", F.lit(table_name).alias("table_name"), "tickers",
             F.lit("new_data").alias("event"))


def encode(df: DataFrame, *columns: str) -> DataFrame:
    """One JSON text per row, with the fields in the given order."""
    return df.select(F.to_json(F.struct(*columns)).alias("body"))


def event_times(data_events: DataFrame | None, fill_events: DataFrame | None) -> DataFrame:
    """Distinct times named by admitted data events and by fill events."""
    frames = []
    if data_events is not None:
        frames.append(
            data_events.where(admitted(F.col("table_name"), F.col("tickers")))
            .select(from_stamp(F.col("timestamp")).alias("event_ts")))
    if fill_events is not None:
        frames.append(
            fill_events.select(F.explode("fill_timestamps").alias("t"))
            .select(from_stamp(F.col("t")).alias("event_ts")))
    times = frames[0]
    for frame in frames[1:]:
        times = times.union(frame)
    return times.where(F.col("event_ts").isNotNull()).distinct()


def event_coverage(held: DataFrame, events: DataFrame) -> DataFrame:
    """Per event (timestamp, tickers): does its list hold every held ticker?

    Listed held tickers are counted against the number held, so no (event, ticker) pair is
    formed for what is missing.
    """
    listed = events.select("timestamp", F.explode("tickers").alias("ticker")).distinct()
    hits = listed.join(held.select("ticker").distinct(), "ticker", "left_semi").groupBy(
        "timestamp").agg(F.count(F.lit(1)).alias("n_listed"))
    n_held = held.agg(F.count_distinct("ticker")).scalar()
    listed_held = F.coalesce("n_listed", F.lit(0))
    return (
        events.select("timestamp").distinct().join(hits, "timestamp", "left")
        .select("timestamp", listed_held.alias("n_listed"), n_held.alias("n_held"))
        .withColumn("complete", F.col("n_listed") == F.col("n_held")))


def missing_tickers(held: DataFrame, event_tickers: DataFrame) -> DataFrame:
    """Held tickers that one event does not list: the event fails when any is missing."""
    return held.select("ticker").distinct().join(
        event_tickers.select("ticker").distinct(), "ticker", "left_anti")


def newer_than(events: DataFrame, positions: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Events later than the last position."""
    return events.where(F.col("event_ts") > positions.agg(F.max(ts)).scalar())


def accepted(events: DataFrame, positions: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Events (event_ts, tickers) later than the last position that list every held ticker.

    What is held is read from the positions at their last time.
    """
    last = positions.agg(F.max(ts)).scalar()
    held = positions.where(F.col(ts) == last).select("ticker")
    new = newer_than(events, positions, ts)
    covered = event_coverage(held, new.select(F.col("event_ts").alias("timestamp"), "tickers"))
    return new.join(
        covered.where("complete").select(F.col("timestamp").alias("event_ts")), "event_ts",
        "left_semi")
