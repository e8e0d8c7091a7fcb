"""Price files: checks, readers, stacking and conforming."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.functions.ranking import latest_per_key
from rollbook.functions.times import MARKET_ZONE, instant_in_zone, millis
from rollbook.schemas import PRICES, conform

CSV_TIME = "yyyy-MM-dd HH:mm:ss[XXX][XX]"


class ManifestError(ValueError):
    """A price file cannot be taken in."""


@dataclass(frozen=True)
class PriceFile:
    ticker: str
    path: str

    @property
    def kind(self) -> str:
        for kind in ("parquet", "csv"):
            if kind in self.path:
                return kind
        raise ManifestError(f"extension not recognized: {self.path}")


def check_manifest(files: Sequence[PriceFile]) -> None:
    """Each path names its ticker and has a known format."""
    for f in files:
        if f.ticker.lower() not in f.path.lower():
            raise ManifestError(f"ticker {f.ticker} is not in path {f.path}")
        _ = f.kind


def check_fields(df: DataFrame, required: Sequence[str], path: str) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ManifestError(f"fields missing in {path}: {missing}")


def csv_wall_clock(text: Column) -> Column:
    """New York wall clock of a time text with offset."""
    return millis(instant_in_zone(F.to_timestamp(text, CSV_TIME), MARKET_ZONE))


def zoned_wall_clock(df: DataFrame, column: str, zone: str = MARKET_ZONE) -> Column:
    """The wall clock a zoned file column shows; naive columns keep theirs."""
    if df.schema[column].dataType == T.TimestampType():
        return millis(instant_in_zone(F.col(column), zone))
    return millis(F.col(column))


#: When a row's file was written: of rows for one time and ticker the latest load counts.
LOADED = "loaded"


def _loaded() -> Column:
    return F.col("_metadata.file_modification_time").alias(LOADED)


def read_parquet_prices(
    spark: SparkSession, paths: Sequence[str], ticker: str, fields: Sequence[str] = ("close",),
    zone: str = MARKET_ZONE,
) -> DataFrame:
    df = spark.read.parquet(*paths)
    check_fields(df, ["date", *fields], str(paths))
    return df.select(
        zoned_wall_clock(df, "date", zone).alias("date"),
        *[F.col(c).cast("double").alias(c) for c in fields], F.lit(ticker).alias("ticker"), _loaded())


def csv_headers(spark: SparkSession, paths: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """The files below the paths by their header; only first lines are read."""
    found: dict[tuple[str, ...], list[str]] = {}
    for path in spark.read.text(list(paths)).inputFiles():
        header = tuple(spark.read.option("header", True).csv(path).columns)
        found.setdefault(header, []).append(path)
    return found


def read_csv_prices(
    spark: SparkSession, paths: Sequence[str], ticker: str, fields: Sequence[str] = ("close",)
) -> DataFrame:
    """Columns are taken by name, whatever their order in each file: one scan for each header."""
    frames = []
    for files in csv_headers(spark, paths).values():
        df = spark.read.option("header", True).csv(files)
        check_fields(df, ["date", *fields], str(files))
        frames.append(df.select(
            csv_wall_clock(F.col("date")).alias("date"),
            *[F.col(c).cast("double").alias(c) for c in fields], F.lit(ticker).alias("ticker"), _loaded()))
    return _union(frames)


def read_mapped_csv(
    spark: SparkSession, path: str, columns: Mapping[str, str], types: Mapping[str, str]
) -> DataFrame:
    """Project a CSV to table columns: `columns` maps table name to file name."""
    df = spark.read.option("header", True).csv(path)
    check_fields(df, list(columns.values()), path)
    return df.select(*[
        F.col(src).cast(types.get(name, "string")).alias(name) for name, src in columns.items()])


def read_price_files(
    spark: SparkSession, files: Sequence[PriceFile], fields: Sequence[str] = ("close",)
) -> DataFrame:
    """All files stacked, the latest load per (date, ticker); greater values settle ties.

    One scan per ticker and format, and per header of CSV files.
    """
    check_manifest(files)
    groups: dict[tuple[str, str], list[str]] = {}
    for f in files:
        groups.setdefault((f.ticker, f.kind), []).append(f.path)
    readers = {"parquet": read_parquet_prices, "csv": read_csv_prices}
    frames = [
        readers[kind](spark, paths, ticker, fields) for (ticker, kind), paths in groups.items()]
    return stack(frames, [LOADED, *fields]).drop(LOADED)


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame)
    return stacked


def manifest_report(spark: SparkSession, files: Sequence[PriceFile], fields: Sequence[str] = ("close",)) -> DataFrame:
    """One row per file: is the ticker in the path, which format, and which fields are missing."""
    rows = []
    for f in files:
        try:
            kind, fault = f.kind, None
            df = spark.read.parquet(f.path) if kind == "parquet" else spark.read.option("header", True).csv(f.path)
            missing = [c for c in ("date", *fields) if c not in df.columns]
        except ManifestError:
            kind, missing, fault = None, [], "format"
        if f.ticker.lower() not in f.path.lower():
            fault = "ticker"
        rows.append((f.ticker, kind, ",".join(missing), fault or ("fields" if missing else None)))
    return spark.createDataFrame(rows, "ticker string, kind string, missing string, fault string")


def stack(frames: Sequence[DataFrame], order: Sequence[str]) -> DataFrame:
    """Union by name, keeping the greatest `order` per (date, ticker)."""
    return latest_per_key(_union(frames), ["date", "ticker"], order)


def conform_prices(data: DataFrame, write_time: Column, price: str = "close") -> DataFrame:
    """Incoming rows as price-table rows: close becomes price, stamped with the write time."""
    return conform(
        data.withColumnRenamed(price, "price").withColumn("timestamp_write", write_time), PRICES)


