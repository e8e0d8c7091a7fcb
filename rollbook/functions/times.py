"""Wall-clock timestamps: parsing, zone shifts and message stamps."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = "yyyyMMddHHmmss"
MARKET_ZONE = "America/New_York"
DESK_ZONE = "America/Lima"


def ntz(value: dt.datetime) -> Column:
    """A wall-clock literal."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def to_stamp(ts: Column) -> Column:
    """Second-precision text used in messages."""
    return F.date_format(ts, STAMP)


def from_stamp(text: Column) -> Column:
    """Wall-clock time of a message stamp; NULL when the text is not one."""
    iso = F.regexp_replace(
        text, r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1-$2-$3 $4:$5:$6")
    return F.when(text.rlike(r"^\d{14}$"), iso.try_cast("timestamp_ntz"))


def instant_in_zone(ts: Column, zone: str) -> Column:
    """Wall clock of an instant in `zone`, whatever zone the session shows."""
    seconds = (F.unix_micros(ts).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return utc_in_zone(epoch + F.make_dt_interval(secs=seconds), zone)


def utc_in_zone(ts_ntz: Column, zone: str) -> Column:
    """Wall clock in `zone` of a UTC wall clock."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts_ntz)


def instant_of_utc(ts_ntz: Column) -> Column:
    """The instant a UTC wall clock names."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts_ntz).cast("timestamp")


def millis(ts: Column) -> Column:
    """Truncate to the stored millisecond."""
    return F.date_trunc("MILLISECOND", ts).cast("timestamp_ntz")


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a wall clock, independent of the session zone."""
    return (
        F.unix_date(ts.cast("date")).cast("long") * F.lit(86_400)
        + F.hour(ts) * F.lit(3_600) + F.minute(ts) * F.lit(60) + F.second(ts))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a wall clock, independent of the session zone."""
    fraction = F.extract(F.lit("SECOND"), ts) % F.lit(1)
    return seconds(ts) * F.lit(1_000_000) + (fraction * F.lit(1_000_000)).cast("long")
