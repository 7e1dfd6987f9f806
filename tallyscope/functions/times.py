"""Instants: text with a mandatory zone in, UTC timestamps and exact second differences out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted time texts. The strict form needs seconds, at most six fraction digits and a bounded offset.
STRICT_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)\z"
ZONED_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]([01]\d|2[0-3]):?[0-5]\d)\z"
SECONDS_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})\z"


def _instant(text: Column) -> Column:
    """Parse text ending in Z or +hh:mm. Java caps offsets at 18 hours, so the zone is arithmetic."""
    utc = F.endswith(text, F.lit("Z"))
    zone = F.right(text, F.lit(6))
    minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int")
    offset = F.when(utc, 0).when(F.startswith(zone, F.lit("-")), -minutes).otherwise(minutes)
    body = F.left(text, F.length(text) - F.when(utc, 1).otherwise(6))
    local = F.try_to_timestamp(F.concat(body, F.lit("Z")))
    return F.timestamp_micros(F.unix_micros(local) - offset.cast("bigint") * F.lit(60_000_000))


def strict_instant(text: Column) -> Column:
    """ISO text with seconds, up to six fraction digits and a valid offset, else null."""
    return F.when(text.rlike(STRICT_TIME), _instant(text))


def zoned_instant(text: Column) -> Column:
    """ISO date and time with a zone; seconds are optional. A text without a zone is null."""
    with_colon = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    with_colon = F.regexp_replace(with_colon, r"(T\d{2}:\d{2})(Z|[+-])", "$1:00$2")
    return F.when(text.rlike(ZONED_TIME), _instant(with_colon))


def seconds_instant(text: Column) -> Column:
    """ISO text with seconds and any fraction length, used for post and counter clocks."""
    # Digits beyond microseconds are dropped, as a microsecond clock does.
    micro = F.regexp_replace(text, r"(\.\d{6})\d+", "$1")
    return F.when(text.rlike(SECONDS_TIME), _instant(micro))


def micros(instant: Column) -> Column:
    return F.unix_micros(instant)


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds as a double, exact to the microsecond."""
    return (micros(end) - micros(start)) / F.lit(1e6)


def midpoint(start: Column, end: Column) -> Column:
    return F.timestamp_micros(micros(start) + F.floor((micros(end) - micros(start)) / 2))


def utc_text(instant: Column, digits: int = 6) -> Column:
    """Render an instant in UTC whatever the session zone is; digits is 0, 3 or 6."""
    us = micros(instant)
    whole = F.floor(us / F.lit(1_000_000)).cast("bigint")
    days = F.floor(whole / F.lit(86_400)).cast("int")
    rest = whole - days.cast("bigint") * 86_400
    clock = F.format_string(
        "%02d:%02d:%02d",
        F.floor(rest / 3600).cast("int"),
        F.floor(F.pmod(rest, F.lit(3600)) / 60).cast("int"),
        F.pmod(rest, F.lit(60)).cast("int"),
    )
    text = F.concat(F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string"), F.lit("T"), clock)
    if digits:
        fraction = F.floor(F.pmod(us, F.lit(1_000_000)) / F.lit(10 ** (6 - digits))).cast("bigint")
        text = F.concat(text, F.lit("."), F.lpad(fraction.cast("string"), digits, "0"))
    return F.when(instant.isNotNull(), F.concat(text, F.lit("Z")))
