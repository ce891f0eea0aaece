"""Time text to numbers."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

OFFSET = "(Z|z|[+-][0-9]{2}:?[0-9]{2})$"


def iso_ms(text) -> Column:
    """ISO-8601 text with an explicit offset to epoch milliseconds; null without an offset or when malformed."""
    c = col(text)
    us = F.unix_micros(F.try_to_timestamp(c))
    return F.when(c.rlike(OFFSET) & c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]"), us / 1000.0)


def decimal_ns(text) -> Column:
    """Decimal seconds (text) to exact integer nanoseconds; null when negative or not finite."""
    d = F.try_cast(col(text), "decimal(28,9)") if hasattr(F, "try_cast") else col(text).try_cast("decimal(28,9)")
    return F.when(d >= 0, (d * F.lit(1_000_000_000).cast("decimal(10,0)")).cast("long"))


def syslog_seconds(stamp, year: int) -> Column:
    """'Mon dd HH:MM:SS' plus a supplied year, read as UTC, to epoch seconds."""
    text = F.concat(F.lit(f"{year} "), F.regexp_replace(F.trim(col(stamp)), " +", " "))
    return F.floor(F.unix_micros(F.try_to_timestamp(text, F.lit("yyyy MMM d HH:mm:ss"))) / 1_000_000).cast("long")


def sample_day(value) -> Column:
    """Eight-digit (19../20..) or six-digit day prefix to ISO date text, null when it is no date."""
    c = F.coalesce(col(value).cast("string"), F.lit(""))
    century = c.rlike("^(19|20)")
    six = F.substring(c, 1, 6)
    yy = F.substring(six, 1, 2)
    # Two-digit years: 69-99 are 19xx, 00-68 are 20xx.
    full = F.when(century, F.substring(c, 1, 8)).otherwise(F.concat(F.when(yy >= "69", "19").otherwise("20"), six))
    day = F.when(full.rlike("^[0-9]{8}$"), F.to_date(F.try_to_timestamp(full, F.lit("yyyyMMdd"))))
    return F.date_format(day, "yyyy-MM-dd")
