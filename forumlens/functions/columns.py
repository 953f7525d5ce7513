"""Column expressions shared by the operators. All run inside the JVM."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlens.fixed import APP_ZONE

# Every character Python's str.strip() removes, by rule.
WHITESPACE = "".join(chr(n) for n in range(0x3001) if chr(n).isspace())


def text_or_null(df: DataFrame, name: str) -> Column:
    """The named column, or NULL where the frame does not have it."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def strip(value: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.btrim(value, F.lit(WHITESPACE))


def present(value: Column) -> Column:
    """True for an id that is not blank, NULL for NULL.

    As a filter both drop the row, and the scan can skip the NULLs.
    """
    return strip(value) != ""


def first_text(*values: Column) -> Column:
    """The first value that is neither NULL nor empty, else ''."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def to_int(value: Column) -> Column:
    """Whole number from text: decimals are rounded, junk becomes NULL."""
    return F.round(value.try_cast("double")).try_cast("int")


def to_time(value: Column) -> Column:
    """UTC wall-clock time from ISO text; text without an offset means UTC.

    The cast goes through ``timestamp`` so that an offset is applied; a direct
    cast to ``timestamp_ntz`` would drop it. In a session that is not in UTC
    the result would be shifted, so that is refused.
    """
    zone = SparkSession.active().conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"set spark.sql.session.timeZone to UTC, it is {zone}")
    return value.try_cast("timestamp").cast("timestamp_ntz")


def iso_time(moment: Column) -> Column:
    """ISO text with a UTC offset; microseconds only when there are any."""
    micros = F.date_format(moment, "SSSSSS")
    return F.concat(
        F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)),
        F.lit("+00:00"),
    )


def week_start(moment: Column) -> Column:
    """Monday 00:00 of the week, again without a zone."""
    return F.date_trunc("week", moment).cast("timestamp_ntz")


def days_between(later: Column, earlier: Column) -> Column:
    """Exact difference in days as a double."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros.cast("double") / F.lit(86_400_000_000.0)


def local_day_bounds(start: date, end: date, zone: str = APP_ZONE) -> tuple[Column, Column]:
    """UTC bounds of whole local days: first 00:00:00 and last 23:59:59.

    The end bound is the last full second, so a row in the last fraction of a
    second of the day is outside.
    """
    def utc(day: date, clock: str) -> Column:
        wall = F.lit(f"{day.isoformat()} {clock}").cast("timestamp_ntz")
        return F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)

    return utc(start, "00:00:00"), utc(end, "23:59:59")


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole with one decimal; 0.0 when there is nothing."""
    share = F.lit(100.0) * part / F.nullif(whole, F.lit(0))
    return F.coalesce(F.round(share, 1), F.lit(0.0))


def clamp01(value: Column, default: float) -> Column:
    """A number limited to [0, 1]; text that is no number gets the default."""
    number = F.coalesce(value.try_cast("double"), F.lit(default))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))


def absolute_link(value: Column, site: str) -> Column:
    """Put the site in front of links that start with '/'."""
    text = F.coalesce(value, F.lit(""))
    return F.when(text.startswith("/"), F.concat(F.lit(site), text)).otherwise(text)


def without_slash(value: Column) -> Column:
    """Drop every '/' at the end."""
    return F.rtrim(value, F.lit("/"))


def url_host(value: Column) -> Column:
    """Host part of a URL with port and user info, or ''."""
    return F.regexp_extract(value, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def l2_norm(vector: Column) -> Column:
    """Length of a vector."""
    squares = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)
