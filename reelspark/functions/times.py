"""Times: microseconds from stream starts, durations, hours and the paths of slices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_microseconds(seconds: Column) -> Column:
    """Seconds as microseconds, halves up, by the decimal digits that the number prints with."""
    return F.round(seconds.cast("string").cast("decimal(38,18)") * 1_000_000, 0).cast("long")


def duration_microseconds(seconds: float) -> int:
    """A setting in seconds as microseconds, halves to even."""
    return round(seconds * 1_000_000)


def duration_us(seconds: Column) -> Column:
    return F.bround(seconds * 1_000_000).cast("long")


def clock(seconds: Column) -> Column:
    """HH:MM:SS.mmm, halves to even, hours without bound."""
    ms = F.bround(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.expr("0L") + F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def hour_start(moment: Column) -> Column:
    return F.date_trunc("HOUR", moment)


def seconds_to_next_hour(moment: Column) -> Column:
    """Whole seconds until the next UTC hour, one at least."""
    micros = F.unix_micros(moment)
    return F.greatest(F.lit(1), F.floor((3_600_000_000 - F.pmod(micros, F.lit(3_600_000_000))) / 1_000_000)).cast("long")


def slice_path(slug: Column, camera: Column, moment: Column) -> Column:
    """Where the slice that starts at a moment goes, under the recording root."""
    start = hour_start(moment)
    name = F.concat(F.date_format(start, "yyyy-MM-dd'T'HH'-00-00Z__start-'"), F.date_format(moment, "HH-mm-ss-SSSSSS'Z.mkv'"))
    return F.concat_ws("/", slug, F.lit("cameras"), camera, F.date_format(start, "yyyy"), F.date_format(start, "MM"), F.date_format(start, "dd"), name)


def retry_delay(header: Column, attempt: Column) -> Column:
    """Seconds before a retry: a numeric Retry-After if there is one, else 2 to the attempt, 30 at most."""
    stated = header.try_cast("double")
    return F.when(stated.isNotNull(), F.greatest(F.lit(0.0), stated)).otherwise(F.least(F.lit(30.0), F.pow(F.lit(2.0), attempt)))
