"""Time codes as column expressions. Times are seconds unless named _ms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number(text: Column) -> Column:
    """A decimal number's value, else null; 'nan', '1d' and the like are no numbers."""
    t = F.trim(text)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def _clock(total_units: Column, per_second: int):
    seconds = F.floor(total_units / per_second)
    return F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60), F.pmod(seconds, F.lit(60)), F.pmod(total_units, F.lit(per_second))


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm from whole milliseconds; negatives are 0."""
    h, m, s, f = _clock(F.greatest(F.lit(0), ms).cast("long"), 1000)
    return F.format_string("%02d:%02d:%02d,%03d", h, m, s, f)


def seconds_to_timestamp(seconds: Column) -> Column:
    """HH:MM:SS.mmm; milliseconds are rounded by themselves, so .9996 prints .1000."""
    t = F.greatest(F.lit(0.0), seconds)
    whole = F.floor(t)
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60), F.pmod(whole, F.lit(60)), F.bround((t - whole) * 1000).cast("long"))


def ass_time(ms: Column) -> Column:
    """H:MM:SS.cc from whole milliseconds, half a hundredth to even; negatives are 0."""
    h, m, s, f = _clock(F.bround(F.greatest(F.lit(0), ms) / 10).cast("long"), 100)
    return F.format_string("%d:%02d:%02d.%02d", h, m, s, f)


def parse_clock_ms(text: Column) -> Column:
    """Milliseconds of [H:]MM:SS[.fff] with '.' or ','; null for anything else."""
    p = F.split(F.regexp_replace(F.trim(text), ",", "."), ":")
    n = F.size(p)
    sec = F.when(n == 3, number(p[2])).otherwise(number(p[1]))
    whole = lambda c: F.when(F.trim(c).rlike(r"^\d+$"), F.trim(c).try_cast("long"))
    minutes = F.when(n == 3, whole(p[1])).otherwise(whole(p[0]))
    hours = F.when(n == 3, whole(p[0])).otherwise(F.lit(0))
    return F.when((n == 2) | (n == 3), F.bround((hours * 3600 + minutes * 60 + sec) * 1000).cast("long"))


def timestamp_to_seconds(text: Column) -> Column:
    """A number as it is, mm:ss or hh:mm:ss as seconds, else null."""
    return F.coalesce(number(text), parse_clock_ms(text) / 1000.0)


def mmss_number_to_seconds(value: Column, chunk_start: Column, chunk_end: Column) -> Column:
    """minute.second shorthand (15.01 is 15:01) where the chunk starts late enough for the value to be none of its seconds."""
    minutes = F.floor(value)
    seconds = F.bround((value - minutes) * 100, 3)
    read = minutes * 60 + seconds
    fits = (chunk_start >= 300) & (value < F.greatest(F.lit(120.0), chunk_start - 120)) & (seconds >= 0) & (seconds < 60) & read.between(chunk_start - 180, chunk_end + 180)
    return F.when(fits, read).otherwise(value)


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap over the shorter length; 0 for empty intervals."""
    inter = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))
    short = F.least(a1 - a0, b1 - b0)
    return F.when(short > 0, inter / short).otherwise(F.lit(0.0))


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap over union; 0 for empty intervals."""
    inter = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))
    union = F.greatest(F.lit(0), a1 - a0) + F.greatest(F.lit(0), b1 - b0) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def rms_db(rms: Column) -> Column:
    return 20 * F.log10(rms + F.lit(1e-9))


def env_db(env: Column) -> Column:
    return 20 * F.log10(F.greatest(env, F.lit(1e-8)))
