"""Column macros over numbers, dates and JSON that models or logs have written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_code_fence


def safe_float(text: Column) -> Column:
    return text.try_cast("double")


def finite(x: Column) -> Column:
    """The number, or null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def finite_rounded(x: Column, digits: int = 4) -> Column:
    return rounded(finite(x), digits)


def rounded(x: Column, digits: int = 6) -> Column:
    """Half up in binary, the same in every engine."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def loose_json(text: Column) -> Column:
    """The JSON text that a reply holds: all of it, the inside of its fence, or from the first { to the last }; else null."""
    bare = strip_code_fence(text)
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    sound = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(sound(bare), sound(F.nullif(inner, F.lit(""))))


def confidence(text: Column) -> Column:
    """A number from 0 to 1, else null."""
    x = safe_float(text)
    return F.when(x.between(0.0, 1.0), x)


def clamped_grade(text: Column) -> Column:
    """A grade from 1 to 5, rounded half to even; 1 where there is no number."""
    return F.coalesce(F.least(F.lit(5), F.greatest(F.lit(1), F.bround(safe_float(text)).cast("int"))), F.lit(1))


def inner_error(text: Column) -> Column:
    """The innermost message of an error that is JSON within JSON; the text itself if it is neither."""
    outer = F.get_json_object(text, "$.error.message")
    return F.coalesce(F.get_json_object(outer, "$.error.message"), outer, text)


def wall_seconds(start: Column, end: Column) -> Column:
    """Seconds between two timestamps, never under 0; 0 where one is missing."""
    return F.coalesce(F.greatest(F.lit(0.0), (F.unix_micros(end) - F.unix_micros(start)) / 1e6), F.lit(0.0))


def score_band(x: Column) -> Column:
    return F.when(x >= 0.8, "best").when(x >= 0.7, "good").when(x >= 0.6, "fair").when(x >= 0.45, "poor").otherwise("bad")


def percent_text(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x), "–").otherwise(F.concat(F.floor(x * 100 + 0.5).cast("string"), F.lit("%")))


def age_text(then: Column, now: Column) -> Column:
    """``just now``, minutes, hours or days ago, else the day and month."""
    seconds = (F.unix_micros(now) - F.unix_micros(then)) / 1e6
    half_up = lambda x: F.floor(x + 0.5).cast("string")
    return (
        F.when(then.isNull(), "")
        .when(seconds < 60, "just now")
        .when(seconds < 3600, F.concat(half_up(seconds / 60), F.lit("m ago")))
        .when(seconds < 86400, F.concat(half_up(seconds / 3600), F.lit("h ago")))
        .when(seconds < 30 * 86400, F.concat(half_up(seconds / 86400), F.lit("d ago")))
        .otherwise(F.date_format(then, "d MMM"))
    )


def run_name_parts(name: Column) -> Column:
    """(number, label, short) of run names like ``r07_longer_answers``; short is the last ten characters of other names."""
    number, label = F.regexp_extract(name, r"^r(\d+)_(.*)$", 1), F.regexp_extract(name, r"^r(\d+)_(.*)$", 2)
    fits = number != ""
    return F.struct(
        F.when(fits, number.try_cast("int")).alias("number"),
        F.when(fits, label).otherwise(name).alias("label"),
        F.when(fits, F.concat(F.lit("#"), number)).otherwise(F.right(name, F.lit(10))).alias("short"),
    )
