"""Clock texts as column expressions: strict and lenient parsing, half-even formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def caption_clock(centiseconds: Column) -> Column:
    """``H:MM:SS.cc`` of a whole number of centiseconds, never below zero."""
    cs = F.greatest(centiseconds.cast("long"), F.lit(0).cast("long"))
    return F.format_string(
        "%d:%02d:%02d.%02d",
        F.floor(cs / 360000).cast("long"),
        F.floor(cs % 360000 / 6000).cast("long"),
        F.floor(cs % 6000 / 100).cast("long"),
        cs % 100,
    )


def centiseconds(seconds: Column) -> Column:
    """Seconds to centiseconds, half to even."""
    return F.rint(seconds * 100).cast("long")


def lyric_clock(token: Column) -> Column:
    """Seconds of ``mm:ss`` with one to three fraction digits; null when malformed."""
    shape = r"^([0-9]+):([0-9]+)(?:\.([0-9]{1,3}))?$"
    seconds = F.regexp_extract(token, shape, 2).try_cast("double")
    digits = F.regexp_extract(token, shape, 3)
    fraction = F.when(digits == "", F.lit(0.0)).otherwise(
        digits.try_cast("double") / F.element_at(F.array(F.lit(10.0), F.lit(100.0), F.lit(1000.0)), F.greatest(F.length(digits), F.lit(1)))
    )
    return F.when(
        F.regexp_like(token, F.lit(shape)) & (seconds < 60),
        F.regexp_extract(token, shape, 1).try_cast("double") * 60 + (seconds + fraction),
    )


def strict_caption_clock(token: Column) -> Column:
    """Seconds of ``H:MM:SS[.f]`` with minutes and seconds under sixty; null otherwise."""
    shape = r"^(\d+):(\d{1,2}):(\d{1,2}(?:\.\d+)?)$"
    text = F.trim(token)
    minutes = F.regexp_extract(text, shape, 2).try_cast("double")
    seconds = F.regexp_extract(text, shape, 3).try_cast("double")
    return F.when(
        F.regexp_like(text, F.lit(shape)) & (minutes < 60) & (seconds < 60),
        F.regexp_extract(text, shape, 1).try_cast("double") * 3600 + minutes * 60 + seconds,
    )


def lenient_caption_clock(token: Column) -> Column:
    """Seconds of ``H:M:S``, ``M:S`` or plain seconds, each part any number; null otherwise."""
    parts = F.split(F.trim(token), ":")
    value = [F.trim(F.get(parts, F.lit(i))).try_cast("double") for i in range(3)]
    return (
        F.when(F.size(parts) == 3, value[0] * 3600 + value[1] * 60 + value[2])
        .when(F.size(parts) == 2, value[0] * 60 + value[1])
        .otherwise(F.trim(token).try_cast("double"))
    )


def spoken_clock(token: Column) -> Column:
    """Seconds of a number with optional trailing ``s``, ``M:SS`` or ``H:MM:SS``; null when it is none of them."""
    text = F.regexp_replace(F.regexp_replace(token, r"^\s+|\s+$", ""), r"[sS]+$", "")
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    parts = F.split(text, ":")
    value = [F.get(parts, F.lit(i)).try_cast("double") for i in range(3)]
    return F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?$"), text.try_cast("double")).when(
        text.rlike(r"^[0-9]+(:[0-5][0-9]){1,2}(\.[0-9]+)?$"),
        F.when(F.size(parts) == 2, value[0] * 60 + value[1]).otherwise(value[0] * 3600 + value[1] * 60 + value[2]),
    )
