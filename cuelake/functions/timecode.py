"""Timecodes: parsing, SRT / WebVTT / chapter rendering, retiming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_timecode(text: Column) -> Column:
    """``HH:MM:SS(.mmm)``, ``MM:SS`` or plain seconds to milliseconds; null when invalid.

    Numbers of more than nine digits (leading zeros aside) are invalid: no video lasts that long.
    """
    t = F.trim(text)
    clock = r"^(?:0*(\d{1,9}):)?0*(\d{1,9}):0*(\d{1,9}(?:\.\d+)?)$"
    plain = r"^0*(\d{1,9}(?:\.\d+)?)$"

    def number(pattern: str, group: int, kind: str) -> Column:
        return F.nullif(F.regexp_extract(t, pattern, group), F.lit("")).try_cast(kind)

    hours = F.coalesce(number(clock, 1, "long"), F.lit(0))
    minutes = number(clock, 2, "long")
    seconds = number(clock, 3, "decimal(18,3)")
    whole = number(plain, 1, "decimal(18,3)")
    as_clock = F.when(
        (minutes < 60) & (seconds < 60),
        (hours * 3600 + minutes * 60) * 1000 + (seconds * 1000).cast("long"),
    )
    return F.coalesce(as_clock, (whole * 1000).cast("long"))


def _clock(ms: Column, mark: str) -> Column:
    return F.format_string(
        f"%02d:%02d:%02d{mark}%03d",
        F.floor(ms / 3600000),
        F.floor(ms / 60000) % 60,
        F.floor(ms / 1000) % 60,
        ms % 1000,
    )


def srt_time(ms: Column) -> Column:
    return _clock(ms, ",")


def vtt_time(ms: Column) -> Column:
    return _clock(ms, ".")


def chapter_time(ms: Column) -> Column:
    """``M:SS``, or ``H:MM:SS`` from one hour on."""
    s = F.floor(ms / 1000)
    short = F.format_string("%d:%02d", F.floor(s / 60), s % 60)
    long = F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    return F.when(ms >= 3600000, long).otherwise(short)


def clock_ms(text: Column) -> Column:
    """SRT or WebVTT time back to milliseconds."""
    p = r"(\d+):(\d+):(\d+)[,.](\d+)"
    part = [F.regexp_extract(text, p, i).try_cast("long") for i in (1, 2, 3, 4)]
    return ((part[0] * 60 + part[1]) * 60 + part[2]) * 1000 + part[3]


def respeed(ms: Column, factor_permille: Column | int) -> Column:
    """``round(ms / factor)``, half up, in integers; the factor is given in thousandths."""
    f = F.lit(factor_permille) if isinstance(factor_permille, int) else factor_permille
    return F.floor((ms * 2000 + f) / (f * 2)).cast("long")
