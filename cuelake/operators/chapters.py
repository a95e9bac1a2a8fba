"""Chapter candidates, checks and description text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.functions.timecode import chapter_time
from cuelake.operators import ordered
from cuelake.operators.ordered import Order, running

TRACK = ("project_id", "language")
CHAPTERS_PER_PART = 5_000


def candidates(cues: DataFrame, order: Order, gap_ms: int) -> DataFrame:
    """0 and every start after a pause of at least ``gap_ms``."""
    c = running(cues, order, _prev=ordered.previous(F.col("end_ms")))
    first = F.col("_prev").isNull()
    late = F.col("start_ms") - F.col("_prev") >= gap_ms
    starts = F.when(first, F.lit(0).cast("long")).when(late, F.col("start_ms"))
    return c.select(*TRACK, starts.alias("start_ms")).filter(F.col("start_ms").isNotNull())


def problems(chapters: DataFrame, order: Order, source: DataFrame) -> DataFrame:
    """Chapters that break a rule, with the first rule they break."""
    c = running(chapters, order, _prev=ordered.previous(F.col("start_ms"))).join(source, list(TRACK))
    start, prev = F.col("start_ms"), F.col("_prev")
    problem = (
        F.when(prev.isNull() & (start != 0), "first-not-at-zero")
        .when(start <= prev, "not-increasing")
        .when(start >= F.col("source_ms"), "beyond-duration")
        .when(F.trim("title") == "", "blank-title")
    )
    return c.select(*TRACK, "cue_id", problem.alias("problem")).filter(F.col("problem").isNotNull())


def description(chapters: DataFrame, per_part: int = CHAPTERS_PER_PART) -> DataFrame:
    """Timecode lines for a video description, in parts of bounded size."""
    line = F.concat(chapter_time(F.col("start_ms")), F.lit(" "), F.col("title"))
    rows = F.sort_array(F.collect_list(F.struct("cue_id", line.alias("line"))))
    return chapters.groupBy(*TRACK, F.floor(F.col("cue_id") / per_part).alias("part")).agg(
        F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text")
    )
