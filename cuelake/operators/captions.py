"""Caption rows to SRT / WebVTT text and back, worksheets, fan-out to languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions.text import script_class, wrap_lines
from cuelake.functions.timecode import clock_ms, srt_time, vtt_time

TRACK = ("project_id", "language")
CUES_PER_PART = 5_000


def block(fmt: str, text: str, has_lines: bool) -> Column:
    """The text of a cue in a file; cue ids count from 0."""
    lines = wrap_lines(F.col(text), script_class(F.col("language")))
    if has_lines:
        lines = F.coalesce(F.col("lines"), lines)
    body = F.concat(F.array_join(lines, "\n"), F.lit("\n\n"))
    clock = srt_time if fmt == "srt" else vtt_time
    timing = F.concat(clock(F.col("start_ms")), F.lit(" --> "), clock(F.col("end_ms")), F.lit("\n"))
    if fmt == "srt":
        return F.concat((F.col("cue_id") + 1).cast("string"), F.lit("\n"), timing, body)
    return F.concat(timing, body)


def render(
    cues: DataFrame, fmt: str, text: str = "target_text", cues_per_part: int = CUES_PER_PART
) -> DataFrame:
    """Caption files as rows ``(project_id, language, part, text)``; parts in order make the file.

    Cue ids count from 0. A part holds a fixed number of cues, so no track is gathered in one row.
    """
    c = cues.select(
        *TRACK, F.floor(F.col("cue_id") / cues_per_part).alias("part"), "cue_id",
        block(fmt, text, "lines" in cues.columns).alias("block"),
    )
    parts = F.sort_array(F.collect_list(F.struct("cue_id", "block")))
    out = c.groupBy(*TRACK, "part").agg(
        F.array_join(F.transform(parts, lambda b: b["block"]), "").alias("text")
    )
    if fmt == "vtt":
        head = F.when(F.col("part") == 0, F.lit("WEBVTT\n\n")).otherwise(F.lit(""))
        out = out.withColumn("text", F.concat(head, F.col("text")))
    return out


def blocks(cues: DataFrame, fmt: str, text: str = "target_text") -> DataFrame:
    """Caption rows ``(project_id, language, cue_id, block)``, each with the text that a file holds for it."""
    return cues.select(*TRACK, "cue_id", block(fmt, text, "lines" in cues.columns).alias("block"))


def parse_blocks(rows: DataFrame) -> DataFrame:
    """SRT or WebVTT blocks back to ``(cue_no, start_ms, end_ms, text)``, lines joined by blanks.

    A block without a number has a null ``cue_no``; hours may be missing in a time.
    """
    text = F.regexp_replace("block", "^\ufeff|\r", "")
    timing = r"(?:(\d+):)?(\d{2}:\d{2}[,.]\d{3})"
    hour = lambda k: F.concat(F.coalesce(F.nullif(F.regexp_extract("_b", times, k), F.lit("")), F.lit("00")), F.lit(":"))
    times = rf"{timing}[ \t]+-->[ \t]+{timing}"
    body = F.regexp_extract("_b", r"-->[^\n]*\n([\s\S]*)$", 1)
    return rows.withColumn("_b", text).select(
        *[c for c in rows.columns if c != "block"],
        F.regexp_extract("_b", r"^(\d+)[ \t]*\n", 1).try_cast("long").alias("cue_no"),
        clock_ms(F.concat(hour(1), F.regexp_extract("_b", times, 2))).alias("start_ms"),
        clock_ms(F.concat(hour(3), F.regexp_extract("_b", times, 4))).alias("end_ms"),
        F.replace(F.regexp_replace(body, r"\n+$", ""), F.lit("\n"), F.lit(" ")).alias("text"),
    )


def verbatim(cues: DataFrame) -> DataFrame:
    """Transcript cues as captions in their own language."""
    return cues.withColumn("target_text", F.col("source_text"))


def fan_out(cues: DataFrame, requested: DataFrame, translations: DataFrame) -> DataFrame:
    """One caption row per cue and requested language; the source language stays verbatim.

    ``requested`` is ``(project_id, target_language)``, a few rows per project.
    """
    rows = cues.join(requested, "project_id")
    t = translations.withColumnRenamed("text", "_text").withColumnRenamed("language", "target_language")
    rows = rows.join(t, ["project_id", "target_language", "cue_id"], "left")
    text = F.when(F.col("target_language") == F.col("language"), F.col("source_text")).otherwise(F.col("_text"))
    return rows.withColumn("target_text", text).drop("_text")


def export_worksheet(cues: DataFrame, flags: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Empty worksheet rows for cues not in ``existing``, with their editorial flags."""
    if existing is not None:
        cues = cues.join(existing, [*TRACK, "cue_id"], "left_anti")
    f = flags.groupBy(*TRACK, "cue_id").agg(
        F.sort_array(F.collect_set(F.concat(F.lit("editorial-"), F.col("category")))).alias("flags")
    )
    out = cues.withColumn("target_text", F.lit("")).join(f, [*TRACK, "cue_id"], "left")
    return out.withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))


def import_worksheet(cues: DataFrame, filled: DataFrame) -> DataFrame:
    """Fill targets by cue id; a track with any empty target is rejected as a whole."""
    f = filled.withColumnRenamed("target_text", "_text")
    rows = cues.drop("target_text").join(f, [*TRACK, "cue_id"], "left")
    rows = rows.withColumn("target_text", F.coalesce("_text", F.lit(""))).drop("_text")
    gaps = rows.filter(F.trim("target_text") == "").select(*TRACK).distinct()
    gaps = gaps.withColumn("rejected", F.lit(True))
    return rows.join(gaps, list(TRACK), "left").withColumn(
        "rejected", F.coalesce("rejected", F.lit(False))
    )


def reconcile_overrides(cues: DataFrame, overrides: DataFrame) -> DataFrame:
    """A non-blank ``modified_translation`` replaces the target."""
    rows = cues.join(overrides, [*TRACK, "cue_id"], "left")
    chosen = F.nullif(F.trim("modified_translation"), F.lit(""))
    return rows.withColumns({
        "overridden": chosen.isNotNull(), "target_text": F.coalesce(chosen, F.col("target_text"))
    }).drop("modified_translation")
