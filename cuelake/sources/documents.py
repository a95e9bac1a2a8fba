"""Readers and sinks for the JSON documents: explicit schemas, one row per inner item.

``multi_line`` reads one pretty-printed document per file; otherwise each line is a document, which
Spark can split. Sinks write lines, with long documents cut into parts of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake import schemas
from cuelake.functions.text import canonical_language

CUES_PER_PART = 5_000


def read_json(
    spark: SparkSession, path: str, schema: str, multi_line: bool = False, mode: str = "FAILFAST"
) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).option("mode", mode).json(path)


# --- transcripts and captions ---------------------------------------------------------------------

def read_transcripts(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    d = read_json(spark, path, schemas.TRANSCRIPT, multi_line)
    return d.select("project_id", "language", "duration_seconds", F.inline("cues")).withColumnRenamed("id", "cue_id")


def read_captions(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    d = read_json(spark, path, schemas.CAPTION, multi_line)
    return d.select("project_id", "language", "source_language", F.inline("cues")).withColumnRenamed("id", "cue_id")


def read_whisper(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Speech-recogniser output to transcript cues: milliseconds, trimmed text, confidence."""
    ms = lambda s: F.round(s * 1000).cast("long")
    d = read_json(spark, path, schemas.WHISPER, multi_line)
    d = d.select("project_id", "language", "duration", F.posexplode("segments").alias("pos", "s"))
    words = F.transform(
        "s.words",
        lambda w: F.struct(
            F.trim(w["word"]).alias("word"), ms(w["start"]).alias("start_ms"), ms(w["end"]).alias("end_ms"),
            w["probability"].alias("probability"),
        ),
    )
    return d.select(
        "project_id", "language", "duration", F.coalesce("s.id", F.col("pos").cast("long")).alias("cue_id"),
        ms(F.col("s.start")).alias("start_ms"), ms(F.col("s.end")).alias("end_ms"), F.trim("s.text").alias("text"),
        F.col("s.avg_logprob").alias("confidence"), F.col("s.no_speech_prob").alias("no_speech_prob"), words.alias("words"),
    )


def as_captions(transcript: DataFrame) -> DataFrame:
    """Transcript cues as verbatim caption cues."""
    return transcript.withColumns({"source_text": F.col("text"), "target_text": F.col("text")}).drop("text", "words")


def language_mismatches(transcripts: DataFrame, declared: DataFrame) -> DataFrame:
    """Projects whose detected language is not the declared one: an error, or a note when forced."""
    t = transcripts.select("project_id", F.col("language").alias("detected")).distinct().join(declared, "project_id")
    given = (F.trim("detected") != "") & (F.trim("declared") != "")
    other = canonical_language(F.col("detected")) != canonical_language(F.col("declared"))
    return t.filter(given & other).withColumn("severity", F.when(F.col("forced"), "note").otherwise("error"))


def cue_documents(
    cues: DataFrame, keys: Sequence[str], items: dict[str, Column], array: str = "cues",
    header: dict[str, Column] | None = None, cues_per_part: int = CUES_PER_PART,
) -> DataFrame:
    """Documents with their cues in order; ``items`` are the fields of a cue, ``id`` first.

    ``header`` adds fields to the grouped documents or replaces keys: cues that lie together by their keys as they are
    need no further shuffle.
    """
    part = F.floor(items["id"] / cues_per_part).alias("_part")
    c = cues.select(*keys, part, F.struct(*[v.alias(k) for k, v in items.items()]).alias("_c"))
    docs = c.groupBy(*keys, "_part").agg(F.sort_array(F.collect_list("_c")).alias(array)).drop("_part")
    for name, value in (header or {}).items():
        docs = docs.withColumn(name, value)
    return docs


def write_cue_documents(
    cues: DataFrame, path: str, keys: Sequence[str], items: dict[str, Column], array: str = "cues",
    header: dict[str, Column] | None = None, cues_per_part: int = CUES_PER_PART,
) -> None:
    """Write ``cue_documents`` as lines of JSON."""
    cue_documents(cues, keys, items, array, header, cues_per_part).write.json(path)


CLIP_TRANSCRIPT = (
    "project_id long, segment struct<index:long,id:string,source_start_ms:long,source_end_ms:long>, duration_seconds double, "
    "cues array<struct<id:long,start_ms:long,end_ms:long,text:string>>"
)


def read_clip_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Cues of clip transcripts in clip time, next to the piece of the source that the clip is."""
    d = spark.read.schema(CLIP_TRANSCRIPT).json(path)
    return d.select(
        "project_id", F.col("segment.index").alias("segment_index"), F.col("segment.id").alias("segment_id"),
        "segment.source_start_ms", "segment.source_end_ms", "duration_seconds", F.explode("cues").alias("_c"),
    ).select("*", "_c.*").drop("_c")


# --- events ---------------------------------------------------------------------------------------

def append_events(events: DataFrame, path: str) -> None:
    """Append one JSON object per line with sorted keys."""
    line = F.to_json(F.struct(*[F.col(c) for c in sorted(events.columns)]), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    events.select(line.alias("value")).write.mode("append").text(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, schemas.EVENT)


# --- manifests, approvals, state, status ----------------------------------------------------------

def read_artifacts(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    d = read_json(spark, path, schemas.ARTIFACT_MANIFEST, multi_line)
    return d.select("project_id", F.inline("artifacts"))


def read_approvals(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return read_json(spark, path, schemas.APPROVAL, multi_line)


def read_tracks(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    d = read_json(spark, path, schemas.STATE, multi_line)
    d = d.select("project_id", "current_state", F.explode("language_tracks").alias("language", "_t"))
    return d.select("project_id", "current_state", "language", "_t.*")


def read_active(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """``type@language`` keys of the state documents split into columns."""
    d = read_json(spark, path, schemas.STATE, multi_line)
    d = d.select("project_id", F.explode("active_artifacts").alias("_k", "sha256"))
    key = F.split("_k", "@")
    return d.select(
        "project_id", key[0].alias("type"), F.coalesce(F.get(key, F.lit(1)), F.lit("")).alias("language"), "sha256"
    )


def read_run_status(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Recorded stage rows; corrupt documents are dropped, so all their stages pend again.

    A stage per language gives one row per language, others one row with an empty language.
    """
    d = read_json(spark, path, schemas.RUN_STATUS, multi_line, mode="PERMISSIVE")
    d = d.filter(F.col("video_id").isNotNull()).select("video_id", F.explode("stages").alias("stage", "_s"))
    whole = F.struct(F.lit("").alias("language"), F.col("_s.status").alias("status"), F.col("_s.artifact").alias("artifact"))
    each = F.transform(
        F.map_entries("_s.per_language"),
        lambda e: F.struct(e["key"].alias("language"), e["value"]["status"].alias("status"), e["value"]["artifact"].alias("artifact")),
    )
    rows = F.when(F.coalesce(F.size("_s.per_language"), F.lit(0)) > 0, each).otherwise(F.array(whole))
    return d.select("video_id", "stage", F.inline(rows))


# --- glossaries, playlists, batches, probes, reports ----------------------------------------------

def read_glossaries(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    d = read_json(spark, path, schemas.GLOSSARY, multi_line).select("glossary_id", F.inline("terms"))
    d = d.select("glossary_id", "source", "must_appear", F.explode("targets").alias("language", "_t"))
    names = F.filter(
        F.concat(F.array("_t.rendering"), F.coalesce("_t.aliases", F.array().cast("array<string>"))), lambda x: x != ""
    )
    return d.select("glossary_id", "language", F.col("source").alias("term"), names.alias("renderings"), "must_appear")


def read_playlists(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Entries with their place in the playlist; ``offset=`` folders hold the parts of long ones."""
    d = read_json(spark, path, schemas.PLAYLIST, multi_line)
    first = F.col("offset") if "offset" in d.columns else F.lit(0)
    d = d.select(
        F.col("id").alias("playlist_id"), F.col("title").alias("playlist_title"), first.cast("long").alias("_first"),
        F.posexplode("entries").alias("pos", "e"),
    )
    return d.select(
        "playlist_id", "playlist_title", (F.col("_first") + F.col("pos") + 1).alias("ordinal"), F.col("e.id").alias("video_id"),
        F.col("e.url").alias("url"), F.col("e.title").alias("title"), F.col("e.channel").alias("channel"),
        F.col("e.duration").alias("duration_seconds"),
    )


def read_batch_list(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Videos of a batch list; a list without videos is an error."""
    videos = read_json(spark, path, schemas.BATCH_LIST, multi_line).select(F.inline("videos"))
    if videos.isEmpty():
        raise ValueError(f"the batch list {path} names no video")
    return videos


def read_probes(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return read_json(spark, path, schemas.PROBE, multi_line)


def write_reports(findings: DataFrame, path: str) -> None:
    """Findings as JSON in one folder per report type."""
    findings.write.partitionBy("report_type").json(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, schemas.FINDING)
