"""Run status of videos: resume plans, stage roll-ups, batch summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The stages of a run, in order; the last three run once per language.
STAGES = ["download", "extract_audio", "transcribe", "translate", "dub", "mux"]
SCOPED = ["translate", "dub", "mux"]


def load_status(recorded: DataFrame, videos: DataFrame) -> DataFrame:
    """Status rows for every stage of every video: unrecorded ones pend, running ones pend again."""
    grid = videos.select("video_id", F.explode(F.array(*[F.lit(s) for s in STAGES])).alias("stage"))
    s = grid.join(recorded, ["video_id", "stage"], "left")
    status = F.coalesce("status", F.lit("pending"))
    return s.withColumn("status", F.when(status == "running", "pending").otherwise(status))


def units(runs: DataFrame) -> DataFrame:
    """``(video_id, stage, language)`` of all that a run has to do, from ``(video_id, language)``.

    The stages before translation run once per video and carry the empty language.
    """
    once = runs.select("video_id").distinct().select(
        "video_id", F.explode(F.array(*[F.lit(s) for s in STAGES if s not in SCOPED])).alias("stage"), F.lit("").alias("language")
    )
    each = runs.select("video_id", "language").distinct()
    each = each.select("video_id", F.explode(F.array(*[F.lit(s) for s in SCOPED])).alias("stage"), "language")
    return once.unionByName(each)


def resume_plan(grid: DataFrame, status: DataFrame) -> DataFrame:
    """Units of ``grid`` that still must run: not done, or done without a non-empty artifact."""
    done = status.filter((F.col("status") == "done") & (F.col("artifact_bytes") > 0))
    return grid.join(done, grid.columns, "left_anti")


def stage_rollup(status: DataFrame) -> DataFrame:
    """Status of a stage from its languages."""
    has = lambda s: F.max((F.col("status") == s).cast("int")) == 1
    rolled = (
        F.when(F.min((F.col("status") == "done").cast("int")) == 1, "done")
        .when(has("failed"), "failed")
        .when(has("running"), "running")
        .otherwise("pending")
    )
    return status.groupBy("video_id", "stage").agg(rolled.alias("status"), F.count(F.lit(1)).alias("languages"))


def batch_outcomes(rollup: DataFrame) -> DataFrame:
    """Per video: failed stages, and whether everything is done."""
    return rollup.groupBy("video_id").agg(
        F.sum((F.col("status") == "failed").cast("long")).alias("failed_stages"),
        F.min(F.when(F.col("status") == "failed", F.col("stage"))).alias("first_failed"),
        (F.min((F.col("status") == "done").cast("int")) == 1).alias("succeeded"),
    )


def batch_results(outcomes: DataFrame) -> DataFrame:
    """``(batch_id, video_id, result, error)`` of the finished videos: ``succeeded``, or ``failed`` with its stage."""
    result = F.when(F.col("failed_stages") > 0, "failed").when(F.col("succeeded"), "succeeded")
    return outcomes.select(
        "batch_id", "video_id", result.alias("result"), F.coalesce("first_failed", F.lit("")).alias("error")
    ).filter(F.col("result").isNotNull())


def batch_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.col("succeeded").cast("long")).alias("succeeded"),
        F.sum((F.col("failed_stages") > 0).cast("long")).alias("failed"),
    )
