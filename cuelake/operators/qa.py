"""Checks over cues: flags, findings, metrics and gate decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions.text import MAX_WPM, reads_faster, script_class, units_per_minute, word_count
from cuelake.operators import ordered
from cuelake.operators.ordered import Order, running

TRACK = ("project_id", "language")
# Severities by rank.
SEVERITIES = ["note", "minor", "major", "blocker"]
TERMINATORS = r"[.!?؟۔…。！？]\s*$"
RESEGMENT_GAP_MS = 800
REPETITION_RUN = 3
OVER_LONG_MS = 30_000
COARSE_MS_PER_CUE = 10_000


def severity_rank(severity: Column) -> Column:
    rank = F.lit(0)
    for i, name in enumerate(SEVERITIES, start=1):
        rank = F.when(severity == name, i).otherwise(rank)
    return rank


def decision(blockers: Column, majors: Column) -> Column:
    """Any blocker fails the gate, any major makes it conditional."""
    return (
        F.when(F.coalesce(blockers, F.lit(0)) > 0, "FAIL")
        .when(F.coalesce(majors, F.lit(0)) > 0, "CONDITIONAL_PASS")
        .otherwise("PASS")
    )


def decide(findings: DataFrame, scope: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One decision per row of ``scope``; no findings is a pass."""
    count = lambda s: F.sum((F.col("severity") == s).cast("long")).alias(f"{s}s")
    per = findings.groupBy(*keys).agg(*[count(s) for s in SEVERITIES])
    out = scope.join(per, list(keys), "left").fillna(0, [f"{s}s" for s in SEVERITIES])
    return out.withColumn("decision", decision(F.col("blockers"), F.col("majors")))


# --- transcripts ----------------------------------------------------------------------------------

def resegment(cues: DataFrame, order: Order, gap_ms: int = RESEGMENT_GAP_MS) -> DataFrame:
    """Join a cue to the one before while that has no sentence end and the pause is short."""
    c = running(cues, order, _prev=ordered.previous(F.struct("source_text", "end_ms")))
    breaks = (
        F.col("_prev").isNull()
        | F.col("_prev")["source_text"].rlike(TERMINATORS)
        | (F.col("start_ms") - F.col("_prev")["end_ms"] > gap_ms)
    )
    c = c.withColumn("_brk", breaks.cast("long"))
    c = running(c, order, _island=ordered.total(F.col("_brk")))
    parts = F.sort_array(F.collect_list(F.struct("cue_id", F.trim("source_text").alias("t"))))
    merged = c.groupBy(*order.keys, F.col("_island").alias("new_id")).agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.count(F.lit(1)).alias("parts"),
        F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text"),
    )
    return merged.withColumn("new_id", F.col("new_id") - 1)


def repetition_runs(texts: DataFrame, order: Order, min_run: int = REPETITION_RUN) -> DataFrame:
    """Runs of ``min_run`` or more equal consecutive texts."""
    t = running(texts, order, _prev=ordered.previous(F.col("text")))
    t = t.withColumn("_new", (~F.col("text").eqNullSafe(F.col("_prev")) | F.col("_prev").isNull()).cast("long"))
    t = running(t, order, _island=ordered.total(F.col("_new")))
    runs = t.groupBy(*order.keys, "_island").agg(
        F.min("cue_id").alias("first_cue"), F.max("cue_id").alias("last_cue"),
        F.min("text").alias("text"), F.count(F.lit(1)).alias("run_length"),
    )
    return runs.filter(F.col("run_length") >= min_run).drop("_island")


def transcript_checks(
    cues: DataFrame, order: Order, silence_bar_ms: int = 5000, low_confidence: float = -1.0,
    over_long_ms: int = OVER_LONG_MS, no_speech: float = 0.6,
) -> DataFrame:
    """Cue rows with one flag per check; a single pass over each track.

    ``non_speech`` says that the recogniser heard no speech with more than ``no_speech``; it is false where the cues
    carry no ``no_speech_prob``.
    """
    silent = F.col("no_speech_prob") > no_speech if "no_speech_prob" in cues.columns else F.lit(False)
    c = running(cues, order, _prev=ordered.previous(F.struct("source_text", "end_ms")))
    prev_end = F.col("_prev")["end_ms"]
    same = F.coalesce(F.col("_prev")["source_text"] == F.col("source_text"), F.lit(False))
    c = c.withColumns({
        "backwards": F.col("end_ms") <= F.col("start_ms"),
        "overlapping": F.coalesce(F.col("start_ms") < prev_end, F.lit(False)),
        "after_silence": F.coalesce(F.col("start_ms") - prev_end > silence_bar_ms, F.lit(False)),
        "over_long": F.col("end_ms") - F.col("start_ms") > over_long_ms,
        "low_confidence": F.coalesce(F.col("confidence") < low_confidence, F.lit(False)),
        "non_speech": F.coalesce(silent, F.lit(False)),
        "_same": same,
    })
    c = running(c, order, _same1=ordered.previous(F.col("_same")))
    c = c.withColumn("_pair", F.col("_same") & F.coalesce("_same1", F.lit(False)))
    c = running(c, order, _pair1=ordered.previous(F.col("_pair")))
    third = F.col("_pair") & ~F.coalesce("_pair1", F.lit(False))  # third cue of a run of three or more
    return c.withColumn("repetition", third).drop("_prev", "_same", "_same1", "_pair", "_pair1")


def transcript_findings(checks: DataFrame) -> DataFrame:
    """The flags as finding rows."""
    def finding(flag: str, severity: str, category: str) -> Column:
        return F.when(
            F.col(flag), F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"))
        )

    rows = F.array(
        finding("backwards", "blocker", "timing"),
        finding("repetition", "blocker", "repetition"),
        finding("overlapping", "note", "possible-overlapping-speech"),
        finding("after_silence", "note", "silence-gap"),
        finding("over_long", "note", "granularity"),
    )
    found = F.inline(F.filter(rows, lambda f: f.isNotNull()))
    return checks.select(*TRACK, "cue_id", F.col("start_ms").alias("timestamp_ms"), found)


def transcript_decision(
    checks: DataFrame, projects: DataFrame, conditional_share: float = 0.25,
    ms_per_cue: int = COARSE_MS_PER_CUE,
) -> DataFrame:
    """Metrics and decision per track of ``projects`` (``source_ms`` known); no cues is a failure."""
    count = lambda flag: F.sum(F.col(flag).cast("long")).alias(flag)
    flags = ["backwards", "repetition", "overlapping", "after_silence", "over_long", "low_confidence", "non_speech"]
    m = checks.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("cue_count"), *[count(f) for f in flags])
    m = projects.join(m, list(TRACK), "left").fillna(0, ["cue_count", *flags])
    share = F.round(F.col("low_confidence") / F.col("cue_count"), 6)
    m = m.withColumns({
        "low_confidence_share": F.when(F.col("cue_count") > 0, share).otherwise(0.0),
        "too_coarse": F.coalesce(F.col("cue_count") * ms_per_cue < F.col("source_ms"), F.lit(False)),
    })
    doubtful = F.col("low_confidence") > conditional_share * F.col("cue_count")
    return m.withColumn(
        "decision",
        decision(
            F.when(F.col("cue_count") == 0, 1).otherwise(F.col("backwards") + F.col("repetition")),
            doubtful.cast("int") + F.col("too_coarse").cast("int"),
        ),
    )


# --- captions and translations --------------------------------------------------------------------

def caption_checks(
    cues: DataFrame, max_rate: Column | int = MAX_WPM, max_cpm: int = 600, very_long_ms: int = 7000
) -> DataFrame:
    """Reading rate and timing flags per caption cue. ``max_rate`` at or below 0 means the default."""
    rate = F.lit(max_rate) if isinstance(max_rate, int) else max_rate
    script = script_class(F.col("language"))
    span = F.col("end_ms") - F.col("start_ms")
    bar = F.when(script == "cjk", max_cpm).when(rate > 0, rate).otherwise(MAX_WPM)
    c = cues.withColumns({
        "script_class": script,
        "rate": units_per_minute(F.col("target_text"), script, span),
        "empty": F.trim("target_text") == "",
        "backwards": span <= 0,
        "very_long": span > very_long_ms,
    })
    return c.withColumn("too_fast", F.coalesce(reads_faster(F.col("target_text"), script, span, bar), F.lit(False)))


def caption_decision(checks: DataFrame, tracks: DataFrame) -> DataFrame:
    count = lambda flag: F.sum(F.col(flag).cast("long")).alias(flag)
    flags = ["empty", "backwards", "too_fast", "very_long"]
    m = checks.groupBy(*TRACK).agg(
        F.count(F.lit(1)).alias("cue_count"), F.max("rate").alias("max_rate"), *[count(f) for f in flags]
    )
    m = tracks.join(m, list(TRACK), "left").fillna(0, ["cue_count", "max_rate", *flags])
    return m.withColumns({
        "script_class": script_class(F.col("language")),
        "decision": decision(
            F.when(F.col("cue_count") == 0, 1).otherwise(F.col("empty") + F.col("backwards")), F.col("too_fast")
        ),
    })


def translation_findings(cues: DataFrame, trivial_words: int = 1) -> DataFrame:
    """Empty targets and targets equal to a source of more than ``trivial_words`` words."""
    source, target = F.trim("source_text"), F.trim("target_text")
    category = F.when(target == "", "empty-target").when(
        (target == source) & (word_count(source) > trivial_words), "identical-to-source"
    )
    c = cues.withColumn("category", category).filter(F.col("category").isNotNull())
    severity = F.when(F.col("category") == "empty-target", "blocker").otherwise("major")
    return c.select(*TRACK, "cue_id", "category", severity.alias("severity"))


def translation_report(findings: DataFrame, tracks: DataFrame) -> DataFrame:
    """One report a project over all its ``tracks``: the languages covered, its findings and one decision."""
    covered = tracks.groupBy("project_id").agg(F.sort_array(F.collect_set("language")).alias("languages"))
    return decide(findings, covered, ["project_id"])


def gloss_findings(cues: DataFrame, min_ratio: float = 0.2, max_ratio: float = 5.0) -> DataFrame:
    """Context checks of the English gloss against its source."""
    source, target = F.trim("source_text"), F.trim("target_text")
    ns, nt = F.length(source), F.length(target)

    def finding(cond: Column, severity: str, category: str) -> Column:
        return F.when(
            cond,
            F.struct(F.lit(severity).alias("severity"), F.lit("english-context/" + category).alias("category")),
        )

    outlier = (target != "") & (ns > 0) & ((nt < min_ratio * ns) | (nt > max_ratio * ns))
    rows = F.array(
        finding((target == source) & (word_count(source) > 1), "note", "untranslated-suspect"),
        finding(outlier, "note", "length-outlier"),
        finding(F.array_contains("flags", "context-mismatch"), "major", "context-mismatch"),
        finding(F.coalesce(F.trim("context_note") != "", F.lit(False)), "note", "context-note"),
    )
    return cues.select(*TRACK, "cue_id", F.inline(F.filter(rows, lambda f: f.isNotNull())))


def fold_gloss(report: DataFrame, gloss_tracks: DataFrame, findings: DataFrame) -> DataFrame:
    """Add gloss findings to a transcript report: presence, count and a decision never milder."""
    per = findings.groupBy(*TRACK).agg(
        F.count(F.lit(1)).alias("gloss_context_findings"),
        F.sum((F.col("severity") == "major").cast("long")).alias("_majors"),
    )
    out = report.join(gloss_tracks.select(*TRACK, F.lit(True).alias("gloss_present")), list(TRACK), "left")
    out = out.join(per, list(TRACK), "left").fillna(0, ["gloss_context_findings", "_majors"])
    folded = F.when((F.col("decision") == "PASS") & (F.col("_majors") > 0), "CONDITIONAL_PASS").otherwise(
        F.col("decision")
    )
    return out.withColumns({
        "gloss_present": F.coalesce("gloss_present", F.lit(False)), "decision": folded
    }).drop("_majors")


# --- media ----------------------------------------------------------------------------------------

def _final_categories(probe: DataFrame, tolerance_ms: int) -> Column:
    """What is wrong with a rendered file: streams first, then its length against the dub's."""
    video = F.when(~F.col("has_video"), "missing-video") if "has_video" in probe.columns else F.lit(None).cast("string")
    drift = F.abs(F.col("container_ms") - F.col("dub_ms")) > tolerance_ms
    return F.array_compact(F.array(
        video, F.when(~F.col("has_audio"), "missing-stream"), F.when(drift, "av-drift")
    ))


def final_findings(probe: DataFrame, tolerance_ms: int = 1000) -> DataFrame:
    """A row per finding: missing video, missing audio, container against dub length."""
    p = probe.withColumn("av_drift_ms", F.col("container_ms") - F.col("dub_ms"))
    return p.withColumn("category", F.explode(_final_categories(probe, tolerance_ms))).withColumn(
        "severity", F.lit("blocker")
    )


def final_verdicts(probe: DataFrame, tolerance_ms: int = 1000) -> DataFrame:
    """Each file with its drift, its ``categories`` and its decision, from its own row alone."""
    found = _final_categories(probe, tolerance_ms)
    return probe.withColumns({
        "av_drift_ms": F.col("container_ms") - F.col("dub_ms"), "categories": found,
        "decision": F.when(F.size(found) > 0, "FAIL").otherwise("PASS"),
    })


def final_report(probes: DataFrame, tracks: DataFrame, tolerance_ms: int = 1000) -> DataFrame:
    """One final decision a project, with a finding for each thing wrong in a language.

    ``probes`` is ``(project_id, language, has_video, has_audio, container_ms, dub_ms)``. Only ``tracks``
    ``(project_id, language, dub_enabled)`` with a dub are looked at; one without a file is a finding of its own, and a
    file of a track without a dub is none. Gives ``languages`` looked at, ``findings`` in order of language, the widest
    drift, and the decision; a project without dubs passes. Lists are as long as a project has languages.
    """
    dubs = tracks.groupBy("project_id", "language").agg(F.max("dub_enabled").alias("_dub"))
    p = dubs.join(probes.withColumn("_file", F.lit(True)), ["project_id", "language"], "left")
    none = F.array().cast("array<string>")
    found = F.when(~F.col("_dub"), none).when(F.col("_file").isNull(), F.array(F.lit("missing-file"))).otherwise(
        _final_categories(probes, tolerance_ms)
    )
    drift = F.when(F.col("_dub"), F.col("container_ms") - F.col("dub_ms"))
    one = F.struct("language", found.alias("categories"), drift.alias("av_drift_ms"))
    g = p.groupBy("project_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("_dub"), one))).alias("_checked"), F.max(F.abs(drift)).alias("widest_drift_ms")
    )
    findings = F.flatten(F.transform("_checked", lambda t: F.transform(t["categories"], lambda c: F.struct(
        t["language"].alias("language"), c.alias("category"), F.lit("blocker").alias("severity"), t["av_drift_ms"].alias("av_drift_ms")
    ))))
    return g.select(
        "project_id", F.transform("_checked", lambda t: t["language"]).alias("languages"), findings.alias("findings"),
        "widest_drift_ms", F.when(F.size(findings) > 0, "FAIL").otherwise("PASS").alias("decision"),
    )


def pick_attempt(attempts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First attempt without problems, else the one with fewest problems, with a warning."""
    best = F.min(F.struct((F.col("problems") > 0).alias("bad"), F.when(F.col("problems") > 0, F.col("problems")).otherwise(0).alias("p"), F.col("attempt")))
    return attempts.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.col("_b")["attempt"].alias("attempt"), F.col("_b")["p"].alias("problems"),
        F.col("_b")["bad"].alias("warning"),
    )
