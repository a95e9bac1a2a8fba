"""Jobs over cues: transcript checks, dub timelines, splitting, rendering, clips, chapters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.functions import text as tx
from cuelake.operators import captions, chapters, glossary, intervals, ordered, packaging, qa, split, timeline
from cuelake.operators.ordered import Order, running, unblock
from cuelake.plans.registry import job
from cuelake.session import shared_dir
from cuelake.sources import captionfiles, documents, packages
from cuelake.sources import fixtures as fx

TRACK = ("project_id", "language")
MEASURE = [*TRACK, "cue_id", "start_ms", "end_ms", "natural_ms", "keep_source"]


def _measures(spark, sf):
    """Cue timing without the texts: the timeline jobs shuffle only numbers."""
    c, order = fx.cues(spark, sf)
    return c.select(*MEASURE, *order.block), order


# --- transcript -----------------------------------------------------------------------------------

@job("transcript_qa_decision", """
+WITH f AS (SELECT *, end_ms <= start_ms AS backwards, COALESCE(start_ms < LAG(end_ms) OVER w, false) AS overlapping,
    COALESCE(start_ms - LAG(end_ms) OVER w > 1000, false) AS after_silence, end_ms - start_ms > 8000 AS over_long,
    SUM(CASE WHEN source_text = COALESCE(pt, '') THEN 0 ELSE 1 END) OVER w AS isl
  FROM (SELECT *, LAG(source_text) OVER (PARTITION BY project_id, language ORDER BY cue_id) AS pt FROM x1b)
  WINDOW w AS (PARTITION BY project_id, language ORDER BY cue_id)),
r AS (SELECT project_id, COUNT(*) AS repetition FROM (SELECT project_id, isl FROM f GROUP BY project_id, isl HAVING COUNT(*) >= 3) GROUP BY project_id),
m AS (SELECT project_id, language, COUNT(*) AS cue_count, CAST(SUM(backwards::INT) AS BIGINT) AS backwards, CAST(SUM(overlapping::INT) AS BIGINT) AS overlapping,
    CAST(SUM(after_silence::INT) AS BIGINT) AS after_silence, CAST(SUM(over_long::INT) AS BIGINT) AS over_long,
    CAST(SUM((confidence < -1.0)::INT) AS BIGINT) AS low_confidence, COUNT(*) FILTER ((project_id + cue_id) % 10 > 6) AS non_speech FROM f GROUP BY project_id, language)
SELECT m.*, COALESCE(repetition, 0) AS repetition, ROUND(low_confidence / cue_count, 6) AS low_confidence_share,
  cue_count * 10000 < source_ms AS too_coarse, source_ms,
  CASE WHEN backwards + COALESCE(repetition, 0) > 0 THEN 'FAIL'
       WHEN low_confidence > 0.25 * cue_count OR cue_count * 10000 < source_ms THEN 'CONDITIONAL_PASS' ELSE 'PASS' END AS decision
FROM m LEFT JOIN r USING (project_id) JOIN dur USING (project_id, language)""")
def transcript_qa_decision(spark: SparkSession, sf: str) -> DataFrame:
    plain, order = fx.cues(spark, sf)
    heard = fx.untidy(plain).withColumn("no_speech_prob", (F.col("project_id") + F.col("cue_id")) % 10 / 10)
    checks = qa.transcript_checks(heard, order, silence_bar_ms=1000, over_long_ms=8000)
    return qa.transcript_decision(checks, fx.durations(plain))


@job("transcript_findings", """
+WITH f AS (SELECT *, LAG(end_ms) OVER w AS pe, LAG(source_text) OVER w AS p1, LAG(source_text, 2) OVER w AS p2, LAG(source_text, 3) OVER w AS p3
  FROM x1b WINDOW w AS (PARTITION BY project_id, language ORDER BY cue_id))
SELECT project_id, language, cue_id, start_ms AS timestamp_ms, 'blocker' AS severity, 'timing' AS category FROM f WHERE end_ms <= start_ms
UNION ALL SELECT project_id, language, cue_id, start_ms, 'blocker', 'repetition' FROM f
  WHERE source_text = p1 AND p1 = p2 AND (p3 IS NULL OR p3 <> p2)
UNION ALL SELECT project_id, language, cue_id, start_ms, 'note', 'possible-overlapping-speech' FROM f WHERE start_ms < pe
UNION ALL SELECT project_id, language, cue_id, start_ms, 'note', 'silence-gap' FROM f WHERE start_ms - pe > 1000
UNION ALL SELECT project_id, language, cue_id, start_ms, 'note', 'granularity' FROM f WHERE end_ms - start_ms > 8000""")
def transcript_findings(spark, sf):
    c, order = fx.untidy_cues(spark, sf)
    return qa.transcript_findings(qa.transcript_checks(c, order, silence_bar_ms=1000, over_long_ms=8000))


@job("resegment_cues", r"""
+WITH b AS (SELECT *, CASE WHEN LAG(cue_id) OVER w IS NULL OR regexp_matches(LAG(source_text) OVER w, '[.!?؟۔…。！？]\s*$')
      OR start_ms - LAG(end_ms) OVER w > 800 THEN 1 ELSE 0 END AS brk
  FROM (SELECT * REPLACE (CASE WHEN cue_id % 2 = 0 THEN rtrim(source_text, '.') ELSE source_text END AS source_text) FROM x1) WINDOW w AS (PARTITION BY project_id, language ORDER BY cue_id)),
i AS (SELECT *, SUM(brk) OVER (PARTITION BY project_id, language ORDER BY cue_id) AS isl FROM b)
SELECT project_id, language, CAST(isl - 1 AS BIGINT) AS new_id, MIN(start_ms) AS start_ms, MAX(end_ms) AS end_ms, COUNT(*) AS parts,
  string_agg(trim(source_text), ' ' ORDER BY cue_id) AS text
FROM i GROUP BY project_id, language, isl""")
def resegment_cues(spark, sf):
    c, order = fx.cues(spark, sf)
    cut = F.regexp_replace("source_text", r"\.+$", "")
    c = c.withColumn("source_text", F.when(F.col("cue_id") % 2 == 0, cut).otherwise(F.col("source_text")))
    return qa.resegment(c, order)


@job("repetition_runs", """
+WITH i AS (SELECT *, cue_id - 0 AS c, ROW_NUMBER() OVER (PARTITION BY project_id ORDER BY cue_id)
    - ROW_NUMBER() OVER (PARTITION BY project_id, text ORDER BY cue_id) AS isl FROM x3)
SELECT project_id, MIN(cue_id) AS first_cue, MAX(cue_id) AS last_cue, text, COUNT(*) AS run_length
FROM i GROUP BY project_id, text, isl HAVING COUNT(*) >= 3""")
def repetition_runs(spark, sf):
    return qa.repetition_runs(*fx.sequences(spark, sf))


@job("retry_pick", """
+WITH i AS (SELECT *, CASE WHEN text = LAG(text) OVER (PARTITION BY project_id ORDER BY cue_id) THEN 1 ELSE 0 END AS same FROM x3),
a AS (SELECT project_id, cue_id // 1000 AS attempt, CAST(SUM(same) AS BIGINT) AS problems FROM i GROUP BY 1, 2)
SELECT project_id, attempt, problems, problems > 0 AS warning
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY project_id ORDER BY problems, attempt) AS rn FROM a) WHERE rn = 1""")
def retry_pick(spark, sf):
    t, order = fx.sequences(spark, sf)
    t = running(t, order, _prev=ordered.previous(F.col("text")))
    same = F.coalesce(F.col("text") == F.col("_prev"), F.lit(False)).cast("long")
    attempts = t.groupBy("project_id", F.floor(F.col("cue_id") / 1000).alias("attempt")).agg(F.sum(same).alias("problems"))
    return qa.pick_attempt(attempts, ["project_id"])


def _lexicon(spark):
    rows = [("religious", "than", 0), ("religious", "reux", 1), ("political", "oir", 0), ("political", "ung", 1)]
    return spark.createDataFrame(rows, "category string, term string, ord long")


@job("sensitive_flags", """
SELECT project_id, language, cue_id, category, arg_min(term, ord) AS term, 'note' AS severity
FROM x1 JOIN (VALUES ('religious','than',0), ('religious','reux',1), ('political','oir',0), ('political','ung',1)) l(category, term, ord)
  ON contains(source_text, term) GROUP BY project_id, language, cue_id, category""")
def sensitive_flags(spark, sf):
    c, _ = fx.cues(spark, sf)
    return glossary.sensitive_flags(c, _lexicon(spark))


# --- dub timeline ---------------------------------------------------------------------------------

PLACED = "project_id, language, cue_id, start_ms, end_ms, natural_ms, rendered_start_ms, rendered_end_ms"
PLACED_COLS = PLACED.split(", ")


@job("rendered_timeline", f"SELECT {PLACED} FROM rt")
def rendered_timeline(spark, sf):
    return timeline.rendered_timeline(*_measures(spark, sf)).select(*PLACED_COLS)


@job("still_image_timeline", f"""
+WITH l AS (SELECT *, CASE WHEN LAG(end_ms) OVER w IS NULL THEN GREATEST(0, start_ms)
    WHEN start_ms - LAG(end_ms) OVER w >= 700 THEN start_ms - LAG(end_ms) OVER w ELSE 0 END AS lead_ms
  FROM x1 WINDOW w AS (PARTITION BY project_id, language ORDER BY cue_id)),
p AS (SELECT *, CAST(SUM(lead_ms + natural_ms) OVER (PARTITION BY project_id, language ORDER BY cue_id) AS BIGINT) AS rendered_end_ms FROM l)
SELECT project_id, language, cue_id, start_ms, end_ms, natural_ms, rendered_end_ms - natural_ms AS rendered_start_ms, rendered_end_ms FROM p""")
def still_image_timeline(spark, sf):
    return timeline.still_image_timeline(*_measures(spark, sf)).select(*PLACED_COLS)


def _planned(spark, sf, trim):
    """Cue rows with their plan, the source lengths, and the order of both."""
    m, order = _measures(spark, sf)
    planned = timeline.freeze_plan(timeline.rendered_timeline(m, order), order, trim)
    return planned, fx.durations(m), order


def _events(spark, sf, trim):
    planned, source, order = _planned(spark, sf, trim)
    return timeline.plan_events(planned, source, trim), source, order


@job("freeze_plan_hold", "SELECT * FROM plan_hold")
def freeze_plan_hold(spark, sf):
    return _events(spark, sf, False)[0]


@job("freeze_plan_trim", "SELECT * FROM plan_trim")
def freeze_plan_trim(spark, sf):
    return _events(spark, sf, True)[0]


SUMMARY = """SELECT project_id, language, MAX(ABS(cumulative_ms)) AS max_abs_drift_ms, arg_max(cumulative_ms, cue_id) AS cumulative_offset_ms,
  CAST(SUM(over_tolerance::INT) AS BIGINT) AS cues_over_tolerance, COALESCE(MIN(CASE WHEN over_tolerance THEN cue_id END), -1) AS first_over_tolerance, COUNT(*) AS cues"""


@job("sync_report", f"""
+WITH s AS ({SUMMARY}, SUM(freeze_ms)::BIGINT AS freeze_ms FROM hold_drift GROUP BY project_id, language),
t AS (SELECT project_id, language, SUM(amount_ms)::BIGINT AS total_freeze_ms FROM plan_hold GROUP BY project_id, language),
g AS (SELECT project_id, language, MAX(duration_ms) AS max_silent_span_ms, COUNT(*) AS silent_spans FROM spans GROUP BY project_id, language)
SELECT s.* EXCLUDE (freeze_ms), COALESCE(total_freeze_ms, 0) AS total_freeze_ms, COALESCE(max_silent_span_ms, 0) AS max_silent_span_ms,
  COALESCE(silent_spans, 0) AS silent_spans FROM s LEFT JOIN t USING (project_id, language) LEFT JOIN g USING (project_id, language)""")
def sync_report(spark, sf):
    planned, source, order = _planned(spark, sf, False)
    events = timeline.plan_events(planned, source, False)
    summary = timeline.sync_summary(timeline.drift(planned, order))
    totals = events.groupBy(*TRACK).agg(F.sum("amount_ms").alias("total_freeze_ms"))
    gaps = timeline.silent_spans(planned, order).groupBy(*TRACK).agg(
        F.max("duration_ms").alias("max_silent_span_ms"), F.count(F.lit(1)).alias("silent_spans")
    )
    out = summary.join(totals, list(TRACK), "left").join(gaps, list(TRACK), "left")
    return out.fillna(0, ["total_freeze_ms", "max_silent_span_ms", "silent_spans"])


def _sync_report(planned, source, order, drifts, trim):
    """Summary with the totals of the plan (none for a still image) and the silent spans."""
    out = timeline.sync_summary(drifts)
    if source is not None:
        amount = lambda kind, name: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("amount_ms"))), F.lit(0)).alias(name)
        totals = timeline.plan_events(planned, source, trim).groupBy(*TRACK).agg(
            amount("freeze", "total_freeze_ms"), amount("trim", "total_trim_ms")
        )
        out = out.join(totals, list(TRACK), "left")
    else:
        out = out.withColumns({"total_freeze_ms": F.lit(0).cast("long"), "total_trim_ms": F.lit(0).cast("long")})
    gaps = timeline.silent_spans(planned, order).groupBy(*TRACK).agg(
        F.max("duration_ms").alias("max_silent_span_ms"), F.count(F.lit(1)).alias("silent_spans")
    )
    return out.join(gaps, list(TRACK), "left").fillna(0, ["total_freeze_ms", "total_trim_ms", "max_silent_span_ms", "silent_spans"])


@job("sync_report_trim", f"""
+WITH s AS ({SUMMARY} FROM trim_drift GROUP BY project_id, language),
t AS (SELECT project_id, language, COALESCE(SUM(amount_ms) FILTER (kind = 'freeze'), 0)::BIGINT AS total_freeze_ms,
  COALESCE(SUM(amount_ms) FILTER (kind = 'trim'), 0)::BIGINT AS total_trim_ms FROM plan_trim GROUP BY project_id, language),
g AS (SELECT project_id, language, MAX(duration_ms) AS max_silent_span_ms, COUNT(*) AS silent_spans FROM spans GROUP BY project_id, language)
SELECT s.*, COALESCE(total_freeze_ms, 0) AS total_freeze_ms, COALESCE(total_trim_ms, 0) AS total_trim_ms, COALESCE(max_silent_span_ms, 0) AS max_silent_span_ms,
  COALESCE(silent_spans, 0) AS silent_spans FROM s LEFT JOIN t USING (project_id, language) LEFT JOIN g USING (project_id, language)""")
def sync_report_trim(spark, sf):
    planned, source, order = _planned(spark, sf, True)
    return _sync_report(planned, source, order, timeline.drift(planned, order), True)


STILL_SPANS = """
st AS (SELECT *, rendered_end_ms - natural_ms AS rendered_start_ms FROM (
  SELECT *, CAST(SUM(lead_ms + natural_ms) OVER (PARTITION BY project_id, language ORDER BY cue_id) AS BIGINT) AS rendered_end_ms FROM (
    SELECT *, CASE WHEN LAG(end_ms) OVER w IS NULL THEN GREATEST(0, start_ms) WHEN start_ms - LAG(end_ms) OVER w >= 700 THEN start_ms - LAG(end_ms) OVER w ELSE 0 END AS lead_ms
    FROM x1 WINDOW w AS (PARTITION BY project_id, language ORDER BY cue_id)))),
gap AS (SELECT project_id, language, rendered_start_ms - p AS duration_ms
  FROM (SELECT *, COALESCE(MAX(rendered_end_ms) OVER (PARTITION BY project_id, language ORDER BY cue_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM st WHERE keep_source OR natural_ms > 1) a
  WHERE rendered_start_ms - p >= 250 AND NOT EXISTS (SELECT 1 FROM st k WHERE k.project_id = a.project_id AND k.language = a.language AND k.keep_source
    AND k.rendered_start_ms <= a.rendered_start_ms AND a.p <= k.rendered_end_ms))"""


@job("sync_report_still_image", f"""
+WITH {STILL_SPANS},
g AS (SELECT project_id, language, MAX(duration_ms) AS max_silent_span_ms, COUNT(*) AS silent_spans FROM gap GROUP BY project_id, language)
SELECT project_id, language, 0::BIGINT AS max_abs_drift_ms, 0::BIGINT AS cumulative_offset_ms, 0::BIGINT AS cues_over_tolerance, -1::BIGINT AS first_over_tolerance,
  cues, 0::BIGINT AS total_freeze_ms, 0::BIGINT AS total_trim_ms, COALESCE(max_silent_span_ms, 0) AS max_silent_span_ms, COALESCE(silent_spans, 0) AS silent_spans
FROM (SELECT project_id, language, COUNT(*) AS cues FROM st GROUP BY project_id, language) c LEFT JOIN g USING (project_id, language)""")
def sync_report_still_image(spark, sf):
    m, order = _measures(spark, sf)
    still = timeline.still_image_timeline(m, order)
    return _sync_report(still, None, order, timeline.no_drift(still), False)


SYNC_CUES = """SELECT project_id, language, cue_id, start_ms, end_ms, rendered_start_ms, rendered_end_ms, cumulative_ms AS drift_ms,
  ((natural_ms * 20000 + GREATEST(1, end_ms - start_ms)) // (2 * GREATEST(1, end_ms - start_ms))) / 10000.0::DOUBLE AS stretch_factor,
  over_tolerance, freeze_ms > 0 AS freeze_planned, freeze_ms, trim_ms > 0 AS trim_planned, trim_ms"""


@job("sync_cues", f"{SYNC_CUES} FROM hold_drift")
def sync_cues(spark, sf):
    planned, _, order = _planned(spark, sf, False)
    return timeline.sync_cues(timeline.drift(planned, order))


@job("sync_cues_trim", f"{SYNC_CUES} FROM trim_drift")
def sync_cues_trim(spark, sf):
    planned, _, order = _planned(spark, sf, True)
    return timeline.sync_cues(timeline.drift(planned, order))


@job("sync_report_reset", f"{SUMMARY} FROM reset_drift GROUP BY project_id, language")
def sync_report_reset(spark, sf):
    m, order = _measures(spark, sf)
    return timeline.sync_summary(timeline.drift_with_resets(timeline.rendered_timeline(m, order), order))


@job("sync_cues_reset", "SELECT project_id, language, cue_id, drift_ms, reset_here, cumulative_ms, over_tolerance FROM reset_drift")
def sync_cues_reset(spark, sf):
    m, order = _measures(spark, sf)
    d = timeline.drift_with_resets(timeline.rendered_timeline(m, order), order)
    return d.select(*TRACK, "cue_id", "drift_ms", "reset_here", "cumulative_ms", "over_tolerance")


@job("silent_spans", "SELECT * FROM spans")
def silent_spans(spark, sf):
    m, order = _measures(spark, sf)
    return timeline.silent_spans(timeline.rendered_timeline(m, order), order)


@job("audio_qa_decision", """
+WITH f AS (SELECT project_id, language, CASE WHEN freeze_ms > 1500 THEN 'major' ELSE 'note' END AS severity FROM hold_drift WHERE freeze_ms > 0
  UNION ALL SELECT project_id, language, 'major' FROM hold_drift WHERE over_tolerance
  UNION ALL SELECT project_id, language, 'blocker' FROM spans WHERE duration_ms > 6000)
SELECT d.project_id, d.language, COUNT(*) FILTER (severity = 'note') AS notes, COUNT(*) FILTER (severity = 'minor') AS minors,
  COUNT(*) FILTER (severity = 'major') AS majors, COUNT(*) FILTER (severity = 'blocker') AS blockers,
  CASE WHEN COUNT(*) FILTER (severity = 'blocker') > 0 THEN 'FAIL' WHEN COUNT(*) FILTER (severity = 'major') > 0 THEN 'CONDITIONAL_PASS' ELSE 'PASS' END AS decision
FROM (SELECT project_id, language FROM dur WHERE language <> 'de') d LEFT JOIN f ON f.project_id = d.project_id AND f.language = d.language
GROUP BY d.project_id, d.language""")
def audio_qa_decision(spark, sf):
    planned, source, order = _planned(spark, sf, False)
    spans = timeline.silent_spans(planned, order)
    findings = timeline.audio_findings(timeline.drift(planned, order), spans, max_freeze_ms=1500, silent_bar_ms=6000)
    dubbed = source.select(*TRACK).filter(F.col("language") != "de")  # dub-enabled tracks only
    return qa.decide(findings, dubbed, TRACK)


@job("retiming_windows", """
+RECURSIVE +WITH e AS (SELECT p.*, source_ms, ROW_NUMBER() OVER (PARTITION BY project_id, language ORDER BY at_ms, kind = 'freeze', tail, cue_id) AS n
  FROM plan_trim p JOIN dur USING (project_id, language)),
walk AS (SELECT project_id, language, source_ms, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS cur, CAST(0 AS BIGINT) AS net,
    CAST(NULL AS BIGINT) AS ws, CAST(NULL AS BIGINT) AS we, CAST(NULL AS BIGINT) AS off FROM dur
  UNION ALL
  SELECT w.project_id, w.language, w.source_ms, e.n,
    CASE WHEN kind = 'trim' THEN LEAST(at_ms + amount_ms, e.source_ms) ELSE GREATEST(w.cur, at_ms) END,
    w.net + CASE WHEN kind = 'trim' THEN at_ms - LEAST(at_ms + amount_ms, e.source_ms) ELSE amount_ms END,
    CASE WHEN at_ms > w.cur THEN w.cur END, CASE WHEN at_ms > w.cur THEN at_ms END, CASE WHEN at_ms > w.cur THEN w.cur + w.net END
  FROM walk w JOIN e ON e.project_id = w.project_id AND e.language = w.language AND e.n = w.n + 1),
fin AS (SELECT project_id, language, arg_max(cur, n) AS cur, arg_max(net, n) AS net, COUNT(ws) AS k, MAX(source_ms) AS d FROM walk GROUP BY project_id, language)
SELECT project_id, language, ws AS win_start_ms, we AS win_end_ms, off AS offset_ms FROM walk WHERE ws IS NOT NULL
UNION ALL SELECT project_id, language, cur, d, cur + net FROM fin WHERE d > cur
UNION ALL SELECT project_id, language, 0, GREATEST(d, 1), net FROM fin WHERE d <= cur AND k = 0""")
def retiming_windows(spark, sf):
    return timeline.retiming_windows(*_events(spark, sf, True))


RETIMED = """
+WITH e AS (SELECT project_id, language, at_ms, amount_ms, COALESCE(LAG(at_ms) OVER w, 0) AS cur,
    COALESCE(SUM(amount_ms) OVER (PARTITION BY project_id, language ORDER BY at_ms, tail, cue_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS net
  FROM plan_hold WINDOW w AS (PARTITION BY project_id, language ORDER BY at_ms, tail, cue_id)),
l AS (SELECT project_id, language, source_ms, COALESCE(MAX(at_ms), 0) AS cur, COALESCE(SUM(amount_ms), 0) AS net
  FROM dur LEFT JOIN plan_hold USING (project_id, language) GROUP BY ALL),
win AS (SELECT project_id, language, cur AS ws, at_ms AS we, cur + net AS off FROM e WHERE at_ms > cur
  UNION ALL SELECT project_id, language, cur, source_ms, cur + net FROM l WHERE source_ms > cur)
SELECT project_id, language, cue_id, CAST(GREATEST(start_ms, ws) - ws + off AS BIGINT) AS clip_start_ms, CAST(LEAST(end_ms, we) - ws + off AS BIGINT) AS clip_end_ms,
  ROW_NUMBER() OVER (PARTITION BY project_id, language ORDER BY ws, cue_id) - 1 AS new_id
FROM x1 JOIN win USING (project_id, language) WHERE start_ms < we AND end_ms > ws"""


@job("retimed_captions", RETIMED)
def retimed_captions(spark, sf):
    planned, source, order = _planned(spark, sf, False)
    windows = timeline.retiming_windows(timeline.plan_events(planned, source, False), source, order)
    cues = planned.select(*TRACK, "cue_id", "start_ms", "end_ms", *order.block)
    out = timeline.retimed_captions(cues, order, windows)
    return out.select(*TRACK, "cue_id", "clip_start_ms", "clip_end_ms", "new_id")


@job("respeed_timeline", """
SELECT project_id, language, cue_id, (start_ms * 2000 + f) // (f * 2) AS start_ms, (end_ms * 2000 + f) // (f * 2) AS end_ms,
  (natural_ms * 2000 + f) // (f * 2) AS natural_ms, language <> 'es' AS speed_ok
FROM (SELECT *, CASE language WHEN 'fr' THEN 850 WHEN 'de' THEN 1250 ELSE 1000 END AS f FROM x1)""")
def respeed_timeline(spark, sf):
    c, _ = fx.cues(spark, sf)
    factor = F.when(F.col("language") == "fr", 850).when(F.col("language") == "de", 1250)
    factor = factor.when(F.col("language") == "es", 99_000).otherwise(1000)
    out = timeline.respeed_timeline(c, factor.cast("long"))
    return out.select(*TRACK, "cue_id", "start_ms", "end_ms", "natural_ms", "speed_ok")


# --- long cues ------------------------------------------------------------------------------------

SLICES = """
+WITH w AS (SELECT project_id, cue_id, span_ms, k, 1 + (cue_id * (k + 3)) % 50 AS w, GREATEST(7000, CAST(ceil(span_ms / 12) AS BIGINT)) AS cap
  FROM x2 CROSS JOIN range(12) r(k)),
s AS (SELECT *, ROW_NUMBER() OVER d - 1 AS j, SUM(w) OVER (PARTITION BY project_id, cue_id) AS t,
    COALESCE(SUM(w) OVER (PARTITION BY project_id, cue_id ORDER BY w DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM w WINDOW d AS (PARTITION BY project_id, cue_id ORDER BY w DESC, k)),
c AS (SELECT *, (span_ms - j * cap) * w > cap * (t - used) AS capped FROM s),
a AS (SELECT *, COUNT(*) FILTER (capped) OVER (PARTITION BY project_id, cue_id) AS nc,
    COALESCE(SUM(w) FILTER (capped) OVER (PARTITION BY project_id, cue_id), 0) AS cw FROM c),
f AS (SELECT *, CASE WHEN capped THEN cap ELSE CAST((span_ms - nc * cap) * w AS BIGINT) // CAST(t - cw AS BIGINT) END AS fl FROM a),
h AS (SELECT *, span_ms - SUM(fl) OVER (PARTITION BY project_id, cue_id) AS lft,
    COALESCE(SUM(cap - fl) OVER (PARTITION BY project_id, cue_id ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after_room FROM f)
SELECT project_id, cue_id, k AS part, CAST(fl + GREATEST(0, LEAST(cap - fl, lft - after_room)) AS BIGINT) AS slice_ms FROM h"""


@job("split_slice_ms", SLICES)
def split_slice_ms(spark, sf):
    c, _ = fx.long_cues(spark, sf)
    weights = F.array(*[1 + (F.col("cue_id") * (k + 3)) % 50 for k in range(12)])
    lengths = split.slice_lengths(weights, F.col("span_ms"), F.lit(split.MAX_CUE_MS).cast("long"))
    out = c.select("project_id", "cue_id", F.posexplode(lengths).alias("part", "slice_ms"))
    return out.withColumn("part", F.col("part").cast("long"))


# chunks of one text of each cue; @ is the side, and txt@ its text
CHUNKS = r"""
tok@ AS (SELECT project_id, cue_id, n, span_ms, txt@ AS text, CASE WHEN len(sent@) >= n THEN sent@ ELSE word@ END AS toks FROM n),
t@ AS (SELECT project_id, cue_id, n, len(toks) AS m, unnest(range(1, len(toks) + 1)) AS i, unnest(toks) AS tk FROM tok@ WHERE n > 1),
u@ AS (SELECT *, CAST(SUM(length(tk)) OVER (PARTITION BY project_id, cue_id ORDER BY i) AS BIGINT) AS cum FROM t@),
tot@ AS (SELECT project_id, cue_id, n, m, MAX(cum) AS total FROM u@ GROUP BY ALL),
g@ AS (SELECT *, (total * (k + 1)) // n + CASE WHEN 2 * ((total * (k + 1)) % n) > n THEN 1 WHEN 2 * ((total * (k + 1)) % n) < n THEN 0
      ELSE ((total * (k + 1)) // n) % 2 END AS goal FROM (SELECT *, unnest(range(0, n - 1)) AS k FROM tot@)),
fk@ AS (SELECT g@.project_id, g@.cue_id, g@.n, g@.m, g@.k, u@.i AS f FROM g@ ASOF JOIN u@ ON g@.project_id = u@.project_id AND g@.cue_id = u@.cue_id AND g@.goal <= u@.cum),
b@ AS (SELECT *, LEAST(m - (n - 1 - k), MAX(f - k) OVER (PARTITION BY project_id, cue_id ORDER BY k) + k) AS e FROM fk@),
cut@ AS (SELECT project_id, cue_id, k, e FROM b@ UNION ALL SELECT project_id, cue_id, n - 1, m FROM tot@),
rng@ AS (SELECT *, COALESCE(LAG(e) OVER (PARTITION BY project_id, cue_id ORDER BY k), 0) AS s FROM cut@),
chunk@ AS (SELECT r.project_id, r.cue_id, r.k, array_to_string(tok@.toks[r.s + 1 : r.e], ' ') AS txt, n, span_ms FROM rng@ r JOIN tok@ USING (project_id, cue_id)
  UNION ALL SELECT project_id, cue_id, 0, text, 1, span_ms FROM tok@ WHERE n = 1)"""


def _tokens_sql(side: str) -> str:
    return rf"""list_filter(string_split(regexp_replace(txt_{side}, '([.!?؟۔…]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS sent_{side},
    list_filter(string_split(txt_{side}, ' '), lambda x: x <> '') AS word_{side}"""


@job("split_long_cues", rf"""
+WITH two AS (SELECT *, target_text AS txt_t, regexp_replace(target_text, '([aeiou])', '\1\1', 'g') AS txt_s FROM x2),
base AS (SELECT *, start_ms + span_ms AS end_ms, {_tokens_sql('t')}, {_tokens_sql('s')} FROM two),
n AS (SELECT *, GREATEST(1, LEAST(CAST(ceil(span_ms / 7000) AS BIGINT), len(word_t), len(word_s))) AS n FROM base),
{CHUNKS.replace('@', '_t')},
{CHUNKS.replace('@', '_s')},
w AS (SELECT *, CAST(length(txt) AS BIGINT) AS w, GREATEST(7000, CAST(ceil(span_ms / n) AS BIGINT)) AS cap FROM chunk_t),
s AS (SELECT *, ROW_NUMBER() OVER d - 1 AS j, CAST(SUM(w) OVER (PARTITION BY project_id, cue_id) AS BIGINT) AS t,
    CAST(COALESCE(SUM(w) OVER (PARTITION BY project_id, cue_id ORDER BY w DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used
  FROM w WINDOW d AS (PARTITION BY project_id, cue_id ORDER BY w DESC, k)),
c AS (SELECT *, n > 1 AND (span_ms - j * cap) * w > cap * (t - used) AS capped FROM s),
a AS (SELECT *, COUNT(*) FILTER (capped) OVER (PARTITION BY project_id, cue_id) AS nc,
    CAST(COALESCE(SUM(w) FILTER (capped) OVER (PARTITION BY project_id, cue_id), 0) AS BIGINT) AS cw FROM c),
fl AS (SELECT *, CASE WHEN n = 1 THEN span_ms WHEN capped THEN cap ELSE ((span_ms - nc * cap) * w) // (t - cw) END AS fl FROM a),
h AS (SELECT *, span_ms - SUM(fl) OVER (PARTITION BY project_id, cue_id) AS lft,
    COALESCE(SUM(cap - fl) OVER (PARTITION BY project_id, cue_id ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after_room FROM fl),
d AS (SELECT *, CAST(fl + GREATEST(0, LEAST(cap - fl, lft - after_room)) AS BIGINT) AS ms FROM h)
SELECT d.project_id, d.cue_id, d.k AS part, d.txt AS target_text, s.txt AS source_text, CAST(x2.start_ms + SUM(ms) OVER p - ms AS BIGINT) AS start_ms,
  CAST(x2.start_ms + SUM(ms) OVER p AS BIGINT) AS end_ms, ROW_NUMBER() OVER (PARTITION BY d.project_id ORDER BY d.cue_id, d.k) - 1 AS new_id
FROM d JOIN chunk_s s ON s.project_id = d.project_id AND s.cue_id = d.cue_id AND s.k = d.k JOIN x2 ON x2.project_id = d.project_id AND x2.cue_id = d.cue_id WINDOW p AS (PARTITION BY d.project_id, d.cue_id ORDER BY d.k)""")
def split_long_cues(spark, sf):
    c, order = fx.long_cues(spark, sf)
    c = c.withColumns({"end_ms": F.col("start_ms") + F.col("span_ms"), "source_text": F.regexp_replace("target_text", "([aeiou])", "$1$1")})
    out = split.split_long_cues(c.drop("span_ms"), order)
    return out.select("project_id", "cue_id", "part", "target_text", "source_text", "start_ms", "end_ms", "new_id")


# --- rendering ------------------------------------------------------------------------------------

LINES = r"""
+WITH t AS (SELECT *, trim(regexp_replace(target_text, '\s+', ' ', 'g')) AS t FROM x1),
h AS (SELECT *, CASE WHEN regexp_extract(t, '^(.{1,42})(?: |$)', 1) <> '' THEN regexp_extract(t, '^(.{1,42})(?: |$)', 1) ELSE regexp_extract(t, '^(\S+)', 1) END AS h FROM t),
l AS (SELECT *, h || CASE WHEN trim(substr(t, length(h) + 1)) = '' THEN '' ELSE chr(10) || trim(substr(t, length(h) + 1)) END AS body FROM h)"""


def _clock_sql(ms: str, mark: str) -> str:
    return f"format('{{:02d}}:{{:02d}}:{{:02d}}{mark}{{:03d}}', {ms} // 3600000, ({ms} // 60000) % 60, ({ms} // 1000) % 60, {ms} % 1000)"


@job("wrapped_srt", LINES + f"""
SELECT project_id, language, CAST(0 AS BIGINT) AS part, string_agg(CAST(cue_id + 1 AS VARCHAR) || chr(10) || {_clock_sql('start_ms', ',')} || ' --> ' ||
  {_clock_sql('end_ms', ',')} || chr(10) || body || chr(10) || chr(10), '' ORDER BY cue_id) AS text FROM l GROUP BY project_id, language""")
def wrapped_srt(spark, sf):
    return captions.render(fx.cues(spark, sf)[0], "srt")


@job("wrapped_vtt", LINES + f"""
SELECT project_id, language, CAST(0 AS BIGINT) AS part, 'WEBVTT' || chr(10) || chr(10) || string_agg({_clock_sql('start_ms', '.')} || ' --> ' ||
  {_clock_sql('end_ms', '.')} || chr(10) || body || chr(10) || chr(10), '' ORDER BY cue_id) AS text FROM l GROUP BY project_id, language""")
def wrapped_vtt(spark, sf):
    return captions.render(fx.cues(spark, sf)[0], "vtt")


@job("srt_roundtrip", r"""
SELECT project_id, language, cue_id + 1 AS cue_no, start_ms, end_ms, trim(regexp_replace(target_text, '\s+', ' ', 'g')) AS text FROM x1""")
def srt_roundtrip(spark, sf):
    return _roundtrip(spark, sf, "srt").select("project_id", "language", "cue_no", "start_ms", "end_ms", "text")


@job("vtt_roundtrip", r"""
SELECT project_id, language, start_ms, end_ms, trim(regexp_replace(target_text, '\s+', ' ', 'g')) AS text FROM x1""")
def vtt_roundtrip(spark, sf):
    return _roundtrip(spark, sf, "vtt").select("project_id", "language", "start_ms", "end_ms", "text")


def _roundtrip(spark, sf, fmt: str):
    folder = f"{shared_dir(spark)}/{fmt}-{uuid.uuid4().hex}"
    captionfiles.write_captions(captions.blocks(fx.cues(spark, sf)[0], fmt), folder, fmt)
    rows = captions.parse_blocks(captionfiles.read_captions(spark, folder, fmt))
    return rows.withColumn("project_id", F.col("project_id").cast("long"))


# --- caption, glossary and translation checks -----------------------------------------------------

@job("caption_qa", r"""
+WITH r AS (SELECT *, trim(target_text) = '' AS empty, CASE WHEN trim(regexp_replace(target_text, '\s+', ' ', 'g')) = '' THEN 0
    ELSE len(string_split(trim(regexp_replace(target_text, '\s+', ' ', 'g')), ' ')) END AS n, end_ms - start_ms AS span FROM x1b),
f AS (SELECT *, CASE WHEN span > 0 THEN n * 60000 // span END AS rate, span > 0 AND n > 180 * (span / 60000.0) AS fast FROM r),
m AS (SELECT project_id, language, COUNT(*) AS cue_count, COALESCE(MAX(rate), 0) AS max_rate, CAST(SUM(empty::INT) AS BIGINT) AS empty, CAST(SUM((span <= 0)::INT) AS BIGINT) AS backwards,
  CAST(SUM(fast::INT) AS BIGINT) AS too_fast, CAST(SUM((span > 7000)::INT) AS BIGINT) AS very_long FROM f GROUP BY project_id, language)
SELECT *, 'latin' AS script_class, CASE WHEN empty + backwards > 0 THEN 'FAIL' WHEN too_fast > 0 THEN 'CONDITIONAL_PASS' ELSE 'PASS' END AS decision FROM m""")
def caption_qa(spark, sf):
    c, _ = fx.untidy_cues(spark, sf)
    return qa.caption_decision(qa.caption_checks(c), c.select(*TRACK).distinct())


def _terms(spark):
    rows = [
        ("en", "th", "TH", "", True), ("en", "on", "ON", "", False), ("fr", "eau", "EAU", "eau", True),
        ("de", "sch", "SCH", "", False), ("es", "en", "EN", "", True),
    ]
    t = spark.createDataFrame(rows, "language string, term string, rendering string, alias string, must_appear boolean")
    return t.select("language", "term", F.array("rendering", "alias").alias("renderings"), "must_appear")


@job("glossary_check", """
+WITH o AS (SELECT project_id, x1.language, must_appear, contains(target_text, rendering) OR (alias <> '' AND contains(target_text, alias)) AS hit
  FROM x1 JOIN x9 ON x1.language = x9.language AND contains(source_text, term)),
m AS (SELECT d.project_id, d.language, COUNT(*) FILTER (must_appear) AS required_occurrences, COUNT(*) FILTER (must_appear AND hit) AS required_hits,
  COUNT(*) FILTER (NOT must_appear AND NOT hit) AS preferred_misses
  FROM dur d LEFT JOIN o ON o.project_id = d.project_id AND o.language = d.language GROUP BY d.project_id, d.language)
SELECT *, CASE WHEN required_occurrences > 0 THEN ROUND(required_hits / required_occurrences, 6) ELSE 1.0 END AS required_hit_rate,
  CASE WHEN required_occurrences > required_hits THEN 'FAIL' ELSE 'PASS' END AS decision FROM m""")
def glossary_check(spark, sf):
    c, _ = fx.cues(spark, sf)
    found = glossary.glossary_occurrences(c, _terms(spark))
    return glossary.glossary_metrics(found, c.select(*TRACK).distinct())


TRANSLATION_SQL = r"""
+WITH f AS (SELECT project_id, language, cue_id, CASE WHEN trim(target_text) = '' THEN 'empty-target'
   WHEN trim(target_text) = trim(source_text) AND len(string_split(trim(regexp_replace(source_text, '\s+', ' ', 'g')), ' ')) > 1 THEN 'identical-to-source' END AS category FROM x1)"""


@job("translation_qa", TRANSLATION_SQL + """
, g AS (SELECT *, CASE category WHEN 'empty-target' THEN 'blocker' ELSE 'major' END AS severity FROM f WHERE category IS NOT NULL)
SELECT d.project_id, d.language, COUNT(*) FILTER (severity = 'note') AS notes, COUNT(*) FILTER (severity = 'minor') AS minors,
  COUNT(*) FILTER (severity = 'major') AS majors, COUNT(*) FILTER (severity = 'blocker') AS blockers,
  CASE WHEN COUNT(*) FILTER (severity = 'blocker') > 0 THEN 'FAIL' WHEN COUNT(*) FILTER (severity = 'major') > 0 THEN 'CONDITIONAL_PASS' ELSE 'PASS' END AS decision
FROM dur d LEFT JOIN g ON g.project_id = d.project_id AND g.language = d.language GROUP BY d.project_id, d.language""")
def translation_qa(spark, sf):
    c, _ = fx.cues(spark, sf)
    return qa.decide(qa.translation_findings(c), c.select(*TRACK).distinct(), TRACK)


@job("translation_report", TRANSLATION_SQL + """
, tr AS (SELECT project_id, language FROM dur UNION SELECT project_id, 'ur' FROM dur WHERE project_id % 2 = 0),
g AS (SELECT project_id, CASE category WHEN 'empty-target' THEN 'blocker' ELSE 'major' END AS severity FROM f WHERE category IS NOT NULL
  UNION ALL SELECT project_id, 'blocker' FROM x1 WHERE project_id % 2 = 0 AND cue_id % 50 = 49),
n AS (SELECT project_id, COUNT(*) FILTER (severity = 'major') AS majors, COUNT(*) FILTER (severity = 'blocker') AS blockers FROM g GROUP BY project_id)
SELECT tr.project_id, string_agg(language, ',' ORDER BY language) AS languages, COALESCE(ANY_VALUE(majors), 0) AS majors, COALESCE(ANY_VALUE(blockers), 0) AS blockers,
  CASE WHEN ANY_VALUE(blockers) > 0 THEN 'FAIL' WHEN ANY_VALUE(majors) > 0 THEN 'CONDITIONAL_PASS' ELSE 'PASS' END AS decision
FROM tr LEFT JOIN n ON n.project_id = tr.project_id GROUP BY tr.project_id""")
def translation_report(spark, sf):
    """Each project's own language, and in every second project another one with a gap now and then."""
    c, _ = fx.cues(spark, sf)
    gap = F.when(F.col("cue_id") % 50 == 49, F.lit("")).otherwise(F.concat(F.lit("ur "), "source_text"))
    other = c.filter(F.col("project_id") % 2 == 0).withColumns({"language": F.lit("ur"), "target_text": gap})
    c = c.unionByName(other).select(*TRACK, "cue_id", "source_text", "target_text")
    r = qa.translation_report(qa.translation_findings(c), c.select(*TRACK).distinct())
    return r.select("project_id", F.array_join("languages", ",").alias("languages"), "majors", "blockers", "decision")


@job("gloss_context", """
+WITH g AS (SELECT *, (project_id + cue_id) % 13 = 0 AS mism FROM x1 WHERE language <> 'de'),
f AS (SELECT project_id, language, 'note' AS severity FROM g WHERE trim(target_text) = trim(source_text) AND contains(trim(source_text), ' ')
  UNION ALL SELECT project_id, language, 'note' FROM g WHERE trim(target_text) <> '' AND length(trim(source_text)) > 0
    AND (length(trim(target_text)) < 0.2 * length(trim(source_text)) OR length(trim(target_text)) > 1.02 * length(trim(source_text)))
  UNION ALL SELECT project_id, language, 'major' FROM g WHERE mism UNION ALL SELECT project_id, language, 'note' FROM g WHERE mism AND cue_id % 2 = 0),
p AS (SELECT project_id, language, COUNT(*) AS n, COUNT(*) FILTER (severity = 'major') AS majors FROM f GROUP BY project_id, language)
SELECT d.project_id, d.language, d.language <> 'de' AS gloss_present, COALESCE(n, 0) AS gloss_context_findings,
  CASE WHEN COALESCE(majors, 0) > 0 THEN 'CONDITIONAL_PASS' ELSE 'PASS' END AS decision
FROM dur d LEFT JOIN p ON p.project_id = d.project_id AND p.language = d.language""")
def gloss_context(spark, sf):
    c, _ = fx.cues(spark, sf)
    report = c.select(*TRACK).distinct().withColumn("decision", F.lit("PASS"))
    mark = (F.col("project_id") + F.col("cue_id")) % 13 == 0
    gloss = c.filter(F.col("language") != "de").withColumns({
        "flags": F.when(mark, F.array(F.lit("context-mismatch"))).otherwise(F.array().cast("array<string>")),
        "context_note": F.when(mark & (F.col("cue_id") % 2 == 0), "unclear"),
    })
    findings = qa.gloss_findings(gloss, min_ratio=0.2, max_ratio=1.02)
    return qa.fold_gloss(report, gloss.select(*TRACK).distinct(), findings)


LEAKY = """CASE cue_id % 4 WHEN 0 THEN concat(target_text, ' «سلام»') WHEN 1 THEN concat(target_text, ' سلام')
 WHEN 2 THEN concat(target_text, ' «ok»') ELSE target_text END"""


@job("script_leaks", f"""
SELECT project_id, language, cue_id, CASE WHEN trim(t) = '' THEN 'empty' ELSE 'script-leak' END AS problem FROM (
  SELECT project_id, CASE WHEN project_id % 5 = 0 THEN 'ur' ELSE language END AS language, cue_id, {LEAKY} AS t FROM x1)
WHERE trim(t) = '' OR regexp_matches(t, '«[^»]*[؀-ۿ][^»]*»') OR (language <> 'ur' AND regexp_matches(regexp_replace(t, '«[^»]*»', '', 'g'), '[؀-ۿ]'))""")
def script_leaks(spark, sf):
    c, _ = fx.cues(spark, sf)
    k, t = F.col("cue_id") % 4, F.col("target_text")
    leaky = F.when(k == 0, F.concat(t, F.lit(" «سلام»"))).when(k == 1, F.concat(t, F.lit(" سلام"))).when(
        k == 2, F.concat(t, F.lit(" «ok»"))
    ).otherwise(t)
    language = F.when(F.col("project_id") % 5 == 0, "ur").otherwise(F.col("language"))
    c = c.select("project_id", language.alias("language"), "cue_id", leaky.alias("t"))
    problem = F.when(F.trim("t") == "", "empty").when(tx.leaks_script(F.col("t"), F.col("language")), "script-leak")
    return c.withColumn("problem", problem).filter(F.col("problem").isNotNull()).drop("t")


@job("strip_citations", r"""
SELECT project_id, language, cue_id, trim(regexp_replace(regexp_replace(
  concat(source_text, ' (Quran ', project_id, ':', cue_id, ') ', target_text), '\s*\(Quran[^)]*\)', '', 'g'), '\s+', ' ', 'g')) AS spoken FROM x1""")
def strip_citations(spark, sf):
    c, _ = fx.cues(spark, sf)
    cited = F.concat("source_text", F.lit(" (Quran "), "project_id", F.lit(":"), "cue_id", F.lit(") "), "target_text")
    return c.select(*TRACK, "cue_id", tx.strip_citations(cited).alias("spoken"))


# --- worksheets -----------------------------------------------------------------------------------

@job("caption_fanout", """
+WITH r AS (SELECT DISTINCT project_id, language, unnest([language, 'en', 'fa']) AS target_language FROM x1)
SELECT x1.project_id, x1.language, target_language, cue_id, start_ms, end_ms,
  CASE WHEN target_language = x1.language THEN source_text WHEN target_language = 'en' THEN target_text END AS target_text
FROM x1 JOIN r ON r.project_id = x1.project_id""")
def caption_fanout(spark, sf):
    c, _ = fx.cues(spark, sf)
    asked = c.select("project_id", F.explode(F.array("language", F.lit("en"), F.lit("fa"))).alias("target_language")).distinct()
    given = c.select("project_id", F.lit("en").alias("language"), "cue_id", F.col("target_text").alias("text"))
    out = captions.fan_out(c, asked, given)
    return out.select("project_id", "language", "target_language", "cue_id", "start_ms", "end_ms", "target_text")


@job("worksheet_export", """
+WITH s AS (SELECT DISTINCT project_id, cue_id, category FROM x1
  JOIN (VALUES ('religious','than'), ('religious','reux'), ('political','oir'), ('political','ung')) l(category, term) ON contains(source_text, term))
SELECT x1.project_id, x1.language, x1.cue_id, start_ms, end_ms, '' AS target_text,
  COALESCE(string_agg('editorial-' || category, ',' ORDER BY category), '') AS flags
FROM x1 LEFT JOIN s ON s.project_id = x1.project_id AND s.cue_id = x1.cue_id WHERE x1.cue_id % 6 <> 5 GROUP BY ALL""")
def worksheet_export(spark, sf):
    c, _ = fx.cues(spark, sf)
    done = c.filter(F.col("cue_id") % 6 == 5).select(*TRACK, "cue_id")  # rows already in the worksheet
    out = captions.export_worksheet(c, glossary.sensitive_flags(c, _lexicon(spark)), done)
    return out.select(*TRACK, "cue_id", "start_ms", "end_ms", "target_text", F.array_join("flags", ",").alias("flags"))


@job("worksheet_import", """
SELECT project_id, language, cue_id, start_ms, end_ms, target_text,
  bool_or(trim(target_text) = '') OVER (PARTITION BY project_id, language) AS rejected FROM x1""")
def worksheet_import(spark, sf):
    c, _ = fx.cues(spark, sf)
    filled = c.select(*TRACK, "cue_id", "target_text")
    out = captions.import_worksheet(c, filled)
    return out.select(*TRACK, "cue_id", "start_ms", "end_ms", "target_text", "rejected")


@job("verse_reconcile", """
SELECT project_id, language, cue_id, CASE WHEN cue_id % 3 = 0 AND trim(source_text) <> '' THEN trim(source_text) ELSE target_text END AS target_text,
  cue_id % 3 = 0 AND trim(source_text) <> '' AS overridden FROM x1""")
def verse_reconcile(spark, sf):
    c, _ = fx.cues(spark, sf)
    verses = c.filter(F.col("cue_id") % 3 != 2).select(
        *TRACK, "cue_id", F.when(F.col("cue_id") % 3 == 0, F.col("source_text")).otherwise("  ").alias("modified_translation")
    )
    return captions.reconcile_overrides(c, verses).select(*TRACK, "cue_id", "target_text", "overridden")


# --- clips ----------------------------------------------------------------------------------------

SNAPPED = """
+WITH b AS (SELECT DISTINCT project_id, unnest([start_ms, end_ms]) AS boundary_ms FROM x1),
e AS (SELECT project_id, idx, 0 AS side, req_start_ms AS at_ms FROM x4s WHERE NOT exact UNION ALL SELECT project_id, idx, 1, req_end_ms FROM x4s WHERE NOT exact),
n AS (SELECT e.project_id, idx, side, at_ms, arg_min(boundary_ms, abs(boundary_ms - at_ms) * 100000000 + boundary_ms) AS near_ms
  FROM e LEFT JOIN b ON b.project_id = e.project_id AND abs(boundary_ms - at_ms) <= 2000 GROUP BY e.project_id, idx, side, at_ms)"""


@job("edge_snap", SNAPPED + " SELECT project_id, idx * 2 + side AS edge_id, at_ms, COALESCE(near_ms, at_ms) AS snapped_ms, near_ms IS NOT NULL AS has_candidate FROM n")
def edge_snap(spark, sf):
    c, _ = fx.cues(spark, sf)
    s = fx.selections(spark, sf)[0].filter(~F.col("exact"))
    t = intervals.parse_timecode
    edges = s.select("project_id", "idx", F.posexplode(F.array(t(F.col("start")), t(F.col("end")))).alias("side", "at_ms"))
    edges = edges.select("project_id", (F.col("idx") * 2 + F.col("side")).alias("edge_id"), "at_ms")
    return intervals.snap_edges(edges, intervals.cue_boundaries(c))


RESOLVED = SNAPPED + """,
r AS (SELECT s.*, COALESCE(a.near_ms, req_start_ms) AS start_ms, COALESCE(z.near_ms, req_end_ms) AS end_ms FROM x4s s
  LEFT JOIN n a ON a.project_id = s.project_id AND a.idx = s.idx AND a.side = 0 LEFT JOIN n z ON z.project_id = s.project_id AND z.idx = s.idx AND z.side = 1),
res AS (SELECT r.project_id, idx, id, start_ms, end_ms, exact, start_ms <> req_start_ms OR end_ms <> req_end_ms AS snapped,
  CASE WHEN source_ms IS NULL THEN 'unknown-project' WHEN COUNT(*) OVER (PARTITION BY r.project_id, id) > 1 THEN 'duplicate-id'
   WHEN end_ms <= start_ms THEN 'end-not-after-start' WHEN end_ms > source_ms THEN 'out-of-bounds' ELSE 'ok' END AS status,
  COALESCE(start_ms < LAG(start_ms) OVER (PARTITION BY r.project_id ORDER BY idx), false) AS out_of_order,
  COALESCE(start_ms < MAX(end_ms) OVER (PARTITION BY r.project_id ORDER BY start_ms, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS overlaps
FROM r LEFT JOIN dur d ON d.project_id = r.project_id)"""


def _segments(spark, sf):
    c, order = fx.cues(spark, sf)
    picked, listed = fx.selections(spark, sf)
    return intervals.resolve_segments(picked, listed, c, fx.durations(c)), c, order


@job("resolve_segments", RESOLVED + " SELECT * FROM res")
def resolve_segments(spark, sf):
    return _segments(spark, sf)[0].select(
        "project_id", "idx", "id", "start_ms", "end_ms", "exact", "snapped", "status", "out_of_order", "overlaps"
    )


def _clip_windows(segs, *more):
    return segs.filter(F.col("status") == "ok").select(
        "project_id", F.col("idx").alias("clip"), "idx", F.col("start_ms").alias("win_start_ms"), F.col("end_ms").alias("win_end_ms"), *more
    )


def arrange_clips(windows, listed: Order):
    """Clips in list order; cut into blocks only where selections were."""
    if not listed.block:
        return windows, Order(("project_id",), ("idx",))
    return ordered.arrange(windows, ("project_id",), ("idx",))


CLIP = """ SELECT x1.project_id, clip, cue_id, GREATEST(start_ms, ws) - ws + off AS clip_start_ms, LEAST(end_ms, we) - ws + off AS clip_end_ms,
  ROW_NUMBER() OVER (PARTITION BY x1.project_id, clip ORDER BY cue_id) - 1 AS clip_cue_id
FROM x1 JOIN win ON win.project_id = x1.project_id AND start_ms < we AND end_ms > ws"""
CLIP_COLS = ["project_id", "clip", "cue_id", "clip_start_ms", "clip_end_ms", "clip_cue_id"]


@job("clip_captions", RESOLVED + ", win AS (SELECT project_id, idx AS clip, start_ms AS ws, end_ms AS we, 0 AS off FROM res WHERE status = 'ok')" + CLIP)
def clip_captions(spark, sf):
    segs, c, order = _segments(spark, sf)
    windows = intervals.seam_offsets(_clip_windows(segs), None)
    c = c.select("project_id", "cue_id", "start_ms", "end_ms", *order.block)
    return intervals.clip_captions(c, order, windows).select(*CLIP_COLS)


@job("clip_transcripts", RESOLVED + ", win AS (SELECT project_id, idx AS clip, id, start_ms AS ws, end_ms AS we FROM res WHERE status = 'ok')" + """
SELECT x1.project_id, clip AS segment_index, win.id AS segment_id, ws AS source_start_ms, we AS source_end_ms, (we - ws) / 1000.0::DOUBLE AS duration_seconds,
  ROW_NUMBER() OVER (PARTITION BY x1.project_id, clip ORDER BY cue_id) - 1 AS id, GREATEST(start_ms, ws) - ws AS start_ms, LEAST(end_ms, we) - ws AS end_ms, source_text AS text
FROM x1 JOIN win ON win.project_id = x1.project_id AND start_ms < we AND end_ms > ws""")
def clip_transcripts(spark, sf):
    """Transcripts of the clips as documents, written and read back: cues in clip time, and where the clip comes from."""
    segs, c, order = _segments(spark, sf)
    named = intervals.seam_offsets(_clip_windows(segs, F.col("id").alias("segment_id")), None)
    cues = intervals.clip_captions(c.select("project_id", "cue_id", "start_ms", "end_ms", "source_text", *order.block), order, named)
    folder = f"{shared_dir(spark)}/clip-transcripts-{uuid.uuid4().hex}"
    keys = ["project_id", "clip", "segment_id", "win_start_ms", "win_end_ms"]
    items = {"id": F.col("clip_cue_id"), "start_ms": F.col("clip_start_ms"), "end_ms": F.col("clip_end_ms"), "text": F.col("source_text")}
    documents.write_cue_documents(cues, folder, keys, items, header={
        "segment": F.struct(
            F.col("clip").alias("index"), F.col("segment_id").alias("id"),
            F.col("win_start_ms").alias("source_start_ms"), F.col("win_end_ms").alias("source_end_ms")),
        "duration_seconds": (F.col("win_end_ms") - F.col("win_start_ms")) / 1000.0,
    })
    return documents.read_clip_transcripts(spark, folder)


@job("joined_seams", RESOLVED + """, win AS (SELECT project_id, idx AS clip, start_ms AS ws, end_ms AS we,
  CAST(COALESCE(SUM(end_ms - start_ms) OVER (PARTITION BY project_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
  FROM res WHERE status = 'ok')""" + CLIP)
def joined_seams(spark, sf):
    segs, c, order = _segments(spark, sf)
    windows, listed = arrange_clips(_clip_windows(segs), fx.selections(spark, sf)[1])
    windows = unblock(intervals.seam_offsets(windows, listed), listed)
    c = c.select("project_id", "cue_id", "start_ms", "end_ms", *order.block)
    return intervals.clip_captions(c, order, windows).select(*CLIP_COLS)


# --- chapters -------------------------------------------------------------------------------------

@job("chapter_candidates", """
SELECT project_id, language, 0 AS start_ms FROM dur UNION SELECT project_id, language, start_ms FROM (
  SELECT *, start_ms - LAG(end_ms) OVER (PARTITION BY project_id, language ORDER BY cue_id) AS gap FROM x1) WHERE gap >= 1200""")
def chapter_candidates(spark, sf):
    c, order = fx.cues(spark, sf)
    return chapters.candidates(c.select(*TRACK, "cue_id", "start_ms", "end_ms", *order.block), order, gap_ms=1200)


CHAPTERS = """
+WITH c AS (SELECT project_id, language, cue_id, CASE WHEN cue_id = 0 AND project_id % 4 <> 1 THEN 0 WHEN cue_id = 3 AND project_id % 4 = 2 THEN 0 ELSE start_ms END AS start_ms,
  CASE WHEN project_id % 7 = 3 AND cue_id = 2 THEN '  ' ELSE concat('Part ', cue_id) END AS title FROM x1)"""


def _chapters(spark, sf):
    c, order = fx.cues(spark, sf)
    p, i = F.col("project_id"), F.col("cue_id")
    start = F.when((i == 0) & (p % 4 != 1), 0).when((i == 3) & (p % 4 == 2), 0).otherwise(F.col("start_ms"))
    title = F.when((p % 7 == 3) & (i == 2), "  ").otherwise(F.concat(F.lit("Part "), i.cast("string")))
    rows = c.select(*TRACK, "cue_id", *order.block, start.alias("start_ms"), title.alias("title"))
    return rows, order, fx.durations(c)


@job("chapter_validation", CHAPTERS + """
, v AS (SELECT c.*, source_ms, LAG(start_ms) OVER (PARTITION BY project_id, language ORDER BY cue_id) AS p FROM c JOIN dur USING (project_id, language))
SELECT project_id, language, cue_id, CASE WHEN p IS NULL AND start_ms <> 0 THEN 'first-not-at-zero' WHEN start_ms <= p THEN 'not-increasing'
  WHEN start_ms >= source_ms THEN 'beyond-duration' WHEN trim(title) = '' THEN 'blank-title' END AS problem
FROM v WHERE (p IS NULL AND start_ms <> 0) OR start_ms <= p OR start_ms >= source_ms OR trim(title) = ''""")
def chapter_validation(spark, sf):
    rows, order, source = _chapters(spark, sf)
    return chapters.problems(rows, order, source)


@job("chapter_timecodes", CHAPTERS + """
SELECT project_id, language, CAST(0 AS BIGINT) AS part, string_agg(CASE WHEN s >= 3600 THEN format('{:d}:{:02d}:{:02d}', s // 3600, (s // 60) % 60, s % 60) ELSE format('{:d}:{:02d}', s // 60, s % 60) END
  || ' ' || title, chr(10) ORDER BY cue_id) AS text FROM (SELECT *, start_ms * 100 // 1000 AS s FROM c) GROUP BY project_id, language""")
def chapter_timecodes(spark, sf):
    rows, _, _ = _chapters(spark, sf)
    return chapters.description(rows.withColumn("start_ms", F.col("start_ms") * 100))


# --- package files --------------------------------------------------------------------------------

def _timing_sql(mark: str) -> str:
    return f"{_clock_sql('start_ms', mark)} || ' --> ' || {_clock_sql('end_ms', mark)} || chr(10) || body || chr(10) || chr(10)"


@job("package_files", LINES + f""",
tracks AS (SELECT DISTINCT project_id, language, project_id % 3 AS mode, project_id % 5 <> 0 AS dub, CASE WHEN project_id % 4 = 0 THEN 'unreviewed' ELSE 'licensed' END AS rights FROM x1),
units AS (SELECT *, CASE WHEN mode = 1 THEN k END AS clip_index FROM tracks, (SELECT unnest([0, 1]) AS k) WHERE mode = 1 OR k = 0),
win AS (SELECT project_id, k, CAST(k * 40000 AS BIGINT) AS ws, CAST(k * 40000 + 30000 AS BIGINT) AS we, CASE WHEN mode = 2 THEN CAST(k * 30000 AS BIGINT) ELSE 0 END AS off, mode
  FROM tracks, (SELECT unnest([0, 1]) AS k) WHERE mode > 0),
cut AS (SELECT l.project_id, l.language, CASE WHEN w.mode = 1 THEN w.k END AS clip_index, w.k, cue_id, GREATEST(start_ms, ws) - ws + off AS start_ms, LEAST(end_ms, we) - ws + off AS end_ms, body
  FROM l JOIN win w ON w.project_id = l.project_id AND start_ms < we AND end_ms > ws),
c AS (SELECT project_id, language, NULL AS clip_index, cue_id AS n, start_ms, end_ms, body FROM l WHERE project_id % 3 = 0
  UNION ALL SELECT project_id, language, clip_index, ROW_NUMBER() OVER (PARTITION BY project_id, language, clip_index ORDER BY k, cue_id) - 1, start_ms, end_ms, body FROM cut),
f AS (SELECT project_id, language, clip_index, 'captions-srt' AS kind, string_agg(CAST(n + 1 AS VARCHAR) || chr(10) || {_timing_sql(',')}, '' ORDER BY n) AS t FROM c GROUP BY ALL
  UNION ALL SELECT project_id, language, clip_index, 'captions-vtt', string_agg({_timing_sql('.')}, '' ORDER BY n) FROM c GROUP BY ALL),
files AS (SELECT u.project_id, u.language, u.clip_index, k.kind, CASE WHEN k.kind = 'captions-vtt' THEN 'WEBVTT' || chr(10) || chr(10) ELSE '' END || COALESCE(f.t, '') AS t
  FROM units u CROSS JOIN (SELECT unnest(['captions-srt', 'captions-vtt']) AS kind) k
  LEFT JOIN f ON f.project_id = u.project_id AND f.language = u.language AND f.clip_index IS NOT DISTINCT FROM u.clip_index AND f.kind = k.kind
  UNION ALL SELECT project_id, language, NULL, 'readme', '# ' || project_id || chr(10) || chr(10) || 'Language: ' || language || chr(10) || 'Dubbed: ' || CASE WHEN dub THEN 'yes' ELSE 'no' END ||
    chr(10) || 'Rights: ' || rights || chr(10) || CASE WHEN rights = 'licensed' THEN '' ELSE chr(10) || '**NOT CLEARED FOR DISTRIBUTION**' || chr(10) END FROM tracks)
SELECT project_id, language, CAST(clip_index AS INTEGER) AS clip_index, kind, octet_length(encode(t))::BIGINT AS bytes, sha256(t) AS sha256 FROM files
UNION ALL SELECT project_id, language, clip_index, CASE mode WHEN 0 THEN 'dubbed-video' WHEN 1 THEN 'clip-video' ELSE 'joined-video' END, NULL,
  'sha256:' || sha256(concat(project_id, '/', language, '/', COALESCE(clip_index, -1))) FROM units WHERE dub""")
def package_files(spark, sf):
    """Whole videos, single clips and joined clips by project, with two windows of half a minute where clips are asked for."""
    c, order = fx.cues(spark, sf)
    c = c.select(*TRACK, "cue_id", "start_ms", "end_ms", "target_text", *order.block)
    mode, clip = F.col("project_id") % 3, F.col("clip")
    tracks = c.select(*TRACK).distinct().withColumns({"mode": mode, "clip": F.explode(F.array(F.lit(0), F.lit(1)))})
    own = F.when(F.col("mode") == 1, F.col("clip"))
    units = tracks.filter((F.col("mode") == 1) | (clip == 0)).withColumn("clip_index", own)
    name = F.concat_ws("/", F.col("project_id").cast("string"), "language", F.coalesce("clip_index", F.lit(-1)).cast("string"))
    units = units.select(
        *TRACK, "clip_index", (F.col("mode") == 2).alias("joined"), (F.col("project_id") % 5 != 0).alias("dub_enabled"),
        F.concat(F.lit("sha256:"), F.sha2(name, 256)).alias("media_sha256"),
    )
    windows = tracks.filter("mode > 0").select(
        *TRACK, "clip", own.alias("clip_index"), (clip * 40_000).cast("long").alias("win_start_ms"), (clip * 40_000 + 30_000).cast("long").alias("win_end_ms"),
        F.when(F.col("mode") == 2, clip * 30_000).otherwise(0).cast("long").alias("offset_ms"),
    )
    cut = intervals.clip_overlaps(c, windows, list(TRACK)).withColumn("_unit", F.coalesce("clip_index", F.lit(-1)))
    numbered = ordered.running(cut, Order((*TRACK, "_unit"), ("clip", "cue_id"), order.block), n=ordered.position())
    clips = numbered.select(
        *TRACK, "clip_index", (F.col("n") - 1).alias("cue_id"), F.col("clip_start_ms").alias("start_ms"), F.col("clip_end_ms").alias("end_ms"), "target_text"
    )
    whole = c.filter(mode == 0).select(*TRACK, F.lit(None).cast("int").alias("clip_index"), "cue_id", "start_ms", "end_ms", "target_text")
    rights = c.select("project_id").distinct().withColumn("rights_status", F.when(F.col("project_id") % 4 == 0, "unreviewed").otherwise("licensed"))
    folder = f"{shared_dir(spark)}/packages-{uuid.uuid4().hex}"
    packages.write_packages(packaging.package_pieces(units, whole.unionByName(clips), rights), folder)
    rows = packages.read_manifest(spark, folder)
    return rows.select(F.col("project_id").cast("long").alias("project_id"), "language", "clip_index", "kind", "bytes", "sha256")


# --- clip requests --------------------------------------------------------------------------------

@job("clip_requests", """
+WITH src AS (SELECT project_id, MAX(end_ms) AS source_ms FROM x1 GROUP BY project_id),
w AS (SELECT project_id, source_ms, k, 3000 + project_id % 5 * 700 + k * 10500 AS s, 3000 + project_id % 5 * 700 + CASE k WHEN 0 THEN 9000 ELSE 15500 END AS e, project_id % 4 = 2 AS snap
  FROM src, (SELECT unnest([0, 1]) AS k) WHERE project_id % 4 >= 2),
b AS (SELECT project_id, unnest([start_ms, end_ms]) AS t FROM x1),
edge AS (SELECT project_id, k, 0 AS side, s AS t FROM w UNION ALL SELECT project_id, k, 1, e FROM w),
near AS (SELECT edge.project_id, k, side, arg_min(b.t, abs(b.t - edge.t) * 100000000 + b.t) AS t FROM edge JOIN b ON b.project_id = edge.project_id AND abs(b.t - edge.t) <= 2000 GROUP BY ALL),
r AS (SELECT w.project_id, source_ms, w.k AS idx, CASE w.k WHEN 0 THEN 'first' ELSE 'second' END AS id, CASE WHEN snap THEN COALESCE(a.t, s) ELSE s END AS start_ms, CASE WHEN snap THEN COALESCE(z.t, e) ELSE e END AS end_ms
  FROM w LEFT JOIN near a ON a.project_id = w.project_id AND a.k = w.k AND a.side = 0 LEFT JOIN near z ON z.project_id = w.project_id AND z.k = w.k AND z.side = 1)
SELECT project_id, CAST(idx AS BIGINT) AS idx, id, start_ms, end_ms, CASE WHEN end_ms <= start_ms THEN 'end-not-after-start' WHEN end_ms > source_ms THEN 'out-of-bounds' ELSE 'ok' END AS status FROM r
UNION ALL SELECT project_id, 0, 'whole', 0, source_ms, 'ok' FROM src WHERE project_id % 4 = 0
UNION ALL SELECT project_id, 0, NULL, NULL, NULL, 'empty-selection' FROM src WHERE project_id % 4 = 1""")
def clip_requests(spark, sf):
    """Requests for the whole video, for nothing, and for two windows with and without snapping to cues."""
    c, _ = fx.cues(spark, sf)
    source = c.groupBy("project_id").agg(F.max("end_ms").alias("source_ms"))
    begin = 3000 + F.col("project_id") % 5 * 700
    time = lambda ms: F.format_string("%d.%03d", F.floor(ms / 1000), ms % 1000)
    window = lambda name, a, b: F.struct(
        F.lit(name).alias("id"), time(begin + a).alias("start"), time(begin + b).alias("end"), F.lit(None).cast("boolean").alias("exact")
    )
    windows = F.array(window("first", 0, 9000), window("second", 10_500, 15_500))
    kind = F.col("project_id") % 4
    requests = source.select(
        "project_id", F.when(kind >= 2, windows).when(kind == 1, F.slice(windows, 1, 0)).alias("segments"),
        F.when(kind == 3, F.lit(False)).alias("snap_edges"),
    )
    rows, order = ordered.arrange(intervals.selection_rows(requests, source), ("project_id",), ("idx",))
    out = intervals.resolve_segments(rows, order, c, source)
    return out.select("project_id", "idx", "id", "start_ms", "end_ms", "status")
