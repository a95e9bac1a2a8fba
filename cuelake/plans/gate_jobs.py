"""Jobs over artifacts, approvals, events, tracks, runs and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.operators import ledger, ordered, packaging, qa, replay, runs
from cuelake.operators import provenance as pv
from cuelake.plans.registry import job
from cuelake.sources import fixtures as fx

# --- artifacts and approvals ----------------------------------------------------------------------

@job("artifact_versions", """
+WITH d AS (SELECT * FROM (SELECT *, LAG(sha256) OVER (PARTITION BY project_id, type, language ORDER BY seq) AS p FROM x5) WHERE p IS DISTINCT FROM sha256)
SELECT project_id, type, language, seq, sha256, ROW_NUMBER() OVER w AS version, COALESCE(LAG(seq) OVER w, 0) AS supersedes
FROM d WINDOW w AS (PARTITION BY project_id, type, language ORDER BY seq)""")
def artifact_versions(spark, sf):
    a, order = fx.artifacts(spark, sf)
    v = pv.versions(a, order.block).fillna(0, ["supersedes"])
    return v.select("project_id", "type", "language", "seq", "sha256", "version", "supersedes")


ACTIVE = """
+WITH act AS (SELECT project_id, type, language, MAX(seq) AS seq, arg_max(sha256, seq) AS sha256 FROM x5 GROUP BY project_id, type, language)"""


@job("active_artifacts", ACTIVE + " SELECT * FROM act")
def active_artifacts(spark, sf):
    return pv.active_artifacts(fx.artifacts(spark, sf)[0])


PARENTS = """par AS (SELECT project_id, seq, seq - 1 AS parent FROM x5 WHERE seq > 1
  UNION SELECT project_id, seq, seq // 2 FROM x5 WHERE seq % 50 = 0)"""


def _parents(a):
    """The registration before as parent, and from every fiftieth a second one half as far."""
    seq = F.col("seq")
    both = F.when(seq % 50 == 0, F.array(seq - 1, F.floor(seq / 2))).otherwise(F.array(seq - 1))
    return a.filter(seq > 1).select("project_id", "seq", F.explode(both).alias("parent"))


@job("lineage", f"""
+RECURSIVE +WITH del AS (SELECT project_id, type, language, MAX(seq) AS seq FROM x5 GROUP BY project_id, type, language),
{PARENTS},
up AS (SELECT d.project_id, d.seq, p.parent AS source_seq FROM del d JOIN par p USING (project_id, seq)
  UNION SELECT up.project_id, up.seq, p.parent FROM up JOIN par p ON p.project_id = up.project_id AND p.seq = up.source_seq)
SELECT * FROM up""")
def lineage(spark, sf):
    a, _ = fx.artifacts(spark, sf)
    return pv.lineage(pv.active_artifacts(a).select("project_id", "seq"), _parents(a))


@job("lineage_circles", f"""
+RECURSIVE +WITH {PARENTS},
late AS (SELECT project_id, seq, seq + 7 AS parent FROM x5 WHERE seq % 100 = 30
  UNION ALL SELECT project_id, 1, 3 FROM x5 WHERE seq = 2 AND project_id % 2 = 0 UNION ALL SELECT project_id, 2, 2 FROM x5 WHERE seq = 2 AND project_id % 3 = 0),
every AS (SELECT * FROM par UNION SELECT * FROM late),
up AS (SELECT project_id, parent AS start_seq, parent AS at FROM late
  UNION SELECT up.project_id, up.start_seq, p.parent FROM up JOIN every p ON p.project_id = up.project_id AND p.seq = up.at)
SELECT DISTINCT l.project_id, l.seq, l.parent FROM late l JOIN up ON up.project_id = l.project_id AND up.start_seq = l.parent AND up.at = l.seq""")
def lineage_circles(spark, sf):
    a, _ = fx.artifacts(spark, sf)
    seq, project = F.col("seq"), F.col("project_id")
    late = F.array_compact(F.array(
        F.when(seq % 100 == 30, F.struct(seq.alias("seq"), (seq + 7).alias("parent"))),
        F.when((seq == 2) & (project % 2 == 0), F.struct((seq - 1).alias("seq"), (seq + 1).alias("parent"))),
        F.when((seq == 2) & (project % 3 == 0), F.struct(seq.alias("seq"), seq.alias("parent"))),
    ))
    late = a.select("project_id", F.explode(late).alias("edge")).select("project_id", "edge.*")
    return pv.lineage_circles(_parents(a).unionByName(late))


APPROVED = ACTIVE + """,
ap AS (SELECT *, CASE WHEN approval_id % 3 = 0 THEN created_at + INTERVAL 1000 DAY END AS expires_at FROM x6),
stale AS (SELECT approval_id, COUNT(*) AS stale_hashes FROM (SELECT approval_id, project_id, unnest(artifact_hashes) AS h FROM ap) b
  WHERE NOT EXISTS (SELECT 1 FROM act WHERE act.project_id = b.project_id AND act.sha256 = b.h) GROUP BY approval_id),
av AS (SELECT approval_id, project_id, gate, decision, COALESCE(stale_hashes, 0) AS stale_hashes,
  decision = 'APPROVED' AND COALESCE(expires_at > TIMESTAMP '1999-01-01', true) AND approval_id % 11 <> 0 AND COALESCE(stale_hashes, 0) = 0 AS valid
  FROM ap LEFT JOIN stale USING (approval_id))"""


def _approvals(spark, sf):
    a = fx.approvals(spark, sf)
    expires = F.when(F.col("approval_id") % 3 == 0, F.col("created_at") + F.expr("INTERVAL 1000 DAYS"))
    a = a.withColumns({"expires_at": expires, "invalidated_at": F.when(F.col("approval_id") % 11 == 0, F.col("created_at"))})
    active = pv.active_artifacts(fx.artifacts(spark, sf)[0])
    return pv.approval_states(a, active, F.lit("1999-01-01").cast("timestamp"))


@job("approval_validity", APPROVED + " SELECT * FROM av")
def approval_validity(spark, sf):
    return _approvals(spark, sf).select("approval_id", "project_id", "gate", "decision", "stale_hashes", "valid")


# --- gates ----------------------------------------------------------------------------------------

TRACK_CODES = ["en", "fr", "es", "fa"]


def _tracks():
    """Four tracks per project seen in the event log, as an array."""
    source = F.element_at(F.array(F.lit("fa"), F.lit("en"), F.lit("fr")), (F.col("project_id") % 3 + 1).cast("int"))

    def track(code, at):
        skip = code == source
        return F.struct(
            code.alias("language"), skip.alias("skip_translation"), (~skip & (code != "en")).alias("auto_translate"),
            ((F.col("project_id") + at) % 5 < 2).alias("dub_enabled"),
        )

    return F.transform(F.array(*[F.lit(c) for c in TRACK_CODES]), track)


# Approval gates and report types
GATES = ["transcript_qa", "translation_qa", "audio_qa", "final_qa", "rights"]
REPORTS = ["transcript-qa", "translation-qa", "glossary", "caption", "audio-sync", "final"]


def gates(spark, sf):
    """Every project's next step: one aggregate of the log, one of the approvals, array expressions for the rest."""
    seq = F.col("seq")
    report = F.element_at(F.array(*[F.lit(r) for r in REPORTS]), (seq % 6 + 1).cast("int"))
    verdict = F.when(seq % 7 == 0, "FAIL").when(seq % 5 == 0, "CONDITIONAL_PASS").otherwise("PASS")
    log = fx.event_rows(spark, sf).select(
        "project_id", "time", "seq", "to_state", report.alias("report_type"), verdict.alias("decision")
    )
    a = _approvals(spark, sf).filter("valid")  # stale, expired and invalidated ones open no gate
    gate = F.element_at(F.array(*[F.lit(g) for g in GATES]), F.substring("gate", 1, 1).cast("int"))
    code = F.element_at(F.array(*[F.lit(c) for c in TRACK_CODES]), (F.col("approval_id") % 4 + 1).cast("int"))
    per_language = gate.isin("translation_qa", "audio_qa")
    valid = a.select("project_id", gate.alias("gate"), F.when(per_language, code).otherwise("").alias("language"))
    rights = F.when(F.col("project_id") % 4 == 0, "unreviewed").otherwise("licensed")
    projects = pv.log_board(log).join(pv.approval_keys(valid), "project_id", "left")
    return pv.check_gates(projects.withColumns({"tracks": _tracks(), "rights_status": rights}))


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


EDGE_ROWS = ", ".join(
    f"('{a}', '{b}', {_sql_list(r)}::VARCHAR[], {repr(g) if g else 'NULL'}, {str(l).lower()}, {str(n).lower()}, {'NULL' if d is None else str(d).lower()})"
    for a, b, r, g, l, n, d in pv.EDGES
)
GATE_SQL = APPROVED + f""",
st AS (SELECT user_id AS project_id, arg_max(to_state, seq) AS current_state FROM (SELECT project_id AS user_id, seq, to_state FROM x4) GROUP BY 1),
tr AS (SELECT project_id, language, language = src AS skip, language <> src AND language <> 'en' AS auto, (project_id + pos) % 5 < 2 AS dub
  FROM (SELECT project_id, unnest({_sql_list(TRACK_CODES)}) AS language, unnest([0, 1, 2, 3]) AS pos, (['fa','en','fr'])[project_id % 3 + 1] AS src FROM st)),
edge AS (SELECT * FROM (VALUES {EDGE_ROWS}) e(current_state, next_state, reports, gate, per_language, needs_rights, with_dubs)),
nx AS (SELECT s.project_id, s.current_state, next_state, reports, gate, per_language, needs_rights FROM (SELECT *, EXISTS (SELECT 1 FROM tr WHERE tr.project_id = st.project_id AND dub) AS dubs FROM st) s
  LEFT JOIN edge e ON e.current_state = s.current_state AND (with_dubs IS NULL OR with_dubs = dubs)),
rp AS (SELECT project_id, ({_sql_list(REPORTS)})[seq % 6 + 1] AS report_type, arg_max(CASE WHEN seq % 7 = 0 THEN 'FAIL' WHEN seq % 5 = 0 THEN 'CONDITIONAL_PASS' ELSE 'PASS' END, seq) AS decision FROM x4 GROUP BY 1, 2),
va AS (SELECT DISTINCT project_id, g AS gate, CASE WHEN g IN ('translation_qa', 'audio_qa') THEN ({_sql_list(TRACK_CODES)})[approval_id % 4 + 1] ELSE '' END AS language
  FROM (SELECT *, ({_sql_list(GATES)})[CAST(substr(gate, 1, 1) AS INT)] AS g FROM av WHERE valid)),
bl AS (SELECT project_id, 'report' AS kind, r AS detail FROM (SELECT project_id, unnest(reports) AS r FROM nx) n
    WHERE NOT EXISTS (SELECT 1 FROM rp WHERE rp.project_id = n.project_id AND rp.report_type = n.r AND decision <> 'FAIL')
  UNION ALL SELECT n.project_id, 'approval', gate || ':' || language FROM nx n JOIN tr USING (project_id) WHERE per_language AND NOT skip AND NOT auto AND (gate <> 'audio_qa' OR dub)
    AND NOT EXISTS (SELECT 1 FROM va WHERE va.project_id = n.project_id AND va.gate = n.gate AND va.language = tr.language)
  UNION ALL SELECT n.project_id, 'approval', gate FROM nx n WHERE gate IS NOT NULL AND NOT per_language AND NOT EXISTS (SELECT 1 FROM va WHERE va.project_id = n.project_id AND va.gate = n.gate)
  UNION ALL SELECT project_id, 'rights', 'rights_status' FROM nx WHERE needs_rights AND project_id % 4 = 0),
ac AS (SELECT nx.project_id, nx.current_state, COALESCE(next_state, '') AS next_state, CASE WHEN next_state IS NULL THEN 'TERMINAL' WHEN o > 0 THEN 'BLOCKED' WHEN a > 0 THEN 'STOP_AT_GATE' ELSE 'PROCEED' END AS action
  FROM nx LEFT JOIN (SELECT project_id, COUNT(*) FILTER (kind = 'approval') AS a, COUNT(*) FILTER (kind <> 'approval') AS o FROM bl GROUP BY project_id) b USING (project_id))"""


@job("gate_blockers", GATE_SQL + " SELECT * FROM bl")
def gate_blockers(spark, sf):
    return pv.gate_blockers(gates(spark, sf))


@job("next_action", GATE_SQL + " SELECT * FROM ac")
def next_action(spark, sf):
    return gates(spark, sf).select("project_id", "current_state", F.coalesce("next_state", F.lit("")).alias("next_state"), "action")


@job("stranded_dubs", ACTIVE + " SELECT project_id, type, language, seq, sha256 FROM act WHERE type = 'A' AND (project_id + CASE language WHEN 'F' THEN 1 ELSE 0 END) % 3 = 0")
def stranded_dubs(spark, sf):
    a, _ = fx.artifacts(spark, sf)
    active = pv.active_artifacts(a)
    return pv.stranded(active, _artifact_tracks(active), "A")


def _artifact_tracks(active):
    on = (F.col("project_id") + F.when(F.col("language") == "F", 1).otherwise(0)) % 3 != 0
    return active.select("project_id", "language", on.alias("dub_enabled")).distinct()


# --- events ---------------------------------------------------------------------------------------

@job("project_state", """
SELECT project_id, arg_max(to_state, seq) AS current_state, MAX(seq) AS seq, COUNT(*) AS transitions FROM x4 GROUP BY project_id""")
def project_state(spark, sf):
    return pv.latest_state(fx.event_rows(spark, sf))


@job("state_history", """
SELECT project_id, seq, to_state AS state, time, COALESCE((epoch_us(LEAD(time) OVER (PARTITION BY project_id ORDER BY seq)) - epoch_us(time)) // 1000, -1) AS dwell_ms FROM x4""")
def state_history(spark, sf):
    e, order = fx.event_log(spark, sf)
    return pv.state_history(e, order).fillna(-1, ["dwell_ms"])


@job("transition_audit", f"""
+WITH p AS (SELECT *, LAG(to_state) OVER (PARTITION BY project_id ORDER BY seq) AS prev FROM x4)
SELECT project_id, seq, COALESCE(from_state, '') AS from_state, to_state, 'broken-chain' AS problem FROM p WHERE prev IS NOT NULL AND from_state IS DISTINCT FROM prev
UNION ALL SELECT project_id, seq, from_state, to_state, 'edge-not-allowed' FROM p WHERE from_state IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM (VALUES {EDGE_ROWS}) e(a, b, r, g, l, n, d) WHERE e.a = p.from_state AND e.b = p.to_state)""")
def transition_audit(spark, sf):
    e, order = fx.event_log(spark, sf)
    return pv.transition_problems(e, order).fillna("", ["from_state"])


# every state once, in the order of a project's life; events ask for the next one, some for one that is far off
LIFE = list(dict.fromkeys([*fx.STATES, *(s for e in pv.DISTRIBUTION_EDGES for s in e)]))
LIFE_SQL = "[" + ", ".join(f"'{s}'" for s in LIFE) + "]"
ALLOWED_SQL = ", ".join(f"('{a}', '{b}')" for a, b in sorted(pv.ALLOWED))


@job("transition_replay", f"""
+RECURSIVE +WITH r AS (SELECT project_id, seq, ROW_NUMBER() OVER (PARTITION BY project_id ORDER BY seq) AS n FROM x4),
w AS (SELECT project_id, seq, n, ({LIFE_SQL})[CASE WHEN seq % 9 = 0 THEN seq * 7 % 23 ELSE n % 31 END + 1] AS to_state FROM r),
ok(a, b) AS (VALUES {ALLOWED_SQL}),
walk AS (SELECT project_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS to_state, CAST(NULL AS VARCHAR) AS met, 'INGEST' AS now, false AS accepted
    FROM w GROUP BY project_id
  UNION ALL SELECT w.project_id, w.n, w.seq, w.to_state, k.now, CASE WHEN ok.a IS NULL THEN k.now ELSE w.to_state END, ok.a IS NOT NULL
  FROM walk k JOIN w ON w.project_id = k.project_id AND w.n = k.n + 1 LEFT JOIN ok ON ok.a = k.now AND ok.b = w.to_state)
SELECT project_id, seq, to_state, met, accepted FROM walk WHERE n > 0""")
def transition_replay(spark, sf):
    e, order = fx.event_log(spark, sf)
    e = ordered.running(e.select("project_id", "seq", *order.block), order, n=ordered.position())
    place = F.when(F.col("seq") % 9 == 0, F.col("seq") * 7 % 23).otherwise(F.col("n") % 31)
    e = e.withColumn("to_state", F.get(F.array(*[F.lit(s) for s in LIFE]), place.cast("int")))
    return replay.replay(e, order, pv.ALLOWED, "INGEST")


@job("event_tail", """
SELECT project_id, seq, time, actor, to_state FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY project_id ORDER BY seq DESC) AS rn FROM x4) WHERE rn <= 5""")
def event_tail(spark, sf):
    return pv.tail(fx.event_rows(spark, sf), 5).select("project_id", "seq", "time", "actor", "to_state")


@job("event_counts", """
SELECT project_id, actor, to_state AS kind, CAST(CAST(time AS DATE) AS VARCHAR) AS day, COUNT(*) AS events FROM x4 GROUP BY ALL""")
def event_counts(spark, sf):
    e = fx.event_rows(spark, sf)
    day = F.date_format("time", "yyyy-MM-dd")
    return e.groupBy("project_id", "actor", F.col("to_state").alias("kind"), day.alias("day")).agg(F.count(F.lit(1)).alias("events"))


@job("track_quorum", f"""
+WITH t AS (SELECT project_id, actor, list_position({_sql_list(fx.STATES)}, arg_max(to_state, seq)) - 1 AS r, (project_id + length(actor)) % 2 = 0 AS dub FROM x4 WHERE actor <> 'click' GROUP BY project_id, actor),
g AS (SELECT project_id, MIN(r) AS r, MIN(CASE WHEN NOT dub AND r >= 8 THEN GREATEST(r, 13) ELSE r END) AS e, bool_or(dub) AS d, COUNT(*) AS tracks FROM t GROUP BY project_id)
SELECT project_id, ({_sql_list(fx.STATES)})[CASE WHEN d THEN e ELSE r END + 1] AS current_state, tracks FROM g""")
def track_quorum(spark, sf):
    e = fx.event_rows(spark, sf)
    t = e.groupBy("project_id", "actor").agg(F.max(F.struct("seq", "to_state"))["to_state"].alias("stage"))
    t = t.withColumns({
        "skip_translation": F.col("actor") == "click",
        "dub_enabled": (F.col("project_id") + F.length("actor")) % 2 == 0,
    })
    return pv.quorum(t, fx.STATES)


@job("scope_markers", """
+WITH t AS (SELECT video_id, source, unnest(list_distinct(list_append(targets, source))) AS language FROM x14),
o AS (SELECT *, (video_id + length(language) + ascii(language)) % 3 = 0 AS s0, (video_id + ascii(language)) % 2 = 0 AS a0, language = source AS s1, language <> source AND language <> 'en' AS a1 FROM t)
SELECT video_id, language, s1 AS skip_now, a1 AS auto_now, s1 AND NOT s0 AS marked_skip, a1 AND NOT a0 AS marked_auto, (s0 AND NOT s1) OR (a0 AND NOT a1) AS cleared FROM o""")
def scope_markers(spark, sf):
    r = fx.language_requests(spark, sf)
    t = r.select("video_id", "source", F.explode(F.array_union(F.array("source"), "targets")).alias("language"))
    code = F.ascii("language")
    t = t.withColumns({
        "skip_translation": (F.col("video_id") + F.length("language") + code) % 3 == 0,
        "auto_translate": (F.col("video_id") + code) % 2 == 0,
    })
    return pv.scope_markers(t).select("video_id", "language", "skip_now", "auto_now", "marked_skip", "marked_auto", "cleared")


# --- runs -----------------------------------------------------------------------------------------

@job("run_status", """
+WITH s AS (SELECT video_id, stage, CASE WHEN bool_and(status = 'done') THEN 'done' WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'running') THEN 'running' ELSE 'pending' END AS status
  FROM x11 GROUP BY video_id, stage),
g AS (SELECT DISTINCT video_id, unnest(['download','extract_audio','transcribe','translate','dub','mux']) AS stage, unnest(range(6)) AS n FROM x11)
SELECT g.video_id, g.stage, CASE COALESCE(status, 'pending') WHEN 'running' THEN 'pending' ELSE COALESCE(status, 'pending') END AS status
FROM g LEFT JOIN s ON s.video_id = g.video_id AND s.stage = g.n""")
def run_status(spark, sf):
    s = fx.run_status(spark, sf)
    name = F.element_at(F.array(*[F.lit(x) for x in runs.STAGES]), (F.col("stage") + 1).cast("int"))
    rolled = runs.stage_rollup(s.withColumn("stage", name)).drop("languages")
    return runs.load_status(rolled, s.select("video_id").distinct())


@job("resume_plan", f"""
+WITH n AS (SELECT * REPLACE (({_sql_list(runs.STAGES)})[stage + 1] AS stage) FROM x11),
s AS (SELECT * REPLACE (CASE WHEN stage IN ('download', 'extract_audio', 'transcribe') THEN '' ELSE language END AS language) FROM n),
g AS (SELECT DISTINCT video_id, unnest(['download', 'extract_audio', 'transcribe']) AS stage, '' AS language FROM x11
  UNION ALL SELECT DISTINCT video_id, unnest(['translate', 'dub', 'mux']), language FROM x11)
SELECT g.* FROM g
WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.video_id = g.video_id AND s.language = g.language AND s.stage = g.stage AND status = 'done' AND artifact_bytes > 0)""")
def resume_plan(spark, sf):
    s = fx.run_status(spark, sf)
    s = s.withColumn("stage", F.element_at(F.array(*[F.lit(x) for x in runs.STAGES]), (F.col("stage") + 1).cast("int")))
    scoped = F.when(F.col("stage").isin(runs.SCOPED), F.col("language")).otherwise("")
    return runs.resume_plan(runs.units(s), s.withColumn("language", scoped))


ROLLUP = """
+WITH r AS (SELECT video_id, stage, CASE WHEN bool_and(status = 'done') THEN 'done' WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'running') THEN 'running' ELSE 'pending' END AS status,
  COUNT(*) AS languages FROM x11 GROUP BY video_id, stage)"""


@job("stage_rollup", ROLLUP + " SELECT * FROM r")
def stage_rollup(spark, sf):
    return runs.stage_rollup(fx.run_status(spark, sf))


@job("batch_summary", ROLLUP + """
, v AS (SELECT video_id // 100 AS batch_id, bool_and(status = 'done') AS ok, bool_or(status = 'failed') AS bad FROM r GROUP BY video_id)
SELECT batch_id, COUNT(*) AS total, COUNT(*) FILTER (ok) AS succeeded, COUNT(*) FILTER (bad) AS failed FROM v GROUP BY batch_id""")
def batch_summary(spark, sf):
    o = runs.batch_outcomes(runs.stage_rollup(fx.run_status(spark, sf)))
    return runs.batch_summary(o.withColumn("batch_id", F.floor(F.col("video_id") / 100)))


@job("batch_results", ROLLUP + f"""
, v AS (SELECT video_id, bool_and(status = 'done') AS ok, COALESCE(MIN(({_sql_list(runs.STAGES)})[stage + 1]) FILTER (status = 'failed'), '') AS error FROM r GROUP BY video_id)
SELECT video_id // 100 AS batch_id, video_id, CASE WHEN error <> '' THEN 'failed' ELSE 'succeeded' END AS result, error FROM v WHERE ok OR error <> ''""")
def batch_results(spark, sf):
    rolled = runs.stage_rollup(fx.run_status(spark, sf))
    name = F.element_at(F.array(*[F.lit(x) for x in runs.STAGES]), (F.col("stage") + 1).cast("int"))
    o = runs.batch_outcomes(rolled.withColumn("stage", name))
    return runs.batch_results(o.withColumn("batch_id", F.floor(F.col("video_id") / 100)))


@job("final_qa", """
+WITH f AS (SELECT project_id, CASE WHEN NOT has_audio THEN 'missing-stream' WHEN abs(container_ms - dub_ms) > 1000 THEN 'av-drift' ELSE '' END AS category, container_ms - dub_ms AS av_drift_ms FROM x10)
SELECT *, CASE category WHEN '' THEN 'PASS' ELSE 'FAIL' END AS decision FROM f""")
def final_qa(spark, sf):
    p = fx.media_probe(spark, sf)
    first = F.coalesce(F.try_element_at("categories", F.lit(1)), F.lit(""))
    return qa.final_verdicts(p).select("project_id", first.alias("category"), "av_drift_ms", "decision")


PROBED = """
+WITH l AS (SELECT l_orderkey AS project_id, l_linenumber AS pos, MIN(l_partkey) AS p, MIN(l_suppkey) AS s FROM lineitem GROUP BY ALL),
t AS (SELECT project_id, (%s)[pos %% %d + 1] AS language, pos %% 3 <> 0 AS dub, s %% 23 <> 0 AS file, s %% 40 <> 0 AS video, p %% 50 <> 0 AS audio,
    (p * 37) %% 2601 - 1300 AS drift FROM l)"""


@job("final_report", PROBED % (_sql_list(fx.CODES), len(fx.CODES)) + """,
c AS (SELECT project_id, language, dub, CASE WHEN dub AND file THEN drift END AS drift, unnest(CASE WHEN NOT dub THEN [''] WHEN NOT file THEN ['1 missing-file'] ELSE
    ['', CASE WHEN NOT video THEN '1 missing-video' END, CASE WHEN NOT audio THEN '2 missing-stream' END, CASE WHEN abs(drift) > 1000 THEN '3 av-drift' END] END) AS wrong FROM t)
SELECT project_id, COALESCE(string_agg(DISTINCT language, ',' ORDER BY language) FILTER (dub), '') AS languages,
  COALESCE(string_agg(language || ':' || substr(wrong, 3), ',' ORDER BY language, wrong) FILTER (wrong <> ''), '') AS findings,
  COALESCE(MAX(abs(drift)), -1) AS widest_drift_ms, CASE WHEN COUNT(*) FILTER (wrong <> '') > 0 THEN 'FAIL' ELSE 'PASS' END AS decision
FROM c GROUP BY project_id""")
def final_report(spark, sf):
    """A project an order, a track a line of it; some tracks have no dub, some dubs no file."""
    at, codes = F.col("l_linenumber"), F.array(*[F.lit(c) for c in fx.CODES])
    li = fx.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s")
    )
    t = li.select(
        F.col("l_orderkey").alias("project_id"), F.element_at(codes, (at % len(fx.CODES) + 1).cast("int")).alias("language"),
        (at % 3 != 0).alias("dub_enabled"), (F.col("s") % 40 != 0).alias("has_video"), (F.col("p") % 50 != 0).alias("has_audio"),
        (1000 * (F.col("p") + 60)).alias("container_ms"), ((F.col("p") * 37) % 2601 - 1300).alias("drift"), "s",
    )
    probes = t.filter(F.col("s") % 23 != 0).select(
        "project_id", "language", "has_video", "has_audio", "container_ms", (F.col("container_ms") - F.col("drift")).alias("dub_ms")
    )
    r = qa.final_report(probes, t.select("project_id", "language", "dub_enabled"))
    listed = F.transform("findings", lambda f: F.concat_ws(":", f["language"], f["category"]))
    return r.select(
        "project_id", F.array_join("languages", ",").alias("languages"), F.array_join(listed, ",").alias("findings"),
        F.coalesce("widest_drift_ms", F.lit(-1)).alias("widest_drift_ms"), "decision",
    )


# --- ledgers --------------------------------------------------------------------------------------

@job("budget_status", """
SELECT ledger_id, CAST(COALESCE(SUM(cost_usd) FILTER (guarded), 0) AS DOUBLE) AS spent_usd, COUNT(*) AS calls,
  CAST(CAST(300000 AS DECIMAL(38,2)) - COALESCE(SUM(cost_usd) FILTER (guarded), 0) AS DOUBLE) AS remaining_usd FROM x8 GROUP BY ledger_id""")
def budget_status(spark, sf):
    calls, _ = fx.ledger_calls(spark, sf)
    s = ledger.status(calls, F.lit(300000).cast("decimal(18,2)"))
    return s.select("ledger_id", F.col("spent_usd").cast("double").alias("spent_usd"), "calls", F.col("remaining_usd").cast("double").alias("remaining_usd"))


@job("budget_admission", """
+RECURSIVE +WITH g AS (SELECT ledger_id, seq, guarded, CAST(cost_usd * 100 AS BIGINT) AS cents FROM x8),
walk AS (SELECT ledger_id, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS spent, false AS admitted FROM g GROUP BY ledger_id
  UNION ALL SELECT w.ledger_id, g.seq, CASE WHEN g.guarded AND w.spent + g.cents <= 30000000 THEN w.spent + g.cents ELSE w.spent END, NOT g.guarded OR w.spent + g.cents <= 30000000
  FROM walk w JOIN g ON g.ledger_id = w.ledger_id AND g.seq = w.seq + 1)
SELECT ledger_id, seq, admitted FROM walk WHERE seq > 0""")
def budget_admission(spark, sf):
    calls, order = fx.ledger_calls(spark, sf)
    calls = calls.withColumn("cents", (F.col("cost_usd") * 100).cast("long")).drop("cost_usd")
    return ledger.admit(calls, order, 30_000_000).select("ledger_id", "seq", "admitted")


# --- packages and channels ------------------------------------------------------------------------

@job("package_manifest", ACTIVE + """
, t AS (SELECT *, (project_id + CASE language WHEN 'F' THEN 1 ELSE 0 END) % 3 <> 0 AS dub FROM act)
SELECT project_id, language, string_agg(type || '=' || sha256, ',' ORDER BY type || '=' || sha256) AS deliverables, COUNT(*) AS n_deliverables,
  CASE WHEN project_id % 4 = 0 THEN 'unreviewed' ELSE 'licensed' END AS rights_status, project_id % 4 <> 0 AS distributable
FROM t WHERE dub OR type <> 'A' GROUP BY project_id, language""")
def package_manifest(spark, sf):
    active = pv.active_artifacts(fx.artifacts(spark, sf)[0])
    rights = active.select("project_id").distinct().withColumn(
        "rights_status", F.when(F.col("project_id") % 4 == 0, "unreviewed").otherwise("licensed")
    )
    m = packaging.package_manifest(active, _artifact_tracks(active), rights, "A")
    return m.withColumn("deliverables", F.array_join("deliverables", ","))


@job("channel_resolution", """
SELECT c_custkey AS project_id, CAST(c_nationkey AS BIGINT) AS language,
  CASE WHEN c_custkey % 10 = 0 THEN 900000 + c_custkey ELSE COALESCE(b.channel_id, -1) END AS channel_id
FROM customer LEFT JOIN (SELECT language, arg_min(channel_id, CASE WHEN is_default THEN 0 ELSE 1000000000 END + ord) AS channel_id FROM x12 GROUP BY language) b
  ON b.language = c_nationkey""")
def channel_resolution(spark, sf):
    c = fx.table(spark, sf, "customer")
    p = c.select(
        F.col("c_custkey").alias("project_id"), F.col("c_nationkey").cast("long").alias("language"),
        F.when(F.col("c_custkey") % 10 == 0, 900000 + F.col("c_custkey")).alias("override_channel"),
    )
    out = packaging.resolve_channels(p, fx.channels(spark, sf))
    return out.select("project_id", "language", F.coalesce("channel_id", F.lit(-1)).alias("channel_id"))


@job("config_integrity", "SELECT language, COUNT(*) AS defaults FROM x12 WHERE is_default GROUP BY language HAVING COUNT(*) > 1")
def config_integrity(spark, sf):
    return packaging.config_problems(fx.channels(spark, sf))


@job("duplicate_posts", """
+WITH p AS (SELECT s_suppkey AS post_id, 'New lecture: ' || CAST(floor(s_acctbal / 100) AS BIGINT) || ' minutes' AS text FROM supplier WHERE s_suppkey % 4 <> 0)
SELECT text, COUNT(*) AS posts, MIN(post_id) AS first_post FROM p GROUP BY text HAVING COUNT(*) > 1""")
def duplicate_posts(spark, sf):
    from cuelake.functions.text import fill_template

    text = fill_template(F.lit("New lecture: {{BODY}} minutes"), {"BODY": F.col("body")})
    return packaging.duplicate_posts(fx.posts(spark, sf).withColumn("text", text))
