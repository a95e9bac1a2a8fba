"""Artifacts, approvals, gates and project state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.operators import ordered
from cuelake.operators.ordered import ROWS_PER_BLOCK, Order, arrange, running
from cuelake.session import ensure_checkpoint_dir

# The allowed edges of a project's life, with what each edge asks for:
# (from, to, reports, approval gate, approval per language, needs distributable rights, only with dubs)
EDGES = [
    ("INGEST", "LANGUAGE_ID", [], None, False, False, None),
    ("LANGUAGE_ID", "TRANSCRIPTION", [], None, False, False, None),
    ("TRANSCRIPTION", "TRANSCRIPT_QA_GATE", [], None, False, False, None),
    ("TRANSCRIPT_QA_GATE", "SEGMENT_RESOLUTION", ["transcript-qa"], "transcript_qa", False, False, None),
    ("SEGMENT_RESOLUTION", "TRANSLATION", [], None, False, False, None),
    ("TRANSLATION", "TRANSLATION_QA_GATE", [], None, False, False, None),
    ("TRANSLATION_QA_GATE", "CAPTION_TIMING", ["translation-qa", "glossary"], "translation_qa", True, False, None),
    ("CAPTION_TIMING", "CAPTION_VALIDATION", [], None, False, False, None),
    ("CAPTION_VALIDATION", "DUBBING", ["caption"], None, False, False, True),
    ("CAPTION_VALIDATION", "PACKAGE", ["caption"], None, False, False, False),
    ("DUBBING", "AUDIO_SYNC_ADJUST", [], None, False, False, None),
    ("AUDIO_SYNC_ADJUST", "AUDIO_QA_GATE", [], None, False, False, None),
    ("AUDIO_QA_GATE", "VIDEO_MUX", ["audio-sync"], "audio_qa", True, False, None),
    ("VIDEO_MUX", "FINAL_QA_GATE", [], None, False, False, None),
    ("FINAL_QA_GATE", "PACKAGE", ["final"], "final_qa", False, False, None),
    ("PACKAGE", "READY_FOR_REVIEW", [], None, False, True, None),
]
# How a project goes on after review, only under human hands (from, to)
DISTRIBUTION_EDGES = [
    ("READY_FOR_REVIEW", "PLATFORM_PACKAGING"),
    ("PLATFORM_PACKAGING", "RELEASE_AUTHORIZATION"),
    ("RELEASE_AUTHORIZATION", "YOUTUBE_UPLOAD"),
    ("YOUTUBE_UPLOAD", "PROMOTION_QUEUE"),
    ("PROMOTION_QUEUE", "PROMOTION_REVIEW"),
    ("PROMOTION_REVIEW", "PROMOTION_PUBLISHED"),
    ("PROMOTION_PUBLISHED", "MONITORING"),
]
ALLOWED = [(a, b) for a, b, *_ in EDGES] + DISTRIBUTION_EDGES
REPORT_TYPES = list(dict.fromkeys(r for _, _, reports, *_ in EDGES for r in reports))
EDGE_SCHEMA = (
    "current_state string, next_state string, reports array<string>, gate string, per_language boolean, "
    "needs_rights boolean, with_dubs boolean"
)
# Rights that allow distribution
DISTRIBUTABLE = ["self-authored", "licensed", "fair-use-claimed"]


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGES, EDGE_SCHEMA)


# --- artifacts ------------------------------------------------------------------------------------

ARTIFACT = ("project_id", "type", "language")
#: Numbers that a piece of a line may span: what one row of a followed-up line stands for.
SEGMENT = 10_000


def versions(registrations: DataFrame, block: tuple[str, ...] = ()) -> DataFrame:
    """Version numbers and what each version supersedes; an unchanged hash registers nothing."""
    o = Order(ARTIFACT, ("seq",), block)
    r = running(registrations, o, _prev=ordered.previous(F.col("sha256")))
    r = r.filter(~F.col("sha256").eqNullSafe(F.col("_prev"))).drop("_prev")
    return running(r, o, version=ordered.position(), supersedes=ordered.previous(F.col("seq")))


def active_artifacts(registrations: DataFrame) -> DataFrame:
    """Newest registration per (project, type, language); an aggregate, so no group is gathered."""
    newest = F.max(F.struct("created_at", "seq", "sha256"))
    return registrations.groupBy(*ARTIFACT).agg(newest.alias("_n")).select(
        *ARTIFACT, F.col("_n")["seq"].alias("seq"), F.col("_n")["sha256"].alias("sha256")
    )


def _jumps(first: DataFrame, keys: list[str]) -> list[DataFrame]:
    """Jump tables ``(keys, at, to)`` over 1, 2, 4, … first parents, as far as the longest line goes.

    Each table is at most a row a node. In a circle lines never end, so the tables end where a jump is longer than
    the largest group.
    """
    tables = [first]
    largest = first.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    while 1 << len(tables) <= largest:
        last = tables[-1]
        on = [*keys, "_mid"]
        longer = last.withColumnRenamed("_to", "_mid").join(last.withColumnRenamed("_at", "_mid"), on).drop("_mid").checkpoint()
        if longer.isEmpty():
            break
        tables.append(longer)
    return tables


def _segments(wanted: DataFrame, parents: DataFrame, keys: list[str], rows_per_block: int) -> DataFrame:
    """Each node with its segment ``(keys, _seg, _node)``: a piece of a line that is entered at its top and left at its end only.

    A node goes on the segment of the next lower one if that one is its only parent and has no other child. A segment
    is named by its lowest node, holds at most ``SEGMENT`` numbers, and a wanted node is the lowest of its own.
    """
    none = F.lit(None).cast("long")
    ends = F.array(
        F.struct(F.col("seq").alias("_node"), F.col("parent").alias("_up"), none.alias("_down")),
        F.struct(F.col("parent").alias("_node"), none.alias("_up"), F.col("seq").alias("_down")),
    )
    ends = parents.select(*keys, F.explode(ends).alias("_e")).select(*keys, "_e.*", F.lit(False).alias("_own"))
    own = wanted.select(*keys, F.col("seq").alias("_node"), none.alias("_up"), none.alias("_down"), F.lit(True).alias("_own"))
    only = lambda c: F.when(F.min(c) == F.max(c), F.max(c))
    nodes = ends.unionByName(own).groupBy(*keys, "_node").agg(only("_up").alias("_up"), only("_down").alias("_down"), F.max("_own").alias("_own"))
    nodes, order = arrange(nodes, keys, ("_node",), rows_per_block=rows_per_block)
    nodes = running(nodes, order, _low=ordered.previous(F.struct("_node", "_down")))
    same = lambda c: F.floor(F.col(c) / SEGMENT)
    goes_on = ~F.col("_own") & (F.col("_up") == F.col("_low._node")) & (F.col("_low._down") == F.col("_node")) & (same("_node") == same("_low._node"))
    begins = F.when(~F.coalesce(goes_on, F.lit(False)), F.col("_node"))
    return running(nodes.withColumn("_begins", begins), order, _seg=ordered.highest(F.col("_begins"))).select(*keys, "_seg", "_node")


def lineage(
    deliverables: DataFrame, parents: DataFrame, keys: Sequence[str] = ("project_id",), rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """All sources, near and far, of each deliverable ``(keys, seq)``; parents are ``(keys, seq, parent)``.

    Pieces of lines without branches are followed as one node, so that only the branches meet the joins and the sorting
    out of repeated rows; each row of the result is made once, at the end. Circles are followed once round;
    ``lineage_circles`` reports them.
    """
    ensure_checkpoint_dir(parents.sparkSession)
    keys = list(keys)
    wanted = deliverables.select(*keys, "seq").filter(F.col("seq").isNotNull()).distinct().checkpoint()
    edges_ = parents.select(*keys, "seq", "parent").filter(F.col("seq").isNotNull() & F.col("parent").isNotNull()).checkpoint()
    members = _segments(wanted, edges_, keys, rows_per_block).checkpoint()
    tops = members.groupBy(*keys, "_seg").agg(F.max("_node").alias("parent"))
    leaving = edges_.join(tops.select(*keys, F.col("_seg").alias("seq")), [*keys, "seq"], "left_semi")
    between = leaving.join(tops, [*keys, "parent"]).select(*keys, "seq", F.col("_seg").alias("parent")).checkpoint()
    reached = _reached(wanted, between, keys).withColumnRenamed("_at", "_seg")
    return reached.join(members, [*keys, "_seg"]).select(*keys, "seq", F.col("_node").alias("source_seq"))


def _reached(deliverables: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Rows ``(keys, seq, _at)`` of each deliverable and each node above it.

    Path doubling: the greatest parent of each node is its first one, and jump tables over 1, 2, 4, … first parents
    are built once. A set of nodes grows along its lines by one join a table, doubling each time, so a line of any
    length takes a logarithm of joins, and rows are made once. Other parents then start new lines; that is repeated
    until nothing is new, once for each change of lines that the farthest source needs.
    """
    edges_ = parents.select(*keys, F.col("seq").alias("_at"), F.col("parent").alias("_to")).distinct()
    ranked = edges_.groupBy(*keys, "_at").agg(F.max("_to").alias("_to"))
    first = ranked.repartition(*keys, "_at").checkpoint()
    others = edges_.join(first, [*keys, "_at", "_to"], "left_anti").checkpoint()
    jumps = _jumps(first, keys)

    def along_lines(rows: DataFrame) -> DataFrame:
        for table in jumps:
            rows = rows.join(table, [*keys, "_at"], "left").select(
                *keys, "seq", F.explode(F.array_compact(F.array("_at", "_to"))).alias("_at")
            )
        return rows.distinct()

    def step(rows: DataFrame, by: DataFrame) -> DataFrame:
        return rows.join(by, [*keys, "_at"]).select(*keys, "seq", F.col("_to").alias("_at"))

    start = deliverables.select(*keys, "seq", F.col("seq").alias("_at"))
    new = along_lines(step(start, first).unionByName(step(start, others)).distinct()).checkpoint()
    found = new
    while not others.isEmpty():
        fresh = step(new, others).distinct().join(found, [*keys, "seq", "_at"], "left_anti").checkpoint()
        if fresh.isEmpty():
            break
        new = along_lines(fresh).join(found, [*keys, "seq", "_at"], "left_anti").checkpoint()
        found = found.unionByName(new)
    return found


def lineage_circles(
    parents: DataFrame, keys: Sequence[str] = ("project_id",), rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Edges ``(keys, seq, parent)`` that close a circle: the parent isn't older, and descends from the node itself.

    Every circle has an edge whose parent doesn't come before its node. Such edges are its only steps up, so they span
    all numbers that it passes, and an edge whose lower end lies in no such span is in no circle. One sorted pass leaves
    only the edges that do, and these few are followed up.
    """
    ensure_checkpoint_dir(parents.sparkSession)
    keys = list(keys)
    low = F.least("seq", "parent")  # skips nulls
    edges_ = parents.filter(F.col("seq").isNotNull() & F.col("parent").isNotNull())
    edges_ = edges_.select(*keys, "seq", "parent", low.alias("_low"), (F.col("parent") < F.col("seq")).alias("_down"))
    edges_, order = arrange(edges_, keys, ("_low", "_down"), rows_per_block=rows_per_block)
    spanned = running(edges_, order, _top=ordered.highest(F.when(~F.col("_down"), F.col("parent"))))
    near = spanned.filter(F.col("_top") >= F.col("_low")).select(*keys, "seq", "parent").distinct().checkpoint()
    back = near.filter(F.col("parent") >= F.col("seq"))
    starts = back.select(*keys, F.col("parent").alias("seq")).distinct()
    reached = lineage(starts, near, keys, rows_per_block).select(*keys, F.col("seq").alias("parent"), F.col("source_seq").alias("seq"))
    itself = back.filter(F.col("parent") == F.col("seq"))
    return back.join(reached, [*keys, "seq", "parent"], "left_semi").unionByName(itself).distinct()


# --- approvals ------------------------------------------------------------------------------------

def approval_states(approvals: DataFrame, active: DataFrame, as_of: Column) -> DataFrame:
    """Approvals with ``stale_hashes`` and ``valid``: approved, in force, every bound hash active."""
    hashes = active.groupBy("project_id").agg(F.collect_set("sha256").alias("_active"))  # one a type and language
    a = approvals.join(hashes, "project_id", "left")
    is_active = lambda h: F.coalesce(F.array_contains("_active", h), F.lit(False))
    old = F.filter(F.coalesce("artifact_hashes", F.array()), lambda h: ~is_active(h))
    a = a.select(*approvals.columns, F.size(old).cast("long").alias("stale_hashes"))
    in_force = F.coalesce(F.col("expires_at") > as_of, F.lit(True)) & F.col("invalidated_at").isNull()
    return a.withColumn(
        "valid", (F.col("decision") == "APPROVED") & in_force & (F.col("stale_hashes") == 0)
    )


# --- gates ----------------------------------------------------------------------------------------

def _newest_report(report_type: str) -> Column:
    of_type = F.when(F.col("report_type") == report_type, F.struct("seq", "decision"))
    return F.max(of_type)["decision"]


def log_board(log: DataFrame) -> DataFrame:
    """State and newest reports of each project in one aggregate of its log.

    ``log`` is ``(project_id, time, seq, to_state, report_type, decision)``; a row may hold a new state, a report, or
    both. Gives ``(project_id, current_state, seq, transitions, reports)``, ``reports`` a map of the report types
    that gates ask for.
    """
    moved = F.when(F.col("to_state").isNotNull(), F.struct("time", "seq", "to_state"))
    g = log.groupBy("project_id").agg(
        F.max(moved).alias("_n"), F.count("to_state").alias("transitions"),
        *[_newest_report(t).alias(f"_r{i}") for i, t in enumerate(REPORT_TYPES)],
    )
    reports = F.create_map(*[c for i, t in enumerate(REPORT_TYPES) for c in (F.lit(t), F.col(f"_r{i}"))])
    return g.select(
        "project_id", F.col("_n")["to_state"].alias("current_state"), F.col("_n")["seq"].alias("seq"), "transitions",
        reports.alias("reports"),
    )


def approval_keys(valid_approvals: DataFrame) -> DataFrame:
    """Gates each project is cleared for, ``gate`` or ``gate:language``: a set, at most one entry a gate and language.

    ``valid_approvals`` is ``(project_id, gate, language)`` with an empty language for project-level gates.
    """
    key = F.when(F.col("language") == "", F.col("gate")).otherwise(F.concat_ws(":", "gate", "language"))
    return valid_approvals.groupBy("project_id").agg(F.collect_set(key).alias("approvals"))


def board(
    states: DataFrame, reports: DataFrame, valid_approvals: DataFrame, tracks: DataFrame, rights: DataFrame
) -> DataFrame:
    """All that gates look at, one row a project, from tables of their own; ``reports`` may hold older ones with a ``seq``."""
    newest = F.max(F.struct("seq", "decision"))["decision"] if "seq" in reports.columns else F.max("decision")
    last = reports.groupBy("project_id", "report_type").agg(newest.alias("decision"))
    by_type = F.map_from_entries(F.collect_list(F.struct("report_type", "decision"))).alias("reports")
    of_track = F.struct("language", "skip_translation", "auto_translate", "dub_enabled")
    out = states.select("project_id", "current_state")
    for part in (
        last.groupBy("project_id").agg(by_type), approval_keys(valid_approvals),
        tracks.groupBy("project_id").agg(F.collect_list(of_track).alias("tracks")), rights.select("project_id", "rights_status"),
    ):
        out = out.join(part, "project_id", "left")
    return out


def check_gates(projects: DataFrame, accepted: Sequence[str] = ("PASS", "CONDITIONAL_PASS")) -> DataFrame:
    """The edge each project would take next, what keeps it from that, and what to do, without a join of tables.

    ``projects`` is a board: ``(project_id, current_state, reports, approvals, tracks, rights_status)``. Adds
    ``next_state`` (null at the end), ``blockers`` (an array of kind and detail) and ``action``: TERMINAL, STOP_AT_GATE
    (only a human approval is missing), BLOCKED or PROCEED.
    """
    none = F.array().cast("array<string>")
    dubs = F.coalesce(F.exists("tracks", lambda t: t["dub_enabled"]), F.lit(False))
    b = projects.withColumn("_dubs", dubs)
    e = F.broadcast(edges(projects.sparkSession).select(  # a fixed list
        F.col("current_state").alias("_from"), "next_state", F.col("reports").alias("_needed"), "gate", "per_language",
        "needs_rights", "with_dubs",
    ))
    fits = F.col("with_dubs").isNull() | (F.col("with_dubs") == F.col("_dubs"))
    b = b.join(e, (F.col("current_state") == F.col("_from")) & fits, "left")

    good = lambda r: F.coalesce(F.col("reports")[r].isin(list(accepted)), F.lit(False))
    reports = F.filter(F.coalesce("_needed", none), lambda r: ~good(r))
    human = F.filter("tracks", lambda t: ~t["skip_translation"] & ~t["auto_translate"] & ((F.col("gate") != "audio_qa") | t["dub_enabled"]))
    asked = F.when(F.col("per_language"), F.transform(human, lambda t: F.concat_ws(":", F.col("gate"), t["language"]))).when(
        F.col("gate").isNotNull(), F.array("gate")
    )
    cleared = lambda a: F.coalesce(F.array_contains("approvals", a), F.lit(False))
    approvals = F.filter(F.coalesce(asked, none), lambda a: ~cleared(a))
    rights = F.when(
        F.col("needs_rights") & ~F.coalesce(F.col("rights_status").isin(DISTRIBUTABLE), F.lit(False)), F.array(F.lit("rights_status"))
    )
    def blocked(kind: str, details: Column) -> Column:
        return F.transform(details, lambda d: F.struct(F.lit(kind).alias("kind"), d.alias("detail")))

    b = b.withColumn("blockers", F.concat(
        blocked("report", reports), blocked("approval", approvals), blocked("rights", F.coalesce(rights, none))
    ))
    action = (
        F.when(F.col("next_state").isNull(), "TERMINAL")
        .when(F.exists("blockers", lambda x: x["kind"] != "approval"), "BLOCKED")
        .when(F.size("blockers") > 0, "STOP_AT_GATE")
        .otherwise("PROCEED")
    )
    return b.select(*projects.columns, "next_state", "blockers", action.alias("action"))


def gate_blockers(checked: DataFrame) -> DataFrame:
    """A row a blocker: ``(project_id, kind, detail)``."""
    return checked.select("project_id", F.inline("blockers"))


def stranded(active: DataFrame, tracks: DataFrame, dub_type: str) -> DataFrame:
    """Active dubs of tracks whose dubbing is off."""
    off = tracks.filter(~F.col("dub_enabled")).select("project_id", "language")
    return active.filter(F.col("type") == dub_type).join(off, ["project_id", "language"], "left_semi")


# --- events ---------------------------------------------------------------------------------------

def latest_state(events: DataFrame) -> DataFrame:
    """Current state per project; an aggregate that also runs on a stream."""
    newest = F.max(F.struct("time", "seq", "to_state"))
    return events.groupBy("project_id").agg(newest.alias("_n"), F.count(F.lit(1)).alias("transitions")).select(
        "project_id", F.col("_n")["to_state"].alias("current_state"), F.col("_n")["seq"].alias("seq"), "transitions"
    )


def state_history(events: DataFrame, order: Order) -> DataFrame:
    """Each stay in a state with its length; the current stay has none."""
    e = running(events, order, _next=ordered.following(F.col("time")))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    dwell = F.floor((micros("_next") - micros("time")) / 1000)
    return e.select("project_id", "seq", F.col("to_state").alias("state"), "time", dwell.alias("dwell_ms"))


def transition_problems(events: DataFrame, order: Order, allowed: Sequence[tuple[str, str]] = tuple(ALLOWED)) -> DataFrame:
    """Transitions that do not start where the last one ended, or take an edge that is not among the allowed ones."""
    e = running(events, order, _prev=ordered.previous(F.col("to_state")))
    known = events.sparkSession.createDataFrame(sorted(set(allowed)), "from_state string, to_state string")
    e = e.join(F.broadcast(known.withColumn("_ok", F.lit(True))), ["from_state", "to_state"], "left")  # a fixed list
    rows = F.array(
        F.when(F.col("_prev").isNotNull() & ~F.col("from_state").eqNullSafe(F.col("_prev")), "broken-chain"),
        F.when(F.col("from_state").isNotNull() & F.col("_ok").isNull(), "edge-not-allowed"),
    )
    found = F.explode(F.filter(rows, lambda r: r.isNotNull()))
    return e.select("project_id", "seq", "from_state", "to_state", found.alias("problem"))


def tail(events: DataFrame, k: int) -> DataFrame:
    """Last ``k`` events per project; Spark keeps only k rows per group before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy("project_id").orderBy(F.col("seq").desc())
    return events.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


# --- tracks ---------------------------------------------------------------------------------------

def quorum(tracks: DataFrame, states: Sequence[str]) -> DataFrame:
    """Project state after its slowest track.

    Tracks that skip translation do not count. A caption-only track past caption validation does not
    hold back the audio milestones of the others.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in states]), F.col("stage")) - 1
    validated, before_package = states.index("CAPTION_VALIDATION"), states.index("PACKAGE") - 1
    t = tracks.filter(~F.col("skip_translation")).withColumn("_r", rank)
    waits = ~F.col("dub_enabled") & (F.col("_r") >= validated)
    t = t.withColumn("_e", F.when(waits, F.greatest(F.col("_r"), F.lit(before_package))).otherwise(F.col("_r")))
    g = t.groupBy("project_id").agg(
        F.min("_r").alias("_r"), F.min("_e").alias("_e"), F.max("dub_enabled").alias("_d"),
        F.count(F.lit(1)).alias("tracks"),
    )
    top = F.when(F.col("_d"), F.col("_e")).otherwise(F.col("_r"))
    name = F.element_at(F.array(*[F.lit(s) for s in states]), (top + 1).cast("int"))
    return g.select("project_id", name.alias("current_state"), "tracks")


def scope_markers(tracks: DataFrame, human_language: str = "en") -> DataFrame:
    """Recompute which tracks skip translation or translate automatically, and what changed."""
    skip = F.col("language") == F.col("source")
    auto = ~skip & (F.col("language") != human_language)
    t = tracks.withColumns({"skip_now": skip, "auto_now": auto})
    return t.withColumns({
        "marked_skip": F.col("skip_now") & ~F.col("skip_translation"),
        "marked_auto": F.col("auto_now") & ~F.col("auto_translate"),
        "cleared": (~F.col("skip_now") & F.col("skip_translation")) | (~F.col("auto_now") & F.col("auto_translate")),
    })
