"""Dub timelines: rendered audio, freeze and trim plans, drift, silence, retimed captions.

All functions read cue rows with ``project_id, language, cue_id, start_ms, end_ms, natural_ms,
keep_source`` and an ``Order`` over them; every running value is a closed form, so a track of any
length needs no fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions.timecode import respeed
from cuelake.operators import ordered
from cuelake.operators.intervals import clip_overlaps
from cuelake.operators.ordered import ROWS_PER_BLOCK, Order, running

NATURAL_PAUSE_MS = 700
SILENT_FLOOR_MS = 250
SILENT_BAR_MS = 7000
DRIFT_TOLERANCE_MS = 150
MAX_FREEZE_MS = 4000
TRACK = ("project_id", "language")


def rendered_timeline(cues: DataFrame, order: Order) -> DataFrame:
    """Audio back to back; a cue waits for its own start when the audio before it ends early."""
    c = running(cues, order, _before=ordered.total(F.col("natural_ms"), current=False))
    c = running(c, order, _wait=ordered.highest(F.col("start_ms") - F.col("_before")))
    start = F.col("_before") + F.greatest(F.lit(0), F.col("_wait"))
    return _place(c, start, "_before", "_wait")


def still_image_timeline(
    cues: DataFrame, order: Order, natural_pause_ms: int = NATURAL_PAUSE_MS
) -> DataFrame:
    """Over a still image only the natural pauses of the source are kept as lead silence."""
    c = running(cues, order, _prev_end=ordered.previous(F.col("end_ms")))
    pause = F.col("start_ms") - F.col("_prev_end")
    lead = F.when(F.col("_prev_end").isNull(), F.greatest(F.lit(0), F.col("start_ms"))).when(
        pause >= natural_pause_ms, pause
    ).otherwise(0)
    c = c.withColumn("_lead", lead)
    c = running(
        c, order, _leads=ordered.total(F.col("_lead")),
        _before=ordered.total(F.col("natural_ms"), current=False),
    )
    return _place(c, F.col("_leads") + F.col("_before"), "_prev_end", "_lead", "_leads", "_before")


def _place(c: DataFrame, start: Column, *helpers: str) -> DataFrame:
    c = c.withColumn("rendered_start_ms", start)
    return c.withColumn("rendered_end_ms", F.col("rendered_start_ms") + F.col("natural_ms")).drop(*helpers)


def freeze_plan(measures: DataFrame, order: Order, trim: bool) -> DataFrame:
    """Per cue ``freeze_ms`` and ``trim_ms`` that keep the picture in step with the audio.

    ``net_ms`` is the picture offset after the cue; ``last_cue`` marks the end of the track.
    """
    gap = F.col("rendered_start_ms") - F.col("start_ms")
    if trim:
        m = running(
            measures, order, _prev=ordered.previous(gap), _next=ordered.following(F.col("cue_id"))
        )
        step = gap - F.coalesce(F.col("_prev"), F.lit(0))
        m = m.withColumns({
            "freeze_ms": F.greatest(step, F.lit(0)),
            "trim_ms": F.greatest(-step, F.lit(0)),
            "net_ms": gap,
        })
    else:
        m = running(
            measures, order, _prev=ordered.highest(gap, current=False), _upto=ordered.highest(gap),
            _next=ordered.following(F.col("cue_id")),
        )
        net = F.greatest(F.col("_upto"), F.lit(0))
        m = m.withColumns({
            "freeze_ms": net - F.greatest(F.coalesce(F.col("_prev"), F.lit(0)), F.lit(0)),
            "trim_ms": F.lit(0).cast("long"),
            "net_ms": net,
        })
    return m.withColumn("last_cue", F.col("_next").isNull()).drop("_prev", "_next", "_upto")


def plan_events(planned: DataFrame, source: DataFrame, trim: bool) -> DataFrame:
    """The plan as rows: one per freeze or trim, and the tail that ends picture and audio together."""
    p = planned.join(source, list(TRACK), "left")
    at, cue = F.col("start_ms"), F.col("cue_id")
    slot = F.greatest(F.lit(1), F.col("end_ms") - at)
    tail = F.col("rendered_end_ms") - (F.col("source_ms") + F.col("net_ms"))

    def event(kind: str, at_ms: Column, amount: Column, natural: Column, slot_ms: Column, is_tail: bool):
        return F.struct(
            F.lit(kind).alias("kind"), cue.alias("cue_id"), at_ms.alias("at_ms"),
            amount.alias("amount_ms"), natural.alias("natural_ms"), slot_ms.alias("slot_ms"),
            F.lit(is_tail).alias("tail"),
        )

    natural, zero, one = F.col("natural_ms"), F.lit(0).cast("long"), F.lit(1).cast("long")
    rows = [
        F.when(F.col("freeze_ms") > 0, event("freeze", at, F.col("freeze_ms"), natural, slot, False)),
        F.when(F.col("trim_ms") > 0, event("trim", at, F.col("trim_ms"), natural, slot, False)),
        F.when(F.col("last_cue") & (tail > 0), event("freeze", F.col("source_ms"), tail, zero, one, True)),
    ]
    if trim:
        back = F.greatest(F.lit(0), F.col("source_ms") + tail)
        rows.append(F.when(F.col("last_cue") & (tail < 0), event("trim", back, -tail, zero, one, True)))
    kept = F.filter(F.array(*rows), lambda e: e.isNotNull())
    return p.select(*TRACK, F.inline(kept))


def drift(planned: DataFrame, order: Order, tolerance_ms: int = DRIFT_TOLERANCE_MS) -> DataFrame:
    """Residual drift of each cue once the plan is applied."""
    p = running(planned, order, _net=ordered.total(F.col("freeze_ms") - F.col("trim_ms")))
    d = F.col("rendered_start_ms") - (F.col("start_ms") + F.col("_net"))
    return _judge(p.withColumn("drift_ms", d), F.col("drift_ms"), tolerance_ms).drop("_net")


def no_drift(measures: DataFrame) -> DataFrame:
    """Over a still image no cue can be out of step."""
    m = measures.withColumns({"drift_ms": F.lit(0).cast("long"), "freeze_ms": F.lit(0).cast("long"), "trim_ms": F.lit(0).cast("long")})
    return _judge(m, F.col("drift_ms"), DRIFT_TOLERANCE_MS)


def stretch_factor(natural_ms: Column, slot_ms: Column) -> Column:
    """Natural length over the slot's, to four places, halves up; computed in whole numbers."""
    slot = F.greatest(F.lit(1), slot_ms)
    return F.floor((natural_ms * 20_000 + slot) / (2 * slot)) / 10_000.0


def sync_cues(drifts: DataFrame) -> DataFrame:
    """The per-cue rows of a sync report."""
    return drifts.select(
        *TRACK, "cue_id", "start_ms", "end_ms", "rendered_start_ms", "rendered_end_ms",
        F.col("cumulative_ms").alias("drift_ms"),
        stretch_factor(F.col("natural_ms"), F.col("end_ms") - F.col("start_ms")).alias("stretch_factor"),
        "over_tolerance", (F.col("freeze_ms") > 0).alias("freeze_planned"), "freeze_ms",
        (F.col("trim_ms") > 0).alias("trim_planned"), "trim_ms",
    )


def drift_with_resets(
    measures: DataFrame, order: Order, tolerance_ms: int = DRIFT_TOLERANCE_MS,
    natural_pause_ms: int = NATURAL_PAUSE_MS,
) -> DataFrame:
    """Without a plan, end drift adds up from one natural pause to the next."""
    m = running(measures, order, _prev_end=ordered.previous(F.col("end_ms")))
    m = m.withColumns({
        "drift_ms": F.col("rendered_end_ms") - F.col("end_ms"),
        "reset_here": F.col("_prev_end").isNull()
        | (F.col("start_ms") - F.col("_prev_end") >= natural_pause_ms),
    })
    m = running(m, order, _sum=ordered.total(F.col("drift_ms")))
    base = F.when(F.col("reset_here"), F.struct("cue_id", (F.col("_sum") - F.col("drift_ms")).alias("v")))
    m = running(m, order, _base=ordered.highest(base))
    return _judge(m, F.col("_sum") - F.col("_base")["v"], tolerance_ms).drop("_prev_end", "_sum", "_base")


def _judge(m: DataFrame, cumulative: Column, tolerance_ms: int) -> DataFrame:
    return m.withColumn("cumulative_ms", cumulative).withColumn(
        "over_tolerance", F.abs(F.col("cumulative_ms")) > tolerance_ms
    )


def sync_summary(drifts: DataFrame) -> DataFrame:
    """Per track: largest drift, last offset, cues over tolerance, total freeze and trim."""
    return drifts.groupBy(*TRACK).agg(
        F.max(F.abs("cumulative_ms")).alias("max_abs_drift_ms"),
        F.max_by("cumulative_ms", "cue_id").alias("cumulative_offset_ms"),
        F.sum(F.col("over_tolerance").cast("long")).alias("cues_over_tolerance"),
        F.coalesce(F.min(F.when(F.col("over_tolerance"), F.col("cue_id"))), F.lit(-1)).alias("first_over_tolerance"),
        F.count(F.lit(1)).alias("cues"),
    )


def silent_spans(measures: DataFrame, order: Order, floor_ms: int = SILENT_FLOOR_MS) -> DataFrame:
    """Silence between audible cues on the rendered timeline, unless it touches kept source audio.

    Rendered starts never fall along the track, so a kept cue touches the gap before cue *i* exactly
    when the latest kept end up to *i* reaches the gap's start.
    """
    audible = measures.filter(F.col("keep_source") | (F.col("natural_ms") > 1))
    end = F.col("rendered_end_ms")
    a = running(
        audible, order, _prev=ordered.highest(end, current=False),
        _kept=ordered.highest(F.when(F.col("keep_source"), end)),
    )
    start = F.coalesce(F.col("_prev"), F.lit(0))
    a = a.select(
        *TRACK, "cue_id", start.alias("gap_start_ms"), F.col("rendered_start_ms").alias("gap_end_ms"), "_kept"
    )
    a = a.withColumn("duration_ms", F.col("gap_end_ms") - F.col("gap_start_ms"))
    touches = F.coalesce(F.col("_kept") >= F.col("gap_start_ms"), F.lit(False))
    return a.filter((F.col("duration_ms") >= floor_ms) & ~touches).drop("_kept")


def audio_findings(
    drifts: DataFrame, spans: DataFrame, max_freeze_ms: int = MAX_FREEZE_MS,
    silent_bar_ms: int = SILENT_BAR_MS,
) -> DataFrame:
    """Findings of the audio check, one row each."""
    def finding(severity: str, category: str) -> Column:
        return F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"))

    rows = F.array(
        F.when(F.col("freeze_ms") > max_freeze_ms, finding("major", "audio-freeze-excessive"))
        .when(F.col("freeze_ms") > 0, finding("note", "audio-freeze-planned")),
        F.when(F.col("over_tolerance"), finding("major", "audio-drift")),
    )
    cue_rows = drifts.select(*TRACK, "cue_id", F.inline(F.filter(rows, lambda f: f.isNotNull())))
    long_gaps = spans.filter(F.col("duration_ms") > silent_bar_ms).select(
        *TRACK, "cue_id", F.lit("blocker").alias("severity"), F.lit("audio-silent-span").alias("category")
    )
    return cue_rows.unionByName(long_gaps)


def retiming_windows(
    events: DataFrame, source: DataFrame, order: Order, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Plan events to windows ``(win_start_ms, win_end_ms, offset_ms)`` of the source timeline.

    A trim sets the cursor, also back; a freeze only raises it. ``order`` tells whether the tracks
    are cut into blocks; plan events are then cut by time.
    """
    start = source.select(
        *TRACK, "source_ms", F.lit("freeze").alias("kind"), F.lit(-1).cast("long").alias("cue_id"),
        F.lit(-1).cast("long").alias("at_ms"), F.lit(0).cast("long").alias("amount_ms"), F.lit(False).alias("tail"),
    )
    e = events.select(*TRACK, "kind", "cue_id", "at_ms", "amount_ms", "tail").join(source, list(TRACK))
    e = start.unionByName(e)
    is_trim = F.col("kind") == "trim"
    e = e.withColumns({
        "_rank": F.when(is_trim, 0).otherwise(1),
        "_late": F.col("tail").cast("int"),
        "_drop_end": F.least(F.col("at_ms") + F.col("amount_ms"), F.col("source_ms")),
    })
    by = ("at_ms", "_rank", "_late", "cue_id")
    block = ()
    if order.block:
        e = e.withColumn("_when", F.floor(F.col("at_ms") / (rows_per_block * 1000)))
        block = ("_when",)
    o = Order(TRACK, by, block)
    shift = F.when(is_trim, F.col("at_ms") - F.col("_drop_end")).otherwise(F.col("amount_ms"))
    e = running(
        e, o, _island=ordered.total(is_trim.cast("long")), _net=ordered.total(shift, current=False),
        _all=ordered.total(shift),
    )
    reach = F.struct(
        F.col("_island"), F.when(is_trim, F.col("_drop_end")).otherwise(F.col("at_ms")).alias("v")
    )
    e = running(
        e, o, _cursor=ordered.highest(reach, current=False), _after=ordered.highest(reach),
        _next=ordered.following(F.col("at_ms")),
    )
    zero = F.lit(0).cast("long")
    e = e.withColumns({
        "_cursor": F.greatest(F.coalesce(F.col("_cursor")["v"], zero), zero),
        "_after": F.greatest(F.col("_after")["v"], zero),
    })
    e = running(e, o, _windows=ordered.total((F.col("at_ms") > F.col("_cursor")).cast("long")))

    def window(a: Column, b: Column, off: Column) -> Column:
        return F.struct(a.alias("win_start_ms"), b.alias("win_end_ms"), off.alias("offset_ms"))

    last = F.col("_next").isNull()
    dur = F.col("source_ms")
    rows = F.array(
        F.when(F.col("at_ms") > F.col("_cursor"),
               window(F.col("_cursor"), F.col("at_ms"), F.col("_cursor") + F.col("_net"))),
        F.when(last & (dur > F.col("_after")), window(F.col("_after"), dur, F.col("_after") + F.col("_all"))),
        F.when(last & (dur <= F.col("_after")) & (F.col("_windows") == 0),
               window(zero, F.greatest(dur, F.lit(1)), F.col("_all"))),
    )
    return e.select(*TRACK, F.inline(F.filter(rows, lambda r: r.isNotNull())))


def retimed_captions(cues: DataFrame, order: Order, windows: DataFrame) -> DataFrame:
    """Captions on the timeline after freezes and trims, renumbered in (window, cue) order."""
    clips = clip_overlaps(cues, windows, list(TRACK))
    o = Order(TRACK, ("win_start_ms", "cue_id"), order.block)
    out = running(clips, o, new_id=ordered.position())
    return out.withColumn("new_id", F.col("new_id") - 1)


def respeed_timeline(cues: DataFrame, factor_permille: Column, low: int = 500, high: int = 4000) -> DataFrame:
    """Uniform playback speed, in thousandths; 1000 leaves the timing as it is.

    A factor outside ``low`` to ``high`` is rejected: the timing stays, and ``speed_ok`` is false.
    """
    ok = factor_permille.between(low, high)
    used = F.when(ok, factor_permille).otherwise(1000)
    timed = {c: respeed(F.col(c), used) for c in ("start_ms", "end_ms", "natural_ms")}
    return cues.withColumns({**timed, "speed_ok": F.coalesce(ok, F.lit(False))})
