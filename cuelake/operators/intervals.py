"""Interval work: overlap joins, clips, edge snapping, clip selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions.text import canonical_hash
from cuelake.functions.timecode import parse_timecode
from cuelake.operators import ordered
from cuelake.operators.asof import neighbours
from cuelake.operators.ordered import ROWS_PER_BLOCK, Order, arrange, running

BUCKET_MS = 60_000
SNAP_RADIUS_MS = 2000


def _level(start: Column, end: Column, width: int) -> Column:
    """Level of an interval: the lowest whose cells, ``width`` times a power of four, hold it in three or fewer."""
    length = F.greatest(end - start, F.lit(1))
    return F.greatest(F.ceil(F.log(4.0, length / (2.0 * width))), F.lit(0)).cast("int")


def _size(level: Column, width: int) -> Column:
    return (F.pow(F.lit(4.0), level) * width).cast("long")


def _cells(start: Column, end: Column, level: Column, levels: list[int], width: int) -> Column:
    """(level, cell) on the interval's own level and on those above it that are in use."""
    def on(at: Column) -> Column:
        first = F.floor(start / _size(at, width))
        last = F.greatest(first, F.floor((end - 1) / _size(at, width)))
        return F.transform(F.sequence(first, last), lambda cell: F.struct(at.alias("level"), cell.alias("cell")))

    used = F.filter(F.array(*[F.lit(n) for n in levels]), lambda at: at >= level)
    return F.flatten(F.transform(used, on))


def overlap_join(
    cues: DataFrame, windows: DataFrame, keys: list[str], bucket_ms: int = BUCKET_MS
) -> DataFrame:
    """Cues that overlap windows ``[win_start_ms, win_end_ms)`` of the same keys, each pair once.

    Time is cut into cells on levels, four cells of one making one of the next. An interval, however long, lies in at
    most three cells of its own level, and two intervals meet on the higher of their levels: an equi-join on
    (keys, level, cell). One long track becomes many join keys, and an endless window a few rows.
    """
    c = cues.withColumn("_own", _level(F.col("start_ms"), F.col("end_ms"), bucket_ms))
    w = windows.withColumn("_win_own", _level(F.col("win_start_ms"), F.col("win_end_ms"), bucket_ms))
    used = c.select("_own").distinct().unionByName(w.select(F.col("_win_own").alias("_own")).distinct()).distinct().collect()
    levels = sorted(r["_own"] for r in used if r["_own"] is not None)  # one for each power of four that lengths reach
    if not levels:
        levels = [0]
    at = F.explode(_cells(F.col("start_ms"), F.col("end_ms"), F.col("_own"), levels, bucket_ms))
    c = c.withColumn("_at", at)
    w = w.withColumn("_at", F.explode(_cells(F.col("win_start_ms"), F.col("win_end_ms"), F.col("_win_own"), levels, bucket_ms)))
    both = c.join(w, [*keys, "_at"]).filter(
        (F.col("start_ms") < F.col("win_end_ms")) & (F.col("end_ms") > F.col("win_start_ms"))
    )
    met = F.floor(F.greatest("start_ms", "win_start_ms") / _size(F.col("_at.level"), bucket_ms)) == F.col("_at.cell")
    return both.filter(met & (F.col("_at.level") == F.greatest("_own", "_win_own"))).drop("_at", "_own", "_win_own")


def clip_overlaps(cues: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Clip overlapping cues to their window and move them to the window's ``offset_ms``."""
    j = overlap_join(cues, windows, keys)
    base = F.col("offset_ms") - F.col("win_start_ms")
    return j.withColumns({
        "clip_start_ms": F.greatest("start_ms", "win_start_ms") + base,
        "clip_end_ms": F.least("end_ms", "win_end_ms") + base,
    })


def clip_captions(cues: DataFrame, order: Order, windows: DataFrame) -> DataFrame:
    """Cues of each clip in clip-local time, numbered from 0. ``windows`` carry ``clip`` and ``offset_ms``."""
    clips = clip_overlaps(cues, windows, ["project_id"])
    o = Order(("project_id", "clip"), ("cue_id",), order.block)
    out = running(clips, o, clip_cue_id=ordered.position())
    return out.withColumn("clip_cue_id", F.col("clip_cue_id") - 1)


def _nearest(radius_ms: int) -> Column:
    """The nearer one of ``before`` and ``after`` within the radius of ``at_ms``; ties go back."""
    back = F.when(F.col("at_ms") - F.col("before") <= radius_ms, F.col("before"))
    on = F.when(F.col("after") - F.col("at_ms") <= radius_ms, F.col("after"))
    later = on - F.col("at_ms") < F.col("at_ms") - back
    return F.when(later, on).otherwise(F.coalesce(back, on))


def snap_edges(
    edges: DataFrame, boundaries: DataFrame, radius_ms: int = SNAP_RADIUS_MS, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Nearest boundary within the radius for each edge ``(project_id, at_ms, …)``; ties go back.

    Edges and boundaries are walked through together in order of time (``asof.neighbours``).
    """
    e = neighbours(edges, "at_ms", boundaries, "boundary_ms", ["project_id"], rows_per_block)
    near = _nearest(radius_ms)
    return e.select(*edges.columns, F.coalesce(near, F.col("at_ms")).alias("snapped_ms"), near.isNotNull().alias("has_candidate"))


def cue_boundaries(cues: DataFrame) -> DataFrame:
    return cues.select("project_id", F.explode(F.array("start_ms", "end_ms")).alias("boundary_ms"))


def selection_rows(requests: DataFrame, source: DataFrame) -> DataFrame:
    """Windows ``(project_id, idx, id, start, end, exact)`` of clip requests ``(project_id, segments, snap_edges)``.

    ``segments`` is an array of ``(id, start, end, exact)``. Without one (null) the whole video is the
    only window; an empty one gives a row without times, which ``resolve_segments`` rejects. With
    ``snap_edges`` false every window of the request is taken as given.
    """
    ends = source.groupBy("project_id").agg(F.max("source_ms").alias("_ms"))
    text = F.format_string("%d.%03d", F.floor(F.col("_ms") / 1000), F.col("_ms") % 1000)
    whole = requests.filter(F.col("segments").isNull()).join(ends, "project_id", "left").select(
        "project_id", F.lit(0).cast("long").alias("idx"), F.lit("whole").alias("id"), F.lit("0").alias("start"),
        F.when(F.col("_ms").isNotNull(), text).alias("end"), F.lit(True).alias("exact"),
    )
    given = requests.filter(F.col("segments").isNotNull()).select(
        "project_id", F.coalesce("snap_edges", F.lit(True)).alias("_snap"), F.posexplode_outer("segments").alias("idx", "_s")
    ).select(
        "project_id", F.coalesce("idx", F.lit(0)).cast("long").alias("idx"), "_s.id", "_s.start", "_s.end",
        (F.coalesce("_s.exact", F.lit(False)) | ~F.col("_snap")).alias("exact"),
    )
    return whole.unionByName(given)


def _snap_windows(windows: DataFrame, cues: DataFrame, radius_ms: int, rows_per_block: int) -> DataFrame:
    """Windows with ``start_ms`` and ``end_ms``: both ends moved to cue boundaries, unless ``exact``."""
    names = windows.columns
    sides = F.posexplode(F.array("req_start_ms", "req_end_ms")).alias("_side", "at_ms")
    e = neighbours(windows.select("*", sides), "at_ms", cue_boundaries(cues), "boundary_ms", ["project_id"], rows_per_block)
    e = e.withColumn("_ms", F.coalesce(F.when(~F.col("exact"), _nearest(radius_ms)), F.col("at_ms")))
    ends = [F.max(F.when(F.col("_side") == n, F.col("_ms"))).alias(c) for n, c in enumerate(("start_ms", "end_ms"))]
    kept = [F.first(c).alias(c) for c in names if c not in ("project_id", "idx")]  # the same on both sides
    return e.groupBy("project_id", "idx").agg(*kept, *ends)


def resolve_segments(
    selections: DataFrame, order: Order, cues: DataFrame, source: DataFrame, radius_ms: int = SNAP_RADIUS_MS,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Clip windows as given to checked windows in milliseconds, list order kept; ``idx`` is the place in a list.

    A row without id and times stands for an empty selection.

    ``status`` is ``ok`` or the first reason to reject the window; the notes say whether a window
    starts before the one listed before it and whether it overlaps one that starts no later.
    """
    s = selections.withColumns({
        "req_start_ms": parse_timecode(F.col("start")), "req_end_ms": parse_timecode(F.col("end"))
    })
    s = s.withColumn("exact", F.coalesce("exact", F.lit(False)))  # snapping is the default
    s = _snap_windows(ordered.unblock(s, order), cues, radius_ms, rows_per_block)
    if order.block:  # dealt by time to be snapped, now by place in the list again
        s, order = arrange(s, order.keys, order.by, rows_per_block=rows_per_block)
    s = s.withColumn("snapped", (F.col("start_ms") != F.col("req_start_ms")) | (F.col("end_ms") != F.col("req_end_ms")))

    if order.block:
        repeated = selections.groupBy("project_id", "id").agg(F.count(F.lit(1)).alias("_uses")).filter("_uses > 1")
        s = s.join(repeated, ["project_id", "id"], "left")
    else:  # selections lie together already
        uses = F.count("id").over(Window.partitionBy("project_id", "id"))
        s = s.withColumn("_uses", F.when(uses > 1, uses))
    s = s.join(
        source.groupBy("project_id").agg(F.max("source_ms").alias("source_ms")), "project_id", "left"
    )
    s = running(s, order, _prev=ordered.previous(F.col("start_ms")))
    timed = Order(order.keys, ("start_ms", "idx"))
    if order.block:  # some selection is large: cut it by time as well
        s, timed = arrange(ordered.unblock(s, order), timed.keys, timed.by)
    s = ordered.unblock(running(s, timed, _reach=ordered.highest(F.col("end_ms"), current=False)), timed)
    status = (
        F.when(F.col("source_ms").isNull(), "unknown-project")
        .when(F.col("id").isNull() & F.col("start").isNull() & F.col("end").isNull(), "empty-selection")
        .when(F.col("req_start_ms").isNull() | F.col("req_end_ms").isNull(), "bad-timecode")
        .when(F.col("_uses").isNotNull(), "duplicate-id")
        .when(F.col("end_ms") <= F.col("start_ms"), "end-not-after-start")
        .when((F.col("start_ms") < 0) | (F.col("end_ms") > F.col("source_ms")), "out-of-bounds")
        .otherwise("ok")
    )
    return s.withColumns({
        "status": status,
        "out_of_order": F.coalesce(F.col("start_ms") < F.col("_prev"), F.lit(False)),
        "overlaps": F.coalesce(F.col("start_ms") < F.col("_reach"), F.lit(False)),
    }).drop("_uses", "_prev", "_reach")


def seam_offsets(windows: DataFrame, order: Order | None) -> DataFrame:
    """Where each clip begins in the joined video: after all clips listed before it.

    Without an ``order`` the clips are not joined and each begins at 0.
    """
    if order is None:
        return windows.withColumn("offset_ms", F.lit(0).cast("long"))
    length = F.col("win_end_ms") - F.col("win_start_ms")
    return running(windows, order, offset_ms=ordered.total(length, current=False))


HASHES_PER_NODE = 4096


def selection_hash(windows: DataFrame, join_clips: Column, fan_in: int = HASHES_PER_NODE) -> DataFrame:
    """Hash per selection over its windows in list order and the join switch.

    Window hashes are combined ``fan_in`` at a time, level by level, so no row holds a whole
    selection; up to ``fan_in`` windows take one level. A selection that has come down to its first
    node is carried on unchanged while longer ones of the table go through more levels, so its hash
    depends on its own windows only.
    """
    one = canonical_hash(F.col("end_ms"), F.col("id"), F.col("start_ms"))
    h = windows.select("project_id", "idx", one.alias("h"), F.lit(1).cast("long").alias("windows"))
    top = h.agg(F.max("idx")).first()[0] or 0
    first = True
    while True:
        rows = F.sort_array(F.collect_list(F.struct("idx", "h")))
        joined = F.array_join(F.transform(rows, lambda r: r["h"]), ",")
        node = F.concat(F.lit("sha256:"), F.sha2(joined, 256))
        # on later levels a node without siblings is the root already
        node = node if first else F.when(F.max("idx") == 0, F.min("h")).otherwise(node)
        h = h.groupBy("project_id", F.floor(F.col("idx") / fan_in).alias("idx")).agg(
            node.alias("h"), F.sum("windows").alias("windows")
        )
        first = False
        top = top // fan_in
        if top == 0:
            break
    whole = canonical_hash(join_clips.alias("join_clips"), F.col("h").alias("windows"))
    return h.select("project_id", "windows", whole.alias("selection_hash"))
