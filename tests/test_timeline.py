"""Dub timeline rules: given cases, closed forms against plain loops, blocked against plain."""

import random

import pytest
from pyspark.sql import functions as F

from cuelake.operators import timeline as tl
from cuelake.operators.ordered import Order, arrange

TRACK = ["project_id", "language"]
SCHEMA = "project_id long, language string, cue_id long, start_ms long, end_ms long, natural_ms long, keep_source boolean"
MEASURED = SCHEMA + ", rendered_start_ms long, rendered_end_ms long"
ORDER = Order(("project_id", "language"), ("cue_id",))


def measures(spark, rows):
    """(caption start, caption end, rendered start, rendered end)"""
    data = [(1, "en", i, a, b, d - c, False, c, d) for i, (a, b, c, d) in enumerate(rows)]
    return spark.createDataFrame(data, MEASURED)


def source(spark, ms):
    return spark.createDataFrame([(1, "en", ms)], "project_id long, language string, source_ms long")


def events(spark, rows, ms, trim=False):
    planned = tl.freeze_plan(measures(spark, rows), ORDER, trim)
    out = tl.plan_events(planned, source(spark, ms), trim).orderBy("at_ms").collect()
    return [(r.kind, r.cue_id, r.at_ms, r.amount_ms, r.tail) for r in out]


def test_hold_plan_freezes_by_the_running_gap(spark):
    rows = [(0, 2000, 0, 2609), (2000, 4000, 2609, 4000)]
    assert events(spark, rows, 4000) == [("freeze", 1, 2000, 609, False)]


def test_tail_freeze_when_audio_outlasts_picture(spark):
    assert events(spark, [(0, 2000, 0, 6000)], 5000) == [("freeze", 0, 5000, 1000, True)]


def test_trim_mode_removes_picture_and_tail(spark):
    rows = [(1000, 2000, 1500, 2000), (3000, 4000, 3100, 3500)]
    got = events(spark, rows, 6000, trim=True)
    assert got == [("freeze", 0, 1000, 500, False), ("trim", 1, 3000, 400, False), ("trim", 1, 3400, 2600, True)]
    assert not any(k == "trim" for k, *_ in events(spark, rows, 6000))


def plan_rows(spark, rows):
    data = [(1, "en", kind, i, at, amount, False) for i, (kind, at, amount) in enumerate(rows)]
    return spark.createDataFrame(
        data, "project_id long, language string, kind string, cue_id long, at_ms long, amount_ms long, tail boolean"
    )


def windows(spark, rows, ms, order=ORDER, **kw):
    w = tl.retiming_windows(plan_rows(spark, rows), source(spark, ms), order, **kw)
    return sorted((r.win_start_ms, r.win_end_ms, r.offset_ms) for r in w.collect())


def test_retiming_windows(spark):
    assert windows(spark, [("freeze", 4000, 600), ("freeze", 8000, 300)], 10000) == [
        (0, 4000, 0), (4000, 8000, 4600), (8000, 10000, 8900)]
    assert windows(spark, [("freeze", 2000, 600), ("trim", 8000, 600)], 10000) == [
        (0, 2000, 0), (2000, 8000, 2600), (8600, 10000, 8600)]
    assert windows(spark, [], 5000) == [(0, 5000, 0)]
    assert windows(spark, [("trim", 0, 5000)], 5000) == [(0, 5000, -5000)]


def walk_windows(rows, dur):
    out, cursor, net = [], 0, 0
    for kind, at, amount in sorted(rows, key=lambda e: (e[1], e[0] == "freeze")):
        if at > cursor:
            out.append((cursor, at, cursor + net))
            cursor = at
        if kind == "freeze":
            net += amount
        else:
            end = min(at + amount, dur)
            net -= end - at
            cursor = end
    if dur > cursor:
        out.append((cursor, dur, cursor + net))
    elif not out:
        out.append((0, max(dur, 1), net))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_retiming_windows_like_a_walk(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["freeze", "trim"]), rnd.randrange(0, 9000), rnd.randrange(1, 2500)) for _ in range(12)]
    expected = walk_windows(rows, 10000)
    assert windows(spark, rows, 10000) == expected
    blocked = Order(ORDER.keys, ORDER.by, ("_block0",))
    assert windows(spark, rows, 10000, blocked, rows_per_block=2) == expected


def random_cues(spark, seed, n=60):
    rnd = random.Random(seed)
    data, at = [], 0
    for i in range(n):
        at += rnd.choice([0, 100, 300, 700, 1500, 4000])
        end = at + rnd.randrange(500, 5000)
        data.append((1, "en", i, at, end, rnd.choice([0, 1, rnd.randrange(200, 7000)]), rnd.random() < 0.2))
        at = end
    return spark.createDataFrame(data, SCHEMA), data


def loop_render(data, still):
    out, t = [], 0
    for i, (_, _, _, start, _, natural, _) in enumerate(data):
        if still and i:
            pause = start - data[i - 1][4]
            lead = pause if pause >= 700 else 0
        else:
            lead = max(0, start - t)
        t += lead
        out.append((t, t + natural))
        t += natural
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("rows_per_block", [1000, 7])
def test_chain_like_loops(spark, seed, rows_per_block):
    df, data = random_cues(spark, seed)
    df, order = arrange(df, TRACK, ["cue_id"], dense=True, rows_per_block=rows_per_block)
    assert bool(order.block) == (rows_per_block == 7)
    rendered = tl.rendered_timeline(df, order)
    placed = [(r.rendered_start_ms, r.rendered_end_ms) for r in rendered.orderBy("cue_id").collect()]
    assert placed == loop_render(data, False)
    still = tl.still_image_timeline(df, order).orderBy("cue_id").collect()
    assert [(r.rendered_start_ms, r.rendered_end_ms) for r in still] == loop_render(data, True)

    cum, want = 0, []
    for (_, _, _, start, *_), (rs, _) in zip(data, placed):
        gap = rs - (start + cum)
        want.append(max(gap, 0))
        cum += max(gap, 0)
    planned = tl.freeze_plan(rendered, order, trim=False)
    assert [r.freeze_ms for r in planned.orderBy("cue_id").collect()] == want
    drifts = tl.drift(planned, order).orderBy("cue_id").collect()
    net, expected = 0, []
    for (_, _, _, start, *_), (rs, _), f in zip(data, placed, want):
        net += f
        expected.append(rs - start - net)
    assert [r.cumulative_ms for r in drifts] == expected
    trimmed = tl.drift(tl.freeze_plan(rendered, order, trim=True), order)
    assert all(r.drift_ms == 0 for r in trimmed.collect())

    cum, expected = 0, []
    for i, ((_, _, _, start, end, *_), (_, re)) in enumerate(zip(data, placed)):
        if i == 0 or start - data[i - 1][4] >= 700:
            cum = 0
        cum += re - end
        expected.append(cum)
    resets = tl.drift_with_resets(rendered, order).orderBy("cue_id").collect()
    assert [r.cumulative_ms for r in resets] == expected

    keeps = [(a, b) for (a, b), row in zip(placed, data) if row[6]]
    spans, prev = [], 0
    for (a, b), row in zip(placed, data):
        if not (row[6] or row[5] > 1):
            continue
        touched = any(ks <= a and prev <= ke for ks, ke in keeps)
        if a - prev >= 250 and not touched:
            spans.append((prev, a))
        prev = max(prev, b)
    got = tl.silent_spans(rendered, order).orderBy("cue_id").collect()
    assert [(r.gap_start_ms, r.gap_end_ms) for r in got] == spans


def test_audio_findings(spark):
    cols = "project_id long, language string, cue_id long, freeze_ms long, over_tolerance boolean"
    d = spark.createDataFrame([(1, "en", 0, 609, False), (1, "en", 1, 9000, False), (1, "en", 2, 0, True)], cols)
    s = spark.createDataFrame([(1, "en", 3, 8000)], "project_id long, language string, cue_id long, duration_ms long")
    got = {(r.cue_id, r.severity, r.category) for r in tl.audio_findings(d, s).collect()}
    assert got == {
        (0, "note", "audio-freeze-planned"), (1, "major", "audio-freeze-excessive"), (2, "major", "audio-drift"),
        (3, "blocker", "audio-silent-span"),
    }


def test_respeed(spark):
    df, _ = random_cues(spark, 1, 5)
    same = tl.respeed_timeline(df, F.lit(1000))
    assert same.filter("speed_ok").drop("speed_ok").collect() == df.collect()
    bad = tl.respeed_timeline(df, F.lit(99_000))
    assert bad.filter("not speed_ok").drop("speed_ok").collect() == df.collect()
    half = tl.respeed_timeline(df, F.lit(2000)).orderBy("cue_id").collect()
    assert [r.start_ms for r in half] == [(r.start_ms + 1) // 2 for r in df.orderBy("cue_id").collect()]


def test_a_large_track_is_spread_by_block(spark):
    df, _ = random_cues(spark, 5, 90)
    df, order = arrange(df, TRACK, ["cue_id"], dense=True, rows_per_block=20)
    rendered = tl.rendered_timeline(df, order)
    joined = rendered.join(source(spark, 5000), TRACK)
    plan = tl.freeze_plan(joined, order, trim=True)._jdf.queryExecution().executedPlan().toString()
    assert "_block0" in plan and plan.count("Exchange hashpartitioning") <= 4
    window = plan[plan.index("Window"):]
    assert "_block0" in window.splitlines()[0]
