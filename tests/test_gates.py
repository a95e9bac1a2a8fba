"""Artifacts, approvals, gates, runs, ledgers, catalogs, languages."""

import random

import pytest
from pyspark.sql import functions as F

from cuelake.operators import catalog, intervals, languages, ledger, packaging, runlog, runs
from cuelake.operators import provenance as pv
from cuelake.operators.ordered import Order, arrange


LISTED = Order(("project_id",), ("idx",))


def ladder(calls, ceiling):
    spent, out = 0, []
    for guarded, cents in calls:
        ok = not guarded or spent + cents <= ceiling
        spent += cents if guarded and ok else 0
        out.append(ok)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_admission_in_rounds_equals_the_loop(spark, seed):
    rnd = random.Random(seed)
    data, want = [], {}
    for ledger_id in (1, 2, 3):
        calls = [(rnd.random() < 0.9, rnd.choice([0, rnd.randrange(1, 40), rnd.randrange(1, 900)])) for _ in range(80)]
        data += [(ledger_id, i, g, c) for i, (g, c) in enumerate(calls)]
        want.update({(ledger_id, i): ok for i, ok in enumerate(ladder(calls, 1000))})
    df = spark.createDataFrame(data, "ledger_id long, seq long, guarded boolean, cents long")
    for size in (1000, 25):
        cut, order = arrange(df, ["ledger_id"], ["seq"], rows_per_block=size)
        assert bool(order.block) == (size == 25)
        got = {(r.ledger_id, r.seq): r.admitted for r in ledger.admit(cut, order, 1000).collect()}
        assert got == want


def test_versions_and_active(spark):
    rows = [(1, "t", "fa", i, sha) for i, sha in enumerate(["a", "a", "b", "a", "a", "c"], start=1)]
    df = spark.createDataFrame(rows, "project_id long, type string, language string, seq long, sha256 string")
    got = [(r.seq, r.version, r.supersedes) for r in pv.versions(df).orderBy("seq").collect()]
    assert got == [(1, 1, None), (3, 2, 1), (4, 3, 3), (6, 4, 4)]
    blocked = df.withColumn("_block0", F.floor(F.col("seq") / 2))
    got = [(r.seq, r.version, r.supersedes) for r in pv.versions(blocked, ("_block0",)).orderBy("seq").collect()]
    assert got == [(1, 1, None), (3, 2, 1), (4, 3, 3), (6, 4, 4)]
    act = pv.active_artifacts(df.withColumn("created_at", F.col("seq"))).first()
    assert act.sha256 == "c"


def test_lineage_of_a_chain_and_a_diamond(spark):
    parents = spark.createDataFrame([(1, 5, 4), (1, 5, 3), (1, 4, 2), (1, 3, 2), (1, 2, 1)], "project_id long, seq long, parent long")
    out = pv.lineage(spark.createDataFrame([(1, 5)], "project_id long, seq long"), parents)
    assert sorted(r.source_seq for r in out.collect()) == [1, 2, 3, 4]


def test_approvals(spark):
    cols = "approval_id long, project_id long, gate string, artifact_hashes array<string>, decision string, expires_at timestamp, invalidated_at timestamp"
    rows = [(1, 1, "g", ["a"], "APPROVED", None, None), (2, 1, "g", ["a", "old"], "APPROVED", None, None), (3, 1, "g", ["a"], "REJECTED", None, None)]
    a = spark.createDataFrame(rows, cols)
    active = spark.createDataFrame([(1, "a"), (1, "b")], "project_id long, sha256 string")
    got = {r.approval_id: r.valid for r in pv.approval_states(a, active, F.current_timestamp()).collect()}
    assert got == {1: True, 2: False, 3: False}


def gate(spark, state, reports=(), approvals=(), rights="licensed", tracks=None):
    s = spark.createDataFrame([(1, state)], "project_id long, current_state string")
    t = spark.createDataFrame(
        tracks or [(1, "en", False, False, True), (1, "fr", False, True, False), (1, "fa", True, False, False)],
        "project_id long, language string, skip_translation boolean, auto_translate boolean, dub_enabled boolean",
    )
    r = spark.createDataFrame([(1, *x) for x in reports], "project_id long, report_type string, decision string")
    a = spark.createDataFrame([(1, *x) for x in approvals], "project_id long, gate string, language string")
    d = spark.createDataFrame([(1, rights)], "project_id long, rights_status string")
    checked = pv.check_gates(pv.board(s, r, a, t, d))
    return sorted((b.kind, b.detail) for b in pv.gate_blockers(checked).collect()), checked.first()


def test_board_from_a_log(spark):
    rows = [(1, 1, "INGEST", None, None), (1, 2, None, "caption", "FAIL"), (1, 3, "CAPTION_VALIDATION", None, None),
            (1, 4, None, "caption", "PASS"), (1, 5, None, "unheard-of", "FAIL"), (2, 1, None, "final", "PASS")]
    log = spark.createDataFrame(rows, "project_id long, seq long, to_state string, report_type string, decision string")
    got = {r.project_id: r for r in pv.log_board(log.withColumn("time", F.col("seq"))).collect()}
    assert (got[1].current_state, got[1].seq, got[1].transitions) == ("CAPTION_VALIDATION", 3, 2)
    assert got[1].reports["caption"] == "PASS" and got[1].reports["final"] is None
    assert (got[2].current_state, got[2].transitions, got[2].reports["final"]) == (None, 0, "PASS")


def test_a_project_without_anything_else_is_blocked_or_done(spark):
    assert gate(spark, "TRANSCRIPT_QA_GATE", tracks=[(2, "en", False, False, True)])[0] == [("approval", "transcript_qa"), ("report", "transcript-qa")]
    assert gate(spark, "UNHEARD_OF")[1].action == "TERMINAL"


def test_gate_demands_only_human_tracks(spark):
    good = [("translation-qa", "PASS"), ("glossary", "CONDITIONAL_PASS")]
    b, n = gate(spark, "TRANSLATION_QA_GATE", good)
    assert b == [("approval", "translation_qa:en")] and n.action == "STOP_AT_GATE"
    b, n = gate(spark, "TRANSLATION_QA_GATE", good, [("translation_qa", "en")])
    assert b == [] and n.action == "PROCEED"
    b, n = gate(spark, "TRANSLATION_QA_GATE", [("translation-qa", "FAIL")])
    assert n.action == "BLOCKED" and ("report", "translation-qa") in b and ("report", "glossary") in b


def test_rights_and_terminal(spark):
    assert gate(spark, "PACKAGE", rights="do-not-distribute")[0] == [("rights", "rights_status")]
    assert gate(spark, "PACKAGE")[1].action == "PROCEED"
    assert gate(spark, "READY_FOR_REVIEW")[1].action == "TERMINAL"
    assert gate(spark, "CAPTION_VALIDATION", [("caption", "PASS")])[1].next_state == "DUBBING"
    no_dubs = [(1, "en", False, False, False)]
    assert gate(spark, "CAPTION_VALIDATION", [("caption", "PASS")], tracks=no_dubs)[1].next_state == "PACKAGE"


def test_quorum_follows_the_slowest_track(spark):
    from cuelake.sources.fixtures import STATES

    cols = "project_id long, stage string, skip_translation boolean, dub_enabled boolean"
    rows = [
        (1, "TRANSLATION_QA_GATE", False, True), (1, "TRANSLATION", False, False), (1, "INGEST", True, False),
        (2, "AUDIO_QA_GATE", False, True), (2, "CAPTION_VALIDATION", False, False),
        (3, "CAPTION_VALIDATION", False, False),
    ]
    got = {r.project_id: r.current_state for r in pv.quorum(spark.createDataFrame(rows, cols), STATES).collect()}
    assert got == {1: "TRANSLATION", 2: "AUDIO_QA_GATE", 3: "CAPTION_VALIDATION"}


def test_scope_markers(spark):
    cols = "language string, source string, skip_translation boolean, auto_translate boolean"
    rows = [("fa", "fa", False, True), ("en", "fa", False, False), ("fr", "fa", False, False), ("es", "fa", False, True)]
    got = {r.language: (r.marked_skip, r.marked_auto, r.cleared) for r in pv.scope_markers(spark.createDataFrame(rows, cols)).collect()}
    assert got == {"fa": (True, False, True), "en": (False, False, False), "fr": (False, True, False), "es": (False, False, False)}


def test_catalog(spark):
    cols = "video_id string, seq long, url string, title string"
    rows = [("yt-abc", 1, "u", "Keep me"), ("yt-abc", 2, "u", None), ("Bad ID!", 3, "u", "x"), ("yt-abc", 4, "v", "New")]
    u = spark.createDataFrame(rows, cols)
    r = catalog.upsert(u.filter("seq < 4"), ["url", "title"]).collect()
    assert [(x.video_id, x.title) for x in r] == [("yt-abc", "Keep me")]
    for size in (2, 1000):
        a, order = arrange(u, ["video_id"], ["seq"], rows_per_block=size)
        e = catalog.upsert_events(a, order, ["url", "title"]).orderBy("seq").collect()
        assert [(x.event, x.changed) for x in e] == [
            ("CATALOG_ENTRY_ADDED", "url,title"), ("CATALOG_ENTRY_MERGED", ""), ("CATALOG_ENTRY_MERGED", "url,title")]
    with pytest.raises(ValueError):
        catalog.check_fields(u.withColumn("bogus", F.lit(1)), ["video_id", "seq", "url", "title"])
    kept, events = catalog.remove(catalog.upsert(u, ["url"]), spark.createDataFrame([("yt-abc",), ("yt-zzz",)], "video_id string"))
    assert kept.count() == 0 and {(x.video_id, x.removed) for x in events.collect()} == {("yt-abc", True), ("yt-zzz", False)}


def test_playlist_keeps_the_latest_order(spark):
    rows = [("PL", "1", i, v) for i, v in enumerate("ZAM", 1)] + [("PL", "2", i, v) for i, v in enumerate("MZAZ", 1)]
    items = spark.createDataFrame(rows, "playlist_id string, enumeration string, ordinal long, video_id string")
    known = spark.createDataFrame([("A",)], "video_id string")
    got = [(r.video_id, r.link) for r in catalog.merge_playlist(items, known).orderBy("ordinal").collect()]
    assert got == [("M", "added"), ("Z", "added"), ("A", "linked")]


def test_status_tally_is_unfiltered(spark):
    e = spark.createDataFrame([("a", "done"), ("b", "in-progress"), ("c", None)], "video_id string, status string")
    tally, listed = catalog.summarize(e, ["done"])
    assert {r.status: r.entries for r in tally.collect()} == {"done": 1, "in-progress": 1, "unknown": 1}
    assert [r.video_id for r in listed.collect()] == ["a"]


def plan(spark, **over):
    row = {"source": "fa", "targets": ["en", "fa", "ar", "es"], "dubs": ["en", "ar"], "captions": ["en", "fa", "ar", "es"], **over}
    df = spark.createDataFrame([tuple(row.values())], "source string, targets array<string>, dubs array<string>, captions array<string>")
    return languages.language_plan(df, ["en", "fa", "ar", "es", "ru", "de"]).first()


def test_language_plan(spark):
    p = plan(spark)
    assert p.translate == ["en", "ar", "es"] and p.caption_langs == ["fa", "en", "ar", "es"] and p.error is None
    assert "self-translation:fa" in p.notes
    p = plan(spark, dubs=["en", "ru"], captions=["en", "de"])
    assert p.dub_langs == ["en"] and p.caption_langs == ["en"]
    assert "dub-ignored:ru" in p.notes and "caption-ignored:de" in p.notes
    assert plan(spark, captions=["de"]).caption_langs == ["fa", "en", "ar", "es"]
    assert plan(spark, source=" ").error == "missing-source"
    assert plan(spark, targets=["urdu"]).error == "unknown-code"


def test_voice_plan(spark):
    rows = [("en", None, None, True), ("ar", None, False, True), ("en", "piper", True, True), ("de", None, True, False),
            ("fa", "xtts", None, True), ("fa", None, True, True), ("ur", "piper", None, True), ("en", None, None, False)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, language string, provider string, voice_clone boolean, clone_default boolean")
    got = [(r.clone, r.error) for r in languages.voice_plan(d, ["en", "ar"]).orderBy("i").collect()]
    assert got == [(True, None), (False, None), (False, None), (True, None), (False, "piper-only-provider"),
                   (False, "piper-only-clone"), (False, None), (False, None)]


def test_add_languages(spark):
    rows = [(["en", "fa"], ["zh", "fr"], None), (["en"], ["zh"], ["en"]), (["en"], ["klingon"], None), (["en"], ["en"], None)]
    r = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, present array<string>, wanted array<string>, wanted_dubs array<string>")
    got = [(x.added, x.dubbed, x.error) for x in languages.add_languages(r).orderBy("i").collect()]
    assert got == [(["zh", "fr"], ["zh", "fr"], None), (["zh"], ["en"], "dub-not-added"), (["klingon"], ["klingon"], "unknown-code"), ([], [], None)]


def test_effective_config(spark):
    defaults = {"a": {"x": 1, "y": 2}, "langs": ["en"], "s": "v"}
    e = spark.createDataFrame([(1, {"a.x": "9", "langs": '["fa"]', "id": '"k"'}), (2, {"a": "null"}), (3, {"s.deep": "1"})], "video_id long, overrides map<string,string>")
    out = {}
    for r in languages.effective_config(e, defaults).collect():
        out.setdefault(r.video_id, {})[r.path] = r.value
    assert out[1] == {"a.x": "9", "a.y": "2", "langs": '["fa"]', "s": '"v"', "id": '"k"'}
    assert out[2] == {"a": "null", "langs": '["en"]', "s": '"v"'}
    assert out[3] == {"a.x": "1", "a.y": "2", "langs": '["en"]', "s.deep": "1"}


def test_runs(spark):
    s = spark.createDataFrame(
        [(1, "dub", "en", "done", 5), (1, "dub", "fr", "failed", 0), (1, "mux", "en", "running", 0), (2, "dub", "en", "done", 0)],
        "video_id long, stage string, language string, status string, artifact_bytes long",
    )
    roll = {(r.video_id, r.stage): r.status for r in runs.stage_rollup(s).collect()}
    assert roll == {(1, "dub"): "failed", (1, "mux"): "running", (2, "dub"): "done"}
    grid = s.select("video_id", "stage", "language")
    assert {(r.video_id, r.stage, r.language) for r in runs.resume_plan(grid, s).collect()} == {(1, "dub", "fr"), (1, "mux", "en"), (2, "dub", "en")}
    loaded = runs.load_status(s.select("video_id", "stage", "status").filter("video_id = 1 and stage = 'mux'"), s.select("video_id").distinct())
    assert loaded.count() == 12 and {r.status for r in loaded.collect()} == {"pending"}


def test_packaging(spark):
    ch = spark.createDataFrame([("a", "en", False, 0), ("b", "en", True, 1), ("c", "fr", False, 2)], "channel_id string, language string, is_default boolean, ord long")
    p = spark.createDataFrame([(1, "en", None), (2, "fr", None), (3, "xx", None), (4, "en", "O")], "project_id long, language string, override_channel string")
    got = {r.project_id: r.channel_id for r in packaging.resolve_channels(p, ch).collect()}
    assert got == {1: "b", 2: "c", 3: None, 4: "O"}
    assert packaging.config_problems(ch).isEmpty()
    posts = spark.createDataFrame([(1, "t", "queued"), (2, "t", "queued"), (3, "u", "queued"), (4, "u", "sent")], "post_id long, text string, status string")
    assert [r.text for r in packaging.duplicate_posts(posts).collect()] == ["t"]


def test_segments(spark):
    cue = "project_id long, language string, cue_id long, start_ms long, end_ms long"
    c = spark.createDataFrame([(1, "fa", 0, 0, 3000), (1, "fa", 1, 3000, 9000), (1, "fa", 2, 12000, 20000)], cue)
    source = spark.createDataFrame([(1, 20000)], "project_id long, source_ms long")
    rows = [("00:00:03.100", "00:00:08.900", False, "a"), ("10", "12", True, "b"), ("1", "2", True, "c"), ("5", "5", True, "d"),
            ("1", "99", True, "e"), ("x", "2", True, "f"), ("1", "2", True, "g"), ("1", "2", True, "g"), ("14.5", "17", False, "h")]
    s = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "project_id long, idx long, start string, end string, exact boolean, id string")
    got = {r.idx: r for r in intervals.resolve_segments(s, LISTED, c, source).collect()}
    assert (got[0].start_ms, got[0].end_ms, got[0].snapped) == (3000, 9000, True)
    assert (got[1].start_ms, got[1].snapped, got[1].out_of_order) == (10000, False, False)
    assert got[2].out_of_order
    assert [got[i].status for i in range(9)] == ["ok", "ok", "ok", "end-not-after-start", "out-of-bounds", "bad-timecode", "duplicate-id", "duplicate-id", "ok"]
    assert (got[8].start_ms, got[8].end_ms) == (14500, 17000)  # nothing within two seconds
    two = s.limit(0).union(spark.createDataFrame([(1, 0, "1", "5", True, "a"), (1, 1, "4", "8", True, "b"), (1, 2, "9", "10", True, "c")], s.schema))
    got = {r.idx: r.overlaps for r in intervals.resolve_segments(two, LISTED, c, source).collect()}
    assert got == {0: False, 1: True, 2: False}


@pytest.mark.parametrize("bucket", [1000, 60000])
def test_overlap_join_and_clips(spark, bucket):
    c = spark.createDataFrame([(1, 0, 1000, 4000), (1, 1, 5000, 8000), (1, 2, 13000, 16000)], "project_id long, cue_id long, start_ms long, end_ms long")
    w = spark.createDataFrame([(1, 0, 3000, 9000, 0), (1, 1, 0, 20000, 6000)], "project_id long, clip long, win_start_ms long, win_end_ms long, offset_ms long")
    pairs = intervals.overlap_join(c, w, ["project_id"], bucket_ms=bucket)
    assert sorted((r.clip, r.cue_id) for r in pairs.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)]
    out = intervals.clip_captions(c, Order(("project_id",), ("cue_id",)), w).filter("clip = 0").orderBy("clip_cue_id").collect()
    assert [(r.clip_cue_id, r.clip_start_ms, r.clip_end_ms) for r in out] == [(0, 0, 1000), (1, 2000, 5000)]


def test_selection_hash_levels_agree_on_change(spark):
    def h(rows, join=True, fan_in=4096):
        s = spark.createDataFrame([(1, i, f"s{i}", a, b) for i, (a, b) in enumerate(rows)], "project_id long, idx long, id string, start_ms long, end_ms long")
        return intervals.selection_hash(s, F.lit(join), fan_in).first().selection_hash

    rows = [(i, i + 5) for i in range(10)]
    assert h(rows) == h(rows) and h(rows) != h(rows, join=False) and h(rows) != h(rows[:-1] + [(9, 15)])
    assert h(rows, fan_in=3) == h(rows, fan_in=3) != h(rows[:-1] + [(9, 15)], fan_in=3)


def test_whole_empty_and_unsnapped_selections(spark):
    seg = "array<struct<id:string,start:string,end:string,exact:boolean>>"
    req = spark.createDataFrame(
        [(1, None, None), (2, [], None), (3, [("a", "1.1", "5", None)], None), (4, [("a", "1.1", "5", None)], False)],
        f"project_id long, segments {seg}, snap_edges boolean",
    )
    source = spark.createDataFrame([(p, 9_500) for p in (1, 2, 3, 4)], "project_id long, source_ms long")
    cues = spark.createDataFrame([(p, 1_000, 5_000) for p in (1, 2, 3, 4)], "project_id long, start_ms long, end_ms long")
    rows, order = arrange(intervals.selection_rows(req, source), ["project_id"], ["idx"])
    got = {r.project_id: (r.id, r.start_ms, r.end_ms, r.status) for r in intervals.resolve_segments(rows, order, cues, source).collect()}
    assert got == {
        1: ("whole", 0, 9_500, "ok"), 2: (None, None, None, "empty-selection"), 3: ("a", 1_000, 5_000, "ok"), 4: ("a", 1_100, 5_000, "ok"),
    }


def test_a_selections_hash_depends_on_itself_alone(spark):
    windows = lambda p, n: [(p, i, f"s{i}", i, i + 5) for i in range(n)]

    def h(rows, fan_in):
        s = spark.createDataFrame(rows, "project_id long, idx long, id string, start_ms long, end_ms long")
        return {r.project_id: r.selection_hash for r in intervals.selection_hash(s, F.lit(True), fan_in).collect()}

    for fan_in in (2, 4, 4096):
        together = h(windows(1, 3) + windows(2, 20) + windows(3, 1) + windows(4, 70), fan_in)
        assert together == {p: h(windows(p, n), fan_in)[p] for p, n in ((1, 3), (2, 20), (3, 1), (4, 70))}
        assert len(set(together.values())) == 4


@pytest.mark.parametrize("seed", [1, 2])
def test_refunds_and_missing_costs_are_refused_alike(spark, seed):
    rng = random.Random(seed)
    data = [
        (ledger_id, i, rng.random() < 0.9, rng.choice([None, 0, -50, 50, 100, 30, 1]))
        for ledger_id in range(4) for i in range(rng.choice([3, 25, 60]))
    ]
    df = spark.createDataFrame(data, "ledger_id long, seq long, guarded boolean, cents long")
    want, spent = {}, {}
    for ledger_id, seq, guarded, cents in data:
        ok = not guarded or (cents is not None and cents >= 0 and spent.get(ledger_id, 0) + cents <= 100)
        want[ledger_id, seq] = ok
        if guarded and ok:
            spent[ledger_id] = spent.get(ledger_id, 0) + cents
    for size in (5, 1000):
        cut, order = arrange(df, ["ledger_id"], ["seq"], rows_per_block=size)
        assert {(r.ledger_id, r.seq): r.admitted for r in ledger.admit(cut, order, 100).collect()} == want


def test_run_pairs_across_blocks(spark):
    rows = [(1, "dub", i, k, rc) for i, (k, rc) in enumerate([("start", 0), ("end", 2), ("start", 0), ("start", 0), ("end", 0), ("end", 0), ("start", 0)])]
    df = spark.createDataFrame(rows, "project_id long, cmd string, seq long, kind string, rc long")
    for size in (2, 1000):
        r, order = arrange(df, ["project_id", "cmd"], ["seq"], rows_per_block=size)
        pairs = runlog.pair_runs(r, order)
        assert sorted((p.started_seq, p.ended_seq, p.failed) for p in pairs.collect()) == [(0, 1, True), (2, -1, False), (3, 4, False), (6, -1, False)]
        assert runlog.error_rates(pairs).first().error_rate == 0.5
