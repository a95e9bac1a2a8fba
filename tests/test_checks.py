"""Checks over cues, glossaries and captions."""

import pytest
from pyspark.sql import functions as F

from cuelake.operators import captions, chapters, glossary, qa
from cuelake.operators.ordered import Order, arrange

CUE = "project_id long, language string, cue_id long, start_ms long, end_ms long, source_text string, target_text string, confidence double"
ORDER = Order(("project_id", "language"), ("cue_id",))


def cues(spark, rows, language="en", project=1):
    data = [(project, language, i, a, b, s, t, c) for i, (a, b, s, t, c) in enumerate(rows)]
    return spark.createDataFrame(data, CUE)


def scope(spark, ms=None):
    return spark.createDataFrame([(1, "en", ms)], "project_id long, language string, source_ms long")


def decide(spark, rows, ms=None):
    c = cues(spark, [(a, b, t, t, conf) for a, b, t, conf in rows])
    return qa.transcript_decision(qa.transcript_checks(c, ORDER), scope(spark, ms)).first()


def test_transcript_decisions(spark):
    assert decide(spark, [(5000, 1000, "backwards", None)]).decision == "FAIL"
    assert decide(spark, [(i * 1000, i * 1000 + 900, "same", None) for i in range(4)]).repetition == 1
    assert decide(spark, [(i * 1000, i * 1000 + 900, "same", None) for i in range(4)]).decision == "FAIL"
    low = decide(spark, [(i * 1000, i * 1000 + 900, f"cue {i}", -2.0) for i in range(5)])
    assert (low.decision, low.low_confidence_share) == ("CONDITIONAL_PASS", 1.0)
    coarse = decide(spark, [(i * 90000, i * 90000 + 80000, f"s {i}.", None) for i in range(3)], 300_000)
    assert coarse.decision == "CONDITIONAL_PASS" and coarse.over_long == 3
    assert decide(spark, [(i * 5000, i * 5000 + 4000, f"s {i}.", -0.2) for i in range(6)], 30_000).decision == "PASS"
    empty = qa.transcript_decision(qa.transcript_checks(cues(spark, []), ORDER), scope(spark, 1000)).first()
    assert empty.decision == "FAIL"


def test_resegment(spark):
    c = cues(spark, [(0, 1000, "This is a", "", None), (1100, 2000, "single sentence.", "", None), (2100, 3000, "Next one.", "", None)])
    out = qa.resegment(c, ORDER).orderBy("new_id").collect()
    assert [(r.new_id, r.text, r.end_ms) for r in out] == [(0, "This is a single sentence.", 2000), (1, "Next one.", 3000)]
    c = cues(spark, [(0, 1000, "Unfinished", "", None), (3000, 4000, "after a gap.", "", None)])
    assert qa.resegment(c, ORDER).count() == 2


@pytest.mark.parametrize("rows_per_block", [2, 5, 1000])
def test_repetition_runs_across_blocks(spark, rows_per_block):
    texts = ["a", "b", "b", "b", "b", "b", "c", "c", "d", "d", "d"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "project_id long, cue_id long, text string")
    df, order = arrange(df, ["project_id"], ["cue_id"], dense=True, rows_per_block=rows_per_block)
    got = [(r.first_cue, r.last_cue, r.run_length) for r in qa.repetition_runs(df, order).orderBy("first_cue").collect()]
    assert got == [(1, 5, 5), (8, 10, 3)]


def test_caption_decisions(spark):
    def one(a, b, text, language="en"):
        c = qa.caption_checks(cues(spark, [(a, b, "s", text, None)], language))
        tracks = spark.createDataFrame([(1, language)], "project_id long, language string")
        return qa.caption_decision(c, tracks).first()

    assert one(0, 1000, "one two three four five six seven eight nine ten eleven twelve").decision == "CONDITIONAL_PASS"
    assert one(5000, 1000, "x").decision == "FAIL"
    assert one(0, 3000, "A calm, readable line.").decision == "PASS"
    dense = one(0, 800, "这是一段非常密集的中文字幕内容需要很快阅读完毕否则观众跟不上节奏啊", "zh")
    assert dense.script_class == "cjk" and dense.too_fast == 1
    c = qa.caption_checks(cues(spark, []))
    assert qa.caption_decision(c, scope(spark).select("project_id", "language")).first().decision == "FAIL"


def test_reading_rate_override(spark):
    c = cues(spark, [(0, 3000, "s", "one two three four five six", None)])  # 120 words per minute
    assert not qa.caption_checks(c).first().too_fast
    assert qa.caption_checks(c, 100).first().too_fast
    assert not qa.caption_checks(c, 0).first().too_fast


TERMS = [("en", "x", ["Ex", "EX"], True), ("en", "speech", ["Speech"], False), ("fa", "x", ["ایکس"], True)]


def terms(spark):
    return spark.createDataFrame(TERMS, "language string, term string, renderings array<string>, must_appear boolean")


@pytest.mark.parametrize("limit", [0, 100])
def test_glossary(spark, limit):
    c = cues(spark, [(0, 1, "x here", "EX ok", None), (1, 2, "no term", "Ex", None), (2, 3, "a speech", "talk", None)])
    found = glossary.glossary_occurrences(c, terms(spark), broadcast_terms=limit)
    m = glossary.glossary_metrics(found, scope(spark).select("project_id", "language")).first()
    assert (m.required_occurrences, m.required_hits, m.required_hit_rate, m.preferred_misses, m.decision) == (1, 1, 1.0, 1, "PASS")
    c = cues(spark, [(0, 1, "x here", "nope", None)])
    found = glossary.glossary_occurrences(c, terms(spark), broadcast_terms=limit)
    assert glossary.glossary_metrics(found, scope(spark).select("project_id", "language")).first().decision == "FAIL"


@pytest.mark.parametrize("limit", [0, 100])
def test_sensitive_terms_once_per_category(spark, limit):
    lex = spark.createDataFrame(
        [("religious", "Allah", 0), ("religious", "a", 1), ("political", "revolution", 0)], "category string, term string, ord long"
    )
    c = cues(spark, [(0, 1, "Praise be to Allah the merciful.", "", None), (1, 2, "The revolution contínues à", "", None), (2, 3, "", "", None)])
    got = {(r.cue_id, r.category, r.term) for r in glossary.sensitive_flags(c, lex, broadcast_terms=limit).collect()}
    assert got == {(0, "religious", "Allah"), (1, "political", "revolution")} | (set())


def test_contains_join_by_gram_equals_broadcast(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select(
        F.col("conv_id").alias("project_id"), F.lit("en").alias("language"), F.col("turn").alias("cue_id"), F.col("text").alias("source_text")
    )
    words = base.select(F.explode(F.split("source_text", " ")).alias("term")).filter("length(term) > 0").distinct().limit(200)
    t = words.select("term", F.lit("en").alias("language"))
    a = glossary.contains_join(base, t, "source_text", True, broadcast_terms=1000).select("project_id", "cue_id", "term")
    b = glossary.contains_join(base, t, "source_text", True, broadcast_terms=0).select("project_id", "cue_id", "term")
    assert a.count() == b.count() and a.exceptAll(b).isEmpty()


@pytest.mark.parametrize("limit", [0, 100])
def test_blank_terms_match_nothing(spark, limit):
    cues = spark.createDataFrame([(1, "abc def"), (2, "")], "id long, text string")
    terms = spark.createDataFrame([("",), (None,), ("def",)], "term string")
    got = glossary.contains_join(cues, terms, "text", by_language=False, broadcast_terms=limit)
    assert [(r.id, r.term) for r in got.collect()] == [(1, "def")]


def test_a_rate_just_over_the_bar_is_too_fast(spark):
    rows = [(1, "en", 0, " ".join(["w"] * 30), 0, 9967), (1, "en", 1, " ".join(["w"] * 30), 0, 10_000)]
    df = spark.createDataFrame(rows, "project_id long, language string, cue_id long, target_text string, start_ms long, end_ms long")
    assert {r.cue_id: (r.rate, r.too_fast) for r in qa.caption_checks(df, 180).collect()} == {0: (180, True), 1: (180, False)}


def test_all_findings_of_a_file(spark):
    df = spark.createDataFrame([(1, 9000, 5000, False, False), (2, 100, 100, True, True)], "project_id long, container_ms long, dub_ms long, has_audio boolean, has_video boolean")
    assert sorted(r.category for r in qa.final_findings(df).collect()) == ["av-drift", "missing-stream", "missing-video"]
    got = {r.project_id: (r.categories, r.decision) for r in qa.final_verdicts(df).collect()}
    assert got == {1: (["missing-video", "missing-stream", "av-drift"], "FAIL"), 2: ([], "PASS")}


def test_translation_and_gloss_findings(spark):
    c = cues(spark, [(0, 1, "a b c", "a b c", None), (1, 2, "x", "x", None), (2, 3, "y", " ", None)])
    assert {(r.cue_id, r.category) for r in qa.translation_findings(c).collect()} == {(0, "identical-to-source"), (2, "empty-target")}
    g = cues(spark, [(0, 1, "این یک جمله است", "این یک جمله است", None), (1, 2, "این یک سخنرانی طولانی درباره موضوعات", "Yes.", None), (2, 3, "نصیحت", "[unclear]", None)])
    g = g.withColumns({
        "flags": F.when(F.col("cue_id") == 2, F.array(F.lit("context-mismatch"))), "context_note": F.lit(None).cast("string")
    })
    got = {(r.cue_id, r.severity, r.category.split("/")[1]) for r in qa.gloss_findings(g).collect()}
    assert got == {(0, "note", "untranslated-suspect"), (1, "note", "length-outlier"), (2, "major", "context-mismatch")}


def test_final_check(spark):
    p = spark.createDataFrame(
        [("fr", 1624540, 2070859, True), ("en", 1625023, 1624540, True), ("de", 5, 5, False)],
        "project_id string, container_ms long, dub_ms long, has_audio boolean",
    )
    got = {(r.project_id, r.category, r.av_drift_ms) for r in qa.final_findings(p).collect()}
    assert got == {("fr", "av-drift", -446319), ("de", "missing-stream", 0)}


def test_final_report_by_project(spark):
    probes = spark.createDataFrame(
        [(1, "fr", True, True, 1624540, 2070859), (1, "en", True, True, 1488020, 1487537), (1, "de", False, False, 5, 5000),
         (2, "en", True, True, 10, 10), (3, "en", False, False, 1, 1)],
        "project_id long, language string, has_video boolean, has_audio boolean, container_ms long, dub_ms long",
    )
    tracks = spark.createDataFrame(
        [(1, "fr", True), (1, "en", True), (1, "de", True), (1, "es", True), (2, "en", True), (3, "en", False)],
        "project_id long, language string, dub_enabled boolean",
    )
    got = {r.project_id: r for r in qa.final_report(probes, tracks).collect()}
    assert [(f.language, f.category) for f in got[1].findings] == [
        ("de", "missing-video"), ("de", "missing-stream"), ("de", "av-drift"), ("es", "missing-file"), ("fr", "av-drift")]
    assert (got[1].decision, got[1].languages, got[1].widest_drift_ms) == ("FAIL", ["de", "en", "es", "fr"], 446319)
    assert (got[2].decision, got[2].findings) == ("PASS", []) and (got[3].decision, got[3].languages) == ("PASS", [])


def test_retry_pick(spark):
    a = spark.createDataFrame([(1, 0, 3), (1, 1, 0), (1, 2, 0), (2, 0, 3), (2, 1, 1)], "v long, attempt long, problems long")
    got = {(r.v, r.attempt, r.warning) for r in qa.pick_attempt(a, ["v"]).collect()}
    assert got == {(1, 1, False), (2, 1, True)}


def test_srt_and_vtt(spark):
    c = cues(spark, [(0, 2000, "a", "Hello.", None), (2000, 3500, "b", "World.", None)])
    assert captions.render(c, "srt").first().text == "1\n00:00:00,000 --> 00:00:02,000\nHello.\n\n2\n00:00:02,000 --> 00:00:03,500\nWorld.\n\n"
    assert captions.render(c, "vtt").first().text == "WEBVTT\n\n00:00:00.000 --> 00:00:02.000\nHello.\n\n00:00:02.000 --> 00:00:03.500\nWorld.\n\n"
    parts = captions.render(c, "srt", cues_per_part=1).orderBy("part").collect()
    assert "".join(p.text for p in parts) == captions.render(c, "srt").first().text
    pre = c.withColumn("lines", F.array(F.lit("Line one"), F.lit("Line two")))
    assert "Line one\nLine two\n\n" in captions.render(pre, "srt").first().text


def test_worksheets(spark):
    c = cues(spark, [(0, 1, "a", "", None), (1, 2, "b", "", None)])
    flags = spark.createDataFrame([(1, "en", 0, "religious")], "project_id long, language string, cue_id long, category string")
    rows = captions.export_worksheet(c, flags).orderBy("cue_id").collect()
    assert [(r.target_text, r.flags) for r in rows] == [("", ["editorial-religious"]), ("", [])]
    done = c.filter("cue_id = 0").select("project_id", "language", "cue_id")
    assert [r.cue_id for r in captions.export_worksheet(c, flags, done).collect()] == [1]
    key = "project_id long, language string, cue_id long, target_text string"
    half = spark.createDataFrame([(1, "en", 0, "A")], key)
    assert all(r.rejected for r in captions.import_worksheet(c, half).collect())
    full = spark.createDataFrame([(1, "en", 0, "A"), (1, "en", 1, "B")], key)
    out = captions.import_worksheet(c, full).orderBy("cue_id").collect()
    assert [(r.target_text, r.rejected) for r in out] == [("A", False), ("B", False)]
    over = spark.createDataFrame([(1, "en", 0, "New"), (1, "en", 1, " ")], "project_id long, language string, cue_id long, modified_translation string")
    got = captions.reconcile_overrides(c, over).orderBy("cue_id").collect()
    assert [(r.target_text, r.overridden) for r in got] == [("New", True), ("", False)]


def test_chapters(spark):
    c = cues(spark, [(0, 3000, "", "", None), (3000, 6000, "", "", None), (16000, 20000, "", "", None)])
    got = sorted(r.start_ms for r in chapters.candidates(c, ORDER, gap_ms=10000).collect())
    assert got == [0, 16000]
    rows = [(1, "en", 0, 0, "A"), (1, "en", 1, 5000, "B"), (1, "en", 2, 5000, "C"), (1, "en", 3, 6000, " "), (1, "en", 4, 99999, "D")]
    ch = spark.createDataFrame(rows, "project_id long, language string, cue_id long, start_ms long, title string")
    got = {(r.cue_id, r.problem) for r in chapters.problems(ch, ORDER, scope(spark, 20000)).collect()}
    assert got == {(2, "not-increasing"), (3, "blank-title"), (4, "beyond-duration")}
    assert chapters.description(ch.filter("cue_id < 2")).first().text == "0:00 A\n0:05 B"
