"""Readers on hand-written documents, streams against batch, and the oracle on the smallest tables."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import compare, connect
from cuelake.plans.document_jobs import _event_files, _real
from cuelake.sources import documents as docs
from cuelake.sources import fixtures as fx
from cuelake.streaming import events as st

SF = "/root/testdata/sf0.001"


def put(folder, name, doc):
    (folder / name).write_text(doc if isinstance(doc, str) else json.dumps(doc, ensure_ascii=False, indent=1))


def test_pretty_printed_transcript_and_glossary(spark, tmp_path):
    put(tmp_path, "a.json", {"project_id": "p", "language": "fa", "duration_seconds": 4.0, "cues": [
        {"id": 0, "start_ms": 0, "end_ms": 2000, "text": "سلام", "confidence": -0.2}, {"id": 1, "start_ms": 2000, "end_ms": 4000, "text": "b"}]})
    rows = docs.read_transcripts(spark, str(tmp_path), multi_line=True).orderBy("cue_id").collect()
    assert [(r.cue_id, r.text, r.confidence) for r in rows] == [(0, "سلام", -0.2), (1, "b", None)]
    g = tmp_path / "g"
    g.mkdir()
    put(g, "g.json", {"glossary_id": "g", "source_language": "fa", "terms": [
        {"source": "x", "targets": {"en": {"rendering": "Ex", "aliases": ["EX"]}, "zh": {"rendering": "艾"}}, "must_appear": True}]})
    rows = {(r.language, tuple(r.renderings)) for r in docs.read_glossaries(spark, str(g), multi_line=True).collect()}
    assert rows == {("en", ("Ex", "EX")), ("zh", ("艾",))}


def test_whisper_import(spark, tmp_path):
    put(tmp_path, "w.json", {"project_id": "p", "language": "fa", "duration": 3.0, "segments": [
        {"start": 0.0, "end": 1.25, "text": " hi ", "avg_logprob": -0.4, "no_speech_prob": 0.01,
         "words": [{"word": " hi", "start": 0.1, "end": 0.5, "probability": 0.9}]}]})
    r = docs.read_whisper(spark, str(tmp_path), multi_line=True).first()
    assert (r.cue_id, r.start_ms, r.end_ms, r.text, r.confidence) == (0, 0, 1250, "hi", -0.4)
    assert r.words[0].asDict() == {"word": "hi", "start_ms": 100, "end_ms": 500, "probability": 0.9}
    declared = spark.createDataFrame([("p", "en", False)], "project_id string, declared string, forced boolean")
    t = docs.read_whisper(spark, str(tmp_path), multi_line=True)
    assert docs.language_mismatches(t, declared).first().severity == "error"


def test_status_documents_and_corrupt_ones(spark, tmp_path):
    put(tmp_path, "a.json", {"video_id": "v", "stages": {"download": {"status": "done", "artifact": "x"},
                                                          "dub": {"status": "running", "per_language": {"en": {"status": "running"}, "fr": {"status": "done"}}}}})
    put(tmp_path, "b.json", '{"video_id": "broken", "stages": {')
    rows = {(r.video_id, r.stage, r.language, r.status) for r in docs.read_run_status(spark, str(tmp_path), multi_line=True).collect()}
    assert rows == {("v", "download", "", "done"), ("v", "dub", "en", "running"), ("v", "dub", "fr", "done")}


def test_empty_batch_list_is_refused(spark, tmp_path):
    put(tmp_path, "a.json", {"videos": []})
    with pytest.raises(ValueError):
        docs.read_batch_list(spark, str(tmp_path), multi_line=True)


def test_event_lines_have_sorted_keys(spark, tmp_path):
    e = spark.createDataFrame([("1", "p", "E", "a")], "event_id string, project_id string, event string, actor string")
    docs.append_events(e, str(tmp_path / "e"))
    docs.append_events(e, str(tmp_path / "e"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "e")).collect()]
    assert lines == ['{"actor":"a","event":"E","event_id":"1","project_id":"p"}'] * 2


def test_sliding_activity_stream_equals_batch(spark, tmp_path):
    events = _real(st.read_stream(spark, _event_files(spark, SF)))
    st.run_updates(st.activity(events, "2 hours", "1 hour", late="400 days"), str(tmp_path))
    got = st.newest(spark, str(tmp_path), ["window_start", "kind"])
    want = st.activity(fx.event_rows(spark, SF).withColumn("time", F.col("time").cast("timestamp")), "2 hours", "1 hour")
    assert got.count() == want.count() and got.select(*want.columns).exceptAll(want).isEmpty()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    oracle = entry.oracle_sql()
    assert name in oracle
    _, problems = compare(spark, con, name, entry.queries()[name], oracle[name], SF)
    assert not problems, problems


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["artifact_documents", "transcript_documents", "caption_documents", "asr_import"])
def test_documents_take_no_shuffle_beyond_that_of_their_rows(spark, monkeypatch, name):
    """rows that lay together by project were shuffled again, because the project became text first."""
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    met = []

    def look(cues, path, *args, **more):
        met.append((exchanges(cues), exchanges(docs.cue_documents(cues, *args, **more))))
        docs.cue_documents(cues, *args, **more).write.json(path)

    monkeypatch.setattr(docs, "write_cue_documents", look)
    entry.queries()[name](spark, SF)
    assert met and all(before == after for before, after in met)


def test_clips_keep_their_names_without_a_second_resolution(spark, monkeypatch):
    """the segments were resolved again and joined to the clips for their names."""
    met = []

    def look(cues, *args, **more):
        met.append(cues._jdf.queryExecution().optimizedPlan().toString())
        write(cues, *args, **more)

    write = docs.write_cue_documents
    monkeypatch.setattr(docs, "write_cue_documents", look)
    entry.queries()["clip_transcripts"](spark, SF)
    captions = entry.queries()["clip_captions"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert met[0].count("Relation [") == captions.count("Relation [") > 0
