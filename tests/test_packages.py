import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cuelake.operators import packaging
from cuelake.sources import packages as pk

UNIT = "project_id long, language string, dub_enabled boolean, joined boolean, clip_index int, media_sha256 string"
CUE = "project_id long, language string, clip_index int, cue_id long, start_ms long, end_ms long, target_text string"
UNITS = [
    (1, "en", True, False, None, "m1"), (2, "ar", False, False, None, "m2"), (3, "en", True, False, 0, "m3a"),
    (3, "en", True, False, 1, "m3b"), (4, "fr", True, True, None, "m4"),
]
CUES = [(1, "en", None, k, 1000 * k, 1000 * k + 500, f"cue {k}") for k in range(300)] + [
    (2, "ar", None, 0, 0, 900, "نص"), (3, "en", 0, 0, 0, 900, "first clip"), (4, "fr", None, 0, 0, 900, "joint"),
]
RIGHTS = [(1, "licensed"), (2, "unreviewed"), (3, "self-authored")]


def pieces(spark):
    return packaging.package_pieces(
        spark.createDataFrame(UNITS, UNIT), spark.createDataFrame(CUES, CUE).repartition(4),
        spark.createDataFrame(RIGHTS, "project_id long, rights_status string"),
    )


def test_files_kinds_and_sums(spark, tmp_path):
    pk.write_packages(pieces(spark), str(tmp_path))
    rows = pk.read_manifest(spark, str(tmp_path)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.project_id, set()).add((r.kind, r.clip_index))
    plain = {("captions-srt", None), ("captions-vtt", None), ("readme", None)}
    assert by["1"] == plain | {("dubbed-video", None)} and by["2"] == plain
    assert by["4"] == plain | {("joined-video", None)}
    clips = {(kind, k) for kind in ("captions-srt", "captions-vtt", "clip-video") for k in (0, 1)}
    assert by["3"] == clips | {("readme", None)}
    run = json.loads((tmp_path / pk.MANIFEST).read_text())["run"]
    for r in rows:
        if r.path is None:
            assert r.sha256.startswith("m") and r.bytes is None
            continue
        data = (tmp_path / run / r.path).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (r.bytes, r.sha256)
        if r.kind == "captions-srt" and r.project_id == "1":
            assert data.count(b" --> ") == 300 and data.startswith(b"1\n") and data.endswith(b"cue 299\n\n")
        if r.kind == "captions-vtt":
            assert data.startswith(b"WEBVTT\n\n")
        if r.kind == "readme":
            assert (packaging.NOT_CLEARED.encode() in data) == (r.project_id in ("2", "4"))
    assert not list(tmp_path.rglob("*.draft"))


def test_a_killed_job_leaves_no_manifest_and_keeps_the_last_one(spark, tmp_path):
    broken = pieces(spark).withColumn(
        "content", F.when((F.col("project_id") == 1) & (F.col("place") == 200), F.raise_error(F.lit("lost"))).otherwise(F.col("content"))
    )
    with pytest.raises(Exception, match="lost"):
        pk.write_packages(broken, str(tmp_path))
    assert not (tmp_path / pk.MANIFEST).exists()
    pk.write_packages(pieces(spark), str(tmp_path))
    before = (tmp_path / pk.MANIFEST).read_text()
    with pytest.raises(Exception, match="lost"):
        pk.write_packages(broken, str(tmp_path))
    assert (tmp_path / pk.MANIFEST).read_text() == before and pk.read_manifest(spark, str(tmp_path)).count() == 18


def test_nothing_to_pack(spark, tmp_path):
    pk.write_packages(pieces(spark).limit(0), str(tmp_path))
    assert pk.read_manifest(spark, str(tmp_path)).count() == 0
