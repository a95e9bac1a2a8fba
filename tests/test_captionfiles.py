import hashlib
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cuelake.operators import captions
from cuelake.sources import captionfiles as cf

CUES = "project_id long, language string, cue_id long, start_ms long, end_ms long, target_text string"


def cues(spark, seed=1):
    rng = random.Random(seed)
    words = ["one", "12", "naïve", "次の字幕", "00:00:01,000", "--", "WEBVTT", ""]
    rows = []
    for project in range(5):
        for cue in range(rng.choice([1, 7, 40])):
            text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 18)))
            rows.append((project, rng.choice(["en"]) if project else "fa", cue, 1000 * cue, 1000 * cue + 999, text))
    return spark.createDataFrame(rows, CUES)


def wanted(df):
    return sorted((str(r.project_id), r.language, r.start_ms, r.end_ms, " ".join(r.target_text.split())) for r in df.collect())


def found(df):
    return sorted((r.project_id, r.language, r.start_ms, r.end_ms, r.text) for r in captions.parse_blocks(df).collect())


@pytest.mark.parametrize("fmt", ["srt", "vtt"])
def test_any_ranges_and_file_sizes_give_all_cues(spark, tmp_path, fmt):
    df = cues(spark)
    for k, (file_bytes, range_bytes) in enumerate([(1 << 20, 1 << 20), (1 << 20, 37), (300, 90), (1, 211)]):
        folder = str(tmp_path / f"{fmt}{k}")
        cf.write_captions(captions.blocks(df, fmt), folder, fmt, file_bytes=file_bytes)
        assert found(cf.read_captions(spark, folder, fmt, range_bytes=range_bytes)) == wanted(df)


def test_tracks_share_files_and_their_sums_hold(spark, tmp_path):
    many = spark.range(6000).selectExpr(
        "1L AS project_id", "'en' AS language", "id AS cue_id", "id * 10 AS start_ms", "id * 10 + 9 AS end_ms", "concat('cue ', id) AS target_text"
    )
    small = spark.range(200).selectExpr("id + 2 AS project_id", "'en' AS language", "0L AS cue_id", "0L AS start_ms", "9L AS end_ms", "'x' AS target_text")
    folder = tmp_path / "c"
    cf.write_captions(captions.blocks(many.unionByName(small), "srt").coalesce(1), str(folder), "srt")
    files = json.loads((folder / cf.FILE_LIST).read_text())
    assert len(files) == 1
    data = (folder / files[0][0]).read_bytes()
    tracks = [json.loads(line) for line in (folder / f"{files[0][0]}.tracks").read_text().splitlines()]
    assert len(tracks) == 201 and max(t["cues"] for t in tracks) == 6000
    for t in tracks:
        assert hashlib.sha256(data[t["at"] : t["at"] + t["bytes"]]).hexdigest() == t["sha256"]


def test_what_was_never_committed_is_not_read(spark, tmp_path):
    folder = tmp_path / "c"
    failing = captions.blocks(cues(spark), "srt").withColumn(
        "block", F.when(F.col("project_id") == 4, F.raise_error(F.lit("lost"))).otherwise(F.col("block"))
    )
    with pytest.raises(Exception, match="lost"):
        cf.write_captions(failing, str(folder), "srt")
    assert not (folder / cf.FILE_LIST).exists()
    assert cf.read_captions(spark, str(folder), "srt").count() == 0


def test_plain_files_are_tracks(spark, tmp_path):
    srt = tmp_path / "talk" / "captions" / "captions.fa.srt"
    srt.parent.mkdir(parents=True)
    srt.write_bytes("﻿1\r\n00:00:01,000 --> 00:00:02,500\r\nسلام\r\nدنیا\r\n\r\n2\r\n00:01:00,000 --> 00:01:01,000\r\n\r\n".encode())
    (srt.parent / "captions.en.vtt").write_text(
        "WEBVTT - a talk\n\nNOTE made\nby hand\n\nintro\n00:01.000 --> 00:02.500 align:start\nhello\nthere\n\nSTYLE\n::cue {}\n\n01:00:00.000 --> 01:00:01.000\nbye\n"
    )
    assert found(cf.read_captions(spark, str(tmp_path), "srt")) == [("talk", "fa", 1000, 2500, "سلام دنیا"), ("talk", "fa", 60000, 61000, "")]
    assert found(cf.read_captions(spark, str(tmp_path), "vtt")) == [("talk", "en", 1000, 2500, "hello there"), ("talk", "en", 3600000, 3601000, "bye")]
    assert Path(srt).exists()


def test_empty_folder_and_table(spark, tmp_path):
    cf.write_captions(captions.blocks(cues(spark).limit(0), "vtt"), str(tmp_path / "none"), "vtt")
    assert cf.read_captions(spark, str(tmp_path / "none"), "vtt").count() == 0


@pytest.mark.parametrize("fmt", ["srt", "vtt"])
def test_no_cue_is_lost_between_batches(tmp_path, fmt, monkeypatch):
    """a range with more cues than a batch holds lost one cue at the end of every full batch."""
    monkeypatch.setattr(cf, "BATCH_CUES", 3)
    folder = tmp_path / "p" / "captions"
    folder.mkdir(parents=True)
    clock = "00:00:0{0}{1}000 --> 00:00:0{0}{1}900\n"
    texts = [f"{k + 1}\n{clock.format(k, ',')}t{k}\n\n" if fmt == "srt" else f"{clock.format(k, '.')}t{k}\n\n" for k in range(9)]
    (folder / f"x.en.{fmt}").write_text(("WEBVTT\n\n" if fmt == "vtt" else "") + "".join(texts))
    reader = cf.CaptionReader({"path": str(tmp_path), "format": fmt})
    got = [b for part in reader.partitions() for batch in reader.read(part) for b in batch.column("block").to_pylist()]
    assert got == texts
