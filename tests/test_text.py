"""Column rules for text, timecodes and references."""

from pyspark.sql import functions as F

from cuelake.functions import refs
from cuelake.functions import text as tx
from cuelake.functions import timecode as tc


def values(spark, rows, fn, schema="x string"):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in df.orderBy("i").select(fn).collect()]


def test_timecodes(spark):
    good = {"00:00:03.000": 3000, "01:02:03": 3723000, "02:30": 150000, "12.5": 12500, "0": 0, "00:00:00.250": 250}
    assert values(spark, list(good), tc.parse_timecode(F.col("x"))) == list(good.values())
    bad = ["", "  ", "abc", "-5", "True", None, "00:60:00", "00:00:60"]
    assert values(spark, bad, tc.parse_timecode(F.col("x"))) == [None] * len(bad)


def test_long_digit_runs_are_invalid(spark):
    df = spark.createDataFrame([("1" * 23,), ("9" * 30 + ":00:01",), ("00:" + "1" * 25,), ("0" * 20 + "5",), ("1.123456789012345678901",)], "t string")
    assert [r.ms for r in df.select(tc.parse_timecode(F.col("t")).alias("ms")).collect()] == [None, None, None, 5000, 1123]


def test_rendered_times(spark):
    assert values(spark, [3723004], tc.srt_time(F.col("x")), "x long") == ["01:02:03,004"]
    assert values(spark, [63200], tc.vtt_time(F.col("x")), "x long") == ["00:01:03.200"]
    assert values(spark, [0, 65000, 3600000], tc.chapter_time(F.col("x")), "x long") == ["0:00", "1:05", "1:00:00"]


def test_script_classes(spark):
    assert values(spark, ["en", "ru", "fa", "zh", "ja"], tx.script_class(F.col("x"))) == ["latin", "cyrillic", "rtl", "cjk", "cjk"]


def test_wrapping_keeps_every_word(spark):
    text = "This is a fairly long caption line that should wrap onto two display lines here."
    lines = values(spark, [text], tx.wrap_lines(F.col("x"), F.lit("latin")))[0]
    assert len(lines) == 2 and len(lines[0]) <= 42 and " ".join(lines) == text
    cjk = "这是一段需要按照字符数量来换行的中文字幕文本内容示例"
    lines = values(spark, [cjk], tx.wrap_lines(F.col("x"), F.lit("cjk")))[0]
    assert len(lines[0]) == 16 and "".join(lines) == cjk
    long_word = "x" * 50
    assert values(spark, [long_word + " y"], tx.wrap_lines(F.col("x"), F.lit("latin")))[0] == [long_word, "y"]


def test_citations(spark):
    rows = ["As He says (Quran 2:255) to us", "no citation", "(Quran 1:1)  twice (Quran 2:2)"]
    assert values(spark, rows, tx.strip_citations(F.col("x"))) == ["As He says to us", "no citation", "twice"]


def test_language_codes(spark):
    assert values(spark, ["zh-CN", "iw", " EN "], tx.canonical_language(F.col("x"))) == ["zh", "he", "en"]
    assert values(spark, ["Persian", "ara", "zz", "klingon"], tx.normalize_language(F.col("x"))) == ["fa", "ar", "zz", None]
    df = spark.createDataFrame([([" EN", "fa", "en", "", "Ar "],)], "x array<string>")
    assert df.select(tx.norm_codes(F.col("x"))).first()[0] == ["en", "fa", "ar"]


def test_script_leaks(spark):
    rows = [("plain", "en"), ("a «سلام» b", "ur"), ("سلام", "en"), ("سلام", "ur"), ("«ok» x", "en")]
    got = values(spark, rows, tx.leaks_script(F.col("x"), F.col("l")), "x string, l string")
    assert got == [False, True, True, False, False]


def test_lang_map(spark):
    got = values(spark, ["en=a,fa=b", "en", "en=a,fa"], tx.lang_map(F.col("x")))
    assert got == [{"en": "a", "fa": "b"}, None, None]


def test_template(spark):
    got = values(spark, ["{{A}} and {{B}} and {{A}}"], tx.fill_template(F.col("x"), {"A": F.lit("1"), "B": F.lit("2")}))
    assert got == ["1 and 2 and 1"]


def test_video_references(spark):
    urls = ["MFuUIoF5PSc", "PLDvVOFNMIIG3snBzVLV65D9YHbmkN8s2Z", "https://youtu.be/MFuUIoF5PSc", "some random text"]
    assert values(spark, urls, refs.canonical_url(F.col("x"))) == [
        "https://www.youtube.com/watch?v=MFuUIoF5PSc",
        "https://www.youtube.com/playlist?list=PLDvVOFNMIIG3snBzVLV65D9YHbmkN8s2Z", *urls[2:],
    ]
    rows = ["PLtestplaylist000", "AAAAAAAAAAA", "https://www.youtube.com/playlist?list=PLx", "https://www.youtube.com/watch?v=x",
            "https://youtu.be/AAAAAAAAAAA", "https://www.youtube.com/watch?v=x&list=PLx"]
    assert values(spark, rows, refs.is_playlist(F.col("x"))) == [True, False, True, False, False, True]
    rows = ["https://www.youtube.com/watch?v=abc&t=1", "https://youtu.be/xyz/", "bare"]
    assert values(spark, rows, refs.id_from_ref(F.col("x"))) == ["abc", "xyz", "bare"]
    rows = ["yt-abc", "Bad ID!", "-x", "a", "A1"]
    assert values(spark, rows, refs.is_valid_video_id(F.col("x"))) == [True, False, False, False, True]
    rows = ["https://www.youtube.com/x", "https://evil.com/youtube.com", "https://notyoutube.com/", "https://vimeo.com/1"]
    assert values(spark, rows, refs.host_allowed(F.col("x"))) == [True, False, False, True]
