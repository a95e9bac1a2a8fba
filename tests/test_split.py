"""Long cues: slice lengths, token chunks, numbering."""

import random

import pytest
from pyspark.sql import functions as F

from cuelake.operators.ordered import Order
from cuelake.plans import QUERIES
from cuelake.sources import fixtures as fx
from cuelake.operators.split import slice_lengths, split_long_cues

SCHEMA = "project_id long, language string, cue_id long, start_ms long, end_ms long, source_text string, target_text string, flags array<string>, lines array<string>"
ORDER = Order(("project_id", "language"), ("cue_id",))


def slices(spark, weights, span, cap=7000):
    df = spark.createDataFrame([(weights, span)], "w array<long>, span long")
    return df.select(slice_lengths(F.col("w"), F.col("span"), F.lit(cap).cast("long")).alias("d")).first()[0]


def test_capped_slices(spark):
    assert slices(spark, [1, 1, 50, 1, 1], 25000) == [4500, 4500, 7000, 4500, 4500]


def test_recorded_slices(spark):
    w = [43, 36, 37, 39, 41, 33, 36, 38, 37, 38, 39, 40, 36, 37, 35, 41, 37, 37, 38]
    want = [{36: 6905, 33: 6330, 35: 6715}.get(x, 7000) for x in w]
    got = slices(spark, w, 131760)
    assert sum(got) == 131760
    assert got == want


@pytest.mark.parametrize("seed", range(5))
def test_slices_tile_and_respect_the_cap(spark, seed):
    rnd = random.Random(seed)
    n = rnd.randrange(2, 30)
    w = [rnd.randrange(1, 80) for _ in range(n)]
    span = rnd.randrange(n * 1000, n * 7000)
    d = slices(spark, w, span)
    assert sum(d) == span and max(d) <= 7000 and len(d) == n
    for a, x in zip(w, d):
        for b, y in zip(w, d):
            assert a <= b or x >= y - n  # a longer text never gets clearly less time


def run(spark, *cues, language="en"):
    data = []
    for i, c in enumerate(cues):
        start, end, source, target, *rest = c
        flags, lines = (rest + [None, None])[:2]
        data.append((1, language, i, start, end, source, target, flags, lines))
    return split_long_cues(spark.createDataFrame(data, SCHEMA), ORDER).orderBy("new_id").collect()


def test_sentences_per_slice(spark):
    out = run(spark, (1000, 22000, "Yek. Do. Seh.", "One sentence. Two sentence. Three sentence.", ["editorial-religious"], ["x"]))
    assert [r.target_text for r in out] == ["One sentence.", "Two sentence.", "Three sentence."]
    assert [r.source_text for r in out] == ["Yek.", "Do.", "Seh."]
    assert out[0].start_ms == 1000 and out[-1].end_ms == 22000
    assert all(a.end_ms == b.start_ms for a, b in zip(out, out[1:]))
    assert all(r.flags == ["editorial-religious"] and r.lines is None for r in out)


def test_short_and_single_token_cues_pass(spark):
    out = run(spark, (0, 5000, "s", "short", None, ["short"]), (5000, 26000, "x", "word"))
    assert [(r.start_ms, r.end_ms, r.target_text) for r in out] == [(0, 5000, "short"), (5000, 26000, "word")]
    assert out[0].lines == ["short"]


def test_never_more_slices_than_tokens(spark):
    out = run(spark, (0, 21000, "x y", "just two"))
    assert [r.target_text for r in out] == ["just", "two"]
    assert out[0].end_ms == out[1].start_ms and out[1].end_ms == 21000


def test_short_target_of_long_source_is_never_blank(spark):
    src = " ".join(f"s{i}" for i in range(60)) + "."
    tgt = " ".join(f"word{i}" for i in range(60)) + "."
    out = run(spark, (0, 112000, src, tgt), (115000, 117000, "later", "later"))
    assert len(out) == 17 and all(r.target_text.strip() and r.source_text.strip() for r in out)
    assert " ".join(r.target_text for r in out[:-1]) == tgt
    assert all(r.end_ms - r.start_ms <= 7000 for r in out)
    assert out[-1].start_ms == 115000 and [r.new_id for r in out] == list(range(17))


def test_cjk_splits_on_characters(spark):
    text = "这是一段很长的中文字幕" * 4
    out = run(spark, (0, 21000, text, text), language="zh")
    assert len(out) == 3 and "".join(r.target_text for r in out) == text


def fold_chunks(tokens, n):
    total, out, i, cum = sum(map(len, tokens)), [], 0, 0
    for k in range(n):
        goal, part = round(total * (k + 1) / n), []
        while i < len(tokens) and (not part or k == n - 1 or (cum < goal and len(tokens) - i > n - 1 - k)):
            part.append(tokens[i])
            cum += len(tokens[i])
            i += 1
        out.append(" ".join(part))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_chunks_like_a_loop(spark, seed):
    rnd = random.Random(seed)
    words = ["w" * rnd.randrange(1, 12) for _ in range(rnd.randrange(20, 60))]
    n = rnd.randrange(2, 12)
    out = run(spark, (0, n * 7000, " ".join(words), " ".join(words)))
    assert [r.target_text for r in out] == fold_chunks(words, n)


def test_sources_of_many_texts_are_cut_into_blocks(spark, monkeypatch):
    """all texts of a source, up to a million, were read by one task."""
    sf = "/root/testdata/sf0.001"
    job = lambda: sorted(tuple(r) for r in QUERIES["split_long_cues"](spark, sf).collect())
    whole = job()
    monkeypatch.setattr(fx, "TEXTS_PER_BLOCK", 2)
    assert fx.long_cues(spark, sf)[1].block
    assert job() == whole
