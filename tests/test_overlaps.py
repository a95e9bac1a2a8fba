import random

import pytest

from cuelake.operators import intervals


@pytest.mark.parametrize("bucket", [1, 50, 60_000])
def test_equals_all_pairs_with_long_and_empty_intervals(spark, bucket):
    rng = random.Random(bucket)
    length = lambda: rng.choice([0, 1, 7, 90, 4_000, 10**6])
    cues = [(rng.randrange(2), k, s, s + length()) for k, s in enumerate(rng.choices(range(0, 5000), k=120))]
    windows = [(rng.randrange(2), k, s, s + length()) for k, s in enumerate(rng.choices(range(0, 5000), k=40))] + [(0, 99, 0, 2**45), (1, 98, 2000, 2000)]
    c = spark.createDataFrame(cues, "project_id long, cue_id long, start_ms long, end_ms long")
    w = spark.createDataFrame(windows, "project_id long, clip long, win_start_ms long, win_end_ms long")
    got = sorted((r.project_id, r.cue_id, r.clip) for r in intervals.overlap_join(c, w, ["project_id"], bucket).collect())
    assert got == sorted((p, k, m) for p, k, s, e in cues for q, m, a, z in windows if p == q and s < z and e > a)


def test_an_endless_window_is_a_few_rows(spark):
    w = spark.createDataFrame([(0, 2**50)], "a long, z long")
    from pyspark.sql import functions as F

    level = intervals._level(F.col("a"), F.col("z"), 60_000)
    cells = intervals._cells(F.col("a"), F.col("z"), level, list(range(22)), 60_000)
    assert w.select(F.size(cells)).first()[0] < 40
    assert intervals.overlap_join(
        spark.createDataFrame([], "p long, start_ms long, end_ms long"), spark.createDataFrame([], "p long, win_start_ms long, win_end_ms long"), ["p"]
    ).count() == 0
