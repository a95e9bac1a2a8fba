"""Neighbours in both directions against a plain search."""

from bisect import bisect_right
from random import Random

import pytest

from cuelake.operators import asof, intervals


@pytest.mark.parametrize("rows_per_block", [7, 1_000_000])
def test_neighbours_equal_a_plain_search(spark, rows_per_block):
    r = Random(5)
    marks = [(r.randrange(3), r.randrange(400)) for _ in range(90)] + [(9, 5)] * 3 + [(0, None)]
    points = [(i, r.randrange(4), r.randrange(-20, 430)) for i in range(200)] + [(900, 0, None), (901, 9, 5), (902, 9, 4)]
    p = spark.createDataFrame(points, "n long, k long, at long")
    m = spark.createDataFrame(marks, "k long, mark long")
    got = {x.n: (x.before, x.after) for x in asof.neighbours(p, "at", m, "mark", ["k"], rows_per_block).collect()}

    def plain(k, at):
        if at is None:
            return None, None
        own = sorted({t for key, t in marks if key == k and t is not None})
        n = bisect_right(own, at)
        return own[n - 1] if n else None, own[n] if n < len(own) else None

    assert got == {n: plain(k, at) for n, k, at in points}
    assert asof.neighbours(p, "at", m.limit(0), "mark", ["k"]).filter("before IS NOT NULL OR after IS NOT NULL").isEmpty()
    assert asof.neighbours(p.limit(0), "at", m, "mark", ["k"]).isEmpty()


@pytest.mark.parametrize("rows_per_block", [4, 1_000_000])
def test_snapping_takes_the_nearest_and_ties_go_back(spark, rows_per_block):
    b = spark.createDataFrame([(1, t) for t in (0, 3000, 5000, 5000, 9001)], "project_id long, boundary_ms long")
    times = {4000: 3000, 4001: 5000, 7000: 5000, 7001: 9001, 11001: 9001, 11002: None, -2000: 0, -2001: None, 3000: 3000}
    e = spark.createDataFrame([(1, t) for t in times] * 2, "project_id long, at_ms long")
    got = intervals.snap_edges(e, b, rows_per_block=rows_per_block).collect()
    assert len(got) == 2 * len(times)
    for r in got:
        want = times[r.at_ms]
        assert (r.snapped_ms, r.has_candidate) == (r.at_ms if want is None else want, want is not None)
