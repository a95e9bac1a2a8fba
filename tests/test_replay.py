import random

import pytest

from cuelake.operators import replay as rp
from cuelake.operators.ordered import arrange

EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("c", "d")]


def plain(events):
    now, out = {}, []
    for project, seq, to in sorted(events):
        met = now.get(project, "a")
        ok = (met, to) in EDGES
        out.append((project, seq, to, met, ok))
        now[project] = to if ok else met
    return sorted(out)


@pytest.mark.parametrize(("fan_in", "rows_per_block"), [(1000, 1_000_000), (3, 1_000_000), (2, 10)])
def test_equals_a_walk_on_every_level(spark, fan_in, rows_per_block):
    rng = random.Random(fan_in)
    events = [(rng.choice([1, 1, 1, 2, 3]), k, rng.choice(["a", "b", "c", "d", "nowhere"])) for k in range(90)]
    df = spark.createDataFrame(events, "project_id long, seq long, to_state string")
    df, order = arrange(df, ("project_id",), ("seq",), rows_per_block=rows_per_block)
    got = rp.replay(df, order, EDGES, "a", fan_in).collect()
    assert sorted(tuple(r) for r in got) == plain(events)


def test_no_events(spark):
    df, order = arrange(spark.createDataFrame([], "project_id long, seq long, to_state string"), ("project_id",), ("seq",))
    assert rp.replay(df, order, EDGES, "a").count() == 0
