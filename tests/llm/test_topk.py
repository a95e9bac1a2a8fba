import math
import random

import numpy as np
import pytest

from cuelake.llm import topk


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, part int, ids string")


def plain(rows, k, every):
    usable = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, (qi, qv) in enumerate(usable):
        if qi % every == 0:
            scores = [(-min(max(sum(a * b for a, b in zip(qv, v, strict=False)), -(2**63)), 2**63 - 1), i) for c, (i, v) in enumerate(usable) if c != q]
            out += [(qi, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("range_rows", [7, 64, 8192])
def test_against_all_pairs(spark, range_rows):
    rng = random.Random(range_rows)
    rows = [(k, [rng.choice([-0.5, 0.0, 0.25, rng.gauss(0, 0.3)]) for _ in range(6)]) for k in range(300)]
    assert got(topk.nearest(vectors(spark, rows), 20, 64, 20, range_rows)) == plain(rows, 20, 20)


def test_blocks_are_pruned():
    rng = np.random.default_rng(2)
    centre = np.repeat(rng.normal(0, 60, (40, 8)), 128, axis=0)
    data = (centre + rng.normal(0, 2, centre.shape)).astype(np.int64)
    _, _, scored = topk.best_in_range(data[:50], np.arange(50), np.arange(len(data)), data, 20)
    assert scored < 50 * 40 / 2


def test_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 2.0]), (20, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [0.5, None]), (2, None), (3, [nan, 1.0]), (4, [inf, 0.0]),
        (None, [1.0, 1.0]), (5, [1.0]), (6, []), (7, [3e15, 3e15]), (-20, [-1.0, 0.0]), (8, [0.0, 0.0]), (9, [0.0, 0.0]),
    ]
    assert got(topk.nearest(vectors(spark, rows))) == plain(rows, 20, 20)
    assert topk.nearest(vectors(spark, [])).count() == 0
    assert topk.nearest(vectors(spark, [(20, [1.0])])).count() == 0


def test_products_beyond_a_long_are_held_at_its_ends(spark):
    rows = [(0, [1e30, 1e30]), (1, [1e30, 1e30]), (2, [-1e30, -1e30])]
    assert [(r[1], r[2]) for r in got(topk.nearest(vectors(spark, rows)))] == [(1, 1), (2, 2)]
