import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.llm import whitening
from cuelake.llm.jobs import LLM_QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows, scale=64, offset=1_000_000):
    """(usable rows, distinct x vectors, their exact covariance) with fractions and a loop over pairs."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, tuple(math.floor(scale * float(c)) + offset for c in v)) for i, v in good]
    fit = sorted({x for _, x in xs})
    n, d = len(fit), len(fit[0])
    mean = [Fraction(sum(x[k] for x in fit), n) for k in range(d)]
    cov = [[sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n for j in range(d)] for i in range(d)]
    return xs, fit, mean, cov


def check(got, rows, components=16):
    xs, fit, mean, cov = plain(rows)
    n, d = len(fit), len(fit[0])
    k = min(components, d)
    sums = [sum(x[j] for x in fit) for j in range(d)]
    v = np.array([[float(c) for c in r] for r in cov])
    values = np.linalg.eigvalsh(v)[::-1]
    assert len(got) == len(xs) * k
    table = {}
    for r in got:
        table.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    projected = []
    for i, x in xs:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        own = [table[i, deviation][c][0] for c in range(1, k + 1)]
        projected.append([r.whitened for r in own])
        assert all(r.n == n and math.isclose(r.explained, values[c] / np.trace(v), rel_tol=1e-9) for c, r in enumerate(own))
        assert own[0].identity_error < 1e-9
    # whitened vectors of the fit list have the identity as covariance, and follow the eigenvectors of V
    index = {x: k for k, (_, x) in enumerate(xs)}
    white = np.array([projected[index[x]] for x in fit])
    assert np.allclose(white.T @ white / n - np.eye(k), 0, atol=1e-9)
    centred = np.array([[float(a - m) for a, m in zip(x, mean, strict=True)] for x in fit])
    axes = centred.T @ white / n / np.sqrt(values[:k])
    assert np.allclose(v @ axes, axes * values[:k], atol=1e-7 * values[0])


def test_query_against_fractions(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").limit(120).collect()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    check(whitening.whitened(df).collect(), rows)


def test_whole_table(spark):
    out = LLM_QUERIES["op12_whitening"](spark, SF)
    assert out.count() == 16 * spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert out.agg(F.max("identity_error")).first()[0] < 1e-4


def test_cases(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=3).tolist()) for k in range(40)]
    rows += [(5, rows[5][1]), (None, rows[6][1]), (41, None), (42, [1.0, None, 2.0]), (43, [float("nan"), 0.0, 0.0])]
    rows += [(44, [float("inf"), 0.0, 1.0]), (46, [-3.25, 70000.5, 3e9])]
    odd = [(47, []), (48, [1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("code", F.lit("x")).withColumn("size", F.lit(1))
    with pytest.raises(Exception, match="64|int|[Oo]verflow"):
        whitening.whitened(df).collect()  # a deviation of (41 * 64 * 3e9)^2 is no long
    rows[-1] = (46, [-3.25, 700.5, 30.0])
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("code", F.lit("x")).withColumn("size", F.lit(1))
    check(whitening.whitened(df).collect(), rows)
    nothing = spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")
    assert whitening.whitened(nothing).count() == whitening.whitened(nothing.limit(0)).count() == 0


def test_components_without_variance_have_no_value(spark):
    df = spark.createDataFrame([(k, [float(k), 2.0 * k, 1.0]) for k in range(6)], "vec_id int, embedding array<double>")
    rows = whitening.whitened(df).collect()
    assert {(r.component, r.whitened is None) for r in rows} == {(1, False), (2, True), (3, True)}
    one = whitening.whitened(df.filter("vec_id = 3")).collect()
    assert [(r.whitened, r.deviation, r.n, r.explained) for r in one] == [(None, 0, 1, 0.0)] * 3


def test_long_numbers_are_exact(spark):
    big = [[2**40 + k, -(2**45) - 7 * k * k] for k in range(9)]
    df = spark.createDataFrame([(k, [float(a) for a in v]) for k, v in enumerate(big)], "vec_id int, embedding array<double>")
    model, _ = whitening.fit(whitening.encoded(df, scale=1))
    s = [sum(v[i] for v in big) for i in range(2)]
    want = [[sum((9 * v[i] - s[i]) * (9 * v[j] - s[j]) for v in big) / 729 for j in range(2)] for i in range(2)]
    assert model.covariance.tolist() == want and model.sums == s
