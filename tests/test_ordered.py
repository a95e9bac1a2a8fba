"""Two-level running values equal plain windows, also with one group holding most rows."""

import pytest
from pyspark.sql import functions as F

from cuelake.operators import ordered
from cuelake.operators.ordered import arrange, running, unblock


def _all(df, order):
    v = F.col("v")
    out = running(
        df, order, a=ordered.total(v), b=ordered.total(v, current=False), c=ordered.highest(v),
        d=ordered.highest(v, current=False), e=ordered.lowest(v), f=ordered.previous(v), g=ordered.following(v),
        h=ordered.position(), i=ordered.highest(F.struct("o", "v"), current=False),
    )
    return sorted(map(tuple, unblock(out, order).collect()), key=repr)


@pytest.fixture(scope="module")
def rows(spark):
    k = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5)
    return spark.range(600).select(
        k.alias("k"), (F.col("id") * 3).alias("o"),
        F.when(F.col("id") % 11 != 0, F.hash("id").cast("long") % 50).alias("v"),
    )


def test_blocks_by_width(rows):
    plain, o1 = arrange(rows, ["k"], ["o"])
    cut, o2 = arrange(rows, ["k"], ["o"], rows_per_block=40)
    assert not o1.block and o2.block
    assert _all(plain, o1) == _all(cut, o2)


def test_dense_blocks(spark):
    rows = spark.range(500).select(
        (F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).alias("o"), (F.hash("id").cast("long") % 50).alias("v")
    )
    plain, o1 = arrange(rows, ["k"], ["o"], dense=True)
    cut, o2 = arrange(rows, ["k"], ["o"], dense=True, rows_per_block=16)
    assert not o1.block and o2.block
    assert _all(plain, o1) == _all(cut, o2)


def test_given_blocks(rows):
    r = rows.withColumn("day", F.floor(F.col("o") / 300))
    plain, o1 = arrange(r, ["k"], ["day", "o"])
    cut, o2 = arrange(r, ["k"], ["day", "o"], blocks=[F.col("day"), F.floor(F.col("o") / 100)], rows_per_block=40)
    assert len(o2.block) == 2
    assert _all(plain, o1) == _all(cut, o2)


def test_no_block_holds_a_whole_large_group(rows):
    cut, o = arrange(rows, ["k"], ["o"], rows_per_block=40)
    biggest = cut.groupBy(*o.keys, *o.block).count().agg(F.max("count")).first()[0]
    assert biggest <= 41


@pytest.mark.parametrize("far", [10**6, 10**15])
def test_a_clump_is_split(spark, far):
    clump = spark.range(1000).select(F.lit(1).alias("k"), (F.lit(500) + F.col("id")).alias("o"), F.col("id").alias("v"))
    ends = spark.createDataFrame([(1, 0, 1), (1, far, 2), (2, 5, 3)], "k int, o long, v long")
    df = clump.unionByName(ends)
    cut, o = arrange(df, ["k"], ["o"], rows_per_block=100)
    assert cut.groupBy(*o.keys, *o.block).count().agg(F.max("count")).first()[0] <= 200
    plain, o1 = arrange(df, ["k"], ["o"])
    assert _all(plain, o1) == _all(cut, o)


def test_ties_stay_together(spark):
    df = spark.range(900).select(
        F.lit(1).alias("k"), F.when(F.col("id") < 300, 7).otherwise(F.col("id") % 50).cast("long").alias("o"), F.col("id").alias("v")
    )
    cut, o = arrange(df, ["k"], ["o", "v"], rows_per_block=100)
    assert cut.groupBy("k", "o").agg(F.countDistinct(F.struct(*o.block)).alias("n")).agg(F.max("n")).first()[0] == 1
    by = lambda d, order: sorted(map(tuple, unblock(running(d, order, p=ordered.position(), s=ordered.total(F.col("v"))), order).collect()))
    plain, o1 = arrange(df, ["k"], ["o", "v"])
    assert by(plain, o1) == by(cut, o)


def test_the_sessions_settings_are_left_alone(spark, rows):
    before = spark.conf.get("spark.sql.requireAllClusterKeysForDistribution")
    _all(*arrange(rows, ["k"], ["o"], rows_per_block=40))
    assert spark.conf.get("spark.sql.requireAllClusterKeysForDistribution") == before
