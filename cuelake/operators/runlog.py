"""Run log records: runs, their outcome, error rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.operators import ordered
from cuelake.operators.ordered import Order, running


def pair_runs(records: DataFrame, order: Order) -> DataFrame:
    """One row per start record: its end when the next record of the key is one, else unfinished (-1)."""
    r = running(records, order, _next=ordered.following(F.struct("seq", "kind", "rc")))
    r = r.filter(F.col("kind") == "start")
    ended = F.coalesce(F.col("_next")["kind"] == "end", F.lit(False))
    return r.select(
        *order.keys, F.col("seq").alias("started_seq"),
        F.when(ended, F.col("_next")["seq"]).otherwise(-1).alias("ended_seq"),
        (ended & (F.col("_next")["rc"] != 0)).alias("failed"),
    )


def error_rates(runs: DataFrame) -> DataFrame:
    done = F.col("ended_seq") >= 0
    g = runs.groupBy("cmd").agg(
        F.count(F.lit(1)).alias("runs"), F.sum((~done).cast("long")).alias("unfinished"),
        F.sum(F.col("failed").cast("long")).alias("failed"),
    )
    finished = F.col("runs") - F.col("unfinished")
    return g.withColumn("error_rate", F.when(finished > 0, F.round(F.col("failed") / finished, 6)).otherwise(0.0))
