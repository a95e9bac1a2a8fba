"""Spend ledgers: status, and admission of calls under a ceiling.

A refused call costs nothing, so admission is not a running sum. A guarded call without a cost, or
with one below 0, is refused: a refund is no call, and what it would free depends on later calls. Ledgers of ordinary size are folded
row by row inside one aggregate. A large ledger is admitted in rounds instead, each one distributed
running sum: with between 2^k and 2^(k+1) cents left, every call below 2^k is admitted until less
than 2^k is left, and one larger call ends the round, because it leaves less than 2^k. The rounds
are bounded by the bits of the ceiling, whatever the length of the ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.operators import ordered
from cuelake.operators.ordered import Order, running
from cuelake.session import ensure_checkpoint_dir

FOLD_ROWS = 5_000


def status(calls: DataFrame, ceiling: Column) -> DataFrame:
    """Spent and remaining per ledger; calls to local engines cost nothing."""
    spent = F.coalesce(F.sum(F.when(F.col("guarded"), F.col("cost_usd"))), F.lit(0))
    out = calls.groupBy("ledger_id").agg(spent.alias("spent_usd"), F.count(F.lit(1)).alias("calls"))
    return out.withColumn("ceiling_usd", ceiling).withColumn("remaining_usd", F.col("ceiling_usd") - F.col("spent_usd"))


def admit(calls: DataFrame, order: Order, ceiling_cents: int) -> DataFrame:
    """Add ``admitted`` to calls ``(ledger_id, seq, guarded, cents)``; unguarded calls always pass.

    Ledgers that ``order`` cuts into blocks are the large ones; arrange them at ``FOLD_ROWS``.
    """
    if not order.block:
        return _fold(calls, ceiling_cents)
    large = F.col(order.block[0]).isNotNull()
    free = calls.filter(large & ~F.col("guarded")).withColumn("admitted", F.lit(True))
    rest = _rounds(calls.filter(large & F.col("guarded")), order, ceiling_cents)
    return _fold(calls.filter(~large), ceiling_cents).unionByName(free).unionByName(rest)


def _fold(calls: DataFrame, ceiling_cents: int) -> DataFrame:
    others = [c for c in calls.columns if c not in ("ledger_id", "seq")]
    rows = F.sort_array(F.collect_list(F.struct("seq", *others)))
    start = F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast("array<boolean>").alias("ok"))

    def step(s: Column, call: Column) -> Column:
        fits = F.coalesce((call["cents"] >= 0) & (s["spent"] + call["cents"] <= ceiling_cents), F.lit(False))
        return F.struct(
            F.when(call["guarded"] & fits, s["spent"] + call["cents"]).otherwise(s["spent"]).alias("spent"),
            F.concat(s["ok"], F.array(~call["guarded"] | fits)).alias("ok"),
        )

    g = calls.groupBy("ledger_id").agg(rows.alias("_rows"))
    ok = F.aggregate("_rows", start, step, lambda s: s["ok"])
    g = g.select("ledger_id", F.explode(F.arrays_zip(F.col("_rows").alias("r"), ok.alias("ok"))).alias("_z"))
    return g.select("ledger_id", "_z.r.*", F.col("_z.ok").alias("admitted")).select(*calls.columns, "admitted")


def _rounds(calls: DataFrame, order: Order, ceiling_cents: int) -> DataFrame:
    ensure_checkpoint_dir(calls.sparkSession)
    no_rounds = F.array().cast("array<struct<after:bigint,upto:bigint,below:bigint,big:bigint>>")
    state = calls.select("ledger_id").distinct().select(
        "ledger_id", F.lit(ceiling_cents).cast("long").alias("left"), F.lit(-1).cast("long").alias("after"),
        no_rounds.alias("rounds"), F.lit(False).alias("done"),
    ).checkpoint()
    end_of_time = F.lit(2**62).cast("long")
    while not state.filter("not done").isEmpty():
        todo = state.filter("not done")
        open_calls = calls.join(todo.drop("rounds", "done"), "ledger_id").filter(
            (F.col("seq") > F.col("after")) & (F.col("cents") >= 0) & (F.col("cents") <= F.col("left"))
        )
        below = F.pow(F.lit(2.0), F.length(F.bin("left")) - 1).cast("long")
        small = F.col("cents") < below
        o = open_calls.withColumn("_small", F.when(small, F.col("cents")).otherwise(0))
        o = running(o, order, _sum=ordered.total(F.col("_small")))
        ends = (F.col("left") > 0) & F.when(small, F.col("left") - F.col("_sum") < below).otherwise(
            F.col("cents") <= F.col("left") - F.col("_sum")
        )
        end = F.min(F.when(ends, F.struct("seq", "_sum", F.when(small, 0).otherwise(F.col("cents")).alias("big"))))
        found = o.groupBy("ledger_id").agg(end.alias("_end"))
        nxt = state.join(found, "ledger_id", "left")
        closed = F.struct(
            F.col("after"), F.coalesce(F.col("_end")["seq"], end_of_time).alias("upto"), below.alias("below"),
            F.when(F.col("_end")["big"] > 0, F.col("_end")["seq"]).otherwise(-1).alias("big"),
        )
        state = nxt.select(
            "ledger_id",
            (F.col("left") - F.coalesce(F.col("_end")["_sum"] + F.col("_end")["big"], F.lit(0))).alias("left"),
            F.coalesce(F.col("_end")["seq"], F.col("after")).alias("after"),
            F.when(F.col("done"), F.col("rounds")).otherwise(F.concat("rounds", F.array(closed))).alias("rounds"),
            (F.col("done") | F.col("_end").isNull()).alias("done"),
        ).checkpoint()
    c = calls.join(state.select("ledger_id", "rounds"), "ledger_id")
    admitted = F.exists(
        F.col("rounds"),
        lambda r: (F.col("seq") > r["after"]) & (F.col("seq") <= r["upto"])
        & ((F.col("cents") < r["below"]) | (F.col("seq") == r["big"])),
    )
    costs = F.coalesce(F.col("cents") >= 0, F.lit(False))
    return c.withColumn("admitted", costs & F.coalesce(admitted, F.lit(False))).select(*calls.columns, "admitted")
