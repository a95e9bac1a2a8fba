"""Replay of requested state changes where a step that isn't allowed is refused and leaves the state as it was.

What an event does depends on the state it meets, so runs of events can't be told apart by sums. But each event is a
map from states to states, and maps compose: a block of events is one map of a few numbers. Blocks are composed level
by level, start states are handed down again, and only then each block is walked once with the state it starts in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.operators import ordered
from cuelake.operators.ordered import Order, running, unblock
from cuelake.session import ensure_checkpoint_dir

FAN_IN = 1_000


def _listed(columns: list[str]) -> Column:
    """A block's rows in order; a block holds ``FAN_IN`` of them at most."""
    return F.sort_array(F.collect_list(F.struct(*columns)))


def _numbers(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _starts(maps: DataFrame, keys: list[str], states: int, first: int, fan_in: int) -> DataFrame:
    """``(keys, at, start)``: the state each block of ``(keys, at, map)`` begins in; blocks count from 0."""
    maps = maps.checkpoint()
    last = maps.agg(F.max("at")).first()[0]
    if last is None or last < fan_in:
        groups = maps.groupBy(*keys).agg(_listed(["at", "map"]).alias("_blocks")).withColumn("start", F.lit(first))
    else:
        up = maps.withColumn("up", F.floor(F.col("at") / fan_in))
        groups = up.groupBy(*keys, "up").agg(_listed(["at", "map"]).alias("_blocks"))
        whole = F.aggregate("_blocks", _numbers(range(states)), lambda m, b: F.transform(m, lambda s: F.get(b["map"], s)))
        above = groups.select(*keys, F.col("up").alias("at"), whole.alias("map"))
        above = _starts(above, keys, states, first, fan_in).withColumnRenamed("at", "up")
        groups = groups.join(above, [*keys, "up"])
    begun = F.aggregate(
        "_blocks", F.struct(F.array().cast("array<int>").alias("met"), F.col("start").alias("now")),
        lambda a, b: F.struct(F.array_append(a["met"], a["now"]).alias("met"), F.get(b["map"], a["now"]).alias("now")),
    )["met"]
    pairs = F.explode(F.arrays_zip(F.col("_blocks.at").alias("at"), begun.alias("start")))
    return groups.select(*keys, pairs.alias("_p")).select(*keys, "_p.at", "_p.start")


def replay(
    events: DataFrame, order: Order, allowed: Sequence[tuple[str, str]], first: str, fan_in: int = FAN_IN
) -> DataFrame:
    """``(keys, seq, to_state, met, accepted)`` of each event: the state it met, and whether its step was taken.

    ``allowed`` are the edges ``(from, to)``; ``first`` is the state before any event. A state that no edge names is
    always refused. ``order`` is by ``seq``.
    """
    ensure_checkpoint_dir(events.sparkSession)
    keys = list(order.keys)
    names = sorted({first, *(s for e in allowed for s in e)})
    n, edges = len(names), set(allowed)
    # for each wanted state what becomes of every state
    after = [[names.index(to) if (s, to) in edges else k for k, s in enumerate(names)] for to in names]
    table = F.array(*[_numbers(row) for row in after])
    e = unblock(running(events, order, _n=ordered.position()), order)
    to = F.array_position(F.array(*[F.lit(s) for s in names]), F.col("to_state")).cast("int") - 1
    e = e.select(*keys, F.floor((F.col("_n") - 1) / fan_in).alias("at"), "_n", "seq", "to_state", F.when(to >= 0, to).alias("_to"))
    blocks = e.groupBy(*keys, "at").agg(_listed(["_n", "seq", "to_state", "_to"]).alias("_events")).checkpoint()
    whole = F.aggregate(
        "_events", _numbers(range(n)),
        lambda m, x: F.when(x["_to"].isNull(), m).otherwise(F.transform(m, lambda s: F.get(F.get(table, x["_to"]), s))),
    )
    starts = _starts(blocks.select(*keys, "at", whole.alias("map")), keys, n, names.index(first), fan_in)
    walked = F.aggregate(
        "_events", F.struct(F.array().cast("array<int>").alias("met"), F.col("start").alias("now")),
        lambda a, x: F.struct(
            F.array_append(a["met"], a["now"]).alias("met"),
            F.when(x["_to"].isNull(), a["now"]).otherwise(F.get(F.get(table, x["_to"]), a["now"])).alias("now"),
        ),
    )["met"]
    rows = blocks.join(starts, [*keys, "at"]).select(*keys, F.explode(F.arrays_zip(F.col("_events").alias("e"), walked.alias("met"))).alias("_p"))
    met = F.get(F.array(*[F.lit(s) for s in names]), F.col("_p.met"))
    step = F.struct(met.alias("a"), F.col("_p.e.to_state").alias("b"))
    taken = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in sorted(edges)])
    return rows.select(
        *keys, F.col("_p.e.seq").alias("seq"), F.col("_p.e.to_state").alias("to_state"), met.alias("met"),
        F.coalesce(F.array_contains(taken, step), F.lit(False)).alias("accepted"),
    )
