"""As-of lookups in both directions: the marks just before and just after each point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.operators import ordered
from cuelake.operators.ordered import ROWS_PER_BLOCK, arrange, running, unblock


def neighbours(
    points: DataFrame, at: str, marks: DataFrame, mark: str, keys: Sequence[str], rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """``points`` with ``before``, the last mark at or before ``at``, and ``after``, the first one later; else null.

    Points and marks of the same ``keys`` lie in one sorted table, and the marks met on the way are carried along it
    from both ends: one shuffle for both sides, and no pair of a point and a mark is made. A key that holds many rows
    is cut into blocks by time. Points without ``at`` stay and have no neighbours. ``at`` and ``mark`` are whole numbers;
    the names ``before`` and ``after`` are free in ``points``.
    """
    keys = list(keys)
    rows = points.withColumns({"_when": F.coalesce(F.col(at), F.lit(0)).cast("long"), "_point": F.lit(True)})
    met = marks.filter(F.col(mark).isNotNull()).select(*keys, F.col(mark).cast("long").alias("_when"), F.lit(False).alias("_point"))
    both = rows.unionByName(met, allowMissingColumns=True)
    both, order = arrange(both, keys, ("_when", "_point"), rows_per_block=rows_per_block)  # a mark comes before its points
    own = F.when(~F.col("_point"), F.col("_when"))
    out = unblock(running(both, order, before=ordered.highest(own), after=ordered.lowest_ahead(own)), order)
    known = F.col(at).isNotNull()
    return out.filter("_point").drop("_when", "_point").withColumns({
        "before": F.when(known, F.col("before")), "after": F.when(known, F.col("after"))
    })
