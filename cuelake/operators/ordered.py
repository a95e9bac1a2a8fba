"""Running values over ordered groups, also where one group holds a large share of all rows.

A plain window puts a whole group into one task. ``arrange`` looks at the group sizes first. When
every group is small, nothing changes and the window is a plain one. Otherwise the large groups get
a block column that grows with the order, the windows run per (group, block), and one summary row
per block, scanned in a second small window, carries sums, extremes and neighbours across blocks.
The summaries are checkpointed, so a chain of running values stays a chain: each step reads its
input once more for the summary, and plans do not double.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.session import ensure_checkpoint_dir

ROWS_PER_BLOCK = 1_000_000
BROADCAST_GROUPS = 100_000


@dataclass(frozen=True)
class Order:
    """Groups ``keys`` (never null), ordered by ``by``; ``block`` is empty when groups are small."""

    keys: tuple[str, ...]
    by: tuple[str, ...]
    block: tuple[str, ...] = ()

    def window(self, back: bool = False):
        by = [F.desc(c) for c in self.by] if back else self.by
        return Window.partitionBy(*self.keys, *self.block).orderBy(*by)


class Running(NamedTuple):
    kind: str
    value: Column | None
    current: bool = True


def total(value: Column, current: bool = True) -> Running:
    """Running sum, with the row itself or up to the row before (then 0 at the start)."""
    return Running("sum", value, current)


def highest(value: Column, current: bool = True) -> Running:
    return Running("max", value, current)


def lowest(value: Column, current: bool = True) -> Running:
    return Running("min", value, current)


def lowest_ahead(value: Column) -> Running:
    """Least value of the rows after this one: a scan from the end, so one more sort but no frame that starts anew."""
    return Running("ahead", value, False)


def previous(value: Column) -> Running:
    return Running("lag", value)


def following(value: Column) -> Running:
    return Running("lead", value)


def position() -> Running:
    """1-based row number."""
    return Running("row", None)


def arrange(
    df: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    *,
    dense: bool = False,
    blocks: Sequence[Column] | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> tuple[DataFrame, Order]:
    """Return ``df`` with block columns where groups are large, and the matching ``Order``.

    ``dense`` says that ``by[0]`` counts 0, 1, 2, … inside each group (cue ids): the check is then a
    pushed-down filter and the block a division. Otherwise group sizes are counted once, and the
    groups above ``rows_per_block`` are cut along ``by[0]`` (an integer or timestamp) into blocks of
    about that size, or at the given ``blocks``, which must never fall along the order.
    """
    keys, by = tuple(keys), tuple(by)
    if dense:
        if df.filter(F.col(by[0]) >= rows_per_block).isEmpty():
            return df, Order(keys, by)
        block = F.floor(F.col(by[0]) / F.lit(rows_per_block))
        df = df.withColumn("_block0", block)
        return df.repartition(*keys, "_block0"), Order(keys, by, ("_block0",))

    first = F.col(by[0])
    if dict(df.dtypes)[by[0]].startswith("timestamp"):
        first = F.unix_micros(first.cast("timestamp"))
    sizes = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(first).alias("_lo"), F.max(first).alias("_hi")
    )
    large = sizes.filter(F.col("_n") > rows_per_block)  # at most rows / rows_per_block groups
    found = large.limit(BROADCAST_GROUPS + 1).count()
    if found == 0:
        return df, Order(keys, by)
    df = df.join(F.broadcast(large) if found <= BROADCAST_GROUPS else large, list(keys), "left")
    if blocks is None:
        return _equal_blocks(df.withColumn("_at", first), keys, by, rows_per_block)
    names = tuple(f"_block{i}" for i in range(len(blocks)))
    cut = [F.when(F.col("_n").isNotNull(), b).alias(n) for b, n in zip(blocks, names)]
    df = df.select("*", *cut).drop("_n", "_lo", "_hi")
    # rows that lie together per group are good enough for a window over (group, block), so a large
    # group would stay in one task after the join: deal them by both
    return df.repartition(*keys, *names), Order(keys, by, names)


def _equal_blocks(
    df: DataFrame, keys: tuple[str, ...], by: tuple[str, ...], rows_per_block: int
) -> tuple[DataFrame, Order]:
    """Cut large groups (those with ``_n``, ``_lo``, ``_hi``; place ``_at``) into blocks of at most about a bound.

    Slices of equal width are counted, and only slices above the bound are sliced again, so that a
    clump of close values is found whatever else the group holds. Neighbouring small slices then
    share a block. Rows of one value of the order column are never parted: more of these than the
    bound stay together.
    """
    ensure_checkpoint_dir(df.sparkSession)
    slices_of = lambda n: F.ceil(n * 2 / F.lit(rows_per_block))
    large = F.col("_n").isNotNull()
    # where each row's slice begins, and how wide and full it is; a step narrows only the full ones
    rows = df.withColumns({
        "_from": F.when(large, F.col("_lo")), "_wide": F.when(large, F.col("_hi") - F.col("_lo") + 1), "_in": F.col("_n"),
    }).drop("_n", "_lo", "_hi")
    while True:
        full = (F.col("_in") > rows_per_block) & (F.col("_wide") > 1)
        width = F.greatest(F.ceil(F.col("_wide") / slices_of(F.col("_in"))), F.lit(1))
        begin = F.when(full, F.col("_from") + F.floor((F.col("_at") - F.col("_from")) / width) * width).otherwise(F.col("_from"))
        rows = rows.withColumns({"_next": begin, "_wide": F.when(full, width).otherwise(F.col("_wide"))})
        rows = rows.withColumn("_from", F.col("_next")).drop("_next", "_in")
        counted = rows.filter(F.col("_from").isNotNull()).groupBy(*keys, "_from", "_wide").agg(F.count(F.lit(1)).alias("_in"))
        counted = counted.checkpoint()  # at most a few slices per block's worth of rows
        if counted.filter((F.col("_in") > rows_per_block) & (F.col("_wide") > 1)).isEmpty():
            break
        rows = rows.join(counted, [*keys, "_from", "_wide"], "left")
    along = Window.partitionBy(*keys).orderBy("_from")
    before = F.coalesce(F.sum("_in").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a slice above half the bound is a block of its own; smaller ones fill blocks up to the next such slice
    alone = (F.col("_in") * 2 > rows_per_block).cast("long")
    own = F.sum(alone).over(along) + F.coalesce(F.sum(alone).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.select(*keys, "_from", "_wide", own.alias("_block0"), F.floor(before / rows_per_block * 2).alias("_block1"))
    placed = placed.withColumn("_block1", F.when(F.col("_block0") % 2 == 1, F.lit(0)).otherwise(F.col("_block1"))).checkpoint()
    out = rows.join(placed, [*keys, "_from", "_wide"], "left").drop("_from", "_wide", "_at")
    names = ("_block0", "_block1")
    return out.repartition(*keys, *names), Order(keys, by, names)


def _local(spec: Running, window, wrap: bool, back=None) -> Column:
    if spec.kind == "ahead":
        return F.min(spec.value).over(back.rowsBetween(Window.unboundedPreceding, -1))
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    frame = upto if spec.current else before
    if spec.kind == "row":
        return F.row_number().over(window).cast("long")
    if spec.kind in ("lag", "lead"):
        step = F.lag if spec.kind == "lag" else F.lead
        return step(F.struct(spec.value.alias("v")) if wrap else spec.value).over(window)
    value = {"sum": F.sum, "max": F.max, "min": F.min}[spec.kind](spec.value).over(frame)
    return F.coalesce(value, F.lit(0)) if spec.kind == "sum" else value


def _summary(spec: Running, by: tuple[str, ...]) -> Column:
    if spec.kind == "row":
        return F.count(F.lit(1))
    if spec.kind == "lag":
        return F.max_by(F.struct(spec.value.alias("v")), F.struct(*by))
    if spec.kind == "lead":
        return F.min_by(F.struct(spec.value.alias("v")), F.struct(*by))
    return {"sum": F.sum, "max": F.max, "min": F.min, "ahead": F.min}[spec.kind](spec.value)


def _carried(spec: Running, name: str, window, back) -> Column:
    if spec.kind == "ahead":
        return F.min(name).over(back.rowsBetween(Window.unboundedPreceding, -1))
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    if spec.kind == "lag":
        return F.lag(name).over(window)
    if spec.kind == "lead":
        return F.lead(name).over(window)
    if spec.kind in ("row", "sum"):
        return F.sum(name).over(before)
    return {"max": F.max, "min": F.min}[spec.kind](name).over(before)


def _combined(spec: Running, local: Column, carry: Column) -> Column:
    if spec.kind in ("row", "sum"):
        return local + F.coalesce(carry, F.lit(0))
    if spec.kind == "max":
        return F.greatest(local, carry)  # greatest and least skip nulls
    if spec.kind in ("min", "ahead"):
        return F.least(local, carry)
    return F.coalesce(local, carry)["v"]


def running(df: DataFrame, order: Order, **specs: Running) -> DataFrame:
    """Add one column per spec; specs read columns of ``df``, not each other."""
    window, back = order.window(), order.window(back=True)
    if not order.block:
        return df.select("*", *[_local(s, window, False, back).alias(n) for n, s in specs.items()])

    groups = [*order.keys, *order.block]
    local = df.select("*", *[_local(s, window, True, back).alias(f"_l_{n}") for n, s in specs.items()])
    blocks = df.filter(F.col(order.block[0]).isNotNull()).groupBy(*groups).agg(
        *[_summary(s, order.by).alias(f"_c_{n}") for n, s in specs.items()]
    )
    whole = Window.partitionBy(*order.keys)
    over_blocks, from_last = whole.orderBy(*order.block), whole.orderBy(*[F.desc(b) for b in order.block])
    carry = blocks.select(
        *groups, *[_carried(s, f"_c_{n}", over_blocks, from_last).alias(f"_c_{n}") for n, s in specs.items()],
        F.count(F.lit(1)).over(Window.partitionBy(*order.keys)).alias("_blocks"),
    ).filter(F.col("_blocks") > 1).drop("_blocks")
    ensure_checkpoint_dir(df.sparkSession)
    carry = carry.checkpoint()  # one row per block; without this a chain would plan each step twice
    if carry.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        carry = F.broadcast(carry)
    joined = local.join(carry, groups, "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[
            _combined(s, F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n)
            for n, s in specs.items()
        ],
    )


def unblock(df: DataFrame, order: Order) -> DataFrame:
    """Drop the helper columns again."""
    return df.drop(*order.block)
