"""Split long cues: token-aware text chunks and proportional, capped slice lengths.

Everything is local to one cue row, so no shuffle is needed before the chunks are numbered. A fold over
tokens with ``F.aggregate`` took several times as long, so chunk ends come from a vectorised helper.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.functions.text import script_class, squeeze
from cuelake.operators import ordered
from cuelake.operators.ordered import Order, running

MAX_CUE_MS = 7000

# Where sentences end, per script.
SENTENCE_BREAK = r"(?<=[.!?؟۔…])\s+"
CJK_SENTENCE_BREAK = r"(?<=[。！？])"


def _parts(text: Column, script: Column, cjk_break: str, other_break: str) -> Column:
    """Split squeezed text; only CJK breaks can leave an empty part."""
    cjk = F.filter(F.split(text, cjk_break), lambda x: x != "")
    none = F.array().cast("array<string>")
    return F.when(text == "", none).when(script == "cjk", cjk).otherwise(F.split(text, other_break))


def sentences(text: Column, script: Column) -> Column:
    return _parts(text, script, CJK_SENTENCE_BREAK, SENTENCE_BREAK)


def words(text: Column, script: Column) -> Column:
    return _parts(text, script, "", " ")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` computed once; an inlined expression would run again per lambda call."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def chunk_ends(tokens: Column, n: Column) -> Column:
    """Where each of ``n`` chunks ends, from token lengths alone; the texts stay in the JVM.

    A chunk ends with the first token that reaches its share of the whole (halves to even), after at
    least one token and leaving one for each chunk behind it.
    """

    def ends(size: np.ndarray, k: int) -> np.ndarray:
        reached, j = np.cumsum(size, dtype=np.int64), np.arange(k - 1)
        q, r = np.divmod(reached[-1] * (j + 1), k)
        share = q + np.where(2 * r == k, q % 2, 2 * r > k)
        first = np.searchsorted(reached, share) + 1
        cut = np.minimum(np.maximum.accumulate(first - j) + j, len(size) - (k - 1 - j))
        return np.concatenate(([0], cut, [len(size)]))

    def batch(lengths: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([None if k < 2 else ends(size, int(k)) for size, k in zip(lengths, counts)])

    # a local function travels to the executors by value
    run = F.pandas_udf(batch, T.ArrayType(T.LongType()))
    return run(F.when(n > 1, F.transform(tokens, F.length)), n)


def chunk_texts(tokens: Column, ends: Column, n: Column, separator: Column) -> Column:
    """The ``n`` chunk texts between consecutive ``ends``."""

    def text(k: Column) -> Column:
        a, b = F.element_at(ends, k.cast("int")), F.element_at(ends, (k + 1).cast("int"))
        piece = F.slice(tokens, (a + 1).cast("int"), (b - a).cast("int"))
        return F.call_function("array_join", piece, separator)

    return F.transform(F.sequence(_long(1), n), text)


def slice_lengths(weights: Column, span: Column, cap: Column) -> Column:
    """Integer slice lengths in proportion to ``weights``, none above ``cap``, tiling ``span``.

    When the span does not fit under the cap, the cap becomes the smallest one it fits under.
    """
    n = F.size(weights)
    given = F.struct(
        weights.alias("w"), span.alias("span"), F.greatest(cap, F.ceil(span / n)).alias("cap"),
        F.aggregate(weights, _long(0), lambda a, w: a + w).alias("whole"),
        F.reverse(F.sort_array(weights)).alias("falling"),
    )
    return _let(given, _fill)


def _fill(g: Column) -> Column:
    cap, span = g["cap"], g["span"]
    start = F.struct(_long(0).alias("j"), _long(0).alias("capped"), _long(0).alias("used"))

    def step(s: Column, w: Column) -> Column:  # capped weights come first in falling order
        hit = (s["j"] == s["capped"]) & ((span - s["j"] * cap) * w > cap * (g["whole"] - s["used"]))
        return F.struct(
            (s["j"] + 1).alias("j"), F.when(hit, s["capped"] + 1).otherwise(s["capped"]).alias("capped"),
            F.when(hit, s["used"] + w).otherwise(s["used"]).alias("used"),
        )

    def bounds(s: Column) -> Column:
        limit = F.when(s["capped"] > 0, F.element_at(g["falling"], F.greatest(s["capped"], _long(1)).cast("int")))
        return F.struct(
            limit.alias("limit"), (span - s["capped"] * cap).alias("room"), (g["whole"] - s["used"]).alias("rest")
        )

    def share(b: Column, w: Column) -> Column:
        capped = F.coalesce(w >= b["limit"], F.lit(False))
        return F.when(capped, cap).otherwise(F.floor(b["room"] * w / b["rest"]).cast("long"))

    floors = _let(
        F.aggregate(g["falling"], start, step, bounds),
        lambda b: F.transform(g["w"], lambda w: share(b, w)),
    )

    def hand_out(s: Column, x: Column) -> Column:
        extra = F.least(s["left"], cap - x)
        return F.struct((s["left"] - extra).alias("left"), F.concat(F.array(x + extra), s["out"]).alias("out"))

    def finish(f: Column) -> Column:
        left = span - F.aggregate(f, _long(0), lambda a, x: a + x)
        give = F.struct(left.alias("left"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(F.reverse(f), give, hand_out, lambda s: s["out"])

    return _let(floors, finish)


def split_long_cues(cues: DataFrame, order: Order, max_ms: int = MAX_CUE_MS) -> DataFrame:
    """Cues longer than ``max_ms`` become several; ids are renumbered along the track.

    Reads ``language, cue_id, start_ms, end_ms, source_text, target_text``; other columns, such as
    flags and context notes, are carried along.
    """
    c = cues.withColumns({
        "_script": script_class(F.col("language")),
        "_span": F.col("end_ms") - F.col("start_ms"),
        "_t": squeeze(F.col("target_text")), "_s": squeeze(F.col("source_text")),
    })
    c = c.withColumns({
        "_tw": words(F.col("_t"), F.col("_script")), "_ts": sentences(F.col("_t"), F.col("_script")),
        "_sw": words(F.col("_s"), F.col("_script")), "_ss": sentences(F.col("_s"), F.col("_script")),
    })
    wanted = F.ceil(F.col("_span") / max_ms)
    n = F.greatest(F.lit(1), F.least(wanted, F.size("_tw"), F.size("_sw"))).cast("long")
    c = c.withColumn("_n", n)
    sep = F.when(F.col("_script") == "cjk", "").otherwise(" ")
    t_tokens = F.when(F.size("_ts") >= F.col("_n"), F.col("_ts")).otherwise(F.col("_tw"))
    s_tokens = F.when(F.size("_ss") >= F.col("_n"), F.col("_ss")).otherwise(F.col("_sw"))
    one = F.col("_n") == 1
    c = c.withColumns({"_tt": t_tokens, "_st": s_tokens}).drop("_tw", "_ts", "_sw", "_ss")
    c = c.withColumns({
        "_te": chunk_ends(F.col("_tt"), F.col("_n")), "_se": chunk_ends(F.col("_st"), F.col("_n"))
    })
    texts = lambda t, e: chunk_texts(F.col(t), F.col(e), F.col("_n"), sep)
    c = c.withColumns({
        "_tc": F.when(one, F.array("target_text")).otherwise(texts("_tt", "_te")),
        "_sc": F.when(one, F.array("source_text")).otherwise(texts("_st", "_se")),
    })
    weights = F.transform(F.col("_tc"), lambda x: F.length(x).cast("long"))
    c = c.withColumn(
        "_d",
        F.when(one, F.array(F.col("_span"))).otherwise(
            slice_lengths(weights, F.col("_span"), F.lit(max_ms).cast("long"))
        ),
    )
    starts = F.aggregate(
        F.col("_d"),
        F.struct(F.col("start_ms").alias("at"), F.array().cast("array<bigint>").alias("out")),
        lambda acc, d: F.struct(
            (acc["at"] + d).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")
        ),
        lambda acc: acc["out"],
    )
    parts = F.arrays_zip(
        F.col("_tc").alias("t"), F.col("_sc").alias("s"), F.col("_d").alias("d"), starts.alias("at")
    )
    replaced = ("start_ms", "end_ms", "source_text", "target_text")
    whole_only = ("lines", "back_translation")  # a split cue loses these
    keep = [
        F.when(one, F.col(x)).alias(x) if x in whole_only else F.col(x)
        for x in cues.columns if x not in replaced
    ]
    out = c.select(*keep, F.posexplode(parts).alias("part", "_p"))
    out = out.withColumns({
        "part": F.col("part").cast("long"),
        "start_ms": F.col("_p")["at"],
        "end_ms": F.col("_p")["at"] + F.col("_p")["d"],
        "source_text": F.col("_p")["s"],
        "target_text": F.col("_p")["t"],
    }).drop("_p")
    o = Order(order.keys, (*order.by, "part"), order.block)
    out = running(out, o, new_id=ordered.position())
    return out.withColumn("new_id", F.col("new_id") - 1)
