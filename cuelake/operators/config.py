"""Configurations of any depth, merged from JSON documents: objects key by key, lists and scalars replaced.

A document is taken apart into its leaves, one row each, with the keys on the way as an array, so that a key may hold
dots or quotes. A leaf is a scalar, a list or an empty object. Merging is then a matter of paths: what hides a leaf are
leaves of the upper document at its place, above it or below it, all found by equal prefixes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.session import ensure_checkpoint_dir

EMPTY = "{}"


def leaves(documents: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """``(keys, path, value)`` of each document's leaves, values as JSON; a null document has none.

    One round a level of nesting, over the objects that are left.
    """
    ensure_checkpoint_dir(documents.sparkSession)
    keys = list(keys)
    level = documents.filter(F.col(column).isNotNull()).select(
        *keys, F.array().cast("array<string>").alias("path"), F.parse_json(column).alias("_v")
    )
    out = None
    while True:
        kind = F.schema_of_variant("_v")
        inner = kind.startswith("OBJECT<") & (kind != "OBJECT<>")
        flat = level.filter(~inner & (F.size("path") > 0)).select(*keys, "path", F.to_json("_v").alias("value"))
        out = flat if out is None else out.unionByName(flat)
        names = ", ".join(f"`{k}`" for k in keys)
        level = documents.sparkSession.sql(
            f"SELECT {names}, array_append(path, e.key) AS path, e.value AS _v FROM {{objects}}, LATERAL variant_explode(_v) e",
            objects=level.filter(inner),
        ).checkpoint()
        if level.isEmpty():
            return out


def _prefixes(path: str, proper: bool) -> Column:
    """The path's beginnings, from its first key on, itself among them unless ``proper``."""
    last = F.size(path) - (1 if proper else 0)
    every = F.transform(F.sequence(F.lit(1), last), lambda n: F.slice(path, F.lit(1), n))
    return F.explode(F.when(last > 0, every))


def merge(lower: DataFrame, upper: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Leaves of both documents of each key, where the upper one's win; both are ``(keys, path, value)``."""
    keys, at = list(keys), [*keys, "path"]
    solid = upper.filter(F.col("value") != EMPTY).select(*at)
    inside = lower.select(*keys, F.col("path").alias("_leaf"), _prefixes("path", proper=False).alias("path"))
    covered = inside.join(solid, at, "left_semi").select(*keys, F.col("_leaf").alias("path"))
    # an empty object leaves an object's leaves alone, but takes the place of a list or scalar
    replaced = upper.select(*at).unionByName(upper.select(*keys, _prefixes("path", proper=True).alias("path")))
    stay = lower.join(covered.unionByName(replaced).distinct(), at, "left_anti")
    filled = lower.select(*keys, _prefixes("path", proper=True).alias("path"))
    drop = upper.filter(F.col("value") == EMPTY).select(*at).join(filled, at, "left_semi")
    return stay.unionByName(upper.join(drop, at, "left_anti"))


def effective(entries: DataFrame, defaults: DataFrame) -> DataFrame:
    """``(video_id, path, value)``: each entry's overrides over the layers of its profile's defaults.

    ``entries`` is ``(video_id, profile, entry)``, ``defaults`` ``(profile, layer, config)``, layers counting upwards;
    ``entry`` and ``config`` are JSON. An entry's ``id`` and ``url`` are carried unless they are empty.
    """
    ensure_checkpoint_dir(entries.sparkSession)
    layers = sorted(r.layer for r in defaults.select("layer").distinct().collect())  # a handful of files
    base = None
    for layer in layers:
        own = leaves(defaults.filter(F.col("layer") == layer), ["profile"], "config")
        base = own if base is None else merge(base, own, ["profile"]).checkpoint()
    given = leaves(entries, ["video_id"], "entry")
    first = F.get("path", F.lit(0))
    over = given.filter((first == "overrides") & (F.size("path") > 1)).withColumn("path", F.slice("path", F.lit(2), F.size("path")))
    carried = given.filter(first.isin("id", "url") & ~F.col("value").isin("null", '""', "false", "0", "[]", EMPTY))
    profiles = entries.select("video_id", "profile")
    out = over if base is None else merge(profiles.join(base, "profile").select("video_id", "path", "value"), over, ["video_id"])
    return merge(out, carried, ["video_id"])


def json_path(path: str) -> Column:
    """The keys as one JSON path; keys with other signs than letters, digits and ``_`` are quoted."""
    step = lambda k: F.when(k.rlike("^[A-Za-z0-9_]+$"), k).otherwise(F.concat(F.lit('"'), k, F.lit('"')))
    return F.concat(F.lit("$."), F.array_join(F.transform(path, step), "."))
