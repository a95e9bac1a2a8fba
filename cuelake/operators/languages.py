"""Language plans, voice choice, added languages, effective configuration."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions.text import norm_codes, normalize_language

# Languages without voice-clone coverage.
PIPER_ONLY = ["fa", "ur"]


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def language_plan(requests: DataFrame, known: list[str]) -> DataFrame:
    """What to translate, caption and dub per video, with notes and errors.

    Reads ``source string`` and the arrays ``targets, dubs, captions``.
    """
    r = requests.withColumns({
        "source": F.coalesce(F.lower(F.trim("source")), F.lit("")),
        "targets": norm_codes(F.col("targets")), "dubs": norm_codes(F.col("dubs")),
        "captions": norm_codes(F.col("captions")),
    })
    source = F.array("source")
    asked = F.concat(source, F.col("targets"), F.col("dubs"), F.col("captions"))
    r = r.withColumn("unknown", F.filter(F.array_distinct(F.array_except(asked, _strings(known))), lambda c: c != ""))
    r = r.withColumn("translate", F.array_except("targets", source))
    r = r.withColumn("produced", F.array_union(source, F.col("translate")))
    r = r.withColumn("matched", F.array_intersect("produced", "captions"))
    outside = lambda c: F.array_except(c, F.col("produced"))
    note = lambda kind, codes: F.transform(codes, lambda c: F.concat(F.lit(kind + ":"), c))
    none_matched = (F.size("captions") > 0) & (F.size("matched") == 0)
    notes = F.concat(
        F.when(F.array_contains("targets", F.col("source")), F.array(F.concat(F.lit("self-translation:"), "source")))
        .otherwise(F.array().cast("array<string>")),
        note("caption-ignored", outside(F.col("captions"))),
        F.when(none_matched, F.array(F.lit("captions-fall-back:all"))).otherwise(F.array().cast("array<string>")),
        note("dub-ignored", outside(F.col("dubs"))),
    )
    return r.withColumns({
        "caption_langs": F.when(F.size("matched") > 0, F.col("matched")).otherwise(F.col("produced")),
        "dub_langs": F.array_intersect("dubs", "produced"),
        "notes": notes,
        "error": F.when(F.col("source") == "", "missing-source").when(F.size("unknown") > 0, "unknown-code"),
    }).drop("matched")


def voice_plan(dubs: DataFrame, clone_languages: list[str]) -> DataFrame:
    """Engine per (video, dub language).

    Reads ``provider`` (forced engine or null), ``voice_clone`` (explicit choice or null) and
    ``clone_default`` (the global switch).
    """
    lang, forced, explicit = F.col("language"), F.lower(F.trim("provider")), F.col("voice_clone")
    piper_only = lang.isin(PIPER_ONLY)
    error = F.when(piper_only & (forced != "piper"), "piper-only-provider").when(
        piper_only & F.coalesce(explicit, F.lit(False)), "piper-only-clone"
    )
    clone = (
        F.when(forced == "piper", False)
        .when(explicit.isNotNull(), explicit)
        .otherwise(F.col("clone_default") & lang.isin(clone_languages))
    )
    d = dubs.withColumn("error", error)
    return d.withColumn("clone", F.when(F.col("error").isNull(), clone).otherwise(False))


def add_languages(requests: DataFrame) -> DataFrame:
    """New languages in order, the resulting list and the dub subset.

    Reads the arrays ``present, wanted, wanted_dubs`` (null dubs: every added language).
    """
    wanted = norm_codes(F.col("wanted"))
    r = requests.withColumn("added", F.array_except(wanted, "present"))
    bad = F.exists(F.col("added"), lambda c: normalize_language(c).isNull())
    dubs = F.coalesce(norm_codes(F.col("wanted_dubs")), F.col("added"))
    dubs = F.when(F.col("wanted_dubs").isNull(), F.col("added")).otherwise(dubs)
    r = r.withColumn("dubbed", dubs)
    error = F.when(bad, "unknown-code").when(F.size(F.array_except("dubbed", "added")) > 0, "dub-not-added")
    return r.withColumn("error", error).withColumn("languages", F.array_union("present", "added"))


def flatten(config: dict[str, Any], prefix: str = "") -> dict[str, str]:
    """Nested configuration as dotted paths with JSON values; lists and scalars are leaves."""
    out: dict[str, str] = {}
    for key, value in config.items():
        path = f"{prefix}{key}"
        if isinstance(value, dict) and value:
            out.update(flatten(value, path + "."))
        else:
            out[path] = json.dumps(value, sort_keys=True)
    return out


def effective_config(entries: DataFrame, defaults: dict[str, Any]) -> DataFrame:
    """Defaults under each video's own settings as ``(video_id, path, value)``.

    ``entries`` has ``overrides`` as a map from dotted path to JSON value. An override replaces the
    default at its path, below it, and a leaf above it. Local to the row: no join.
    """
    flat = flatten(defaults)
    base = F.create_map(*[F.lit(x) for kv in sorted(flat.items()) for x in kv])
    own = F.map_keys("overrides")
    hidden = lambda p: F.exists(
        own, lambda o: (o == p) | F.startswith(p, F.concat(o, F.lit("."))) | F.startswith(o, F.concat(p, F.lit(".")))
    )
    kept = F.map_filter(base, lambda p, v: ~hidden(p))
    return entries.select("video_id", F.explode(F.map_concat(kept, F.col("overrides"))).alias("path", "value"))
