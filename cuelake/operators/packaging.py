"""Package manifests, channels and posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.operators import captions
from cuelake.operators.provenance import DISTRIBUTABLE

PIECE = ["project_id", "language", "clip_index", "kind", "name", "place", "content", "sha256"]
# Fixed value: what the notes of a package say while its rights don't allow distribution
NOT_CLEARED = "NOT CLEARED FOR DISTRIBUTION"


def package_manifest(active: DataFrame, tracks: DataFrame, rights: DataFrame, dub_type: str) -> DataFrame:
    """Deliverables per (project, language) with their hashes, and the rights banner.

    A track without dubbing ships no dub. The list per track is as long as there are artifact types.
    """
    a = active.join(tracks.select("project_id", "language", "dub_enabled"), ["project_id", "language"])
    a = a.filter(F.col("dub_enabled") | (F.col("type") != dub_type))
    items = F.sort_array(F.collect_list(F.concat_ws("=", "type", "sha256")))
    m = a.groupBy("project_id", "language").agg(items.alias("deliverables"), F.count(F.lit(1)).alias("n_deliverables"))
    m = m.join(rights, "project_id", "left")
    return m.withColumn("distributable", F.coalesce(F.col("rights_status").isin(DISTRIBUTABLE), F.lit(False)))


def _variant(row_kind: str, fmt: str | None = None) -> tuple[Column, Column]:
    """(kind, file name) by a package's selection: whole video, single clips, or the clips joined."""
    clip = F.col("clip_index").isNotNull()
    if fmt is not None:
        stem = F.when(clip, F.concat(F.lit("clip-"), F.col("clip_index").cast("string"))).otherwise("captions")
        return F.lit(f"captions-{fmt}"), F.concat_ws(".", stem, "language", F.lit(fmt))
    kind = F.when(clip, "clip-video").when(F.col("joined"), "joined-video").otherwise(row_kind)
    return kind, F.concat_ws(".", F.concat_ws("-", kind, F.col("clip_index").cast("string")), "language", F.lit("mp4"))


def package_pieces(units: DataFrame, cues: DataFrame, rights: DataFrame) -> DataFrame:
    """The pieces of all files of the packages, for ``write_packages``.

    ``units`` is ``(project_id, language, dub_enabled, joined, clip_index, media_sha256)``: one row a package, or one a
    clip where the clips stay apart (``clip_index`` is null elsewhere). ``cues`` are those of the units, with the same
    keys, in the time of the clip or of the joined video. A track without dubbing ships captions and notes only.
    """
    keys = ["project_id", "language", "clip_index"]
    nothing = F.lit(None).cast("string").alias("sha256")
    parts = []
    for fmt in ("srt", "vtt"):
        kind, name = _variant("", fmt)
        head = F.lit("WEBVTT\n\n" if fmt == "vtt" else "")
        # a file without cues is a file
        begin = units.select(*keys, kind.alias("kind"), name.alias("name"), F.lit(-1).cast("long").alias("place"), head.alias("content"), nothing)
        block = captions.block(fmt, "target_text", "lines" in cues.columns)
        body = cues.select(*keys, kind.alias("kind"), name.alias("name"), F.col("cue_id").alias("place"), block.alias("content"), nothing)
        parts += [begin, body]
    kind, name = _variant("dubbed-video")
    parts.append(units.filter("dub_enabled").select(
        *keys, kind.alias("kind"), name.alias("name"), F.lit(0).cast("long").alias("place"),
        F.lit(None).cast("string").alias("content"), F.col("media_sha256").alias("sha256"),
    ))
    packages = units.groupBy("project_id", "language").agg(F.max("dub_enabled").alias("dub_enabled")).join(rights, "project_id", "left")
    cleared = F.coalesce(F.col("rights_status").isin(DISTRIBUTABLE), F.lit(False))
    notes = F.concat(
        F.lit("# "), F.col("project_id").cast("string"), F.lit("\n\nLanguage: "), "language",
        F.lit("\nDubbed: "), F.when(F.col("dub_enabled"), "yes").otherwise("no"),
        F.lit("\nRights: "), F.coalesce("rights_status", F.lit("unreviewed")), F.lit("\n"),
        F.when(cleared, "").otherwise(f"\n**{NOT_CLEARED}**\n"),
    )
    parts.append(packages.select(
        "project_id", "language", F.lit(None).cast("int").alias("clip_index"), F.lit("readme").alias("kind"),
        F.lit("README.md").alias("name"), F.lit(0).cast("long").alias("place"), notes.alias("content"), nothing,
    ))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*PIECE)


def resolve_channels(projects: DataFrame, channels: DataFrame) -> DataFrame:
    """Channel per project: its override, else the language's default, else its first, else null."""
    best = channels.groupBy("language").agg(
        F.min(F.struct((~F.col("is_default")).alias("n"), "ord", "channel_id"))["channel_id"].alias("_best")
    )
    p = projects.join(best, "language", "left")
    return p.withColumn("channel_id", F.coalesce("override_channel", "_best")).drop("_best")


def config_problems(channels: DataFrame) -> DataFrame:
    """Languages with more than one default channel."""
    return channels.groupBy("language").agg(
        F.sum(F.col("is_default").cast("long")).alias("defaults")
    ).filter(F.col("defaults") > 1)


def duplicate_posts(posts: DataFrame) -> DataFrame:
    """Texts that more than one queued post shares."""
    queued = posts.filter(F.col("status") == "queued")
    return queued.groupBy("text").agg(
        F.count(F.lit(1)).alias("posts"), F.min("post_id").alias("first_post")
    ).filter(F.col("posts") > 1)
