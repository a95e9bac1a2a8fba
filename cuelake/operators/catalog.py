"""Catalog entries, playlists, enrichment with project state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions.refs import is_valid_video_id
from cuelake.operators import ordered
from cuelake.operators.ordered import Order, running


def check_fields(updates: DataFrame, known: Sequence[str]) -> None:
    """Reject updates that carry a field the catalog does not know."""
    unknown = [c for c in updates.columns if c not in known]
    if unknown:
        raise ValueError(f"unknown catalog fields: {unknown}")


def upsert(updates: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Catalog after all updates in ``seq`` order: per field the last value that is not null."""
    good = updates.filter(is_valid_video_id(F.col("video_id")))
    last = [
        F.max(F.when(F.col(f).isNotNull(), F.struct("seq", F.col(f).alias("v"))))["v"].alias(f) for f in fields
    ]
    return good.groupBy("video_id").agg(*last, F.count(F.lit(1)).alias("updates"))


def upsert_events(updates: DataFrame, order: Order, fields: Sequence[str]) -> DataFrame:
    """One event per accepted update, with the fields it changed."""
    known = {
        f"_{f}": ordered.highest(
            F.when(F.col(f).isNotNull(), F.struct("seq", F.col(f).alias("v"))), current=False
        )
        for f in fields
    }
    u = updates.filter(is_valid_video_id(F.col("video_id")))
    u = running(u, order, _n=ordered.position(), **known)
    changed = [
        F.when(F.col(f).isNotNull() & ~F.col(f).eqNullSafe(F.col(f"_{f}")["v"]), F.lit(f)) for f in fields
    ]
    kind = F.when(F.col("_n") == 1, "CATALOG_ENTRY_ADDED").otherwise("CATALOG_ENTRY_MERGED")
    names = F.filter(F.array(*changed), lambda c: c.isNotNull())
    return u.select("video_id", "seq", kind.alias("event"), F.array_join(names, ",").alias("changed"))


def remove(catalog: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalog without the requested ids, and one event per request saying whether it hit."""
    asked = requests.select("video_id").distinct()
    kept = catalog.join(asked, "video_id", "left_anti")
    present = catalog.select("video_id", F.lit(True).alias("removed"))
    events = asked.join(present, "video_id", "left").withColumn("removed", F.coalesce("removed", F.lit(False)))
    return kept, events


def status_bucket(state: Column, action: Column) -> Column:
    return (
        F.when(state.isNull(), "not-started")
        .when(state == "CANCELLED", "cancelled")
        .when(action == "TERMINAL", "done")
        .when(action == "STOP_AT_GATE", "gate-pending")
        .when(action == "BLOCKED", "blocked")
        .otherwise("in-progress")
    )


def enrich(catalog: DataFrame, actions: DataFrame) -> DataFrame:
    """Catalog entries with state, status and, only at a gate, the report to review."""
    c = catalog.join(actions.select("project_id", "current_state", "action"), "project_id", "left")
    c = c.withColumn("status", status_bucket(F.col("current_state"), F.col("action")))
    gate = F.regexp_extract("current_state", r"^(.*)_GATE$", 1)
    report = F.when(F.col("status") == "gate-pending", F.lower(F.replace(gate, F.lit("_"), F.lit("-"))))
    return c.withColumn("review_report", report)


def summarize(entries: DataFrame, wanted: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Tally over all entries, and the listing with only the ``wanted`` statuses."""
    tally = entries.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(
        F.count(F.lit(1)).alias("entries")
    )
    return tally, entries.filter(F.col("status").isin(list(wanted))) if wanted else entries


def merge_playlist(items: DataFrame, known: DataFrame) -> DataFrame:
    """Entries of each playlist's latest enumeration, once per video, as added or linked.

    ``items`` is ``(playlist_id, enumeration, ordinal, video_id)``; ``known`` the catalogued ids.
    """
    latest = items.groupBy("playlist_id").agg(F.max("enumeration").alias("enumeration"))
    now = items.join(latest, ["playlist_id", "enumeration"], "left_semi")
    now = now.groupBy("playlist_id", "video_id").agg(F.min("ordinal").alias("ordinal"))
    seen = known.select("video_id", F.lit("linked").alias("link")).distinct()
    return now.join(seen, "video_id", "left").withColumn("link", F.coalesce("link", F.lit("added")))


def playlist_view(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """A playlist's entries in its own order, with their catalog columns."""
    return items.join(catalog, "video_id", "left").orderBy("playlist_id", "ordinal")
