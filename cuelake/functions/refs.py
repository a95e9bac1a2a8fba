"""Video references: ids, canonical URLs, playlists, host lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INGEST_HOSTS = ["youtube.com", "youtu.be", "vimeo.com"]
PLAYLIST_ID = r"^(PL|UU)[A-Za-z0-9_-]{10,}$"
VIDEO_ID = r"^[A-Za-z0-9_-]{11}$"


def is_valid_video_id(video_id: Column) -> Column:
    return video_id.rlike(r"^[A-Za-z0-9][A-Za-z0-9_-]+$")


def canonical_url(ref: Column) -> Column:
    r = F.trim(ref)
    return (
        F.when(r.rlike(PLAYLIST_ID), F.concat(F.lit("https://www.youtube.com/playlist?list="), r))
        .when(r.rlike(VIDEO_ID), F.concat(F.lit("https://www.youtube.com/watch?v="), r))
        .otherwise(ref)
    )


def is_playlist(ref: Column) -> Column:
    r = F.trim(ref)
    return r.rlike(PLAYLIST_ID) | r.rlike(r"/playlist\?([^#]*&)?list=") | r.rlike(r"[?&]list=[^&#]")


def id_from_ref(ref: Column) -> Column:
    """The ``v`` query value, else the last path segment, else the text itself."""
    r = F.trim(ref)
    v = F.regexp_extract(r, r"[?&]v=([^&#]+)", 1)
    path = F.regexp_replace(F.regexp_replace(r, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    last = F.regexp_extract(path, r"([^/]+)/*$", 1)
    is_url = r.contains("/")
    return F.when(is_url & (v != ""), v).when(is_url & (last != ""), last).otherwise(r)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]+)", 1))


def host_allowed(url: Column, hosts: list[str] = INGEST_HOSTS) -> Column:
    h = host(url)
    allowed = F.lit(False)
    for name in hosts:
        allowed = allowed | (h == name) | h.endswith("." + name)
    return allowed
