"""Jobs over catalog updates, playlists, video references, language requests and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.functions import refs
from cuelake.functions import text as tx
from cuelake.functions.timecode import parse_timecode
from cuelake.operators import catalog, config, intervals, languages
from cuelake.operators.ordered import arrange
from cuelake.plans.gate_jobs import GATE_SQL, gates
from cuelake.plans.registry import job
from cuelake.sources import fixtures as fx

VALID = "regexp_matches(video_id, '^[A-Za-z0-9][A-Za-z0-9_-]+$')"


def _catalog(spark, sf):
    u = fx.catalog_updates(spark, sf)
    catalog.check_fields(u, ["video_id", "seq", "url", "host", "title"])
    return catalog.upsert(u, ["url", "host", "title"])


CATALOG = f"""
+WITH cat AS (SELECT video_id, arg_max(url, seq) AS url, arg_max(host, seq) AS host, arg_max(title, seq) FILTER (title IS NOT NULL) AS title, COUNT(*) AS updates
  FROM x7 WHERE {VALID} GROUP BY video_id)"""


@job("catalog_upsert", CATALOG + " SELECT * FROM cat")
def catalog_upsert(spark, sf):
    return _catalog(spark, sf)


@job("catalog_events", f"""
+WITH u AS (SELECT *, ROW_NUMBER() OVER w AS n, LAG(url) OVER w AS pu, LAST_VALUE(title IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pt
  FROM x7 WHERE {VALID} WINDOW w AS (PARTITION BY video_id ORDER BY seq))
SELECT video_id, seq, CASE WHEN n = 1 THEN 'CATALOG_ENTRY_ADDED' ELSE 'CATALOG_ENTRY_MERGED' END AS event,
  concat_ws(',', CASE WHEN url IS DISTINCT FROM pu THEN 'url' END, CASE WHEN title IS NOT NULL AND title IS DISTINCT FROM pt THEN 'title' END) AS changed FROM u""")
def catalog_events(spark, sf):
    u, order = arrange(fx.catalog_updates(spark, sf), ("video_id",), ("seq",))
    return catalog.upsert_events(u, order, ["url", "title"])


@job("catalog_remove", CATALOG + """
, r AS (SELECT DISTINCT concat('yt-', page_id * 3) AS video_id FROM pages)
SELECT video_id, 'kept' AS outcome FROM cat WHERE video_id NOT IN (SELECT video_id FROM r)
UNION ALL SELECT video_id, CASE WHEN video_id IN (SELECT video_id FROM cat) THEN 'removed' ELSE 'not-found' END FROM r""")
def catalog_remove(spark, sf):
    asked = fx.table(spark, sf, "pages").select(F.concat(F.lit("yt-"), (F.col("page_id") * 3).cast("string")).alias("video_id"))
    kept, events = catalog.remove(_catalog(spark, sf), asked)
    outcome = F.when(F.col("removed"), "removed").otherwise("not-found")
    return kept.select("video_id", F.lit("kept").alias("outcome")).unionByName(
        events.select("video_id", outcome.alias("outcome"))
    )


STATUS = """CASE WHEN current_state IS NULL THEN 'not-started' WHEN action = 'TERMINAL' THEN 'done' WHEN action = 'STOP_AT_GATE' THEN 'gate-pending' WHEN action = 'BLOCKED' THEN 'blocked' ELSE 'in-progress' END"""
ENRICHED = GATE_SQL + f""",
cat AS (SELECT video_id, arg_max(title, seq) FILTER (title IS NOT NULL) AS title, TRY_CAST(substr(video_id, 4) AS BIGINT) AS project_id FROM x7 WHERE {VALID} GROUP BY video_id),
en AS (SELECT video_id, COALESCE(title, '') AS title, COALESCE(current_state, '') AS current_state, {STATUS} AS status,
  CASE WHEN action = 'STOP_AT_GATE' AND current_state LIKE '%_GATE' THEN replace(lower(replace(current_state, '_GATE', '')), '_', '-') ELSE '' END AS review_report
  FROM cat LEFT JOIN ac ON ac.project_id = cat.project_id)"""


def _enriched(spark, sf):
    c = _catalog(spark, sf).withColumn("project_id", F.regexp_extract("video_id", r"^yt-(\d+)$", 1).try_cast("long"))
    return catalog.enrich(c, gates(spark, sf))


@job("catalog_enriched", ENRICHED + " SELECT * FROM en")
def catalog_enriched(spark, sf):
    names = ["title", "current_state", "status", "review_report"]
    return _enriched(spark, sf).select("video_id", *names).fillna("", names)


@job("status_summary", ENRICHED + " SELECT status, COUNT(*) AS entries FROM en GROUP BY status")
def status_summary(spark, sf):
    return catalog.summarize(_enriched(spark, sf))[0]


MADE = """CASE k WHEN 0 THEN url WHEN 1 THEN 'https://www.youtube.com/watch?v=' || lpad(CAST(page_id AS VARCHAR), 11, 'a') || '&list=PL1'
  WHEN 2 THEN lpad(CAST(page_id AS VARCHAR), 11, 'A') WHEN 3 THEN 'PL' || lpad(CAST(page_id AS VARCHAR), 12, 'x') ELSE 'https://youtu.be/' || lpad(CAST(page_id AS VARCHAR), 11, 'b') || '/' END"""


@job("video_refs", f"""
+WITH p AS (SELECT page_id, url, unnest([0, 1, 2, 3, 4]) AS k FROM pages), r AS (SELECT page_id, k, {MADE} AS ref FROM p),
i AS (SELECT *, CASE k WHEN 1 THEN lpad(CAST(page_id AS VARCHAR), 11, 'a') WHEN 4 THEN lpad(CAST(page_id AS VARCHAR), 11, 'b')
    WHEN 0 THEN regexp_extract(regexp_replace(ref, '[?#].*$', ''), '([^/]+)/*$', 1) ELSE ref END AS video_id FROM r)
SELECT page_id, ref, video_id, regexp_matches(video_id, '^[A-Za-z0-9][A-Za-z0-9_-]+$') AS valid_id,
  CASE k WHEN 2 THEN 'https://www.youtube.com/watch?v=' || ref WHEN 3 THEN 'https://www.youtube.com/playlist?list=' || ref ELSE ref END AS canonical,
  k IN (1, 3) AS playlist, k IN (1, 4) AS allowed FROM i""")
def video_refs(spark, sf):
    """Every page's url as it stands, and one reference of each other kind per page."""
    n = F.col("page_id").cast("string")
    kinds = F.array(
        F.col("url"), F.concat(F.lit("https://www.youtube.com/watch?v="), F.lpad(n, 11, "a"), F.lit("&list=PL1")),
        F.lpad(n, 11, "A"), F.concat(F.lit("PL"), F.lpad(n, 12, "x")), F.concat(F.lit("https://youtu.be/"), F.lpad(n, 11, "b"), F.lit("/")),
    )
    r = fx.table(spark, sf, "pages").select("page_id", F.explode(kinds).alias("ref"))
    r = r.withColumn("video_id", refs.id_from_ref(F.col("ref")))
    return r.select(
        "page_id", "ref", "video_id", refs.is_valid_video_id(F.col("video_id")).alias("valid_id"),
        refs.canonical_url(F.col("ref")).alias("canonical"), refs.is_playlist(F.col("ref")).alias("playlist"),
        refs.host_allowed(F.col("ref")).alias("allowed"),
    )


# --- playlists ------------------------------------------------------------------------------------

MERGED = """
+WITH m AS (SELECT playlist_id, video_id, MIN(ordinal) AS ordinal, CASE WHEN video_id IN (SELECT video_id FROM x13 WHERE enumeration <> 'O' AND video_id % 3 <> 0) THEN 'linked' ELSE 'added' END AS link
  FROM (SELECT *, MAX(enumeration) OVER (PARTITION BY playlist_id) AS last FROM x13) WHERE enumeration = last GROUP BY playlist_id, video_id)"""


def _merged(spark, sf):
    items, _ = fx.playlist_enumerations(spark, sf)
    known = items.filter((F.col("enumeration") != "O") & (F.col("video_id") % 3 != 0)).select("video_id")
    return catalog.merge_playlist(items, known)


@job("playlist_merge", MERGED + " SELECT * FROM m")
def playlist_merge(spark, sf):
    return _merged(spark, sf)


@job("playlist_view", MERGED + """
SELECT playlist_id, ordinal, video_id, p_name AS title, COALESCE(p_type, '') AS kind FROM m LEFT JOIN part ON p_partkey = video_id""")
def playlist_view(spark, sf):
    parts = fx.table(spark, sf, "part").select(
        F.col("p_partkey").alias("video_id"), F.col("p_name").alias("title"), F.coalesce("p_type", F.lit("")).alias("kind")
    )
    return catalog.playlist_view(_merged(spark, sf), parts).select("playlist_id", "ordinal", "video_id", "title", "kind")


# --- languages ------------------------------------------------------------------------------------

KNOWN = ["en", "fa", "ar", "es", "ur", "ru"]
PLAN = """
+WITH u AS (SELECT *, list_filter(list_distinct(list_concat(targets, dubs, captions)), lambda c: c = 'zz') AS unk,
    list_filter(targets, lambda c: c <> source) AS translate FROM x14),
p AS (SELECT *, list_concat([source], translate) AS produced FROM u),
q AS (SELECT *, list_filter(produced, lambda c: list_contains(captions, c)) AS matched, list_filter(dubs, lambda c: list_contains(produced, c)) AS dl FROM p)"""


@job("language_plan", PLAN + """
SELECT video_id, array_to_string(translate, ',') AS translate, array_to_string(CASE WHEN len(matched) > 0 THEN matched ELSE produced END, ',') AS caption_langs,
  array_to_string(dl, ',') AS dub_langs,
  concat_ws(';', CASE WHEN list_contains(targets, source) THEN 'self-translation:' || source END,
    NULLIF(array_to_string(list_transform(list_filter(captions, lambda c: NOT list_contains(produced, c)), lambda c: 'caption-ignored:' || c), ';'), ''),
    CASE WHEN len(captions) > 0 AND len(matched) = 0 THEN 'captions-fall-back:all' END,
    NULLIF(array_to_string(list_transform(list_filter(dubs, lambda c: NOT list_contains(produced, c)), lambda c: 'dub-ignored:' || c), ';'), '')) AS notes,
  CASE WHEN len(unk) > 0 THEN 'unknown-code' ELSE '' END AS error FROM q""")
def language_plan(spark, sf):
    p = languages.language_plan(fx.language_requests(spark, sf), KNOWN)
    joined = [F.array_join(c, ",").alias(c) for c in ("translate", "caption_langs", "dub_langs")]
    return p.select("video_id", *joined, F.array_join("notes", ";").alias("notes"), F.coalesce("error", F.lit("")).alias("error"))


@job("voice_plan", PLAN + """
, d AS (SELECT video_id, unnest(dl) AS language FROM q),
v AS (SELECT *, CASE (video_id + ascii(language)) % 5 WHEN 0 THEN 'piper' WHEN 1 THEN 'xtts' END AS provider,
   CASE (video_id + length(language) + ascii(language)) % 4 WHEN 0 THEN true WHEN 1 THEN false END AS vc, video_id % 2 = 0 AS dflt FROM d),
e AS (SELECT *, CASE WHEN language IN ('fa', 'ur') AND provider = 'xtts' THEN 'piper-only-provider' WHEN language IN ('fa', 'ur') AND vc THEN 'piper-only-clone' ELSE '' END AS error FROM v)
SELECT video_id, language, error, CASE WHEN error <> '' THEN false WHEN provider = 'piper' THEN false WHEN vc IS NOT NULL THEN vc ELSE dflt AND language IN ('en', 'ar', 'es') END AS clone FROM e""")
def voice_plan(spark, sf):
    p = languages.language_plan(fx.language_requests(spark, sf), KNOWN)
    d = p.select("video_id", F.explode("dub_langs").alias("language"))
    v, code = F.col("video_id"), F.ascii("language")
    mark, choice = (v + code) % 5, (v + F.length("language") + code) % 4
    d = d.withColumns({
        "provider": F.when(mark == 0, "piper").when(mark == 1, "xtts"),
        "voice_clone": F.when(choice == 0, True).when(choice == 1, False),
        "clone_default": v % 2 == 0,
    })
    out = languages.voice_plan(d, ["en", "ar", "es"])
    return out.select("video_id", "language", F.coalesce("error", F.lit("")).alias("error"), "clone")


@job("add_languages", """
+WITH a AS (SELECT video_id, targets AS present, list_filter(captions, lambda c: NOT list_contains(targets, c)) AS added, CASE WHEN video_id % 3 <> 0 THEN dubs END AS wd FROM x14),
d AS (SELECT *, CASE WHEN wd IS NULL THEN added ELSE wd END AS dubbed FROM a)
SELECT video_id, array_to_string(added, ',') AS added, array_to_string(dubbed, ',') AS dubbed, array_to_string(list_concat(present, added), ',') AS languages,
  CASE WHEN len(list_filter(dubbed, lambda c: NOT list_contains(added, c))) > 0 THEN 'dub-not-added' ELSE '' END AS error FROM d""")
def add_languages(spark, sf):
    r = fx.language_requests(spark, sf).select(
        "video_id", F.col("targets").alias("present"), F.col("captions").alias("wanted"),
        F.when(F.col("video_id") % 3 != 0, F.col("dubs")).alias("wanted_dubs"),
    )
    a = languages.add_languages(r)
    joined = [F.array_join(c, ",").alias(c) for c in ("added", "dubbed", "languages")]
    return a.select("video_id", *joined, F.coalesce("error", F.lit("")).alias("error"))


# every name and code that is known, and some that aren't; written plain, in capitals or between blanks
NAMED = [*tx.LANGUAGE_NAMES, *tx.ALIASES, *fx.CODES, "zz", "klingon", "x1", ""]
NAMED_SQL = "[" + ", ".join(f"'{n}'" for n in NAMED) + "]"
KNOWN_SQL = ", ".join(f"('{a}', '{b}')" for a, b in tx.LANGUAGE_NAMES.items())
ALIAS_SQL = ", ".join(f"('{a}', '{b}')" for a, b in tx.ALIASES.items())


@job("normalized_languages", f"""
+WITH c AS (SELECT c_custkey AS video_id, ({NAMED_SQL})[c_custkey % {len(NAMED)} + 1] AS plain, c_custkey // {len(NAMED)} % 3 AS style FROM customer),
a AS (SELECT video_id, CASE style WHEN 0 THEN plain WHEN 1 THEN upper(plain) ELSE ' ' || plain || ' ' END AS name, COALESCE(code, plain) AS canonical
  FROM c LEFT JOIN (VALUES {ALIAS_SQL}) alias(alias, code) ON alias = plain)
SELECT video_id, name, COALESCE(code, CASE WHEN regexp_matches(canonical, '^[a-z]{{2,3}}$') THEN canonical END, '') AS language, canonical
FROM a LEFT JOIN (VALUES {KNOWN_SQL}) known(known, code) ON known = canonical""")
def normalized_languages(spark, sf):
    k = F.col("c_custkey")
    plain = F.element_at(F.array(*[F.lit(n) for n in NAMED]), (k % len(NAMED) + 1).cast("int"))
    style = F.floor(k / len(NAMED)) % 3
    name = F.when(style == 0, plain).when(style == 1, F.upper(plain)).otherwise(F.concat(F.lit(" "), plain, F.lit(" ")))
    c = fx.table(spark, sf, "customer").select(k.alias("video_id"), name.alias("name"))
    canonical = tx.canonical_language(F.col("name"))
    return c.select(
        "video_id", "name", F.coalesce(tx.normalize_language(canonical), F.lit("")).alias("language"), canonical.alias("canonical"),
    )


DEFAULTS = {
    "sourceLang": "fa", "targetLangs": ["en", "ar"], "clone": {"enabled_by_default": True, "seconds": 25},
    "playback_speed": {"en": 1.0, "fr": 1.1}, "asr": {"provider": "local", "model": "large"},
}
CONFIG = [(k, v) for k, v in sorted(languages.flatten(DEFAULTS).items())]
CONFIG_SQL = ", ".join(f"('{k}', '{v}')" for k, v in CONFIG)


@job("effective_config", f"""
+WITH o AS (SELECT c_custkey AS video_id, 'sourceLang' AS path, '"' || lower(substr(c_mktsegment, 1, 2)) || '"' AS value FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT c_custkey, 'playback_speed.en', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey, 'clone', 'null' FROM customer WHERE c_custkey % 5 = 0
  UNION ALL SELECT c_custkey, 'targetLangs.extra', '1' FROM customer WHERE c_custkey % 7 = 0
  UNION ALL SELECT c_custkey, 'id', CAST(c_custkey AS VARCHAR) FROM customer),
d AS (SELECT c_custkey AS video_id, path, value FROM customer CROSS JOIN (VALUES {CONFIG_SQL}) v(path, value))
SELECT * FROM o UNION ALL SELECT d.* FROM d WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.video_id = d.video_id
  AND (o.path = d.path OR starts_with(d.path, o.path || '.') OR starts_with(o.path, d.path || '.')))""")
def effective_config(spark, sf):
    k = F.col("c_custkey")
    pair = lambda cond, path, value: F.when(cond, F.struct(F.lit(path).alias("key"), value.alias("value")))
    pairs = F.array(
        pair(k % 2 == 0, "sourceLang", F.concat(F.lit('"'), F.lower(F.substring("c_mktsegment", 1, 2)), F.lit('"'))),
        pair(k % 3 == 0, "playback_speed.en", F.col("c_nationkey").cast("string")),
        pair(k % 5 == 0, "clone", F.lit("null")),
        pair(k % 7 == 0, "targetLangs.extra", F.lit("1")),
        pair(F.lit(True), "id", k.cast("string")),
    )
    e = fx.table(spark, sf, "customer").select(
        k.alias("video_id"), F.map_from_entries(F.filter(pairs, lambda p: p.isNotNull())).alias("overrides")
    )
    return languages.effective_config(e, DEFAULTS)


@job("lang_maps", """
+WITH m AS (SELECT video_id, array_to_string(list_transform(targets, lambda c: c || CASE WHEN video_id % 11 = 0 AND c = 'en' THEN '' ELSE '=' || length(c) || video_id % 9 END), ',') AS spec FROM x14)
SELECT video_id, spec, spec <> '' AND NOT (video_id % 11 = 0 AND (spec = 'en' OR spec LIKE 'en,%')) AS valid FROM m""")
def lang_maps(spark, sf):
    r = fx.language_requests(spark, sf)
    bad = F.col("video_id") % 11 == 0
    item = lambda c: F.concat(
        c, F.when(bad & (c == "en"), "").otherwise(
            F.concat(F.lit("="), F.length(c).cast("string"), (F.col("video_id") % 9).cast("string"))
        )
    )
    spec = F.array_join(F.transform("targets", item), ",")
    r = r.select("video_id", spec.alias("spec"))
    return r.withColumn("valid", tx.lang_map(F.col("spec")).isNotNull())


@job("selection_hash", """
+WITH w AS (SELECT project_id, idx, 'sha256:' || sha256('{"end_ms":' || req_end_ms || ',"id":"' || id || '","start_ms":' || req_start_ms || '}') AS h FROM x4s),
r AS (SELECT project_id, COUNT(*) AS windows, string_agg(h, ',' ORDER BY idx) AS hs FROM w GROUP BY project_id)
SELECT project_id, windows, 'sha256:' || sha256('{"join_clips":' || CASE WHEN project_id % 2 = 0 THEN 'true' ELSE 'false' END || ',"windows":"sha256:' || sha256(hs) || '"}') AS selection_hash FROM r""")
def selection_hash(spark, sf):
    s = fx.selections(spark, sf)[0].withColumns({
        "start_ms": parse_timecode(F.col("start")), "end_ms": parse_timecode(F.col("end"))
    })
    return intervals.selection_hash(s, F.col("project_id") % 2 == 0)


OVERRIDES = [
    '{"playback.speed": {"en": %s, "fr": {"max": 3}}}', '{"langs": ["fa", {"code": "%s"}], "region": {}}', '{"sourceLang": {"code": "x%s"}}',
    '{"region": "none", "notes": {"a": {"b": "c%s"}}}', '{"asr": {}, "langs": {}, "n": %s}',
]
CONFIG_LAYERS = [
    '{"sourceLang": "fa", "region": {"name": "%s", "at": {"key": 1, "keys": [1, 2]}}, "playback.speed": {"en": 1, "fr": {"min": 1, "max": 2}}, "langs": ["en", "ar"], "notes": {}}',
    '{"region": {"at": {"key": "%s"}}, "asr": {"provider": "local"}}',
]
_SPLIT = [o.split("%s") for o in (*OVERRIDES, *CONFIG_LAYERS)]


@job("merged_config", f"""
+WITH p AS (SELECT n_nationkey AS profile, json_merge_patch('{_SPLIT[5][0]}' || n_name || '{_SPLIT[5][1]}',
    CASE WHEN n_nationkey % 2 = 0 THEN '{_SPLIT[6][0]}' || n_name || '{_SPLIT[6][1]}' ELSE '{{}}' END) AS config FROM nation),
m AS (SELECT c_custkey AS video_id, json_merge_patch(json_merge_patch(config, CASE c_custkey % 6 {" ".join(
    f"WHEN {k} THEN '{a}' || c_custkey || '{b}'" for k, (a, b) in enumerate(_SPLIT[:5]))} ELSE '{{}}' END),
  '{{"id": "c' || c_custkey || '"' || CASE WHEN c_custkey % 2 = 0 THEN ', "url": "https://v/' || c_custkey || '"' ELSE '' END || '}}') AS j
  FROM customer JOIN p ON profile = c_nationkey)
SELECT video_id, t.fullkey AS path, t.value::VARCHAR AS value FROM m, json_tree(j) t
WHERE NOT contains(t.fullkey, '[') AND (t.type <> 'OBJECT' OR t.value::VARCHAR = '{{}}')""")
def merged_config(spark, sf):
    """Two layers of defaults per nation under each customer's own settings, all read as JSON."""
    k = F.col("c_custkey").cast("string")
    own = F.lit(None).cast("string")
    for n, (a, b) in enumerate(_SPLIT[:5]):
        own = F.when(F.col("c_custkey") % 6 == n, F.concat(F.lit(f', "overrides": {a}'), k, F.lit(b))).otherwise(own)
    url = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('"https://v/'), k, F.lit('"'))).otherwise('""')
    entry = F.concat(F.lit('{"id": "c'), k, F.lit('", "url": '), url, F.coalesce(own, F.lit("")), F.lit("}"))
    entries = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("video_id"), F.col("c_nationkey").alias("profile"), entry.alias("entry"))
    nation = fx.table(spark, sf, "nation")
    layers = [
        nation.filter((F.col("n_nationkey") % 2 == 0) | F.lit(n == 0)).select(
            F.col("n_nationkey").alias("profile"), F.lit(n).alias("layer"), F.concat(F.lit(a), "n_name", F.lit(b)).alias("config")
        ) for n, (a, b) in enumerate(_SPLIT[5:])
    ]
    out = config.effective(entries, layers[0].unionByName(layers[1]))
    return out.select("video_id", config.json_path("path").alias("path"), "value")
