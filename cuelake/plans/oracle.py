"""The registered jobs once more, as plain SQL over the parquet tables."""

from __future__ import annotations

import re

from cuelake.sources.fixtures import CODES, STATES


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _codes(bits: str) -> str:
    items = ", ".join(f"CASE WHEN (({bits}) // {1 << i}) % 2 = 1 THEN '{c}' END" for i, c in enumerate(CODES))
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


# Derived tables by name; each may read the ones it names.
VIEWS: dict[str, str] = {
    "x1": """
SELECT project_id, language, cue_id, CAST(e - dur_ms AS BIGINT) AS start_ms, CAST(e AS BIGINT) AS end_ms,
       source_text, target_text, natural_ms, keep_source, confidence
FROM (SELECT *, SUM(gap_ms + dur_ms) OVER (PARTITION BY project_id ORDER BY cue_id) AS e FROM (
  SELECT conv_id AS project_id, turn AS cue_id, text AS source_text,
         CASE conv_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END AS language,
         CASE (conv_id * 3 + turn) % 9 WHEN 0 THEN '' WHEN 1 THEN text
              ELSE concat('T ', replace(text, 'th', 'TH')) END AS target_text,
         CAST(800 + (length(text) * 37) % 9000 AS BIGINT) AS dur_ms,
         CAST(((conv_id * 7 + turn * 13) % 6) * 300 AS BIGINT) AS gap_ms,
         CAST(500 + (length(text) * 53) % 9000 AS BIGINT) AS natural_ms,
         (conv_id + turn) % 11 = 0 AS keep_source,
         CASE WHEN (conv_id + turn) % 5 = 0 THEN -2.0::DOUBLE ELSE -0.2::DOUBLE END AS confidence
  FROM conversations))""",
    "x1b": """
SELECT * REPLACE (CASE WHEN sw THEN e0 ELSE s0 END AS start_ms, CASE WHEN sw THEN s0 ELSE e0 END AS end_ms)
FROM (SELECT *, end_ms AS e0, (project_id + cue_id) % 17 = 0 AS sw,
             CASE WHEN (project_id + cue_id) % 7 = 0 THEN start_ms - 1500 ELSE start_ms END AS s0 FROM x1)""",
    "dur": """
SELECT project_id, language, MAX(end_ms) + (project_id % 3 - 1) * 2500 AS source_ms
FROM x1 GROUP BY project_id, language""",
    "x2": r"""
SELECT *, CAST(COALESCE(SUM(span_ms) OVER (PARTITION BY project_id ORDER BY cue_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms
FROM (SELECT *, CAST(1000 + 60 * length(target_text) AS BIGINT) AS span_ms FROM (
  SELECT source AS project_id, doc_id AS cue_id, lang AS language,
         trim(regexp_replace(text, '\s+', ' ', 'g')) AS target_text FROM documents))""",
    "x3": "SELECT user_id AS project_id, event_id AS cue_id, event_type AS text FROM events",
    "x4": f"""
SELECT *, CASE WHEN seq % 10 = 0 THEN 'INGEST'
       ELSE LAG(to_state) OVER (PARTITION BY project_id ORDER BY seq) END AS from_state
FROM (SELECT user_id AS project_id, event_id AS seq, ts AS time, event_type AS actor,
             ({_list(STATES)})[event_id % 16 + 1] AS to_state FROM events)""",
    "x4s": """
SELECT project_id, idx, seq, start_ms AS req_start_ms, start_ms + (seq % 7) * 900 AS req_end_ms,
       seq % 4 = 0 AS exact, concat('seg', seq % 997) AS id
FROM (SELECT user_id AS project_id, event_id AS seq, (event_id % 50) * 1000 AS start_ms,
             ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx FROM events)""",
    "x5": """
SELECT l_suppkey AS project_id, l_returnflag AS type, l_linestatus AS language,
       ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity) AS seq,
       l_shipdate AS created_at, concat('sha256:', sha256(CAST(CAST(l_quantity AS INT) AS VARCHAR))) AS sha256
FROM lineitem""",
    "x6": """
SELECT o_orderkey AS approval_id, o_custkey % (SELECT COUNT(*) FROM supplier) AS project_id, o_orderpriority AS gate,
       [concat('sha256:', sha256(CAST(1 + o_orderkey % 50 AS VARCHAR))),
        concat('sha256:', sha256(CAST(1 + o_custkey % 50 AS VARCHAR)))] AS artifact_hashes,
       CASE WHEN o_orderstatus = 'P' THEN 'REJECTED' ELSE 'APPROVED' END AS decision, o_orderdate AS created_at
FROM orders""",
    "x7": r"""
SELECT concat('yt-', regexp_extract(url, '/([0-9]+)[^/0-9]*(?:[/?#].*)?$', 1)) AS video_id,
       page_id * 2 + u.k AS seq, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
       CASE WHEN u.k = 1 AND page_id % 3 = 0 THEN NULL ELSE concat('Title ', page_id) END AS title
FROM pages CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) u""",
    "x8": """
SELECT o_custkey AS ledger_id, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq,
       o_orderpriority AS provider, o_orderpriority < '4' AS guarded, CAST(o_totalprice AS DECIMAL(18,2)) AS cost_usd
FROM orders""",
    "x9": """
SELECT * FROM (VALUES ('en','th','TH','',true), ('en','on','ON','',false), ('fr','eau','EAU','eau',true),
  ('de','sch','SCH','',false), ('es','en','EN','',true)) t(language, term, rendering, alias, must_appear)""",
    "x10": """
SELECT o_orderkey AS project_id, 1000 * (o_custkey + 60) AS container_ms,
       1000 * (o_custkey + 60) - ((o_orderkey * 37) % 4001 - 2000) AS dub_ms, o_orderkey % 50 <> 0 AS has_audio
FROM orders""",
    "x11": """
SELECT l_orderkey AS video_id, CAST(l_linenumber % 6 AS BIGINT) AS stage, l_returnflag AS language,
       CASE CAST(MIN(l_quantity) AS INT) % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'done' ELSE 'failed' END AS status,
       CASE WHEN MIN(l_discount) = 0 THEN 0 ELSE MIN(l_partkey) END AS artifact_bytes
FROM lineitem GROUP BY l_orderkey, l_linenumber % 6, l_returnflag""",
    "x12": """
SELECT s_suppkey AS channel_id, CAST(s_nationkey AS BIGINT) AS language, s_suppkey % 3 = 0 AS is_default, s_suppkey AS ord
FROM supplier""",
    "x13": """
SELECT l_suppkey AS playlist_id, l_partkey AS video_id, l_linestatus AS enumeration,
       ROW_NUMBER() OVER (PARTITION BY l_suppkey, l_linestatus ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS ordinal
FROM lineitem""",
    "x14": f"""
SELECT c_custkey AS video_id, ({_list(CODES[:6])})[c_custkey % 6 + 1] AS source,
       {_codes('c_custkey % 128')} AS targets, {_codes('(c_custkey // 3) % 128')} AS dubs,
       {_codes('(c_custkey // 5) % 128')} AS captions
FROM customer""",
    # rendered timeline: audio back to back, waiting for a cue's own start
    "rt": """
SELECT *, rendered_start_ms + natural_ms AS rendered_end_ms FROM (
  SELECT *, CAST(before_ms + GREATEST(0, MAX(start_ms - before_ms) OVER (PARTITION BY project_id, language ORDER BY cue_id)) AS BIGINT) AS rendered_start_ms
  FROM (SELECT *, CAST(COALESCE(SUM(natural_ms) OVER (PARTITION BY project_id, language ORDER BY cue_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before_ms FROM x1))""",
    "hold": """
SELECT *, m - COALESCE(LAG(m) OVER (PARTITION BY project_id, language ORDER BY cue_id), 0) AS freeze_ms,
       CAST(0 AS BIGINT) AS trim_ms, m AS net_ms,
       LEAD(cue_id) OVER (PARTITION BY project_id, language ORDER BY cue_id) IS NULL AS last_cue
FROM (SELECT *, GREATEST(0, MAX(rendered_start_ms - start_ms) OVER (PARTITION BY project_id, language ORDER BY cue_id)) AS m FROM rt)""",
    "trimmed": """
SELECT *, GREATEST(d, 0) AS freeze_ms, GREATEST(-d, 0) AS trim_ms, rendered_start_ms - start_ms AS net_ms,
       LEAD(cue_id) OVER (PARTITION BY project_id, language ORDER BY cue_id) IS NULL AS last_cue
FROM (SELECT *, (rendered_start_ms - start_ms) - COALESCE(LAG(rendered_start_ms - start_ms)
        OVER (PARTITION BY project_id, language ORDER BY cue_id), 0) AS d FROM rt)""",
}


def _plan_view(view: str, trim: bool) -> str:
    tail = "rendered_end_ms - (source_ms + net_ms)"
    back = f"""
UNION ALL SELECT project_id, language, 'trim', cue_id, GREATEST(0, source_ms + ({tail})), -({tail}), 0, 1, true
FROM {view} JOIN dur USING (project_id, language) WHERE last_cue AND {tail} < 0""" if trim else ""
    return f"""
SELECT project_id, language, 'freeze' AS kind, cue_id, start_ms AS at_ms, freeze_ms AS amount_ms, natural_ms,
       GREATEST(1, end_ms - start_ms) AS slot_ms, false AS tail FROM {view} WHERE freeze_ms > 0
UNION ALL SELECT project_id, language, 'trim', cue_id, start_ms, trim_ms, natural_ms, GREATEST(1, end_ms - start_ms), false
FROM {view} WHERE trim_ms > 0
UNION ALL SELECT project_id, language, 'freeze', cue_id, source_ms, {tail}, 0, 1, true
FROM {view} JOIN dur USING (project_id, language) WHERE last_cue AND {tail} > 0{back}"""


VIEWS["plan_hold"] = _plan_view("hold", False)
VIEWS["plan_trim"] = _plan_view("trimmed", True)
VIEWS["spans"] = """
SELECT project_id, language, cue_id, p AS gap_start_ms, rendered_start_ms AS gap_end_ms, rendered_start_ms - p AS duration_ms
FROM (SELECT *, COALESCE(MAX(rendered_end_ms) OVER (PARTITION BY project_id, language ORDER BY cue_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM rt WHERE keep_source OR natural_ms > 1) a
WHERE rendered_start_ms - p >= 250 AND NOT EXISTS (
  SELECT 1 FROM rt k WHERE k.project_id = a.project_id AND k.language = a.language AND k.keep_source
    AND k.rendered_start_ms <= a.rendered_start_ms AND a.p <= k.rendered_end_ms)"""
VIEWS["hold_drift"] = """
SELECT *, ABS(cumulative_ms) > 150 AS over_tolerance FROM (
  SELECT *, CAST(rendered_start_ms - (start_ms + SUM(freeze_ms - trim_ms) OVER (PARTITION BY project_id, language ORDER BY cue_id)) AS BIGINT) AS cumulative_ms
  FROM hold)"""
VIEWS["trim_drift"] = """
SELECT *, ABS(cumulative_ms) > 150 AS over_tolerance FROM (
  SELECT *, CAST(rendered_start_ms - (start_ms + SUM(freeze_ms - trim_ms) OVER (PARTITION BY project_id, language ORDER BY cue_id)) AS BIGINT) AS cumulative_ms
  FROM trimmed)"""
VIEWS["reset_drift"] = """
SELECT *, ABS(cumulative_ms) > 150 AS over_tolerance FROM (
  SELECT *, CAST(SUM(drift_ms) OVER (PARTITION BY project_id, language, isl ORDER BY cue_id) AS BIGINT) AS cumulative_ms
  FROM (SELECT *, SUM(CASE WHEN reset_here THEN 1 ELSE 0 END) OVER (PARTITION BY project_id, language ORDER BY cue_id) AS isl
    FROM (SELECT *, rendered_end_ms - end_ms AS drift_ms,
                 COALESCE(start_ms - LAG(end_ms) OVER (PARTITION BY project_id, language ORDER BY cue_id) >= 700, true) AS reset_here FROM rt)))"""


def sql(body: str) -> str:
    """Prefix the derived tables that ``body`` reads, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, view in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(view)
                if name not in needed:
                    needed.append(name)

    visit(body)
    text = body.strip()
    recursive = text.startswith("+RECURSIVE")
    text = text.removeprefix("+RECURSIVE").strip()
    own = text.startswith("+WITH")
    text = text.removeprefix("+WITH").strip()
    views = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed)
    if not needed and not own:
        return text
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + views + ((", " if views else "") if own else " ") + text
