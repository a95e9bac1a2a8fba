"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import divergence, langid, licences, linedup, neardup, packing, repeats, suffixtree, tiling, topk, toxicity, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]
LLM_QUERIES: dict[str, Query] = {}
LLM_ORACLE: dict[str, str] = {}


def job(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        LLM_QUERIES[name] = fn
        if oracle is not None:
            LLM_ORACLE[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@job(
    "op1_warc",
    """
    WITH hashed AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
    quint AS (
        SELECT page_id, body, hex,
            list_transform(range(8), lambda k: ('0x' || substr(hex, 1 + 5 * k::INT, 5))::INT) AS parts
        FROM hashed
    ),
    digests AS (
        SELECT page_id, body, list_aggregate(list_transform(range(32), lambda k: substr(
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + ((parts[1 + (k // 4)::INT] >> (15 - 5 * (k % 4)::INT)) & 31)::INT, 1)), 'string_agg', '') AS digest
        FROM quint
    ),
    largest AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS first_id FROM digests)
    SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, digest AS payload_digest,
        CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
    FROM largest
    """,
)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), least_bytes=0)
    return warc.read_archives(manifest, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@job("op2_string_tiling")
def op2_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the items: tiles of 4 words or more cover 0.6 of the item."""
    return tiling.leaks(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), seed_words=4, coverage=0.6
    ).select("doc_id", "item_id", "coverage", "tiles")


@job("op3_dart_minhash")
def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document: five-word shingles, weighted similarity of 0.8 or more."""
    return neardup.classes(table(spark, sf_dir, "documents"), least=0.8).select("doc_id", "class_id")


@job(
    "op4_line_dedup",
    """
    WITH lines AS (
        SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
    ),
    keyed AS (
        SELECT doc_id, parts, list_transform(parts, lambda x: translate(
            trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS keys
        FROM lines
    ),
    common AS (
        SELECT key FROM (SELECT unnest(list_distinct(keys)) AS key FROM keyed)
        WHERE length(key) >= 1 GROUP BY key HAVING count(*) >= 10
    ),
    placed AS (
        SELECT doc_id, parts, keys, unnest(range(1, len(parts) + 1)) AS k FROM keyed
    ),
    judged AS (
        SELECT doc_id, k, parts[k] AS line, common.key IS NOT NULL AS gone
        FROM placed LEFT JOIN common ON placed.keys[placed.k] = common.key
    )
    SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
    FROM judged GROUP BY doc_id
    """,
)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten or more documents share."""
    return linedup.line_report(table(spark, sf_dir, "documents"), min_docs=10, least_chars=1)


@job("op5_suffix_tree")
def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents, a tenth of them held out."""
    return suffixtree.scores(table(spark, sf_dir, "documents"), hold_out=10)


@job("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, a third of them held out of learning."""
    return toxicity.toxicity(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), divisor=3, held=1, bar=0.7
    )


@job("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), size=1024).select(
        "doc_id", "piece", "start", "length", F.col("ids_crc32"), "sequence_id", "offset"
    )


def _licence_sql() -> str:
    """The native form written out in SQL: same patterns, same known digests."""

    def form(text: str) -> str:
        out = f"regexp_replace(lower({text}), '{licences.COPYRIGHT_LINE}', ' ', 'g')"
        out = f"' ' || trim(regexp_replace({out}, '{licences.MARKS}', ' ', 'g')) || ' '"
        for variant, word in licences.SPELLINGS:
            out = f"replace({out}, ' {variant} ', ' {word} ')"
        return f"trim({out})"

    known = ", ".join(f"('{digest}', '{name}')" for digest, name in licences.known_digests())
    return f"""
    WITH known(digest, licence) AS (VALUES {known}),
    units AS (
        SELECT doc_id, TRUE AS whole, {form("text")} AS form FROM documents
        UNION ALL
        SELECT DISTINCT doc_id, FALSE, {form("line")}
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    ),
    hits AS (SELECT doc_id, whole, licence FROM units LEFT JOIN known ON sha256(form) = digest)
    SELECT doc_id, max(licence) FILTER (whole) AS text_licence,
        string_agg(DISTINCT licence, ',' ORDER BY licence) FILTER (NOT whole) AS line_licences
    FROM hits GROUP BY doc_id
    """


@job("op8_licences", _licence_sql())
def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that a document's entire text or one of its lines is a copy of."""
    return licences.find_licences(table(spark, sf_dir, "documents"))


@job(
    "op9_topk",
    """
    WITH usable AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    ),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id,
            list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
        FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
    )
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
    FROM scored QUALIFY rank <= 20
    """,
)
def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best neighbours of every twentieth vector."""
    return topk.nearest(table(spark, sf_dir, "embeddings"), k=20, scale=64, every=20)


@job("op10_language")
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, a quarter of them held out."""
    return langid.languages(table(spark, sf_dir, "documents"), divisor=4, held=2)


@job(
    "op11_divergence",
    """
    WITH docs AS (
        SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[A-Za-z\\x{80}-\\x{10FFFF}]+') AS terms
        FROM documents
    ),
    occ AS (SELECT row, lang, source, unnest(terms) AS term FROM docs),
    per_doc AS (SELECT row, lang, source, term, count(*) AS n FROM occ GROUP BY ALL),
    keep AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM per_doc GROUP BY lang, term HAVING count(*) >= 10),
    langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM keep GROUP BY lang),
    cnt AS (SELECT lang, source, term, sum(p.n)::HUGEINT AS n FROM per_doc p SEMI JOIN keep USING (lang, term) GROUP BY ALL),
    grp AS (SELECT DISTINCT lang, source FROM docs),
    tot AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM grp LEFT JOIN cnt USING (lang, source) GROUP BY ALL),
    shares AS (
        SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
            1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (t.total + 2 * l.v) AS p,
            1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v) AS q
        FROM tot t JOIN langs l USING (lang) JOIN keep k USING (lang)
        LEFT JOIN cnt c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
    ),
    pair_sums AS (
        SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::HUGEINT AS value
        FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    ),
    pairs AS (
        SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
        FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    ),
    found AS (
        SELECT lang, source, 'pair' AS part, item, value FROM pairs
        UNION ALL
        SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM shares WHERE n > 0 AND p > q
    )
    SELECT lang, source, part, item, value::BIGINT AS value,
        row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
    FROM found QUALIFY part = 'pair' OR rank <= 10
    """,
)
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every source's wording differs from its language's other sources, and by which terms."""
    return divergence.divergence(table(spark, sf_dir, "documents"), min_docs=10, top=10)


@job("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every usable vector, fitted on the distinct ones."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"), scale=64, offset=1_000_000, components=16)


@job("op13_repeats")
def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 35 words or more that stand anywhere else."""
    return repeats.repeat_report(table(spark, sf_dir, "documents"), window=35)
