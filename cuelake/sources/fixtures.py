"""Cue, event, artifact and catalog tables derived from the test data's parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.functions.text import squeeze
from cuelake.operators import ordered
from cuelake.operators.ledger import FOLD_ROWS
from cuelake.operators.ordered import Order, arrange, running

# Language codes of the requests, one of them unknown
CODES = ["en", "fa", "ar", "es", "ur", "ru", "zz"]
CUE_KEYS = ("project_id", "language")
#: Whole documents that may lie in one task: fewer than of narrow rows.
TEXTS_PER_BLOCK = 50_000
# The states of a project's life, in their order
STATES = [
    "INGEST", "LANGUAGE_ID", "TRANSCRIPTION", "TRANSCRIPT_QA_GATE", "SEGMENT_RESOLUTION",
    "TRANSLATION", "TRANSLATION_QA_GATE", "CAPTION_TIMING", "CAPTION_VALIDATION", "DUBBING",
    "AUDIO_SYNC_ADJUST", "AUDIO_QA_GATE", "VIDEO_MUX", "FINAL_QA_GATE", "PACKAGE",
    "READY_FOR_REVIEW",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def cues(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Order]:
    """Cues with source and target text, timing and measured audio lengths, one project per talk."""
    c = table(spark, sf_dir, "conversations")
    conv, turn, text = F.col("conv_id"), F.col("turn"), F.col("text")
    n = F.length(text).cast("long")
    mark = (conv * 3 + turn) % 9
    target = F.when(mark == 0, "").when(mark == 1, text).otherwise(
        F.concat(F.lit("T "), F.replace(text, F.lit("th"), F.lit("TH")))
    )
    base = c.select(
        conv.alias("project_id"),
        _pick(conv % 4, ["en", "fr", "de", "es"]).alias("language"),
        turn.alias("cue_id"),
        text.alias("source_text"),
        target.alias("target_text"),
        (800 + (n * 37) % 9000).alias("dur_ms"),
        (((conv * 7 + turn * 13) % 6) * 300).alias("gap_ms"),
        (500 + (n * 53) % 9000).alias("natural_ms"),
        ((conv + turn) % 11 == 0).alias("keep_source"),
        F.when((conv + turn) % 5 == 0, -2.0).otherwise(-0.2).alias("confidence"),
    )
    base, order = arrange(base, CUE_KEYS, ("cue_id",), dense=True)
    timed = running(base, order, end_ms=ordered.total(F.col("gap_ms") + F.col("dur_ms")))
    out = timed.select(
        *CUE_KEYS, "cue_id", *order.block, (F.col("end_ms") - F.col("dur_ms")).alias("start_ms"),
        "end_ms", "source_text", "target_text", "natural_ms", "keep_source", "confidence",
    )
    return out, order


def untidy_cues(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Order]:
    c, order = cues(spark, sf_dir)
    return untidy(c), order


def untidy(c: DataFrame) -> DataFrame:
    """The cues with some overlapping and some backwards ones."""
    mark = F.col("project_id") + F.col("cue_id")
    early = F.when(mark % 7 == 0, F.col("start_ms") - 1500).otherwise(F.col("start_ms"))
    swap = mark % 17 == 0
    c = c.withColumns({"_s": early, "_e": F.col("end_ms")}).withColumns({
        "start_ms": F.when(swap, F.col("_e")).otherwise(F.col("_s")),
        "end_ms": F.when(swap, F.col("_s")).otherwise(F.col("_e")),
    })
    return c.drop("_s", "_e")


def durations(cue_rows: DataFrame) -> DataFrame:
    """Source length per project, off by up to 2.5 s either way from the last cue."""
    return cue_rows.groupBy(*CUE_KEYS).agg(F.max("end_ms").alias("_m")).select(
        *CUE_KEYS, (F.col("_m") + (F.col("project_id") % 3 - 1) * 2500).alias("source_ms")
    )


def long_cues(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Order]:
    d = table(spark, sf_dir, "documents").select(
        F.col("source").alias("project_id"), F.col("doc_id").alias("cue_id"),
        F.col("lang").alias("language"), squeeze(F.col("text")).alias("target_text"),
    )
    d = d.withColumn("span_ms", (1000 + 60 * F.length("target_text")).cast("long"))
    d, order = arrange(d, ("project_id",), ("cue_id",), rows_per_block=TEXTS_PER_BLOCK)
    return running(d, order, start_ms=ordered.total(F.col("span_ms"), current=False)), order


def sequences(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Order]:
    """Short texts in order, with repeats."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("project_id"), F.col("event_id").alias("cue_id"),
        F.col("event_type").alias("text"),
    )
    return arrange(e, ("project_id",), ("cue_id",))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log without ``from_state``: no order needed."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("project_id"), F.col("event_id").alias("seq"),
        F.col("ts").alias("time"), F.col("event_type").alias("actor"),
        _pick(F.col("event_id") % 16, STATES).alias("to_state"),
    )


def event_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Order]:
    e, order = arrange(event_rows(spark, sf_dir), ("project_id",), ("seq",))
    e = running(e, order, _prev=ordered.previous(F.col("to_state")))
    state = F.when(F.col("seq") % 10 == 0, F.lit("INGEST")).otherwise(F.col("_prev"))
    return e.withColumn("from_state", state).drop("_prev"), order


def selections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Order]:
    """Clip windows per project in list order, as timecodes."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("project_id"), F.col("event_id").alias("seq")
    )
    e, order = arrange(e, ("project_id",), ("seq",))
    e = running(e, order, _rn=ordered.position())
    start = (F.col("seq") % 50) * 1000
    end = start + (F.col("seq") % 7) * 900
    out = e.select(
        "project_id", (F.col("_rn") - 1).alias("idx"), "seq", *order.block,
        _mmss(start).alias("start"), _mmss(end).alias("end"),
        (F.col("seq") % 4 == 0).alias("exact"),
        F.concat(F.lit("seg"), (F.col("seq") % 997).cast("string")).alias("id"),
    )
    return out, Order(("project_id",), ("idx",), order.block)


def _mmss(ms: Column) -> Column:
    return F.format_string(
        "%02d:%02d.%03d", F.floor(ms / 60000), F.floor(ms / 1000) % 60, ms % 1000
    )


def sha_id(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value.cast("int").cast("string"), 256))


def artifacts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Order]:
    """Artifact registrations in order, one row per registration."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("project_id"), F.col("l_returnflag").alias("type"),
        F.col("l_linestatus").alias("language"), F.col("l_shipdate").alias("created_at"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
    )
    by = ("created_at", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    blocks = [F.unix_micros(F.col("created_at").cast("timestamp")), F.floor(F.col("l_orderkey") / 1_000_000)]
    li, order = arrange(li, ("project_id",), by, blocks=blocks)
    li = running(li, order, seq=ordered.position())
    out = li.select(
        "project_id", "type", "language", "seq", "created_at", *order.block,
        sha_id(F.col("l_quantity")).alias("sha256"),
    )
    return out, Order(("project_id",), ("seq",), order.block)


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_projects = F.lit(table(spark, sf_dir, "supplier").count())
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("approval_id"),
        (F.col("o_custkey") % n_projects).alias("project_id"),
        F.col("o_orderpriority").alias("gate"),
        F.array(sha_id(1 + F.col("o_orderkey") % 50), sha_id(1 + F.col("o_custkey") % 50)).alias("artifact_hashes"),
        F.when(F.col("o_orderstatus") == "P", "REJECTED").otherwise("APPROVED").alias("decision"),
        F.col("o_orderdate").alias("created_at"),
    )


def catalog_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    p = p.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    return p.select(
        F.concat(F.lit("yt-"), F.regexp_extract("url", r"/([0-9]+)[^/0-9]*(?:[/?#].*)?$", 1)).alias("video_id"),
        (F.col("page_id") * 2 + F.col("k")).alias("seq"),
        "url",
        F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"),
        F.when((F.col("k") == 1) & (F.col("page_id") % 3 == 0), None)
        .otherwise(F.concat(F.lit("Title "), F.col("page_id").cast("string"))).alias("title"),
    )


def ledger_calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Order]:
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("ledger_id"), "o_orderdate", "o_orderkey",
        F.col("o_orderpriority").alias("provider"),
        (F.col("o_orderpriority") < "4").alias("guarded"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("cost_usd"),
    )
    o, order = arrange(
        o, ("ledger_id",), ("o_orderdate", "o_orderkey"),
        blocks=[F.unix_micros(F.col("o_orderdate").cast("timestamp")), F.floor(F.col("o_orderkey") / 1_000_000)],
        rows_per_block=FOLD_ROWS,
    )
    o = running(o, order, seq=ordered.position())
    out = o.select("ledger_id", "seq", "provider", "guarded", "cost_usd", *order.block)
    return out, Order(("ledger_id",), ("seq",), order.block)


def media_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    container = 1000 * (F.col("o_custkey") + 60)
    return o.select(
        F.col("o_orderkey").alias("project_id"), container.alias("container_ms"),
        (container - ((F.col("o_orderkey") * 37) % 4001 - 2000)).alias("dub_ms"),
        (F.col("o_orderkey") % 50 != 0).alias("has_audio"),
    )


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy(
        F.col("l_orderkey").alias("video_id"), (F.col("l_linenumber") % 6).cast("long").alias("stage"),
        F.col("l_returnflag").alias("language"),
    ).agg(
        F.min("l_quantity").alias("_q"), F.min("l_discount").alias("_d"), F.min("l_partkey").alias("_p")
    )
    return g.select(
        "video_id", "stage", "language",
        _pick(F.col("_q").cast("int") % 4, ["pending", "running", "done", "failed"]).alias("status"),
        F.when(F.col("_d") == 0, F.lit(0)).otherwise(F.col("_p")).cast("long").alias("artifact_bytes"),
    )


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("channel_id"), F.col("s_nationkey").cast("long").alias("language"),
        (F.col("s_suppkey") % 3 == 0).alias("is_default"), F.col("s_suppkey").alias("ord"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("post_id"),
        F.floor(F.col("s_acctbal") / 100).cast("long").cast("string").alias("body"),
        F.when(F.col("s_suppkey") % 4 == 0, "sent").otherwise("queued").alias("status"),
    )


def playlist_enumerations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Order]:
    """Entries of two enumerations per playlist, in listing order."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("playlist_id"), F.col("l_partkey").alias("video_id"),
        F.col("l_linestatus").alias("enumeration"), "l_shipdate", "l_orderkey", "l_linenumber",
    )
    by = ("l_shipdate", "l_orderkey", "l_linenumber", "video_id")
    blocks = [F.unix_micros(F.col("l_shipdate").cast("timestamp")), F.floor(F.col("l_orderkey") / 1_000_000)]
    li, order = arrange(li, ("playlist_id", "enumeration"), by, blocks=blocks)
    li = running(li, order, ordinal=ordered.position())
    return li.select("playlist_id", "video_id", "enumeration", "ordinal"), order




def _codes_of(bits: Column) -> Column:
    picked = [
        F.when(F.floor(bits / (1 << i)) % 2 == 1, F.lit(code)) for i, code in enumerate(CODES)
    ]
    return F.filter(F.array(*picked), lambda x: x.isNotNull())


def language_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    return c.select(
        k.alias("video_id"), _pick(k % 6, CODES[:6]).alias("source"),
        _codes_of(k % 128).alias("targets"),
        _codes_of(F.floor(k / 3) % 128).alias("dubs"),
        _codes_of(F.floor(k / 5) % 128).alias("captions"),
    )
