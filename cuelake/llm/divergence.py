"""How a source's wording differs from other sources of its language, with term strings read back last.

Late string materialization: tasks count terms under a 64-bit digest and write (digests, count, documents) to the shared
folder, with a term's string where the task meets it first. Shuffles of the counting read the fixed-width columns only.
The strings are then read for the digests that may be kept: a digest whose least and greatest string differ stands for
several terms and is counted again by string, which splits it. Everything after that is whole numbers again, until the few reported terms get their
text by a last join.

Sources of a language are compared over all kept terms. Terms are dealt into blocks and sources into chunks of
``CHUNK``; a task takes one block and two chunks as a matrix and returns one sum a pair of sources, so neither a
common term nor a large source is gathered. Terms that neither source of a pair has give one known value each.

Defined cases: null text, lang or source is ''. A row is a document, also where ids repeat. A source without terms
has the share of unseen terms throughout; a language without kept terms gives value 0 for every pair and no term
rows. Ties are ranked by the item's UTF-8 bytes. Texts over ``PIECE`` bytes are counted piece by piece, cut between
terms. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.jobfolder import column_bytes, kept

# Fixed value: a term is a run of letters and of bytes beyond ASCII
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")

PIECE = 1 << 20
#: Distinct terms that a task holds before it sends its counts on.
HELD_TERMS = 400_000
#: Sources compared with each other in one task; entries (term, source) of a block.
CHUNK = 256
BLOCK_ENTRIES = 500_000
#: Tables of whole numbers up to this many rows are sent to all tasks instead of dealing the other side out.
SENT_ROWS = 1_000_000

COUNTS = "lang_key long, group_key long, digest long, n long, docs long, term binary"


def digest_of(term: bytes, bits: int = 64) -> int:
    """The term's digest as a signed long; fewer bits make terms meet, as tests need."""
    return (xxhash.xxh3_64_intdigest(term) & ((1 << bits) - 1)) - (1 << (bits - 1))


def _pieces(text: bytes, limit: int) -> Iterator[bytes]:
    at = 0
    while len(text) - at > limit:
        gap = re.compile(rb"[^A-Za-z\x80-\xff]").search(text, at + limit)
        cut = gap.start() if gap else len(text)
        yield text[at:cut]
        at = cut
    yield text[at:]


def _count(bits: int, most: int, limit: int, named: bool = False):
    """Each group's terms in a part of the table, with how often and in how many documents they occur.

    A term's string stands in its first row only, in all of them if ``named``.
    """

    def flush(counts: dict[tuple[int, int], tuple[Counter, Counter]]) -> pa.RecordBatch:
        lang, group, digest, n, docs, terms = [], [], [], [], [], []
        known: dict[bytes, int] = {}
        for (lang_key, group_key), (times, holders) in counts.items():
            for term, times_here in times.items():
                number = known.get(term)
                terms.append(term if named or number is None else None)
                if number is None:
                    number = known[term] = digest_of(term, bits)
                digest.append(number)
                n.append(times_here)
                docs.append(holders[term])
            lang.extend([lang_key] * len(times))
            group.extend([group_key] * len(times))
        longs = [pa.array(x, pa.int64()) for x in (lang, group, digest, n, docs)]
        return pa.RecordBatch.from_arrays([*longs, pa.array(terms, pa.binary())], [c.split()[0] for c in COUNTS.split(", ")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for key, text in zip(keys, column_bytes(batch, "text"), strict=True):
                times, holders = counts.setdefault(key, (Counter(), Counter()))
                own: set[bytes] = set()
                held -= len(times)
                for piece in _pieces(text, limit):
                    found = TERM.findall(piece.lower())
                    times.update(found)
                    own.update(found)
                holders.update(own)
                held += len(times)
                if held > most:
                    yield flush(counts)
                    counts, held = {}, 0
        if counts:
            yield flush(counts)

    return count


def _name(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _groups(docs: DataFrame) -> tuple[DataFrame, int]:
    """(lang, source, lang_key, group_key) of all groups, and the seed for which no two names share a key."""
    names = kept(docs.select(_name("lang").alias("lang"), _name("source").alias("source")).distinct(), "source-groups")
    seed = 0
    while True:
        keyed = names.select("lang", "source", *_keys(seed))
        met = keyed.groupBy("lang_key").agg(F.min("lang").alias("a"), F.max("lang").alias("b")).filter("a <> b")
        twice = keyed.groupBy("group_key").count().filter("count > 1")
        if met.isEmpty() and twice.isEmpty():
            return keyed, seed
        seed += 1


def _keys(seed: int, lang: str = "lang", source: str = "source") -> list[Column]:
    return [
        F.xxhash64(F.lit(seed), lang).alias("lang_key"),
        F.xxhash64(F.lit(seed), lang, F.lit("in"), source).alias("group_key"),
    ]


def _sent(rows: DataFrame) -> DataFrame:
    """The table marked as one for all tasks if a count says that it is small."""
    return F.broadcast(rows) if rows.limit(SENT_ROWS + 1).count() <= SENT_ROWS else rows


def _term_counts(docs: DataFrame, seed: int, min_docs: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(lang_key, group_key, digest, k, n) of the kept terms in each group that has them, and (digest, k, term).

    k tells apart the terms of one digest; it is 0 where a digest stands for one term.
    """
    rows = docs.select(_name("lang").alias("lang"), _name("source").alias("source"), F.col("text").cast("string").alias("text"))
    rows = rows.select(*_keys(seed), "text")
    written = kept(rows.mapInArrow(_count(bits, HELD_TERMS, PIECE), COUNTS), "term-counts")
    # only whole numbers travel here
    group, sums = ["lang_key", "group_key", "digest"], [F.sum("n").alias("n"), F.sum("docs").alias("docs")]
    counts = kept(written.select(*group, "n", "docs").groupBy(*group).agg(*sums), "digest-counts")
    enough = F.col("docs") >= min_docs
    likely = counts.groupBy("lang_key", "digest").agg(F.sum("docs").alias("docs")).filter(enough)
    likely = kept(likely.select("lang_key", "digest"), "likely-terms")

    strings = written.filter(F.col("term").isNotNull()).select("digest", "term")
    strings = strings.join(_sent(likely.select("digest").distinct()), "digest", "left_semi")
    ends = kept(strings.groupBy("digest").agg(F.min("term").alias("term"), F.max("term").alias("last")), "term-strings")
    terms = ends.filter("term = last").select("digest", F.lit(0).alias("k"), "term")
    mixed = ends.filter("term <> last").select("digest")
    every = counts.join(_sent(likely), ["lang_key", "digest"], "left_semi").withColumn("k", F.lit(0))
    columns = ["lang_key", "group_key", "digest", "k", "n"]
    if mixed.isEmpty():
        return every.select(*columns), terms

    # digests that stand for several terms: counted by string, numbered, judged again
    named = rows.mapInArrow(_count(bits, HELD_TERMS, PIECE, named=True), COUNTS).join(_sent(mixed), "digest", "left_semi")
    split = kept(named.groupBy(*group, "term").agg(*sums), "split-terms")
    number = F.row_number().over(Window.partitionBy("digest").orderBy("term"))
    parts = kept(split.select("digest", "term").distinct().select("digest", number.alias("k"), "term"), "split-numbers")
    split = split.join(parts, ["digest", "term"])
    held = split.groupBy("lang_key", "digest", "k").agg(F.sum("docs").alias("docs")).filter(enough)
    split = split.join(held.drop("docs"), ["lang_key", "digest", "k"], "left_semi")
    every = every.join(_sent(mixed), "digest", "left_anti")
    return every.select(*columns).unionByName(split.select(*columns)), terms.unionByName(parts)


def _share(n: str, total: str, terms: str) -> Column:
    """1 + floor(1e9 * (n + 2) / (total + 2 * terms)) in whole numbers; null without any kept term."""
    return F.when(F.col(terms) > 0, F.expr(
        f"1 + (cast(1000000000 as decimal(20,0)) * cast({n} + 2 as decimal(18,0))) div cast({total} + 2 * {terms} as decimal(18,0))"
    ))


def _gap(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _compare(chunk: int):
    """Sums over one block's terms for all pairs of sources of two chunks (or of one with itself)."""

    def compare(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
        a_chunk, b_chunk = key[2].as_py(), key[3].as_py()
        column = lambda name: parts.column(name).to_numpy()
        place, p, is_base = column("place"), column("p"), parts.column("digest").is_null().to_numpy()
        sources, column_of = np.unique(place, return_inverse=True)
        base = np.zeros(len(sources), np.int64)
        base[column_of[is_base]] = p[is_base]
        seen = ~is_base
        term = np.stack([np.asarray(parts.column(c).to_numpy()[seen], np.int64) for c in ("digest", "k")], 1)
        term_of = np.unique(term, axis=0, return_inverse=True)[1].reshape(-1)
        shares = np.tile(base, (int(term_of.max(initial=-1)) + 1, 1))
        shares[term_of, column_of[seen]] = p[seen]
        first, second = np.flatnonzero(sources // chunk == a_chunk), np.flatnonzero(sources // chunk == b_chunk)
        out_a, out_b, value = [], [], []
        for i in first:
            q = shares[:, second]
            own = shares[:, [i]]
            sums = ((own - q) ** 2 // (own + q)).sum(0)
            keep = sources[second] > sources[i] if a_chunk == b_chunk else np.ones(len(second), bool)
            out_a.append(np.full(keep.sum(), sources[i]))
            out_b.append(sources[second][keep])
            value.append(sums[keep])
        joined = [np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (out_a, out_b, value)]
        lang = pa.array(np.full(len(joined[0]), key[0].as_py()), pa.int64())
        return pa.table({
            "lang_key": lang, "a": joined[0], "b": joined[1], "value": joined[2], "seen": np.full(len(joined[0]), len(shares), np.int64)})

    return compare


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_key, other, value): differences of all ordered pairs of a language's sources, over all its kept terms."""
    most = F.greatest(F.ceil(F.col("entries") / BLOCK_ENTRIES), F.lit(1)).cast("long")
    blocks = shares.groupBy("lang_key").agg(F.count("*").alias("entries")).select("lang_key", most.alias("blocks"))
    chunk = F.floor(F.col("place") / CHUNK).cast("int")
    last = F.floor((F.col("sources") - 1) / CHUNK).cast("int")
    # a source's chunk meets every chunk once: as the first of two up to the last one, as the second of two before it
    sides = F.concat(
        F.transform(F.sequence(chunk, last), lambda c: F.struct(chunk.alias("a"), c.alias("b"))),
        F.transform(F.filter(F.sequence(F.lit(0), last), lambda c: c < chunk), lambda c: F.struct(c.alias("a"), chunk.alias("b"))),
    )
    placed = groups.select("lang_key", "group_key", "place", "sources", "p0").join(blocks, "lang_key")
    entries = shares.join(placed.drop("p0"), ["lang_key", "group_key"]).withColumn(
        "block", F.pmod(F.xxhash64("digest", "k"), F.col("blocks"))
    ).select("lang_key", "block", "place", "sources", "digest", "k", "p")
    bases = placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "lang_key", "block", "place", "sources", F.lit(None).cast("long").alias("digest"), F.lit(None).cast("int").alias("k"),
        F.col("p0").alias("p"),
    )
    dealt = entries.unionByName(bases).select("lang_key", "block", "place", "digest", "k", "p", F.explode(sides).alias("side"))
    dealt = dealt.select("lang_key", "block", F.col("side.a").alias("a"), F.col("side.b").alias("b"), "place", "digest", "k", "p")
    sums = dealt.groupBy("lang_key", "block", "a", "b").applyInArrow(
        _compare(CHUNK), "lang_key long, a long, b long, value long, seen long"
    ).groupBy("lang_key", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    both = kept(sums, "source-pairs")
    both = both.unionByName(both.select("lang_key", F.col("b").alias("a"), F.col("a").alias("b"), "value", "seen"))
    one = groups.select("lang_key", F.col("place").alias("a"), "group_key", "terms", F.col("p0").alias("p"))
    other = groups.select("lang_key", F.col("place").alias("b"), F.col("source").alias("item"), F.col("p0").alias("q"))
    met = one.join(other, "lang_key").filter("a <> b").join(both, ["lang_key", "a", "b"], "left")
    rest = (F.col("terms") - F.coalesce(F.col("seen"), F.lit(0))) * _gap("p", "q")
    value = F.when(F.col("terms") > 0, F.coalesce(F.col("value"), F.lit(0)) + rest).otherwise(0)
    return met.select("group_key", "item", value.cast("long").alias("value"))


def divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, bits: int = 64) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for the documents (text, lang, source).

    Part ``pair``: every other source of the language by difference over the kept terms. Part ``term``: the ``top``
    terms that the source uses above its language's share. min_docs: documents of a language that a kept term is in.
    """
    names, seed = _groups(docs)
    counts, strings = _term_counts(docs, seed, min_docs, bits)
    counts = kept(counts, "kept-terms")
    per_lang = counts.groupBy("lang_key", "digest", "k").agg(F.sum("n").alias("lang_n"))
    langs = per_lang.groupBy("lang_key").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = counts.groupBy("group_key").agg(F.sum("n").alias("total"))
    along = Window.partitionBy("lang_key")
    groups = names.join(totals, "group_key", "left").join(langs, "lang_key", "left").fillna(0, ["total", "terms", "lang_total"])
    groups = groups.withColumns({
        "place": F.row_number().over(along.orderBy("source")).cast("long") - 1, "sources": F.count("*").over(along),
        "none": F.lit(0).cast("long"),
    })
    groups = kept(groups.withColumn("p0", _share("none", "total", "terms")), "source-totals")

    shares = counts.join(groups.select("group_key", "total", "terms"), "group_key").withColumn("p", _share("n", "total", "terms"))
    shares = kept(shares.select("lang_key", "group_key", "digest", "k", "p"), "term-shares")

    lang_shares = per_lang.join(langs, "lang_key").withColumn("q", _share("lang_n", "lang_total", "terms"))
    above = shares.join(lang_shares.select("lang_key", "digest", "k", "q"), ["lang_key", "digest", "k"]).filter("p > q")
    best = Window.partitionBy("group_key").orderBy(F.desc("value"))
    # what can be among the first, ties included, still without text; then the text, and ties by it
    near = above.select("group_key", "digest", "k", _gap("p", "q").alias("value")).withColumn("near", F.rank().over(best))
    near = near.filter(F.col("near") <= top).drop("near").join(strings, ["digest", "k"])
    near = near.select("group_key", F.lit("term").alias("part"), F.decode("term", "UTF-8").alias("item"), "value")
    pairs = _pairs(shares, groups).select("group_key", F.lit("pair").alias("part"), "item", "value")
    place = F.row_number().over(Window.partitionBy("group_key", "part").orderBy(F.desc("value"), "item"))
    ranked = near.unionByName(pairs).withColumn("rank", place).filter((F.col("part") == "pair") | (F.col("rank") <= top))
    return ranked.join(names.select("group_key", "lang", "source"), "group_key").select(
        "lang", "source", "part", "item", "value", "rank"
    )
