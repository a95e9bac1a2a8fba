"""Language-model scores of documents from a probabilistic suffix tree over words.

Corpus passes on Spark count words, then word sequences level by level: a sequence is a candidate if it was seen
``least`` times, whatever the size of the corpus; a longer one can only be if its parts are. Each level stays a table
in the shared folder. A context stays in the tree when its next-word distribution diverges enough from that of its
longest kept suffix, which grouped sums decide. A word's probability is that of its longest listed sequence, times a
factor for each kept context that is longer; as logarithms, both are sums of one weight per sequence. Scores add the
weights of all sequences of a text: those of common sequences are sent to all tasks, the others meet the texts in a
join, as do the counts of rare words.

Defined cases: a null or empty text has one token, its end. A null id counts as the empty text for the held-out
rule. Repeated rows are documents of their own. Without training rows all counts are 0 and scores follow the base
formula. Columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm import words
from cuelake.llm.jobfolder import batches_of, column_bytes, dropped, kept, remainder

#: The token after the last word of every text.
END = np.uint64(0x5DEECE66D1CE4E5B)
#: Share of all tokens from which a word's count, or a sequence's weight, is sent to every task: at most 1 / WORD_SHARE
#: words, and as many sequences of each length.
WORD_SHARE = 1e-6
#: Rows of counts that a task gathers before it hands them on: words', and those of pieces.
GATHERED_WORDS, GATHERED = 1 << 22, 1 << 20
#: Bits of a table that tells which keys a join would surely not find: as many per key, within these bounds.
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 8, 1 << 12, 1 << 28

#: Tokens whose sequences, or texts' finds, fill a bucket, and fewest buckets.
BUCKET, LEAST_BUCKETS = 1 << 20, 64
#: Texts that a task's Python function gets at once.
BATCH_TEXTS = 1000
#: Texts whose finds lie in one piece: their numbers in it take two bytes.
PIECE_TEXTS = 1 << 16
#: Parts of the texts that are scored one after the other, so that the finds of one at a time lie on the disk.
SCORE_PARTS = 3

COUNTS = "key long, n long"
PIECES = "bucket long, key binary, prefix binary, n binary"
SEQUENCES = "key long, prefix long, suffix long, n long"
LISTED = "bucket long, is_weight boolean, keys binary, values binary"


@dataclass
class Level:
    """Sequences of one length: sorted keys (index of all but the last word << 32 | index of the last), counts."""

    keys: np.ndarray
    counts: np.ndarray
    prefix: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    kept: np.ndarray = field(default_factory=lambda: np.empty(0, bool))
    rest: np.ndarray = field(default_factory=lambda: np.empty(0))


@dataclass
class Tree:
    """What scoring needs: frequent words with counts, the totals, and the tables of sequences.

    sequences: per length (key, n, and from two words on prefix, suffix) of what was seen often enough. contexts: per
    length but the last (prefix, rest, whole, fall) of the kept ones. weights: (key, n, weight) of sequences, up to two
    rows of a key.
    """

    words: np.ndarray
    word_counts: np.ndarray
    total: int
    distinct: int
    alpha: float
    prior: float
    sequences: list[DataFrame] = field(default_factory=list)
    contexts: list[DataFrame] = field(default_factory=list)
    weights: DataFrame | None = None

    def base(self, count: np.ndarray) -> np.ndarray:
        return (count + self.alpha) / (self.total + self.alpha * (self.distinct + 1))

    @cached_property
    def levels(self) -> list[Level]:
        """All sequences of a small tree, gathered for a look at it; scoring doesn't need this."""
        out: list[Level] = []
        places: dict[int, int] = {}
        for k, table in enumerate(self.sequences):
            rows = table.toArrow().to_pydict()
            if not k:
                place = np.array(rows["key"], np.int64).view(np.uint64)
            else:
                # the last word is the sequence's suffix, shortened to one word
                last = rows["suffix"]
                for shorter in reversed(suffixes[1:]):
                    last = [shorter[x] for x in last]
                place = np.array(
                    [(places[a] << 32) | first[b] for a, b in zip(rows["prefix"], last, strict=True)], np.int64
                )
            order = np.argsort(place)
            keys = np.array(rows["key"], np.int64)[order]
            places = {key: at for at, key in enumerate(keys.tolist())}
            if not k:
                first, suffixes = places, [{}]
            else:
                suffixes.append(dict(zip(rows["key"], rows["suffix"], strict=True)))
            level = Level(place[order], np.array(rows["n"], np.int64)[order])
            level.prefix = np.full(len(keys), -1, np.int64) if not k else level.keys >> 32
            level.kept, level.rest = np.zeros(len(keys), bool), level.counts + self.prior
            if k < len(self.contexts):
                for r in self.contexts[k].collect():
                    level.kept[places[r.prefix]], level.rest[places[r.prefix]] = True, r.rest
            out.append(level)
        return out


@dataclass
class Shared:
    """What every scoring task holds: common words with their base, common sequences with weights, keys of others."""

    words: np.ndarray
    base: np.ndarray
    keys: np.ndarray
    weights: np.ndarray
    others: np.ndarray
    depth: int


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted key in the sorted keys, -1 where it is absent."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


_PREFIX = np.uint64(0x9FB21C651E98DF25)


def sequence_key(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Key of the sequence whose parts without the last and without the first word have these keys."""
    return words.mix(prefix * _PREFIX + suffix)


def suffix_of(key: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Key of the sequence without its first word, from its own and that without its last word."""
    return words.unmix(key) - prefix * _PREFIX


def grown(shorter: np.ndarray) -> np.ndarray:
    """Keys of the sequences that end at each token and are one word longer than those of ``shorter``."""
    return sequence_key(np.concatenate((np.zeros(1, np.uint64), shorter[:-1])), shorter)


def bits_of(keys: np.ndarray) -> np.ndarray:
    """Bits of keys that are at hand, as in ``bit_table``."""
    size = LEAST_BITS
    while size < min(len(keys) * BITS_PER_KEY, MOST_BITS):
        size *= 2
    table = np.zeros(size // 64, np.uint64)
    np.bitwise_or.at(table, (keys >> np.uint64(6)) & np.uint64(len(table) - 1), np.uint64(1) << (keys & np.uint64(63)))
    return table


def bit_table(keys: DataFrame) -> np.ndarray:
    """Bits that are set for every key (any other key may meet a set bit, too); its size is bounded."""
    size = LEAST_BITS
    n = keys.count()
    while size < min(n * BITS_PER_KEY, MOST_BITS):
        size *= 2
    place = F.shiftrightunsigned(F.col("key"), 6).bitwiseAND(F.lit(size // 64 - 1))
    bits = keys.groupBy(place.alias("place")).agg(F.expr("bit_or(shiftleft(1L, cast(key & 63L as int)))").alias("bits"))
    rows = bits.toArrow()
    table = np.zeros(size // 64, np.uint64)
    table[rows["place"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return table


def may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    cell = table[(keys >> np.uint64(6)) & np.uint64(len(table) - 1)]
    return (cell >> (keys & np.uint64(63))) & np.uint64(1) != 0


def tokens(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, token hashes with ends, place of each in its text, lengths) of groups of texts."""
    for first, group in words.by_text(column_bytes(batch, "text")):
        lengths = np.array([len(g) + 1 for g in group])
        ends = np.cumsum(lengths)
        out = np.empty(ends[-1], np.uint64)
        is_end = np.zeros(ends[-1], bool)
        is_end[ends - 1] = True
        out[is_end] = END
        out[~is_end] = np.concatenate(group)
        yield first, out, np.arange(ends[-1]) - np.repeat(ends - lengths, lengths), lengths


def _gathered(parts: Iterator[list[np.ndarray]], most: int) -> Iterator[list[np.ndarray]]:
    """Columns of many parts as one, whenever ``most`` rows have gathered."""
    held: list[list[np.ndarray]] = []
    size = 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= most:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, size = [], 0
    if size:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (value,) in _gathered(([value] for batch in batches for _, value, _, _ in tokens(batch)), GATHERED_WORDS):
        key, n = np.unique(value, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])


def buckets_for(entries: int) -> int:
    """Into how many buckets keys are dealt, so that a task can take one as arrays."""
    return max(LEAST_BUCKETS, -(-entries // BUCKET))


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each key: buckets are ranges of keys."""
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def planes(ordered: np.ndarray) -> bytes:
    """Whole numbers as one run of bytes for each of their places: of sorted ones, the high runs hardly take space."""
    return np.ascontiguousarray(ordered.view(np.uint8).reshape(len(ordered), -1).T).tobytes()


def unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _pieces(buckets: int, key: np.ndarray, *others: np.ndarray) -> list[pa.Array]:
    """A row for each bucket: its number, its keys sorted, as planes, the other columns' bytes in that order."""
    order = np.argsort(key)
    key, others = key[order], [c[order] for c in others]
    bucket = bucket_of(key, buckets)
    runs = _runs(bucket)
    columns = [[planes(key[a:b]) for a, b in runs], *([c[a:b].tobytes() for a, b in runs] for c in others)]
    return [pa.array(bucket[runs[:, 0]]), *(pa.array(c, pa.binary()) for c in columns)]


def _runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """(start, end) of each stretch of equal rows."""
    n = len(sorted_columns[0])
    change = np.zeros(n, bool)
    change[:1] = True
    for c in sorted_columns:
        change[1:] |= c[1:] != c[:-1]
    start = np.flatnonzero(change)
    return np.column_stack((start, np.append(start, n)[1:]))


def _summed(key: np.ndarray, prefix: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each sequence once, with its occurrences."""
    order = np.argsort(key, kind="stable")  # quick for a few sorted runs
    if np.any((key[order][1:] == key[order][:-1]) & (prefix[order][1:] != prefix[order][:-1])):
        order = np.lexsort((prefix, key))
    runs = _runs(key[order], prefix[order])
    start = runs[:, 0]
    first = order[start]
    return key[first], prefix[first], (runs[:, 1] - start if n is None else np.add.reduceat(n[order], start)).astype(np.uint64)


def _counter(shared, length: int, buckets: int, bit: int):
    """Counts sequences of ``length`` words whose two parts may be listed, of those with keys that end in ``bit``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed: np.ndarray = shared.value

        def parts() -> Iterator[list[np.ndarray]]:
            for batch in batches:
                for _, value, place, _ in tokens(batch):
                    suffix = value
                    for _ in range(length - 2):
                        suffix = grown(suffix)
                    on = may_hold(listed, suffix)
                    at = np.flatnonzero(on[1:] & on[:-1] & (place[1:] >= length - 1)) + 1
                    key = sequence_key(suffix[at - 1], suffix[at])
                    own = key & np.uint64(1) == np.uint64(bit)
                    yield [key[own], suffix[at - 1][own]]

        for key, prefix in _gathered(parts(), GATHERED):
            yield pa.RecordBatch.from_arrays(_pieces(buckets, *_summed(key, prefix)), ["bucket", "key", "prefix", "n"])

    return count


def _lister(bar: float):
    """Sums up a bucket's counts and lists the sequences that reach ``bar``."""

    def listed(table: pa.Table) -> pa.Table:
        key = np.concatenate([unplaned(x) for x in table["key"].to_pylist()])
        prefix, n = (np.frombuffer(b"".join(table[c].to_pylist()), np.uint64) for c in ("prefix", "n"))
        key, prefix, n = _summed(key, prefix, n)
        on = n >= bar
        key, prefix, n = key[on], prefix[on], n[on]
        columns = [pa.array(c.view(np.int64)) for c in (key, prefix, suffix_of(key, prefix), n)]
        return pa.Table.from_arrays(columns, ["key", "prefix", "suffix", "n"])

    return listed


def _settled(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """``kept``; then the tables in ``done`` and the shuffles that led to it may go from the disk.

    Spark's cleaner follows the JVM's collector.
    """
    out = kept(df, name)
    for table in done:
        dropped(table)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def _grow(tree: Tree, longer: DataFrame, level: DataFrame, above: list[DataFrame], spare: list[DataFrame]) -> DataFrame:
    """Keep the contexts whose next words diverge from those of their longest kept suffix; weights of sequences.

    longer: sequences one word longer than the contexts. level: (key, n, chance) of the contexts' own words, from the
    table in ``above`` if there is one. Returns that of ``longer``; the tables of ``spare``, which ``longer`` reads, go.

    The gain is the log-likelihood that a context adds over its suffix; each listed next word has to earn half the
    log of the corpus size, the usual price of a parameter.
    """
    price = 0.5 * math.log(tree.total + 2)
    inherited = level.select(F.col("key").alias("suffix"), F.col("chance").alias("inherited"))
    joined = longer.join(inherited, "suffix").select("suffix", "key", "prefix", "n", "inherited")
    halves = []
    for bit in (0, 1):  # so that the shuffles of one half at a time lie on the disk
        half = joined.filter(F.col("suffix").bitwiseAND(1) == bit).drop("suffix")
        halves.append(_settled(half, "next-words", *(spare if bit else [])))
    nexts = halves[0].unionByName(halves[1])
    listed = nexts.groupBy("prefix").agg(F.sum("n").alias("listed"), F.count("n").alias("n_next"))
    stats = _settled(
        listed.join(level.select(F.col("key").alias("prefix"), F.col("n").alias("n_context")), "prefix").select(
            "prefix", "n_context", "n_next", (F.col("n_context") - F.col("listed")).alias("unlisted"),
            (F.col("n_context") - F.col("listed") + F.lit(tree.prior)).alias("rest"),
            (F.col("n_context") + F.lit(tree.prior)).alias("whole"),
        ),
        "contexts", *above,
    )
    own = F.log((F.col("n") + F.col("rest") * F.exp("inherited")) / F.col("whole"))
    fall = F.log(F.col("rest") / F.col("whole"))
    gained = nexts.join(stats.select("prefix", "rest", "whole"), "prefix")
    gains = gained.groupBy("prefix").agg(F.sum(F.col("n") * (own - F.col("inherited"))).alias("gain"))
    context = _settled(
        stats.join(gains, "prefix")
        .filter(F.col("gain") + F.col("unlisted") * fall > F.lit(price) * (1 + F.col("n_next")))
        .select("prefix", "n_context", "rest", "whole", fall.alias("fall")),
        "kept-contexts", stats,
    )
    tree.contexts.append(context)
    on = F.col("fall").isNotNull()
    grown_level = nexts.join(context.select("prefix", "rest", "whole", "fall"), "prefix", "left").select(
        "key", "n", F.when(on, own).otherwise(F.col("inherited")).alias("chance"),
        (own - F.col("inherited") - F.col("fall")).alias("weight"),
    )
    below = _settled(grown_level, "chances", *halves)
    common = F.lit(math.log(10))
    weights = context.select(F.col("prefix").alias("key"), F.col("n_context").alias("n"), (F.col("fall") / common).alias("weight"))
    own_weights = below.filter(F.col("weight").isNotNull()).select("key", "n", (F.col("weight") / common).alias("weight"))
    weights = _settled(weights.unionByName(own_weights), "weights")
    tree.weights = weights if tree.weights is None else tree.weights.unionByName(weights)
    return below


def _scorer(shared, buckets: int):
    """A row for each text with what common words and sequences give, and pieces of its other words and sequences."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Shared = shared.value
        often = bits_of(known.keys)
        row = first_row = TaskContext.get().partitionId() << 40
        held: list[list[np.ndarray]] = []
        size = 0

        def pieces() -> Iterator[pa.RecordBatch]:
            owner, key, is_weight, tf = (np.concatenate(c) for c in zip(*held, strict=True))
            for kind in (False, True):
                on = np.flatnonzero(is_weight == kind)
                if len(on):
                    columns = _pieces(buckets, key[on], owner[on].astype(np.uint16), tf[on].astype(np.uint32))
                    m = len(columns[0])
                    yield pa.RecordBatch.from_arrays([
                        columns[0], pa.array(np.full(m, first_row)), pa.nulls(m, ids.type),
                        *(pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())),
                        pa.array(np.full(m, kind)), *columns[1:],
                    ], names)

        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            names = ["bucket", "row", "doc_id", "n_tokens", "n_known", "base", "gained", "is_weight", "keys", "owner", "tf"]
            for first, value, place, lengths in tokens(batch):
                n = len(lengths)
                if size >= GATHERED or row + n - first_row > PIECE_TEXTS:
                    yield from pieces()
                    held, size, first_row = [], 0, row
                owner = np.repeat(np.arange(n), lengths)
                word = find(known.words, value)
                common = word >= 0
                base = np.zeros(len(value))
                base[common] = known.base[word[common]]
                gained = np.zeros(n)
                met = [(owner[~common], value[~common], np.zeros(int((~common).sum()), bool))]
                sequence = value
                for length in range(1, known.depth + 2):
                    if length > 1:
                        sequence = grown(sequence)
                    on = np.flatnonzero(place >= length - 1)
                    key, by = sequence[on], owner[on]
                    here = may_hold(often, key)
                    at = find(known.keys, key[here])
                    here[here] = at >= 0
                    gained += np.bincount(by[here], weights=known.weights[at[at >= 0]], minlength=n)
                    far = may_hold(known.others, key) & ~here
                    met.append((by[far], key[far], np.ones(int(far.sum()), bool)))
                by, key, is_weight = (np.concatenate(c) for c in zip(*met, strict=True))
                order = np.lexsort((key, 2 * by + is_weight))
                by, key, is_weight = by[order], key[order], is_weight[order]
                runs = _runs(by, key, is_weight)
                start = runs[:, 0]
                held.append([by[start] + (row - first_row), key[start], is_weight[start], runs[:, 1] - start])
                size += len(start)
                rows = row + np.arange(n)
                row += n
                sums = [np.bincount(owner, weights=w, minlength=n) for w in (common, base)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket_of(words.mix(rows.view(np.uint64)), buckets)), pa.array(rows), ids.slice(first, n),
                    pa.array(lengths), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(gained),
                    pa.nulls(n, pa.bool_()), *(pa.nulls(n, pa.binary()) for _ in range(3)),
                ], names)
        if held:
            yield from pieces()

    return score


def _packer(buckets: int, is_weight: bool):
    """Keys with their counts or weights as pieces, for the buckets in which the texts' finds meet them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ([batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().astype(float)] for batch in batches)
        for key, value in _gathered(columns, GATHERED):
            bucket, keys, values = _pieces(buckets, key, value)
            kind = pa.array(np.full(len(bucket), is_weight))
            yield pa.RecordBatch.from_arrays([bucket, kind, keys, values], ["bucket", "is_weight", "keys", "values"])

    return pack


def _meeting(alpha: float, whole: float):
    """Sums of what a bucket's counts and weights give its finds, by row; texts' own rows pass through."""

    def meet(finds: pa.Table, listed: pa.Table) -> pa.Table:
        own = ["row", "doc_id", "n_tokens", "n_known", "base", "gained"]
        out = [finds.filter(finds["keys"].is_null()).select(own)]
        for kind in (False, True):
            there = listed.filter(pa.compute.equal(listed["is_weight"], kind))
            keys = np.concatenate([np.empty(0, np.uint64), *(unplaned(x) for x in there["keys"].to_pylist())])
            values = np.frombuffer(b"".join(there["values"].to_pylist()), np.float64)
            order = np.argsort(keys)
            keys, values = keys[order], values[order]
            if len(keys):  # up to two weights of a key: their sum counts
                start = _runs(keys)[:, 0]
                keys, values = keys[start], np.add.reduceat(values, start)
            here = finds.filter(pa.compute.equal(finds["is_weight"], kind))
            for first, found, owner, tf in zip(*(here[c].to_pylist() for c in ("row", "keys", "owner", "tf")), strict=True):
                at = find(keys, unplaned(found))
                value = np.zeros(len(at))
                value[at >= 0] = values[at[at >= 0]]
                tf = np.frombuffer(tf, np.uint32)
                rows, by = np.unique(np.frombuffer(owner, np.uint16), return_inverse=True)
                n = len(rows)
                if kind:
                    n_known, base, gained = np.zeros(n), np.zeros(n), np.bincount(by, tf * value, n)
                else:
                    n_known, gained = np.bincount(by, tf * (value > 0), n), np.zeros(n)
                    base = np.bincount(by, tf * np.log10((value + alpha) / whole), n)
                out.append(pa.Table.from_arrays([
                    pa.array(first + rows.astype(np.int64)), pa.nulls(n, finds.schema.field("doc_id").type),
                    pa.array(np.zeros(n, np.int64)), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(gained),
                ], own))
        return pa.concat_tables(out)

    return meet


def fit(
    train: DataFrame, depth: int = 3, least: int = 2, min_share: float = 0.0, alpha: float = 0.1, prior: float = 1.0,
    spare: bool = False,
) -> tuple[Tree, DataFrame]:
    """The tree over the texts of ``train`` (text: binary), and the table of all word counts.

    depth: most words in a context. least: occurrences that a sequence needs to be looked at. min_share: share of all
    tokens that it needs as well, for a smaller tree. alpha: added to each count at the root. prior: words' worth of
    the shorter context that each context's distribution starts from. spare: sequences of several words are removed
    from the disk once their weights are known, which is all that scoring needs.
    """
    spark = train.sparkSession
    texts = train.select("text")
    with batches_of(spark, BATCH_TEXTS):
        counts = _settled(texts.mapInArrow(_count_words, COUNTS).groupBy("key").agg(F.sum("n").alias("n")), "word-counts")
    total, distinct = counts.agg(F.sum("n"), F.count("n")).first()
    total = total or 0
    bar = max(float(least), min_share * total)
    common = counts.filter(F.col("n") >= F.lit(max(1.0, WORD_SHARE * total))).toArrow()
    key = common["key"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    tree = Tree(key[order], common["n"].to_numpy()[order], total, distinct, alpha, prior)
    tree.sequences = [counts.filter(F.col("n") >= F.lit(bar))]
    base = (F.col("n") + F.lit(alpha)) / F.lit(total + alpha * (distinct + 1))
    level = tree.sequences[0].select("key", "n", F.log(base).alias("chance"))
    longer, above, buckets = tree.sequences[0], [], buckets_for(total)
    table = bit_table(longer)
    for length in range(2, depth + 2):
        shared = spark.sparkContext.broadcast(table)
        halves = []
        for bit in (0, 1):  # so that the shuffle of one half at a time lies on the disk
            pieces = texts.mapInArrow(_counter(shared, length, buckets, bit), PIECES)
            with batches_of(spark, BATCH_TEXTS):
                halves.append(_settled(pieces.groupBy("bucket").applyInArrow(_lister(bar), SEQUENCES), "sequences"))
        longer = halves[0].unionByName(halves[1])
        table = bit_table(longer)
        if not spare:
            tree.sequences.append(longer)
        level = _grow(tree, longer, level, above, halves if spare else [])
        above = [level]
    for last in above:
        dropped(last)
    return tree, counts


def _shared(tree: Tree, bar: float) -> Shared:
    often = tree.weights.filter(F.col("n") >= F.lit(bar)).groupBy("key").agg(F.sum("weight").alias("weight")).toArrow()
    key = often["key"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    return Shared(
        tree.words, np.log10(tree.base(tree.word_counts.astype(float))), key[order],
        often["weight"].to_numpy()[order], bit_table(tree.weights.filter(F.col("n") < F.lit(bar)).select("key")),
        len(tree.contexts),
    )


def score_texts(docs: DataFrame, tree: Tree, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text: binary)."""
    bar = max(1.0, WORD_SHARE * tree.total)
    buckets = buckets_for(tree.total)
    shared = docs.sparkSession.sparkContext.broadcast(_shared(tree, bar))
    sums = f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, base double, gained double"
    rare = counts.filter(F.col("n") < F.lit(bar)).select("key", "n")
    far = tree.weights.filter(F.col("n") < F.lit(bar)).select("key", "weight")
    listed = rare.mapInArrow(_packer(buckets, False), LISTED).unionByName(far.mapInArrow(_packer(buckets, True), LISTED))
    meet = _meeting(tree.alpha, tree.total + tree.alpha * (tree.distinct + 1))
    done = []
    for part in range(SCORE_PARTS):
        own = docs.select("doc_id", "text").filter(F.pmod(F.xxhash64("doc_id"), F.lit(SCORE_PARTS)) == part)
        finds = own.mapInArrow(_scorer(shared, buckets), f"bucket long, {sums}, is_weight boolean, keys binary, owner binary, tf binary")
        met = finds.groupBy("bucket").cogroup(listed.groupBy("bucket")).applyInArrow(meet, sums)
        sums_of = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "gained")]
        rows = met.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *sums_of).select(
            "doc_id", "n_tokens", "n_known", F.lit(tree.total).cast("long").alias("train_tokens"),
            F.col("base").alias("base_score"), (F.col("base") + F.col("gained")).alias("score"),
        )
        with batches_of(docs.sparkSession, BATCH_TEXTS):
            done.append(_settled(rows, "scores"))
    return reduce(DataFrame.unionByName, done)


def scores(docs: DataFrame, hold_out: int = 10, **settings: float) -> DataFrame:
    """Scores of all documents by a tree over those whose id's remainder by ``hold_out`` is not 0.

    Adds held_out (the remainder is 0) to the columns of ``score_texts``.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    tree, counts = fit(texts.filter(remainder("doc_id", hold_out) != 0), spare=True, **settings)
    return score_texts(texts, tree, counts).select(
        "doc_id", (remainder("doc_id", hold_out) == 0).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )
