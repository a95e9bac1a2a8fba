"""Benchmark passages in documents by greedy string tiling.

Seeds (short word sequences) that documents share with test items are joined; for each (document, item) pair that
shares one, running Karp-Rabin matching repeatedly marks the longest common stretches that don't overlap, so that a
passage whose parts were reordered is still covered. A pair is a leak if its tiles cover enough of the item.

A fixed-size bit table of the items' seeds, sent to all tasks, spares most documents the join; it only ever lets
too many through.

Words are runs of letters, digits and bytes beyond ASCII, in lower case. Defined cases: null and empty
texts have no words; items of fewer than ``seed_words`` words never match. Rows of repeated ids give pairs of their
own. An empty side gives no pairs. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm import words
from cuelake.llm.jobfolder import column_bytes, kept, lowered, numbered, numbered_texts, texts_of

#: Bits of the seed table, two of them set a seed: 8 MB whatever the benchmark's size.
FILTER_BITS = 26

_BASE = 0xC2B2AE3D27D4EB4F
_INVERSE = pow(_BASE, -1, 1 << 64)


def windows(tokens: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin values of all windows of ``length`` tokens."""
    if len(tokens) < length:
        return np.empty(0, np.uint64)
    n = len(tokens)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(tokens * words._power_table(_BASE, n)[:n], out=sums[1:])
    return words.mix((sums[length:] - sums[:-length]) * words._power_table(_INVERSE, n)[: n - length + 1])


def _scan(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(length, place in a, place in b) of the longest unmarked matches of at least ``length`` that start anywhere."""

    def open_windows(free: np.ndarray) -> np.ndarray:
        taken = np.concatenate(([0], np.cumsum(~free)))
        return np.flatnonzero(taken[length:] == taken[:-length]) if len(free) >= length else np.empty(0, int)

    at_b = open_windows(free_b)
    if not len(at_b):
        return []
    value_b = windows(b, length)[at_b]
    order = np.argsort(value_b, kind="stable")
    value_b, at_b = value_b[order], at_b[order]
    at_a = open_windows(free_a)
    value_a = windows(a, length)[at_a]
    low, high = np.searchsorted(value_b, value_a, "left"), np.searchsorted(value_b, value_a, "right")
    hit = np.flatnonzero(high > low)
    found, reached = [], {}
    for k in hit:
        i = int(at_a[k])
        for m in range(low[k], high[k]):
            j = int(at_b[m])
            if reached.get(i - j, -1) > i:  # inside the match found before on this diagonal
                continue
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                n += 1
            if n >= length:
                found.append((n, i, j))
                reached[i - j] = i + n
    return found


def tiles(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, place in a, place in b): longest first, none overlapping, of at least ``least`` tokens."""
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    length, out = max(least, len(b) // 2), []
    while True:
        waiting = sorted(_scan(a, b, free_a, free_b, length), key=lambda m: (-m[0], m[2], m[1]))
        if waiting and waiting[0][0] > 2 * length:
            length = waiting[0][0]
            continue
        again = []
        for n, i, j in waiting:
            open_ = free_a[i : i + n] & free_b[j : j + n]
            if open_.all():
                free_a[i : i + n] = free_b[j : j + n] = False
                out.append((n, i, j))
            else:
                again.append((n, i, j))
        if again and len(again) < len(waiting):
            continue  # what is left of the matches that were partly taken may still be long enough
        if length == least:
            return out
        length = max(least, length // 2)


def seeds(items: DataFrame, seed_words: int) -> DataFrame:
    """(item_id, seed): each item's distinct seeds."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("item"))
            for first, group in words.by_text(column_bytes(batch, "text"), words.PLAIN):
                for k, tokens in enumerate(group, start=first):
                    own = np.unique(windows(tokens, seed_words)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(ids[k].as_py(), len(own)), pa.int64()), pa.array(own)], ["item", "seed"])

    return items.select("item", "text").mapInArrow(each, "item long, seed long")


def _bits(seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    value = seed.view(np.uint64)
    shift = np.uint64(64 - FILTER_BITS)
    return value >> shift, (value * np.uint64(0x9E3779B97F4A7C15)) >> shift


def seed_table(found: DataFrame) -> np.ndarray:
    """The bit table of all seeds: tasks set their bits, equal bytes are joined, and only set ones travel."""

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unique(np.concatenate(_bits(batch.column(0).to_numpy())))
            yield pa.RecordBatch.from_arrays([pa.array((bits >> np.uint64(3)).astype(np.int32)), pa.array((1 << (bits & np.uint64(7)).astype(np.int32)).astype(np.int32))], ["byte", "bit"])

    bytes_ = found.select("seed").mapInArrow(set_bits, "byte int, bit int").groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    table[bytes_["byte"].to_numpy()] = bytes_["bits"].to_numpy().astype(np.uint8)
    return table


def _touched(shared, seed_words: int):
    """Texts with a seed in the table: (row, doc_id, tokens, their distinct seeds that may be in the table)."""

    def touch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: np.ndarray = shared.value
        for batch in batches:
            ids, rows = (batch.column(batch.schema.get_field_index(x)) for x in ("doc_id", "row"))
            for first, group in words.by_text(column_bytes(batch, "text"), words.PLAIN):
                every = np.concatenate(group)
                value = windows(every, seed_words)  # windows across two texts are left out below
                x, y = _bits(value)
                hit = (table[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8)) & (table[y >> np.uint64(3)] >> (y & np.uint64(7)).astype(np.uint8)) & 1
                at = np.flatnonzero(hit)
                ends = np.cumsum([len(g) for g in group])
                owner = np.searchsorted(ends, at, side="right")
                inside = at + seed_words <= ends[owner] if len(at) else np.empty(0, bool)
                at, owner = at[inside], owner[inside]
                for k in np.unique(owner):
                    own = np.unique(value[at[owner == k]]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([
                        rows.slice(first + int(k), 1), ids.slice(first + int(k), 1), pa.array([group[k].tobytes()]),
                        pa.array([own], pa.list_(pa.int64()))], ["row", "doc_id", "tokens", "seeds"])

    return touch


def _judge(least: int, coverage: float):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, share, count = [], [], []
            pairs = zip(column_bytes(batch, "tokens"), column_bytes(batch, "item_tokens"), strict=True)
            for k, (doc, item) in enumerate(pairs):
                b = np.frombuffer(item, np.uint64)
                found = tiles(np.frombuffer(doc, np.uint64), b, least)
                covered = sum(n for n, _, _ in found) / len(b)
                if covered >= coverage:
                    keep.append(k)
                    share.append(covered)
                    count.append(len(found))
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.get_field_index("row")).take(take), batch.column(batch.schema.get_field_index("doc_id")).take(take),
                batch.column(batch.schema.get_field_index("item_id")).take(take), pa.array(share, pa.float64()), pa.array(count, pa.int32()),
            ], ["row", "doc_id", "item_id", "coverage", "tiles"])

    return judge


def leaks(docs: DataFrame, items: DataFrame, seed_words: int = 4, coverage: float = 0.6) -> DataFrame:
    """(row, doc_id, item_id, coverage, tiles) of the pairs whose tiles cover ``coverage`` of the item.

    docs: doc_id, text. items: item_id, text. seed_words: least words of a tile. row: number of the document's row.
    """
    return _leaks(numbered_texts(docs, lowered("text")), items, seed_words, coverage)


def _leaks(texts: DataFrame, items: DataFrame, seed_words: int, coverage: float) -> DataFrame:
    spark = texts.sparkSession
    id_type, item_type = texts.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    tests = kept(items.select(
        F.monotonically_increasing_id().alias("item"), "item_id", lowered("text").alias("text")
    ), "benchmark")
    found = kept(seeds(tests, seed_words), "benchmark-seeds")
    shared = spark.sparkContext.broadcast(seed_table(found))
    touched = kept(
        texts.mapInArrow(
            _touched(shared, seed_words), f"row long, doc_id {id_type}, tokens binary, seeds array<long>"
        ),
        "touched-documents",
    )
    pairs = kept(
        touched.select("row", F.explode("seeds").alias("seed")).join(found, "seed").select("row", "item").distinct(),
        "tiling-pairs",
    )

    def item_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, group in words.by_text(column_bytes(batch, "text"), words.PLAIN):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(group)), batch.column(1).slice(first, len(group)),
                    pa.array([g.tobytes() for g in group], pa.binary())], ["item", "item_id", "item_tokens"])

    tokens = tests.mapInArrow(item_tokens, f"item long, item_id {item_type}, item_tokens binary")
    met = pairs.join(touched.select("row", "doc_id", "tokens"), "row").join(tokens, "item")
    return met.select("row", "doc_id", "tokens", "item_id", "item_tokens").mapInArrow(
        _judge(seed_words, coverage), f"row long, doc_id {id_type}, item_id {item_type}, coverage double, tiles int"
    )


def without_leaks(docs: DataFrame, items: DataFrame, seed_words: int = 4, coverage: float = 0.6) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    rows = numbered(docs)
    found = _leaks(texts_of(rows, lowered("doc.text")), items, seed_words, coverage)
    gone = kept(found.select("row").distinct(), "leaky-rows")
    return rows.join(gone, "row", "left_anti").select(*[F.col("doc")[c].alias(c) for c in docs.columns])
