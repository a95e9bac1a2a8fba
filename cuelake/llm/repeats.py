"""Remove passages that occur more than once, found with an FM-index per shard.

A window is ``window`` consecutive words of one document. Each window belongs to the least hash among its runs of
``GRAM`` words, so equal windows belong to the same one, and neighbouring windows that share it form one segment.

1. Tasks count in how many places each least run stands. A window can only repeat if its run stands in two or more,
   so other segments end here; a bit table of fixed size says which go on.
2. What goes on is written to the shared folder: each segment's place, digest and, once a task, its text. Equal
   segments are one with a weight. Runs that stand in very many places (a passage in a third of all documents,
   each time with other words around it) are cut into single windows first, which deals them out and lets the equal
   ones meet.
3. Segments are dealt to shards by run. A shard builds a compressed FM-index of its segments, streams them through
   it by backward search over the wavelet matrix and reports the stretches whose windows stand in two places or more.
   Every segment of a run is in the run's shard, so a shard's counts are those of the whole table.
4. Stretches go back to the segments' places and documents; each document is cut once.

The windows are judged on the table as it is read: rows are numbered and written once, and all steps read that copy.

Defined cases: a null or empty text, and one of fewer words than a window, loses nothing. A row is a document, also
where ids repeat: repeated rows lose all their words that windows cover. A null id is an id. Words are compared as
bytes; blanks are [\\x20\\x09-\\x0D]. Very long texts are streamed in segments of at most ``SEGMENT`` windows. An empty
table gives no rows. Other columns are carried by ``without_repeats`` and ignored elsewhere, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm import words
from cuelake.llm.fmindex import FMIndex
from cuelake.llm.jobfolder import column_bytes, kept, numbered, numbered_texts, payload, texts_of

#: Words of the runs whose least hash a window belongs to.
GRAM = 8
#: Windows of one segment at most; text bytes of one shard, about.
SEGMENT = 1024
SHARD_BYTES = 6 << 20
#: A run is cut into single windows if it stands in this many places and in this share of all places, or more: so
#: there are at most as many of these runs as the share allows.
CROWD = 10_000
CROWD_SHARE = 1e-6
#: Bits of the table of repeated runs: 2^26, 8 MB at any size of input. A fuller table only lets more segments on.
TABLE_BITS = 26
#: Digests whose text a task has sent are remembered up to this many.
SENT = 200_000


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours."""
    covered = 1
    while covered * 2 <= width:
        values = np.minimum(values[:-covered], values[covered:])
        covered *= 2
    return np.minimum(values[: len(values) - (width - covered)], values[width - covered :]) if covered < width else values


def _runs(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` neighbouring words."""
    out, covered = values, 1
    mult = np.uint64(0x9E3779B97F4A7C15)
    while covered < width:
        step = min(covered, width - covered)
        out = words.mix(out[: len(out) - step] * mult + out[step:])
        covered += step
    return out


def segments(values: np.ndarray, window: int, longest: int = SEGMENT) -> tuple[np.ndarray, ...]:
    """(least run, first window, number of windows, places of the run in this text) of each segment of a text."""
    n = len(values) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3
    gram = min(GRAM, window)
    runs = _runs(values, gram)
    least = _least(runs, window - gram + 1)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    size = np.diff(np.append(first, n))
    if size.max() > longest:
        parts = -(-size // longest)
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first = np.repeat(first, parts) + within * longest
        size = np.diff(np.append(first, n))
    run = least[first]
    ordered = np.sort(runs)
    return run, first, size, np.searchsorted(ordered, run, side="right") - np.searchsorted(ordered, run)


def _places(window: int):
    """(run, places) of every segment of the texts."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, group in words.by_text(column_bytes(batch, "text")):
                found = [segments(values, window) for values in group]
                run = np.concatenate([f[0] for f in found]).view(np.int64)
                # a run that stands twice in one text is as good as one in two texts
                count = np.minimum(np.concatenate([f[3] for f in found]), 2)
                yield pa.RecordBatch.from_arrays([pa.array(run), pa.array(count.astype(np.int64))], ["run", "places"])

    return places


def _bits(run: np.ndarray) -> np.ndarray:
    return (run.view(np.uint64) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _table(repeated: DataFrame) -> np.ndarray:
    """The bit table of the repeated runs: tasks set bits, only set bytes travel, of which there are 8 million at most."""

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique(_bits(batch.column(0).to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 3, pa.int32()), pa.array(1 << (bit & 7), pa.int32())], ["byte", "bit"])

    found = repeated.select("run").mapInArrow(set_bits, "byte int, bit int").groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    table[found["byte"].to_numpy()] = found["bits"].to_numpy().astype(np.uint8)
    return table


SEGMENTS = "hi long, lo long, run long, row long, word int, bytes long, text binary"


def _send(shared: Broadcast, window: int):
    """The segments whose run may repeat; single windows where it stands in very many places."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, crowded = shared.value
        sent: set[bytes] = set()
        rows: list[tuple] = []

        def add(run: int, row: int, word: int, text: bytes) -> None:
            digest = xxhash.xxh3_128_digest(text)
            new = digest not in sent
            if new:
                if len(sent) >= SENT:
                    sent.clear()
                sent.add(digest)
            rows.append((digest, run, row, word, len(text), text if new else None))

        def flush() -> pa.RecordBatch:
            digest, run, row, word, size, text = zip(*rows, strict=True)
            halves = np.frombuffer(b"".join(digest), dtype=">i8").astype(np.int64).reshape(-1, 2)
            rows.clear()
            return pa.RecordBatch.from_arrays([
                pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(run, pa.int64()), pa.array(row, pa.int64()),
                pa.array(word, pa.int32()), pa.array(size, pa.int64()), pa.array(text, pa.binary()),
            ], [c.split()[0] for c in SEGMENTS.split(", ")])

        for batch in batches:
            numbers = batch.column(batch.schema.get_field_index("row")).to_pylist()
            texts = column_bytes(batch, "text")
            for at, group in words.by_text(texts):
                for k, values in enumerate(group, start=at):
                    run, first, size, _ = segments(values, window)
                    run = run.view(np.int64)
                    bit = _bits(run)
                    stay = np.flatnonzero((table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
                    if not len(stay):
                        continue
                    start, end = _spans(texts[k])
                    place = np.minimum(np.searchsorted(crowded, run[stay]), max(len(crowded) - 1, 0))
                    single = crowded[place] == run[stay] if len(crowded) else np.zeros(len(stay), bool)
                    for j, cut in zip(stay.tolist(), single.tolist(), strict=True):
                        a, n = int(first[j]), int(size[j])
                        if cut:
                            for w in range(a, a + n):
                                text = b" ".join(texts[k][start[w] : end[w + window - 1]].split())
                                add(xxhash.xxh3_64_intdigest(text) - (1 << 63), numbers[k], w, text)
                        else:
                            add(int(run[j]), numbers[k], a, texts[k][start[a] : end[a + n + window - 2]])
                    if len(rows) >= 20_000:
                        yield flush()
        if rows:
            yield flush()

    return send


def _spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte places where the words of a text begin and end, found piece by piece."""
    starts, ends, at = [], [], 0
    for piece in words.pieces(text):
        _, start, end, _ = words.spans([piece], words.SPACED)
        starts.append(start + at)
        ends.append(end + at)
        at += len(piece)
    return np.concatenate(starts), np.concatenate(ends)


def stretches(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """(first word, word after the last) of the words that windows at ``starts`` (rising) cover."""
    if not len(starts):
        return []
    gap = np.flatnonzero(starts[1:] - starts[:-1] > window)
    first = starts[np.concatenate(([0], gap + 1))]
    last = starts[np.concatenate((gap, [len(starts) - 1]))] + window
    return list(zip(first.tolist(), last.tolist(), strict=True))


def _search(window: int):
    """Stretches of one shard's segments whose windows stand in two places or more."""

    def search(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        digests = list(zip(parts.column("hi").to_pylist(), parts.column("lo").to_pylist(), strict=True))
        places = {d: n for d, n in zip(digests, parts.column("places").to_pylist(), strict=True) if n is not None}
        bodies = {d: text.as_buffer() for d, text in zip(digests, parts.column("text"), strict=True) if text.is_valid}
        digests = list(bodies)
        sequences = [
            np.array([number.setdefault(w, len(number) + 1) for w in bytes(text).split()], np.int64) for text in bodies.values()
        ]
        found = FMIndex(sequences, np.array([places[d] for d in digests], np.int64), window).repeated(2)
        hit = [k for k, starts in enumerate(found) if len(starts)]
        spans = [[{"first": a, "last": b} for a, b in stretches(found[k], window)] for k in hit]
        return pa.table({
            "hi": pa.array([digests[k][0] for k in hit], pa.int64()), "lo": pa.array([digests[k][1] for k in hit], pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))})

    return search


def repeated_spans(texts: DataFrame, window: int) -> DataFrame:
    """(row, spans) of the texts (row, text as bytes) that hold repeated windows: stretches of covered words, in any order.

    ``texts`` must be a written table, because it is read more than once.
    """
    spark = texts.sparkSession
    texts = texts.select("row", "text")
    counted = texts.mapInArrow(_places(window), "run long, places long").groupBy("run").agg(F.sum("places").alias("places"))
    repeated = kept(counted.filter(F.col("places") > 1), "repeated-runs")
    total = repeated.agg(F.sum("places")).first()[0] or 0
    crowd = max(CROWD, int(CROWD_SHARE * total))
    crowded = repeated.filter(F.col("places") >= crowd).select("run").toArrow()["run"].to_numpy()
    shared = spark.sparkContext.broadcast((_table(repeated), np.sort(crowded)))
    sent = kept(texts.mapInArrow(_send(shared, window), SEGMENTS), "segments")

    # texts are dealt to the shards once, next to one row of each segment that says in how many places it stands
    weights = sent.groupBy("hi", "lo", "run").agg(F.count("*").alias("places"))
    bodies = sent.filter(F.col("text").isNotNull())
    size = bodies.agg(F.sum("bytes")).first()[0] or 0
    both = weights.withColumn("text", F.lit(None).cast("binary")).unionByName(
        bodies.select("hi", "lo", "run", F.lit(None).cast("long").alias("places"), "text")
    )
    shards = 1 + size // SHARD_BYTES
    dealt = both.select(F.pmod(F.xxhash64("run"), F.lit(shards)).alias("shard"), "hi", "lo", "places", "text")
    spans = "array<struct<first:int,last:int>>"
    found = kept(dealt.groupBy("shard").applyInArrow(_search(window), f"hi long, lo long, spans {spans}"), "repeated-stretches")
    back = sent.select("hi", "lo", "row", "word").join(found, ["hi", "lo"])
    moved = F.transform("spans", lambda s: F.struct((s["first"] + F.col("word")).alias("first"), (s["last"] + F.col("word")).alias("last")))
    return back.groupBy("row").agg(F.flatten(F.collect_list(moved)).alias("spans"))


def cut(text: bytes, spans: list[dict] | None) -> tuple[int, list[bytes]]:
    """(number of words, words outside the spans)."""
    found = text.split()
    if not spans:
        return len(found), found
    edge = np.zeros(len(found) + 1, np.int64)
    np.add.at(edge, [s["first"] for s in spans], 1)
    np.add.at(edge, [s["last"] for s in spans], -1)
    return len(found), [found[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, removed, digests = [], [], []
        for text, spans in zip(column_bytes(batch, "text"), batch.column(2).to_pylist(), strict=True):
            n, stay = cut(text, spans)
            total.append(n)
            removed.append(n - len(stay))
            digests.append(hashlib.sha256(b" ".join(stay)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [
            b" ".join(cut(text, spans)[1]) for text, spans in zip(column_bytes(batch, "text"), batch.column(2).to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc", "text"])


def repeat_report(docs: DataFrame, window: int = 35) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 of the words that stay."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = numbered_texts(docs, payload("text"))
    met = texts.join(repeated_spans(texts, window), "row", "left")
    return met.select("doc_id", "text", "spans").mapInArrow(
        _digest, f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string"
    )


def without_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """The rows of ``docs`` with their texts less repeated passages, words joined by one space.

    Texts that lose nothing and null texts stay as they are; n_chars, where there is one, follows the text.
    """
    rows = numbered(docs)
    spans = repeated_spans(texts_of(rows, payload("doc.text")), window)
    met = rows.join(spans, "row", "left")
    out = met.filter(F.col("spans").isNotNull()).select("doc", payload("doc.text").alias("text"), "spans").mapInArrow(
        _rewrite, f"doc {met.schema['doc'].dataType.simpleString()}, text binary"
    )
    text = F.col("text").cast("string")
    new = {"text": text, "n_chars": F.length(text).cast(dict(docs.dtypes).get("n_chars", "long"))}
    changed = out.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
    same = met.filter(F.col("spans").isNull()).select(*[F.col("doc")[c].alias(c) for c in docs.columns])
    return same.unionByName(changed)
