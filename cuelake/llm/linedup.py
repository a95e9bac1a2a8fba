"""Drop lines that many documents share, from a store of line hashes in levelled sorted runs.

A run is a table of (line hash, documents that hold it), sorted by hash within its files. Level 0 takes the runs of
new batches; when a level has ``fan_in`` runs they are merged into one run of the next level. Keys that have
reached the bar move to the settled runs: each new batch merge-anti-joins those, so that the most common lines are
neither counted nor stored again, and adds its own run. Settled hashes are dropped from every document by a last
join on line places.

Defined cases: a null or empty text is one empty line. A row is a document, also where ids repeat; a null id is an
id. A line is its UTF-8 bytes between \\n; its key is stripped of blanks ([\\x20\\x09-\\x0D]) at both ends and has A-Z
lower-cased. Keys under ``least_chars`` code points always stay. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.jobfolder import column_bytes, kept, new_folder, numbered, numbered_texts, payload, texts_of

HASH = ["hi", "lo"]
LINES = "hi long, lo long, row long, line int"


def key_of(line: bytes) -> bytes:
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def _long_enough(key: bytes, least_chars: int) -> bool:
    if len(key) < least_chars:
        return False
    return least_chars <= 1 or len(key) - sum(b & 0xC0 == 0x80 for b in key) >= least_chars


def _lines(least_chars: int):
    """Rows (hash, row number, line number) of the first line of each key in each text."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index("row")).to_pylist()
            seen: dict[bytes, int] = {}
            digests, owners, places = [], [], []
            for row, text in zip(rows, column_bytes(batch, "text"), strict=True):
                seen.clear()
                for place, line in enumerate(text.split(b"\n")):
                    key = key_of(line)
                    if key not in seen and _long_enough(key, least_chars):
                        seen[key] = place
                        digests.append(xxhash.xxh3_128_digest(key))
                        owners.append(row)
                        places.append(place)
                if len(owners) >= 200_000:
                    yield _line_batch(digests, owners, places)
                    digests, owners, places = [], [], []
            if owners:
                yield _line_batch(digests, owners, places)

    return explode


def _line_batch(digests: list[bytes], owners: list[int], places: list[int]) -> pa.RecordBatch:
    halves = np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays(
        [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(owners, pa.int64()), pa.array(places, pa.int32())],
        ["hi", "lo", "row", "line"],
    )


def distinct_lines(texts: DataFrame, least_chars: int = 1) -> DataFrame:
    """(hi, lo, row, line): each text's keys once, at their first line."""
    return texts.select("row", "text").mapInArrow(_lines(least_chars), LINES)


@dataclass
class LineRuns:
    """The store. ``add`` takes batches in turn; ``settled`` gives the keys that reached ``min_docs`` documents."""

    spark: SparkSession
    min_docs: int = 10
    fan_in: int = 4
    levels: list[list[DataFrame]] = field(default_factory=list)
    settled_runs: list[DataFrame] = field(default_factory=list)

    def add(self, lines: DataFrame) -> None:
        """Add a batch of (hi, lo, one row a document)."""
        for run in self.settled_runs:
            lines = lines.join(run, HASH, "left_anti")
        counts = lines.groupBy(*HASH).agg(F.count("*").alias("docs"))
        self._put(0, self._write(counts))

    def _write(self, run: DataFrame) -> DataFrame:
        path = new_folder(self.spark, "line-run")
        run.sortWithinPartitions(*HASH).write.parquet(path)
        return self.spark.read.schema("hi long, lo long, docs long").parquet(path)

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_in:
            self._compact(level)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        union = runs[0]
        for run in runs[1:]:
            union = union.unionByName(run)
        return union.groupBy(*HASH).agg(F.sum("docs").alias("docs"))

    def _compact(self, level: int) -> None:
        """Merge the runs of all levels up to ``level``; what reached the bar is settled, the rest moves up."""
        runs = [run for below in self.levels[: level + 1] for run in below]
        merged = self._write(self._merged(runs))
        for below in self.levels[: level + 1]:
            below.clear()
        # a settled key is one whose counts all came together here: it is counted nowhere else from now on
        self.settled_runs.append(merged.filter(F.col("docs") >= self.min_docs).select(*HASH))
        self._put(level + 1, merged.filter(F.col("docs") < self.min_docs))

    def settled(self) -> DataFrame:
        """(hi, lo) of every key found in at least ``min_docs`` documents, each once."""
        open_runs = [run for level in self.levels for run in level]
        found = list(self.settled_runs)
        if open_runs:
            found.append(self._merged(open_runs).filter(F.col("docs") >= self.min_docs).select(*HASH))
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out


def split_by_keys(text: bytes, drop: list[int] | None) -> tuple[int, list[bytes]]:
    """(number of lines, lines that stay): ``drop`` names the first line of each key that goes."""
    lines = text.split(b"\n")
    if not drop:
        return len(lines), lines
    keys = {key_of(lines[k]) for k in drop}
    return len(lines), [line for line in lines if key_of(line) not in keys]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        drops = batch.column(batch.schema.get_field_index("drop")).to_pylist()
        total, dropped, digests = [], [], []
        for text, drop in zip(column_bytes(batch, "text"), drops, strict=True):
            n, stay = split_by_keys(text, drop)
            total.append(n)
            dropped.append(n - len(stay))
            digests.append(hashlib.sha256(b"\n".join(stay)).hexdigest())
        yield pa.RecordBatch.from_arrays([
            batch.column(batch.schema.get_field_index("doc_id")), pa.array(total, pa.int64()),
            pa.array(dropped, pa.int64()), pa.array(digests, pa.string()),
        ], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        drops = batch.column(batch.schema.get_field_index("drop")).to_pylist()
        texts = [b"\n".join(split_by_keys(t, d)[1]) for t, d in zip(column_bytes(batch, "text"), drops, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("doc")), pa.array(texts, pa.binary())], ["doc", "text"]
        )


def common_keys(texts: DataFrame, min_docs: int, least_chars: int, batches: int, fan_in: int) -> DataFrame:
    """(hi, lo) of the keys in at least ``min_docs`` of the numbered texts, gathered batch by batch."""
    store = LineRuns(texts.sparkSession, min_docs, fan_in)
    for k in range(batches):
        part = texts.filter(F.pmod(F.xxhash64("row"), F.lit(batches)) == k)
        store.add(distinct_lines(part, least_chars))
    return kept(store.settled(), "common-lines")


def _drops(rows: DataFrame, min_docs: int, least_chars: int, batches: int, fan_in: int) -> DataFrame:
    """(row, drop): first lines of the keys that go, for those of the numbered texts that hold some."""
    common = common_keys(rows, min_docs, least_chars, batches, fan_in)
    hits = distinct_lines(rows, least_chars).join(common, HASH, "left_semi")
    return hits.groupBy("row").agg(F.collect_list("line").alias("drop"))


def line_report(
    docs: DataFrame, min_docs: int = 10, least_chars: int = 1, batches: int = 4, fan_in: int = 3
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256 of the text that stays.

    batches: in how many turns the table enters the store. fan_in: runs on a level that are merged into one.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = numbered_texts(docs, payload("text"))
    met = texts.join(_drops(texts, min_docs, least_chars, batches, fan_in), "row", "left")
    return met.select("doc_id", "text", "drop").mapInArrow(
        _digest, f"doc_id {id_type}, n_lines long, n_dropped long, kept_sha256 string"
    )


def without_common_lines(
    docs: DataFrame, min_docs: int = 10, least_chars: int = 1, batches: int = 4, fan_in: int = 3
) -> DataFrame:
    """The rows of ``docs`` with what stays of their texts; n_chars, where there is one, follows the text.

    A null text stays null.
    """
    rows = numbered(docs)
    met = rows.join(_drops(texts_of(rows, payload("doc.text")), min_docs, least_chars, batches, fan_in), "row", "left")
    doc_type = met.schema["doc"].dataType.simpleString()
    out = met.select("doc", payload("doc.text").alias("text"), "drop").mapInArrow(_rewrite, f"doc {doc_type}, text binary")
    text = F.when(F.col("doc.text").isNotNull(), F.col("text").cast("string"))
    new = {"text": text, "n_chars": F.length(text).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return out.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
