"""SRT and WebVTT files as a Spark data source: ``spark.read.format("captions")`` and ``df.write.format("captions")``.

Writing: rows ``(project_id, language, cue_id, block)`` that lie together per track and in cue order. A task appends
the tracks it meets to one file until the file is full, and notes beside it where each track lies and its SHA-256,
taken as it is written. The list of files is written last, from the tasks' messages, so a job that was killed leaves
no readable output, and files of repeated attempts are not in the list.

Reading: rows ``(project_id, language, block)``, one a cue. Files are read in byte ranges; a range owns the cues that
begin in it and finds its first one by itself, whatever it begins in the middle of. Folders without a list are taken
as plain caption files, one track each: ``<project>/captions/<name>.<language>.srt``.

Options: ``format`` (srt or vtt), ``file_bytes`` and ``range_bytes`` (about how large files and ranges get).
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FILE_BYTES = 256 << 20
RANGE_BYTES = 16 << 20
FILE_LIST = "_files.json"
#: Bytes before a range that show whether its first byte begins a line after an empty one.
LOOK_BACK = 4
BATCH_CUES = 10_000

CLOCK = rb"(?:\d+:)?\d{2}:\d{2}[,.]\d{3}[ \t]+-->[ \t]+"
AFTER_BLANK = rb"(?:\A(?:\xef\xbb\xbf)?|(?<=\n\n)|(?<=\n\r\n))"
BEGIN = {
    "srt": re.compile(AFTER_BLANK + rb"\d+[ \t]*\r?\n" + CLOCK),
    "vtt": re.compile(AFTER_BLANK + rb"(?:[^\n]*\S[^\n]*\n)?" + CLOCK),
}
#: A WebVTT cue ends with an empty line; what follows up to the next cue is a comment or a style.
BLANK = re.compile(rb"\r?\n\r?\n")
VTT_HEAD = b"WEBVTT\n\n"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system that holds a folder, local paths without a scheme included."""
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    """Data files of one task, with their sizes."""

    files: list[tuple[str, int]]


class _OpenFile:
    """A file that takes tracks one after the other, and the places of these tracks."""

    def __init__(self, fs: pafs.FileSystem, folder: str, fmt: str):
        self.fs, self.name = fs, f"captions-{uuid.uuid4().hex}.{fmt}"
        self.path = f"{folder}/{self.name}"
        self.out, self.at, self.fmt = fs.open_output_stream(self.path), 0, fmt
        self.tracks: list[dict] = []
        self.digest = hashlib.sha256()

    def begin(self, project_id: str, language: str) -> None:
        self.end()
        self.tracks.append({"project_id": project_id, "language": language, "at": self.at, "cues": 0})
        self.digest = hashlib.sha256()
        if self.fmt == "vtt":
            self.write(VTT_HEAD, 0)

    def write(self, data: bytes, cues: int) -> None:
        self.out.write(data)
        self.digest.update(data)
        self.at += len(data)
        self.tracks[-1]["cues"] += cues

    def end(self) -> None:
        if self.tracks:
            last = self.tracks[-1]
            last["bytes"], last["sha256"] = self.at - last["at"], self.digest.hexdigest()

    def close(self) -> tuple[str, int]:
        self.end()
        self.out.close()
        with self.fs.open_output_stream(f"{self.path}.tracks") as out:
            for track in self.tracks:
                out.write(json.dumps(track).encode() + b"\n")
        return self.name, self.at


class CaptionWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.folder, self.format = options["path"], options.get("format", "srt")
        self.file_bytes, self.overwrite = int(options.get("file_bytes", FILE_BYTES)), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, folder = file_system(self.folder)
        fs.create_dir(folder, recursive=True)
        track, out, done = None, None, []
        for batch in iterator:
            names = [batch.column(batch.schema.get_field_index(c)).cast(pa.string()).to_pylist() for c in ("project_id", "language")]
            blocks = batch.column(batch.schema.get_field_index("block")).cast(pa.binary()).to_pylist()
            keys = list(zip(*names, strict=True))
            cuts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
            for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                if keys[a] != track:
                    track = keys[a]
                    if out is not None and out.at >= self.file_bytes:
                        done.append(out.close())
                        out = None
                    out = out or _OpenFile(fs, folder, self.format)
                    out.begin(*track)
                out.write(b"".join(blocks[a:b]), b - a)
        if out is not None:
            done.append(out.close())
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, folder = file_system(self.folder)
        fs.create_dir(folder, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        if not self.overwrite:
            files = _listed(fs, folder) + files
        # a list under its final name is whole: it is written aside and moved
        draft = f"{folder}/{FILE_LIST}.{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as out:
            out.write(json.dumps(files).encode())
        fs.move(draft, f"{folder}/{FILE_LIST}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, folder = file_system(self.folder)
        for name, _ in (f for m in messages if m is not None for f in m.files):
            for path in (f"{folder}/{name}", f"{folder}/{name}.tracks"):
                if fs.get_file_info(path).type != pafs.FileType.NotFound:
                    fs.delete_file(path)


def _listed(fs: pafs.FileSystem, folder: str) -> list[tuple[str, int]]:
    if fs.get_file_info(f"{folder}/{FILE_LIST}").type == pafs.FileType.NotFound:
        return []
    with fs.open_input_stream(f"{folder}/{FILE_LIST}") as source:
        return [tuple(f) for f in json.loads(source.read())]


@dataclass
class ByteRange(InputPartition):
    path: str
    begin: int
    end: int
    size: int
    listed: bool


class CaptionReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.format = options["path"], options.get("format", "srt")
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[InputPartition]:
        """Byte ranges of the files: the driver sees names and sizes only."""
        fs, folder = file_system(self.folder)
        listed = fs.get_file_info(f"{folder}/{FILE_LIST}").type != pafs.FileType.NotFound
        if listed:
            files = [(f"{folder}/{name}", size) for name, size in _listed(fs, folder)]
        else:
            found = fs.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True))
            # data files of a writer that never committed are no captions
            files = [
                (f.path, f.size) for f in found
                if f.is_file and f.path.endswith(f".{self.format}") and not f.base_name.startswith(("captions-", "_", "."))
            ]
        return [
            ByteRange(path, at, min(at + self.range_bytes, size), size, listed)
            for path, size in sorted(files) for at in range(0, size, self.range_bytes)
        ] or [ByteRange("", 0, 0, 0, False)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        fs, _ = file_system(self.folder)
        starts, names = _tracks(fs, partition)
        with fs.open_input_file(partition.path) as source:
            found = _blocks(source, partition, BEGIN[self.format], BLANK if self.format == "vtt" else None, starts)
            while rows := list(islice(found, BATCH_CUES)):
                owner = np.searchsorted(starts, [at for at, _ in rows], side="right") - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([names[k][0] for k in owner]), pa.array([names[k][1] for k in owner]),
                    pa.array([text.decode("utf-8", "replace") for _, text in rows]),
                ], ["project_id", "language", "block"])


def _tracks(fs: pafs.FileSystem, partition: ByteRange) -> tuple[np.ndarray, list[tuple[str, str]]]:
    """(where tracks begin, their names) of a file: from beside it, or one track named by the path."""
    if partition.listed:
        with fs.open_input_stream(f"{partition.path}.tracks") as source:
            tracks = [json.loads(line) for line in source.read().splitlines()]
        return np.array([t["at"] for t in tracks]), [(t["project_id"], t["language"]) for t in tracks]
    parts = partition.path.split("/")
    name = parts[-1].split(".")
    project = parts[-3] if len(parts) > 2 and parts[-2] == "captions" else parts[-2]
    return np.array([0]), [(project, name[-2] if len(name) > 2 else "")]


def _blocks(
    source, partition: ByteRange, begins: re.Pattern, blank: re.Pattern | None, starts: np.ndarray
) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the cues that begin in the range; the last one may end beyond it."""
    at = max(partition.begin - LOOK_BACK, 0)
    source.seek(at)
    data = source.read(partition.end - at)
    # a cue at the very end of the range is seen by its first lines, which may lie beyond: read on to a further cue
    reach = partition.end
    while reach < partition.size:
        more = source.read(min(1 << 16, partition.size - reach))
        data += more
        reach += len(more)
        if not more or any(at + m.start() >= partition.end for m in begins.finditer(data, max(partition.end - at - LOOK_BACK, 0))):
            break
    places = [m.start() for m in begins.finditer(data) if at == 0 or m.start() >= LOOK_BACK]
    for k, place in enumerate(places):
        absolute = at + place
        if not partition.begin <= absolute < partition.end:
            continue
        stop = places[k + 1] if k + 1 < len(places) else len(data)
        border = np.searchsorted(starts, absolute, side="right")
        if border < len(starts):
            stop = min(stop, int(starts[border]) - at)
        if blank is not None and (gap := blank.search(data, data.find(b"-->", place), stop)):
            stop = gap.end()
        yield absolute, data[place:stop]


def write_captions(blocks: DataFrame, folder: str, fmt: str, **options: int) -> None:
    """Write ``(project_id, language, cue_id, block)``; files follow the size of the rows, not the number of tracks.

    Rows are dealt by ranges of track and cue, so a large track is written by several tasks, in order.
    """
    blocks.sparkSession.dataSource.register(CaptionFiles)
    rows = blocks.select(F.col("project_id").cast("string"), "language", "cue_id", "block")
    keys = ["project_id", "language", "cue_id"]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows.write.format("captions").options(format=fmt, **options).mode("overwrite").save(folder)


def read_captions(spark: SparkSession, folder: str, fmt: str, **options: int) -> DataFrame:
    """``(project_id, language, block)`` of all cues of a folder."""
    spark.dataSource.register(CaptionFiles)
    return spark.read.format("captions").options(format=fmt, **options).load(folder)


class CaptionFiles(DataSource):
    """The data source; register it with ``spark.dataSource.register(CaptionFiles)``."""

    @classmethod
    def name(cls) -> str:
        return "captions"

    def schema(self) -> str:
        return "project_id string, language string, block string"

    def reader(self, schema) -> DataSourceReader:
        return CaptionReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return CaptionWriter(self.options, overwrite)
