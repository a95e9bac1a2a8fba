"""Package folders as a Spark sink: many named files a task, checksums as they are written, the manifest last.

Rows are pieces of files, ``(project_id, language, clip_index, kind, name, place, content, sha256)``. A task writes
each file as its pieces come, to a draft that is renamed when the file is whole, and hashes it on the way. A row
without content refers to media that lie elsewhere: it is listed under its given hash and nothing is written. Each
task lists what it wrote in a part of the manifest; the driver, which sees the parts' names only, commits them by one
small file after all tasks. A job that was killed leaves no manifest, and parts of repeated attempts are not in it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from cuelake.sources.captionfiles import file_system

MANIFEST = "package-manifest.json"
FILE_KEYS = ["project_id", "language", "name"]
PIECES = (
    "project_id string, language string, clip_index int, kind string, name string, place long, content string, sha256 string"
)
LISTED = "project_id string, language string, clip_index int, kind string, path string, bytes long, sha256 string"


@dataclass
class Part(WriterCommitMessage):
    """The part of the manifest that a task wrote; null for a task without rows."""

    name: str | None


class _Draft:
    """One file being written."""

    def __init__(self, fs, folder: str, row: dict):
        self.fs, self.row = fs, row
        self.path = f"{row['project_id']}/packages/{row['language']}/{row['name']}"
        self.final = f"{folder}/{self.path}"
        self.draft = f"{self.final}.{uuid.uuid4().hex}.draft"
        fs.create_dir(self.final.rsplit("/", 1)[0], recursive=True)
        self.out, self.bytes, self.digest = fs.open_output_stream(self.draft), 0, hashlib.sha256()

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.digest.update(data)
        self.bytes += len(data)

    def close(self) -> dict:
        self.out.close()
        self.fs.move(self.draft, self.final)
        return _entry(self.row, self.path, self.bytes, self.digest.hexdigest())

    def drop(self) -> None:
        self.out.close()
        self.fs.delete_file(self.draft)


def _entry(row: dict, path: str | None, size: int | None, digest: str | None) -> dict:
    return {k: row[k] for k in ("project_id", "language", "clip_index", "kind")} | {"path": path, "bytes": size, "sha256": digest}


class PackageWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        # a run writes below a folder of its own: files of an earlier run stay whole until the new list stands
        self.root, self.run = options["path"], f"run-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = file_system(self.root)
        folder, entries, draft, key = f"{root}/{self.run}", [], None, None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    own = tuple(row[k] for k in FILE_KEYS)
                    if draft is not None and own != key:
                        entries.append(draft.close())
                        draft = None
                    key = own
                    if row["content"] is None:
                        entries.append(_entry(row, None, None, row["sha256"]))
                        continue
                    draft = draft or _Draft(fs, folder, row)
                    draft.write(row["content"].encode())
            if draft is not None:
                entries.append(draft.close())
                draft = None
        finally:
            if draft is not None:
                draft.drop()
        if not entries:
            return Part(None)
        name = f"{self.run}/_manifest/part-{uuid.uuid4().hex}.json"
        fs.create_dir(f"{folder}/_manifest", recursive=True)
        with fs.open_output_stream(f"{root}/{name}") as out:
            out.write("".join(json.dumps(e, ensure_ascii=False) + "\n" for e in entries).encode())
        return Part(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = file_system(self.root)
        fs.create_dir(root, recursive=True)
        draft = f"{root}/{MANIFEST}.{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as out:
            out.write(json.dumps({"run": self.run, "parts": [m.name for m in messages if m is not None and m.name]}).encode())
        fs.move(draft, f"{root}/{MANIFEST}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Nothing to take back: without a manifest the run's folder is not a package."""


class PackageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packages"

    def schema(self) -> str:
        return PIECES

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return PackageWriter(self.options)


def write_packages(pieces: DataFrame, folder: str) -> None:
    """Write all files; pieces of one file are joined by ``place``. A large project's files are dealt over tasks."""
    pieces.sparkSession.dataSource.register(PackageFiles)
    columns = [F.col(f.split()[0]).cast(f.split()[1]).alias(f.split()[0]) for f in PIECES.split(", ")]
    rows = pieces.select(*columns).repartition(*FILE_KEYS).sortWithinPartitions(*FILE_KEYS, "place")
    rows.write.format("packages").mode("append").save(folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """What the last finished run wrote, a row a deliverable; paths are below ``folder/<run>``."""
    fs, root = file_system(folder)
    with fs.open_input_stream(f"{root}/{MANIFEST}") as source:
        parts = json.loads(source.read())["parts"]
    if not parts:
        return spark.createDataFrame([], LISTED)
    return spark.read.schema(LISTED).json([f"{folder.rstrip('/')}/{p}" for p in parts])
