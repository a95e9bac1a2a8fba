"""Idempotent ingest: each record once, however late it is delivered again and however often a batch runs.

Ids that were taken in are kept in runs, tables of sorted ids. A batch adds a run on level 0; ``fan_in`` runs of a
level are merged into one of the next, so that a batch meets few runs and each id is rewritten a logarithm of times.
A commit names the runs and the output of its batch; it is one small file, renamed into place after both are written.
What no commit names does not count: a batch that was lost midway writes its folders again, one that was committed and
runs again does nothing. Records without an id are taken in once a batch.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.sources.captionfiles import file_system


@dataclass
class Ingest:
    """The store below ``folder``; ``key`` is the id column. One stream writes to it at a time."""

    folder: str
    key: str = "event_id"
    fan_in: int = 4

    def last_commit(self) -> dict:
        """The newest commit: its batch, and the live runs as [level, name]; batch -1 before the first one."""
        fs, root = file_system(self.folder)
        found = fs.get_file_info(pafs.FileSelector(f"{root}/commits", allow_not_found=True))
        names = [f.path for f in found if f.base_name.endswith(".json")]
        if not names:
            return {"batch": -1, "runs": []}
        with fs.open_input_stream(max(names)) as source:
            return json.loads(source.read())

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Take in a batch; for ``foreachBatch``, which may call it again with the same batch."""
        before = self.last_commit()
        if batch_id <= before["batch"]:
            return
        spark = batch.sparkSession
        once = batch.dropDuplicates([self.key]).persist()
        out = f"{self.folder}/rows/batch={batch_id}"
        once.join(self._seen(spark, before["runs"], once), self.key, "left_anti").write.mode("overwrite").parquet(out)
        once.unpersist()
        added = spark.read.schema(batch.schema).parquet(out).select(self.key)
        runs = [*before["runs"], [0, self._write(added, f"0-{batch_id}")]]
        self._commit({"batch": batch_id, "runs": self._compacted(spark, runs, batch_id, added.schema)})

    def rows(self, spark: SparkSession) -> DataFrame:
        """Everything that was committed, each record once."""
        last = self.last_commit()["batch"]
        return spark.read.parquet(f"{self.folder}/rows").filter(F.col("batch") <= last).drop("batch")

    def _seen(self, spark: SparkSession, runs: list, batch: DataFrame) -> DataFrame:
        """The batch's ids that some run holds: runs are sorted, so ids out of the batch's range are not read."""
        ids = batch.select(self.key)
        low, high = ids.agg(F.min(self.key), F.max(self.key)).first()
        if not runs or low is None:
            return ids.limit(0)
        paths = [f"{self.folder}/runs/{name}" for _, name in runs]
        known = spark.read.schema(ids.schema).parquet(*paths).filter(F.col(self.key).between(low, high))
        return known.join(ids, self.key, "left_semi")

    def _write(self, ids: DataFrame, name: str) -> str:
        ids.repartitionByRange(self.key).sortWithinPartitions(self.key).write.mode("overwrite").parquet(f"{self.folder}/runs/{name}")
        return name

    def _compacted(self, spark: SparkSession, runs: list, batch_id: int, schema) -> list:
        level = 0
        while len(full := [name for at, name in runs if at == level]) >= self.fan_in:
            ids = spark.read.schema(schema).parquet(*[f"{self.folder}/runs/{name}" for name in full])
            merged = self._write(ids, f"{level + 1}-{batch_id}")
            runs = [r for r in runs if r[0] != level] + [[level + 1, merged]]
            level += 1
        return runs

    def _commit(self, commit: dict) -> None:
        fs, root = file_system(self.folder)
        fs.create_dir(f"{root}/commits", recursive=True)
        draft = f"{root}/commits/{uuid.uuid4().hex}.draft"
        with fs.open_output_stream(draft) as out:
            out.write(json.dumps(commit).encode())
        fs.move(draft, f"{root}/commits/{commit['batch']:020d}.json")

    def run(self, records: DataFrame) -> None:
        """Take in what a stream has now."""
        query = (
            records.writeStream.foreachBatch(self.add).option("checkpointLocation", f"{self.folder}/checkpoint")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
