"""Where operators of this subpackage keep what a later stage reads, and how they take their columns."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.session import ensure_checkpoint_dir, shared_dir


#: Rows of whole numbers from which a small table takes a further partition.
ROWS_TOGETHER = 100_000


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Python functions get ``rows`` rows at once at most in what runs inside; None leaves their number as it is.

    Spark holds a batch of texts outside its heap.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if rows is not None:
        spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def kept(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """The rows written once into the shared folder and read from there: lineage ends here.

    batch_rows: most rows that go to a Python function at once meanwhile.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    with batches_of(spark, batch_rows):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove a table that ``kept`` wrote, once nothing will read it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def together(df: DataFrame, rows: int, each: int = ROWS_TOGETHER) -> DataFrame:
    """A table of about ``rows`` small rows in as few partitions as its size asks for, without a shuffle of its own.

    Every round over a small table costs a task, files and a log entry for each partition, whatever is in it.
    """
    return df.coalesce(max(1, -(-rows // each)))


def cut(df: DataFrame) -> DataFrame:
    """``checkpoint`` in the shared folder; Spark's cleaner removes it when nothing refers to it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def remainder(doc_id: str | Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(divisor)


def payload(column: str) -> Column:
    """A text column's UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def lowered(column: str) -> Column:
    """The bytes of a text column in lower case, accented letters included, null as empty."""
    return F.coalesce(F.lower(F.col(column).cast("string")).cast("binary"), F.lit(b""))


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text or binary column of a batch as bytes, null as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc): each row as a struct next to its number, written once into the shared folder.

    Numbers follow the splits of a reading, and splits change when executors come and go; so what an operator finds
    about ``row`` is brought back to this copy and to no second reading of ``docs``.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    return kept(rows, "numbered-documents")


def numbered_texts(docs: DataFrame, text: Column) -> DataFrame:
    """(row, doc_id, text): each row's id and a form of its text next to its number, written once like ``numbered``."""
    return kept(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text")), "numbered-texts")


def texts_of(rows: DataFrame, text: Column) -> DataFrame:
    """(row, doc_id, text) of a numbered table; ``text`` may name columns of ``doc``."""
    return rows.select("row", F.col("doc.doc_id").alias("doc_id"), text.alias("text"))
