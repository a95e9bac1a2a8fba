"""Exact top-k inner products with block-at-a-time pruning.

Vectors become integers and are laid out in ranges; a range is cut into blocks, and each block keeps, next to its
forward index (the vectors themselves), the largest and the least value of every term (component). What a query can
reach in a block is at most the sum of its terms times those maxima. Per query the blocks of a range are taken by
falling bound and scored from their forward index until the bound lies below the k-th score so far. Every range
gives its k best per query, and the best k of all ranges are the result.

Defined cases: a vector that is null or holds a null or non-finite component takes no part, nor does a row without
an id. Vectors of different length are compared on their common components. Repeated rows are candidates and
queries of their own; only the query's own row is left out. Fewer candidates than k give fewer rows. Scores beyond
a long are held at its ends. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.jobfolder import kept

RANGE_ROWS = 8192
BLOCK_ROWS = 128
#: Queries that meet a range at once.
QUERY_ROWS = 2048

RANGES = "part long, dims int, ids binary, vectors binary, query_rows binary"
HITS = "query_row long, query_id long, vec_id long, score long"


def _range_row(part: int, ids: list[int], vectors: list[list[int]], every: int) -> pa.RecordBatch:
    dims = max(len(v) for v in vectors)
    matrix = np.zeros((len(ids), dims), np.int64)
    for k, v in enumerate(vectors):
        matrix[k, : len(v)] = v
    ids_ = np.array(ids, np.int64)
    queries = np.flatnonzero(ids_ % every == 0)
    return pa.RecordBatch.from_arrays(
        [pa.array([part]), pa.array([dims], pa.int32()), pa.array([ids_.tobytes()]), pa.array([matrix.tobytes()]),
         pa.array([queries.astype(np.int64).tobytes()])],
        ["part", "dims", "ids", "vectors", "query_rows"],
    )


def lay_out(vectors: DataFrame, scale: int = 64, every: int = 20, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Ranges of up to ``range_rows`` integer vectors, one row each, kept in the shared folder.

    Neighbours in a range share their strongest term, which makes the blocks' maxima tighter; ``query_rows`` are
    the places of the vectors whose id is divisible by ``every``.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")).alias("v"),
    )
    size = F.transform("v", lambda x: F.abs(x.cast("double")))
    strongest = F.array_position(size, F.array_max(size)).alias("lead")
    rows = rows.select("vec_id", "v", strongest)
    count = rows.count()
    parts = max(1, -(-count // range_rows))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        ids, held = [], []
        for batch in batches:
            for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(vec_id)
                held.append(v)
                if len(ids) == range_rows:
                    yield _range_row(part, ids, held, every)
                    part, ids, held = part + 1, [], []
        if ids:
            yield _range_row(part, ids, held, every)

    dealt = rows.repartitionByRange(parts, "lead", "vec_id", F.xxhash64("v")).sortWithinPartitions("lead", "vec_id", "v")
    return kept(dealt.select("vec_id", "v").mapInArrow(gather, RANGES), "vector-ranges")


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["vectors"], np.int64).reshape(len(ids), row["dims"])


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer a @ b.T, exact: by floating point where it can't round, by big integers where a long can't hold it."""
    reach = np.abs(a.astype(float)).max(initial=0) * np.abs(b.astype(float)).max(initial=0) * max(1, a.shape[1])
    if reach < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if reach < 2**63:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best_in_range(
    queries: np.ndarray, own: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, block_rows: int = BLOCK_ROWS
) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, places) of each query's k best vectors of a range, -1 where there are fewer; blocks scored.

    ``own``: the place of the query's own row in this range, -1 if it is elsewhere. Ties go to the smaller id.
    """
    dims = min(queries.shape[1], vectors.shape[1])
    queries, vectors = queries[:, :dims], vectors[:, :dims]
    starts = np.arange(0, len(ids), block_rows)
    most, least = np.maximum.reduceat(vectors, starts), np.minimum.reduceat(vectors, starts)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    # the sum of two clipped halves is a bound as well; products beyond a long leave nothing to prune
    bounds = up.astype(float) @ most.T.astype(float) - (-down).astype(float) @ least.T.astype(float)
    bounds += 1e-6 * np.abs(bounds) + 1e-6
    order = np.argsort(-bounds, axis=1, kind="stable")
    n = len(queries)
    scores = np.full((n, k), np.iinfo(np.int64).min)
    places = np.full((n, k), -1)
    going, scored = np.arange(n), 0
    for turn in range(len(starts)):
        block = order[going, turn]
        # a bound equal to the k-th score may still hide a smaller id
        open_ = (places[going, -1] < 0) | (bounds[going, block] >= scores[going, -1])
        going, block = going[open_], block[open_]
        if not len(going):
            break
        for b in np.unique(block):
            mine = going[block == b]
            at = np.arange(starts[b], min(starts[b] + block_rows, len(ids)))
            got = _product(queries[mine], vectors[at])
            scored += len(mine)
            place = np.where(own[mine][:, None] == at[None, :], -1, at[None, :])
            all_scores = np.concatenate([scores[mine], got], axis=1)
            all_places = np.concatenate([places[mine], place], axis=1)
            vec = np.where(all_places < 0, np.iinfo(np.int64).max, ids[all_places])
            all_scores = np.where(all_places < 0, np.iinfo(np.int64).min, all_scores)
            rank = np.lexsort((all_places, vec, -np.maximum(all_scores, -(2**63) + 1), all_places < 0), axis=1)[:, :k]
            scores[mine] = np.take_along_axis(all_scores, rank, axis=1)
            places[mine] = np.take_along_axis(all_places, rank, axis=1)
    return scores, places, scored


def _searcher(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, vectors = _unpack(row)
                queries = np.frombuffer(row["q_vectors"], np.int64).reshape(-1, row["q_dims"])
                q_ids, q_rows = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_rows"], np.int64)
                own = q_rows if row["q_part"] == row["part"] else np.full(len(q_rows), -1)
                scores, places, _ = best_in_range(queries, own, ids, vectors, k)
                at, rank = np.nonzero(places >= 0)
                yield pa.RecordBatch.from_arrays([
                    pa.array((row["q_part"] >> 32 << 40) + ((row["q_part"] & 0xFFFFFFFF) << 20) + q_rows[at]),
                    pa.array(q_ids[at]), pa.array(ids[places[at, rank]]), pa.array(scores[at, rank]),
                ], ["query_row", "query_id", "vec_id", "score"])

    return search


def _query_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, vectors = _unpack(row)
            rows = np.frombuffer(row["query_rows"], np.int64)
            for at in range(0, len(rows), QUERY_ROWS):
                part = rows[at : at + QUERY_ROWS]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["part"]]), pa.array([row["dims"]], pa.int32()), pa.array([part.tobytes()]),
                    pa.array([ids[part].tobytes()]), pa.array([vectors[part].tobytes()]),
                ], ["q_part", "q_dims", "q_rows", "q_ids", "q_vectors"])


def nearest(vectors: DataFrame, k: int = 20, scale: int = 64, every: int = 20, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The k highest inner products of each query: query_id, rank (from 1), vec_id, score."""
    ranges = lay_out(vectors, scale, every, range_rows)
    parts = (ranges.agg(F.max(F.shiftright("part", 32))).first()[0] or 0) + 1
    chunks = ranges.filter(F.octet_length("query_rows") > 0).mapInArrow(
        _query_chunks, "q_part long, q_dims int, q_rows binary, q_ids binary, q_vectors binary"
    )
    # each chunk of queries is sent to each range: the stated query set against all rows, in blocks
    meetings = chunks.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")))
    pairs = meetings.join(ranges.withColumn("place", F.shiftright("part", 32)), "place").drop("query_rows")
    tasks = max(1, min(parts**2, 4 * vectors.sparkSession.sparkContext.defaultParallelism))
    hits = pairs.repartition(tasks, "part", "q_part").mapInArrow(_searcher(k), HITS)
    ranked = Window.partitionBy("query_row", "query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
