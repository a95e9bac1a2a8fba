"""Whiten embeddings: covariance by polarisation over whole numbers, components by ``eigh``.

Each entry c of a vector becomes the whole number x = floor(scale * c) + offset. Each distinct x vector counts once.
With S the sums of n distinct vectors, the squares of n*x - S are summed exactly for every dimension and for the sum
of every two dimensions; the variance of a sum less those of its parts is twice their covariance, so that squares are
all that is added up. Tasks add shifted whole numbers y = x - shift (shift: the mean's nearest whole number) and the
driver, which sees one number a pair of dimensions whatever the rows are, turns them into the exact centred sums with
whole numbers of any length: sum (n*x - S)^2 = n^2 * sum y^2 - n * (sum y)^2.

Defined cases: a null vector, and one that holds a null, NaN or infinite entry, takes no part and is not returned. A
vector of another length than most usable ones (of equally common lengths, the larger) takes no part either; empty
vectors have no component and no row. Repeated rows, also of one id, are all returned and fit once. A null id is an
id. Entries beyond the 64-bit range are an error, as is a deviation beyond it. A component without variance (fewer
distinct vectors than dimensions, constant ones) has no whitened value: null. An empty table gives no rows. Between
equal eigenvalues any rotation is a result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.jobfolder import kept

#: Vectors are worked on this many at a time; rows are sent to Spark in groups of this many.
ROWS = 2048
#: Sums of whole numbers are taken in 64 bits while they surely stay below this, else with whole numbers of any length.
SAFE = 1 << 62
#: An eigenvalue under this share of the largest is rounding, not variance.
FLAT = 1e-12


def _usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of each usable vector, its length, all their entries one after another as doubles)."""
    column = column.cast(pa.list_(pa.float64()))
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), -1), dtype=np.int64)
    entries = column.flatten()
    values = np.asarray(entries.fill_null(float("nan")), dtype=np.float64)
    owner = np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))
    broken = np.bincount(owner[~np.isfinite(values)], minlength=len(sizes)) > 0
    good = (sizes >= 0) & ~broken
    return np.flatnonzero(good), sizes[good], values[good[owner]]


def _whole(values: np.ndarray, scale: int) -> np.ndarray:
    floors = np.floor(values * scale)
    if len(floors) and not np.all(np.abs(floors) < 2.0**62):
        raise OverflowError("an entry is beyond 64 bits")
    return floors.astype(np.int64)


def _packed(row: np.ndarray) -> bytes:
    """A vector of whole numbers in as few bytes an entry as hold it; equal vectors have equal bytes."""
    top = int(np.abs(row).max(initial=0))
    for kind in ("<i1", "<i2", "<i4"):
        if top <= np.iinfo(kind).max:
            return row.astype(kind).tobytes() + kind[-1].encode()
    return row.astype("<i8").tobytes() + b"8"


def _unpacked(code: bytes) -> np.ndarray:
    return np.frombuffer(code[:-1], dtype=f"<i{code[-1:].decode()}").astype(np.int64)


def _encode(scale: int):
    """(vec_id, code): usable vectors as packed whole numbers, without the offset."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, sizes, values = _usable(batch.column(1))
            rows = np.split(_whole(values, scale), np.cumsum(sizes)[:-1]) if len(index) else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(index)), pa.array([_packed(r) for r in rows], pa.binary()), pa.array(sizes, pa.int32())],
                ["vec_id", "code", "size"])

    return encode


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches next to their vectors as a matrix of whole numbers."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            codes = part.column(part.schema.get_field_index("code")).to_pylist()
            if codes:
                yield part, np.stack([_unpacked(c) for c in codes])


def _exact(rows: np.ndarray, bound: int) -> np.ndarray:
    """The matrix with 64-bit numbers if sums of what is multiplied stay below ``bound``, else with numbers of any length."""
    return rows if bound < SAFE else rows.astype(object)


def _top(rows: np.ndarray) -> int:
    """The largest absolute value, as a number of any length."""
    return max(int(rows.max(initial=0)), -int(rows.min(initial=0)))


def _totals(name_rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    i, j, value = zip(*name_rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([str(v) for v in value])], ["i", "j", "value"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, -1, sum of dimension i) and (-1, -1, vectors) of a task."""
    n, total = 0, None
    for _, rows in _matrices(batches):
        n += len(rows)
        part = _exact(rows, _top(rows) * len(rows)).sum(0).astype(object)
        total = part if total is None else total + part
    if n:
        yield _totals([(-1, -1, n), *((k, -1, int(v)) for k, v in enumerate(total))])


def _squares(shift: np.ndarray):
    """(i, j, sum of squares of y_i + y_j), (i, i, that of y_i) of a task; y are the entries less ``shift``."""
    d = len(shift)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, rows in _matrices(batches):
            y = rows - shift
            columns = np.ascontiguousarray(_exact(y, 4 * _top(y) ** 2 * len(y)).T)
            part = np.zeros((d, d), dtype=object)
            for i in range(d):
                pairs = columns[i] + columns[i:]
                pairs[0] = columns[i]
                part[i, i:] = (pairs * pairs).sum(1)
            total = part if total is None else total + part
        if total is not None:
            yield _totals([(i, j, int(total[i, j])) for i in range(d) for j in range(i, d)])

    return squares


def _added(parts: DataFrame) -> dict[tuple[int, int], int]:
    """Tasks' totals added up: one number for each pair of dimensions."""
    rows = parts.groupBy("i", "j").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    return {(r.i, r.j): int(r.value) for r in rows}


@dataclass(frozen=True)
class Whitening:
    """What was fitted: ``n`` vectors, their sums over whole numbers, components by falling eigenvalue.

    ``axes`` has a column for each component; ``covariance`` is that of x, each entry correctly rounded.
    """

    n: int
    sums: list[int]
    shift: np.ndarray
    rest: list[int]
    covariance: np.ndarray
    eigenvalues: np.ndarray
    axes: np.ndarray

    def scaled(self, components: int) -> np.ndarray:
        """The axes over the roots of their eigenvalues; NaN for those without variance."""
        e = self.eigenvalues[:components]
        flat = e <= FLAT * max(self.eigenvalues[0], 0.0)
        return self.axes[:, :components] / np.sqrt(np.where(flat, np.nan, e))


def encoded(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, code) of the vectors that take part."""
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    rows = vectors.select("vec_id", "embedding").mapInArrow(_encode(scale), f"vec_id {id_type}, code binary, size int")
    rows = kept(rows, "vector-codes")
    sizes = rows.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return rows.filter(F.col("size") == (sizes[0]["size"] if sizes else 0)).filter("size > 0").select("vec_id", "code")


def fit(codes: DataFrame, offset: int = 0) -> tuple[Whitening | None, DataFrame]:
    """The whitening of the distinct vectors (None without any), and these vectors."""
    distinct = kept(codes.select("code").distinct(), "distinct-vectors")
    sums = _added(distinct.mapInArrow(_sums, "i int, j int, value string"))
    if not sums:
        return None, distinct
    n = sums.pop((-1, -1))
    total = [sums[k, -1] for k in range(len(sums))]
    shift = [(2 * s + n) // (2 * n) for s in total]
    squares = _added(distinct.mapInArrow(_squares(np.array(shift, dtype=np.int64)), "i int, j int, value string"))
    d, rest = len(total), [s - n * m for s, m in zip(total, shift, strict=True)]
    # sums of (n*x - S)^2, alone and for two dimensions together, without any rounding
    alone = [n * n * squares[i, i] - n * rest[i] ** 2 for i in range(d)]
    covariance = np.empty((d, d))
    for i in range(d):
        covariance[i, i] = alone[i] / n**3
        for j in range(i + 1, d):
            both = n * n * squares[i, j] - n * (rest[i] + rest[j]) ** 2
            covariance[i, j] = covariance[j, i] = (both - alone[i] - alone[j]) / (2 * n**3)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    lead = np.abs(axes).argmax(0)
    axes = axes * np.where(axes[lead, np.arange(d)] < 0, -1.0, 1.0)
    return Whitening(n, [s + n * offset for s in total], np.array(shift, dtype=np.int64), rest, covariance, values, axes), distinct


def _projected(model: Whitening, rows: np.ndarray, scaled: np.ndarray) -> np.ndarray:
    mean = np.array([r / model.n for r in model.rest])
    return ((rows - model.shift) - mean) @ scaled


def _products(model: Whitening, scaled: np.ndarray):
    """(i, j, sum of products of whitened i and j), (i, -1, sum of whitened i) of a task."""
    k = scaled.shape[1]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((k, k)), np.zeros(k)
        for _, rows in _matrices(batches):
            w = _projected(model, rows, scaled)
            total += w.T @ w
            first += w.sum(0)
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate((i, np.arange(k))), pa.int32()), pa.array(np.concatenate((j, np.full(k, -1))), pa.int32()),
            pa.array(np.concatenate((total[i, j], first)))], ["i", "j", "value"])

    return products


def identity_error(model: Whitening, distinct: DataFrame, components: int) -> float:
    """Largest absolute entry of the whitened fit vectors' covariance less the identity, measured on the vectors."""
    scaled = model.scaled(components)
    scaled = scaled[:, ~np.isnan(scaled).any(0)]
    parts = distinct.mapInArrow(_products(model, scaled), "i int, j int, value double")
    found = {(r.i, r.j): r.value for r in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()}
    mean = {i: v / model.n for (i, j), v in found.items() if j < 0}
    return max((abs(v / model.n - mean[i] * mean[j] - (i == j)) for (i, j), v in found.items() if j >= 0), default=0.0)


def _deviations(model: Whitening, rows: np.ndarray) -> list[int]:
    """Sum over dimensions of (n*x - S)^2 for each vector, exact."""
    y = rows - model.shift
    largest, most = _top(y), max((abs(r) for r in model.rest), default=0)
    y = _exact(y, max(largest, most) * max(largest, 1) * y.shape[1])
    rest = np.array(model.rest, dtype=y.dtype if most < SAFE else object)
    squares, cross = (y * y).sum(1), (y * rest).sum(1)
    n, own = model.n, sum(r * r for r in model.rest)
    return [n * n * int(a) - 2 * n * int(b) + own for a, b in zip(squares, cross, strict=True)]


def whitened(vectors: DataFrame, scale: int = 64, offset: int = 1_000_000, components: int = 16) -> DataFrame:
    """Per usable row of ``vectors`` (vec_id, embedding) and component: its whitened value and the fit's figures.

    Columns: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    schema = (
        f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    codes = encoded(vectors, scale)
    model, distinct = fit(codes, offset)
    if model is None:
        return spark.createDataFrame([], schema)
    k = min(components, len(model.sums))
    error = identity_error(model, distinct, k)
    trace = float(np.trace(model.covariance))
    share = model.eigenvalues[:k] / trace if trace > 0 else np.zeros(k)
    scaled = model.scaled(k)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _matrices(batches):
            m = len(rows)
            values = _projected(model, rows, scaled).reshape(-1)
            yield pa.RecordBatch.from_arrays([
                part.column(part.schema.get_field_index("vec_id")).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n)),
                pa.array([v for v in _deviations(model, rows) for _ in range(k)], pa.int64()),
                pa.array(values, mask=np.isnan(values)), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
            ], [f.split()[0] for f in schema.split(", ")])

    return codes.mapInArrow(project, schema)
