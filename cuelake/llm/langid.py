"""Language of texts by their nearest centroid: TF-IDF vectors of byte n-grams against a few centroids a language.

Learning takes a bounded random sample of labelled rows per language (Spark counts n-grams of whole texts; only
these vectors reach the driver), document frequencies give the weights, and spherical k-means in numpy gives each
language several centroids. Every document's whole text is then compared with all centroids by cosine. A document
further from its nearest centroid than nearly all sample rows of that cluster is marked as rejected.

Defined cases: a text that is null or has no letter is ``und`` with score 0, rejected. Without any labelled row all
documents are ``und``. Repeated rows are documents of their own. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm import words
from cuelake.llm.jobfolder import column_bytes, remainder

UND = "und"
#: N-grams of 2 and 3 bytes fall into so many buckets.
BUCKETS = 1 << 13
#: Bytes counted at once.
TOGETHER = 1 << 18

_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


def _buckets(text: bytes, size: int = TOGETHER) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text set between blanks, stretch by stretch."""
    for at in range(0, max(1, len(text)), size):
        part = text[max(0, at - 2) : at + size]
        b = _FOLD[np.frombuffer((b" " if not at else b"") + part + (b" " if at + size >= len(text) else b""), np.uint8)]
        pair = (b[:-1] << np.uint32(8)) | b[1:]
        triple = (pair[:-1] << np.uint32(8)) | b[2:]
        if at:
            pair = pair[1:]  # the stretch before has counted it
        for code, salt in ((pair, 0x9E3779B1), (triple, 0x85EBCA77)):
            yield (code * np.uint32(salt)) >> np.uint32(32 - 13)


def count_grams(texts: list[bytes]) -> np.ndarray:
    """N-gram counts of each text, one row a text."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for k, text in enumerate(texts):
        for found in _buckets(text):
            out[k] += np.bincount(found, minlength=BUCKETS)
    return out


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows."""
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Centroids:
    langs: list[str]
    matrix: np.ndarray
    idf: np.ndarray
    reach: np.ndarray

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.langs):
            return np.full(len(counts), -1), np.zeros(len(counts))
        cosine = weigh(counts, self.idf) @ self.matrix.T
        best = cosine.argmax(axis=1)
        return best, np.clip(cosine[np.arange(len(best)), best], 0, 1).astype(float)


def _clusters(x: np.ndarray, k: int, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from the farthest-first rows; (centroids, cluster of each row)."""
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    centre = x[chosen]
    owner = np.zeros(len(x), int)
    for _ in range(rounds):
        owner = (x @ centre.T).argmax(axis=1)
        sums = np.stack([x[owner == c].sum(axis=0) if (owner == c).any() else centre[c] for c in range(len(centre))])
        centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centre, (x @ centre.T).argmax(axis=1)


def fit(
    train: DataFrame, sample_rows: int = 2000, max_languages: int = 500, per_language: int = 4,
    inner_share: float = 0.99, slack: float = 1.5,
) -> Centroids:
    """Centroids from (text: binary, lang) rows.

    sample_rows: about how many rows are sampled, the same number for each language. max_languages: the most
    frequent so many are learned. per_language: centroids of each. A cluster reaches ``slack`` times as far
    (1 - cosine) as the nearest ``inner_share`` of its sample rows.
    """
    counted = train.filter(F.col("lang").isNotNull()).groupBy("lang").count()
    sizes = {r["lang"]: r["count"] for r in counted.orderBy(F.desc("count"), "lang").limit(max_languages).collect()}
    share = {lang: min(1.0, sample_rows / len(sizes) / n) for lang, n in sizes.items()}
    if not sizes:
        return Centroids([], np.zeros((0, BUCKETS)), np.ones(BUCKETS), np.zeros(0))
    sample = train.select("lang", "text").sampleBy("lang", share, seed=7)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(batch.schema.get_field_index("lang"))
            for k, text in enumerate(column_bytes(batch, "text")):
                row = count_grams([text])[0]
                at = np.flatnonzero(row)
                yield pa.RecordBatch.from_arrays(
                    [langs.slice(k, 1), pa.array([at.astype("<u2").tobytes()]), pa.array([row[at].tobytes()])],
                    ["lang", "at", "n"],
                )

    rows = sample.mapInArrow(sparse, "lang string, at binary, n binary").toArrow()
    found = sorted(zip(rows["lang"].to_pylist(), rows["at"].to_pylist(), rows["n"].to_pylist(), strict=True))
    documents = np.zeros(BUCKETS)
    for _, at, _ in found:
        documents[np.frombuffer(at, "<u2")] += 1
    idf = np.log((1 + len(found)) / (1 + documents)).astype(np.float32) + np.float32(0.1)
    langs, centres, reach = [], [], []
    for lang in sorted({x[0] for x in found}):
        own = [x for x in found if x[0] == lang]
        counts = np.zeros((len(own), BUCKETS), np.float32)
        for k, (_, at, n) in enumerate(own):
            counts[k, np.frombuffer(at, "<u2")] = np.frombuffer(n, np.float32)
        x = weigh(counts, idf)
        centre, owner = _clusters(x, per_language)
        for c in range(len(centre)):
            inside = (x[owner == c] @ centre[c]) if (owner == c).any() else np.ones(1)
            langs.append(lang)
            centres.append(centre[c])
            reach.append(1 - slack * (1 - float(np.quantile(inside, 1 - inner_share))))
    return Centroids(langs, np.stack(centres), idf, np.array(reach))


def _predictor(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Centroids = shared.value
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            letter = batch.column(batch.schema.get_field_index("letter")).to_pylist()
            texts = column_bytes(batch, "text")
            for at in range(0, len(texts), 256):
                best, score = model.nearest(count_grams(texts[at : at + 256]))
                known = [x and b >= 0 for x, b in zip(letter[at : at + 256], best, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, len(best)),
                    pa.array([model.langs[b] if ok else UND for ok, b in zip(known, best, strict=True)]),
                    pa.array([s if ok else 0.0 for ok, s in zip(known, score, strict=True)], pa.float64()),
                    pa.array([not ok or bool(s < model.reach[b]) for ok, b, s in zip(known, best, score, strict=True)]),
                ], ["doc_id", "lang_pred", "score", "rejected"])

    return predict


def identify(docs: DataFrame, model: Centroids) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(
        "doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
        F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letter"),
    )
    return rows.mapInArrow(_predictor(shared), f"doc_id {id_type}, lang_pred string, score double, rejected boolean")


def languages(docs: DataFrame, divisor: int = 4, held: int = 2, **settings: float) -> DataFrame:
    """Predicted languages of all documents, learned from those whose id's remainder by ``divisor`` isn't ``held``."""
    train = docs.filter(remainder("doc_id", divisor) != held).select(
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), F.col("lang").cast("string").alias("lang")
    )
    return identify(docs, fit(train, **settings)).select(
        "doc_id", (remainder("doc_id", divisor) == held).alias("held_out"), "lang_pred", "score", "rejected"
    )
