"""Quality scores by nearest-neighbour voting over latent-semantic vectors."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from market_signals.llm.common import blocks, fold, labelled, read
from market_signals.llm.grams import gram_blocks

BITS = 12
SIZES = (2, 3)
#: Terms of their own for a text's repeats: so many columns and so much weight for words that follow themselves, and for repeated lines.
REPEATS, REPEAT_WEIGHT = 2, 6


def term_blocks(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Counts of hashed n-grams, and of repeated neighbouring words and repeated lines."""
    for first, counts in gram_blocks(texts, BITS, SIZES):
        more = np.zeros((len(counts), REPEATS), np.int64)
        for i, text in enumerate(texts[first : first + len(counts)]):
            words, lines = (text or "").lower().split(), (text or "").split("\n")
            more[i] = sum(map(eq, words, words[1:])), len(lines) - len(set(lines))
        yield np.concatenate([counts, more], 1)


@dataclass
class Model:
    #: by hashed n-gram: inverse document frequency
    idf: np.ndarray
    #: hashed n-grams to latent axes
    axes: np.ndarray
    #: labelled vectors (unit length) and their labels
    vectors: np.ndarray
    labels: np.ndarray
    #: votes of each label count so much
    weigh: np.ndarray
    neighbours: int
    power: float

    def place(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space; a text without n-grams is the zero vector."""
        x = np.log1p(counts).astype(np.float32) * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        y = x @ self.axes
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)

    def vote(self, y: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, each weighted by a power of its cosine."""
        if not len(self.labels):
            return np.full(len(y), 0.5)
        cosine = y @ self.vectors.T
        k = min(self.neighbours, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** self.power + 1e-9
        w *= self.weigh[self.labels[near]]
        return np.clip((w * (self.labels[near] == 1)).sum(1) / w.sum(1), 0, 1)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.__dict__)
        return out.getvalue()


def load(data: bytes) -> Model:
    x = np.load(io.BytesIO(data))
    return Model(*[x[k] for k in ("idf", "axes", "vectors", "labels", "weigh")], int(x["neighbours"]), float(x["power"]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", held: int = 1, folds: int = 3, most: int = 3000, dims: int = 96, neighbours: int = 15, power: float = 4.0) -> Model:
    """Fit on at most `most` labelled documents chosen by hash of doc_id (fold `held` left out).

    The executors count n-grams; the driver gets at most `most` rows of 2 ** BITS half-size numbers (24 MB) and finds
    the latent axes from their Gram matrix. Every document is later compared with every labelled vector.
    """
    sample = labelled(docs, labels, label, folds, held, most).select("doc_id", "label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            rows: list[bytes] = []
            for counts in term_blocks(block.column(2).to_pylist()):
                rows += [r.tobytes() for r in np.log1p(counts).astype(np.float16)]
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(rows, pa.binary())], names=["doc_id", "label", "x"])

    found = sample.repartition(16).mapInArrow(count, "doc_id bigint, label int, x binary").collect()
    found = sorted(found, key=lambda r: r["doc_id"])
    size = (1 << BITS) + REPEATS
    truth = np.array([int(r["label"] == 1) for r in found], np.int64)
    if not found:
        return Model(np.zeros(size, np.float32), np.zeros((size, 1), np.float32), np.zeros((0, 1), np.float32), truth, np.ones(2), neighbours, power)
    x = np.frombuffer(b"".join(r["x"] for r in found), np.float16).reshape(-1, size).astype(np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 0.1
    idf[-REPEATS:] *= REPEAT_WEIGHT
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    values, u = np.linalg.eigh((x @ x.T).astype(np.float64))
    order = np.argsort(-values)[: min(dims, len(values))]
    order = order[values[order] > 1e-9]
    axes = (x.T @ (u[:, order] / np.sqrt(values[order])).astype(np.float32)).astype(np.float32)
    y = x @ axes
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    shares = np.bincount(truth, minlength=2) / len(truth)
    weigh = np.sqrt(0.5 / np.maximum(shares, 1e-3))
    return Model(idf, axes, y.astype(np.float32), truth, weigh, neighbours, power)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) for every row.

    Null and empty texts share one vector and one score. Repeated rows each get their row; empty tables give no rows;
    further columns are ignored. Products are made in blocks of documents against all labelled vectors.
    """
    data = docs.sparkSession.sparkContext.broadcast(model.dump())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(data.value)
        for block in blocks(batches):
            parts = [m.vote(m.place(counts)) for counts in term_blocks(block.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([block.column(0).cast(pa.int64()), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, score double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
