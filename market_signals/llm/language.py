"""Language identification with error-correcting output codes."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from market_signals.llm.common import blocks, fold, read
from market_signals.llm.grams import gram_blocks

UNKNOWN = "und"


def codewords(classes: int, seed: int = 5) -> np.ndarray:
    """A row of +1 / -1 for each class. Up to 5 classes: every different split; more: the best of random codes."""
    if classes <= 1:
        return np.ones((classes, 1), np.int8)
    if classes <= 5:
        splits = [s for s in product((1, -1), repeat=classes - 1) if -1 in s]
        return np.array([[1, *s] for s in splits], np.int8).T
    rng, bits = np.random.default_rng(seed), 12 * int(np.ceil(np.log2(classes)))
    best, spread = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (classes, bits))
        code[:, np.abs(code.sum(0)) == classes] = np.where(np.arange(classes) % 2, 1, -1)[:, None]
        near = (bits - (code.astype(int) @ code.T)) // 2 + bits * np.eye(classes, dtype=int)
        if near.min() > spread:
            best, spread = code, near.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    #: by hashed n-gram and bit: log odds
    weights: np.ndarray
    #: by bit: what its losses count
    trust: np.ndarray
    scale: np.ndarray

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword, its share of exp(-loss) over all codewords, and whether the runner-up is close."""
        length = np.maximum(counts.sum(1, keepdims=True), 1)
        margins = (counts.astype(np.float32) @ self.weights) / length * self.scale
        # logistic loss of each bit of each codeword, weighted by the trust in the bit
        loss = np.logaddexp(0, -self.code[None] * margins[:, None, :]) @ self.trust
        share = np.exp(-(loss - loss.min(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        best = loss.argmin(1)
        top = np.sort(share, 1)
        close = top[:, -1] < 2 * top[:, -2] if share.shape[1] > 1 else np.zeros(len(best), bool)
        return best, share[np.arange(len(best)), best], close

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, languages=np.array(self.languages), code=self.code, weights=self.weights, trust=self.trust, scale=self.scale)
        return out.getvalue()


def load(data: bytes) -> Model:
    x = np.load(io.BytesIO(data))
    return Model([str(v) for v in x["languages"]], x["code"], x["weights"], x["trust"], x["scale"])


def train(docs: DataFrame, held: int = 2, folds: int = 4, per_language: int = 1500, bits: int = 13) -> Model:
    """Learn from at most `per_language` documents of each language, chosen by hash of doc_id; fold `held` is left out.

    Rows whose lang or text is null teach nothing. An id with several languages counts for the first of them, one with
    several texts with the least one. Hashes are cut so that about twice `per_language` ids of a language are ranked,
    however many there are. One pass counts n-grams by language and a second one, over the same bounded sample, measures each bit's accuracy,
    which weights its loss.
    """
    ids = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held))
    counts = ids.groupBy("lang").agg(F.count("*").alias("n")).collect()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    cuts = [x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1 << 30, (2 * per_language << 30) // r["n"])))]
    some = ids.where(place < F.create_map(*cuts)[F.col("lang")]) if cuts else ids
    order = W.partitionBy("lang").orderBy("place", "doc_id")
    chosen = some.select("doc_id", "lang", place.alias("place")).distinct().withColumn("row", F.row_number().over(order)).where(F.col("row") <= per_language)
    chosen = chosen.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    sample = docs.where("text is not null").select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    sample = sample.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r")).select(F.col("r.lang").alias("label"), "r.text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for block in blocks(batches):
            labels, texts = block.column(0).to_pylist(), block.column(1).to_pylist()
            for first, counts in gram_blocks(texts, bits):
                # each document weighs the same, whatever its length
                shares = counts / np.maximum(counts.sum(1, keepdims=True), 1)
                for label in set(labels[first : first + len(counts)]):
                    rows = shares[[i for i, x in enumerate(labels[first : first + len(counts)]) if x == label]]
                    sums[label] = sums.get(label, 0) + np.concatenate([[len(rows)], rows.sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["label", "sums"])

    parts = sample.repartition(16).mapInArrow(count, "label string, sums binary").collect()
    totals: dict[str, np.ndarray] = {}
    for r in sorted(parts, key=lambda r: (r["label"], r["sums"])):
        totals[r["label"]] = totals.get(r["label"], 0) + np.frombuffer(r["sums"])
    languages = sorted(totals)
    code = codewords(len(languages))
    if not languages:
        return Model([], code, np.zeros((1 << bits, 1), np.float32), np.ones(1), np.ones(1))
    # shares per class, smoothed
    rates = np.array([totals[x][1:] / totals[x][0] for x in languages])
    weights = np.zeros((1 << bits, code.shape[1]))
    for j, bit in enumerate(code.T):
        plus, minus = (rates[bit == s].mean(0) if (bit == s).any() else np.zeros(1 << bits) for s in (1, -1))
        weights[:, j] = np.log((plus + 1e-5) / (minus + 1e-5))
    # the expected margin of a class on its own bits sets the scale
    margins = rates @ weights
    scale = 3.0 / np.maximum(np.abs(margins).mean(0), 1e-9)
    model = Model(languages, code, weights.astype(np.float32), np.ones(code.shape[1]), scale)
    data = docs.sparkSession.sparkContext.broadcast(model.dump())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, right, n = load(data.value), 0, 0
        place = {x: i for i, x in enumerate(m.languages)}
        for block in blocks(batches):
            truth = np.array([place[x] for x in block.column(0).to_pylist()], int)
            for first, counts in gram_blocks(block.column(1).to_pylist(), bits):
                margins = counts.astype(np.float32) @ m.weights
                bitwise = (margins > 0) == (m.code[truth[first : first + len(counts)]] > 0)
                right, n = right + bitwise.sum(0), n + len(counts)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([np.asarray(right, np.int64).tolist()], pa.list_(pa.int64()))], names=["n", "right"])

    found = sample.repartition(16).mapInArrow(measure, "n bigint, right array<bigint>").collect()
    accuracy = sum(np.array(r["right"]) for r in found) / sum(r["n"] for r in found)
    error = np.clip(1 - accuracy, 0.01, 0.49)
    model.trust = np.log((1 - error) / error) / np.log((1 - error) / error).sum() * len(error)
    return model


def identify(docs: DataFrame, model: Model, bits: int = 13) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), ambiguous for every row.

    Null texts and texts without a letter are `und` with score 0. With no language learned all are `und`. Whole texts
    count; repeated rows each get their row; further columns are ignored.
    """
    data = docs.sparkSession.sparkContext.broadcast(model.dump())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(data.value)
        names = np.array(m.languages, object)
        for block in blocks(batches):
            texts = block.column(1).to_pylist()
            lettered = np.array([x is not None and any(map(str.isalpha, x)) for x in texts], bool)
            langs, scores, close = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if len(names):
                for first, counts in gram_blocks(texts, bits):
                    best, share, near = m.decode(counts)
                    ok = lettered[first : first + len(counts)]
                    at = np.arange(first, first + len(counts))[ok]
                    langs[at], scores[at], close[at] = names[best[ok]], share[ok], near[ok]
            yield pa.RecordBatch.from_arrays([block.column(0).cast(pa.int64()), pa.array(langs.tolist(), pa.string()), pa.array(scores), pa.array(close)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double, ambiguous boolean")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
