"""Document fingerprints by I-Match with randomised lexicons."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from market_signals.llm.common import blocks, documents, read, release

#: Lexicon subsets of a fingerprint, and thinning levels kept of each.
SUBSETS, LEVELS = 32, 3
#: Terms of a document that a subset holds on average at the first of its levels: this much to twice this much.
KEPT = 1.5
EMPTY = np.uint32(0)
#: Bytes of text of one range of documents.
PART_BYTES = 32_000_000
_MULTIPLIERS = (np.arange(1, SUBSETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def terms(text: str) -> set[str]:
    return set(text.lower().split())


def term_hash(term: str) -> int:
    """A signed 64-bit hash."""
    h = xxhash.xxh3_64_intdigest(term)
    return h - (1 << 64) if h >= 1 << 63 else h


def lexicon(docs: DataFrame, low: float = 0.0005, high: float = 0.05) -> np.ndarray:
    """Hashes of the terms that stand in at least `low` and at most `high` of all documents (and in 2 at least).

    That band of inverse document frequency bounds the lexicon whatever the corpus: no more terms than the mean number
    of distinct terms of a document over `low`.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            seen: Counter[str] = Counter()
            for text in block.column(0).to_pylist():
                seen.update(terms(text or ""))
            yield pa.RecordBatch.from_arrays([pa.array(map(term_hash, seen), pa.int64()), pa.array(seen.values(), pa.int64())], names=["term", "n"])

    n = docs.count()
    found = docs.select("text").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    found = found.where((F.col("n") >= max(2, low * n)) & (F.col("n") <= max(2, high * n)))
    out = np.sort(found.select("term").toPandas()["term"].to_numpy(np.int64))
    del found
    release(docs.sparkSession)
    return out


class Printer:
    """Makes fingerprints with one lexicon (an array of hashes). A worker that gets it makes its set once and keeps it, with the terms it has hashed, from task to task."""

    def __init__(self, lex: np.ndarray):
        self.__setstate__(lex)

    def __getstate__(self) -> np.ndarray:
        return self.lex

    def __setstate__(self, lex: np.ndarray) -> None:
        self.lex, self.known = lex, set(lex.tolist())
        self.hashes: dict[str, int] = {}

    def pick(self, text: str) -> np.ndarray:
        """Sorted hashes of the text's distinct terms in the lexicon."""
        hashes, known, got = self.hashes, self.known, []
        for t in terms(text):
            h = hashes.get(t)
            if h is None:
                h = term_hash(t)
                h = h if h in known else 0
                if len(t) <= 32:
                    if len(hashes) >= 200_000:
                        hashes.clear()
                    hashes[t] = h
            if h:
                got.append(h)
        return np.sort(np.array(got, np.int64))

    def make(self, text: str) -> tuple[int, np.ndarray] | str:
        """Level and signatures [LEVELS, SUBSETS] (0: no term of that subset), or a digest of a text without terms of the lexicon.

        Subset k at level j holds the terms whose k-th hash is under 2 ** -j. Its signature is a hash of the document's
        sorted distinct terms in it.
        """
        h = self.pick(text)
        if not len(h):
            return hashlib.sha256(" ".join(text.lower().split()).encode("utf-8", "replace")).hexdigest()[:16]
        level = max(0, int(np.floor(np.log2(len(h) / KEPT))))
        x = h.view(np.uint64)[None, :] * _MULTIPLIERS[:, None]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x >>= np.uint64(32)
        out = np.zeros((LEVELS, SUBSETS), np.uint32)
        for j in range(LEVELS):
            held = x < np.uint64(1 << max(0, 32 - level - j))
            for k in np.flatnonzero(held.any(1)):
                out[j, k] = xxhash.xxh3_64_intdigest(h[held[k]].tobytes()) % 0xFFFFFF + 1
        return level, out


def spell(made: tuple[int, np.ndarray] | str) -> str:
    return "t" + made if isinstance(made, str) else f"{made[0]:02d}" + "".join([f"{x:06x}" for x in made[1].ravel().tolist()])


def likeness(a: tuple[int, np.ndarray] | str, b: tuple[int, np.ndarray] | str) -> float:
    """Share of equal signatures among the subsets that hold a term of either, at the levels that both have."""
    if isinstance(a, str) or isinstance(b, str):
        return float(isinstance(a, str) and isinstance(b, str) and a == b)
    same = told = 0
    for j in range(LEVELS):
        i = a[0] + j - b[0]
        if 0 <= i < LEVELS:
            x, y = a[1][j], b[1][i]
            some = (x != EMPTY) | (y != EMPTY)
            told += int(some.sum())
            same += int((some & (x == y)).sum())
    return same / told if told else 0.0


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, text in partitions by ranges of doc_id, sorted, with the first row of the next range at each one's end (late = 1).

    The last range is followed by the first row of all. Ranges come from quantiles of doc_id, so only their bounds and
    first ids (one number each) reach the driver. A null doc_id sorts first, equal ones by text.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    keyed = docs.select(key.alias("at"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = sorted({int(x) for x in keyed.select(F.col("at").cast("double").alias("at")).approxQuantile("at", [i / parts for i in range(1, parts)], 1 / (4 * parts))})
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("at"))) if cuts else F.lit(0)
    keyed = keyed.withColumn("part", part)
    first = sorted((r["part"], r["at"]) for r in keyed.groupBy("part").agg(F.min("at").alias("at")).collect())
    heads = [(at, first[i - 1][0] if i else first[-1][0]) for i, (_, at) in enumerate(first)]
    rows = F.array(F.struct("part", F.lit(0).alias("late")))
    if heads:
        leads = F.create_map(*[F.lit(x) for h in heads for x in h])
        also = F.try_element_at(leads, "at")
        rows = F.when(also.isNull(), rows).otherwise(F.concat(rows, F.array(F.struct(also.alias("part"), F.lit(1).alias("late")))))
    every = keyed.withColumn("r", F.explode(rows)).select("r.part", "r.late", "at", "doc_id", "text")
    return every.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "late", "at", "text")


def fingerprints(docs: DataFrame, lex: np.ndarray, share: int = 4) -> DataFrame:
    """Fingerprints of every text and of its edited text, in which the last floor(n_chars / share) code points are replaced by the first as many of the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts count
    as empty; rows of equal doc_id follow each other by text; the last row is followed by the first (a lone row by
    itself); an empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    data = spark.sparkContext.broadcast(Printer(lex))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer = data.value
        last = None
        for block in blocks(batches):
            out: list[tuple] = []
            for part, late, doc_id, text in zip(*[block.column(i).to_pylist() for i in (0, 1, 3, 4)], strict=True):
                text = text or ""
                if late and (last is None or last[0] != part):
                    continue
                made = printer.make(text)
                if last is not None and last[0] == part:
                    out.append(pair(printer, *last[1:], text, made))
                last = None if late else (part, doc_id, text, made)
            cols = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def pair(printer: Printer, doc_id: int | None, text: str, made, after: str, after_made) -> tuple:
        n = len(text) // share
        edited = text[: len(text) - n] + after[:n]
        other = made if edited == text else printer.make(edited)
        return doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), spell(made), spell(other), likeness(made, other), likeness(made, after_made)

    return with_next(documents(docs), parts).mapInArrow(run, schema)


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return fingerprints(docs, lexicon(docs))
