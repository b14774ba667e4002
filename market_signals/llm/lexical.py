"""Ranked lexical search by scanning documents with an Aho-Corasick automaton of all searched terms; there is no index."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from market_signals.llm.common import blocks, documents, forget, keep, read, text_bytes, tidy

#: A term: ASCII letters and digits, and all beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GUARD = " "
#: What a byte of a text becomes: A-Z lower-cased, all that is in no term the guard. Bytes beyond ASCII are of terms.
FOLD = bytes((b | 32) if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Terms of items that are searched at once: the automaton and what goes with it stay below some hundred MB.
TERMS = 200_000
#: Items of a load: a task keeps the best documents of each, and scores of ROWS documents against all.
ITEMS = 5_000
#: Documents that are scored against all items at once.
ROWS = 64


def terms_of(text: Column) -> Column:
    """The terms of a text in order, with repeats."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), 0)


class Automaton:
    """Counts the searched terms of a text. Each stands between two guards, so that no term is found within another."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.machine = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            self.machine.add_word(GUARD + t.encode().decode("latin-1") + GUARD, i)
        if terms:
            self.machine.make_automaton()

    def __reduce__(self):
        return Automaton, (self.terms,)

    def count(self, data: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """How many terms a text (UTF-8) has, and the searched ones among them with how often each stands there."""
        low = data.translate(FOLD)
        inside = np.frombuffer(low, np.uint8) != 32
        n = int(inside[:1].sum()) + int((inside[1:] & ~inside[:-1]).sum())
        if not n or not self.terms:
            return n, np.zeros(0, np.int32), np.zeros(0, np.int64)
        hits = np.fromiter((i for _, i in self.machine.iter(GUARD + low.decode("latin-1") + GUARD)), np.int32)
        found, tf = np.unique(hits, return_counts=True)
        return n, found, tf


def scanned(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n (terms with repeats), found (numbers of the searched terms it holds) and tf of every row."""
    data = docs.sparkSession.sparkContext.broadcast(Automaton(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = data.value
        for block in blocks(batches):
            flat, at = text_bytes(block.column(1))
            told = [automaton.count(flat[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(f) for _, f, _ in told])]), pa.int32())
            found, tf = (np.concatenate([np.zeros(0, np.int64), *[t[k] for t in told]]) for k in (1, 2))
            cols = [block.column(0), pa.array([t[0] for t in told], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(found, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "found", "tf"])
        tidy()

    return documents(docs.withColumn("doc_id", F.col("doc_id").cast("long"))).mapInArrow(run, "doc_id bigint, n bigint, found array<int>, tf array<bigint>")


class Best:
    """The k best rows of each item so far: highest score first, of equal ones the lowest id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.rows: list[list[tuple[int, bool, int]]] = [[] for _ in range(items)]
        self.least = np.zeros(items, np.int64)

    def add(self, scores: np.ndarray, ids: list[int | None]) -> None:
        """Scores [rows, items] of rows with these ids; a score of 0 counts for nothing."""
        for j in np.flatnonzero((scores >= np.maximum(self.least, 1)).any(0)).tolist():
            own = self.rows[j]
            own += [(-s, ids[i] is None, ids[i] or 0) for i in np.flatnonzero(scores[:, j] >= max(self.least[j], 1)).tolist() for s in [int(scores[i, j])]]
            own.sort()
            del own[self.k :]
            if len(own) == self.k:
                self.least[j] = -own[-1][0]


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)


def scored(found: DataFrame, held: list[list[int]], weight: np.ndarray, n: int, total: int, k: int) -> DataFrame:
    """item (its place in `held`), score and doc_id of each task's k best documents of each item.

    `held` gives the items that an output of the automaton stands for. Scores are whole numbers under 2 ** 53, so that
    their sums in doubles are exact.
    """
    items = 1 + max((max(x) for x in held), default=-1)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in held])])
    flat = np.array([j for x in held for j in x], np.int64)
    data = found.sparkSession.sparkContext.broadcast((starts, flat, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, flat, weight = data.value
        best = Best(items, k)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lists, tfs = part.column(2), part.column(3)
                terms, tf = lists.flatten().to_numpy(), tfs.flatten().to_numpy()
                row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                m = 50 + (50 * part.column(1).to_numpy() * n) // max(total, 1)
                points = weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
                size = starts[terms + 1] - starts[terms]
                # every hit once for each item of its term
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[terms], size)
                cell = np.repeat(row, size) * items + flat[place]
                scores = np.bincount(cell, np.repeat(points, size), part.num_rows * items).astype(np.int64).reshape(-1, items)
                best.add(scores, part.column(0).to_pylist())
        rows = [(j, -s, None if none else i) for j, own in enumerate(best.rows) for s, none, i in own]
        cols = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["item", "score", "doc_id"])
        tidy()

    return found.mapInArrow(run, "item int, score bigint, doc_id bigint")


def batched(items: DataFrame, most: int, most_items: int = ITEMS) -> Iterator[list[tuple[int | None, list[str]]]]:
    """(item_id, its distinct terms) in loads of at most `most` terms and `most_items` items, an item with more terms in a load of its own."""
    each = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms_of(F.col("text"))).alias("t")).groupBy("item_id").agg(F.sort_array(F.collect_set("t")).alias("terms"))
    load: list[tuple[int | None, list[str]]] = []
    size = 0
    for row in each.orderBy(F.col("item_id").asc_nulls_last()).toLocalIterator():
        if load and (size + len(row["terms"]) > most or len(load) >= most_items):
            yield load
            load, size = [], 0
        load.append((row["item_id"], row["terms"]))
        size += len(row["terms"])
    if load:
        yield load


def search(docs: DataFrame, items: DataFrame, k: int = 50, most_terms: int = TERMS) -> DataFrame:
    """item_id, rank, doc_id, score of each item's `k` best documents with a score over 0, of equal scores by doc_id.

    Items come in loads of at most `most_terms` terms (and ITEMS items). For each load an automaton of all its terms is broadcast, and one
    scan of the texts counts them; statistics of the corpus are sums over that scan. Then each task scores its documents
    against all items of the load and keeps the best k of each, and the tasks' rows are ranked by item.

    Rows of `items` that repeat an item_id are one item with all their terms; items without a term (null or empty text)
    have no rows. Null and empty texts of `docs` are no documents of the statistics and score 0; rows that repeat a
    doc_id are ranked each; a null doc_id ranks last of equal scores; empty tables give no rows; further columns are
    ignored.
    """
    out = None
    for load in batched(items, most_terms):
        terms = sorted({t for _, own in load for t in own})
        number = {t: i for i, t in enumerate(terms)}
        held: list[list[int]] = [[] for _ in terms]
        for j, (_, own) in enumerate(load):
            for t in own:
                held[number[t]].append(j)
        found = keep(scanned(docs, terms))
        n, total = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(terms), np.int64)
        for t, c in found.select(F.explode("found").alias("t")).groupBy("t").agg(F.count("*").alias("c")).toLocalIterator():
            df[t] = c
        names = docs.sparkSession.createDataFrame([(j, i) for j, (i, _) in enumerate(load)], "item int, item_id bigint")
        order = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        best = scored(found, held, weights(df, n), n, total, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = keep(best.join(names, "item").select("item_id", "rank", "doc_id", "score"))
        forget(found)
        out = best if out is None else out.unionByName(best)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return out


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def _terms_sql(text: str) -> str:
    return f"regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '{TERM}')"


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_terms_sql("coalesce(text, '')")} AS terms FROM documents
), c AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0
), i AS (SELECT DISTINCT item_id, unnest({_terms_sql("coalesce(text, '')")}) AS t FROM benchmark
), tf AS (SELECT k, any_value(doc_id) AS doc_id, any_value(n) AS n, t, count(*) AS tf FROM (SELECT k, doc_id, len(terms) AS n, unnest(terms) AS t FROM d) u WHERE t IN (SELECT t FROM i) GROUP BY k, t
), df AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY t
), p AS (SELECT k, doc_id, tf.t, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // total))) AS points FROM tf JOIN df ON tf.t = df.t, c
), s AS (SELECT item_id, k, any_value(doc_id) AS doc_id, sum(points)::BIGINT AS score FROM i JOIN p ON i.t = p.t GROUP BY item_id, k
)
SELECT item_id, rank, doc_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank FROM s WHERE score > 0) r WHERE rank <= 50
"""
