"""Near-duplicate vectors by Euclidean p-stable hashing, checked by exact cosines."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from market_signals.llm.common import forget, keep, read
from market_signals.llm.graph import components
from market_signals.llm.shingles import Forest

#: Bucket width of a projection; projections of unit vectors are standard normal.
WIDTH = 1.8
#: Vectors of one chunk of a bucket: a task holds two chunks of one bucket at most.
CHUNK = 1024


def agree(distance: float) -> float:
    """Probability that a projection puts two points of that distance into one cell."""
    r = WIDTH / distance
    return erf(r / sqrt(2)) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))


def plan(n: int, least: float, recall: float) -> tuple[int, int]:
    """(projections of a table, tables) for n vectors: unrelated vectors (orthogonal: sqrt 2 apart) meet about one in n
    times in a table, and pairs just at the threshold meet in some table with probability `recall`."""
    k = max(6, ceil(log(max(n, 2)) / -log(agree(sqrt(2)))))
    near = agree(sqrt(max(2 - 2 * least, 1e-6))) ** k
    return k, max(1, ceil(log(1 - recall) / log(1 - near)))


def pack(vector: list | None) -> bytes | None:
    """A vector's bytes, as float32 where that loses nothing; None if it is null, empty, zero or not finite throughout."""
    if not vector or any(x is None for x in vector):
        return None
    v = np.asarray(vector, np.float64)
    if not np.isfinite(v).all() or not v.any():
        return None
    with np.errstate(over="ignore", under="ignore"):
        small = v.astype(np.float32)
    return b"f" + small.tobytes() if (small == v).all() else b"d" + v.tobytes()


def unit(data: bytes) -> np.ndarray:
    v = np.frombuffer(data[1:], np.float32 if data[:1] == b"f" else np.float64).astype(np.float64)
    v = v / np.abs(v).max()
    return v / np.sqrt((v * v).sum())


@cache
def projections(dim: int, k: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions [dim, tables * k] and offsets, the same on every executor."""
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, tables * k)), rng.uniform(0, WIDTH, tables * k)


def buckets(units: np.ndarray, k: int, tables: int, seed: int) -> np.ndarray:
    """A 64-bit key for each row and table: the hash of floor((a . v + b) / w) of its projections.

    Products are added in a fixed order, so a vector has the same keys in whatever block it comes.
    """
    a, b = projections(units.shape[1], k, tables, seed)
    out = np.empty((len(units), tables), np.uint64)
    for i in range(0, len(units), 64):
        part = (units[i : i + 64, :, None] * a[None]).sum(1)
        cells = np.floor((part + b) / WIDTH).astype(np.int64).reshape(-1, tables, k)
        h = np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(units.shape[1])
        h = np.broadcast_to(h, (len(part), tables)).copy()
        for j in range(k):
            h = (h ^ cells[:, :, j].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        out[i : i + 64] = h
    return out.view(np.int64)


def compare(keys: list[bytes], ids: np.ndarray, members: np.ndarray, units: np.ndarray, table: int, side: np.ndarray, cross: bool, least: float, shape: tuple[int, int, int]) -> tuple[list, list, list, list]:
    """Rows (key, n, a, b) of one bucket: how many vectors a class links with by what is found here, and (key null) a
    spanning forest over the classes' ids.

    A pair counts only in the first table in which it shares a bucket. `cross`: only pairs of different sides.
    """
    cosine = units @ units.T
    i, j = np.nonzero(np.triu(cosine >= least, 1))
    if cross:
        i, j = (x[side[i] != side[j]] for x in (i, j))
    if not len(i):
        return [], [], [], []
    if table:
        some = np.unique(np.concatenate([i, j]))
        cells = buckets(units[some], *shape)[:, :table]
        a, b = cells[np.searchsorted(some, i)], cells[np.searchsorted(some, j)]
        new = ~(a == b).any(1)
        i, j = i[new], j[new]
    n = np.zeros(len(ids), np.int64)
    np.add.at(n, i, members[j])
    np.add.at(n, j, members[i])
    forest, edges = Forest(len(ids)), []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        if forest.join(x, y):
            edges.append((int(ids[x]), int(ids[y])))
    own = np.flatnonzero(n).tolist()
    told, none = [None] * len(own), [None] * len(edges)
    return [*[keys[x] for x in own], *none], [*n[own].tolist(), *none], [*told, *[e[0] for e in edges]], [*told, *[e[1] for e in edges]]


def near_duplicates(vectors: DataFrame, least: float = 0.95, recall: float = 0.985, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding).

    Equal vectors are one class (its size is a count, not pairs). Class representatives go to their buckets in several
    hash tables; a bucket of over CHUNK classes is cut into chunks, whose pairs are tasks of their own, so no task
    holds more than two chunks and no bucket is capped. Blocks of cosines in double precision decide; only counts and a
    spanning forest of each block's links leave it. At the threshold a pair is found with probability `recall`, closer
    pairs more surely; no pair below it is linked.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do rows with a null
    vec_id (their component is null). Rows that repeat an id count as vectors of their own, each with its links (equal
    ones link with each other); what is reachable from an id is so from all its rows, so they share a component. Vectors
    of different dimensions don't meet; further columns (labels too) are ignored; an empty table gives no rows.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [pack(v) for v in batch.column(1).to_pylist()]
            keys = [xxhash.xxh3_128_digest(unit(d).tobytes()) if d else None for d in data]
            cols = [batch.column(0), pa.array(keys, pa.binary()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "key", "v"])

    described = keep(vectors.mapInArrow(describe, "vec_id bigint, key binary, v binary"))
    valid = described.where("key is not null and vec_id is not null")
    classes = keep(valid.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("members"), F.min("v").alias("v")))
    k, tables = plan(classes.count(), least, recall)
    shape = k, tables, seed

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(2).to_pylist()
            by_size: dict[int, list[int]] = {}
            units = [unit(d) for d in data]
            for i, u in enumerate(units):
                by_size.setdefault(len(u), []).append(i)
            for rows in by_size.values():
                for at in range(0, len(rows), 256):
                    some = rows[at : at + 256]
                    keys = buckets(np.stack([units[i] for i in some]), *shape)
                    take = pa.array(np.repeat(some, tables))
                    cols = [pa.array(keys.ravel()), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(some))), batch.column(0).take(take)]
                    yield pa.RecordBatch.from_arrays(cols, names=["bucket", "t", "key"])

    # a class is told by its digest, as two classes may have one smallest id; digests alone find the buckets that are
    # shared, and vectors go to these only
    placed = keep(classes.select("key", "members", "v").mapInArrow(place, "bucket bigint, t int, key binary"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    rows = placed.join(sizes, "bucket").withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least("chunk", c).alias("x"), F.greatest("chunk", c).alias("y")))
    rows = rows.withColumn("p", F.explode(pair)).select("bucket", "p.x", "p.y", (F.col("chunk") != F.col("p.x")).alias("side"), "t", "key")
    rows = rows.join(classes, "key").select("bucket", "x", "y", "side", "t", "rep", "members", "v", "key")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Compares the rows of each (bucket, x, y); they come sorted by it."""
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if not table.num_rows:
                return
            c = {n: table.column(n).to_numpy() for n in ("bucket", "x", "y", "side", "t", "rep", "members")}
            v, digests = table.column("v").to_pylist(), table.column("key").to_pylist()
            new = (np.diff(c["bucket"]) != 0) | (np.diff(c["x"]) != 0) | (np.diff(c["y"]) != 0)
            starts = [0, *(np.flatnonzero(new) + 1).tolist(), len(v)]
            key, n, a, b = [], [], [], []
            for s, e in zip(starts, starts[1:], strict=False):
                if e - s < 2:
                    continue
                units = [unit(x) for x in v[s:e]]
                same = [i for i in range(e - s) if len(units[i]) == len(units[0])]
                at = np.array(same) + s
                found = compare([digests[x] for x in at.tolist()], c["rep"][at], c["members"][at], np.stack([units[i] for i in same]), int(c["t"][s]), c["side"][at], bool(c["x"][s] != c["y"][s]), least, shape)
                for out, more in zip((key, n, a, b), found, strict=True):
                    out += more
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), *[pa.array(x, pa.int64()) for x in (n, a, b)]], names=["key", "n", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            bucket, x, y = (batch.column(i).to_numpy() for i in range(3))
            last = np.flatnonzero((bucket != bucket[-1]) | (x != x[-1]) | (y != y[-1]))
            if len(last):
                # all but the last group, which may go on in the next batch
                table = pa.Table.from_batches(held)
                whole = table.num_rows - (batch.num_rows - int(last[-1]) - 1)
                yield from done(table.slice(0, whole))
                held = table.slice(whole).combine_chunks().to_batches()
        if held:
            yield from done(pa.Table.from_batches(held))

    linked = keep(rows.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y").mapInArrow(links, "key binary, n bigint, a bigint, b bigint"))
    forget(placed)
    counts = linked.where("key is not null").groupBy("key").agg(F.sum("n").alias("more"))
    # an id of several classes ties them
    shared = valid.groupBy("vec_id").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x <> y").select("vec_id")
    ties = valid.join(shared, "vec_id").select("vec_id", "key").join(classes.select("key", "rep"), "key").where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    groups = components(linked.where("key is null").select("a", "b").unionByName(ties)).withColumnRenamed("node", "rep")
    known = classes.select("key", "rep", "members").join(counts, "key", "left").join(groups, "rep", "left")
    known = known.select("key", (F.col("members") - 1 + F.coalesce("more", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    out = described.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(known, "key", "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS k, vec_id, embedding::DOUBLE[] AS x FROM embeddings
), v AS (
  SELECT * FROM e WHERE vec_id IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0
), l AS (SELECT a.k, a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.k <> b.k AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95
), r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node
), c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node
), n AS (SELECT k, count(*) AS n FROM l GROUP BY k)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM e LEFT JOIN c ON vec_id = node LEFT JOIN n ON e.k = n.k
"""
