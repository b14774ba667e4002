"""Merkle manifest of a dataset: incremental witnesses of aligned appends, with the roots of blocks appended further."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from market_signals.llm.common import forget, keep, read

#: Nodes that make one parent.
ARITY = 8
#: Levels of a block, and its leaves: what a task holds at once.
LEVELS = 3
BLOCK = ARITY**LEVELS
#: What a leaf binds, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(nodes: Iterable[bytes]) -> bytes:
    """SHA-256 of the nodes' hexadecimal text, one after the other."""
    return hashlib.sha256("".join([x.hex() for x in nodes]).encode()).digest()


def height(n: int) -> int:
    """Levels above n nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Append:
    """A tree that grows by aligned appends. Every leaf holds its partial witness: its siblings up to the open subtree it
    stands in. A run that is complete extends the witnesses of all leaves below it and is appended a level higher."""

    def __init__(self) -> None:
        self.open: list[list[tuple[bytes, range]]] = [[]]
        self.witness: list[list[bytes]] = []

    def append(self, node: bytes) -> None:
        at = len(self.witness)
        self.witness.append([])
        self._add(0, node, range(at, at + 1))

    def _add(self, level: int, node: bytes, below: range) -> None:
        self.open[level].append((node, below))
        if len(self.open[level]) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        nodes = [x for x, _ in run]
        for i, (_, below) in enumerate(run):
            rest = b"".join(nodes[:i] + nodes[i + 1 :])
            for leaf in below:
                self.witness[leaf].append(rest)
        if level + 1 == len(self.open):
            self.open.append([])
        self._add(level + 1, digest(nodes), range(run[0][1].start, run[-1][1].stop))

    def finish(self, levels: int) -> bytes:
        """Complete what is open on the first `levels` levels, however few nodes a run has; returns the root above them."""
        for level in range(levels):
            if level < len(self.open) and self.open[level]:
                self._complete(level)
        ((root, _),) = self.open[levels]
        return root


def fold(node: bytes, witness: bytes, pos: int, n: int) -> tuple[bytes, int]:
    """The root above `node`, which stands at `pos` of n, from its siblings; and how many bytes of the witness were used."""
    at = 0
    while n > 1:
        first = pos - pos % ARITY
        run = min(ARITY, n - first)
        left, right = at + 32 * (pos - first), at + 32 * (run - 1)
        node = hashlib.sha256((witness[at:left].hex() + node.hex() + witness[left:right].hex()).encode()).digest()
        at, pos, n = right, pos // ARITY, -(-n // ARITY)
    return node, at


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Nodes with their place `pos` among the n of their group `g`, by the columns of `order`.

    Ranges of (g, order) are sorted apart and numbered from 0; the ranges' sizes, one row for each range and group, say
    where each begins. So a group of any size is spread, and no row passes one task or the driver. Rows that are equal
    in all of `order` must be equal altogether, or their order doesn't matter.
    """
    by = ["g", *order]
    names = nodes.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), None, -1
        for batch in batches:
            places = []
            for g in batch.column(names.index("g")).to_pylist():
                at, last = (at + 1 if g == last else 0), g
                places.append(at)
            cols = [*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "part", "place"])

    schema = ", ".join(f"{c} {t}" for c, t in nodes.dtypes) + ", part int, place bigint"
    rows = keep(nodes.repartitionByRange(*[F.col(c).asc_nulls_first() for c in by]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in by]).mapInArrow(count, schema))
    sizes = rows.groupBy("g", "part").agg(F.count("*").alias("size"))
    along = W.partitionBy("g").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    begins = sizes.select("g", "part", F.coalesce(F.sum("size").over(along), F.lit(0)).alias("begin"), F.sum("size").over(W.partitionBy("g")).alias("n"))
    return rows.join(begins, ["g", "part"]).withColumn("pos", F.col("begin") + F.col("place")).select(*names, "pos", "n")


def by_block(rows: DataFrame) -> DataFrame:
    """Rows with their `block`, those of one together and in order."""
    return rows.repartition("g", "block").sortWithinPartitions("g", "block", "pos")


def grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each (g, block), which come in order: a block's leaves and what stands above it."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (held[0]["g"], held[0]["block"]) != (row["g"], row["block"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def build(rows: list[dict]) -> tuple[Append, bytes]:
    """The tree of a block's nodes, which is lower only if it is the whole tree, and its root."""
    tree = Append()
    for row in rows:
        tree.append(row["node"])
    n = rows[0]["n"]
    return tree, tree.finish(LEVELS if n > BLOCK else height(n))


def block_roots(nodes: DataFrame) -> DataFrame:
    """g, pos, n, node of the roots of all blocks of (g, pos, n, node): the nodes of the next appends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [(rows[0]["g"], rows[0]["block"], -(-rows[0]["n"] // BLOCK), build(rows)[1]) for rows in grouped(batches)]
        cols = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["g", "pos", "n", "node"])

    some = nodes.select("g", (F.col("pos") / BLOCK).cast("bigint").alias("block"), "pos", "n", "node")
    return by_block(some).mapInArrow(run, "g string, pos bigint, n bigint, node binary")


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, their blocks' roots, the roots of these, and so on, until each group has one."""
    out = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 1
    while most > 1:
        out.append(keep(block_roots(out[-1])))
        most = -(-most // BLOCK)
    return out


def with_upper(nodes: DataFrame, upper: DataFrame) -> DataFrame:
    """Nodes by block, with the row of `upper` (g, pos, above, subroot, place) that holds their block's root before them (pos -1)."""
    below = nodes.withColumn("block", (F.col("pos") / BLOCK).cast("bigint"))
    heads = upper.select("g", F.col("pos").alias("block"), F.lit(-1).cast("bigint").alias("pos"), "above", "subroot", "place")
    return by_block(below.unionByName(heads, allowMissingColumns=True))


def extended(nodes: DataFrame, upper: DataFrame) -> DataFrame:
    """g, pos, above (the whole witness), subroot, place of nodes: their partial witness in the block, and that of its root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for head, *rows in grouped(batches):
            tree, _ = build(rows)
            out += [(r["g"], r["pos"], b"".join(w) + head["above"], head["subroot"], head["place"]) for r, w in zip(rows, tree.witness, strict=True)]
        cols = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["g", "pos", "above", "subroot", "place"])

    return with_upper(nodes.select("g", "pos", "n", "node"), upper).mapInArrow(run, "g string, pos bigint, above binary, subroot binary, place bigint")


def item(c: Column) -> Column:
    """A value with its length in UTF-8 bytes before it; `-` if it is null."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(columns: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[item(columns[c]) for c in COLUMNS]), 256))


def manifest(docs: DataFrame, folds: int = 3) -> DataFrame:
    """A leaf, the root of its language, the root of all, and a proof for every row; and what the root recomputed from a
    changed row is, where `folds` divides the crc32 of its id (there A-Z of the text are lower-cased).

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Leaves are hashed by Spark expressions and
    numbered in ranges; blocks of 512 leaves are appended by tasks of their own, their roots by the next round's, until a
    language has one node; then the languages likewise. On the way back each block's witness extends those of its
    leaves, which are made anew from the leaves and never written. A hot language is many blocks.

    Null values are bound as such; a null lang is a group of its own, the first; a null doc_id stands before all others
    and isn't changed; rows that repeat an id follow each other by leaf, equal rows are leaves of their own; an empty
    table gives no rows; further columns are ignored.
    """
    given = {c: F.col(c) for c in COLUMNS}
    hit = F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0)
    changed = F.when(hit, leaf_of(given | {"text": F.translate("text", UPPER, LOWER)}))
    group = F.when(F.col("lang").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), "lang"))
    hashed = keep(docs.select(group.alias("g"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(given).alias("node"), changed.alias("told")))
    leaves = keep(numbered(hashed, ["doc_id", "node"]))
    forget(hashed)
    own = rounds(leaves)
    # languages: the subroots are leaves of one more tree
    subroots = own[-1].select(F.lit("").alias("g"), F.col("g").alias("lang"), "node")
    langs = keep(numbered(subroots, ["lang"]))
    above = rounds(langs)
    top = above[-1].first()
    root, m = (bytes(top["node"]), langs.count()) if top else (b"", 0)
    upper = above[-1].select("g", "pos", F.lit(b"").alias("above"), F.lit(None).cast("binary").alias("subroot"), F.lit(None).cast("bigint").alias("place"))
    for nodes in above[-2::-1]:
        upper = extended(nodes, upper)
    upper = upper.select("pos", "above").join(langs, "pos").select(F.col("lang").alias("g"), F.lit(0).cast("bigint").alias("pos"), "above", F.col("node").alias("subroot"), F.col("pos").alias("place"))
    for nodes in own[-2:0:-1]:
        upper = extended(nodes, upper)

    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for head, *rows in grouped(batches):
            tree, _ = build(rows)
            for r, w in zip(rows, tree.witness, strict=True):
                witness = b"".join(w) + head["above"]
                sub, used = fold(r["told"] or r["node"], witness, r["pos"], r["n"])
                found, _ = fold(sub, witness[used:], head["place"], m)
                out.append((r["doc_id"], r["node"].hex(), head["subroot"].hex(), root.hex(), hashlib.sha256(witness.hex().encode()).hexdigest(), found.hex(), found == root))
            if len(out) >= 4096:
                yield table(out)
                out = []
        yield table(out)

    def table(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), *[pa.string()] * 5, pa.bool_()), strict=True)], names=names)

    schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return with_upper(leaves, upper).mapInArrow(run, schema)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(read(spark, sf_dir, "documents"))


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text in SQL: each byte is taken in, then eight bits are shifted out."""
    steps = f"list_prepend(4294967295, flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])))"
    return f"xor(list_reduce({steps}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"


def _leaf_sql(text: str) -> str:
    parts = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}) || ':' || {c} END" for c in parts) + ")"


def _walk(name: str, rows: str, runs: str) -> str:
    """The way from each leaf of `rows` up the runs: node, and the siblings so far."""
    return f"""{name}(k, leaf_pos, level, pos, node, proof) AS (SELECT k, pos, 0, pos, told, '' FROM {rows} UNION ALL
  SELECT w.k, leaf_pos, w.level + 1, w.pos // 8, sha256(array_to_string(nodes[:w.pos % 8], '') || node || array_to_string(nodes[w.pos % 8 + 2:], '')),
    proof || array_to_string(nodes[:w.pos % 8], '') || array_to_string(nodes[w.pos % 8 + 2:], '') FROM {name} w JOIN {runs} r ON w.k = r.k AND w.level = r.level AND w.pos // 8 = r.run)"""


def _tree(name: str, rows: str) -> str:
    return f"""{name}(k, level, pos, node, n) AS (SELECT k, 0, pos, leaf, n FROM {rows} UNION ALL
  SELECT k, level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (n + 7) // 8 FROM {name} WHERE n > 1 GROUP BY k, level, pos // 8, n),
{name}_runs AS (SELECT k, level, pos // 8 AS run, list(node ORDER BY pos) AS nodes FROM {name} WHERE n > 1 GROUP BY k, level, pos // 8)"""


SQL = f"""
WITH RECURSIVE e AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS k, {_leaf_sql('text')} AS leaf,
  CASE WHEN doc_id IS NOT NULL AND text IS NOT NULL AND {_crc32('doc_id::VARCHAR')} % 3 = 0 THEN {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other FROM documents
), l AS (SELECT *, coalesce(other, leaf) AS told, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM e
), {_tree('t', 'l')}
, s AS (SELECT 0 AS k, k AS lang, node AS leaf, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1
), {_tree('u', 's')}
, {_walk('f', 'l', 't_runs')}
, g AS (SELECT f.k, f.leaf_pos, f.node, f.proof FROM f JOIN t ON t.k = f.k AND t.n = 1 AND t.level = f.level
), v AS (SELECT row_number() OVER () AS k, g.node AS told, s.pos, g.k AS lang, g.leaf_pos, g.proof FROM g JOIN s ON s.lang = g.k
), {_walk('h', 'v', '(SELECT v.k, u_runs.* EXCLUDE k FROM u_runs, v)')}
SELECT l.doc_id, l.leaf, s.leaf AS subroot, u.node AS root, sha256(v.proof || h.proof) AS proof_sha256, h.node AS folded_root, h.node = u.node AS verified
FROM l JOIN v ON v.lang = l.k AND v.leaf_pos = l.pos JOIN s ON s.lang = l.k JOIN u ON u.n = 1 JOIN h ON h.k = v.k AND h.level = u.level
"""
