"""Removal of repeated byte strings across documents by blockwise suffix sorting with a difference cover."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from market_signals.llm.common import blocks, documents, forget, keep, read, release

#: Length of the repeats that are removed, and of the grams whose least one in a window places it in a bucket.
LENGTH, GRAM = 50, 20
#: Window starts that an anchor can serve: a window holds so many grams.
REACH = LENGTH - GRAM + 1
#: Windows of one piece: all of them share the LENGTH - STEP + 1 bytes in the middle.
STEP = 8
#: Difference cover: every difference modulo PERIOD is one of two members of COVER.
PERIOD, COVER = 7, (0, 1, 3)
#: Suffix buckets that are handled one after the other. Each is a pass over the texts, so their number doesn't follow the
#: corpus: it says what share of the anchors (about 1.4 bytes for a byte of text) the disks hold at a time.
BUCKETS = 2
#: Pieces of one key that a task holds and sorts at most; the windows of a key with more are compared one by one.
HOT = 20_000
#: Bytes of text that a task hashes at once.
BLOCK = 400_000
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, x, np.uint64))]) for x in (BASE, INVERSE))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = _powers(1 << max(20, int(n).bit_length()))
    return a[:n], b[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Block:
    """Texts laid end to end, with hashes of any of their substrings."""

    def __init__(self, data: list[bytes]):
        self.lengths = np.array([len(x) for x in data], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.flat = np.frombuffer(b"".join(data), np.uint8)
        n = len(self.flat)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.flat.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of flat[begin:end]."""
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin] ^ ((end - begin).astype(np.uint64) << np.uint64(48)))

    def anchors(self) -> tuple[np.ndarray, ...]:
        """(doc, gram, first window, last window, hash of the gram, hash of the union of the windows) of every anchor.

        A window of LENGTH bytes belongs to the least of its grams by hash, the leftmost of equals. Equal windows have
        equal grams at equal places. Windows of one gram are consecutive.
        """
        n = len(self.flat)
        if n < LENGTH:
            return tuple(np.zeros(0, t) for t in (np.int32, np.int64, np.int64, np.int64, np.uint64, np.uint64))
        m = n - GRAM + 1
        g = mix((self.sums[GRAM:] - self.sums[:-GRAM]) * self.down[:m])
        # the low bits hold the distance from the window's first gram
        v = g & ~np.uint64(63)
        for step in (1, 2, 4, 8):
            v = np.minimum(v[:-step], v[step:] + np.uint64(step))
        v = np.minimum(v[: -(REACH - 16)], v[REACH - 16 :] + np.uint64(REACH - 16))
        doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        s = np.flatnonzero(doc[: n - LENGTH + 1] == doc[LENGTH - 1 :])
        if not len(s):
            return tuple(np.zeros(0, t) for t in (np.int32, np.int64, np.int64, np.int64, np.uint64, np.uint64))
        p = s + (v[s] & np.uint64(63)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)]))
        last = np.append(first[1:], len(s)) - 1
        p, lo, hi = p[first], s[first], s[last]
        return doc[p], p, lo, hi, g[p], self.hash(lo, hi + LENGTH)


def encoded(texts: list[str | None]) -> list[bytes]:
    return [(x or "").encode("utf-8", "replace") for x in texts]


def batch_of(names: list[str], cols: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in cols], names=names)


def holders(group: np.ndarray, doc: np.ndarray, before: tuple | None = None) -> np.ndarray:
    """For rows sorted by group and doc, the first doc of each row's group. group: True where a new one begins."""
    start = np.flatnonzero(group)
    out = np.repeat(doc[start], np.diff(np.append(start, len(doc)))) if len(start) else np.zeros(0, np.int64)
    if before is not None and (not len(start) or start[0] > 0):
        head = start[0] if len(start) else len(doc)
        out = np.concatenate([np.full(head, before[0], np.int64), out])
    return out


def suffix_order(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Order of the suffixes at `starts` by at least their first LENGTH bytes (zeros after the text's end).

    1. The suffixes at cover positions (i mod PERIOD in COVER) are ranked by their first 56 bytes.
    2. All suffixes are ordered by their first 8 bytes.
    3. Ties among these are long ones. For suffixes i and j some d < PERIOD puts both i + d and j + d on the cover, so
       the ranks there decide; d depends only on their places modulo PERIOD. The suffixes of each residue are sorted
       by each rank in question once, and a suffix's place is the count of smaller ones over all residues.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(72, np.uint8)]).astype(np.uint64)
    word = np.zeros(n + 64, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + n + 64]
    cover = np.flatnonzero(np.isin(np.arange(n + PERIOD) % PERIOD, COVER))
    keys = [word[np.minimum(cover + 8 * k, n + 63)] for k in range(6, -1, -1)]
    order = np.lexsort(keys)
    differ = np.zeros(len(order), bool)
    for key in keys:
        sorted_key = key[order]
        differ[1:] |= sorted_key[1:] != sorted_key[:-1]
    rank = np.zeros(n + 2 * PERIOD, np.int64)
    rank[cover[order]] = np.cumsum(differ)
    head = word[starts]
    by_head = np.argsort(head, kind="stable")
    runs = np.zeros(len(starts), np.int64)
    runs[by_head] = np.cumsum(np.concatenate([[0], head[by_head][1:] != head[by_head][:-1]]))
    residue = starts % PERIOD
    place = np.zeros(len(starts), np.int64)
    for c in range(PERIOD):
        these = np.flatnonzero(residue == c)
        if not len(these):
            continue
        for r in range(PERIOD):
            those = np.flatnonzero(residue == r)
            if not len(those):
                continue
            d = next(d for d in range(PERIOD) if (c + d) % PERIOD in COVER and (r + d) % PERIOD in COVER)
            known = np.sort((runs[these] << 32) | rank[starts[these] + d])
            place[those] += np.searchsorted(known, (runs[those] << 32) | rank[starts[those] + d])
    return np.argsort(place, kind="stable")


def least_docs(contexts: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For every window of every context the smallest doc among all contexts that hold the same LENGTH bytes."""
    lengths = np.array([len(c) for c in contexts])
    begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    text = np.frombuffer(b"".join(contexts), np.uint8)
    counts = lengths - LENGTH + 1
    owner = np.repeat(np.arange(len(contexts)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = begin[owner] + within
    order = suffix_order(text, starts)
    at = starts[order]
    # neighbours in suffix order with a common prefix of LENGTH bytes are equal windows
    same = np.ones(len(at) - 1, bool)
    padded = np.concatenate([text, np.zeros(LENGTH, np.uint8)])
    for k in range(LENGTH):
        same &= padded[at[1:] + k] == padded[at[:-1] + k]
    group = np.concatenate([[0], np.cumsum(~same)])
    low = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, group, docs[owner[order]])
    least = np.empty(len(at), np.int64)
    least[order] = low[group]
    return np.split(least, np.cumsum(counts)[:-1])


def find_anchors(docs: DataFrame, bucket: int, buckets: int) -> DataFrame:
    """(h, c, doc, at) of the bucket's anchors. at: place << 10 | bytes before it << 5 | least such bytes of a window.

    Of equal anchors with equal surroundings in one block of rows only those of the first document go on. The others
    repeat a smaller document for certain: they come with ~at and a spread h.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches, BLOCK):
            block = Block(encoded(rows.column(1).to_pylist()))
            doc, p, lo, hi, h, c = block.anchors()
            own = h % np.uint64(buckets) == bucket
            doc, p, lo, hi, h, c = (x[own] for x in (doc, p, lo, hi, h, c))
            at = ((p - block.starts[doc]) << 10) | ((p - lo) << 5) | (p - hi)
            doc = rows.column(0).to_numpy()[doc]
            order = np.lexsort((at, doc, c, h))
            h, c, doc, at = (x[order] for x in (h, c, doc, at))
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]) if len(h) else np.zeros(0, bool)
            later = doc > holders(new, doc)
            at = np.where(later, ~at, at)
            h = np.where(later, mix(at.view(np.uint64) + doc.astype(np.uint64) * BASE), h)
            yield batch_of(["h", "c", "doc", "at"], [h.view(np.int64), c.view(np.int64), doc, at])

    return docs.mapInArrow(run, "h bigint, c bigint, doc bigint, at bigint")


def shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (h, c, doc, at): (doc, at) of anchors whose gram stands in several documents.

    A row with the surroundings of a smaller document comes as ~at: all its windows repeat. The rest of a gram in
    several documents comes as at. Only the rows of one document wait for what follows.
    """
    held = [np.zeros(0, np.int64)] * 4
    state: tuple | None = None  # (h, c, first doc of h and c) of a gram that is known to be in several documents
    for batch in _and_end(batches):
        if batch is not None:
            new = [batch.column(i).to_numpy() for i in range(4)]
            done = new[3] < 0
            if done.any():
                yield batch_of(["doc", "at"], [new[2][done], new[3][done]])
            h, c, doc, at = (np.concatenate([a, b[~done]]) for a, b in zip(held, new, strict=True))
        else:
            h, c, doc, at = held
        if not len(h):
            continue
        first = np.concatenate([[state is None or state[0] != h[0]], h[1:] != h[:-1]])
        both = first | np.concatenate([[state is None or state[1] != c[0]], c[1:] != c[:-1]])
        run = np.cumsum(first)
        start = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        several = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
        if not first[0]:
            several[0] = True
        sizes = np.diff(np.append(start, len(h)))
        holder = holders(both, doc, (state[2],) if state is not None else None)
        emit = np.repeat(several, sizes)
        if batch is not None and not several[-1]:
            held = [x[start[-1] :] for x in (h, c, doc, at)]
            state = None
        else:
            held = [np.zeros(0, np.int64)] * 4
            state = (h[-1], c[-1], holder[-1])
        out = np.where(doc > holder, ~at, at)
        yield batch_of(["doc", "at"], [doc[emit], out[emit]])


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, context, doc, at) of the windows of undecided anchors, STEP windows a piece; key: hash of the bytes that all of them hold."""
    for rows in blocks(batches, BLOCK):
        data = encoded(rows.column(1).to_pylist())
        block = Block(data)
        ats = rows.column(2)
        sizes = np.diff(ats.offsets.to_numpy())
        at = ats.flatten().to_numpy()
        index = np.repeat(np.arange(len(data)), sizes)
        p = (at >> 10) + block.starts[index]
        far, near = (at >> 5) & 31, at & 31
        out: list[tuple[np.ndarray, ...]] = []
        for low in range(0, REACH, STEP):
            # windows that begin low .. low + STEP - 1 bytes before the anchor
            a, b = np.minimum(far, low + STEP - 1), np.maximum(near, low)
            ok = a >= b
            i = index[ok]
            begin, end = (p - a)[ok], (p - b)[ok] + LENGTH
            core_begin, core_end = (p - low)[ok], (p - low - STEP + 1)[ok] + LENGTH
            # at the ends of a text the common part can reach out of the windows that exist
            core_begin, core_end = np.maximum(core_begin, 0), np.minimum(core_end, len(block.flat))
            out.append((block.hash(core_begin, core_end).view(np.int64), begin, end, i))
        key, begin, end, i = (np.concatenate(x) for x in zip(*out, strict=True))
        flat = block.flat.tobytes()
        context = pa.array([flat[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())
        yield batch_of(["key", "context", "doc", "at"], [key, context, rows.column(0).to_numpy()[i], begin - block.starts[i]])


def repeated_windows(batches: Iterator[pa.RecordBatch], most: int = HOT) -> Iterator[pa.RecordBatch]:
    """From pieces sorted by (key, context, doc, at): (doc, begin, end) of bytes that repeat a smaller document.

    Equal contexts are one: the first document holds it, the others repeat it. The distinct contexts of a key are
    suffix-sorted together; a key with one context needs no more. The last key of a batch waits for the next one,
    with its distinct contexts and the rows of their first documents alone. Once over `most` of these wait, the key's
    windows leave with their bytes in `window`, undecided, and only the row that holds the last context stays.
    """
    names = ["doc", "begin", "end", "window"]

    def decided(doc: np.ndarray | list, begin: np.ndarray | list, end: np.ndarray | list) -> pa.RecordBatch:
        return batch_of(names, [doc, begin, end, pa.nulls(len(doc), pa.binary())])

    def undecided(context: list[bytes], doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        counts = np.array([len(x) - LENGTH + 1 for x in context], np.int64)
        begin = np.repeat(at, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        window = pa.array([x[k : k + LENGTH] for x in context for k in range(len(x) - LENGTH + 1)], pa.binary())
        return batch_of(names, [np.repeat(doc, counts), begin, begin + LENGTH, window])

    held: tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray] = (np.zeros(0, np.int64), [], np.zeros(0, np.int64), np.zeros(0, np.int64))
    hot = False  # the held row has left already, and its key's others shall leave
    for batch in _and_end(batches):
        key, context, doc, at = held
        if batch is not None:
            key, context, doc, at = np.concatenate([key, batch.column(0).to_numpy()]), context + batch.column(1).to_pylist(), np.concatenate([doc, batch.column(2).to_numpy()]), np.concatenate([at, batch.column(3).to_numpy()])
        if not len(key):
            continue
        size = np.array([len(x) for x in context], np.int64)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | np.array([x != y for x, y in zip(context[1:], context, strict=False)], bool)])
        later = doc > holders(new, doc)
        if later.any():
            yield decided(doc[later], at[later], (at + size)[later])
        keep_rows = np.flatnonzero(~later)
        key, doc, at, new = key[keep_rows], doc[keep_rows], at[keep_rows], new[keep_rows]
        context = [context[i] for i in keep_rows.tolist()]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        whole = len(key) if batch is None else int(start[-1])
        gone = 0
        if hot:
            gone = int(start[1]) if len(start) > 1 else len(key)
            if gone > 1:
                yield undecided(context[1:gone], doc[1:gone], at[1:gone])
            hot = gone == len(key)
        if batch is not None and not hot and len(key) - whole > most:
            yield undecided(context[whole:], doc[whole:], at[whole:])
            hot = True
        wait = slice(int(np.flatnonzero(new)[-1]), int(np.flatnonzero(new)[-1]) + 1) if hot else slice(whole, None)
        held = (key[wait], context[wait], doc[wait], at[wait])
        key, context, doc, at, new = key[gone:whole], context[gone:whole], doc[gone:whole], at[gone:whole], new[gone:whole]
        if not len(key):
            continue
        # keys with contexts of several documents
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        many = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
        use = np.repeat(many, np.diff(np.append(start, len(key))))
        if not use.any():
            continue
        classes = np.cumsum(new) - 1
        first = np.flatnonzero(new & use)
        least = least_docs([context[i] for i in first.tolist()], doc[first])
        of = dict(zip(classes[first].tolist(), least, strict=True))
        out = []
        for i in np.flatnonzero(use).tolist():
            hit = np.flatnonzero(of[int(classes[i])] < doc[i])
            if len(hit):
                cut = np.flatnonzero(np.diff(hit) > 1)
                for a, b in zip(hit[np.append(0, cut + 1)].tolist(), hit[np.append(cut, len(hit) - 1)].tolist(), strict=True):
                    out.append((int(doc[i]), int(at[i]) + a, int(at[i]) + b + LENGTH))
        if out:
            yield decided(*[list(x) for x in zip(*out, strict=True)])


def again(windows: DataFrame) -> DataFrame:
    """(doc, begin, end) of the windows (doc, begin, end, window) whose bytes stand in a smaller document.

    The least documents are aggregated before the shuffle and written, so that Spark can split the join of a window that very many share.
    """
    least = windows.groupBy("window").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    least = keep(least.where("low < high").select("window", "low"))
    return windows.join(least, "window").where("low < doc").select("doc", "begin", "end")


def repeats(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(doc, begin, end) of byte ranges of docs (doc, text) that repeat LENGTH bytes of a document with a smaller doc.

    Suffix buckets are sorted one after the other, so the disk holds one bucket's rows at a time. A suffix's bucket is the
    least gram of its first LENGTH bytes; suffixes whose gram stands in one document alone leave at once. Of the rest,
    equal surroundings are settled by counting them once; what remains goes, as pieces of text, to the tasks that sort
    them. Pieces of one key beyond HOT are cut into their windows, which are dealt anew by all their bytes.
    """
    spark = docs.sparkSession
    found: DataFrame | None = None
    for bucket in range(buckets):
        rows = find_anchors(docs, bucket, buckets).repartition("h").sortWithinPartitions("h", "c", "doc", "at")
        flags = keep(rows.mapInArrow(shared_anchors, "doc bigint, at bigint"))
        del rows
        release(spark)
        at = F.bitwise_not("at")
        place, far, near = F.shiftright(at, 10), F.shiftright(at, 5).bitwiseAND(31), at.bitwiseAND(31)
        certain = flags.where("at < 0").select("doc", (place - far).alias("begin"), (place - near + LENGTH).alias("end"))
        open_ = flags.where("at >= 0").groupBy("doc").agg(F.sort_array(F.collect_list("at")).alias("ats"))
        parts = docs.join(open_, "doc").select("doc", "text", "ats").mapInArrow(pieces, "key bigint, context binary, doc bigint, at bigint")
        parts = parts.repartition("key").sortWithinPartitions("key", "context", "doc", "at")
        sorted_out = parts.mapInArrow(partial(repeated_windows, most=HOT), "doc bigint, begin bigint, end bigint, window binary")
        ranges = keep(certain.withColumn("window", F.lit(None).cast("binary")).unionByName(sorted_out))
        del parts, sorted_out, certain, open_
        forget(flags)
        release(spark)
        windows = ranges.where("window is not null")
        ranges = ranges.where("window is null").select("doc", "begin", "end")
        if windows.limit(1).count():
            ranges = ranges.unionByName(keep(again(windows)))
            release(spark)
        found = ranges if found is None else found.unionByName(ranges)
    return found


def numbered(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with a number `doc` of its own for every row, in order of doc_id (null first) and text's digest.

    Rows are dealt by ranges, equal ones among themselves by where they were read, so that many copies of one row fall
    into several ranges. The driver gets one count for each range.
    """
    order = [F.col("doc_id").asc_nulls_first(), "digest", "read"]
    rows = docs.withColumn("digest", F.xxhash64("text")).withColumn("read", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at, at + batch.num_rows))], names=["doc_id", "text", "part", "place"])
            at += batch.num_rows

    rows = keep(rows.mapInArrow(run, "doc_id bigint, text string, part int, place bigint"))
    counts = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect())
    starts = np.cumsum([0, *(n for _, n in counts)]).tolist()
    offset = F.create_map(*[F.lit(x) for (part, _), start in zip(counts, starts, strict=False) for x in (part, start)])[F.col("part")] if counts else F.lit(0)
    return rows.select((offset + F.col("place")).alias("doc"), "doc_id", "text")


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (array of begin, end), kept_sha256 of every row.

    Every byte goes that is covered by LENGTH bytes which also start in a document with a smaller doc_id; strings are
    judged on the input. Null texts count as empty. Rows that repeat a doc_id count as documents one after the other,
    by a digest of their text (null ids come first): a later equal row loses all its strings. Texts under LENGTH bytes stay whole. An
    empty table gives no rows; further columns are ignored.
    """
    docs = documents(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counted = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
    if counted["n"] == counted["ids"] and docs.groupBy("doc_id").count().where("count > 1").limit(1).count() == 0:
        docs = docs.withColumn("doc", F.col("doc_id"))
    else:
        docs = numbered(docs)
    ranges = repeats(docs.select("doc", "text"))
    by = ranges.groupBy("doc").agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches):
            out = []
            for data, found in zip(encoded(rows.column(1).to_pylist()), rows.column(2).to_pylist(), strict=True):
                spans: list[list[int]] = []
                for a, b in sorted((x["begin"], x["end"]) for x in found or ()):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                digest, at = hashlib.sha256(), 0
                for a, b in spans:
                    digest.update(data[at:a])
                    at = b
                digest.update(data[at:])
                out.append((len(data), sum(b - a for a, b in spans), len(spans), spans, digest.hexdigest()))
            cols = [list(x) for x in zip(*out, strict=True)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string())
            yield pa.RecordBatch.from_arrays([rows.column(0), *[pa.array(x, k) for x, k in zip(cols, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"])

    joined = docs.join(by, "doc", "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<array<bigint>>, kept_sha256 string")


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(read(spark, sf_dir, "documents")).drop("spans")
