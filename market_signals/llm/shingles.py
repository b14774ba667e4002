"""Exact set-similarity join of documents on word shingles with PartEnum signatures."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from market_signals.llm.common import blocks, documents, forget, keep, marked, read, release, text_bytes, tidy
from market_signals.llm.graph import components, thinned

#: Bytes with A-Z lower-cased, and which of them separate words.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEPARATES = np.isin(np.arange(256), [32, *range(9, 14)])
#: Words of more bytes are hashed one by one.
LONG_WORD = 256
#: Masks for the last 0 to 8 bytes of a word.
TAIL = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Band ends are sizes at powers of (1 / similarity) ** BAND.
BAND = 2
#: The first count of shingles covers this part of their domain (see join_components).
THIRD = 3
#: Shingles that a task of a count holds, about, and those a dealing task holds before it sends them.
COUNTED, HELD = 1_000_000, 500_000
#: Bits of the table of sets that remain after the first count: 2 MB at any size of the corpus.
TABLE_BITS = 24
#: Shingles in this share of the remaining sets (and in LEAST_COMMON) are common.
COMMON, LEAST_COMMON = 1 / 5000, 8
#: A set with up to the first percentage of common shingles is signed without them, one with at least the second with them (see least_with).
WITHOUT, WITH = 65, 45
#: Signatures that a signing task holds before it sends them.
SIGNED = 500_000
#: Sets of one chunk of a cluster, and their shingles: a verifying task holds two chunks at most.
CHUNK, CHUNK_SHINGLES = 1500, 2_000_000
#: Up to so many sets of a cluster are compared without looking for shared signatures again.
FEW = 64


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the texts with A-Z lower-cased, in order, and how many words each text has."""
    data, begins = text_bytes(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    low = np.zeros(len(data) + 8, np.uint8)
    low[:-8] = LOWER[data]
    inside = ~SEPARATES[data]
    # a word begins behind a separator or where a text does, and ends likewise
    behind, before = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    behind[begins] = before[begins] = True
    behind[1:] |= ~inside
    before[:-1] |= ~inside
    first, last = np.flatnonzero(inside & behind[:-1]), np.flatnonzero(inside & before[1:]) + 1
    sizes = last - first
    eight = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
    h = sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    live = np.flatnonzero(sizes <= LONG_WORD)
    for j in range(0, LONG_WORD, 8):
        live = live[sizes[live] > j] if j else live
        if not len(live):
            break
        part = eight[first[live] + j] & TAIL[np.minimum(sizes[live] - j, 8)]
        h[live] = mixed((h[live] ^ part) * np.uint64(0x2545F4914F6CDD1D))
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(low[first[i] : last[i]].tobytes())
    return h, np.bincount(np.searchsorted(begins, first, "right") - 1, minlength=len(texts))


def shingle_sets(texts: pa.Array, n: int = 3) -> list[np.ndarray]:
    """Of every text the sorted distinct 64-bit hashes of its word n-grams; fewer words are one shingle, none are no shingle."""
    w, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    starts = ends - counts

    def chained(h: np.ndarray, rest: list[np.ndarray]) -> np.ndarray:
        h = h ^ np.uint64(0x632BE59BD9B4E019 * (len(rest) + 1) % 2**64)
        for x in rest:
            h = mixed(h * np.uint64(0x2545F4914F6CDD1D) + x)
        return mixed(h)

    k = max(0, len(w) - n + 1)
    whole = chained(w[:k], [w[j : j + k] for j in range(1, n)])
    out = [np.unique(whole[a : b - n + 1]) if b - a >= n else np.zeros(0, np.uint64) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    for c in range(1, n):
        rows = np.flatnonzero(counts == c)
        short = chained(w[starts[rows]], [w[starts[rows] + j] for j in range(1, c)])
        for i, h in zip(rows.tolist(), short, strict=True):
            out[i] = np.array([h], np.uint64)
    return out


def shingle_set(text: str | None, n: int = 3) -> np.ndarray:
    return shingle_sets(pa.array([text], pa.string()), n)[0]


def apart(size: int, share: int) -> int:
    """Most elements by which two sets of up to `size` elements with 100 * common >= share * union differ."""
    return 2 * size * (100 - share) // (100 + share)


def bands(size: int, share: int) -> list[tuple[int, int]]:
    """(band, largest size in it) of the bands in which a set of `size` meets all sets that may link with it.

    Band i holds the sizes from end(i) up to end(i + 1). A set joins its own band, and the one above if a partner of up
    to size * 100 / share may lie there; sets of that band join with it under its differences.
    """
    from math import floor, log

    step = BAND * log(100 / share) if share < 100 else log(2)
    own = floor(log(size) / step + 1e-9)

    def top(i: int) -> int:
        return int(np.exp(step * (i + 1)) + 1e-6) + 1

    out = [(own, top(own))]
    if size * 100 // share >= int(np.exp(step * (own + 1)) - 1e-6):
        out.append((own + 1, top(own + 1)))
    return out


def scheme(k: int) -> tuple[int, int, int, int]:
    """(first-level partitions n1, second-level ones in each n2, how many of these may disagree k2, spare partitions)
    for sets that differ by at most k elements.

    Of n1 partitions at least 1 + spare hold at most k2 of the differences, as (k2 + 1) * (n1 - spare) > k; in such
    a one at least n2 - k2 second-level partitions agree. Few differences: one partition; many: small k2, so that the
    number of signatures stays near 1.7 * k.
    """
    if k <= 5:
        return 1, k + 3 if k else 1, k, 0
    if k < 24:
        return k // 4 + 1, 6, 3, 0
    n1 = k // 2 + 1
    return n1 + 2 + n1 // 8, 3, 1, 2 + n1 // 8


@cache
def choices(n2: int, k2: int) -> np.ndarray:
    """A row of 0 / 1 by second-level partition for each choice of n2 - k2 of them."""
    return np.array([[c in chosen for c in range(n2)] for chosen in combinations(range(n2), n2 - k2)], np.uint64)


def least_with(share: int) -> int:
    """The percentage of common shingles from which a set is signed with them.

    Those of two sets that link differ by 100 - share at most: it is reached where one set holds the other and all of
    the rest is common, or none of it. So WITHOUT may be higher by no more than that.
    """
    return min(WITH, WITHOUT - (100 - share))


def all_signatures(s: np.ndarray, share: int, common: np.ndarray) -> np.ndarray:
    """Signatures of a set without its common shingles, or with them where they make up much of it, or both.

    Leaving out the same shingles everywhere can't add to two sets' differences, so the bound of the whole sets holds.
    It keeps passages that many documents share from making signatures of their own. Two sets that link are both
    signed in at least one same way (see least_with).
    """
    if not len(common) or not len(s):
        return signatures(s, share, len(s))
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    rare = s[common[at] != s]
    part = 100 * (len(s) - len(rare))
    out = []
    if part <= WITHOUT * len(s):
        out.append(signatures(rare, share, len(s)) ^ np.uint64(0x5851F42D4C957F2D))
    if part >= least_with(share) * len(s):
        out.append(signatures(s, share, len(s)))
    return np.concatenate(out)


def signatures(s: np.ndarray, share: int, size: int) -> np.ndarray:
    """PartEnum signatures of (part of) a set of `size` elements: hashes of its elements in every choice of agreeing second-level partitions.

    Projections without elements say little and are shared by many sets. Where spare partitions exist they are left
    out, unless the set has more such partitions than there are spare ones: two sets can agree on nothing else only if
    both have.
    """
    out = []
    for band, top in bands(size, share):
        n1, n2, k2, spare = scheme(apart(top, share))
        cell = ((s >> np.uint64(20)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        cell = (cell % np.uint64(n1 * n2)).astype(np.int64)
        mixed = s ^ (s >> np.uint64(29))
        mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        sums = np.zeros(n1 * n2, np.uint64)
        np.add.at(sums, cell, mixed)
        # an odd factor for each second-level partition, so that elements of different ones don't mix up
        factor = (np.arange(n2, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)
        pick = choices(n2, k2)
        h = ((sums.reshape(n1, n2) * factor)[:, None, :] * pick[None]).sum(2, dtype=np.uint64)
        h ^= (np.arange(n1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(band * 1_000_003 + 7))[:, None]
        h ^= np.arange(1, len(pick) + 1, dtype=np.uint64)[None] * np.uint64(0x632BE59BD9B4E019)
        h = h * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(28)
        if spare:
            none = (np.bincount(cell, minlength=n1 * n2).reshape(n1, 1, n2) * pick[None].astype(np.int64)).sum(2) == 0
            if none.any(1).sum() <= spare:
                h = h[~none]
        out.append(h.ravel())
    return np.unique(np.concatenate(out))


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def links(a: np.ndarray, b: np.ndarray, share: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < share * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = len(large) - 1
    both = int((large[at] == small).sum())
    return 100 * both >= share * (len(a) + len(b) - both)


def parity(s: np.ndarray, bits: int = 4096) -> int:
    """The parity of a set's elements in each of `bits` cells. The cells in which two sets differ are at most as many as the elements in which they do."""
    odd = np.bincount(((s >> np.uint64(11)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return int.from_bytes(np.packbits(odd.astype(np.uint8)).tobytes(), "big")


class Forest:
    """Union-find over places 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def tree_of(ids: list[int], sets: list[np.ndarray], side: np.ndarray, share: int, common: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets that share a signature. side: 0 in the first chunk, 1 in the second, and only links
    between chunks are sought if both occur. Pairs that are connected already are not compared."""
    forest, out, n = Forest(len(ids)), [], len(ids)
    tested = bytearray(n * n)
    odd, counts = [parity(s) for s in sets], [len(s) for s in sets]
    # of a few sets every pair is compared, as if all shared one signature
    sigs = [all_signatures(s, share, common) for s in sets] if n > FEW else [np.zeros(1, np.uint64)] * n
    flat, owner = np.concatenate(sigs), np.repeat(np.arange(len(sets)), [len(x) for x in sigs])
    order = np.lexsort((owner, flat))
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    sizes = np.diff(np.append(starts, len(flat)))
    cross = bool(side.any()) and not bool(side.all())

    def meet(these: list[int], those: list[int]) -> None:
        for i in these:
            for j in those:
                pair = min(i, j) * n + max(i, j)
                if tested[pair] or (cross and side[i] == side[j]):
                    continue
                tested[pair] = 1
                # linked sets differ in (a + b) * (100 - share) / (100 + share) elements at most
                if (odd[i] ^ odd[j]).bit_count() * (100 + share) <= (counts[i] + counts[j]) * (100 - share) and links(sets[i], sets[j], share):
                    forest.join(i, j)
                    out.append((int(ids[i]), int(ids[j])))
                    return

    for start, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        # sets of one signature by what they are connected to so far
        parts: dict[int, list[int]] = {}
        for i in owner[start : start + size].tolist():
            parts.setdefault(forest.root(i), []).append(i)
        apart_yet = list(parts.values())
        for x in range(1, len(apart_yet)):
            for y in range(x):
                if forest.root(apart_yet[x][0]) != forest.root(apart_yet[y][0]):
                    meet(apart_yet[x], apart_yet[y])
    return out


def home(load: np.ndarray, parts: int) -> np.ndarray:
    """The part that adds up what is counted of the sets of a load (partition << 32 | its number there)."""
    return ((load >> 32) * 1_000_003 + (load & 0xFFFFFFFF)) % parts


def code(s: np.ndarray, parts: int) -> np.ndarray:
    """The part that counts a shingle, and 32 bits of its hash."""
    return (((s >> np.uint64(33)) % np.uint64(parts)) << np.uint64(32)) | (s & np.uint64(0xFFFFFFFF))


def lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def deal(found: Iterator[tuple[list[int], list[np.ndarray]]], parts: int, third: int) -> Iterator[pa.RecordBatch]:
    """Shingles (of a `third` of their domain) to the parts that count them: (part, load, h, i, m, n, k, own).

    A shingle is four bytes of its hash (h) and a set its place in a task's load (i): six bytes in all, however many
    parts there are. Two shingles of a part that are taken for one can only make sets look shared that are not.
    A shingle of several sets of a load goes once (m) with their number (n), and counts as shared for these sets at
    once: so a shingle that very many sets hold is a few rows. The keys of the load's sets (k) and these counts (own)
    go to the load's home.
    """
    held: dict[int, np.ndarray] = {}
    size, load = 0, TaskContext.get().partitionId() << 32

    def told() -> pa.RecordBatch:
        h = np.concatenate(list(held.values()))
        i = np.repeat(np.arange(len(held)), [len(x) for x in held.values()])
        order = np.argsort(h, kind="stable")
        s = h[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(s)))
        shared = np.zeros(len(h), bool)
        shared[order] = np.repeat(times > 1, times)
        own = np.bincount(i[shared], minlength=len(held)).astype(np.int32)
        columns = []
        for x, y in ((h[~shared], i[~shared].astype(np.uint16).view(np.int16)), (s[first[times > 1]], times[times > 1].astype(np.int32))):
            c = code(x, parts)
            part = c >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
            columns += [lists((c & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)[order], ends), lists(y[order], ends)]
        at = int(home(np.int64(load), parts))
        ends = np.where(np.arange(parts + 1) > at, len(held), 0)
        columns += [lists(np.fromiter(held, np.int64, len(held)), ends), lists(own, ends)]
        out = pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), pa.array(np.full(parts, load)), *columns], names=["part", "load", "h", "i", "m", "n", "k", "own"])
        some = np.add.reduce([np.diff(c.offsets.to_numpy()) for c in columns])
        return out.filter(pa.array(some > 0))

    for keys, sets in found:
        for key, s in zip(keys, sets, strict=True):
            if key not in held:
                held[key] = s[(s >> np.uint64(7)) % np.uint64(third) == 0]
                size += len(held[key])
            if size >= HELD or len(held) > 0xFFFF:
                yield told()
                held, size, load = {}, 0, load + 1
    if held:
        yield told()
    tidy()


def gather(batches: Iterator[pa.RecordBatch], parts: int, least: int | None) -> Iterator[pa.RecordBatch]:
    """What one part says of its shingles, as (part, load, i, n, k, own): of sets i of a load how many of their shingles other
    sets share (n), to the load's home, which also gets its keys; with `least` as part -1 the codes (k) of the shingles in
    so many sets."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    rows = pa.Table.from_batches(rows).combine_chunks()
    whole = lambda c: rows.column(c).combine_chunks()
    part, load = whole("part").to_numpy().astype(np.uint64), whole("load").to_numpy()
    flat = {c: whole(c).flatten().to_numpy() for c in ("h", "i", "m", "n")}
    of = {c: np.repeat(np.arange(len(load)), np.diff(whole(c).offsets.to_numpy())) for c in ("h", "m")}
    c = np.concatenate([(part[of[x]] << np.uint64(32)) | flat[x].view(np.uint32) for x in ("h", "m")])
    times = np.concatenate([np.ones(len(flat["h"]), np.int64), flat["n"]])
    order = np.argsort(c, kind="stable")
    s = c[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    df = np.add.reduceat(times[order], first) if len(first) else np.zeros(0, np.int64)
    many = np.zeros(len(c), bool)
    many[order] = np.repeat(df > 1, np.diff(np.append(first, len(s))))
    many = many[: len(flat["h"])]
    at, n = np.unique((of["h"][many] << 16) | flat["i"][many].view(np.uint16), return_counts=True)
    ends = np.searchsorted(at >> 16, np.arange(len(load) + 1))
    none = np.zeros(len(load) + 1, np.int64)
    columns = [home(load, parts).astype(np.int32), load, lists((at & 0xFFFF).astype(np.uint16).view(np.int16), ends), lists(n.astype(np.int32), ends), whole("k"), whole("own")]
    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=[*GATHERED])
    common = s[first[df >= least]] if least else s[:0]
    if len(common):
        none = lists(np.zeros(0, np.int16), np.zeros(2)), lists(np.zeros(0, np.int32), np.zeros(2))
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int64()), *none, lists(common.view(np.int64), np.array([0, len(common)])), none[1]], names=[*GATHERED])


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k1, shared: sums of n by set, under the sets' keys."""
    keys: dict[int, np.ndarray] = {}
    sums: dict[int, np.ndarray] = {}
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for r in range(batch.num_rows):
            load = batch.column(1)[r].as_py()
            i, n, k, own = (batch.column(c)[r].values.to_numpy() for c in range(2, 6))
            if len(k):
                keys[load], sums[load] = k.copy(), own.astype(np.int64)
            if len(i):
                found.setdefault(load, []).append((i.view(np.uint16).copy(), n.copy()))
    for load, k in keys.items():
        for i, n in found.pop(load, []):
            sums[load][i] += n
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(sums.pop(load))], names=["k1", "shared"])
    tidy()


DEALT = "part int, load bigint, h array<int>, i array<smallint>, m array<int>, n array<int>, k array<bigint>, own array<int>"
GATHERED = {"part": "int", "load": "bigint", "i": "array<smallint>", "n": "array<int>", "k": "array<bigint>", "own": "array<int>"}


def in_parts(shingles: int, third: int) -> int:
    return 1 + shingles // third // COUNTED


def counted(source: DataFrame, of: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[list[int], list[np.ndarray]]]], shingles: int, third: int, least: int | None = None) -> DataFrame:
    """What gather() says of the sets that `of` makes of `source`; about `shingles` in all."""
    parts = in_parts(shingles, third)
    dealt = source.mapInArrow(lambda batches: deal(of(batches), parts, third), DEALT)
    return dealt.repartitionById(parts, F.col("part")).mapInArrow(lambda batches: gather(batches, parts, least), ", ".join(f"{c} {t}" for c, t in GATHERED.items()))


def shared_of(counts: DataFrame, shingles: int, third: int) -> DataFrame:
    """k1, shared: of each set's key how many of its shingles other sets have, from a table of counted()."""
    sums = counts.where("part >= 0").repartitionById(in_parts(shingles, third), F.col("part")).mapInArrow(added, "k1 bigint, shared bigint")
    return sums.groupBy("k1").agg(F.max("shared").alias("shared"))


def common_of(sets: DataFrame, counts: DataFrame, parts: int) -> np.ndarray:
    """The shingles, in order, of the sets (s) whose codes `counts` has as common ones."""
    codes = np.sort(counts.where("part < 0").select(F.explode("k").alias("k")).toArrow().column("k").to_numpy().view(np.uint64))
    if not len(codes):
        return codes
    sent = sets.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found = sent.value, np.zeros(0, np.uint64)
        for batch in batches:
            s = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(0)] or [found])
            c = code(s, parts)
            found = np.union1d(found, s[known[np.minimum(np.searchsorted(known, c), len(known) - 1)] == c])
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["h"])

    return np.sort(sets.select("s").mapInArrow(run, "h bigint").distinct().toArrow().column("h").to_numpy().view(np.uint64))


def described(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, how many of them the first count covers (n_counted), and the key (k1, k2) of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 1_000_000):
            sets = shingle_sets(block.column(1), n)
            keys = [set_key(s) if len(s) else (None, None) for s in sets]
            part = [int(((s >> np.uint64(7)) % np.uint64(THIRD) == 0).sum()) for s in sets]
            cols = [block.column(0), *[pa.array(x, pa.int64()) for x in ([len(s) for s in sets], part, [k[0] for k in keys], [k[1] for k in keys])]]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "n_counted", "k1", "k2"])
        tidy()

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, n_counted bigint, k1 bigint, k2 bigint")


def bit_table(keys: DataFrame) -> np.ndarray:
    """A table of 2 ** TABLE_BITS bits, of which that of every `key` is set: what the driver gets is bounded."""
    low = F.col("key").bitwiseAND(F.lit((1 << TABLE_BITS) - 1))
    words = keys.select(F.shiftright(low, 6).alias("w"), F.expr(f"shiftleft(1L, cast(key & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << TABLE_BITS >> 6, np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool) if len(words) else np.zeros(1 << TABLE_BITS, bool)


def listed(block: pa.RecordBatch, n: int, bits: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """doc_id, k1, k2 and set of the documents (doc_id, text) whose bit of k1 ^ doc_id is set in a packed bit_table()."""
    for doc_id, s in zip(block.column(0).to_pylist(), shingle_sets(block.column(1), n), strict=True):
        if doc_id is None or not len(s):
            continue
        k1, k2 = set_key(s)
        low = (k1 ^ doc_id) & ((1 << TABLE_BITS) - 1)
        if bits[low >> 3] >> (7 - (low & 7)) & 1:
            yield doc_id, k1, k2, s


def paired(ids: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of different ids."""
    pairs = np.unique(np.stack([ids, other], 1)[ids != other], axis=0)
    return pairs[:, 0], pairs[:, 1]


def sign(batches: Iterator[pa.RecordBatch], share: int, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Signatures of sets (k1, s): (sig, key, other).

    Of the sets of a task's load that share a signature the first alone goes on with it (other null); the rest are tied
    to that one (other), so that a signature of very many sets is a few rows.
    """

    def told(keys: list[int], sigs: list[np.ndarray]) -> pa.RecordBatch:
        flat, owner = np.concatenate(sigs).view(np.int64), np.repeat(np.array(keys, np.int64), [len(x) for x in sigs])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        head = np.repeat(owner[first], np.diff(np.append(first, len(flat))))
        a, b = paired(owner, head)
        cols = [np.concatenate([flat[first], a ^ b]), np.concatenate([owner[first], a])]
        other = pa.array(np.concatenate([np.zeros(len(first), np.int64), b]), mask=np.arange(len(first) + len(b)) < len(first))
        return pa.RecordBatch.from_arrays([*map(pa.array, cols), other], names=["sig", "key", "other"])

    keys: list[int] = []
    sigs: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for key, s in zip(batch.column("k1").to_pylist(), batch.column("s"), strict=True):
            keys.append(key)
            sigs.append(all_signatures(np.frombuffer(s.as_buffer(), np.uint64), share, common))
            size += len(sigs[-1])
            if size >= SIGNED:
                yield told(keys, sigs)
                keys, sigs, size = [], [], 0
    if keys:
        yield told(keys, sigs)
    tidy()


def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of neighbouring keys of a signature, and those that are given; rows come sorted by signature and key."""
    last: tuple[int, int] | None = None
    for batch in batches:
        given = np.asarray(batch.column(2).is_valid())
        sig, key = (batch.column(i).to_numpy() for i in range(2))
        a, b = key[given], batch.column(2).drop_null().to_numpy()
        sig, key = sig[~given], key[~given]
        if len(sig):
            old_sig, old_key = (np.concatenate([[last[i] if last else 0], x[:-1]]) for i, x in enumerate((sig, key)))
            near = old_sig == sig
            if last is None:
                near[0] = False
            a, b = np.concatenate([a, key[near]]), np.concatenate([b, old_key[near]])
            last = sig[-1], key[-1]
        a, b = paired(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def verify(batches: Iterator[pa.RecordBatch], share: int, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of the sets of one pair of chunks after another; rows (cluster, x, y, chunk, rep, s) come sorted by cluster, x, y, rep, s, and repeated ones count once."""
    group, ids, sets, side, last = None, [], [], [], None

    def told() -> pa.RecordBatch:
        found = tree_of(ids, sets, np.array(side), share, common)
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(2)], names=["a", "b"])

    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("cluster", "x", "y", "chunk", "rep", "s")), strict=True)
        for cluster, x, y, chunk, rep, s in rows:
            if (cluster, x, y) != group:
                if len(ids) > 1:
                    yield told()
                group, ids, sets, side, last = (cluster, x, y), [], [], [], None
            if (rep, s) == last:
                continue
            last = rep, s
            ids.append(rep)
            sets.append(np.frombuffer(s, np.uint64))
            side.append(chunk != x)
    if len(ids) > 1:
        yield told()
    tidy()


def linked_sets(docs: DataFrame, classes: DataFrame, share: int, n: int) -> DataFrame:
    """Links (a, b) among the `rep`s of classes (k1, k2, rep, n_shingles, n_counted): a spanning forest of all links."""
    spark = docs.sparkSession

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
        for block in blocks(batches, 1_000_000):
            rows = [(k1, s) for _, k1, _, s in listed(block, n, reps.value)]
            yield [k for k, _ in rows], [s for _, s in rows]

    def of_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield part.column("k1").to_pylist(), [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("s")]

    total = classes.agg(F.sum("n_shingles")).first()[0] or 0
    # a set is counted where its class's first document is (and where one with the same bit happens to be)
    reps = spark.sparkContext.broadcast(np.packbits(bit_table(classes.select(F.col("k1").bitwiseXOR(F.col("rep")).alias("key")))))
    shared = shared_of(counted(docs, of_texts, total, THIRD), total, THIRD)
    own = F.col("n_counted") - F.coalesce("shared", F.lit(0))
    left = classes.join(shared, "k1", "left").where(100 * own <= (100 - share) * F.col("n_shingles"))
    table = spark.sparkContext.broadcast(np.packbits(bit_table(left.select(F.col("k1").bitwiseXOR(F.col("rep")).alias("key")))))
    release(spark)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for block in blocks(batches, 1_000_000):
            rows = []
            for doc_id, k1, k2, s in listed(block, n, table.value):
                if (k1, k2) not in seen:
                    seen.add((k1, k2))
                    rows.append((k1, k2, doc_id, len(s), s.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([*[pa.int64()] * 4, pa.binary()])], names=["k1", "k2", "rep", "n_shingles", "s"])

    first = keep(docs.mapInArrow(sets_of, "k1 bigint, k2 bigint, rep bigint, n_shingles bigint, s binary"))
    size = first.agg(F.sum("n_shingles").alias("s"), F.count("*").alias("n")).first()
    least = max(LEAST_COMMON, int(COMMON * size["n"]))
    counts = keep(counted(first, of_sets, size["s"] or 0, 1, least))
    release(spark)
    usual = spark.sparkContext.broadcast(common_of(first, counts, in_parts(size["s"] or 0, 1)))
    shared = shared_of(counts, size["s"] or 0, 1)
    left = first.join(shared, "k1").where(100 * (F.col("n_shingles") - F.col("shared")) <= (100 - share) * F.col("n_shingles"))
    rest = spark.sparkContext.broadcast(np.packbits(bit_table(left.select(F.col("k1").bitwiseXOR(F.col("rep")).alias("key")))))

    def resting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = (batch.column(0).to_numpy() ^ batch.column(1).to_numpy()) & ((1 << TABLE_BITS) - 1)
            yield batch.filter(pa.array((rest.value[low >> 3] >> (7 - (low & 7)) & 1).astype(bool)))

    # not shuffled; a row that is repeated in several tasks stays until verify()
    sets = keep(first.select("k1", "rep", "n_shingles", "s").mapInArrow(resting, "k1 bigint, rep bigint, n_shingles bigint, s binary"))
    forget(first)
    forget(counts)
    release(spark)

    signed = sets.select("k1", "s").mapInArrow(lambda batches: sign(batches, share, usual.value), "sig bigint, key bigint, other bigint")
    near = signed.repartition("sig").sortWithinPartitions("sig", "key").mapInArrow(lambda batches: thinned(chain(batches)), "a bigint, b bigint")
    # clusters of set keys; should two sets share half a key, both are in its cluster
    clusters = components(near, thin=False).withColumnsRenamed({"node": "k1", "component": "cluster"})
    placed = keep(sets.select("k1", "rep", "n_shingles").distinct().join(clusters, "k1"))
    release(spark)
    # chunks of a cluster; each pair of chunks is one task's work
    sizes = placed.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n_shingles") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    placed = placed.join(sizes, "cluster").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least("chunk", c).alias("x"), F.greatest("chunk", c).alias("y")))
    members = sets.select("k1", "rep", "s").join(placed.select("k1", "rep", "cluster", "chunk", pair.alias("pairs")), ["k1", "rep"])
    members = members.select("rep", "s", "cluster", "chunk", F.explode("pairs").alias("p")).select("cluster", "p.x", "p.y", "chunk", "rep", "s")
    members = members.repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y", "rep", "s")
    found = keep(members.mapInArrow(lambda batches: verify(batches, share, usual.value), "a bigint, b bigint"))
    forget(sets)
    return found


def join_components(docs: DataFrame, share: int = 80, n: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: documents link when 100 * common >= share * union of their shingle sets.

    1. Every document gives its set's 128-bit key; equal sets are one class, whose smallest doc_id stands for it.
    2. A shingle that only one set has can't be common to two: a set with more than 100 - share in a hundred of these
       links with nothing. Shingles are counted twice, those of a third of their domain over all sets, then all of
       them over the sets that remain.
    3. What remains gives its PartEnum signatures. Sets that share one make candidate clusters (stars within a task's
       load and chains over the sorted rows of a signature: what is emitted grows with the rows, not with their pairs).
    4. The sets go to their cluster's tasks, in pairs of chunks of CHUNK sets, where pairs that share a signature and
       aren't connected yet are compared exactly.
    5. The links' components, mapped back to all documents by class.

    Null and empty texts have no shingles and link with nothing, so their component is themselves. Rows that repeat a
    doc_id with other text are classes of their own that share the component of that id. A null doc_id links with
    nothing; further columns are ignored; an empty table gives no rows.
    """
    docs = documents(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = keep(described(docs, n))
    full = rows.where("k1 is not null and doc_id is not null")
    classes = full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("n_counted").alias("n_counted"))
    classes = keep(classes)
    links_found = linked_sets(docs, classes, share, n)
    # rows that repeat an id with other text tie their classes together
    own = full.join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    groups = components(links_found).withColumnsRenamed({"node": "rep", "component": "group"})
    tied = own.join(groups, F.col("b") == F.col("rep"), "left").select("a", F.coalesce("group", "b").alias("b"))
    flat = keep(tied.groupBy("a").agg(F.min("b").alias("least"), F.max("b").alias("greatest")))
    if flat.where("least <> greatest").limit(1).count():
        groups = components(tied).withColumnsRenamed({"node": "a", "component": "least"})
        flat = own.select("a").distinct().join(groups, "a", "left").select("a", F.coalesce("least", "a").alias("least"))
    out = rows.join(flat.select("a", "least"), F.col("doc_id") == F.col("a"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op6_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(read(spark, sf_dir, "documents"), share=90, n=3)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): the one with the smallest id.

    Of rows that share an id one stays, the least by its columns. Rows without an id stay.
    """
    found = keep(join_components(docs))
    names = docs.columns
    kept = marked(docs, found.where("doc_id <> component_id")).where("not marked").drop("marked")
    repeated = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if not repeated.limit(1).count():
        return kept.select(*names)
    both = marked(kept, repeated)
    once = both.where("marked").groupBy("doc_id").agg(F.min(F.struct(*[c for c in names if c != "doc_id"])).alias("r")).select("doc_id", "r.*")
    return both.where("not marked").select(*names).unionByName(once.select(*names))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS g FROM s
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (SELECT a, b FROM p WHERE 100 * c >= 90 * (na + nb - c)
), m AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT doc_id AS node, doc_id AS root FROM s UNION SELECT m.b, r.root FROM r JOIN m ON m.a = r.node
), c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM s LEFT JOIN c ON doc_id = node
"""
