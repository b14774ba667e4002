"""Secret scans: patterns of known secrets, and a randomness test battery with length-aware false-discovery control."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from math import erfc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from market_signals.llm.common import blocks, read, text_bytes

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: The same runs as `[0-9a-f]+` of 32 and more characters: a leftmost match starts a run and takes all of it.
HEX = re.compile(r"[0-9a-f]{32,}")
#: Candidates of the battery.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "random")
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings in the order of inference, the narrowest first, with their alphabets.
ENCODINGS = {
    "decimal": DIGITS,
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "base32": UPPER + "234567",
    "base36": DIGITS + LOWER,
    "base36 upper": DIGITS + UPPER,
    "base62": DIGITS + UPPER + LOWER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
}
PLACES = {name: {c: i for i, c in enumerate(chars)} for name, chars in ENCODINGS.items()}
#: All characters of encodings, and the number of each byte's among them (or -1).
CHARACTERS = DIGITS + UPPER + LOWER + "+/-_"
NUMBER = np.full(256, -1, np.int16)
NUMBER[[ord(c) for c in CHARACTERS]] = np.arange(len(CHARACTERS))
#: Letters by how common they are where a corpus has too few of them to tell.
USUAL = "etaoinshrdlcumwfgypbvkjxqz"
#: Length classes of the false-discovery control: from so many characters on.
LENGTHS = (20, 24, 32, 48, 64, 128)
#: p-values are counted in so many steps of equal width in log scale: step k holds 2 ** -(k + 1) < p <= 2 ** -k.
STEPS = 64
#: Text made of words varies more than independent draws of its characters: its variances are taken so many times (measured: at 1.5 fewer
#: of 3,800 joined words than 0.1 % get a p-value under 1 / 128).
SPREAD = 1.5
#: Identifiers join words: at least these shares of their characters are capitals and digits, and as many neighbours change kind.
CAPITALS, NUMERALS, CHANGES = 1 / 6, 1 / 12, 1 / 3
#: Cells of the chi-squared test at most.
CELLS = 6
#: A token that the battery refutes as uniform at this level isn't random.
REFUTED = 1e-3


def infer(token: str) -> str | None:
    """The narrowest encoding whose alphabet holds the token without its padding."""
    own = set(token.rstrip("="))
    return next((name for name, places in PLACES.items() if own <= places.keys()), None) if own else None


def tail(z: float) -> float:
    """P(Z >= z) of a standard normal."""
    return 0.5 * erfc(z / 1.4142135623730951)


def simes(ps: list[float]) -> float:
    """One p-value from several that may depend on each other."""
    return min(1.0, min(p * len(ps) / (i + 1) for i, p in enumerate(sorted(ps))))


@dataclass(frozen=True)
class Words:
    """What tokens made of words look like in one encoding: shares of the characters, how often neighbours change between the
    alphabet's halves, and the serial correlation of places in the alphabet."""

    shares: tuple[float, ...]
    change: float
    serial: float


def words_of(pairs: np.ndarray) -> dict[str, Words]:
    """From counts of neighbouring characters (by CHARACTERS) in short runs of a corpus, the Words of each encoding.

    Counts of a hundred characters of usual text are added, so that an encoding whose characters are missing has a
    null hypothesis too. Capitals, digits and changes are at least as common as in identifiers joined of such words.
    """
    kinds = np.array([0 if c in DIGITS else 1 if c in UPPER else 2 for c in CHARACTERS])
    rank = {c: 1 / (i + 1) for i, c in enumerate(USUAL)}
    usual = np.array([rank[c] if c in rank else rank[c.lower()] / 20 if c in UPPER else 0.02 for c in CHARACTERS])
    usual /= usual.sum()
    pairs = pairs.reshape(len(CHARACTERS), -1) + 100 * usual[:, None] * usual[None]
    out = {}
    for name, chars in ENCODINGS.items():
        own = [CHARACTERS.index(c) for c in chars]
        c = pairs[np.ix_(own, own)]
        share = (pairs.sum(1) + pairs.sum(0))[own]
        share = share / share.sum()
        for kind, least in ((0, NUMERALS), (1, CAPITALS)):
            mine = kinds[own] == kind
            if 0 < share[mine].sum() < least and not mine.all():
                share = np.where(mine, share * least / share[mine].sum(), share * (1 - least) / share[~mine].sum())
        c = c / c.sum()
        high, x = np.arange(len(own)) >= len(own) / 2, np.arange(len(own), dtype=float)
        change = float(c[high][:, ~high].sum() + c[~high][:, high].sum())
        a, b = c.sum(1), c.sum(0)
        ma, mb = a @ x, b @ x
        spread = np.sqrt((a @ (x - ma) ** 2) * (b @ (x - mb) ** 2))
        out[name] = Words(tuple(share.tolist()), max(change, CHANGES), float((x - ma) @ c @ (x - mb) / spread) if spread > 0 else 0.0)
    return out


@cache
def cells_of(n: int, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each character in tokens of n, at least 4 of them expected in a cell, and the cells' uniform shares.

    Characters that are about as common in words share a cell.
    """
    k = len(words.shares)
    cells = max(2, min(k, n // 4, CELLS))
    edges = np.zeros(k, np.int64)
    edges[np.argsort(-np.array(words.shares), kind="stable")] = np.arange(k) * cells // k
    return edges, np.bincount(edges, minlength=cells) / k


@cache
def uniformity_of_words(n: int, words: Words) -> tuple[float, float]:
    """Mean and standard deviation of the root of the chi-squared statistic of uniformity of a token made of words."""
    edges, u = cells_of(n, words)
    p = np.bincount(edges, weights=words.shares, minlength=len(u))
    r = (p - u) / u
    mean = float((p * (1 - p) / u).sum() + n * (r * r * u).sum())
    var = 4 * n * float((p * r * r).sum() - (p * r).sum() ** 2) + 2 * (len(u) - 1)
    return mean**0.5, (SPREAD * var / 4 / mean) ** 0.5


def battery(token: str, encoding: str, words: Words) -> tuple[list[float], list[float]]:
    """p-values of three tests under two hypotheses: uniform random characters, and characters of a token made of words.

    The tests: uniformity of the alphabet (chi-squared), runs above and below the alphabet's middle, serial correlation.
    Under the first hypothesis a p-value is small if the token is less even, has too few or many runs, or is more
    correlated than random characters; under the second one if it comes nearer to random characters than words do.
    """
    places = PLACES[encoding]
    x = np.array([places[c] for c in token.rstrip("=")])
    n, k = len(x), len(places)
    edges, u = cells_of(n, words)
    chi = float(((np.bincount(edges[x], minlength=len(u)) - n * u) ** 2 / (n * u)).sum())
    df = len(u) - 1
    # Wilson and Hilferty's cube root
    uniform = tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5)
    mean, deviation = uniformity_of_words(n, words)
    worded = tail((mean - chi**0.5) / deviation)
    # changes between halves are binomial, at 1 / 2 for random characters; both sides, with half a step for continuity
    high = x >= k / 2
    half = float((np.arange(k) >= k / 2).mean())
    even = 2 * half * (1 - half)
    off = abs(int((high[1:] != high[:-1]).sum()) - (n - 1) * even)
    run = min(1.0, 2 * tail((off - 0.5) / ((n - 1) * even * (1 - even)) ** 0.5))
    center, width = (n - 1) * words.change, max(1.0, SPREAD * (n - 1) * words.change * (1 - words.change)) ** 0.5
    run_worded = max(0.0, tail(((n - 1) * even - off - 0.5 - center) / width) - tail(((n - 1) * even + off + 0.5 - center) / width))
    d = x - x.mean()
    total = float((d * d).sum())
    r = float((d[1:] * d[:-1]).sum()) / total + 1 / n if total > 0 else 1.0
    serial = min(1.0, 2 * tail(abs(r) * n**0.5))
    width = (SPREAD / n) ** 0.5
    serial_worded = max(0.0, tail((-abs(r) - words.serial) / width) - tail((abs(r) - words.serial) / width))
    return [uniform, run, serial], [worded, run_worded, serial_worded]


def candidates(text: str, words: dict[str, Words], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(begin, end, length class, step) of every token outside of the known spans, whose encoding can be inferred.

    The step is that of its p-value as a token made of words (Simes' combination of the three tests); it is 0 where the
    battery refutes that its characters are uniform.
    """
    out = []
    for m in TOKEN.finditer(text):
        token = m.group()
        encoding = infer(token)
        if encoding is None or any(s < m.end() and m.start() < e for s, _, e in base):
            continue
        random, worded = battery(token, encoding, words[encoding])
        p = 1.0 if simes(random) < REFUTED else simes(worded)
        out.append((m.start(), m.end(), sum(len(token) >= n for n in LENGTHS) - 1, min(STEPS - 1, int(-np.log2(max(p, 2.0**-STEPS))))))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(begin, kind, end) of the known patterns, leftmost and non-overlapping per kind, in order of begin and kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


@dataclass
class Control:
    """The corpus' null hypothesis by encoding, and the first step that is flagged in each length class."""

    words: dict[str, Words]
    limits: list[int]


def pair_counts(docs: DataFrame) -> np.ndarray:
    """Counts of neighbouring characters in runs of under 20 characters of CHARACTERS over all texts: at most 66 x 66 numbers."""
    kinds = len(CHARACTERS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(kinds * kinds, np.int64)
        for block in blocks(batches, 2_000_000):
            data, begins = text_bytes(block.column(0))
            number = np.concatenate([NUMBER[data], [-1]]).astype(np.int64)
            # texts don't run into each other
            first = np.zeros(len(number) + 1, bool)
            first[begins] = True
            inside = number >= 0
            joined = inside[1:] & inside[:-1] & ~first[1:-1]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8)))
            long = (edges[1::2] - edges[::2]) + 1 >= LENGTHS[0]
            mark = np.zeros(len(joined) + 1, np.int64)
            np.add.at(mark, edges[::2][long], 1)
            np.add.at(mark, edges[1::2][long], -1)
            short = joined & (np.cumsum(mark)[:-1] == 0)
            seen += np.bincount(number[:-1][short] * kinds + number[1:][short], minlength=kinds * kinds)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["pair", "n"])

    out = np.zeros(kinds * kinds)
    for r in docs.select("text").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out


def control(docs: DataFrame, rate: float = 0.01) -> Control:
    """What flags a token in this corpus: Benjamini and Hochberg's rule in each length class over all tokens of the corpus.

    The null hypothesis of a token is that it is made of words; how words look in each encoding is learned from the whole
    corpus (pair_counts). The executors count tokens by length class and step; the counts (6 x 64) are all that the
    driver gets. As p <= 2 ** -k in step k, a class with m candidates, of which j lie in step k and beyond, flags from the
    first k with m * 2 ** -k <= rate * j. Tokens that overlap known spans are no candidates.
    """
    words = words_of(pair_counts(docs))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(LENGTHS), STEPS), np.int64)
        for block in blocks(batches):
            for text in block.column(0).to_pylist():
                if text and TOKEN.search(text):
                    for _, _, size, step in candidates(text, words, base_spans(text)):
                        seen[size, step] += 1
        rows = [(a, b, int(seen[a, b])) for a, b in np.argwhere(seen)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64()))], names=["size", "step", "n"])

    found = docs.select("text").mapInArrow(count, "size int, step int, n bigint").groupBy("size", "step").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((len(LENGTHS), STEPS))
    for r in found:
        counts[r["size"], r["step"]] = r["n"]
    return Control(words, limits_of(counts, rate))


def limits_of(counts: np.ndarray, rate: float) -> list[int]:
    """The first step that is flagged in each length class (row of counts), or STEPS."""
    out = []
    for row in counts:
        beyond = row[::-1].cumsum()[::-1]
        ok = np.flatnonzero((row.sum() * 2.0 ** -np.arange(STEPS) <= rate * beyond) & (beyond > 0))
        out.append(int(ok[0]) if len(ok) else STEPS)
    return out


def all_spans(text: str, by: Control) -> list[tuple[int, int, int]]:
    """The known patterns' spans, and those that the battery adds."""
    base = base_spans(text)
    more = [(a, 3, b) for a, b, size, step in candidates(text, by.words, base) if step >= by.limits[size]] if TOKEN.search(text) else []
    return sorted(base + more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, by: Control) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random (bigint), base and spans (kind:begin:end, comma-joined) of every row.

    Positions are code points, ends exclusive. Null texts count as empty and have no spans; repeated rows each get their
    row; empty tables give none; further columns are ignored. Whole texts are searched, however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            found = [all_spans(x or "", by) for x in block.column(1).to_pylist()]
            n = [[sum(s[1] == k for s in f) for f in found] for k in range(4)]
            base = [joined([s for s in f if s[1] < 3]) for f in found]
            cols = [block.column(0).cast(pa.int64()), *[pa.array(x, pa.int64()) for x in n], pa.array(base, pa.string()), pa.array([joined(f) for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base string, spans string")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scan(docs, control(docs)).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_random")


def redact(text: str, by: Control, mark: str = "[secret]") -> str:
    """The text with `mark` in place of every union of overlapping spans."""
    out, at = [], 0
    for a, _, b in all_spans(text, by):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its secrets replaced; n_chars follows the text where the table has it.

    Null texts stay null; every row, also a repeated one, stays; an empty table stays empty.
    """
    by, names = control(docs), docs.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            old = block.column(at).to_pylist()
            new = [None if x is None else redact(x, by) for x in old]
            cols = list(block.columns)
            cols[at] = pa.array(new, pa.string())
            if size is not None:
                n = [a if x == y else len(y) for x, y, a in zip(old, new, block.column(size).to_pylist(), strict=True)]
                cols[size] = pa.array(n, block.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, docs.schema)
