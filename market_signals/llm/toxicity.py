"""Toxicity by fuzzy lexicon search: Levenshtein automata over a trie of learned terms, scored by their context."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from market_signals.llm.common import blocks, fold, keep, labelled, read, tidy

#: Runs of letters; digits and punctuation inside a word split it.
WORDS = re.compile(r"[^\W\d_]+")
#: What closes a quotation that a mark opens. Apostrophes between letters are no marks.
CLOSING = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "›": "‹", "‘": "’", "'": "'"}
MARKS = re.compile("[\"“”„«»‹›‘]|(?<![^\\W_])'|['’](?![^\\W_])")
#: Words to each side of a hit whose marks and hits make its context.
WINDOW = 6
#: Words that a worker remembers.
REMEMBERED = 150_000
#: Names of a document's features, in the order of Model.weights.
FEATURES = ("exact", "stem", "fuzzy", "quoted", "crowded", "share", "any")


@dataclass
class Node:
    """A trie node; `term` is the lexicon's term that ends here."""

    next: dict[str, Node] = field(default_factory=dict)
    term: int = -1


class Lexicon:
    """Tries of terms, searched with a Levenshtein automaton for each queried word. Stems match with any ending."""

    def __init__(self, terms: list[str], stems: list[str]):
        self.terms, self.stems = list(terms), list(stems)
        self.exact = {t: i for i, t in enumerate(terms)}
        self.stem = {t: len(terms) + i for i, t in enumerate(stems)}
        self.stem_sizes = sorted({len(t) for t in stems})
        # with one edit, the first or the second half of a term stays as it is, and the length changes by one at most:
        # other words need no search
        # their terms stand in small tries of their own, by the word's length and that half
        self.heads: dict[tuple[int, str], Node] = {}
        self.tails: dict[tuple[int, str], Node] = {}
        self.swapped: dict[str, Node] = {}
        for i, t in enumerate(terms):
            if len(t) >= 5:
                n = (len(t) + 1) // 2
                # a swap across the halves spoils both
                self.put(self.swapped.setdefault(t[: n - 1] + t[n] + t[n - 1] + t[n + 1 :], Node()), t, i)
                for size in range(len(t) - 1, len(t) + 2):
                    self.put(self.heads.setdefault((size, t[:n]), Node()), t, i)
                    self.put(self.tails.setdefault((size, t[n:]), Node()), t, i)
        self.head_sizes, self.tail_sizes = sorted({len(x) for _, x in self.heads}), sorted({len(x) for _, x in self.tails})
        self.longest = max(map(len, terms), default=0)
        self.seen: dict[str, tuple[int, int]] = {}

    @staticmethod
    def put(root: Node, term: str, i: int) -> None:
        for c in term:
            root = root.next.setdefault(c, Node())
        root.term = i

    def search(self, word: str, root: Node, edits: int = 1) -> int:
        """Index of a term within `edits` insertions, deletions, substitutions or swaps of neighbours of `word`, or -1.

        The automaton's state is the row of edit distances to the prefixes of `word`; it steps along the trie's edges
        and drops a branch when the whole row exceeds `edits`. Terms of under 5 letters match only exactly.
        """
        n = len(word)
        stack = [(root, tuple(range(n + 1)), None, "")]
        best = (edits + 1, -1)
        while stack:
            node, row, above, last = stack.pop()
            for c, child in node.next.items():
                new = [row[0] + 1]
                for i in range(1, n + 1):
                    d = min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (word[i - 1] != c))
                    if above is not None and i > 1 and word[i - 1] == last and word[i - 2] == c:
                        d = min(d, above[i - 2] + 1)
                    new.append(d)
                if child.term >= 0:
                    best = min(best, (new[n], child.term))
                if min(new) <= edits:
                    stack.append((child, tuple(new), row, c))
        return best[1]

    def look(self, word: str) -> tuple[int, int]:
        """(kind, term) of a lower-case word: kind 0 none, 1 exact, 2 a stem's, 3 fuzzy."""
        if word in self.exact:
            return 1, self.exact[word]
        for n in self.stem_sizes:
            if n <= len(word) and word[:n] in self.stem:
                return 2, self.stem[word[:n]]
        if len(word) < 4 or len(word) > self.longest + 1:
            return 0, -1
        size = len(word)
        roots = [self.heads.get((size, word[:n])) for n in self.head_sizes] + [self.tails.get((size, word[-n:])) for n in self.tail_sizes] + [self.swapped.get(word)]
        term = max((self.search(word, r) for r in roots if r is not None), default=-1)
        return (3, term) if term >= 0 else (0, -1)

    def find(self, word: str) -> tuple[int, int]:
        """look(), remembered for as many words as a worker can hold."""
        found = self.seen.get(word)
        if found is None:
            found = self.look(word)
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            if len(word) <= 32:
                self.seen[word] = found
        return found


def quotations(line: str) -> list[tuple[int, int]]:
    """Where quotations of a line open and close: each mark closes the open one if it can, or opens one if none is open.

    A mark that nothing closes within the line opens nothing.
    """
    out, opened, at = [], "", 0
    for m in MARKS.finditer(line):
        mark = m.group()
        if opened and mark in CLOSING[opened]:
            out.append((at, m.start()))
            opened = ""
        elif not opened and mark in CLOSING and (mark not in "\"'" or line[m.end() : m.end() + 1].strip()):
            opened, at = mark, m.start()
    return out


def features(text: str | None, lexicon: Lexicon, clean: frozenset[str] = frozenset()) -> tuple[list[float], list[tuple[int, int, int, bool]]]:
    """Features of a text, and its hits (begin, end, term, quoted) in code points.

    A hit is quoted if it stands within one quotation of its line both of whose marks are in the window, or if its line
    starts with `>`. Marks of two quotations beside it, and apostrophes, don't quote it.
    Fuzzy hits on `clean` words, which are common in clean training texts, don't count.
    """
    low = (text or "").lower()
    look = lexicon.find
    wanted = {w for w in set(WORDS.findall(low)) if (k := look(w)[0]) and not (k == 3 and w in clean)}
    if not wanted:
        return [0.0] * len(FEATURES), []
    spots = [(m.start(), m.end(), m.group()) for m in WORDS.finditer(low)]
    at = [i for i, s in enumerate(spots) if s[2] in wanted]
    hits, out, quoted, crowded = [], [0.0, 0.0, 0.0], 0, 0
    told: tuple[int, list[tuple[int, int]]] = (-1, [])
    for j, i in enumerate(at):
        begin, end, word = spots[i]
        kind, term = look(word)
        line = low.rfind("\n", 0, begin) + 1
        if told[0] != line:
            stop = low.find("\n", begin)
            told = line, [(a + line, b + line) for a, b in quotations(low[line : stop if stop >= 0 else len(low)])]
        first = spots[i - WINDOW - 1][1] if i > WINDOW else 0
        last = spots[i + WINDOW + 1][0] if i + WINDOW + 1 < len(spots) else len(low)
        cited = low.startswith(">", line) or any(first <= a < begin and end <= b < last for a, b in told[1])
        near = (j > 0 and i - at[j - 1] <= WINDOW) or (j + 1 < len(at) and at[j + 1] - i <= WINDOW)
        out[kind - 1] += 1
        quoted += cited
        crowded += near
        hits.append((begin, end, term, cited))
    n = len(hits)
    return [*np.log1p(out).tolist(), quoted / n, crowded / n, min(1.0, 10 * n / len(spots)), 1.0], hits


@dataclass
class Model:
    terms: list[str]
    stems: list[str]
    clean: list[str]
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge-penalised logistic regression by Newton's method."""
    a = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(a.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) / len(y) + penalty * w
        h = (a * (p * (1 - p))[:, None]).T @ a / len(y) + np.diag(penalty + 1e-9)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, held: int = 0, folds: int = 5, most: int = 8_000, least: int = 3, surprise: float = 6.0, stem_sizes: tuple[int, ...] = (4, 5, 6, 7)) -> Model:
    """Learn a lexicon and context weights from at most `most` labelled documents (by hash of doc_id; fold `held` is left out).

    Spark counts, for every word and every word's beginnings of `stem_sizes` letters, in how many toxic and clean
    documents it stands. Terms enter that are far commoner in toxic ones: log odds with a margin of one standard error,
    and so many toxic documents that chance would give as many with a probability under exp(-surprise), by Chernoff's
    bound. A beginning becomes a stem only if it is at least as telling as its words, and has several. Every term over
    these thresholds counts; their number, and so what the driver gets and sends, is bounded by the sample's words.

    Null texts have no words; repeated rows count once (see labelled); without labels of both kinds, as with an empty
    table, the lexicon is empty and all documents score alike.
    """
    sample = labelled(docs, labels, "toxic", folds, held, most).select("doc_id", "label", "text")
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}+"), 0))
    each = sample.select((F.col("label") == 1).alias("toxic"), words.alias("words"))
    sizes = F.array(*[F.lit(n) for n in stem_sizes])
    begin = F.flatten(F.transform(sizes, lambda n: F.transform(F.filter("words", lambda w: F.length(w) >= n), lambda w: F.concat(n.cast("string"), F.lit(":"), F.substring(w, F.lit(1), n)))))
    whole = F.transform("words", lambda w: F.concat(F.lit("0:"), w))
    long = each.select("toxic", F.explode(F.concat(whole, F.array_distinct(begin))).alias("e"))
    counts = long.groupBy("e").agg(F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("good"))
    counts = counts.select(F.substring("e", 1, 1).cast("int").alias("n"), F.substring("e", 3, 1_000_000_000).alias("t"), "bad", "good")
    total = sample.agg(F.count_if(F.col("label") == 1).alias("bad"), F.count_if(F.col("label") != 1).alias("good")).first()
    nb, ng = total["bad"], total["good"]
    none = Model([], [], [], np.zeros(len(FEATURES)), -10.0 if not nb else float(np.log(nb / max(1, ng))) if ng else 10.0)
    if not nb or not ng:
        return none
    # log odds against the clean documents, less its standard error
    odds = F.log((F.col("bad") + 0.1) / F.lit(nb + 0.2)) - F.log((F.col("good") + 0.1) / F.lit(ng + 0.2))
    error = F.sqrt(1 / (F.col("bad") + 0.1) + 1 / (F.col("good") + 0.5))
    least = max(least, nb // 100)
    expected = (F.col("bad") + F.col("good")) * F.lit(nb / (nb + ng))
    chance = F.col("bad") * F.log(expected / F.col("bad")) + F.col("bad") - expected
    counts = keep(counts.where(F.col("bad") + F.col("good") >= least))
    telling = counts.withColumn("z", odds - error).where((F.col("bad") >= least) & (F.col("z") > 1.5) & (F.col("bad") > 3 * F.col("good")) & (chance < -surprise))
    whole_words = telling.where("n = 0").orderBy(F.desc("z"), "t").collect()
    terms = [r["t"] for r in whole_words]
    rows = telling.where("n > 0").collect()
    # of the beginnings of one word keep the shortest that is clean
    stems: list[str] = []
    for r in sorted(rows, key=lambda r: (r["n"], r["t"])):
        # one word alone makes no stem
        if r["bad"] <= 1.2 * max((w["bad"] for w in whole_words if w["t"].startswith(r["t"])), default=0):
            continue
        if r["bad"] >= 2 * least and r["good"] * 50 <= r["bad"] and not any(r["t"].startswith(s) for s in stems):
            stems.append(r["t"])
    terms = [t for t in terms if not any(t.startswith(s) for s in stems) or any(t == s for s in stems)]

    def clashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draft = Lexicon(terms, stems)
        for batch in batches:
            yield batch.filter(pa.array([draft.look(w)[0] == 3 for w in batch.column(0).to_pylist()], pa.bool_()))

    common = counts.where((F.col("n") == 0) & (F.col("good") >= least) & (F.col("bad") <= 3 * F.col("good"))).select("t")
    clean = sorted(r["t"] for r in common.mapInArrow(clashes, "t string").collect())
    data = docs.sparkSession.sparkContext.broadcast((terms, stems, clean))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, stems, clean = data.value
        lex, known = Lexicon(terms, stems), frozenset(clean)
        for block in blocks(batches):
            x = [features(t, lex, known)[0] for t in block.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    found = sorted(sample.repartition(16).mapInArrow(collect, "doc_id bigint, label int, x array<double>").collect(), key=lambda r: (r["doc_id"], r["x"]))
    weights, bias = logistic(np.array([r["x"] for r in found]), np.array([float(r["label"] == 1) for r in found]))
    return Model(terms, stems, clean, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), hits and quoted (bigint) and spans (begin:end of every hit) for every row.

    Null and empty texts have no hits and the score of a text without hits. Repeated rows each get their row; empty
    tables give none; further columns are ignored. The lexicon has a bounded number of terms.
    """
    data = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = data.value
        lex, known = Lexicon(m.terms, m.stems), frozenset(m.clean)
        for block in blocks(batches):
            both = [features(t, lex, known) for t in block.column(1).to_pylist()]
            s = m.score(np.array([x for x, _ in both])) if both else np.zeros(0)
            hits = [h for _, h in both]
            cols = [block.column(0).cast(pa.int64()), pa.array(s), pa.array([len(h) for h in hits], pa.int64()), pa.array([sum(x[3] for x in h) for h in hits], pa.int64()), pa.array([",".join(f"{a}:{b}" for a, b, _, _ in h) for h in hits], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "hits", "quoted", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, score double, hits bigint, quoted bigint, spans string")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits", "quoted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.5; what isn't toxic stays as it is.

    Null and empty texts, null ids and repeated rows stay, each with its row; an empty table stays empty.
    """
    model = train(docs, read(spark, sf_dir, "labels"))
    data = spark.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = data.value
        lex, known = Lexicon(m.terms, m.stems), frozenset(m.clean)
        for block in blocks(batches):
            x = np.array([features(t, lex, known)[0] for t in block.column(at).to_pylist()])
            yield block.filter(pa.array(m.score(x) < 0.5))
        del lex
        tidy()

    return docs.mapInArrow(run, docs.schema)
