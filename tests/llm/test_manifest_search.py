"""The manifest, the license scan and the ranked search against plain versions from their definitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from market_signals.llm import lexical, licenses, merkle, registry

KIND = "doc_id long, text string, lang string, source string, n_chars long, item_id int, terms string, words int, h string, pos int"


def frame(spark, rows):
    """Rows (doc_id, text, lang), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, g, None if i is None or i % 3 else f"s{i}", None if t is None else len(t), 1, "x", 2, "y", 3) for i, t, g in rows], KIND)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def climb(nodes, at, mine, proof):
    """The nodes' root, and what it is with `mine` at place `at`; siblings go to `proof`."""
    while len(nodes) > 1:
        run = nodes[at - at % 8 : at - at % 8 + 8]
        proof += [x for i, x in enumerate(run) if i != at % 8]
        mine = sha("".join(mine if i == at % 8 else x for i, x in enumerate(run)))
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        at //= 8
    return nodes[0], mine


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r["lang"] is not None, (r["lang"] or "").encode())].append(r)
    order = sorted(groups)
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    leaves = {g: [leaf(r, r["text"]) for r in groups[g]] for g in order}
    subroots = [climb(leaves[g], 0, "", [])[0] for g in order]
    want = Counter()
    for k, g in enumerate(order):
        for at, r in enumerate(groups[g]):
            hit = r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            proof = []
            _, mine = climb(leaves[g], at, leaf(r, low(r["text"])) if hit else leaves[g][at], proof)
            root, mine = climb(subroots, k, mine, proof)
            want[(r["doc_id"], leaves[g][at], subroots[k], root, sha("".join(proof)), mine, mine == root)] += 1
    return want


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, None: 9}, {"en": 513, "é": 512, "z": 1, None: 2}, {f"l{i}": i % 3 + 1 for i in range(70)}])
def test_manifest_equals_a_plain_one(spark, sizes):
    rng = random.Random(3)
    rows, at = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            at += 1
            rows.append((at * 7 % 1009, rng.choice(["Some Text é", "all low", "", None, "UPPER" * 30]), lang))
    if len(rows) > 10:
        rows += [rows[3], rows[3], (rows[4][0], "another text", rows[4][2]), (None, "no Id", "en"), (None, "no Id", None)]
    rng.shuffle(rows)
    df = frame(spark, rows).repartition(5)
    got = Counter(tuple(r) for r in merkle.manifest(df).collect())
    assert got == plain_manifest([r.asDict() for r in df.collect()])
    assert any(not r[-1] for r in got) or len(rows) == 1


def test_manifest_of_an_empty_table(spark):
    got = merkle.manifest(frame(spark, []))
    assert got.count() == 0 and got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_appended_witnesses_fold_to_the_root():
    for n in [*range(1, 75), 511, 512]:
        nodes = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        tree = merkle.Append()
        for x in nodes:
            tree.append(x)
        # a complete run has already given its leaves their siblings
        assert all(len(tree.witness[i]) == sum(i // 8**k < n // 8**k for k in range(1, 5)) for i in range(n))
        root = tree.finish(merkle.height(n))
        for i, w in enumerate(tree.witness):
            assert merkle.fold(nodes[i], b"".join(w), i, n) == (root, len(b"".join(w)))


MIT = licenses.TEMPLATES[12].text
NOTICES = [
    "Released under the MIT License.", "gnu General public LICENSE, mit license mit license", "cc by", "cc-by-nc 4.0", "CC\nBY", "apache2 license apache\tlicense", MIT, MIT.replace("free of charge", "free of any charge at all"),
    "before it " * 5 + MIT + " after", " ".join(MIT.split()[:20]), "gnu general public", "", None, "mit license " * 3000, "é漢 mit license", "mitlicense cc", "license mit",
]


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text or ""))


def plain_scan(text):
    """Labels by words: phrases as they stand; of longer texts the share of words that bands of neighbouring offsets cover."""
    w = plain_words(text)
    base, labels, score = [], set(), 0.0
    for t in licenses.TEMPLATES:
        x = t.words
        if t.phrase:
            at = [i for i in range(len(w)) if w[i : i + len(x)] == x]
            base += [(i, t.label) for i in at] if t.base else []
            labels |= {t.label} if at else set()
            score = max(score, 1.0 if at else 0.0)
            continue
        where = defaultdict(set)
        for j in range(len(x) - 4):
            for i in range(len(w) - 4):
                if w[i : i + 5] == x[j : j + 5]:
                    where[i - j].add(j)
        bands, last = [], None
        for d in sorted(where):
            if last is None or d - last > 8:
                bands.append([])
            bands[-1].append(d)
            last = d
        for band in bands:
            covered = {j + k for d in band for j in where[d] for k in range(5)}
            first, end = min(d + min(where[d]) for d in band), max(d + max(where[d]) for d in band) + 5
            if len(covered) / len(x) >= 0.7 and end - first <= 1.5 * len(x):
                labels.add(t.label)
                score = max(score, len(covered) / len(x))
    places = [i for i, _ in base]
    return len(w), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({y for _, y in base})), ",".join(sorted(labels)), round(score, 9)


def test_licenses_equal_a_plain_scan(spark):
    rng = random.Random(4)
    words = "mit license cc by gnu general public apache the a of".split()
    texts = [*NOTICES, *[" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(60)]]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(0, texts[0], None), (0, texts[0], None), (1, texts[2], "x"), (None, "MIT license", None), (None, None, None)]
    got = Counter((*tuple(r)[:-1], round(r["score"], 9)) for r in licenses.scan(frame(spark, rows).repartition(3)).collect())
    assert got == Counter((i, *plain_scan(t)) for i, t, _ in rows)
    by = {r[0]: r for r in got if r[0] in (3, 6, 7, 8, 9)}
    assert [by[i][6] for i in (3, 6, 7, 8, 9)] == ["cc-by,cc-by-nc", "mit", "mit", "mit", ""]


def test_license_scan_uses_dataframe_functions_alone(spark):
    df = licenses.scan(frame(spark, [(1, "mit license", None)]))
    df.collect()
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapPartitions|CartesianProduct|NestedLoop", plan) and "BroadcastHashJoin" in plan
    assert licenses.scan(frame(spark, [])).count() == 0


def plain_search(docs, items, k):
    term = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(t or ""))
    counts = [(i, Counter(term(t))) for i, t, _ in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_all, total = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    merged = defaultdict(set)
    for i, t in items:
        merged[i] |= set(term(t))
    out = Counter()
    for item, terms in merged.items():
        best = []
        for i, c, n in counts:
            m = 100 - 50 + (50 * n * n_all) // total
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            best += [(-s, i is None, i)] if s > 0 else []
        best.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        out.update((item, at + 1, i, -s) for at, (s, _, i) in enumerate(best[:k]))
    return out


@pytest.mark.parametrize(("k", "most"), [(50, 200_000), (3, 5)])
def test_search_equals_plain_ranking(spark, k, most):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)] + ["É", "é漢", "under_score", "A.B", "x1", "x"]
    text = lambda n: " ".join(rng.choice(words) if rng.random() < 0.7 else rng.choice(words).upper() for _ in range(n))
    docs = [(i, text(rng.randrange(1, 30)), None) for i in range(200)] + [(300, None, None), (301, "", None), (302, " .\x00\x7f-", None), (303, "w1 " * 50_000, None), (304, "w1", None), (305, "w1", None), (305, "w1", None), (305, "w2 w1", None), (None, "w1", None)]
    items = [(i, text(6)) for i in range(12)] + [(3, "w7 x1"), (20, None), (21, ""), (22, "never seen"), (None, "w1 w1 W1"), (23, "x")]
    got = lexical.search(frame(spark, docs).repartition(4), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int"), k, most)
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect()) == plain_search(docs, items, k)


def test_search_of_empty_tables(spark):
    none, one = frame(spark, []), frame(spark, [(1, "a b", None)])
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(none, items).count() == lexical.search(one, items.limit(0)).count() == 0
    assert [tuple(r) for r in lexical.search(one, items).collect()] == [(1, 1, 1, 287 * (1000000000 // (1000 + 20 * 100)))]


@pytest.mark.parametrize("name", ["op11_merkle", "op12_licenses", "op13_lexical"])
def test_sql_says_the_same_of_edges(spark, name, tmp_path):
    import duckdb

    docs = [(i, t, [None, "en", "de"][i % 3]) for i, t in enumerate(NOTICES[:13])] + [(5, "cc by", "en"), (5, "cc by", "en"), (None, "w MIT license", None), (40, "gnu General", "")]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "mit cc license"), (0, "by"), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = registry.QUERIES[name](spark, str(tmp_path))
    names = ", ".join(got.columns)
    assert Counter(map(tuple, got.collect())) == Counter(db.execute(f"SELECT {names} FROM ({registry.ORACLES[name]})").fetchall())
