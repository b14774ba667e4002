"""The pipeline against a plain version, stage by stage on one small corpus."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from market_signals.llm import pieces, secrets, shingles, toxicity


def corpus():
    rng = random.Random(11)
    vocabulary = [f"wo{a}{b}" for a in "abcdefgh" for b in "klmnopq"]
    rows, labels = [], []
    for i in range(160):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(8, 60)))
        bad = i % 6 == 0
        if bad:
            text += " you grumble and snark"
        if i % 17 == 3:
            text += ' token = "' + hashlib.sha1(str(i).encode()).hexdigest() + '"'
        rows.append((i, text, "en", f"s{i % 4}" if i % 9 else None, len(text)))
        if i % 2 == 0 or bad:
            labels.append((i, 1, int(bad)))
    for j in range(20):
        i = rng.randrange(160)
        w = rows[i][1].split()
        if j % 2:
            w[len(w) // 2] = "edit"
        rows.append((len(rows), " ".join(w), "en", f"s{j % 4}", 1))
    rows += [(len(rows), None, None, None, None), (len(rows) + 1, "", "en", "s1", 0)]
    return rows, labels


def plain_mix(rows):
    """Copies of (doc_id, source, size) rows, with one sort for each source."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    size = {s: sum(r[2] for r in by[s]) for s in order}
    target, open_, left = {}, set(order), 1.5 * sum(size.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * size[s]}
        for s in full or open_:
            target[s] = 2.0 * size[s] if full else weight[s] * level
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    copies = Counter()
    for s in order:
        rate = target[s] / size[s] if size[s] else 0
        base, part = math.floor(rate), rate - math.floor(rate)
        g = {r: r[2] * 1000 // (r[2] + 200) for r in by[s]}
        mean = sum(g[r] * r[2] for r in by[s]) / size[s] if size[s] else 0
        ranked = []
        for r in by[s]:
            pi = part + 0.5 * part * (1 - part) * (g[r] - mean) / 1000
            u = (int(hashlib.md5(f"17:{r[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            copies[r[0]] += base
            if pi > 0:
                ranked.append((u / (1 - u) * ((1 - pi) / pi), r[0], r[2]))
        done, rest = 0, target[s] - base * size[s]
        for _, doc_id, n in sorted(ranked):
            done += n
            if 2 * done - n <= 2 * rest:
                copies[doc_id] += 1
    return copies


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    import sentencepiece

    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    got = [(r["doc_id"], r["ids"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]

    # toxicity: the same model, scored row by row
    model = toxicity.train(docs, marks)
    lexicon, clean = toxicity.Lexicon(model.terms, model.stems), frozenset(model.clean)
    kept = [r for r in rows if model.score([toxicity.features(r[1], lexicon, clean)[0]])[0] < 0.5]
    assert 0 < len(rows) - len(kept) < 60
    # near-duplicates: all pairs
    sets = {r[0]: set(shingles.shingle_set(r[1], 5).tolist()) for r in kept}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    kept = [r for r in kept if root(r[0]) == r[0]]
    # secrets
    limits = secrets.control(spark.createDataFrame(kept, docs.schema))
    texts = {r[0]: None if r[1] is None else secrets.redact(r[1], limits) for r in kept}
    assert any("[secret]" in (t or "") for t in texts.values())
    # mixing, encoding
    copies = plain_mix([(r[0], r[3], len(re.findall(r"[^\x20\x09-\x0D]+", texts[r[0]] or ""))) for r in kept])
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = [(i, lib.encode(texts[i] or "", add_bos=True, add_eos=True)) for i, n in copies.items() for _ in range(n)]
    assert sorted(got) == sorted(want)


def test_stages_keep_the_columns(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.limit(0), str(tmp_path)).agg(F.count("*")).first()[0] == 0


def test_pipeline_of_an_empty_table_and_its_last_stage(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    name, last = corpus_pipeline.STAGES[-1]
    some = spark.createDataFrame([(1, "a b", 7), (1, "a b", 7), (1, "c", 7), (None, "c", 7), (2, None, 7), (3, "", 7), (4, "word " * 60_000, 7)], "doc_id long, text string, ids int")
    got = last(spark, some, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 1, 1, 1, 2, 3, 4]
    assert {r["doc_id"]: r["n_tokens"] for r in got if r["doc_id"] in (2, 3)} == {2: 2, 3: 2}
    assert all(len(r["ids"]) == r["n_tokens"] for r in got)
