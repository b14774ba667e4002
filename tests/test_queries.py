"""Every query with SQL gives what DuckDB gives on the smallest tables, and streams give what batches give."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from market_signals.plans.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, int):
        return f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        assert df.columns and len(rows) > 0
        return
    cur = duck.execute(ORACLES[name])
    columns = [x[0] for x in cur.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    mine = sorted(tuple(plain(r[c]) for c in order) for r in rows)
    theirs = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in cur.fetchall())
    assert mine == theirs


def pair_rows():
    """Items with shared and repeated words and names, equal ones, undated ones, and some without words or names."""
    rows = [(i, f"alpha w{i % 7} w{i % 11} tender", f"w{i % 5} cable", ["Equinor"] if i % 9 == 0 else ["BP", "Siemens Gamesa"] if i % 4 == 0 else [], ["offshore_wind", "adjacent_energy", "other_energy", None][i % 4], None if i % 13 == 0 else f"2024-01-{1 + i % 28:02d}T{i % 24:02d}:00:00+00:00", "2024-01-31T00:00:00+00:00" if i % 26 else "at some time") for i in range(1, 150)]
    rows += [(200 + i, "equal story told again", "by all", ["Siemens Gamesa", "Vestas"], "offshore_wind", f"2024-01-{10 + i % 3:02d}", "2024-01-31T00:00:00+00:00") for i in range(14)]
    rows += [(300, "", "", [], "offshore_wind", "2024-01-05", "x"), (301, "a b", None, ["Vestas"], "offshore_wind", "2024-01-05", "x"), (302, None, None, ["Vestas"], "adjacent_energy", "2024-01-06", "x")]
    return rows


def plain_pairs(rows, window=7):
    """All pairs by comparing everything with everything."""
    import re
    from datetime import datetime, timezone

    def time(text):
        try:
            t = datetime.fromisoformat(text)
        except ValueError:
            return None
        return (t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp()

    found = lambda text: set(re.findall("[a-z0-9]{3,}", text.lower()))
    overlap = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    every = [(i, (at or made, made, -i), kind or "other_energy", time(at or made), found(f"{t or ''} {s or ''}"), found(",".join(names))) for i, t, s, names, kind, at, made in rows]
    wind, out = ("offshore_wind", "adjacent_energy"), []
    for a in every:
        for b in every:
            if a[1] > b[1] and (a[2] == b[2] or (a[2] in wind and b[2] in wind)) and (a[3] is None or b[3] is None or abs(math.floor((a[3] - b[3]) / 86400)) <= window):
                score = 0.75 * overlap(a[4], b[4]) + 0.25 * overlap(a[5], b[5])
                if score >= 0.14:
                    out.append((a[0], b[0], score, b[1]))
    return out


@pytest.fixture(scope="module")
def told(spark):
    from market_signals.operators import items as it

    kind = "id long, title string, summary string, actors array<string>, domain_bucket string, published_at string, processed_at string"
    return it.placed(spark.createDataFrame(pair_rows(), kind))


def test_blocked_pairs_equal_brute_force_with_edges(told):
    from market_signals.operators import matching as m

    got = sorted((r["left_id"], r["right_id"], r["score"]) for r in m.candidate_pairs(told).collect())
    assert got == sorted(p[:3] for p in plain_pairs(pair_rows()))


@pytest.mark.parametrize("k", [1, 3, 8])
def test_best_pairs_equal_those_of_all_pairs(told, k):
    from market_signals.operators import matching as m

    want, each = [], {}
    for p in plain_pairs(pair_rows()):
        each.setdefault(p[0], []).append(p)
    for own in each.values():
        # the best first; of equal ones the later place
        own.sort(key=lambda p: p[3], reverse=True)
        own.sort(key=lambda p: -p[2])
        want += [p[:3] for p in own[:k]]
    assert sorted((r["left_id"], r["right_id"], r["score"]) for r in m.top_pairs(told, k).collect()) == sorted(want)


@pytest.mark.parametrize("k", [1, 3, 8])
def test_best_pairs_in_small_chunks_without_a_join_of_keys(told, k):
    from market_signals.operators import matching as m

    whole, small = m.top_pairs(told, k), m.top_pairs(told, k, size=3)
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and small.rdd.getNumPartitions() > whole.rdd.getNumPartitions()
    of = lambda df: sorted((r["left_id"], r["right_id"], r["score"]) for r in df.collect())
    assert of(small) == of(whole)
    each = {}
    for p in plain_pairs(pair_rows()):
        each.setdefault(p[0], []).append(p[2])
    assert sorted(x[2] for x in of(small)) == sorted(x for own in each.values() for x in sorted(own, reverse=True)[:k])
    assert m.top_pairs(told.where("id < 0"), k).count() == 0


@pytest.mark.parametrize(("common", "seen", "run", "block", "found", "size"), [(1, 7, 5, 3, 4, None), (4, 40, 2, 2, 1, 16), (0, 50, 64, 8, 1 << 21, 30), (160, 64, 64, 1, 1, 5)])
def test_best_pairs_by_blocks_and_by_words(told, common, seen, run, block, found, size, monkeypatch):
    from market_signals.operators import matching as m
    from market_signals.operators import nearest

    for name, value in (("SEEN", seen), ("RUN", run), ("BLOCK", block), ("FOUND", found), ("PAIRS", 3)):
        monkeypatch.setattr(nearest, name, value)
    monkeypatch.setattr(m, "COMMON", common)
    each = {}
    for p in plain_pairs(pair_rows()):
        each.setdefault(p[0], []).append(p)
    got = {}
    for r in m.top_pairs(told, 3, size=size).collect():
        got.setdefault(r["left_id"], []).append((r["right_id"], r["score"]))
    assert set(got) == set(each)
    for left, own in each.items():
        own.sort(key=lambda p: p[3], reverse=True)
        own.sort(key=lambda p: -p[2])
        assert sorted(got[left]) == sorted(p[1:3] for p in own[:3])


def test_few_of_the_items_met_are_compared():
    import numpy as np
    import pyarrow as pa

    from market_signals.operators import nearest

    # 50 titles of six common words each, and a word of its own in every item; the chunk has one of the titles
    n = 40_000

    def table(some):
        words = [[100 * (i % 50) + j for j in range(6)] + [100_000 + i] for i in some]
        column = lambda x: pa.array(x, pa.int64())
        lists = lambda x: pa.array(x, pa.list_(pa.int64()))
        return pa.table({"id": column(some), "rank": column(some), "same": column(some), "at": column([0] * len(some)), "story": column([i % 50 for i in some]), "words": lists(words), "names": lists([[]] * len(some))})

    common = np.array([100 * i + j for i in range(50) for j in range(6)])
    own = range(7, n, 50)
    chunk, met = nearest._Chunk(table(own), common, 8, 7, 0.14, 0.75, 0.25), nearest._Seen(table(range(n)), common)
    compared = []

    class Columns(np.ndarray):
        def __getitem__(self, at):
            compared.append(len(range(*at.indices(n))))
            return np.asarray(self)[at]

    met.columns = met.columns.view(Columns)
    chunk.meet(met)
    assert chunk.best().num_rows == sum(min(8, i) for i in range(len(own)))
    assert chunk.partner[-1].tolist() == [n - 43 - 50 * i for i in range(1, 9)]
    assert 0 < sum(compared) < n / 2


def test_copies_of_items_do_not_grow_with_the_table(spark, monkeypatch):
    from market_signals.operators import items as it
    from market_signals.operators import matching as m

    monkeypatch.setattr(m, "SMALL", 4)
    kind = "id long, title string, summary string, actors array<string>, domain_bucket string, published_at string, processed_at string"
    copies = []
    for n in (400, 1600):
        rows = it.placed(spark.createDataFrame([(i, f"wind w{i % 9}", "", [], "offshore_wind", "2024-01-05T00:00:00", "x") for i in range(n)], kind))
        dealt, _ = m._dealt(rows, 7, None)
        copies.append(dealt.where("side = 1").count() / n)
    assert copies[0] <= 4 * spark.sparkContext.defaultParallelism + 1 and copies[1] <= 1.1 * copies[0]


@pytest.mark.parametrize("size", [8192, 3])
def test_all_pairs_in_chunks_without_a_join_of_keys(told, size, monkeypatch):
    from market_signals.operators import matching as m
    from market_signals.operators import nearest

    # in small runs of pairs, and with few words in columns of their own
    monkeypatch.setattr(nearest, "PAIRS", 2)
    monkeypatch.setattr(m, "COMMON", 1)
    found = m.all_pairs(told, size=size)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["left_id"], r["right_id"], r["score"]) for r in found.collect()) == sorted(p[:3] for p in plain_pairs(pair_rows()))
    assert m.all_pairs(told.where("id < 0")).count() == 0


def test_match_pairs_joins_no_keys(spark):
    from market_signals.plans import queries as q

    assert "SortMergeJoin" not in q.QUERIES["match_pairs"](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [1, 2, 1 << 18])
def test_common_values_are_counted_in_runs(size, monkeypatch):
    import numpy as np

    from market_signals.operators import nearest

    monkeypatch.setattr(nearest, "PAIRS", size)
    counts = np.zeros((3, 2), np.float32)
    nearest._add_common(counts, np.array([5, 7, 5, 9, 7]), np.array([0, 0, 1, 1, 2]), np.array([5, 5, 7, 8]), np.array([0, 1, 1, 0]))
    assert counts.tolist() == [[1, 2], [1, 1], [0, 1]]


def test_bounds_keep_pairs_in_the_join(told):
    from market_signals.operators import matching as m

    items = m.keep(m.ordered(m.keep(m.prepared(told))))
    assert m.top_candidates(items, 2).count() < m.pair_candidates(items).count()


def test_drained_rows_are_files(spark, tmp_path):
    from market_signals.streaming import jobs

    spark.range(40).selectExpr("id", "id % 7 AS k").repartition(4).write.parquet(str(tmp_path / "some"))
    (tmp_path / "none").mkdir()
    got = {name: jobs.drain(jobs.landed(spark, str(tmp_path / name), "id long, k long", 1), str(tmp_path / f"{name}_checkpoint")) for name in ("some", "none")}
    assert got["some"].inputFiles() and sorted((r["id"], r["k"]) for r in got["some"].collect()) == [(i, i % 7) for i in range(40)]
    assert got["none"].count() == 0


def test_streams_resume_from_their_checkpoint(spark, tmp_path):
    from market_signals.streaming import jobs

    source, checkpoint = str(tmp_path / "landed"), str(tmp_path / "checkpoint")
    for first in (0, 30):
        spark.range(first, first + 30).selectExpr("id", "id % 7 AS k").write.mode("append").parquet(source)
        got = jobs.drain(jobs.landed(spark, source, "id long, k long"), checkpoint)
        # files of the first run aren't read again
        assert sorted(r["id"] for r in got.collect()) == list(range(first + 30))


def test_verdicts_without_confidence_stay_verdicts(spark):
    from market_signals.operators import matching as m

    pairs = spark.createDataFrame([(1, 2, 0.3), (1, 3, 0.3), (1, 4, 0.3), (1, 5, 0.1)], "left_id long, right_id long, score double")
    said = spark.createDataFrame([(1, 2, " YES ", None, "same", ["A ", " "], "week"), (1, 3, "maybe", 0.9, "x", None, None), (1, 4, "yes", 0.8, None, None, None)], "left_id long, right_id long, same_story string, confidence double, reason_short string, overlap_entities array<string>, overlap_timeframe string")
    got = {r["right_id"]: r for r in m.judge(pairs, said).collect()}
    assert (got[2]["same_story"], got[2]["confidence"], got[2]["fallback"], got[2]["enqueue"], got[2]["overlap_entities"], got[2]["reason_short"]) == ("yes", 0.0, False, False, ["A"], "same")
    assert got[3]["fallback"] and got[3]["enqueue"] and got[3]["same_story"] == "no" and got[3]["reason_short"] == "ai_unavailable_or_invalid"
    assert got[4]["enqueue"] and not got[4]["fallback"] and got[5]["fallback"] and not got[5]["enqueue"]


def test_profiles_and_sources_load_from_json_with_broken_rows(spark):
    from market_signals.operators import notices as nt
    from market_signals.operators import registry as rg

    rows = [(0, '{"company":" agr ","keywords":["A"," b "],"aliases":"B, c","cpv_codes":["71354500-1","00000000","x"],"qualifier":[]}'), (1, "[1]"), (2, "{"), (3, '{"company":""}'), (4, None), (5, '{"company":"MAV","name":" M "}')]
    df = spark.createDataFrame(rows, "place int, profile_json string")
    got = {r["company"]: r for r in nt.load_profiles(df).collect()}
    assert set(got) == {"AGR", "MAV"} and got["AGR"]["keywords"] == ["a", "b", "c"] and got["AGR"]["name"] == "AGR" and got["MAV"]["name"] == "M" and got["MAV"]["cpv"] == []
    assert [r["company"] for r in nt.load_profiles(df, [" mav "]).collect()] == ["MAV"]
    sources = spark.createDataFrame([(2, 1, '{"name":"X","type":"rss","enabled":true}'), (1, 2, "null"), (0, 3, "oops")], "position int, id int, source_json string")
    assert [(r["position"], r["name"], r["enabled"]) for r in rg.load_registry(sources).collect()] == [(2, "X", True)]


def test_profiles_and_sources_load_from_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    from market_signals.operators import notices as nt
    from market_signals.operators import registry as rg
    from market_signals.sources import config

    (tmp_path / "p.yaml").write_text("profiles:\n  - company: agr\n    keywords: [A, ' b ']\n    aliases: B, c\n    cpv_codes: ['71354500', 71354501]\n  - just a text\n  - company: mav\n    name: M\n")
    got = {r["company"]: r for r in nt.load_profiles(config.yaml_profiles(spark, str(tmp_path / "p.yaml"))).collect()}
    assert set(got) == {"AGR", "MAV"} and got["AGR"]["keywords"] == ["a", "b", "c"] and got["AGR"]["cpv"] == ["71354500", "71354501"] and got["MAV"]["name"] == "M"
    (tmp_path / "s.yaml").write_text("- name: X\n  type: rss\n  enabled: true\n  url: https://x.example.org/feed\n- name: Y\n  type: scrape\n  enabled: false\n- 3\n")
    rows = rg.load_registry(config.yaml_registry(spark, str(tmp_path / "s.yaml"))).collect()
    assert [(r["position"], r["name"], r["enabled"]) for r in sorted(rows, key=lambda r: r["position"])] == [(0, "X", True), (1, "Y", False)]
    (tmp_path / "none.yaml").write_text("profiles:\n")
    assert config.yaml_profiles(spark, str(tmp_path / "none.yaml")).count() == 0


def test_pages_go_to_python_in_bounded_batches(spark, tmp_path):
    from pyspark.sql import functions as F

    from market_signals.session import BATCH
    from market_signals.sources.fixtures import view

    before = spark.conf.get(BATCH[0])
    try:
        spark.conf.set(BATCH[0], str(1 << 30))
        text = F.concat(F.lit("<html><head></head>"), F.repeat(F.lit("x"), 20_000))
        spark.range(0, 2000, 1, 1).select(F.col("id").alias("page_id"), F.lit("https://a.example/").alias("url"), text.alias("html")).write.parquet(str(tmp_path / "pages.parquet"))

        def rows(batches):
            for b in batches:
                yield b.select([]).from_pydict({"n": [b.num_rows]})

        pages = view(spark, str(tmp_path), "crawl_pages").coalesce(1)
        assert max(r["n"] for r in pages.select("html").mapInArrow(rows, "n long").collect()) < 1000
    finally:
        spark.conf.set(BATCH[0], before)


def test_landed_files_grow_with_the_input(spark, monkeypatch):
    from market_signals.plans import queries as q

    kept = []
    monkeypatch.setattr(q, "raw", lambda s, sf: q.view(s, sf, "news_raw").repartition(11))
    monkeypatch.setattr(q, "keep", lambda df, keep=q.keep: kept.append(keep(df)) or kept[-1])
    q._landed(spark, SF)
    assert len(kept[0].inputFiles()) == 11 and kept[0].count() == q.view(spark, SF, "news_raw").count()


@pytest.mark.parametrize("name", ["process", "latest_of", "fitting", "rejected"])
def test_a_notice_text_is_made_once(spark, name):
    from market_signals.operators import notices as nt
    from market_signals.plans import queries as q

    rows, p = q.view(spark, SF, "notice_raw"), q.profiles(spark)
    df = {"process": lambda: nt.process(rows, p, q.AS_OF, q.AS_OF_TEXT), "latest_of": lambda: nt.matched(nt.latest_of(rows, p, q.AS_OF, q.AS_OF_TEXT).select("id").join(rows, "id"), p), "fitting": lambda: nt.fitting(rows, p), "rejected": lambda: nt.fitting(rows, p, False)}[name]()
    filters = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x]
    assert filters and not any("regexp_replace" in x for x in filters)


def test_a_notice_is_searched_once_for_each_fit_and_date(spark):
    from market_signals.functions import opportunity as o
    from market_signals.plans import queries as q

    rows = spark.range(1).select(F.col("id").cast("string").alias("low"))
    plan = lambda c: rows.select(c.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    fit = plan(o.best_fit(F.col("low"), F.lit("NOR"), q.profiles(spark)))
    assert fit.count("lambdafunction(") == 4  # qualifiers and services, each once a company
    assert plan(o.deadline(F.col("low"))).count("regexp_extract(") == 10


def test_dates_and_fits_keep_their_values(spark):
    from market_signals.functions import opportunity as o
    from market_signals.plans import queries as q

    texts = ["by 1.2.2024", "by 31.02.2024", "due 3/11/2031 or later", "until 5 May 2024", "until 31 june 2024", "on 2024-13-45", "nothing", "", "at 29.2.2023", "at 29-2-2024"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in rows.orderBy("i").select(o.deadline(F.col("t"))).collect()] == ["2024-02-01", None, "2031-11-03", "2024-05-05", None, "2024-13-45", None, None, None, "2024-02-29"]
    texts = ["offshore advisory with strategy", "marine survey of a port, advisory", "marine survey near a school, advisory at the port", "advisory", "offshore", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    fits = [r[0] and r[0][:] for r in rows.orderBy("i").select(o.best_fit(F.col("t"), F.lit("NOR"), q.profiles(spark))).collect()]
    assert fits == [(13, -1, "MAV", ["Strategy & Advisory"], ["offshore"]), (13, 0, "AGR", ["Marine Survey & Geoscience"], ["marine"]), (13, -1, "MAV", ["Strategy & Advisory"], ["port"]), None, None, None]


@pytest.mark.parametrize("mode", ["latest", "upcoming_deadlines", "high_relevance"])
def test_selected_notices_alone_are_processed(spark, mode):
    from market_signals.operators import notices as nt
    from market_signals.plans import queries as q

    rows, p = q.view(spark, SF, "notice_raw"), q.profiles(spark)
    some = nt.selected_of(rows, p, mode, q.AS_OF, q.AS_OF_TEXT, 30)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan  # a sort of all notices makes each fit twice
    whole = nt.selected(nt.process(rows, p, q.AS_OF, q.AS_OF_TEXT), mode, q.AS_OF, 30)
    assert some.collect() == whole.collect() and some.count() == 30


@pytest.mark.parametrize("name", ["opp_upcoming_deadlines", "opp_high_relevance", "export_selected", "export_selected_latest", "export_selected_upcoming", "export_payload"])
def test_selections_store_no_notices(spark, name):
    from market_signals.session import kept

    before = kept(spark)
    QUERIES[name](spark, SF)
    assert kept(spark) == before
