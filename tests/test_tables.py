"""Keyed tables, history in buckets, and the streams that write them."""

import os
import random

import pytest
from pyspark.sql import functions as F

from market_signals.operators import registry as rg
from market_signals.operators import state as st
from market_signals.operators import tables as tb
from market_signals.streaming import jobs

KIND = "k long, ts long, v string"


def batch(spark, rows):
    return spark.createDataFrame(rows, KIND)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_batches_out_of_order_with_deletions(spark, tmp_path):
    rng = random.Random(5)
    log = [(rng.randrange(60), ts, None if rng.random() < 0.3 else f"v{ts}") for ts in range(300)]
    rng.shuffle(log)
    path = str(tmp_path / "t")
    for i in range(3):
        tb.rewrite(batch(spark, log[i * 100 : i * 100 + 100]), path, ["k"], tb.last_wins(["k"], ["ts"]), 8)
        seen = {}
        for k, ts, v in sorted(log[: i * 100 + 100], key=lambda r: r[1]):
            seen[k] = (k, ts, v)
        assert rows_of(tb.live(tb.read_table(spark, path), "v")) == sorted(r for r in seen.values() if r[2] is not None)
    assert tb.versions(spark, path) == [1, 2, 3]
    # an older version reads as it was
    assert tb.read_table(spark, path, 1).count() == len({k for k, _, _ in log[:100]})


def test_a_batch_rewrites_only_its_buckets_and_a_dead_write_is_never_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    change = tb.replaces(["k"], ["ts"])
    tb.rewrite(batch(spark, [(k, 0, "old") for k in range(200)]), path, ["k"], change, 16)
    before = tb.version(spark, path)
    hit = tb.rewrite(batch(spark, [(3, 0, "a"), (3, 1, "new"), (1000, 1, "more")]), path, ["k"], change)
    after = tb.version(spark, path)
    assert 1 <= len(hit) <= 2 and {b for b in before.folders if before.folders[b] != after.folders[b]} == set(map(str, hit))
    want = sorted([(k, 0, "old") for k in range(200) if k != 3] + [(3, 1, "new"), (1000, 1, "more")])
    assert rows_of(tb.read_table(spark, path)) == want

    # a write dies when its files are there, but before its version is
    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(tb, "publish", dies)
        with pytest.raises(OSError):
            tb.rewrite(batch(spark, [(k, 2, "half") for k in range(200)]), path, ["k"], change)
    assert rows_of(tb.read_table(spark, path)) == want and tb.version(spark, path) == after

    # and one while its files are written
    bad = spark.range(50).select(F.col("id").alias("k"), F.lit(5).cast("long").alias("ts"), F.when(F.col("id") == 49, F.raise_error(F.lit("broken row"))).otherwise("half").cast("string").alias("v"))
    with pytest.raises(Exception, match="broken row"):
        tb.rewrite(bad, path, ["k"], change)
    assert rows_of(tb.read_table(spark, path)) == want
    tb.rewrite(batch(spark, [(k, 2, "whole") for k in range(200)]), path, ["k"], change)
    assert rows_of(tb.read_table(spark, path)) == sorted([(k, 2, "whole") for k in range(200)] + [(1000, 1, "more")])
    assert tb.clean(spark, path, 1) >= 2 and tb.clean(spark, path, 1) == 0
    assert tb.versions(spark, path) == [3] and tb.read_table(spark, path).count() == 201
    with pytest.raises(RuntimeError, match="another writer"):
        tb.publish(spark, path, tb.version(spark, path))


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    path, size = str(tmp_path / "t"), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    rows = spark.range(0, 60_000, 1, 8).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("ts"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    spark.conf.set(size, "200000")
    try:
        tb.rewrite(rows, path, ["k"], tb.replaces(["k"], ["ts"]), 2)
        tb.rewrite(rows.where("k < 30000").withColumn("ts", F.lit(1).cast("long")), path, ["k"], tb.replaces(["k"], ["ts"]), 2)
    finally:
        spark.conf.set(size, before)
    got = tb.read_table(spark, path)
    assert got.agg(F.count("*"), F.countDistinct("k"), F.sum("ts")).first()[:] == (60_000, 60_000, 30_000)
    files = [f.rsplit("/", 2)[1] for f in got.inputFiles()]
    assert set(files) == {"_bucket=0", "_bucket=1"} and min(files.count(b) for b in set(files)) > 1


def test_numbered_batches_count_once_and_empty_ones_change_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        tb.read_table(spark, path)
    write = jobs.merge_batches(path, ["k"], tb.last_wins(["k"], ["ts"]), 4)
    write(batch(spark, []), 0)
    assert tb.read_table(spark, path).count() == 0
    write(batch(spark, [(1, 1, "a"), (None, 1, "none")]), 1)
    write(batch(spark, [(1, 9, "again")]), 1)
    write(batch(spark, [(None, 2, None), (2, 1, "b")]), 2)
    assert sorted(map(str, tb.live(tb.read_table(spark, path), "v").collect())) == sorted(map(str, batch(spark, [(1, 1, "a"), (2, 1, "b")]).collect()))


def test_history_isn_t_shuffled_by_an_insert(spark, tmp_path):
    tb.history(spark, "h_items", str(tmp_path / "h"), "url string, id long", "url", 8)
    kind = "url string, id long"
    tb.insert_absent(spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], kind), "h_items", "url", "id", 8)
    new = spark.createDataFrame([("b", 4), ("c", 6), ("c", 5), ("a", 0)], kind)
    plan = tb.absent(new, spark.table("h_items"), "url", "id", 8)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-*"))
    above, level = [], depth(lines[scan])
    for x in lines[scan::-1]:
        if depth(x) < level:
            above.append(x)
            level = depth(x)
    assert not any("Exchange" in x for x in above) and any("SortMergeJoin" in x for x in above) and "Bucketed: true" in plan
    assert plan.count("Exchange") == 1
    for _ in range(2):
        tb.insert_absent(new, "h_items", "url", "id", 8)
    assert rows_of(spark.table("h_items")) == [("a", 1), ("b", 3), ("c", 5)]
    # another session finds the same buckets
    spark.sql("DROP TABLE h_items")
    tb.history(spark, "h_items", str(tmp_path / "h"), "url string, id long", "url", 8)
    assert rows_of(spark.table("h_items")) == [("a", 1), ("b", 3), ("c", 5)]
    spark.sql("DROP TABLE h_items")


def land(spark, rows, kind, path):
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("order", ["sorted", "shuffled", "backwards"])
def test_health_of_runs_that_land_in_any_order(spark, tmp_path, order):
    kind = "run string, source string, kept long, error string"
    log = [(f"2024-01-{1 + i // 3:02d}", f"s{i % 3}", (i * 7) % 11, "timeout" if i % 8 == 5 else None) for i in range(30)]
    if order != "sorted":
        log = log[::-1] if order == "backwards" else random.Random(2).sample(log, len(log))
    source, table, checkpoint = str(tmp_path / "log"), str(tmp_path / "table"), str(tmp_path / "checkpoint")
    for part in (log[:9], log[9:10], log[10:] + log[:2]):
        land(spark, part, kind, source)
        jobs.each_batch(jobs.landed(spark, source, kind), jobs.health_batches(table, 4), checkpoint)
    assert rows_of(tb.read_table(spark, table).na.fill("")) == rows_of(rg.health(spark.createDataFrame(log, kind)).na.fill(""))


def test_failed_rows_go_aside_and_a_repeated_batch_overwrites_both_sinks(spark, tmp_path):
    good, failed = str(tmp_path / "good"), str(tmp_path / "failed")
    write = jobs.split_batches(good, failed, F.when(F.col("v").isNull(), "no value"), lambda rows: rows.select("k"))
    first = batch(spark, [(1, 1, "a"), (2, 1, None), (3, 1, "c")])
    write(first, 0)
    write(first, 0)
    write(batch(spark, [(4, 1, None)]), 1)
    assert sorted(r["k"] for r in spark.read.parquet(good).collect()) == [1, 3]
    assert sorted((r["k"], r["reason"]) for r in spark.read.parquet(failed).collect()) == [(2, "no value"), (4, "no value")]


def test_updates_write_only_what_changes(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / x) for x in ("log", "table", "checkpoint"))
    kind = "k long, ts long, v long"
    for part in ([(k, 1, k) for k in range(100)], [(7, 2, 70), (8, 0, 80)], [(7, 3, None)]):
        land(spark, part, kind, source)
        stream = jobs.current_values(jobs.landed(spark, source, kind), "k", "v", ["ts"])
        jobs.each_batch(stream, jobs.merge_batches(table, ["k"], tb.replaces(["k"], ["ts"]), 16), checkpoint, "update")
    got = {r["k"]: r["v"] for r in tb.read_table(spark, table).collect()}
    assert got == {k: None if k == 7 else k for k in range(100)}
    v = [tb.version(spark, table, n) for n in tb.versions(spark, table)]
    assert len(set(v[0].folders.values())) == 1 and len(v) == 3
    assert sum(v[2].folders[b] != v[1].folders[b] for b in v[2].folders) == 1


def test_first_seen_goes_on_with_its_state_in_rocksdb(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    source, checkpoint, kind = str(tmp_path / "landed"), str(tmp_path / "checkpoint"), "article_url string, published_at string"
    jobs.with_rocksdb(spark)
    try:
        for part in ([("a", "2024-01-03"), ("b", None)], [("a", "2024-01-01"), ("b", None), ("c", None)], [("a", None)]):
            land(spark, part, kind, source)
            got = jobs.drain(jobs.once(jobs.landed(spark, source, kind)).select("article_url"), checkpoint)
    finally:
        spark.conf.set(provider, before)
    assert sorted(r["article_url"] for r in got.collect()) == ["a", "b", "c"]


def test_metrics_are_counted_while_rows_are_written(spark):
    table, counts = st.observed(spark.range(100).withColumn("x", F.col("id") % 7), "a run", F.count("*").alias("n"), F.count_if(F.col("x") == 3).alias("threes"), F.sum("x").alias("sum"))
    assert table.count() == 100 and table.inputFiles()
    assert [tuple(r) for r in counts.collect()] == [(100, 14, sum(i % 7 for i in range(100)))]


RSS = """<?xml version="1.0"?><rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>Channel</title><link>https://x.example.org/</link>
<item><title>One &amp; only</title><link> https://x.example.org/1 </link><description> told </description><content:encoded><![CDATA[<p>first</p>]]></content:encoded><content:encoded>second</content:encoded><media:title>other</media:title><pubDate>Tue, 5 Mar 2024 07:08:09 GMT</pubDate></item>
<item><title>Cut <b>off</title><link>https://x.example.org/2</link></item>
<item id="3"><title>Three</title><link>https://x.example.org/3</link><pubDate>some day</pubDate></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>Feed</title><link href="https://y.example.org/"/>
<entry><title type="html">A</title><link rel="self" href="https://y.example.org/self"/><link href="https://y.example.org/a"/><content type="html">alpha</content><content>beta</content><updated>2024-03-05T07:08:09Z</updated></entry>
<entry><title>B</title><link rel="alternate" href="https://y.example.org/b"/><summary>short</summary><published>2024-03-01T00:00:00+02:00</published><updated>2024-03-09T00:00:00Z</updated></entry>
<entry><title>C<link href="https://y.example.org/c"/></entry></feed>"""


def test_feeds_of_both_kinds_with_broken_entries(spark, tmp_path):
    from market_signals.sources import feeds as fd

    for name, text in (("rss site", RSS), ("atom site", ATOM), ("no feed", "<html><p>items</p></html>")):
        (tmp_path / f"source_name={name}").mkdir()
        (tmp_path / f"source_name={name}" / "feed.xml").write_text(text)
    feed = fd.read_feeds(spark, str(tmp_path))
    got = {r["article_url"]: (r["source_name"], r["title_raw"], r["summary_raw"], r["published_at"]) for r in fd.entries(feed).collect()}
    assert got == {
        "https://x.example.org/1": ("rss site", "One & only", "told", "2024-03-05T07:08:09+00:00"),
        "https://x.example.org/3": ("rss site", "Three", "", "some day"),
        "https://y.example.org/a": ("atom site", "A", "alpha", "2024-03-05T07:08:09+00:00"),
        "https://y.example.org/b": ("atom site", "B", "short", "2024-02-29T22:00:00+00:00"),
    }
    assert sorted((r["source_name"], r["kind"]) for r in fd.broken(feed).collect()) == [("atom site", "entry"), ("rss site", "item")]


def test_contents_decide_what_is_news(spark, tmp_path):
    from market_signals.sources import feeds as fd

    long = "The ministry opens a consultation. " * 12
    rows = [("s", f"https://x.example.org/2024/some-story-{i}", "Ministry opens a consultation on seabed leases", "in short", "2024-01-02T00:00:00Z", c) for i, c in enumerate([[long, "more"], ["too short"], []])]
    df = spark.createDataFrame(rows, "source_name string, link string, title string, summary string, published string, contents array<string>")
    for atom in (False, True):
        path = str(tmp_path / f"atom={atom}" / "feeds")
        fd.write_feed(df, path, atom)
        assert {r["article_url"][-1]: r["is_news"] for r in fd.entries(fd.read_feeds(spark, path)).collect()} == {"0": True, "1": False, "2": True}


def test_kept_tables_go_when_their_user_is_done(spark):
    from market_signals.session import keep, sweep

    sweep(spark)
    a, b = keep(spark.range(5)), keep(spark.range(3))
    files = [*a.inputFiles(), *b.inputFiles()]
    assert a.count() + b.count() == 8 and sweep(spark) == 2 and sweep(spark) == 0
    assert not any(os.path.exists(f.removeprefix("file://").removeprefix("file:")) for f in files)


def test_kept_tables_of_a_step_go_and_its_result_stays(spark):
    from market_signals.session import keep, kept, sweep

    sweep(spark)
    first = keep(spark.range(5))
    before = kept(spark)
    part = keep(first.where("id > 1"))
    result = keep(part.where("id > 2"))
    assert sweep(spark, before, result) == 1 and kept(spark) == 2
    assert first.count() == 5 and rows_of(result) == [(3,), (4,)]
    assert sweep(spark) == 2 and kept(spark) == 0
