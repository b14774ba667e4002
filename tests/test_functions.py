from pyspark.sql import functions as F

from market_signals.functions import news, opportunity, text, urls
from market_signals.operators import items, notices, registry, state
from market_signals.sources import html as pages
from market_signals.sources import notices as sources


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_clean_and_lead(spark):
    assert one(spark, "  a \n\t b  ", text.clean) == "a b"
    assert one(spark, "", text.lead) == "No summary available."
    assert one(spark, "A. B! C? D.", text.lead) == "A. B! C?"


def test_short_terms_are_words(spark):
    f = lambda c: text.has_word(F.lower(c), ["eu", "uk"])
    assert one(spark, "Neutral duke", f) is False
    assert one(spark, "the EU, again", f) is True


def test_domain_examples(spark):
    f = lambda c: news.domain(text.norm(c))
    assert tuple(one(spark, "Offshore wind farm gets a floating wind neighbour", f)) == ("offshore_wind", 0.92)
    assert one(spark, "Refinery adds an oil and gas drilling unit", f)["bucket"] == "other_energy"
    assert tuple(one(spark, "  ", f)) == ("other_energy", 0.4)
    assert one(spark, "turbine installation in gas port offshore", f)["confidence"] >= 0.68


def test_confidence_words(spark):
    got = [one(spark, v, news.confidence) for v in ("0.9", "84", "84%", "high", "lav", "200", None, "x")]
    assert got == [0.9, 0.84, 0.84, 0.85, 0.35, 1.0, 0.5, 0.5]


def test_article_urls(spark):
    f = urls.is_article_url
    assert one(spark, "https://x.com/news", f) is False
    assert one(spark, "https://x.com/p?id=", f) is False
    assert one(spark, "https://x.com/p?id=3", f) is True
    assert one(spark, "https://x.com/2024/story-about-7", f) is True
    assert one(spark, "https://x.com", f) is False
    assert one(spark, None, f) is False


def test_host_key_drops_every_www(spark):
    assert one(spark, "www.a.www.b.com/x", urls.host_key) == "a.b.com"
    assert one(spark, "", urls.host_key) == ""


def test_deadlines(spark):
    f = opportunity.deadline
    assert one(spark, "offers until 2027-09-03 at noon", f) == "2027-09-03"
    assert one(spark, "2027-14-50 and 01.02.2027", f) == "2027-14-50"
    assert one(spark, "31.02.2024", f) is None
    assert one(spark, "5 March 2024", f) == "2024-03-05"
    days = lambda c: opportunity.days_left(c, "2024-01-31 10:00:00")
    assert one(spark, "2024-01-31", days) == -1
    assert one(spark, "2027-14-50", days) is None


def test_export_dates(spark):
    assert one(spark, "2027-11-30T05:06:07Z", notices.export_date) == "2027-11-30"
    assert one(spark, "no date yet", notices.export_date) is None


def test_profiles_merge_and_clean(spark):
    given = [{"company": "agr", "name": "Marine", "keywords": ["survey"], "aliases": "Hydrographic, survey", "qualifier": ["offshore"], "negative_keywords": ["school"], "cpv_codes": ["71354500", "00000000", "7135-4500"]}]
    row = notices.profile_table(spark, given, ["AGR"]).first()
    assert row["keywords"] == ["survey", "hydrographic"] and row["cpv"] == ["71354500"]
    assert notices.profile_table(spark, given, ["MAV"]).count() == 0
    bundle = notices.bundle(notices.profile_table(spark, given))
    raw = spark.createDataFrame([(1, "A", "Offshore survey", "", "", "NOR"), (2, "B", "Offshore survey of a school", "", "", "NOR")], "id long, notice_id string, title_raw string, description_raw string, buyer_raw string, country_raw string")
    got = {r["id"]: r["fit"] for r in notices.matched(raw, bundle).collect()}
    assert got[1]["profile_name"] == "AGR" and got[1]["fit"] == 13 and got[2] is None


def test_equal_fit_takes_the_earlier_company(spark):
    p = {"name": "x", "keywords": ["survey"], "qualifier": ["offshore"], "negative_keywords": []}
    raw = spark.createDataFrame([(1, "Offshore survey")], "id long, t string").select("id", opportunity.best_fit(F.lower("t"), F.lit("NOR"), {"B": [p], "A": [p]}).alias("fit"))
    assert raw.first()["fit"]["profile_name"] == "B"


def test_second_insert_is_not_inserted(spark):
    new = spark.createDataFrame([("u", 1), ("u", 2), ("v", 3)], "article_url string, id long")
    added = state.insert_if_absent(new, new.limit(0), "article_url", "id")
    assert sorted(r["id"] for r in added.collect()) == [1, 3]
    assert state.insert_if_absent(new, added, "article_url", "id").count() == 0


def test_null_deletes_a_key(spark):
    log = spark.createDataFrame([(1, 1, 1), (1, 2, None), (2, 1, 0)], "k long, t long, v int")
    assert [tuple(r) for r in state.latest_state(log, "k", "v", ["t"]).collect()] == [(2, 0)]


def test_pasted_sources(spark):
    lines = spark.createDataFrame([("Harbour Post - harbourpost.example\nhttps://seabed.example\n\nnothing here",)], "text string")
    got = [(r["name"], r["homepage"]) for r in registry.parse_lines(lines).orderBy("ord").collect()]
    assert got == [("Harbour Post", "https://harbourpost.example"), ("Seabed", "https://seabed.example")]


def test_later_source_wins_ties(spark):
    rows = [(1, "a", "x.com", "scrape", "", True), (2, "b", "www.x.com", "scrape", "", True), (3, "c", "", "rss", "", True), (4, "d", "", "rss", "", True)]
    got = registry.dedupe(spark.createDataFrame(rows, "position int, name string, homepage string, type string, url string, enabled boolean")).orderBy("first_position").collect()
    assert [(r["name"], r["first_position"]) for r in got] == [("b", 1), ("c", 3), ("d", 4)]


def test_json_answers(spark):
    rows = [(1, '{"a":1}'), (2, 'Sure: {"a":{"b":2}} bye'), (3, "[1]"), (4, "no"), (5, None)]
    got = spark.createDataFrame(rows, "i int, t string").select("i", items.json_object(F.col("t")).isNotNull().alias("ok")).collect()
    assert {r["i"]: r["ok"] for r in got} == {1: True, 2: True, 3: False, 4: False, 5: False}


def test_language_maps(spark):
    rows = ['{"t":{"eng":["A"]}}', '{"t":{"fra":"F","en":"E"}}', '{"t":["L"]}', '{"t":"S"}', '{"t":{"nor":["N"]}}', "{}"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, body string").withColumn("v", F.try_parse_json("body"))
    assert [r["x"] for r in df.orderBy("i").select(sources.first_value("t").alias("x")).collect()] == ["A", "E", "L", "S", "N", ""]


def test_envelopes(spark):
    df = spark.createDataFrame([('{"procnotices":[{"id":1},{"id":2}]}',), ('{"rows":{"a":{"id":3}}}',), ('[{"id":4}]',)], "body string")
    assert sorted(r["body"] for r in sources.unwrap(df).collect()) == ['{"id":1}', '{"id":2}', '{"id":3}', '{"id":4}']


def test_article_text_and_links():
    page = "<html><head><link rel=alternate type='application/rss+xml' href='/feed'></head><p>Out</p><article><p>One <b>two<p>Three</article><a href='../x'>Go <i>on</i></a></html>"
    assert pages.article_text_of(page) == "One two Three"
    links = pages.links_of("https://a.com/b/c", page)
    assert [(x["href"], x["text"], x["rel"]) for x in links] == [("https://a.com/feed", "", "alternate"), ("https://a.com/x", "Go on", "")]
    assert pages.article_text_of(None) == "" and pages.links_of(None, None) == []


def test_tags_are_made_once_and_a_lead_stops_early(spark):
    from pyspark.sql import functions as F

    from market_signals.functions import news as n
    from market_signals.functions.text import lead, or_default

    rows = spark.range(1).select(F.col("id").cast("string").alias("low"))
    plan = lambda c: rows.select(c.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(n.theme_tags(F.col("low"))).count("supply chain") == 1
    assert plan(n.geography_tags(F.col("low"))).count("norwegian") == 1
    assert r"(?<=[.!?])\s+, 4)" in plan(lead(F.col("low")))
    tags = spark.createDataFrame([(0, ["a", "b"]), (1, []), (2, None)], "i int, t array<string>").orderBy("i")
    assert [r[0] for r in tags.select(or_default(F.col("t"), "d")).collect()] == [["a", "b"], ["d"], ["d"]]
    texts = spark.createDataFrame([(0, "A. B! C? D. E."), (1, "A."), (2, "A. B"), (3, "")], "i int, t string").orderBy("i")
    assert [r[0] for r in texts.select(lead(F.col("t"), 2)).collect()] == ["A. B!", "A.", "A. B", "No summary available."]
