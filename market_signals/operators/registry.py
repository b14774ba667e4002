"""Sources: registry rows, feeds, fetch reports and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from market_signals.functions import dictionaries as d
from market_signals.functions.text import filled, has_any
from market_signals.functions.urls import is_article_url, is_feed_like, name_of, normalize_url, source_host
from market_signals.operators.state import top_per


def enabled(sources: DataFrame, kind: str) -> DataFrame:
    return sources.where(F.col("enabled") & (F.col("type") == kind))


SOURCE = "name string, homepage string, type string, url string, enabled boolean, manual_override boolean"


def load_registry(rows: DataFrame) -> DataFrame:
    """Sources of JSON rows (id, position, source_json); rows that aren't a JSON object are dropped. Order by position and id."""
    good = F.schema_of_variant(F.try_parse_json("source_json")).startswith("OBJECT")
    return rows.where(good).withColumn("s", F.from_json("source_json", SOURCE)).select("position", "id", "s.*")


def dedupe(sources: DataFrame) -> DataFrame:
    """The best source of each host (feeds before pages, enabled ones first, later rows of equals), in order of a host's first row. Rows without a host stay."""
    host = source_host(F.col("homepage"), F.col("url"))
    rows = sources.withColumn("host", host).withColumn("_key", F.when(host == "", F.concat(F.lit("#"), F.col("position").cast("string"))).otherwise(host))
    rows = rows.withColumn("_score", F.when(F.col("type") == "rss", 2).otherwise(0) + F.col("enabled").cast("int"))
    first = rows.groupBy("_key").agg(F.min("position").alias("first_position"), F.max_by(F.struct(*sources.columns, "host"), F.struct("_score", "position")).alias("r"))
    return first.select("r.*", "first_position")


def dedupe_counts(sources: DataFrame) -> DataFrame:
    after = dedupe(sources).agg(F.count("*").alias("after"))
    return sources.agg(F.count("*").alias("before")).crossJoin(after).withColumn("removed_count", F.col("before") - F.col("after"))


def parse_lines(text: DataFrame) -> DataFrame:
    """ord, name, homepage of pasted lines: `Name - address`, or a line that holds an address. Further columns of `text` stay."""
    more = [c for c in text.columns if c != "text"]
    lines = text.select(*more, F.posexplode(F.split("text", r"\R")).alias("ord", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    pair = F.col("line").contains(" - ")
    found = F.regexp_extract("line", r"(https?://\S+|\b[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\S*)", 1)
    raw = F.when(pair, F.expr("substring(line, instr(line, ' - ') + 3)")).otherwise(found)
    name = F.when(pair, F.trim(F.expr("substring(line, 1, instr(line, ' - ') - 1)"))).otherwise(F.regexp_replace(F.expr("replace(line, found, '')"), r"^[ \-:\t]+|[ \-:\t]+$", ""))
    out = lines.withColumn("found", found).withColumn("homepage", normalize_url(raw)).withColumn("given", name)
    return out.where("homepage <> ''").select(*more, "ord", F.coalesce(F.nullif("given", F.lit("")), name_of(F.col("homepage"))).alias("name"), "homepage")


def import_sources(lines: DataFrame, sources: DataFrame, feeds: DataFrame) -> DataFrame:
    """New sources whose host isn't known yet, the first line of each host; a feed's address if one is discovered."""
    known = sources.select(source_host(F.col("homepage"), F.col("url")).alias("host")).distinct()
    new = lines.withColumn("host", source_host(F.col("homepage"), F.lit("")))
    new = top_per(new.join(known, "host", "left_anti"), ["host"], [F.asc("ord")]).join(feeds, "host", "left")
    return new.select("ord", "name", "homepage", "host", F.when(F.col("feed_url").isNotNull(), "rss").otherwise("scrape").alias("type"), F.coalesce("feed_url", "homepage").alias("url"))


def rediscover(sources: DataFrame, feeds: DataFrame, only_scrape: bool = True) -> DataFrame:
    """Sources with their discovered feed and what follows: updated, unchanged, no_feed_found, skipped or not checked."""
    out = sources.withColumn("host", source_host(F.col("homepage"), F.col("url"))).join(feeds, "host", "left")
    checked = (F.lit(not only_scrape) | (F.col("type") == "scrape")) & ~F.col("manual_override") & filled("homepage", "url").isNotNull()
    changed = (F.col("type") != "rss") | (F.col("url") != F.col("feed_url"))
    status = F.when(F.lit(only_scrape) & (F.col("type") != "scrape"), "not_checked").when(F.col("manual_override"), "skipped_manual_override").when(~checked, "not_checked")
    status = status.when(F.col("feed_url").isNull(), "no_feed_found").when(changed, "updated").otherwise("unchanged")
    out = out.withColumn("status", status)
    use = F.col("status") == "updated"
    return out.select("position", "name", "host", F.when(use, "rss").otherwise(F.col("type")).alias("type"), F.when(use, F.col("feed_url")).otherwise(F.col("url")).alias("url"), "status")


def candidate_feeds(url: Column, html: Column, links: Column, known: dict[str, list[str]] | None = None) -> Column:
    """Distinct feed addresses a page may have, in order: known for its host, in its text, its alternates and anchors, common paths."""
    origin = F.regexp_extract(url, r"^([a-z]+://[^/?#]*)", 1)
    inside = F.regexp_extract_all(html, F.lit(r"(https?://[^\"'\s>]*(?i:rss|feed|atom)[^\"'\s>]*)"), 1)
    mime = lambda x: x["type"].rlike("rss|atom|xml")
    tags = F.filter(links, lambda x: F.when(x["rel"] == "alternate", mime(x) | is_feed_like(x["href"])).otherwise(is_feed_like(x["href"]) | F.lower(x["text"]).rlike("rss|feed|atom|xml")))
    common = F.array(*[F.concat(origin, F.lit(p)) for p in d.COMMON_FEED_PATHS])
    first = F.array().cast("array<string>")
    for host, urls in (known or {}).items():
        first = F.when(source_host(url, F.lit("")) == host, F.array(*map(F.lit, urls))).otherwise(first)
    alternates = F.transform(F.filter(tags, lambda x: x["rel"] == "alternate"), lambda x: x["href"])
    anchors = F.transform(F.filter(tags, lambda x: x["rel"] != "alternate"), lambda x: x["href"])
    return F.array_distinct(F.concat(first, inside, alternates, anchors, common))


def feed_validity(status: Column, content_type: Column, body: Column) -> Column:
    """Struct(ok, reason) of a fetched answer."""
    head, kind = F.lower(F.substring(body, 1, 6000)), F.lower(F.coalesce(content_type, F.lit("")))
    to = lambda ok, why: F.struct(F.lit(ok).alias("ok"), (why if isinstance(why, Column) else F.lit(why)).alias("reason"))
    failed = F.concat(F.lit("request error: http_"), F.coalesce(status.cast("string"), F.lit("none")))
    return (
        F.when(status.isNull() | (status >= 400), to(False, failed))
        .when(head.rlike(r"<(item|entry)[\s>]"), to(True, "feed has entries"))
        .when(kind.rlike("rss|atom|xml"), to(True, F.concat(F.lit("content-type="), kind)))
        .when(head.contains("<rss") | head.contains("<feed"), to(True, "rss/atom tags in content"))
        .otherwise(to(False, "not recognized as RSS/Atom feed"))
    )


def discovered_feeds(candidates: DataFrame) -> DataFrame:
    """The first valid candidate of each host; (host, place, url, valid, known)."""
    return candidates.where("known or valid").groupBy("host").agg(F.min_by("url", F.struct(~F.col("known"), F.col("place"))).alias("feed_url"))


def crawl_rows(pages: DataFrame, text: Column) -> DataFrame:
    """Crawled pages as raw items: forbidden ones as stubs, paywalled ones in part, failed ones dropped."""
    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    wall = has_any(F.lower("html"), d.PAGE_PAYWALL)
    out = pages.where("status_code < 400 or status_code in (401, 403)").withColumns({"_title": title, "_text": text, "_wall": wall, "_no": F.col("status_code").isin(401, 403)})
    stub = F.lit("Paywalled content; no full access available.")
    content = F.when(F.col("_no"), F.lit("")).when(F.col("_wall"), F.concat("_title", F.lit(". "), F.substring("_text", 1, 500))).otherwise(F.col("_text"))
    summary = F.when(F.col("_no"), stub).otherwise(F.substring("_text", 1, 500))
    state = F.when(F.col("_no"), "stub").when(F.col("_wall"), "partial").otherwise("full")
    return out.select("page_id", F.col("source").alias("source_name"), F.col("url").alias("article_url"), F.col("_title").alias("title_raw"), summary.alias("summary_raw"), content.alias("content_raw"), F.sha2(F.concat_ws("|", "url", "_title"), 256).alias("content_hash"), state.alias("access"))


def base_health(items: Column, error: Column) -> Column:
    """Struct(score, color)."""
    to = lambda s, c: F.struct(F.lit(s).alias("score"), F.lit(c).alias("color"))
    return F.when(F.coalesce(error, F.lit("")) != "", to(0, "red")).when(F.coalesce(items, F.lit(0)) <= 0, to(1, "yellow")).otherwise(to(2, "green"))


def health(log: DataFrame) -> DataFrame:
    """Health of every run of every source against its previous run: fewer items than then degrade it."""
    before = F.lag("kept").over(W.partitionBy("source").orderBy("run"))
    rows = log.withColumn("_before", before).withColumn("_b", base_health(F.col("kept"), F.col("error")))
    worse = (F.col("_b.color") != "red") & (F.col("kept") < F.col("_before"))
    reason = F.when(F.col("_b.color") == "red", "fetch_failed").when(worse, "degraded_from_previous_fetch").otherwise("ok")
    return rows.select("run", "source", "kept", "error", F.when(worse, F.least(F.col("_b.score"), F.lit(1))).otherwise(F.col("_b.score")).alias("health_score"), F.when(worse, "yellow").otherwise(F.col("_b.color")).alias("health_color"), reason.alias("reason"))


def current_health(log: DataFrame) -> DataFrame:
    return top_per(health(log), ["source"], [F.desc("run")]).orderBy("source")


def fetch_report(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """Items kept, paywalled and failed of each source; sources without rows have zeros."""
    wall = F.col("status_code").isin(401, 403) | has_any(F.lower("html"), d.PAGE_PAYWALL)
    each = pages.groupBy(F.col("source").alias("host")).agg(F.count_if(F.col("status_code") < 400).alias("kept"), F.count_if(wall).alias("paywalled"), F.count_if((F.col("status_code") >= 400) & ~F.col("status_code").isin(401, 403)).alias("failed"))
    s = sources.withColumn("host", source_host(F.col("homepage"), F.col("url"))).select("position", "host")
    return s.join(each, "host", "left").select("position", "host", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("kept", "paywalled", "failed")])


def source_report(sources: DataFrame, entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Items, filtered and paywalled ones, status and error of every enabled source of feed entries (host, is_news) or crawled pages.

    A page source whose first page failed is an error without items. Refused or walled pages of articles are items, and
    counted as paywalled; pages that aren't articles, or failed, are filtered.
    """
    s = sources.withColumn("host", source_host(F.col("homepage"), F.col("url"))).select("position", "host", "type", "enabled")
    fed = entries.groupBy("host").agg(F.count_if("is_news").alias("items"), F.count_if(~F.col("is_news")).alias("filtered"))
    refused = F.col("status_code").isin(401, 403)
    wall = refused | has_any(F.lower("html"), d.PAGE_PAYWALL)
    kept = is_article_url(F.col("url")) & ((F.col("status_code") < 400) | refused)
    crawled = pages.groupBy(F.col("source").alias("host")).agg(F.count_if(kept).alias("items"), F.count_if(~kept).alias("filtered"), F.count_if(kept & wall).alias("paywalled"), F.min_by("status_code", "page_id").alias("first"))
    crawled = crawled.withColumn("error", F.when(F.col("first") >= 400, F.concat(F.lit("http_"), F.col("first").cast("string"))))
    n = lambda c: F.when(F.col("error").isNull(), F.coalesce(c, F.lit(0))).otherwise(0).alias(c)
    of_feeds = enabled(s, "rss").join(fed, "host", "left").withColumns({"paywalled": F.lit(0), "error": F.lit(None).cast("string")})
    of_pages = enabled(s, "scrape").join(crawled.drop("first"), "host", "left")
    both = of_feeds.unionByName(of_pages)
    return both.select("position", "host", "type", n("items"), n("filtered"), n("paywalled"), F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"), "error")


def health_status(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """Status of enabled sources by their first crawled page. `auth_configured` of a source tells whether it has credentials (missing: none has)."""
    page = top_per(pages, ["source"], [F.asc("page_id")]).select(F.col("source").alias("host"), "status_code", "content_type", "html")
    s = sources.where("enabled").withColumn("host", source_host(F.col("homepage"), F.col("url"))).join(page, "host", "left")
    auth = F.col("auth_configured") if "auth_configured" in sources.columns else F.lit(False)
    wall = has_any(F.lower(F.substring("html", 1, 8000)), d.PAGE_PAYWALL)
    valid = feed_validity(F.col("status_code"), F.col("content_type"), F.col("html"))["ok"]
    status = (
        F.when(F.col("host") == "", "missing_homepage")
        .when(F.col("type") == "rss", F.when(valid, "healthy").otherwise("rss_invalid"))
        .when(F.col("status_code").isNull(), "error")
        .when(F.col("status_code").isin(401, 403), F.when(auth, "auth_forbidden").otherwise("paywall_no_auth"))
        .when(wall, F.when(auth, "paywall_detected_with_auth").otherwise("paywall_no_auth"))
        .otherwise("healthy")
    )
    return s.select("position", "host", "type", status.alias("status"))
