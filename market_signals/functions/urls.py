"""URL and article predicates (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from market_signals.functions import dictionaries as d
from market_signals.functions.text import filled, has_any

DATE = r"\b(20\d{2})\b|/20\d{2}/|\d{4}-\d{2}-\d{2}"


def normalize_url(c: Column) -> Column:
    u = F.trim(F.coalesce(c, F.lit("")))
    return F.when(u == "", "").when(u.startswith("http://") | u.startswith("https://"), u).otherwise(F.concat(F.lit("https://"), u))


def netloc(c: Column) -> Column:
    return F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host_key(c: Column) -> Column:
    """Lower-case host of a URL without any `www.`."""
    return F.trim(F.lower(F.replace(netloc(normalize_url(c)), F.lit("www."), F.lit(""))))


def name_of(c: Column) -> Column:
    host = F.replace(netloc(c), F.lit("www."), F.lit(""))
    word = F.split(host, r"\.")[0]
    return F.when(host == "", "Source").otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1_000_000))))


def path_of(c: Column) -> Column:
    return F.regexp_extract(c, r"^(?:[a-z][a-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query_of(c: Column) -> Column:
    return F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def is_article_url(url: Column) -> Column:
    u = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    path = path_of(u)
    parts = segments(path)
    depth, last = F.size(parts), F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    dated, slug, long_id = path.rlike(DATE), last.contains("-") & (F.length(last) >= 12), last.rlike(r"\d{5,}")
    asked = query_of(u).rlike(rf"(^|&)({'|'.join(d.ARTICLE_KEYS)})=[^&]+")
    section = last.isin(d.SECTIONS)
    return (
        F.when(depth == 0, False)
        .when((depth == 1) & section & ~(dated | slug | long_id | asked), False)
        .when(has_any(path, d.STATIC_PATHS) & (depth <= 2) & ~(dated | slug | long_id), False)
        .when(dated | slug | long_id | asked, True)
        .otherwise((depth >= 3) & ~section)
    )


def words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def is_news_item(url: Column, title: Column, summary: Column, body: Column) -> Column:
    u, t, s, f = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (url, title, summary, body))
    path = path_of(u)
    hint = lambda c: has_any(c, d.HINTS)
    blob = F.concat_ws(" ", t, s, u)
    return (
        F.when((u == "") | (t == "") | t.isin(d.GENERIC_TITLES), False)
        .when((words(t) <= 2) & ~(hint(t) | t.rlike(DATE)), False)
        .when(has_any(path, d.STATIC_PATHS) & ~(hint(t) | hint(s) | u.rlike(DATE)), False)
        .when(~is_article_url(url) & ~(u.rlike(DATE) & (hint(t) | hint(s))), False)
        .when((f != "") & ((F.length(f) < 220) | (words(f) < 40)), False)
        .otherwise(hint(blob) | hint(f) | blob.rlike(DATE) | f.rlike(DATE) | ((F.length(t) >= 35) & (F.size(segments(path)) >= 2)))
    )


def is_feed_like(url: Column) -> Column:
    return F.lower(url).rlike(r"rss|feed|atom|\.xml")


def source_host(homepage: Column, url: Column) -> Column:
    return host_key(F.coalesce(filled(homepage, url), F.lit("")))
