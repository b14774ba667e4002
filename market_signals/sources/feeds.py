"""Landed feed files: RSS and Atom entries as raw items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from market_signals.functions.text import filled, published_text
from market_signals.functions.urls import is_news_item

#: Elements of an entry in either format.
TAGS = ("item", "entry")
_TEXT = "struct<_VALUE: string, _type: string>"
#: What is read of an entry. RSS has its link as text, Atom as an attribute; both may repeat links and contents.
ENTRY = f"title {_TEXT}, link array<struct<_VALUE: string, _href: string, _rel: string>>, description {_TEXT}, summary {_TEXT}, encoded array<{_TEXT}>, content array<{_TEXT}>, pubDate string, published string, updated string, _broken string"


def read_entries(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Entries of one kind (source_name, kind, xml, e) of the feed files below `path`, in a folder source_name=... for each source.

    A file is cut at the ends of its entries while it is read, and each entry parsed by itself: one that is broken
    spoils no other, and no file is held whole. Prefixes of names are joined to them, as an entry alone doesn't declare them.
    """
    pieces = spark.read.option("lineSep", f"</{tag}>").text(path)
    own = F.regexp_extract("value", rf"(?s)<{tag}[\s>/].*$", 0)
    xml = F.regexp_replace(F.regexp_replace(own, r"<(/?)content:encoded\b", "<$1encoded"), r"<(/?)(\w+):(\w)", "<$1$2-$3")
    rows = pieces.where(own != "").select("source_name", F.lit(tag).alias("kind"), F.concat(xml, F.lit(f"</{tag}>")).alias("xml"))
    return rows.withColumn("e", F.from_xml("xml", ENTRY, {"columnNameOfCorruptRecord": "_broken"}))


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """RSS and Atom entries below `path`."""
    return read_entries(spark, path, TAGS[0]).unionByName(read_entries(spark, path, TAGS[1]))


def broken(feed: DataFrame) -> DataFrame:
    """Entries that can't be parsed, with their text."""
    return feed.where("e is null or e._broken is not null").select("source_name", "kind", "xml")


def entries(feed: DataFrame) -> DataFrame:
    """Readable feed entries as raw items with `is_news`, which tells the probable news items from the filtered ones.

    The link is an RSS link's text or the first Atom link without another role; contents are joined and decide `is_news`
    with title and summary; an entry without a summary has its first content as one; the time is the published one, else
    the updated one.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    good = feed.where("e is not null and e._broken is null").select("source_name", "e.*")
    contents = F.filter(F.transform(F.concat(_some("encoded"), _some("content")), lambda x: text(x["_VALUE"])), lambda x: x != "")
    own = F.filter(F.coalesce("link", F.array().cast("array<struct<_VALUE: string, _href: string, _rel: string>>")), lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    url = F.coalesce(F.get(F.transform(own, lambda x: F.coalesce(x["_href"], F.trim(x["_VALUE"]))), 0), F.lit(""))
    rows = good.select("source_name", url.alias("url"), text(F.col("title._VALUE")).alias("title"), text(filled(F.col("description._VALUE"), F.col("summary._VALUE"))).alias("told"), contents.alias("contents"), filled("pubDate", "published", "updated").alias("at"))
    rows = rows.withColumn("summary", F.coalesce(filled("told"), F.get("contents", 0), F.lit("")))
    return rows.select(
        "source_name", F.col("url").alias("article_url"), F.col("title").alias("title_raw"), F.col("summary").alias("summary_raw"), F.col("summary").alias("content_raw"), F.sha2(F.concat_ws("|", "url", "title"), 256).alias("content_hash"),
        published_text(F.col("at")).alias("published_at"), is_news_item(F.col("url"), F.col("title"), F.col("summary"), F.array_join("contents", " ")).alias("is_news"),
    )


def _some(column: str) -> Column:
    return F.coalesce(column, F.array().cast(f"array<{_TEXT}>"))


def write_feed(items: DataFrame, path: str, atom: bool = False) -> None:
    """Items (source_name, link, title, summary, published, and optionally contents: array of texts) as RSS or Atom files, one folder a source. Control characters become spaces."""
    text = lambda c: F.regexp_replace(c, r"[\x00-\x1F]", " ")
    contents = F.transform("contents", text) if "contents" in items.columns else F.array().cast("array<string>")
    if atom:
        typed = lambda c: F.struct(c.alias("_VALUE"), F.lit("html").alias("_type"))
        links = F.array(F.struct(F.lit("self").alias("_rel"), F.concat(text("link"), F.lit("#self")).alias("_href")), F.struct(F.lit("alternate").alias("_rel"), text("link").alias("_href")))
        rows = items.select("source_name", typed(text("title")).alias("title"), links.alias("link"), typed(text("summary")).alias("summary"), F.transform(contents, typed).alias("content"), F.col("published").alias("updated"))
    else:
        rows = items.select("source_name", text("title").alias("title"), text("link").alias("link"), text("summary").alias("description"), contents.alias("encoded"), F.col("published").alias("pubDate"))
    tag, root = (TAGS[1], "feed") if atom else (TAGS[0], "channel")
    rows.write.mode("append").partitionBy("source_name").format("xml").option("rootTag", root).option("rowTag", tag).save(path)
