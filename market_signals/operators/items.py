"""News items: processing, enrichment, domains, rankings and collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from market_signals.functions import dictionaries as d
from market_signals.functions import news as n
from market_signals.functions.text import clean, filled, lead, norm
from market_signals.operators.state import top_per
from market_signals.session import keep


def process(raw: DataFrame, as_of_text: str) -> DataFrame:
    """Raw items to processed ones: text, tags, score, paywall adjustment, texts and flags. No shuffle."""
    out = raw.withColumn("cleaned_text", clean(F.coalesce(filled("content_raw", "summary_raw", "title_raw"), F.lit("")))).withColumn("_low", F.lower("cleaned_text"))
    out = out.withColumns({"theme_tags": n.theme_tags(F.col("_low")), "geography_tags": n.geography_tags(F.col("_low")), "actors": n.actors(F.col("_low"))})
    out = out.withColumn("_blob", n.paywall_text(F.col("summary_raw"), F.col("content_raw"), F.col("cleaned_text")))
    paid = n.paywalled(F.col("title_raw"), F.col("_blob"))
    out = out.withColumns({"signal_score": n.signal_score(F.col("theme_tags"), F.col("geography_tags"), F.col("actors"), F.col("cleaned_text")), "_paid": paid, "_sum": lead(F.col("cleaned_text")), "title": F.coalesce(filled("title_raw"), F.lit("Untitled"))})
    return present(out, as_of_text)


def present(out: DataFrame, as_of_text: str) -> DataFrame:
    """The columns of a processed item, with a paywalled one's title, summary and confidence adjusted."""
    title = F.when(F.col("_paid") & ~F.col("title").contains("[Paywalled]"), F.concat(F.lit("[Paywalled] "), "title")).otherwise(F.col("title"))
    summary = F.when(F.col("_paid") & ~F.lower("_sum").startswith("paywalled"), F.concat(F.lit("Paywalled: full article unavailable. "), "_sum")).otherwise(F.col("_sum"))
    sure = F.col("confidence") if "confidence" in out.columns else F.lit(0.65)
    why = n.why_it_matters(F.col("theme_tags"), F.col("geography_tags"))
    return out.select(
        "id", "source_name", "article_url", title.alias("title"), "cleaned_text", summary.alias("summary"), "theme_tags", "geography_tags", "actors", why.alias("why_it_matters"), "signal_score",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.col("_paid"), F.least(sure, F.lit(0.45))).otherwise(sure))).alias("confidence"), F.lit(d.ANGLE).alias("linkedin_angle"),
        (F.col("signal_score") >= 65).cast("int").alias("linkedin_candidate"), F.lit(as_of_text).alias("processed_at"), "published_at", "fetched_at",
    )


def json_object(text: Column) -> Column:
    """The JSON object of a model's answer: the whole text, else its widest {...}; null if neither is an object."""
    whole, part = F.try_parse_json(text), F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    ok = lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v)
    return F.coalesce(ok(whole), ok(part))


def parse_enrichment(answers: DataFrame) -> DataFrame:
    """raw_item_id, summary, theme_tags, geography_tags, actors, confidence of model answers; null fields where absent."""
    v = answers.withColumn("v", json_object(F.col("response")))
    text = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    array = lambda k: F.filter(F.transform(F.try_variant_get("v", f"$.{k}", "array<string>"), lambda x: F.trim(x)), lambda x: x != "")
    return v.select("raw_item_id", F.col("v").isNotNull().alias("parsed"), text("summary").alias("summary"), array("theme_tags").alias("theme_tags"), array("geography_tags").alias("geography_tags"), array("actors").alias("actors"), n.confidence(text("confidence"), 0.65).alias("confidence"))


def overlay(processed: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Model fields over the rules' where they aren't empty."""
    e = enrichment.where("parsed").select(F.col("raw_item_id").alias("id"), *[F.col(c).alias(f"e_{c}") for c in ("summary", "theme_tags", "geography_tags", "actors", "confidence")])
    out = processed.join(e, "id", "left")
    pick = lambda c: F.when(F.size(f"e_{c}") > 0, F.col(f"e_{c}")).otherwise(F.col(c))
    return out.select("id", F.coalesce(F.nullif("e_summary", F.lit("")), "summary").alias("summary"), *[pick(c).alias(c) for c in ("theme_tags", "geography_tags", "actors")], F.coalesce("e_confidence", "confidence").alias("confidence"))


def with_domain(items: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """domain_bucket and domain_confidence: the stored ones, else by the rules over title, summary and themes."""
    out = items.withColumn("_blob", norm(F.concat_ws(" ", "title", "summary", F.array_join("theme_tags", ","))))
    out = out.withColumns({f"_{k}": c for k, c in n.domain_hits(F.col("_blob")).items()})
    out = out.withColumn("_d", n.domain(F.col("_blob"), {k: F.col(f"_{k}") for k in ("off", "near", "other")})).drop("_blob", "_off", "_near", "_other")
    if stored is None:
        return out.select("*", F.col("_d.bucket").alias("domain_bucket"), F.col("_d.confidence").alias("domain_confidence")).drop("_d")
    s = stored.select(F.col("processed_id").alias("id"), F.col("domain_bucket").alias("_b"), F.col("domain_confidence").alias("_c"))
    return out.join(s, "id", "left").withColumns({"domain_bucket": F.coalesce("_b", "_d.bucket"), "domain_confidence": F.coalesce("_c", "_d.confidence")}).drop("_d", "_b", "_c")


def override_domain(items: DataFrame, said: DataFrame) -> DataFrame:
    """A model's bucket counts only where the rules are unsure (under 0.85), it is a known one and at least as sure."""
    s = said.select("id", F.lower(F.trim("domain_bucket")).alias("_b"), F.col("confidence").alias("_c"))
    use = (F.col("domain_confidence") < 0.85) & F.col("_b").isin(d.BUCKETS) & (F.col("_c") >= F.col("domain_confidence"))
    out = items.join(s, "id", "left")
    return out.withColumns({"domain_bucket": F.when(use, F.col("_b")).otherwise(F.col("domain_bucket")), "domain_confidence": F.when(use, F.least(F.lit(1.0), F.greatest(F.lit(0.0), "_c"))).otherwise(F.col("domain_confidence"))}).drop("_b", "_c")


def in_domain(items: DataFrame, bucket: str) -> DataFrame:
    b = bucket.strip().lower().replace("-", "_")
    return items if b == "all" else items.where(F.coalesce("domain_bucket", F.lit("other_energy")) == b)


def of_source(items: DataFrame, name: str | None) -> DataFrame:
    return items if not name or not name.strip() else items.where(F.lower("source_name") == name.strip().lower())


def latest_order() -> list[Column]:
    return [F.coalesce("published_at", "processed_at").desc(), F.col("processed_at").desc(), F.col("id").asc()]


def score_order() -> list[Column]:
    return [F.col("signal_score").desc(), F.col("processed_at").desc(), F.col("id").asc()]


def raw_order(as_of_text: str) -> list[Column]:
    """latest_order() of raw items that are processed at one time."""
    return [F.coalesce("published_at", F.lit(as_of_text)).desc(), F.col("id").asc()]


def scored(raw: DataFrame) -> DataFrame:
    """Raw items with their signal_score alone: what a ranking by score needs before its cut."""
    out = raw.withColumn("_text", clean(F.coalesce(filled("content_raw", "summary_raw", "title_raw"), F.lit("")))).withColumn("_low", F.lower("_text"))
    out = out.withColumns({"_themes": n.theme_tags(F.col("_low")), "_places": n.geography_tags(F.col("_low")), "_names": n.actors(F.col("_low"))})
    return out.withColumn("signal_score", n.signal_score(F.col("_themes"), F.col("_places"), F.col("_names"), F.col("_text"))).drop("_text", "_low", "_themes", "_places", "_names")


def ranked(items: DataFrame, order: list[Column], limit: int, bucket: str = "all", source: str | None = None, prefetch: int | None = 5) -> DataFrame:
    """The first `limit` items of a domain. With `prefetch`, the filter sees only the first prefetch * limit items; None filters first."""
    rows = of_source(items, source)
    if prefetch is None:
        return in_domain(with_domain(rows), bucket).orderBy(*order).limit(max(limit, 1))
    # written before the filter reads it, which otherwise would be pushed into the tags of the few rows and make them again and again
    some = keep(with_domain(rows.orderBy(*order).limit(prefetch * limit)))
    return in_domain(some, bucket).orderBy(*order).limit(max(limit, 1))


def placed(items: DataFrame) -> DataFrame:
    """Items with `place`: of two, the greater one stands earlier in the newest-first list. No item is numbered, so nothing is sorted."""
    return items.withColumn("place", F.struct(F.coalesce("published_at", "processed_at").alias("at"), F.col("processed_at").alias("made"), (-F.col("id")).alias("last")))


def keyed(items: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """collection_key: the override of an item, else its automatic key."""
    own = n.collection_key(F.col("theme_tags"), F.col("geography_tags"), F.col("title"), F.col("id"))
    if overrides is None:
        return items.withColumn("collection_key", own)
    o = overrides.select(F.col("processed_id").alias("id"), F.nullif("collection_key", F.lit("")).alias("_o"))
    return items.join(o, "id", "left").withColumn("collection_key", F.coalesce("_o", own)).drop("_o")


def collections(items: DataFrame, limit: int = 20) -> DataFrame:
    """Groups by collection_key with counts, scores and latest time, the largest first; partial sums come before the shuffle."""
    at = F.coalesce(F.nullif("published_at", F.lit("")), "processed_at")
    out = items.groupBy("collection_key").agg(F.count("*").alias("article_count"), F.max("signal_score").alias("top_signal_score"), F.sum("signal_score").alias("signal_score_sum"), F.max(at).alias("latest_published_at"))
    out = out.withColumn("avg_signal_score", F.bround(F.col("signal_score_sum") / F.col("article_count"), 1)).withColumn("is_manual", F.col("collection_key").startswith("manual:"))
    return out.orderBy(F.desc("article_count"), F.desc("top_signal_score"), F.desc("latest_published_at"), "collection_key").limit(max(limit, 1))


def primary_tags(items: DataFrame, column: str, name: str, default: str) -> DataFrame:
    """The most frequent tag of each collection; of equal ones the one seen first (by list place, then tag place)."""
    each = items.select("collection_key", "place", F.posexplode_outer(column).alias("at", "tag"))
    counted = each.groupBy("collection_key", "tag").agg(F.count("tag").alias("n"), F.max(F.struct("place", (-F.col("at")).alias("at"))).alias("first"))
    best = F.max_by("tag", F.struct("n", "first"))
    return counted.groupBy("collection_key").agg(F.coalesce(best, F.lit(default)).alias(name))


def top_items(items: DataFrame, k: int = 5) -> DataFrame:
    """The best k items of each collection; WindowGroupLimit cuts hot collections before the shuffle."""
    return top_per(items, ["collection_key"], [F.desc("signal_score"), F.coalesce("published_at", F.lit("")).desc(), F.desc("place")], max(k, 1))


def tag_counts(items: DataFrame, column: str) -> DataFrame:
    return items.select(F.explode(column).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
