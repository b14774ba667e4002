"""Opportunity notices: profile bundle, processing, rankings, export."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from market_signals.functions import dictionaries as d
from market_signals.functions import opportunity as o
from market_signals.functions.text import clean, csv, filled, lead


def load_profiles(rows: DataFrame, active: list[str] | None = None) -> DataFrame:
    """company, name, place and the cleaned term arrays of active profiles, from JSON rows (place, profile_json).

    Rows that aren't an object with a company are dropped. Lists may be arrays or comma-separated text.
    """
    v = rows.withColumn("v", F.try_parse_json("profile_json")).where(F.schema_of_variant("v").startswith("OBJECT"))
    text = lambda k: F.trim(F.coalesce(F.try_variant_get("v", f"$.{k}", "string"), F.lit("")))
    given = lambda k: F.coalesce(F.try_variant_get("v", f"$.{k}", "array<string>"), F.split(F.try_variant_get("v", f"$.{k}", "string"), ","), F.array().cast("array<string>"))
    listed = lambda k: F.filter(F.transform(F.array_compact(given(k)), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    company = F.upper(text("company"))
    wanted = sorted({a.strip().upper() for a in active or [] if a.strip()})
    out = v.where((company != "") & (company.isin(wanted) if wanted else F.lit(True)))
    digits = F.array_distinct(F.filter(F.transform(listed("cpv_codes"), lambda x: F.regexp_replace(x, r"\D", "")), lambda x: (F.length(x) == 8) & (x != "00000000") & ~x.endswith("999999")))
    return out.select(
        "place", company.alias("company"), F.coalesce(F.nullif(text("name"), F.lit("")), company).alias("name"), F.array_distinct(F.concat(listed("keywords"), listed("aliases"))).alias("keywords"),
        listed("qualifier").alias("qualifier"), listed("negative_keywords").alias("negative_keywords"), digits.alias("cpv"),
    )


def profile_table(spark: SparkSession, profiles: list[dict] = d.PROFILES, active: list[str] | None = None) -> DataFrame:
    """The profiles of the configuration as a small table."""
    return load_profiles(spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(profiles)], "place int, profile_json string"), active)


def write_profiles(spark: SparkSession, path: str, profiles: list[dict] = d.PROFILES) -> None:
    """Profiles as landed JSON lines (place, profile_json)."""
    spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(profiles)], "place int, profile_json string").write.mode("append").json(path)


def read_profiles(spark: SparkSession, path: str, active: list[str] | None = None) -> DataFrame:
    """The active profiles of landed JSON lines."""
    return load_profiles(spark.read.schema("place int, profile_json string").json(path), active)


def bundle_sets(table: DataFrame) -> DataFrame:
    """Sorted distinct CPVs, qualifiers and keywords of each company."""

    def tagged(kind: str, column: str) -> Column:
        return F.transform(column, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("term")))

    each = table.select("company", F.explode(F.concat(tagged("cpv", "cpv"), tagged("qualifier", "qualifier"), tagged("keyword", "keywords"))).alias("e"))
    of = lambda k: F.array_join(F.sort_array(F.collect_set(F.when(F.col("e.kind") == k, F.col("e.term")))), ",")
    return each.groupBy("company").agg(of("cpv").alias("cpv_codes"), of("qualifier").alias("qualifiers"), of("keyword").alias("keywords"))


def bundle(table: DataFrame) -> dict[str, list[dict]]:
    """The small profile table on the driver, by company in order: input of the row-wise match."""
    out: dict[str, list[dict]] = {}
    for r in table.orderBy("place").collect():
        out.setdefault(r["company"], []).append(r.asDict())
    return out


def notice_text() -> Column:
    e = F.lit("")
    return clean(F.concat(F.coalesce("title_raw", e), F.lit(". "), F.coalesce("description_raw", e), F.lit(". "), F.coalesce("buyer_raw", e)))


def matched(raw: DataFrame, profiles: dict[str, list[dict]]) -> DataFrame:
    """Notices with their text and the best profile fit (null: rejected)."""
    out = raw.withColumn("text", notice_text()).withColumn("low", F.lower("text"))
    return out.withColumn("fit", o.best_fit(F.col("low"), F.col("country_raw"), profiles))


def settled(rows: DataFrame) -> DataFrame:
    """The rows, by a step that Spark moves no filter or projection through: it holds the number of the partition."""
    return rows.withColumn("_part", F.spark_partition_id()).where("_part >= 0").drop("_part")


def fitting(raw: DataFrame, profiles: dict[str, list[dict]], fits: bool = True) -> DataFrame:
    """matched() notices that fit a profile, or those that fit none.

    With the number of its partition the filter is not moved below the fit, where it would make each notice's text again for every term.
    """
    rows = matched(raw, profiles).withColumn("_part", F.spark_partition_id())
    return rows.where((F.col("fit").isNotNull() if fits else F.col("fit").isNull()) & (F.col("_part") >= 0)).drop("_part")


def process(raw: DataFrame, profiles: dict[str, list[dict]], as_of: str, as_of_text: str) -> DataFrame:
    """Processed notices of those that fit a profile. No join, no shuffle; only the deadline part depends on `as_of`."""
    out = fitting(raw, profiles)
    out = out.withColumns({"opportunity_family": o.family(F.col("low")), "mechanism_type": o.mechanism(F.col("low")), "deadline": o.deadline(F.col("text")), "strategic_fit": o.strategic_fit(F.col("fit.fit"))})
    out = out.withColumn("days", o.days_left(F.col("deadline"), as_of))
    country = F.coalesce("country_raw", F.lit(""))
    e = F.lit("")
    return out.select(
        "id", "notice_id", F.coalesce(filled("title_raw"), F.lit("Untitled opportunity")).alias("title"), F.coalesce(filled("source_name"), F.lit("Unknown")).alias("source_name"), F.coalesce("notice_url", e).alias("source_url"),
        F.coalesce("buyer_raw", e).alias("buyer"), country.alias("country"), lead(F.col("text"), 2, 450).alias("summary"), "opportunity_family", "mechanism_type", "deadline", "strategic_fit", o.competition(country).alias("competition_level"),
        csv(F.col("fit.services")).alias("matched_services"), csv(F.col("fit.qualifiers")).alias("matched_qualifiers"), o.action(F.col("strategic_fit"), F.col("days"), F.col("fit.services")).alias("recommended_action"),
        o.why_it_matters(F.col("opportunity_family"), F.col("mechanism_type"), country, F.col("strategic_fit")).alias("why_it_matters"), o.signal_score(F.col("fit.fit"), F.col("opportunity_family"), F.col("days")).alias("signal_score"),
        F.when(F.col("strategic_fit") == "Strong", 0.78).when(F.col("strategic_fit") == "Medium", 0.67).otherwise(0.58).alias("confidence"), F.col("fit.profile_name").alias("profile_name"), F.lit(as_of_text).alias("processed_at"), F.coalesce("publication_date", e).alias("publication_date"),
    )


def chosen(raw: DataFrame, profiles: dict[str, list[dict]], mode: str, as_of: str, limit: int) -> DataFrame:
    """The raw rows of the notices that selected() takes of the processed ones, found by what its order needs alone.

    They are settled: projections moved below the limit would make Spark sort all notices, after a sample that makes each one's fit once more.
    """
    rows = fitting(raw, profiles)
    if mode == "latest":
        order = [F.coalesce("publication_date", F.lit("")).desc(), F.col("id")]
    else:
        rows = settled(rows.withColumn("deadline", o.deadline(F.col("text"))))
        order = [F.desc("signal_score"), F.col("id")]
        if mode == "upcoming_deadlines":
            rows, order = rows.where(F.col("deadline") >= day_of(as_of)), [F.col("deadline"), *order]
        rows = rows.withColumn("days", o.days_left(F.col("deadline"), as_of)).withColumn("signal_score", o.signal_score(F.col("fit.fit"), o.family(F.col("low")), F.col("days")))
    return settled(rows.orderBy(*order).limit(limit)).select(*raw.columns)


def selected_of(raw: DataFrame, profiles: dict[str, list[dict]], mode: str, as_of: str, as_of_text: str, limit: int = 50) -> DataFrame:
    """selected() of the processed notices, of which only those that are returned are processed."""
    n = max(1, limit)
    return selected(process(chosen(raw, profiles, mode, as_of, n), profiles, as_of, as_of_text), mode, as_of, n)


def latest_of(raw: DataFrame, profiles: dict[str, list[dict]], as_of: str, as_of_text: str, limit: int = 20) -> DataFrame:
    return selected_of(raw, profiles, "latest", as_of, as_of_text, limit)


def keys_of(raw: DataFrame, profiles: dict[str, list[dict]]) -> DataFrame:
    """The dedup_key of each notice that fits a profile, without processing it."""
    return fitting(raw, profiles).select("id", "notice_id", "fit.profile_name").select(dedup_key().alias("dedup_key"))


def day_of(as_of: str) -> Column:
    return F.date_format(F.lit(as_of).cast("timestamp"), "yyyy-MM-dd")


def latest(items: DataFrame, limit: int = 20) -> DataFrame:
    return items.orderBy(F.coalesce("publication_date", "processed_at").desc(), F.desc("processed_at"), "id").limit(limit)


def upcoming(items: DataFrame, as_of: str, limit: int = 20) -> DataFrame:
    return items.where(F.col("deadline") >= day_of(as_of)).orderBy("deadline", F.desc("signal_score"), "id").limit(limit)


def high_relevance(items: DataFrame, limit: int = 20) -> DataFrame:
    return items.orderBy(F.desc("signal_score"), F.desc("processed_at"), "id").limit(limit)


def selected(items: DataFrame, mode: str, as_of: str, limit: int = 50) -> DataFrame:
    n = max(1, limit)
    return latest(items, n) if mode == "latest" else upcoming(items, as_of, n) if mode == "upcoming_deadlines" else high_relevance(items, n)


def dedup_key() -> Column:
    return F.concat(F.coalesce(filled("notice_id"), F.col("id").cast("string")), F.lit(":"), F.upper(F.trim("profile_name")))


def to_export(items: DataFrame, exported: DataFrame, order: list[Column]) -> DataFrame:
    """Selected items that aren't exported yet, the first of each key."""
    from market_signals.operators.state import top_per

    keyed = items.withColumn("dedup_key", dedup_key())
    return top_per(keyed, ["dedup_key"], order).join(exported.select("dedup_key").distinct(), "dedup_key", "left_anti")


def write_payloads(payloads: DataFrame, path: str) -> None:
    """One JSON object a line, with its key."""
    payloads.write.mode("overwrite").json(path)


def export_date(c: Column) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    iso = (F.length(t) >= 10) & (F.substring(t, 5, 1) == "-") & (F.substring(t, 8, 1) == "-")
    return F.when(t == "", F.lit(None).cast("string")).when(iso, F.substring(t, 1, 10)).otherwise(F.date_format(F.try_to_timestamp(t), "yyyy-MM-dd"))


def lead_path() -> Column:
    source = F.upper(F.trim(F.coalesce("source_name", F.lit(""))))
    known = F.create_map(*[F.lit(x) for kv in d.LEAD_SUFFIXES.items() for x in kv])
    suffix = F.coalesce(F.try_element_at(known, source), F.nullif(source, F.lit("")), F.lit("Source"))
    return F.concat(F.coalesce(F.nullif(F.upper(F.trim(F.coalesce("profile_name", F.lit("")))), F.lit("")), F.lit("PROFILE")), F.lit(" - "), suffix)


#: Property names in order of preference, allowed kinds.
TARGETS = {
    "source_name": (["Source"], ["select", "rich_text"]),
    "dedup_key": (["Dedup Key"], ["rich_text", "title", "select"]),
    "discovered": (["Discovered Date", "Created"], ["date"]),
    "discovered_by": (["Discovered By"], ["select", "rich_text"]),
    "lead_path": (["Lead Path"], ["select", "rich_text"]),
    "status": (["Status"], ["select", "rich_text"]),
    "country": (["Country"], ["select", "rich_text"]),
    "publication_date": (["Publication Date", "Notice Date"], ["date"]),
    "source_url": (["Source Link", "Source URL", "URL"], ["url", "rich_text"]),
    "strategic_fit": (["Strategic Fit"], ["select", "rich_text"]),
    "competition_level": (["Competition Level"], ["select", "rich_text"]),
    "opportunity_family": (["Project Type", "Opportunity Family"], ["multi_select", "rich_text", "select"]),
    "mechanism_type": (["Mechanism Type", "Mechanism"], ["select", "rich_text"]),
    "matched_services": (["Matched Services"], ["multi_select", "rich_text"]),
    "matched_qualifiers": (["Matched Qualifiers", "Qualifier Match"], ["multi_select", "rich_text"]),
    "deadline": (["Deadline", "Due Date"], ["date"]),
    "signal_score": (["Signal Score", "Score"], ["number", "rich_text"]),
    "confidence": (["Confidence"], ["number", "rich_text"]),
    "recommended_action": (["Your Qualification Notes", "Qualification Notes", "Notes"], ["rich_text"]),
    "reason": (["AI Reason", "Why It Matters"], ["rich_text"]),
}


def _property(kind: str, value: Column) -> Column:
    text = F.trim(value.cast("string"))
    full = F.nullif(text, F.lit(""))
    if kind in ("title", "rich_text"):
        return F.when(full.isNotNull(), F.struct(F.array(F.struct(F.struct(F.substring(text, 1, 2000).alias("content")).alias("text"))).alias(kind)))
    if kind == "select":
        return F.when(full.isNotNull(), F.struct(F.struct(F.substring(text, 1, 100).alias("name")).alias("select")))
    if kind == "multi_select":
        names = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
        return F.when(F.size(names) > 0, F.struct(F.transform(names, lambda x: F.struct(F.substring(x, 1, 100).alias("name"))).alias("multi_select")))
    if kind == "url":
        return F.when(full.isNotNull(), F.struct(F.substring(text, 1, 2000).alias("url")))
    if kind == "date":
        day = export_date(text)
        return F.when(day.isNotNull(), F.struct(F.struct(day.alias("start")).alias("date")))
    if kind == "number":
        return F.when(text.try_cast("double").isNotNull(), F.struct(text.try_cast("double").alias("number")))
    raise ValueError(f"unknown kind of property: {kind}")


def payloads(items: DataFrame, target: dict[str, str], as_of: str) -> DataFrame:
    """dedup_key and a JSON payload of each item, with the properties that the target schema (name: kind) has."""
    rows = items.withColumns({
        "discovered": F.date_format(F.lit(as_of).cast("timestamp"), "yyyy-MM-dd"), "discovered_by": F.lit("Automation"), "lead_path": lead_path(), "status": F.lit("New"),
        "reason": F.trim(F.concat(F.coalesce("recommended_action", F.lit("")), F.lit(" "), F.coalesce("why_it_matters", F.lit("")))),
    })
    fields = [(name, "title", "title") for name, kind in target.items() if kind == "title"][:1]
    for column, (names, kinds) in TARGETS.items():
        found = next((x for x in names if target.get(x) in kinds), None)
        if found:
            fields.append((found, target[found], column))
    return rows.select("dedup_key", F.to_json(F.struct(*[_property(kind, F.col(column)).alias(name) for name, kind, column in fields])).alias("payload"))
