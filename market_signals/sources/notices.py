"""Notices of three sources as JSON text: read, normalise, filter, unite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from market_signals.functions import dictionaries as d
from market_signals.functions.text import filled

COLUMNS = ["id", "source", "title", "buyer", "country", "publication_date", "url", "cpv_codes", "description", "ord"]


def read_notices(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object or envelope a line, as text in `body`."""
    return spark.read.text(path).withColumnRenamed("value", "body")


def unwrap(pages: DataFrame, names: tuple[str, ...] = ("procnotices", "notices", "rows", "data", "results")) -> DataFrame:
    """One row for each notice of an envelope: a list, or an object that holds a list or a keyed object under one of the names."""
    pages.createOrReplaceTempView("ms_envelopes")
    inner = ", ".join(f"try_variant_get(try_parse_json(body), '$.{n}')" for n in names)
    sql = f"SELECT to_json(e.value) AS body FROM (SELECT coalesce({inner}, try_parse_json(body)) AS v FROM ms_envelopes) p, LATERAL variant_explode(p.v) AS e"
    return pages.sparkSession.sql(sql)


def text_at(path: str, of: str = "v") -> Column:
    return F.try_variant_get(of, path, "string")


def first_value(name: str, of: str = "v") -> Column:
    """Text of a string, of a list's head, or of a map of languages (English first, then whichever comes first)."""
    at = f"$['{name}']"
    entries = F.map_values(F.try_variant_get(of, at, "map<string,variant>"))
    head = F.get(entries, 0)
    tries = []
    for lang in ("eng", "en", "ENG", "EN"):
        tries += [text_at(f"{at}.{lang}[0]", of), F.when(F.schema_of_variant(F.try_variant_get(of, f"{at}.{lang}", "variant")) == "STRING", text_at(f"{at}.{lang}", of))]
    other = [F.try_variant_get(head, "$[0]", "string"), F.when(F.schema_of_variant(head) == "STRING", F.try_variant_get(head, "$", "string"))]
    plain = F.when(F.schema_of_variant(F.try_variant_get(of, at, "variant")) == "STRING", text_at(at, of))
    return F.coalesce(plain, text_at(f"{at}[0]", of), *tries, *other, F.lit(""))


def country_code(c: Column) -> Column:
    code = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    known = F.create_map(*[F.lit(x) for kv in d.COUNTRY_CODES.items() for x in kv])
    return F.when((code == "") | (F.length(code) == 3), code).otherwise(F.coalesce(F.try_element_at(known, code), code))


def normalize_ted(raw: DataFrame) -> DataFrame:
    v = raw.withColumn("v", F.try_parse_json("body"))
    number = F.trim(F.coalesce(text_at("$['publication-number']"), F.lit("")))
    title, buyer = first_value("notice-title"), first_value("buyer-name")
    country = F.coalesce(text_at("$['buyer-country'][0]"), F.when(F.schema_of_variant(F.try_variant_get("v", "$['buyer-country']", "variant")) == "STRING", text_at("$['buyer-country']")), F.lit(""))
    date = F.split_part(F.split_part(F.coalesce(text_at("$['publication-date']"), F.lit("")), F.lit("+"), F.lit(1)), F.lit("T"), F.lit(1))
    cpv = F.coalesce(F.try_variant_get("v", "$['classification-cpv']", "array<string>"), F.array(text_at("$['classification-cpv']")))
    link = filled(text_at("$.links.html.ENG"), text_at("$.links.html.eng"), F.when(number != "", F.concat(F.lit("https://ted.europa.eu/en/notice/-/detail/"), number)), F.lit("https://ted.europa.eu"))
    return v.select(
        F.concat(F.lit("TED-"), number).alias("id"), F.lit("TED").alias("source"), title.alias("title"), buyer.alias("buyer"), country.alias("country"), date.alias("publication_date"),
        link.alias("url"), F.filter(F.array_compact(cpv), lambda x: F.trim(x) != "").alias("cpv_codes"), F.lower(F.trim(F.concat_ws(" ", title, buyer))).alias("description"), "ord", text_at("$['notice-type']").alias("kind"),
    )


def normalize_doffin(raw: DataFrame) -> DataFrame:
    v = raw.withColumn("v", F.try_parse_json("body"))
    key, title = F.trim(F.coalesce(text_at("$.id"), F.lit(""))), F.trim(F.coalesce(text_at("$.heading"), F.lit("")))
    buyer = F.trim(F.coalesce(text_at("$.buyer[0].name"), F.lit("")))
    date = F.coalesce(filled(text_at("$.publicationDate"), text_at("$.issueDate")), F.lit(""))
    url = F.coalesce(filled(F.trim(text_at("$.doffinClassicUrl")), F.when(key != "", F.concat(F.lit("https://doffin.no/notices/"), key))), F.lit(""))
    about = F.coalesce(text_at("$.description"), F.lit(""))
    return v.select(
        F.concat(F.lit("DOFFIN-"), key).alias("id"), F.lit("DOFFIN").alias("source"), title.alias("title"), buyer.alias("buyer"), F.lit("NOR").alias("country"), F.when(F.length(date) >= 10, F.substring(date, 1, 10)).otherwise("").alias("publication_date"),
        url.alias("url"), F.coalesce(F.try_variant_get("v", "$.cpvCodes", "array<string>"), F.array().cast("array<string>")).alias("cpv_codes"), F.lower(F.trim(F.concat_ws(" ", title, buyer, about))).alias("description"), "ord",
        text_at("$.status").alias("status"), text_at("$.type").alias("kind"),
    )


def normalize_worldbank(raw: DataFrame) -> DataFrame:
    v = raw.withColumn("v", F.try_parse_json("body"))

    def one(*names: str) -> Column:
        return F.trim(F.coalesce(filled(*[text_at(f"$.{n}") for n in names]), F.lit("")))

    key = one("id", "procno", "noticeId")
    title, buyer = one("project_name", "notice_title", "title", "projectname"), one("borrower", "contact_agency", "contact_agency_name", "agencyname")
    country = country_code(one("contact_country_code", "countrycode", "country_code", "country"))
    date = one("submission_date", "notice_date", "ddate", "publisheddate")
    url = F.coalesce(filled(one("url", "link", "href"), F.when(key != "", F.lit("https://projects.worldbank.org/en/projects-operations/procurement"))), F.lit(""))
    about = F.coalesce(filled(*[text_at(f"$.{n}") for n in ("procurement_description", "description", "project_desc")]), F.lit(""))
    return v.select(
        F.concat(F.lit("WB-"), key).alias("id"), F.lit("WORLDBANK").alias("source"), title.alias("title"), buyer.alias("buyer"), country.alias("country"), F.when(F.length(date) >= 10, F.substring(date, 1, 10)).otherwise("").alias("publication_date"),
        url.alias("url"), F.array().cast("array<string>").alias("cpv_codes"), F.lower(F.trim(F.concat(title, F.lit(" "), buyer, F.lit(" "), about))).alias("description"), "ord",
    )


def keep_ted(ted: DataFrame, cpv: list[str], since: str) -> DataFrame:
    wanted = F.arrays_overlap("cpv_codes", F.array(*map(F.lit, cpv))) & F.col("country").isin(d.TED_COUNTRIES) & (F.col("publication_date") >= since)
    return ted.where(wanted & ~F.coalesce("kind", F.lit("")).rlike(f"^({'|'.join(d.TED_EXCLUDED)})") & (F.col("id") != "TED-"))


def keep_doffin(doffin: DataFrame, cpv: list[str], qualifiers: list[str], since: str) -> DataFrame:
    term = F.lit(False)
    for q in qualifiers[:12]:
        term = term | F.col("description").contains(q)
    wanted = (F.col("status") == "ACTIVE") & F.col("kind").isin(d.DOFFIN_TYPES) & (F.col("publication_date") >= since)
    return doffin.where(wanted & (F.arrays_overlap("cpv_codes", F.array(*map(F.lit, cpv))) | term))


def keep_worldbank(bank: DataFrame, terms: list[str], since: str) -> DataFrame:
    term = F.lit(False)
    for t in terms:
        term = term | F.col("description").contains(t)
    return bank.where((F.col("publication_date") >= since) & term)


def worldbank_terms(keywords: dict[str, list[str]], qualifiers: list[str]) -> list[str]:
    """Search terms: the first five sorted keywords of each company, or the first eight qualifiers where there are none."""
    found = sorted({t for terms in keywords.values() for t in sorted(terms)[:5]})
    return found or list(qualifiers[:8])


def unreadable(body: Column, key: Column) -> Column:
    """Why a notice can't be processed, or null."""
    v = F.try_parse_json(body)
    return F.when(v.isNull(), "invalid json").when(~F.schema_of_variant(v).startswith("OBJECT"), "not an object").when(F.coalesce(key, F.lit("")) == "", "no key")


def clean_columns(notices: DataFrame) -> DataFrame:
    """Trimmed and upper-cased columns of notices that have an id, a title and a URL, with their hash."""
    t = lambda c: F.trim(F.coalesce(c, F.lit("")))
    out = notices.select(
        t("id").alias("notice_id"), F.upper(F.coalesce(filled("source"), F.lit("UNKNOWN"))).alias("source_name"), t("url").alias("notice_url"), t("title").alias("title_raw"), t("buyer").alias("buyer_raw"),
        F.upper(F.coalesce("country", F.lit(""))).alias("country_raw"), F.coalesce("publication_date", F.lit("")).alias("publication_date"), t("description").alias("description_raw"), F.to_json(F.coalesce("cpv_codes", F.array().cast("array<string>"))).alias("cpv_codes"), "ord",
    )
    out = out.where("notice_id <> '' and title_raw <> '' and notice_url <> ''")
    return out.withColumn("content_hash", F.sha2(F.concat_ws("|", "notice_id", "title_raw", "notice_url"), 256))
