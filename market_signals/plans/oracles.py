"""The queries in ANSI-like SQL over the plain tables, built of shared common table expressions."""

from __future__ import annotations

from market_signals.functions import dictionaries as d
from market_signals.sources.fixtures import AS_OF, AS_OF_TEXT, VIEWS

DATE = r"\b(20\d{2})\b|/20\d{2}/|\d{4}-\d{2}-\d{2}"


def term(low: str, t: str) -> str:
    t = t.lower()
    if len(t) <= 3 and t.isalpha():
        return rf"regexp_matches({low}, '(^|[^\p{{L}}\p{{N}}_]){t}([^\p{{L}}\p{{N}}_]|$)')"
    return f"contains({low}, '{t}')"


def any_term(low: str, terms: list[str]) -> str:
    return "(" + " OR ".join(term(low, t) for t in terms) + ")"


def any_plain(low: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({low}, '{t}')" for t in terms) + ")"


def count_terms(low: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({low}, '{t}') AS INTEGER)" for t in terms) + ")"


def tags(pairs: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in pairs) + "], lambda x: x IS NOT NULL)"


def quoted(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def cleaned(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def lead(x: str, n: int, most: int) -> str:
    parts = rf"string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
    return f"CASE WHEN {x} = '' THEN 'No summary available.' ELSE left(trim(array_to_string(list_slice({parts}, 1, {n}), ' ')), {most}) END"


def first_case(low: str, groups: dict[str, list[str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_plain(low, v)} THEN '{k}'" for k, v in groups.items()) + f" ELSE '{other}' END"


CTES = {k: v for k, v in VIEWS.items()}
CTES["t1"] = f"SELECT *, {cleaned("coalesce(nullif(content_raw, ''), nullif(summary_raw, ''), nullif(title_raw, ''), '')")} AS cleaned_text FROM news_raw"
CTES["t2"] = "SELECT *, lower(cleaned_text) AS low, lower(coalesce(summary_raw, '') || ' ' || coalesce(content_raw, '') || ' ' || cleaned_text) AS blob FROM t1"
CTES["t3"] = f"""SELECT *, {tags([(k, any_term('low', v)) for k, v in d.THEMES.items()])} AS th, list_sort({tags([(k, any_term('low', v)) for k, v in d.GEOGRAPHIES.items()])}) AS ge,
  {tags([(n, f"contains(low, '{n.lower()}')") for n in d.ACTORS])} AS actors, contains(lower(coalesce(title_raw, '')), '[paywalled]') OR {any_plain('blob', d.PAYWALL)} AS paid, {lead('cleaned_text', 3, 700)} AS sm FROM t2"""
CTES["t4"] = "SELECT *, CASE WHEN len(th) > 0 THEN th ELSE ['general_news'] END AS theme_tags, CASE WHEN len(ge) > 0 THEN ge ELSE ['Global'] END AS geography_tags FROM t3"
CTES["processed"] = f"""SELECT *, CASE WHEN paid AND NOT contains(title_raw, '[Paywalled]') THEN '[Paywalled] ' || title_raw ELSE title_raw END AS title,
  CASE WHEN paid AND NOT starts_with(lower(sm), 'paywalled') THEN 'Paywalled: full article unavailable. ' || sm ELSE sm END AS summary,
  CAST(least(28 + least(9 * len(theme_tags), 30) + CASE WHEN list_has_any(geography_tags, {listed(d.CORE_GEOGRAPHIES)}) THEN 10 ELSE 5 END + least(7 * len(actors), 21)
    + CASE WHEN length(cleaned_text) > 500 THEN 10 ELSE 0 END + CASE WHEN list_has_any(theme_tags, {listed(d.CORE_THEMES)}) THEN 8 ELSE 0 END, 100) AS INTEGER) AS signal_score,
  CASE WHEN paid THEN 0.45::DOUBLE ELSE 0.65::DOUBLE END AS confidence,
  '{d.NEWS_WHY[0]}' || array_to_string(geography_tags, ', ') || '{d.NEWS_WHY[1]}' || array_to_string(theme_tags, ', ') || '.' AS why_it_matters,
  '{d.ANGLE}' AS linkedin_angle, '{AS_OF_TEXT}' AS processed_at FROM t4"""
CTES["d1"] = f"SELECT *, CAST(signal_score >= 65 AS INTEGER) AS linkedin_candidate, lower({cleaned("title || ' ' || summary || ' ' || array_to_string(theme_tags, ',')")}) AS dblob FROM processed"
CTES["d2"] = f"SELECT *, {count_terms('dblob', d.OFFSHORE)} AS off, {count_terms('dblob', d.ADJACENT)} AS adj, {count_terms('dblob', d.OTHER_ENERGY)} AS oth FROM d1"
CTES["items"] = """SELECT *, CASE WHEN dblob = '' THEN 'other_energy' WHEN off >= 2 OR (off >= 1 AND oth = 0) THEN 'offshore_wind' WHEN oth >= 2 AND off = 0 THEN 'other_energy' WHEN adj >= 1 AND off = 0 THEN 'adjacent_energy' WHEN off > 0 THEN 'offshore_wind' ELSE 'other_energy' END AS domain_bucket,
  CASE WHEN dblob = '' THEN 0.4::DOUBLE WHEN off >= 2 THEN 0.92::DOUBLE WHEN off >= 1 AND oth = 0 THEN 0.84::DOUBLE WHEN oth >= 2 AND off = 0 THEN 0.9::DOUBLE WHEN adj >= 1 AND off = 0 THEN 0.78::DOUBLE WHEN off > 0 THEN 0.68::DOUBLE WHEN oth > 0 THEN 0.66::DOUBLE ELSE 0.52::DOUBLE END AS domain_confidence,
  array_to_string(theme_tags, ',') AS themes, array_to_string(geography_tags, ',') AS geos, array_to_string(actors, ',') AS names FROM d2"""
CTES["listed"] = "SELECT *, row_number() OVER (ORDER BY coalesce(published_at, processed_at) DESC, processed_at DESC, id) AS pos FROM items"
CTES["overrides"] = "SELECT processed_id, arg_max(collection_key, (ts, event_id)) AS o FROM override_log GROUP BY processed_id"
CTES["k1"] = f"SELECT *, list_filter(regexp_extract_all(lower(title), '([a-z0-9]{{3,}})', 1), lambda x: x NOT IN {quoted(d.CLUSTER_STOPWORDS)}) AS told FROM listed LEFT JOIN overrides ON id = processed_id"
CTES["keyed"] = "SELECT *, coalesce(nullif(o, ''), 'auto:' || theme_tags[1] || '|' || geography_tags[1] || '|' || CASE WHEN len(told) = 0 THEN 'item' || id ELSE array_to_string(list_slice(told, 1, 5), '-') END) AS collection_key FROM k1"
CTES["m1"] = r"SELECT id, pos, domain_bucket AS b, epoch(TRY_CAST(coalesce(nullif(published_at, ''), processed_at) AS TIMESTAMPTZ)) AS t, list_distinct(regexp_extract_all(lower(title || ' ' || summary), '([a-z0-9]{3,})', 1)) AS w, list_distinct(regexp_extract_all(lower(names), '([a-z0-9]{3,})', 1)) AS a FROM listed"


def jac(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END)"


CTES["pairs"] = f"""SELECT * FROM (SELECT l.id AS left_id, r.id AS right_id, l.pos AS left_pos, r.pos AS right_pos, 0.75::DOUBLE * {jac('l.w', 'r.w')} + 0.25::DOUBLE * {jac('l.a', 'r.a')} AS score
  FROM m1 l JOIN m1 r ON l.pos < r.pos AND (l.b = r.b OR (l.b <> 'other_energy' AND r.b <> 'other_energy')) AND (l.t IS NULL OR r.t IS NULL OR abs(floor((l.t - r.t) / 86400)) <= 7)) x WHERE score >= 0.14"""
CTES["best"] = "SELECT left_id, right_id, score FROM (SELECT *, row_number() OVER (PARTITION BY left_pos ORDER BY score DESC, right_pos) AS k FROM pairs) x WHERE k <= 8"
CTES["judged"] = """SELECT left_id, right_id, score, said IS NULL AS fallback, CASE WHEN said IS NOT NULL AND left_id % 2 = 0 THEN 'Equinor,BP' ELSE '' END AS entities, CASE WHEN said IS NULL THEN '' ELSE 'same week' END AS overlap_timeframe, coalesce(said, 'no') AS same_story, coalesce(conf, least(greatest(score + 0.2::DOUBLE, 0.0::DOUBLE), 0.49::DOUBLE)) AS confidence,
  CASE WHEN said IS NULL THEN 'ai_unavailable_or_invalid' ELSE 'seen ' || left_id % 5 END AS reason_short FROM (SELECT *, CASE WHEN (left_id + right_id) % 2 = 0 AND (left_id + right_id) % 10 <> 0 THEN CASE WHEN left_id % 3 = 0 THEN 'no' ELSE 'yes' END END AS said,
  CASE WHEN (left_id + right_id) % 2 = 0 AND (left_id + right_id) % 10 <> 0 THEN CASE WHEN (left_id + right_id) % 14 = 0 THEN 0.0::DOUBLE ELSE (50 + (left_id * 7 + right_id) % 50) / 100.0::DOUBLE END END AS conf FROM best) x"""
CTES["queued"] = "SELECT *, CASE WHEN fallback THEN confidence >= 0.35 ELSE same_story = 'yes' AND confidence >= 0.7 END AS enqueue FROM judged"
# opportunities
CTES["n1"] = f"SELECT *, {cleaned("coalesce(title_raw, '') || '. ' || coalesce(description_raw, '') || '. ' || coalesce(buyer_raw, '')")} AS text FROM notice_raw"
CTES["n2"] = "SELECT *, lower(text) AS low FROM n1"


def fit(p: dict) -> str:
    keys = [x.lower() for x in [*p["keywords"], *p["aliases"]]]
    country = f"CASE WHEN country_raw IN {quoted(d.PRIMARY_MARKETS)} THEN 10 WHEN country_raw IN {quoted(d.SECONDARY_MARKETS)} THEN 5 ELSE 2 END"
    return f"CASE WHEN NOT {any_plain('low', p['negative_keywords'])} AND {any_plain('low', p['qualifier'])} AND {any_plain('low', keys)} THEN {country} + 3 END"


def qualifiers(p: dict) -> str:
    return f"array_to_string({tags([(q, f"contains(low, '{q}')") for q in sorted(p['qualifier'])])}, ',')"


_A, _M = d.PROFILES
CTES["n3"] = f"SELECT *, {fit(_A)} AS fa, {fit(_M)} AS fm, {qualifiers(_A)} AS qa, {qualifiers(_M)} AS qm FROM n2"
CTES["n4"] = f"""SELECT *, CASE WHEN fa IS NOT NULL AND (fm IS NULL OR fa >= fm) THEN fa ELSE fm END AS fit, CASE WHEN fa IS NOT NULL AND (fm IS NULL OR fa >= fm) THEN 'AGR' WHEN fm IS NOT NULL THEN 'MAV' END AS profile_name,
  {first_case('low', d.FAMILIES, 'other')} AS opportunity_family, {first_case('low', d.MECHANISMS, 'notice')} AS mechanism_type,
  regexp_extract(text, '\\b(20\\d{{2}}-\\d{{2}}-\\d{{2}})\\b', 1) AS iso, regexp_extract(text, '\\b(\\d{{1,2}})[./-](\\d{{1,2}})[./-](20\\d{{2}})\\b', ['d', 'm', 'y']) AS dmy,
  regexp_extract(low, '\\b(\\d{{1,2}})\\s+({'|'.join(d.MONTHS)})\\s+(20\\d{{2}})\\b', ['d', 'm', 'y']) AS named FROM n3""".replace("\\\\", "\\")
CTES["n5"] = f"""SELECT *, CASE WHEN iso <> '' THEN iso WHEN dmy.y <> '' THEN CAST(TRY_CAST(dmy.y || '-' || lpad(dmy.m, 2, '0') || '-' || lpad(dmy.d, 2, '0') AS DATE) AS VARCHAR)
  WHEN named.y <> '' THEN CAST(TRY_CAST(named.y || '-' || lpad(CAST(list_position({listed(d.MONTHS)}, named.m) AS VARCHAR), 2, '0') || '-' || lpad(named.d, 2, '0') AS DATE) AS VARCHAR) END AS deadline FROM n4"""
CTES["n6"] = f"SELECT *, CAST(TRY_CAST(deadline AS DATE) - DATE '{AS_OF[:10]}' AS INTEGER) AS days, CASE WHEN fit >= 15 THEN 'Strong' WHEN fit >= 8 THEN 'Medium' ELSE 'Weak' END AS strategic_fit FROM n5"
CTES["opps"] = f"""SELECT id, notice_id, title_raw AS title, source_name, notice_url AS source_url, buyer_raw AS buyer, country_raw AS country, {lead('text', 2, 450)} AS summary, opportunity_family, mechanism_type, deadline, days, strategic_fit,
  CASE WHEN country_raw = 'NOR' THEN 'Low' WHEN country_raw IN ('DNK', 'GBR') THEN 'Medium' ELSE 'High' END AS competition_level,
  CASE profile_name WHEN 'AGR' THEN '{_A['name']}' ELSE '{_M['name']}' END AS matched_services, CASE profile_name WHEN 'AGR' THEN qa ELSE qm END AS matched_qualifiers,
  CASE WHEN days <= 10 THEN '{d.ACTIONS[0]}' WHEN strategic_fit = 'Strong' THEN '{d.ACTIONS[1]}' ELSE '{d.ACTIONS[2]}' END AS recommended_action,
  '{d.OPPORTUNITY_WHY[0]}' || replace(opportunity_family, '_', ' ') || '{d.OPPORTUNITY_WHY[1]}' || replace(mechanism_type, '_', ' ') || '{d.OPPORTUNITY_WHY[2]}' || CASE WHEN country_raw = '' THEN 'target markets' ELSE country_raw END || '{d.OPPORTUNITY_WHY[3]}' || lower(strategic_fit) || '{d.OPPORTUNITY_WHY[4]}' AS why_it_matters,
  CAST(greatest(0, least(100, fit + CASE WHEN opportunity_family IN ('market_competitions', 'procurement_tenders') THEN 8 ELSE 4 END + CASE WHEN days < 0 THEN -10 WHEN days <= 14 THEN 12 WHEN days <= 45 THEN 6 ELSE 0 END)) AS INTEGER) AS signal_score,
  CASE strategic_fit WHEN 'Strong' THEN 0.78::DOUBLE WHEN 'Medium' THEN 0.67::DOUBLE ELSE 0.58::DOUBLE END AS confidence, profile_name, '{AS_OF_TEXT}' AS processed_at, publication_date FROM n6 WHERE fit IS NOT NULL"""
_HOST = "trim(lower(replace(regexp_extract(CASE WHEN {x} = '' THEN '' WHEN starts_with({x}, 'http://') OR starts_with({x}, 'https://') THEN {x} ELSE 'https://' || {x} END, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', '')))"
CTES["sources"] = f"SELECT *, {_HOST.format(x="coalesce(nullif(homepage, ''), nullif(url, ''), '')")} AS host FROM registry"
CTES["s1"] = "SELECT *, CASE WHEN host = '' THEN '#' || position ELSE host END AS k, CASE WHEN type = 'rss' THEN 2 ELSE 0 END + CAST(enabled AS INTEGER) AS sc FROM sources"
CTES["deduped"] = "SELECT position, name, homepage, type, url, enabled, host, first_position FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sc DESC, position DESC) AS r, min(position) OVER (PARTITION BY k) AS first_position FROM s1) x WHERE r = 1"
CTES["feeds"] = "SELECT source AS host, 'https://' || source || '/feed' AS feed_url FROM (SELECT source, min(page_id) AS p FROM crawl_pages GROUP BY source) x WHERE p % 2 = 0"
CTES["health"] = """SELECT run, source, kept, error, CASE WHEN error IS NOT NULL THEN 0 WHEN kept < before THEN 1 WHEN kept <= 0 THEN 1 ELSE 2 END AS health_score, CASE WHEN error IS NOT NULL THEN 'red' WHEN kept < before OR kept <= 0 THEN 'yellow' ELSE 'green' END AS health_color,
  CASE WHEN error IS NOT NULL THEN 'fetch_failed' WHEN kept < before THEN 'degraded_from_previous_fetch' ELSE 'ok' END AS reason FROM (SELECT *, lag(kept) OVER (PARTITION BY source ORDER BY run) AS before FROM fetch_log) x"""
_NEEDS = {
    "t1": ["news_raw"], "t2": ["t1"], "t3": ["t2"], "t4": ["t3"], "processed": ["t4"], "d1": ["processed"], "d2": ["d1"], "items": ["d2"], "listed": ["items"], "overrides": ["override_log"], "k1": ["listed", "overrides"], "keyed": ["k1"],
    "m1": ["listed"], "pairs": ["m1"], "best": ["pairs"], "judged": ["best"], "queued": ["judged"], "n1": ["notice_raw"], "n2": ["n1"], "n3": ["n2"], "n4": ["n3"], "n5": ["n4"], "n6": ["n5"], "opps": ["n6"],
    "sources": ["registry"], "s1": ["sources"], "deduped": ["s1"], "feeds": ["crawl_pages"], "health": ["fetch_log"],
}


def oracle(of: str | list[str], select: str) -> str:
    """A statement over the named expressions and all that they need."""
    order: list[str] = []

    def need(name: str) -> None:
        for x in _NEEDS.get(name, []):
            need(x)
        if name not in order:
            order.append(name)

    for name in [of] if isinstance(of, str) else of:
        need(name)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + select


def top(where: str, order: str, limit: int, bucket: str | None, columns: str) -> str:
    inner = f"SELECT * FROM items {where} ORDER BY {order} LIMIT {5 * limit}"
    return f"SELECT {columns} FROM ({inner}) x {f"WHERE domain_bucket = '{bucket}'" if bucket else ''} ORDER BY {order} LIMIT {limit}"
