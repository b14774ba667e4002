"""Families, deadlines, profile fit and scores of notices (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from market_signals.functions import dictionaries as d
from market_signals.functions.text import any_of, first_case


def family(low: Column) -> Column:
    return first_case(low, d.FAMILIES, "other")


def mechanism(low: Column) -> Column:
    return first_case(low, d.MECHANISMS, "notice")


def _date(year: Column, month: Column, day: Column) -> Column:
    # there and back instead of a condition on the text, which would be searched for twice
    return F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date").cast("string")


def deadline(text: Column) -> Column:
    """The first ISO date as it stands, else the first day.month.year, else the first day, month's name and year; one that is no date is null."""
    iso = F.regexp_extract(text, r"\b(20\d{2}-\d{2}-\d{2})\b", 1)
    dmy = r"\b(\d{1,2})[./-](\d{1,2})[./-](20\d{2})\b"
    named = rf"\b(\d{{1,2}})\s+({'|'.join(d.MONTHS)})\s+(20\d{{2}})\b"
    low = F.lower(text)
    part = lambda c, p, i: F.regexp_extract(c, p, i)
    month = F.array_position(F.array(*map(F.lit, d.MONTHS)), part(low, named, 2)).cast("string")
    return (
        F.when(iso != "", iso)
        .when(part(text, dmy, 3) != "", _date(part(text, dmy, 3), part(text, dmy, 2), part(text, dmy, 1)))
        .when(part(low, named, 3) != "", _date(part(low, named, 3), month, part(low, named, 1)))
    )


def days_left(due: Column, as_of: str) -> Column:
    """Whole days from `as_of` to the midnight of a deadline, rounded down; null if the deadline is no date."""
    at = F.when(due.rlike(r"^\d{4}-\d{2}-\d{2}$"), due.try_cast("date")).cast("timestamp")
    return F.floor((F.unix_micros(at) - F.unix_micros(F.lit(as_of).cast("timestamp"))) / 86_400_000_000).cast("int")


def country_score(country: Column) -> Column:
    c = F.upper(F.coalesce(country, F.lit("")))
    return F.when(c.isin(d.PRIMARY_MARKETS), 10).when(c.isin(d.SECONDARY_MARKETS), 5).otherwise(2)


def company_fit(low: Column, country: Column, company: str, profiles: list[dict], order: int) -> Column:
    """Struct(fit, place, profile_name, services, qualifiers) of one company's profiles, or null if it doesn't match."""
    negative = sorted({t for p in profiles for t in p["negative_keywords"]})
    qualifiers = sorted({t for p in profiles for t in p["qualifier"]})
    found = F.filter(F.array(*map(F.lit, qualifiers)), lambda t: low.contains(t)) if qualifiers else F.array().cast("array<string>")
    hit = [any_of(low, p["keywords"]) for p in profiles]
    n = sum((h.cast("int") for h in hit), F.lit(0))
    services = F.sort_array(F.array_distinct(F.array_compact(F.array(*[F.when(h & F.lit(p["name"].strip() != ""), F.lit(p["name"])) for h, p in zip(hit, profiles, strict=True)]))))
    ok = ~any_of(low, negative) & any_of(low, qualifiers) & (n > 0)
    return F.when(ok, F.struct((country_score(country) + n * 3).alias("fit"), F.lit(-order).alias("place"), F.lit(company).alias("profile_name"), services.alias("services"), found.alias("qualifiers")))


def best_fit(low: Column, country: Column, bundle: dict[str, list[dict]]) -> Column:
    """The best company's fit; of equal ones the earlier company's. Row-wise over the small bundle: no join, no shuffle."""
    fits = [company_fit(low, country, c, p, i) for i, (c, p) in enumerate(bundle.items()) if p]
    # greatest() passes over nulls and is compiled, which a filtered array is not
    return F.greatest(*fits) if len(fits) > 1 else F.array_max(F.array_compact(F.array(*fits)))


def strategic_fit(fit: Column) -> Column:
    return F.when(fit >= 15, "Strong").when(fit >= 8, "Medium").otherwise("Weak")


def competition(country: Column) -> Column:
    c = F.upper(F.coalesce(country, F.lit("")))
    return F.when(c == "NOR", "Low").when(c.isin("DNK", "GBR"), "Medium").otherwise("High")


def signal_score(fit: Column, kind: Column, days: Column) -> Column:
    late = F.when(days < 0, -10).when(days <= 14, 12).when(days <= 45, 6).otherwise(0)
    points = fit + F.when(kind.isin("market_competitions", "procurement_tenders"), 8).otherwise(4) + late
    return F.greatest(F.lit(0), F.least(F.lit(100), points)).cast("int")


def action(strength: Column, days: Column, services: Column) -> Column:
    return F.when(days <= 10, d.ACTIONS[0]).when(strength == "Strong", d.ACTIONS[1]).when(F.size(services) > 0, d.ACTIONS[2]).otherwise(d.ACTIONS[3])


def why_it_matters(kind: Column, way: Column, country: Column, strength: Column) -> Column:
    place = F.coalesce(F.nullif(country, F.lit("")), F.lit("target markets"))
    return F.concat(
        F.lit(d.OPPORTUNITY_WHY[0]), F.replace(kind, F.lit("_"), F.lit(" ")), F.lit(d.OPPORTUNITY_WHY[1]), F.replace(way, F.lit("_"), F.lit(" ")),
        F.lit(d.OPPORTUNITY_WHY[2]), place, F.lit(d.OPPORTUNITY_WHY[3]), F.lower(strength), F.lit(d.OPPORTUNITY_WHY[4]),
    )
