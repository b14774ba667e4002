"""Tags, scores and domain buckets of news items (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from market_signals.functions import dictionaries as d
from market_signals.functions.text import any_of, has_word, hits, labels, or_default, tokens


def theme_tags(low: Column, themes: dict[str, list[str]] = d.THEMES) -> Column:
    return or_default(labels([(k, has_word(low, v)) for k, v in themes.items()]), "general_news")


def geography_tags(low: Column, places: dict[str, list[str]] = d.GEOGRAPHIES) -> Column:
    return or_default(F.sort_array(labels([(k, has_word(low, v)) for k, v in places.items()])), "Global")


def actors(low: Column, names: list[str] = d.ACTORS) -> Column:
    return F.filter(F.array(*map(F.lit, names)), lambda n: low.contains(F.lower(n)))


def signal_score(themes: Column, places: Column, names: Column, text: Column) -> Column:
    core = F.arrays_overlap(themes, F.array(*map(F.lit, d.CORE_THEMES)))
    near = F.arrays_overlap(places, F.array(*map(F.lit, d.CORE_GEOGRAPHIES)))
    points = F.lit(28) + F.least(F.size(themes) * 9, F.lit(30)) + F.when(near, 10).otherwise(5)
    points = points + F.least(F.size(names) * 7, F.lit(21)) + F.when(F.length(text) > 500, 10).otherwise(0) + F.when(core, 8).otherwise(0)
    return F.least(points, F.lit(100)).cast("int")


def why_it_matters(themes: Column, places: Column) -> Column:
    return F.concat(F.lit(d.NEWS_WHY[0]), F.array_join(places, ", "), F.lit(d.NEWS_WHY[1]), F.array_join(themes, ", "), F.lit("."))


def paywall_text(summary: Column, content: Column, text: Column) -> Column:
    """What paywalled() searches."""
    return F.lower(F.concat_ws(" ", F.coalesce(summary, F.lit("")), F.coalesce(content, F.lit("")), text))


def paywalled(title: Column, blob: Column) -> Column:
    return F.lower(F.coalesce(title, F.lit(""))).contains("[paywalled]") | any_of(blob, d.PAYWALL)


def domain_hits(blob: Column) -> dict[str, Column]:
    """How many terms of offshore wind, of adjacent and of other energy a normalised text holds."""
    return {"off": hits(blob, d.OFFSHORE), "near": hits(blob, d.ADJACENT), "other": hits(blob, d.OTHER_ENERGY)}


def domain(blob: Column, counts: dict[str, Column] | None = None) -> Column:
    """Struct(bucket, confidence) of a normalised text by a decision list over its three hit counts, which are best columns of their own."""
    off, near, other = (counts or domain_hits(blob)).values()

    def to(bucket: str, confidence: float) -> Column:
        return F.struct(F.lit(bucket).alias("bucket"), F.lit(confidence).alias("confidence"))

    return (
        F.when(blob == "", to("other_energy", 0.4))
        .when(off >= 2, to("offshore_wind", 0.92))
        .when((off >= 1) & (other == 0), to("offshore_wind", 0.84))
        .when((other >= 2) & (off == 0), to("other_energy", 0.9))
        .when((near >= 1) & (off == 0), to("adjacent_energy", 0.78))
        .when(off > 0, to("offshore_wind", 0.68))
        .when(other > 0, to("other_energy", 0.66))
        .otherwise(to("other_energy", 0.52))
    )


def compatible(a: Column, b: Column) -> Column:
    """Equal buckets, or offshore wind with adjacent energy."""
    pair = ["offshore_wind", "adjacent_energy"]
    return (a == b) | (a.isin(pair) & b.isin(pair))


def cluster_key(title: Column, item: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("([a-z0-9]{3,})"), 1)
    told = F.filter(found, lambda t: ~t.isin(d.CLUSTER_STOPWORDS))
    return F.when(F.size(told) == 0, F.concat(F.lit("item"), item.cast("string"))).otherwise(F.array_join(F.slice(told, 1, 5), "-"))


def collection_key(themes: Column, places: Column, title: Column, item: Column) -> Column:
    theme, place = F.coalesce(F.get(themes, 0), F.lit("general_news")), F.coalesce(F.get(places, 0), F.lit("Global"))
    return F.concat(F.lit("auto:"), theme, F.lit("|"), place, F.lit("|"), cluster_key(title, item))


def match_tokens(title: Column, summary: Column) -> Column:
    return tokens(F.concat_ws(" ", title, summary))


def relevance_status(c: Column) -> Column:
    return F.when(c == 1, "relevant").when(c == 0, "non_relevant").otherwise("unrated")


def relevance_payload(word: Column, qualified: Column) -> Column:
    """Struct(action, value) of a reviewer's word, or of `qualified` where there is no word: set to 1 or 0, cleared, or rejected."""
    t = F.lower(F.trim(word))
    to = lambda action, value=None: F.struct(F.lit(action).alias("action"), F.lit(value).cast("int").alias("value"))
    return (
        F.when(word.isNull() & qualified.isNull(), to("rejected"))
        .when(word.isNull(), F.when(qualified, to("set", 1)).otherwise(to("set", 0)))
        .when(t.isin("relevant", "yes", "true", "1"), to("set", 1))
        .when(t.isin("non_relevant", "non-relevant", "irrelevant", "no", "false", "0"), to("set", 0))
        .when(t.isin("unrated", "none", "clear", "reset"), to("clear"))
        .otherwise(to("rejected"))
    )


def confidence(value: Column, fallback: float = 0.5) -> Column:
    """A share of 0 to 1 from a number, a percentage or a word; values over 1 are hundredths."""
    t = F.lower(F.trim(value))
    words = {"high": 0.85, "hoy": 0.85, "medium": 0.6, "med": 0.6, "middels": 0.6, "low": 0.35, "lav": 0.35}
    said = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    number = F.regexp_replace(t, "%", "").try_cast("double")
    scaled = F.when(number > 100, 1.0).when(number > 1, number / 100.0).otherwise(number)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_element_at(said, t), scaled, F.lit(fallback))))
