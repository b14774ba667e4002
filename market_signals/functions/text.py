"""Text functions (Column -> Column)."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(*columns: Column | str) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns])


def clean(c: Column) -> Column:
    """White space collapsed to single spaces, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def norm(c: Column) -> Column:
    return F.lower(clean(c))


def lead(c: Column, sentences: int = 3, most: int = 700) -> Column:
    """The first sentences of a cleaned text, at most so many characters."""
    parts = F.slice(F.split(c, r"(?<=[.!?])\s+", sentences + 1), 1, sentences)
    return F.when(c == "", "No summary available.").otherwise(F.substring(F.trim(F.array_join(parts, " ")), 1, most))


def has_word(low: Column, terms: list[str]) -> Column:
    """Whether a lower-case text holds one of the terms; alphabetic terms of up to three letters only as words of their own."""
    terms = [t.strip().lower() for t in terms]
    short = [t for t in terms if len(t) <= 3 and t.isalpha()]
    rest = [t for t in terms if t and t not in short]
    # the plain test leaves few texts to the pattern, which looks around a term only where it stands
    alone = [low.contains(t) & low.rlike(rf"{t}(?<![\p{{L}}\p{{N}}_]{t})(?![\p{{L}}\p{{N}}_])") for t in short]
    return reduce(or_, [*alone, any_of(low, rest)])


def any_of(low: Column, terms: list[str]) -> Column:
    """Whether a lower-case text column holds one of the terms as a plain substring. Compiled, the first hit ends it; a
    text that is still to be computed belongs in a column of its own first, or in has_any()."""
    return reduce(or_, [low.contains(t) for t in terms]) if terms else F.lit(False)


def has_any(low: Column, terms: list[str]) -> Column:
    """any_of() of a text expression, which is evaluated once."""
    return F.exists(F.array(*map(F.lit, terms)), lambda t: low.contains(t)) if terms else F.lit(False)


def hits(low: Column, terms: list[str]) -> Column:
    """How many of the terms a lower-case text column holds."""
    return reduce(add, [low.contains(t).cast("int") for t in terms]) if terms else F.lit(0)


def labels(pairs: list[tuple[str, Column]]) -> Column:
    """Labels whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs]))


def or_default(tags: Column, default: str) -> Column:
    """The tags, or the default alone if there are none. The tags stand here once, so that they are made once."""
    return F.get(F.filter(F.array(tags, F.array(F.lit(default))), lambda x: F.size(x) > 0), 0)


def tokens(c: Column) -> Column:
    """Distinct runs of three and more of a-z and 0-9 in the lower-case text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]{3,})"), 1))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two distinct arrays; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def from_csv(c: Column, trim: bool = True) -> Column:
    parts = F.split(F.coalesce(c, F.lit("")), ",")
    return F.filter(F.transform(parts, lambda x: F.trim(x)) if trim else parts, lambda x: x != "")


def csv(c: Column) -> Column:
    return F.array_join(c, ",")


def first_case(low: Column, groups: dict[str, list[str]], other: str) -> Column:
    """The first group one of whose terms the text holds."""
    out = None
    for name, terms in groups.items():
        out = F.when(any_of(low, terms), name) if out is None else out.when(any_of(low, terms), name)
    return out.otherwise(other)


def parse_time(c: Column) -> Column:
    """A timestamp of ISO text (Z, offset or none, which is UTC); null if it doesn't parse."""
    return F.try_to_timestamp(F.nullif(F.trim(c), F.lit("")))


def published_text(c: Column) -> Column:
    """ISO text in UTC of RFC-2822 or ISO time text; text that doesn't parse stays, blank is null."""
    own = F.nullif(F.trim(c), F.lit(""))
    plain = F.regexp_replace(own, r"^[A-Za-z]{3},\s*", "")
    when = F.coalesce(F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss xx")))
    when = F.coalesce(when, F.when(own.rlike(r"^\d{4}-\d{2}-\d{2}T\d"), F.try_to_timestamp(own)))
    return F.coalesce(F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), own)
