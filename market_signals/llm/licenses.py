"""License scan by diagonal voting: word k-grams joined to licence texts, votes by offset, neighbouring offsets merged.

DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from market_signals.llm.common import documents, read

#: A word, once A-Z is lower-cased: ASCII letters and digits, and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a gram of phrases, and of longer texts.
SHORT, LONG = 2, 5
#: Of a longer text: offsets so near to each other are one span; share of its words that must be found; longest span, in lengths of the text.
SLACK, LEAST, SPAN = 8, 0.7, 1.5
#: Stands for the document itself among its grams.
SELF = -1


@dataclass(frozen=True)
class Template:
    """A licence's phrase or text. A phrase (up to four words) is found only word by word; `base` ones are counted."""

    label: str
    text: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return "".join(c if c.isalnum() else " " for c in self.text.lower()).split()

    @property
    def phrase(self) -> bool:
        return len(self.words) < LONG


# The phrases of the contract, names of further licences, and notices as their licences word them.
TEMPLATES = [
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-sa", "cc by sa"),
    Template("bsd", "bsd license"),
    Template("isc", "isc license"),
    Template("mpl", "mozilla public license"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), 0)


def grams(words: Column, k: int) -> Column:
    """A hash of every run of k words, in order."""
    some = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    return F.when(F.size(words) >= k, some).otherwise(F.array().cast("array<bigint>"))


def template_grams(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """h, t (the template's number), tpos, told (the gram's words) of every gram of the templates, and one row for SELF."""
    rows = F.array(*[F.struct(F.lit(i).alias("t"), F.array(*map(F.lit, x.words)).alias("words"), F.lit(SHORT if x.phrase else LONG).alias("k")) for i, x in enumerate(templates)])
    each = spark.range(1).select(F.inline(rows))
    parts = [each.where(F.col("k") == k).select("t", "words", F.posexplode(grams(F.col("words"), k)).alias("tpos", "h")).select("h", "t", "tpos", F.slice("words", F.col("tpos") + 1, F.lit(k)).alias("told")) for k in (SHORT, LONG)]
    own = spark.range(1).select(F.lit(SELF).cast("bigint").alias("h"), F.lit(SELF).alias("t"), F.lit(0).alias("tpos"), F.array().cast("array<string>").alias("told"))
    return parts[0].unionByName(parts[1]).unionByName(own)


def votes(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """doc_id, m, n_words, t, diagonal, tps (template places found there) and copies of every offset at which a text and a template share grams.

    Every text also has a row of its own, t = SELF, whose copies say how many equal rows there are.
    """
    rows = documents(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("m"), words_of(F.col("text")).alias("words"))
    # short grams, long grams, then the text itself: the place in the array says which it is
    all_ = F.concat(grams(F.col("words"), SHORT), grams(F.col("words"), LONG), F.array(F.lit(SELF).cast("bigint")))
    rows = rows.select("doc_id", "m", "words", F.size("words").alias("n_words"), F.posexplode(all_).alias("at", "h"))
    found = rows.join(F.broadcast(template_grams(docs.sparkSession, templates)), "h")
    shorts = F.greatest(F.col("n_words") - SHORT + 1, F.lit(0))
    pos = F.when(F.col("t") == SELF, 0).when(F.col("at") < shorts, F.col("at")).otherwise(F.col("at") - shorts)
    # equal hashes are held against the words themselves
    found = found.withColumn("pos", pos).where((F.col("t") == SELF) | (F.slice("words", F.col("pos") + 1, F.size("told")) == F.col("told")))
    found = found.select("doc_id", "m", "n_words", "t", "tpos", (F.col("pos") - F.col("tpos")).alias("diagonal")).repartition("doc_id", "m")
    return found.groupBy("doc_id", "m", "n_words", "t", "diagonal").agg(F.collect_set("tpos").alias("tps"), F.count("*").alias("copies"))


def spans(found: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """doc_id, m, n_words, copies, and t, first, share of every verified span (t = SELF: the text itself).

    Neighbouring offsets of one text and template are one band. Of a phrase all words must stand on one offset. Of a
    longer text a share of LEAST of its words must be covered by the band's grams, within SPAN lengths of it.
    """
    of = lambda f: F.element_at(F.array(*[F.lit(f(x)) for x in templates]), F.col("t") + 1)
    own = ["doc_id", "m", "n_words", "t"]
    k = F.when(of(lambda x: x.phrase), SHORT).otherwise(LONG)
    apart = F.col("diagonal") - F.lag("diagonal").over(W.partitionBy(*own).orderBy("diagonal"))
    slack = F.when((F.col("t") == SELF), 0).when(of(lambda x: x.phrase), 0).otherwise(SLACK)
    rows = found.withColumn("new", F.when(apart <= slack, 0).otherwise(1))
    rows = rows.withColumn("band", F.sum("new").over(W.partitionBy(*own).orderBy("diagonal").rowsBetween(W.unboundedPreceding, 0)))
    bands = rows.groupBy(*own, "band").agg(
        F.flatten(F.collect_list("tps")).alias("tps"), F.min(F.col("diagonal") + F.array_min("tps")).alias("first"), F.max(F.col("diagonal") + F.array_max("tps")).alias("last"), F.max("copies").alias("copies")
    )
    bands = bands.withColumn("k", F.when(F.col("t") == SELF, 0).otherwise(k)).withColumn("size", F.when(F.col("t") == SELF, 1).otherwise(of(lambda x: len(x.words))))
    covered = F.size(F.array_distinct(F.flatten(F.transform("tps", lambda x: F.sequence(x, x + F.col("k") - 1)))))
    bands = bands.withColumn("share", F.when(F.col("t") == SELF, 0.0).otherwise(covered / F.col("size")))
    ok = F.when(F.col("t") == SELF, True).when(F.col("k") == SHORT, F.col("share") == 1).otherwise((F.col("share") >= LEAST) & (F.col("last") + F.col("k") - F.col("first") <= SPAN * F.col("size")))
    return bands.where(ok).select(*own, "copies", "first", "share")


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """Licences of every row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    All word grams of a text meet those of the templates in one broadcast join (the templates are a list of the driver,
    a few thousand grams); only shared grams are shuffled, by document, once. n_base, first_word and last_word count the
    places of base phrases; `labels` also has those of further phrases and longer texts, and score is the greatest share
    of a template that stands in the text (0 without one).

    Null texts are empty: no words and no labels. Equal rows each get their row; rows that repeat an id with other texts
    are told apart; a null doc_id stays null; an empty table gives no rows; further columns are ignored.
    """
    found = spans(votes(docs, templates), templates)
    label = F.element_at(F.array(*[F.lit(x.label) for x in templates]), F.col("t") + 1)
    base = F.when(F.col("t") == SELF, False).otherwise(F.element_at(F.array(*[F.lit(x.base) for x in templates]), F.col("t") + 1))
    rows = found.select("doc_id", "m", "n_words", F.when(F.col("t") == SELF, F.col("copies")).alias("copies"), F.when(F.col("t") != SELF, label).alias("label"), base.alias("base"), "first", "share")
    own = F.when(F.col("base"), F.col("first"))
    out = rows.groupBy("doc_id", "m", "n_words").agg(
        F.max("copies").alias("copies"), F.count_if("base").alias("n_base"), F.min(own).alias("first_word"), F.max(own).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"), F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"),
    )
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("doc_id", F.col("n_words").cast("long"), "n_base", F.col("first_word").cast("long"), F.col("last_word").cast("long"), "base_labels", "labels", "score")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


_ROWS = ", ".join(f"({i}, '{x.label}', {x.base}, {x.phrase}, {SHORT if x.phrase else LONG}, {0 if x.phrase else SLACK}, string_split('{' '.join(x.words)}', ' '))" for i, x in enumerate(TEMPLATES))


def _grams_sql(words: str) -> str:
    return f"list_transform(range(greatest(len({words}) - k + 1, 0)::BIGINT), lambda i: struct_pack(pos := i, g := array_to_string({words}[i + 1:i + k], ' ')))"


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents
), tm(t, label, base, phrase, k, slack, told) AS (VALUES {_ROWS}
), tg AS (SELECT t, k, g.g AS g, g.pos AS tpos FROM (SELECT t, k, unnest({_grams_sql('told')}) AS g FROM tm) x
), dg AS (SELECT id, k, g.g AS g, g.pos AS pos FROM (SELECT id, k, unnest({_grams_sql('words')}) AS g FROM d, (SELECT DISTINCT k FROM tm) ks) x
), h AS (SELECT id, t, pos, tpos, pos - tpos AS diagonal FROM dg JOIN tg ON dg.k = tg.k AND dg.g = tg.g
), n AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY id, t ORDER BY diagonal) <= slack THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT id, t, diagonal FROM h) x JOIN tm USING (t)
), b AS (SELECT id, t, diagonal, sum(new) OVER (PARTITION BY id, t ORDER BY diagonal) AS band FROM n
), v AS (SELECT id, t, band, min(pos) AS first, max(pos) AS last, count(DISTINCT w) AS covered FROM (SELECT h.id, h.t, band, pos, unnest(range(tpos, tpos + k)) AS w FROM h JOIN b ON h.id = b.id AND h.t = b.t AND h.diagonal = b.diagonal JOIN tm ON tm.t = h.t) x GROUP BY id, t, band
), s AS (SELECT v.*, label, base, covered::DOUBLE / len(told) AS share FROM v JOIN tm ON v.t = tm.t WHERE CASE WHEN phrase THEN covered = len(told) ELSE covered::DOUBLE / len(told) >= {LEAST}::DOUBLE AND last + k - first <= {SPAN}::DOUBLE * len(told) END
)
SELECT any_value(doc_id) AS doc_id, any_value(len(words))::BIGINT AS n_words, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (label IS NOT NULL))), ','), '') AS labels, coalesce(max(share), 0.0::DOUBLE) AS score
FROM d LEFT JOIN s ON d.id = s.id GROUP BY d.id
"""
