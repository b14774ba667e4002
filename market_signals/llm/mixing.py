"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from market_signals.llm.common import WORD, keep, read, small

BUCKETS = 65536


def uniform(doc_id: Column, seed: int) -> Column:
    """A reproducible number in (0, 1) from 52 bits of md5 of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(sized: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """One row per source: its size, mean tilt and target.

    Water filling in closed form: sources in order of cap / weight are capped while the level that is left for the
    others is higher; the final level is the highest of these levels.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("g")).alias("sg"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    by = by.withColumn("w", weight).withColumn("ratio", F.lit(float(most)) * F.col("source_size") / F.col("w"))
    before = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    cap = F.col("source_size") * F.lit(float(most))
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    by = by.withColumn("level", level)
    target = F.least(cap, F.col("w") * F.max("level").over(every))
    return by.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, F.col("sg") / F.col("source_size")).otherwise(0.0).alias("mean_g"))


def measured(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, size (words), its tilt g (and `more`)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select("doc_id", "source", size.alias("size"), *more)
    return sized.withColumn("g", F.floor(F.col("size") * 1000 / (F.col("size") + 200)).cast("long"))


def mix(docs: DataFrame, weights: list[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, tilt: float = 0.5, seed: int = 17, carry: bool = False) -> DataFrame:
    """Copies of every document in a mix whose sources come near their target words.

    Sources take `weights` by code point (null last), repeating, and share `share` of all words; no source gets over
    `most` times its words. Of target / size copies per word, the whole part is certain for every document. The rest is
    a fixed-size unequal-probability sample: inclusion odds rise with a document's length (by `tilt`; the expected
    words stay the target), documents rank by random odds over inclusion odds, and the first that fill the words are
    taken. The ranking is not one sort of a source: a histogram of ranks finds the bucket in which the words run out,
    and only that bucket (about 1 / 65536 of a source) is sorted.

    Returns doc_id, source, size, source_size, target, copies, taken, and with `carry` the whole row as a struct `r`
    (it isn't shuffled, but for the bucket that is sorted). Null or empty texts have size 0 and take 0 words
    (whole copies are still counted); a null doc_id ranks as the empty id; repeated rows each count; an empty table
    gives no rows. Further columns are ignored.
    """
    sized = keep(measured(docs))
    targets = small(keep(source_targets(sized, list(weights), share, most)))
    rows = ranked(sized, targets, tilt, seed)
    filled = rows.where("q is not null").groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"))
    along = W.partitionBy("source").orderBy("bucket")
    filled = filled.withColumn("upto", F.sum("words").over(along)).withColumn("below", F.col("upto") - F.col("words"))
    edge = filled.where("upto > rest").groupBy("source").agg(F.min_by(F.struct("bucket", "below"), "bucket").alias("e"))
    edge = edge.select(F.col("source").alias("edge_source"), "e.bucket", "e.below").withColumnsRenamed({"bucket": "edge", "below": "edge_below"})
    if carry:
        rows = ranked(measured(docs, F.struct(*docs.columns).alias("r")), targets, tilt, seed)
    rows = rows.join(small(keep(edge)), F.col("source").eqNullSafe(F.col("edge_source")), "left")
    inside = W.partitionBy("source").orderBy("q", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, 0)
    at_edge = rows.where("q is not null and bucket = edge").withColumn("cum", F.col("edge_below") + F.sum("size").over(inside))
    at_edge = at_edge.withColumn("more", F.when(2 * F.col("cum") - F.col("size") <= 2 * F.col("rest"), 1).otherwise(0))
    others = rows.where("q is null or edge is null or bucket <> edge")
    others = others.withColumn("more", F.when(F.col("q").isNotNull() & (F.col("edge").isNull() | (F.col("bucket") < F.col("edge"))), 1).otherwise(0))
    names = ["doc_id", "source", "size", "source_size", "target", "base", "more", *["r"] * carry]
    both = at_edge.select(names).unionByName(others.select(names))
    copies = (F.col("base") + F.col("more")).cast("long")
    return both.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *["r"] * carry)


def ranked(sized: DataFrame, targets: DataFrame, tilt: float, seed: int) -> DataFrame:
    """Rows with their certain copies (base), the words that remain for their source (rest), and their Pareto rank q and its bucket."""
    rows = sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "source_size", "target", "mean_g")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("rate", rate).withColumn("base", F.floor("rate")).withColumn("part", F.col("rate") - F.col("base"))
    rows = rows.withColumn("rest", F.col("target") - F.col("base") * F.col("source_size"))
    chance = F.col("part") + F.lit(float(tilt)) * F.col("part") * (1 - F.col("part")) * (F.col("g") - F.col("mean_g")) / 1000.0
    u = uniform(F.col("doc_id"), seed)
    rows = rows.withColumn("pi", chance).withColumn("u", u)
    rank = F.when(F.col("pi") > 0, F.col("u") / (1 - F.col("u")) * ((1 - F.col("pi")) / F.col("pi")))
    return rows.withColumn("q", rank).withColumn("bucket", F.floor(F.col("q") / (1 + F.col("q")) * BUCKETS))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: every row repeated by its copies. Rows that take no copy go. Nulls and repeated rows are as in mix()."""
    each = F.sequence(F.lit(1), F.col("copies").cast("int"))
    return mix(docs, carry=True).where("copies > 0").select("r", F.explode(each).alias("copy_of_mix")).select("r.*")


SQL = r"""
WITH s AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), g AS (SELECT *, (size * 1000 / (size + 200))::DOUBLE AS gx FROM s
), gg AS (SELECT doc_id, source, size, floor(gx)::BIGINT AS g FROM g
), b AS (SELECT source, sum(size)::DOUBLE AS source_size, sum(size * g)::DOUBLE AS sg FROM gg GROUP BY source
), w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM b
), r AS (SELECT *, 2.0::DOUBLE * source_size / w AS ratio FROM w
), l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER e, 0.0::DOUBLE)) / (sum(w) OVER () - coalesce(sum(w) OVER e, 0.0::DOUBLE)) AS level
  FROM r WINDOW e AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, w * max(level) OVER ()) AS target, CASE WHEN source_size > 0 THEN sg / source_size ELSE 0.0::DOUBLE END AS mean_g FROM l
), d AS (SELECT gg.*, source_size, target, mean_g, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM gg JOIN t ON gg.source IS NOT DISTINCT FROM t.source
), p AS (SELECT *, floor(rate) AS base, rate - floor(rate) AS part, target - floor(rate) * source_size AS rest,
    (CAST('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM d
), i AS (SELECT *, part + 0.5::DOUBLE * part * (1 - part) * (g - mean_g) / 1000.0::DOUBLE AS pi FROM p
), q AS (SELECT *, CASE WHEN pi > 0 THEN u / (1 - u) * ((1 - pi) / pi) END AS q FROM i
), c AS (SELECT *, sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM q)
SELECT doc_id, source, size, source_size::BIGINT AS source_size, target,
  (base + CASE WHEN q IS NOT NULL AND 2 * cum - size <= 2 * rest THEN 1 ELSE 0 END)::BIGINT AS copies,
  ((base + CASE WHEN q IS NOT NULL AND 2 * cum - size <= 2 * rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM c
"""
