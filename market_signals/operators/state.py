"""Keyed state: first wins, insert if absent, last write wins, checkpoints and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from market_signals.functions.text import parse_time
from market_signals.session import keep


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key in an order; Spark prunes rows beyond k before the shuffle."""
    return df.withColumn("_row", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_row") <= k).drop("_row")


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    return top_per(df, [key], [F.col(order)])


def insert_if_absent(new: DataFrame, stored: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of `new` to add: the first of each key that isn't stored yet."""
    return first_wins(new.join(stored.select(key).distinct(), key, "left_anti"), key, order)


def latest_state(log: DataFrame, key: str, value: str, order: list[str], tombstones: bool = True) -> DataFrame:
    """The last value of each key. With `tombstones`, a null value deletes the key. Aggregates before the shuffle."""
    out = log.groupBy(key).agg(F.max_by(F.struct(value), F.struct(*order)).alias("_v")).select(key, F.col(f"_v.{value}").alias(value))
    return out.where(F.col(value).isNotNull()) if tombstones else out


def checkpoint_of(raw: DataFrame) -> DataFrame:
    """One row: the greatest published time as text, or the greatest fetch time if none is published."""
    return raw.agg(F.coalesce(F.max("published_at"), F.max("fetched_at")).alias("checkpoint"))


def recent(df: DataFrame, as_of: str, days_back: int, column: str = "published_at") -> DataFrame:
    """Drops rows with a time before the cutoff; rows without a time pass."""
    cutoff = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {max(1, days_back)} DAYS")
    at = parse_time(F.col(column))
    return df.where(at.isNull() | (at >= cutoff))


def since(df: DataFrame, checkpoint: Column, column: str = "published_at") -> DataFrame:
    """Drops rows with a time up to the checkpoint; rows without a time pass."""
    at = parse_time(F.col(column))
    return df.where(at.isNull() | (at > checkpoint))


def by_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    clean = ids.where(F.col(key) > 0).select(key).distinct()
    return df.join(clean, key, "left_semi")


def missing_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return ids.where(F.col(key) > 0).select(key).distinct().join(df.select(key), key, "left_anti")


#: What a new judgement of a pair replaces.
JUDGEMENT = ["ai_same_story", "ai_confidence", "reason_short", "overlap_entities", "overlap_timeframe"]


def upsert_pairs(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs with ids in order; a known pair takes the new judgement and keeps its status and creation time."""
    ids = [F.least("item_a_id", "item_b_id").alias("a"), F.greatest("item_a_id", "item_b_id").alias("b")]
    n = new.select(*ids, *[F.col(c).alias(f"n_{c}") for c in JUDGEMENT], F.col("created_at").alias("nt"))
    out = stored.select(F.col("item_a_id").alias("a"), F.col("item_b_id").alias("b"), *JUDGEMENT, "status", "created_at").join(n, ["a", "b"], "full_outer")
    return out.select(
        F.col("a").alias("item_a_id"), F.col("b").alias("item_b_id"), *[F.coalesce(f"n_{c}", c).alias(c) for c in JUDGEMENT],
        F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("created_at", "nt").alias("created_at"),
    )


def unprocessed(raw: DataFrame, limit: int | None = None) -> DataFrame:
    """New and parsed items, the latest fetched first; all of them, or the first `limit` as a guard of small runs."""
    out = raw.where(F.col("status").isin("new", "parsed")).orderBy(F.desc("fetched_at"), "id")
    return out if limit is None else out.limit(limit)


def append_feedback(log: DataFrame, path: str, at: str) -> None:
    """Append reviewers' feedback (feedback_type, feedback_value, processed_id, pair_id, actor) to the log at `path`. Zero ids are none."""
    some = lambda c: F.nullif(F.col(c).cast("long"), F.lit(0)).alias(c)
    log.select(some("processed_id"), some("pair_id"), F.col("feedback_type").cast("string").alias("feedback_type"), F.col("feedback_value").cast("string").alias("feedback_value"), F.col("actor").cast("string").alias("actor"), F.lit(at).alias("created_at")).write.mode("append").parquet(path)


def failures(rows: DataFrame, reason: Column, by: str, samples: int = 5) -> DataFrame:
    """From the side table of rows that can't be processed (`reason` isn't null): their number in each group, and the first ids with their reasons."""
    bad = keep(rows.select("id", by, reason.alias("reason"))).where("reason is not null")
    some = top_per(bad, [by], [F.asc("id")], samples).groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "reason"))), lambda x: F.concat(x["id"].cast("string"), F.lit(": "), x["reason"])), "; ").alias("samples"))
    return bad.groupBy(by).agg(F.count("*").alias("failed")).join(some, by)


def observed(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, DataFrame]:
    """The table that `df` is written to, and one row of metrics (aliased aggregates) that were counted while it was written, without another pass."""
    seen = Observation(name)
    table = keep(df.observe(seen, *metrics))
    told = seen.get
    kinds = df.limit(0).agg(*metrics).schema
    return table, df.sparkSession.createDataFrame([tuple(told[f.name] for f in kinds)], kinds)
