"""The signal contract: one shape for items of all modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def news_signals(items: DataFrame) -> DataFrame:
    return items.select(
        F.concat(F.lit("news_"), "id").alias("signal_id"), F.lit("news").alias("module_type"), F.col("id").cast("string").alias("module_item_id"), "title", "source_name", F.col("article_url").alias("source_url"), "published_at", F.lit("unknown").alias("country"),
        "geography_tags", "theme_tags", "actors", "summary", "why_it_matters", "signal_score", "confidence", "linkedin_angle", (F.col("linkedin_candidate") == 1).alias("linkedin_candidate"), F.concat(F.lit("raw_"), "id").alias("raw_reference"),
    )


def opportunity_signals(items: DataFrame) -> DataFrame:
    one = lambda c: F.array(F.coalesce(c, F.lit("")))
    return items.select(
        F.concat(F.lit("opportunity_"), "id").alias("signal_id"), F.lit("opportunities").alias("module_type"), F.col("id").cast("string").alias("module_item_id"), "title", "source_name", "source_url", F.col("publication_date").alias("published_at"), F.coalesce("country", F.lit("")).alias("country"),
        one("country").alias("geography_tags"), one("opportunity_family").alias("theme_tags"), one("buyer").alias("actors"), "summary", "why_it_matters", "signal_score", "confidence", "deadline", "mechanism_type", "opportunity_family", "recommended_action", F.concat(F.lit("raw_"), "id").alias("raw_reference"),
    )


def united(news: DataFrame, opportunities: DataFrame) -> DataFrame:
    return news_signals(news).unionByName(opportunity_signals(opportunities), allowMissingColumns=True)


def top_across(signals: DataFrame, per_module: int = 20) -> DataFrame:
    """The best signals of each module with their rank there and over all."""
    own = W.partitionBy("module_type").orderBy(F.desc("signal_score"), "signal_id")
    best = signals.withColumn("module_rank", F.row_number().over(own)).where(F.col("module_rank") <= per_module)
    return best.withColumn("overall_rank", F.row_number().over(W.orderBy(F.desc("signal_score"), "signal_id")))


def ideas(items: DataFrame, least: int = 65) -> DataFrame:
    """Items worth a post: candidates, or those of a score over the limit."""
    return items.where((F.col("linkedin_candidate") == 1) | (F.col("signal_score") > least)).select(F.concat(F.lit("idea_"), "id").alias("idea_id"), "title", "signal_score", "why_it_matters", "linkedin_angle", F.lit("idea").alias("status"))


def write_signals(signals: DataFrame, path: str) -> None:
    signals.write.mode("overwrite").partitionBy("module_type").parquet(path)
