"""The incremental rules as Structured Streaming jobs over files that land in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from market_signals.functions.text import parse_time
from market_signals.operators.items import process
from market_signals.operators.registry import health
from market_signals.operators.state import insert_if_absent, recent
from market_signals.operators.tables import Change, last_wins, rewrite


def landed(spark: SparkSession, path: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_seen(items: DataFrame, key: str = "article_url", late: str = "60 days") -> DataFrame:
    """New items once each while the watermark holds their key. Items without a time are kept and not compared over time."""
    return items.withColumn("published_ts", parse_time(F.col("published_at"))).withWatermark("published_ts", late).dropDuplicatesWithinWatermark([key])


def once(items: DataFrame, key: str = "article_url") -> DataFrame:
    """New items once each, however late a repetition comes and with or without a time. All keys are state: see with_rocksdb."""
    return items.dropDuplicates([key])


def processed(items: DataFrame, as_of_text: str) -> DataFrame:
    """Stateless processing of a stream of raw items."""
    return process(items, as_of_text)


def current_values(log: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The last value of each key of a log, and its place in `order`, for `update` or `complete` mode."""
    place = F.struct(*order)
    return log.groupBy(key).agg(F.max_by(F.struct(value), place).alias("_v"), F.max(place).alias("_o")).select(key, F.col(f"_v.{value}").alias(value), *[F.col(f"_o.{c}").alias(c) for c in order])


def merge_batches(path: str, by: list[str], change: Change, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that puts each batch into the table at `path` (see operators.tables), once: a batch that comes again is left out."""

    def write(batch: DataFrame, number: int) -> None:
        rewrite(batch, path, by, change, buckets, number)

    return write


def insert_batches(path: str, key: str, order: str, as_of: str, days_back: int | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends a batch's new keys to the Parquet table at `path`, exactly and without a watermark.

    A batch writes into its own folder, so that a repeated batch overwrites itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = recent(batch, as_of, days_back) if days_back else batch
        try:
            stored = spark.read.parquet(path).where(F.col("batch") < number)
        except Exception as error:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            stored = new.limit(0)
        insert_if_absent(new, stored, key, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def judged(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Runs with their health, those of the batch among the stored ones of the same sources; a run that comes again replaces the stored one."""
    names = ["run", "source", "kept", "error"]
    rows = stored.select(*names, F.lit(0).alias("new")).unionByName(batch.select(*names, F.lit(1).alias("new")))
    return health(last_wins(["run", "source"], ["new"])(rows, rows.limit(0)).drop("new")).select(batch.columns)


def health_batches(path: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds the runs (run, source, kept, error) of each batch with their health to the table at `path`.

    Runs may land in any order: a run is judged against the one before it among all that have landed, and the run after
    it is judged again. The table's buckets are by source, so a batch reads and writes only those of its sources.
    """

    def write(batch: DataFrame, number: int) -> None:
        shape = health(batch.limit(0)).dtypes
        rows = batch.select("run", "source", "kept", "error")
        whole = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in shape])
        rewrite(whole, path, ["source"], judged, buckets, number)

    return write


def split_batches(good: str, failed: str, reason: Column, process: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes what `process` makes of rows without a reason to `good`, and the others with it to `failed`.

    Both sinks are folders by batch number, which a repeated batch overwrites; the batch is computed once for both.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("reason", reason).persist()
        process(rows.where("reason is null").drop("reason")).write.mode("overwrite").parquet(f"{good}/batch={number}")
        rows.where("reason is not null").write.mode("overwrite").parquet(f"{failed}/batch={number}")
        rows.unpersist()

    return write


def drain(stream: DataFrame, checkpoint: str) -> DataFrame:
    """Run a stream of appended rows over what there is and return its rows so far, which executors write to a Parquet table beside the checkpoint."""
    spark, table = stream.sparkSession, f"{checkpoint.rstrip('/')}_rows"
    query: StreamingQuery = stream.writeStream.format("parquet").option("path", table).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(table)


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what there is, batch by batch."""
    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def with_rocksdb(spark: SparkSession) -> None:
    """Keep the state of streams that start from now on in RocksDB on the executors' disks, with changelogs in the checkpoint: it may outgrow their memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
