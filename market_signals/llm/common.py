"""Helpers that the corpus operators share: shared-folder tables, label splits, text blocks."""

from __future__ import annotations

import ctypes
import gc
import sys
import time
from collections.abc import Iterable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from market_signals.session import BATCH, bounded, keep, shared_dir, spread

__all__ = ["BATCH", "WORD", "blocks", "documents", "fold", "forget", "keep", "labelled", "marked", "read", "release", "shared_dir", "small", "spread", "text_bytes", "tidy"]

#: White space of the contracts' word pattern `[^\x20\x09-\x0D]+`.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the folder. Where the session has larger batches, they are cut to BATCH; tables of one file are spread over the cores."""
    bounded(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def tidy() -> None:
    """Give freed memory of a Python worker back at the end of a task: workers stay, and stand beside the heap of an executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def forget(df: DataFrame) -> None:
    """Delete a table of keep() that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now: it does so when the driver has collected their handles."""
    rounds = 1 if spark.sparkContext.master.startswith("local[") else 3
    for _ in range(rounds):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5 if rounds > 1 else 0)


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null doc_id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (and `more`) alone, so that further columns of any name can't clash."""
    return docs.select("doc_id", "text", *more)


def blocks(batches: Iterable[pa.RecordBatch], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches (with a `text` column) into slices of about `most` bytes of text; a longer text stands alone."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text"))
        sizes = pc.fill_null(pc.binary_length(text), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins (and the last ends). Null texts are empty."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    begins = np.frombuffer(places, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[begins[0] : begins[-1]], begins - begins[0]


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int) -> DataFrame:
    """Training rows (doc_id, text, label): fold != held, label not null, at most `most` rows chosen by hash of doc_id.

    The id list is bounded by `most`, so its broadcast is bounded as well. Of rows that repeat an id the one with the
    least text counts.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    rows = documents(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("r"))
    return rows.select("doc_id", "r.text", "r.label")


def marked(docs: DataFrame, ids: DataFrame, most: int = 2_000_000) -> DataFrame:
    """The rows with `marked`: whether the table `ids` has their doc_id.

    Ids go as bits of 64-bit words, a row for each word, which are broadcast unless they are more than `most`: a join
    that Spark plans by the size of the table of ids would shuffle and sort the texts as soon as that is over its threshold.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("doc_id").bitwiseAND(F.lit(63)).cast("int"))
    words = keep(ids.where("doc_id is not null").groupBy(F.shiftright(F.col("doc_id").cast("bigint"), 6).alias("_word")).agg(F.bit_or(bit).alias("_bits")))
    both = docs.join(small(words, most), F.shiftright(F.col("doc_id").cast("bigint"), 6) == F.col("_word"), "left")
    return both.withColumn("marked", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_bits")


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """The table with a hint to broadcast it if it has at most `most` rows (it is counted), or as it is. `df` is best a table of keep()."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
