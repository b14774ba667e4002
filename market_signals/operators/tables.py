"""Keyed tables that batches change: versioned Parquet in buckets of the key, and insert-only history in Spark's buckets."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from market_signals.operators.state import first_wins

#: What a batch's rows and the stored ones of its buckets become.
Change = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Version:
    """What a reader sees: where the rows of each bucket are, and the last batch that is in."""

    number: int
    by: list[str]
    buckets: int
    schema: str
    batch: int = -1
    folders: dict[str, str] = field(default_factory=dict)


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _files(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n[:-5]) for n in _names(spark, f"{path}/versions") if n.endswith(".json")]


def version(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """A version of the table at `path`, the last one by default; None if there is none yet."""
    there = versions(spark, path)
    if not there:
        return None
    text = spark.read.text(f"{path}/versions/{there[-1] if number is None else number:012d}.json", wholetext=True).first()[0]
    return Version(**json.loads(text))


def publish(spark: SparkSession, path: str, new: Version) -> None:
    """Make a version the one that readers see. Its file is written beside the others and named last."""
    target, fs = _files(spark, f"{path}/versions/{new.number:012d}.json")
    if fs.exists(target):
        raise RuntimeError(f"another writer has made version {new.number} of {path}")
    draft, _ = _files(spark, f"{path}/versions/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(asdict(new)).encode()))
    out.close()
    if not fs.rename(draft, target):
        raise RuntimeError(f"version {new.number} of {path} can't be published")


def read_table(spark: SparkSession, path: str, number: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The rows of a version (the last one by default), of some buckets alone if `only` names them."""
    v = version(spark, path, number)
    if v is None:
        raise FileNotFoundError(path)
    return _rows(spark, path, v, only)


def _rows(spark: SparkSession, path: str, v: Version, only: list[int] | None = None) -> DataFrame:
    paths = [f"{path}/{folder}/_bucket={b}" for b, folder in sorted(v.folders.items()) if only is None or int(b) in only]
    return spark.read.schema(v.schema).parquet(*paths) if paths else spark.createDataFrame([], v.schema)


def bucket(by: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")


def rewrite(batch: DataFrame, path: str, by: list[str], change: Change, buckets: int = 64, number: int | None = None) -> list[int]:
    """Put a batch into the table at `path` (made by its first batch): `change`, given the stored rows of the buckets of
    `by` that the batch touches and the batch, says what is in these buckets from now on. Returns the touched buckets.

    Other buckets' files stay as they are. New files come first, the version that names them last: a reader sees a batch
    as a whole or not at all, and a write that dies leaves files that no version names (see clean). With a batch
    `number`, one that is in already is left out, so that a stream may repeat it. One writer at a time.

    Rows are gathered by bucket while they are written; a bucket over spark.sql.adaptive.advisoryPartitionSizeInBytes
    goes to several tasks and files, so that no task's work grows with the table.
    """
    spark = batch.sparkSession
    last = version(spark, path) or Version(0, by, buckets, ", ".join(f"`{c}` {t}" for c, t in batch.dtypes))
    if number is not None and number <= last.batch:
        return []
    new = batch.withColumn("_bucket", bucket(last.by, last.buckets)).persist()
    hit = sorted(r[0] for r in new.select("_bucket").distinct().collect())
    out = change(_rows(spark, path, last, hit), new.drop("_bucket")).withColumn("_bucket", bucket(last.by, last.buckets))
    folder = f"data/{uuid.uuid4().hex}"
    out.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{path}/{folder}")
    new.unpersist()
    written = {n.split("=")[1] for n in _names(spark, f"{path}/{folder}") if n.startswith("_bucket=")}
    folders = {b: f for b, f in last.folders.items() if int(b) not in hit} | {b: folder for b in written}
    publish(spark, path, Version(last.number + 1, last.by, last.buckets, last.schema, last.batch if number is None else number, folders))
    return hit


def last_wins(key: list[str], order: list[str]) -> Change:
    """The row of each key that is last by `order`, whenever it came. A deletion is a row like others (see live)."""

    def change(stored: DataFrame, batch: DataFrame) -> DataFrame:
        rest = [c for c in batch.columns if c not in key]
        rows = stored.unionByName(batch).groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_v"))
        return rows.select(*key, "_v.*").select(*batch.columns)

    return change


def replaces(key: list[str], order: list[str]) -> Change:
    """Insert or replace: the batch's row of a key, the last by `order` if it has several, takes the stored one's place."""

    def change(stored: DataFrame, batch: DataFrame) -> DataFrame:
        rows = stored.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
        return last_wins(key, ["_new", *order])(rows, rows.limit(0)).drop("_new")

    return change


def live(table: DataFrame, value: str) -> DataFrame:
    """Rows without the deleted ones, whose value is null. These stay stored, so that an older row that comes late doesn't bring its key back."""
    return table.where(F.col(value).isNotNull())


def clean(spark: SparkSession, path: str, keep_versions: int = 2) -> int:
    """Delete the files that none of the last versions names, those of writes that died among them; returns how many folders went. Not while a batch is written."""
    there = versions(spark, path)
    for number in there[:-keep_versions]:
        p, fs = _files(spark, f"{path}/versions/{number:012d}.json")
        fs.delete(p, False)
    used = {f for n in there[-keep_versions:] for f in version(spark, path, n).folders.values()}
    gone = [n for n in _names(spark, f"{path}/data") if f"data/{n}" not in used]
    for n in gone:
        p, fs = _files(spark, f"{path}/data/{n}")
        fs.delete(p, True)
    return len(gone)


def history(spark: SparkSession, name: str, path: str, schema: str, key: str, buckets: int = 64) -> DataFrame:
    """The insert-only table `name` whose Parquet files at `path` are in Spark's own buckets of `key`. It is registered in the catalog if it isn't yet."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def absent(new: DataFrame, stored: DataFrame, key: str, order: str, buckets: int) -> DataFrame:
    """The first row of each key of `new` that isn't in a history of so many buckets.

    Only the new rows are shuffled, into the buckets of the history: its own files, however many, are read bucket by
    bucket where they are.
    """
    first = first_wins(new.repartition(buckets, key), key, order)
    return first.join(stored.select(key).hint("merge"), key, "left_anti")


def insert_absent(new: DataFrame, name: str, key: str, order: str, buckets: int = 64) -> None:
    """Append to a history what it doesn't have yet. A batch that comes again adds nothing."""
    stored = new.sparkSession.table(name)
    absent(new, stored, key, order, buckets).select(*stored.columns).write.insertInto(name)
