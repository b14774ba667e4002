"""Makes the package importable on executors, and keeps results in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch between Spark and Python: the tasks' batches, with their copies, stand beside the heap of an executor.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20)

_SENT: set[str] = set()
#: Folders of keep(), by application.
_KEPT: dict[str, list[str]] = {}


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once for each application, unless PYTHONPATH gives it to them already."""
    home = Path(__file__).resolve().parent
    given = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    app = spark.sparkContext.applicationId
    if app in _SENT or str(home.parent) in given:
        return
    out = os.path.join(tempfile.mkdtemp(prefix="spark-"), "market_signals.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    spark.sparkContext.addPyFile(out)
    _SENT.add(app)


def shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where it is unset, as in tests."""
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there


def bounded(spark: SparkSession) -> None:
    """Cut the batches between Spark and Python to BATCH where the session has larger ones (or unbounded ones)."""
    if not 0 < int(spark.conf.get(BATCH[0]).rstrip("b")) <= int(BATCH[1]):
        spark.conf.set(*BATCH)


def spread(df: DataFrame) -> DataFrame:
    """A table of one file in as many partitions as there are cores: one file has few row groups, which alone make tasks. Larger tables stay as they are."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if len(df.inputFiles()) == 1 else df


def keep(df: DataFrame) -> DataFrame:
    """Write a result that several branches of a plan read as Parquet into the shared folder, and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    _KEPT.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession) -> int:
    """How many tables keep() has written in this application and sweep() has not deleted yet."""
    return len(_KEPT.get(spark.sparkContext.applicationId, []))


def sweep(spark: SparkSession, after: int = 0, but: DataFrame | None = None) -> int:
    """Delete the tables that keep() has written in this application: what reads them must be done with. Returns how many went.

    Results are lazy, so only their user knows when: call it between jobs, once a result is written. The first `after`
    tables stay (see kept), as does the one that `but` reads.
    """
    paths = _KEPT.get(spark.sparkContext.applicationId, [])
    names = {f.rsplit("/", 2)[-2] for f in but.inputFiles()} if but is not None else set()
    gone = [p for p in paths[after:] if p.rsplit("/", 1)[-1] not in names]
    for p in gone:
        folder = spark._jvm.org.apache.hadoop.fs.Path(p)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    _KEPT[spark.sparkContext.applicationId] = [p for p in paths if p not in gone]
    return len(gone)
