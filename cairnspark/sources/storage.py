"""Tables: reading by folder and name, and intermediate tables in the folder that a cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none and all runs in one process (local tests) a temporary folder is set
    up; on a cluster a folder of one machine would be seen by no other, so that is an error.
    """
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if not known and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not known:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cairn_ckpt_"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and
    leaves a copy that no lost executor can take along."""
    path = f"{shared_dir(df.sparkSession)}/cairn/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: About so many rows go to one task where their number is known.
TASK_ROWS = 100_000


@contextmanager
def dealt_for(spark: SparkSession, n_rows: int):
    """Plans written within are dealt to a partition for each ``TASK_ROWS`` rows at least, so that the memory of a task doesn't
    grow with the table; a larger number that the session has is kept."""
    name = "spark.sql.shuffle.partitions"
    own = spark.conf.get(name)
    spark.conf.set(name, str(max(int(own), -(-n_rows // TASK_ROWS))))
    try:
        yield
    finally:
        spark.conf.set(name, own)


def complete(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path`` whose write has ended."""
    at = lambda *parts: spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at(path)):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at(path))]
    return [n for n in names if files.exists(at(path, n, "_SUCCESS"))]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished stages now: it does so for plans that the
    driver's garbage collection has found dead, which otherwise may be long in coming."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
