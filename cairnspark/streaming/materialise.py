"""Streaming: an append-only log kept as the latest row of each key, and windowed counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..sources.storage import complete, shared_dir


def _newest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


class LatestTable:
    """The newest row of every key, in ``BUCKETS`` buckets of keys. A micro-batch writes the buckets it
    touches into a folder of its own, then a manifest that tells for each bucket which batch wrote it
    last. The newest whole manifest is the state, so that a restart goes on from it, and a batch that is
    run again after a failure gives the same state again."""

    BUCKETS = 64

    def __init__(self, spark: SparkSession, path: str, schema, key: list[str], order: list[str]):
        self.spark, self.path, self.schema, self.key, self.order = spark, path, schema, key, order

    @property
    def version(self) -> int:
        return max((int(n[1:]) for n in complete(self.spark, f"{self.path}/manifest")), default=-1)

    def _written(self, version: int) -> dict[int, int]:
        """Bucket -> batch that wrote it last, of ``BUCKETS`` buckets at most."""
        if version < 0:
            return {}
        return {r["bucket"]: r["batch"] for r in self.spark.read.schema("bucket int, batch bigint").parquet(f"{self.path}/manifest/v{version}").collect()}

    def _read(self, written: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/rows/v{batch}/bucket={bucket}" for bucket, batch in sorted(written.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(self._written(self.version))

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        version = self.version
        if batch_id <= version:
            return
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.BUCKETS)).cast("int")
        fresh = _newest(batch, self.key, self.order)  # combined before it meets the table
        written = self._written(version)
        touched = {r["bucket"] for r in fresh.select(bucket.alias("bucket")).distinct().collect()}
        old = self._read({b: v for b, v in written.items() if b in touched})
        rows = _newest(old.unionByName(fresh), self.key, self.order).withColumn("bucket", bucket)
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/v{batch_id}")
        now = [*(written | dict.fromkeys(touched, batch_id)).items()]
        self.spark.createDataFrame(now, "bucket int, batch bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v{batch_id}")


def follow(source: DataFrame, key: list[str], order: list[str], path: str, checkpoint: str, once: bool = True, every: str = "1 second"):
    """Start the query that keeps ``LatestTable`` at ``path``; returns (query, table)."""
    kept = LatestTable(source.sparkSession, path, source.schema, key, order)
    writer = source.writeStream.foreachBatch(kept.merge).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start(), kept


def run_once(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The rule over a table, by way of a stream: the rows are written as an append-only log, read
    as a stream and merged batch by batch."""
    spark = rows.sparkSession
    base = f"{shared_dir(spark)}/cairn/{uuid.uuid4().hex}"
    rows.write.parquet(f"{base}/log")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{base}/log")
    running, kept = follow(source, key, order, f"{base}/state", f"{base}/offsets")
    running.awaitTermination()
    return kept.read()


def windowed_counts(source: DataFrame, time: str, key: str, size: str, late: str) -> DataFrame:
    """Counts and sums of ``value`` in tumbling windows; events later than ``late`` are dropped."""
    return source.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_windowed(rows: DataFrame, time: str, key: str, size: str, late: str = "365 days") -> DataFrame:
    """(start, key, n, total) of tumbling windows, by way of a stream: updates of a window replace
    what the table held for it."""
    spark = rows.sparkSession
    base = f"{shared_dir(spark)}/cairn/{uuid.uuid4().hex}"
    rows.select(F.col(time).cast("timestamp").alias(time), key, "value").write.parquet(f"{base}/log")
    source = spark.readStream.schema(f"{time} timestamp, {key} string, value double").option("maxFilesPerTrigger", 2).parquet(f"{base}/log")
    flat = windowed_counts(source, time, key, size, late).select(F.col("window.start").alias("start"), key, "n", "total")
    kept = LatestTable(spark, f"{base}/state", flat.schema, ["start", key], ["n"])
    running = flat.writeStream.outputMode("update").foreachBatch(kept.merge).option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).start()
    running.awaitTermination()
    return kept.read()
