"""Keys as dense numbers that stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.folds import running_total
from ..sources.storage import complete


class KeyDictionary:
    """Numbers from 0 on for the keys ever loaded, below ``path``. New keys are numbered in their order behind the old ones:
    each range of keys is counted, and begins with the counts before it. A load is a folder of its own that
    counts when it is whole; one that is run again after a failure numbers the same keys alike."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self) -> DataFrame:
        """(key, id)."""
        loads = [f"{self.path}/{n}" for n in complete(self.spark, self.path)]
        schema = "key string, id bigint"
        return self.spark.read.schema(schema).parquet(*loads) if loads else self.spark.createDataFrame([], schema)

    def intern(self, keys: DataFrame) -> DataFrame:
        """Number the keys (key) that have none; returns (key, id) of all. Null keys get no number."""
        known = self.read()
        first = known.agg(F.max("id")).first()[0]  # one number
        new = keys.where("key is not null").select("key").distinct().join(known, "key", "left_anti")
        numbered = running_total(new, [], ["key"], F.lit(1)).select("key", (F.col("before") + (0 if first is None else first + 1)).cast("bigint").alias("id"))
        numbered.write.mode("overwrite").parquet(f"{self.path}/load{len(complete(self.spark, self.path)) + 1}")
        return self.read()

    def properties(self, rows: DataFrame) -> DataFrame:
        """(entity, key_id, value) of properties (entity, key, value), their keys numbered first; a property without a key or
        value is left out, of repeated ones the greatest value holds."""
        held = rows.where("key is not null and value is not null").groupBy("entity", "key").agg(F.max("value").alias("value"))
        return held.join(self.intern(held.select("key")), "key").select("entity", F.col("id").alias("key_id"), "value")
