"""Writers: replace by key or partition, append, prune; every one leaves whole files or none."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .storage import materialize


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Overwrite just the partitions that ``rows`` has (the chunks of a source, say)."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append_events(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def upserted(old: DataFrame, new: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """Old rows without those whose key comes in ``new``, and the last new row of each key."""
    if order:
        w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
        new = new.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new.select(*old.columns))


def pruned(old: DataFrame, keep: DataFrame, key: list[str]) -> DataFrame:
    return old.join(keep.select(*key).distinct(), key, "left_semi")


def deleted(tables: dict[str, DataFrame], source_id: str) -> dict[str, DataFrame]:
    """All tables without the rows of a source; rows of no source stay."""
    return {name: df.where(~F.col("source_id").eqNullSafe(F.lit(source_id))) for name, df in tables.items()}


def rewrite(rows: DataFrame, path: str) -> None:
    """Overwrite a table from a plan that may read it: the result is written aside first."""
    materialize(rows, "rewrite").write.mode("overwrite").parquet(path)


def unknown_references(records: DataFrame, refs: str, evidence: DataFrame) -> DataFrame:
    """(id, missing) of references to evidence that doesn't exist; must be empty before a write."""
    return records.select("id", F.explode(refs).alias("missing")).join(evidence.select(F.col("evidence_id").alias("missing")), "missing", "left_anti").select("id", "missing").distinct()


def diff_summary(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(added, removed, changed) between two states of a collection, as one row."""
    mark = lambda df, c: df.select(*key, F.xxhash64(*[x for x in df.columns if x not in key]).alias(c))
    both = mark(old, "a").join(mark(new, "b"), key, "full_outer")
    return both.agg(F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("b").isNull()).alias("removed"), F.count_if(F.col("a") != F.col("b")).alias("changed"))
