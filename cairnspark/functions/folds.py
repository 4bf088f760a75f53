"""Sequential rules: chunking under heading and size limits, greedy batches, budgets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..sources.storage import materialize

MOST_LINES, MOST_BYTES = 80, 6000
CHUNKS = "source_id string, chunk_no int, chunk_id string, heading_path array<string>, line_start int, line_end int, text string"


def fnv1a64(data: bytes) -> str:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def split_markdown(source_id: str, text: str | None) -> Iterator[tuple]:
    """Chunks of one text: headings close a chunk and set the path, as do 80 lines or 6000 bytes."""
    path: list[str] = []
    held: list[str] = []
    size, start, number = 0, 1, 0

    def close(end: int) -> Iterator[tuple]:
        nonlocal held, size, number
        said = "\n".join(held).strip()
        if said:
            yield source_id, number, f"chunk-{source_id}-{number:04d}-{fnv1a64(said.encode())}", [*path], start, end, said
            number += 1
        held, size = [], 0

    lines = (text or "").splitlines()
    for i, line in enumerate(lines, 1):
        mark = len(line.strip()) - len(line.strip().lstrip("#"))
        title = line.strip()[mark:].strip()
        if 1 <= mark <= 6 and title:
            yield from close(i - 1)
            start = i
            path = [*path[: mark - 1], title]
        held.append(line)
        size += len(line.encode())
        if len(held) >= MOST_LINES or size >= MOST_BYTES:
            yield from close(i)
            start = i + 1
    yield from close(len(lines))


def chunk_markdown(docs: DataFrame, source: Column, text: Column) -> DataFrame:
    """One row for each chunk of each text; a text is folded in one pass within its row's batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["source_id", "chunk_no", "chunk_id", "heading_path", "line_start", "line_end", "text"]
        for frame in frames:
            yield pd.DataFrame([c for s, t in zip(frame["s"], frame["t"], strict=True) for c in split_markdown(s, t)], columns=names)

    return docs.select(source.cast("string").alias("s"), text.alias("t")).mapInPandas(run, CHUNKS)


def batch_plan(chunks: DataFrame, group: str, order: str, size: str, most_chunks: int = 40, most_chars: int = 80_000, most_batches: int = 8) -> DataFrame:
    """(group, batch, n_chunks, n_chars, skipped) of the greedy plan; later batches are counted as skipped.
    Rows of a group come sorted in Arrow batches through one fold that holds the open batch alone."""
    kind = chunks.schema[group].dataType.simpleString()
    names = [group, "batch", "n_chunks", "n_chars", "skipped"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, batch, n, chars = None, -1, 0, 0

        def closed() -> list[tuple]:
            return [(key, batch, n, chars, batch >= most_batches)] if n else []

        for frame in frames:
            out = []
            for k, more in zip(frame["g"], frame["n"].tolist(), strict=True):
                if k != key or n >= most_chunks or chars and chars + more > most_chars:
                    out += closed()
                    key, batch, n, chars = k, 0 if k != key else batch + 1, 0, 0
                n, chars = n + 1, chars + more
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(closed(), columns=names)

    ordered = chunks.select(F.col(group).alias("g"), F.col(order).alias("o"), F.coalesce(size, F.lit(0)).cast("bigint").alias("n")).where("g is not null")
    ordered = ordered.repartition("g").sortWithinPartitions("g", "o")
    return ordered.mapInPandas(run, f"{group} {kind}, batch int, n_chunks bigint, n_chars bigint, skipped boolean")


def running_total(rows: DataFrame, group: list[str], order: list[str], size: Column) -> DataFrame:
    """``rows`` with ``before``: the sum of ``size`` over the rows of their group that come earlier. A
    group may be of any size: rows are dealt by ranges of (group, order), summed within each range, and
    each range begins with the sums of those before it."""
    sized = rows.withColumn("_size", F.coalesce(size, F.lit(0)))
    placed = materialize(sized.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*group, "_part").agg(F.sum("_size").alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).withColumnsRenamed({g: f"_{g}" for g in group}).withColumnRenamed("_part", "_range").drop("_sum")
    within = placed.withColumn("_within", F.coalesce(F.sum("_size").over(own), F.lit(0)))
    on = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group] + [F.col("_part") == F.col("_range")]
    return within.join(starts, on).select(*rows.columns, (F.col("_start") + F.col("_within")).alias("before"))


def spend_budget(rows: DataFrame, partition: list[str], order: list[str], size: Column, budget: int) -> DataFrame:
    """Rows with ``kept``: how much of each still fits when rows are taken in order."""
    left = F.greatest(F.lit(budget) - F.col("before"), F.lit(0))
    return running_total(rows, partition, order, size).withColumn("kept", F.least(size, left).cast("bigint")).drop("before")


def stable_id(*parts: str) -> str:
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:32]
