"""Bounded labelled samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._util import materialize


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept out of learning: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(text, y) of about ``most`` labelled rows at most, never of held-out ones.

    Rows are chosen by a hash of their id below a threshold that follows the number of labels; ids
    labelled twice count once (the larger label), null labels not at all; of rows that share an id the
    smallest text counts. The chosen ids are at most a little over ``most`` pairs of numbers, which bounds
    their broadcast and the sample."""
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    n = usable.count()
    if n > most:
        usable = usable.where(F.xxhash64(F.lit("sample"), "doc_id").bitwiseAND(F.lit(2**62 - 1)) < 2**62 * most // n)
    chosen = usable.groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    once = met.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("y").alias("y"))
    return materialize(once.select("text", "y"), "labelled")
