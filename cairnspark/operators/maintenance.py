"""Repair of page collections: pages that are named but missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.storage import materialize


def repair(pages: DataFrame, records: DataFrame) -> DataFrame:
    """Stubs (path, title, refs, named_by, round) of the pages that ``pages`` (path, refs) name but don't hold.

    A stub takes title and references from the record (path, title, refs) of its path, if there is one (the smallest, if there are
    several), else the last part of its path and none. Its references may name further missing pages, so rounds go on until one
    finds nothing; each reads only the stubs of the round before. ``named_by`` is the smallest page or stub that named it first.
    Null paths and references name nothing; pages that name themselves or each other end like any others; pages united
    with their stubs need no repair."""
    known = pages.select("path").where("path is not null").distinct()
    told = materialize(records.where("path is not null").groupBy("path").agg(F.min(F.struct("title", "refs")).alias("told")).select("path", "told.title", F.col("told.refs").alias("refs")), "records")
    front, found, number = pages.select("path", "refs"), None, 0
    while True:
        number += 1
        asked = front.select(F.col("path").alias("by"), F.explode("refs").alias("path")).where("path is not null").groupBy("path").agg(F.min("by").alias("named_by"))
        new = asked.join(known, "path", "left_anti").join(told, "path", "left")
        refs = F.coalesce("refs", F.array().cast("array<string>"))
        front = materialize(new.select("path", F.coalesce("title", F.substring_index("path", "/", -1)).alias("title"), refs.alias("refs"), "named_by", F.lit(number).alias("round")), "stubs")
        if found is not None and front.isEmpty():
            return found
        found = front if found is None else found.union(front)
        known = known.union(front.select("path"))
