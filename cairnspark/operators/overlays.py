"""Overlays of records that refer to sources, evidence and topics: an event's records over those of a snapshot."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Kind:
    """``refs``: columns of references. Of each group in ``needs`` one column must still hold a reference. ``linked``: records that
    come from linking sources must have two in ``source_refs`` (where a kind has that column) and evidence of two."""

    refs: tuple[str, ...]
    needs: tuple[tuple[str, ...], ...]
    linked: bool = True


#: Rules of the record kinds; evidence and entities don't come from linking.
KINDS = {
    "evidence": Kind(("source_refs",), (("source_refs",),), False),
    "relations": Kind(("evidence_refs", "node_refs"), (("evidence_refs",), ("node_refs",))),
    "claims": Kind(("source_refs", "evidence_refs", "topic_refs"), (("source_refs", "evidence_refs"), ("topic_refs",))),
    "memories": Kind(("source_refs", "evidence_refs"), (("source_refs", "evidence_refs"),)),
    "entities": Kind(("source_refs", "evidence_refs"), (("source_refs", "evidence_refs"),), False),
}


def known_refs(rows: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """``rows`` (id, ...) with the references of an array column that ``known`` (ref) holds, each once, sorted."""
    asked = rows.select("id", F.explode(column).alias("ref")).where("ref is not null")
    held = asked.join(known.select("ref"), "ref", "left_semi").groupBy("id").agg(F.sort_array(F.collect_set("ref")).alias(column))
    empty = F.array().cast(rows.schema[column].dataType)
    return rows.drop(column).join(held, "id", "left").withColumn(column, F.coalesce(column, empty))


def overlay(kind: str, current: DataFrame, incoming: DataFrame, known: dict[str, DataFrame], evidence_sources: DataFrame | None = None, linking: bool = False) -> DataFrame:
    """``current`` (id, content, one array for each column of references) after ``incoming`` of the same form.

    References that ``known`` (column -> ref) doesn't hold are taken out of incoming records; both ends of a relation must be
    known; records left without what their kind needs are dropped. The others replace records of their id. When ``linking``, those
    whose evidence has less than two sources (``evidence_sources``: ref, source) are dropped as well, and records that are there already stay.
    Of several incoming records of one id the one with the largest content counts; null ids drop out; records of ``current``
    stay as they are. References travel one by one, so no record is met with all others of its source."""
    rule = KINDS[kind]
    if linking and not rule.linked:
        return current
    best = F.max_by(F.struct(*[c for c in current.columns if c != "id"]), F.struct(F.col("content").isNotNull(), "content", *rule.refs))
    fresh = incoming.where("id is not null").groupBy("id").agg(best.alias("r")).select("id", "r.*")
    ends = F.size(F.array_distinct("node_refs")) if "node_refs" in rule.refs else None
    fresh = fresh.withColumn("_ends", ends) if ends is not None else fresh
    for column in rule.refs:
        fresh = known_refs(fresh, column, known[column])
    for group in rule.needs:
        fresh = fresh.where(reduce(lambda a, b: a | b, [F.size(c) > 0 for c in group]))
    if ends is not None:
        fresh = fresh.where(F.size("node_refs") == F.col("_ends")).drop("_ends")
    if linking:
        if "source_refs" in rule.refs:
            fresh = fresh.where(F.size("source_refs") > 1)
        own = fresh.select("id", F.explode("evidence_refs").alias("ref")).join(evidence_sources.select("ref", "source"), "ref")
        spread = own.groupBy("id").agg(F.min("source").alias("a"), F.max("source").alias("b")).where("a <> b")
        fresh = fresh.join(spread, "id", "left_semi").join(current.select("id"), "id", "left_anti")
        return current.unionByName(fresh)
    return current.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)
