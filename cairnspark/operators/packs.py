"""Context packs: capped evidence and facts, nested rows, citations, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.folds import running_total
from .retrieval import top

SMALL_BUDGET, SMALL_CAPS, LARGE_CAPS = 4000, (8, 5), (15, 12)


def caps(budget: int) -> tuple[int, int]:
    """(evidence, facts) a pack of this token budget may hold."""
    return SMALL_CAPS if budget <= SMALL_BUDGET else LARGE_CAPS


def kept_evidence(rows: DataFrame, group: str, score: Column, selected: Column, budget: int) -> DataFrame:
    """The best evidence of each group; selected evidence is protected by a bias."""
    scored = rows.withColumn("score", score + F.when(selected, 10_000).otherwise(0))
    return top(scored, [group], [F.desc("score"), F.col("evidence_id")], caps(budget)[0])


def kept_facts(claims: DataFrame, relations: DataFrame, evidence: DataFrame, group: str, budget: int) -> DataFrame:
    """Claims, then relations in what is left, that share evidence with the kept set: 100 for each
    shared evidence, relations 4 more (1 if their kind says little)."""
    most = caps(budget)[1]
    ids = evidence.select(group, "evidence_id")

    def shared(df: DataFrame, stage: int, extra: Column) -> DataFrame:
        hit = df.withColumn("evidence_id", F.explode("evidence_ids")).join(ids, [group, "evidence_id"])
        return hit.groupBy(group, "record_id", *([] if stage == 0 else ["kind"])).agg((F.count("*") * 100).alias("score")).select(group, F.lit(stage).alias("stage"), "record_id", (F.col("score") + extra).alias("score"))

    little = F.when(F.col("kind").isin("related_to", "source_of"), 1).otherwise(4) if "kind" in relations.columns else F.lit(4)
    both = shared(claims, 0, F.lit(0)).unionByName(shared(relations, 1, little))
    return top(both, [group], [F.col("stage"), F.desc("score"), F.col("record_id")], most)


def warnings(n_evidence: Column, n_sources: Column, used: Column, budget: Column) -> Column:
    flags = F.array(F.when(n_evidence == 0, "no_evidence"), F.when(n_sources == 1, "single_source"), F.when(used > budget, "over_budget"))
    return F.array_compact(flags)


def nested(evidence: DataFrame, group: str) -> DataFrame:
    """One row of a pack for each group: ordered evidence, its distinct sources, counts by type.
    The kept evidence is capped, so no list grows with the data."""
    item = F.struct("rank", "evidence_id", "source_id", "evidence_type", "quote")
    return evidence.groupBy(group).agg(
        F.array_sort(F.collect_list(item)).alias("evidence"),
        F.array_sort(F.collect_set("source_id")).alias("sources"),
        F.map_from_entries(F.array_sort(F.array_distinct(F.collect_list(F.struct("evidence_type", F.lit(1)))))).alias("types"),
    )


def citations(rows: DataFrame, group: str, order: list[Column], most: int = 4) -> DataFrame:
    """The first distinct sources in candidate order."""
    w = top(rows, [group, "source_id"], order, 1, "_first")
    return top(w, [group], order, most).drop("_first")


def answer_status(n_citations: Column, n_candidates: Column) -> Column:
    return F.when(n_citations > 0, "grounded").when(n_candidates > 0, "low_confidence").otherwise("blocked")


def markdown(pages: DataFrame, source: str, page: str, text: str, most_chars: int = 1 << 24) -> DataFrame:
    """(source, part, markdown): the pages of a source with page marks, in order. A page goes to the next part
    when those before it hold ``most_chars``, so that a source of any size is never one row; the parts
    joined by blank lines are its text."""
    mark = F.concat(F.lit("## Page "), (F.col("p") + 1).cast("string"), F.lit("\n\n"), F.col("t"))
    rows = pages.select(source, F.col(page).alias("p"), F.trim(text).alias("t"))
    sizes = running_total(rows.select(source, "p", F.length("t").alias("size")), [source], ["p"], F.col("size"))
    parts = sizes.select(F.col(source).alias("of_source"), F.col("p").alias("of_page"), F.floor(F.col("before") / most_chars).cast("int").alias("part")).distinct()
    placed = rows.join(parts, rows[source].eqNullSafe(F.col("of_source")) & (rows["p"] == F.col("of_page")))
    held = placed.select(source, "part", "p", mark.alias("said")).groupBy(source, "part")
    return held.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "said"))), lambda x: x["said"]), "\n\n").alias("markdown"))
