"""Reading a workspace snapshot: search over nine kinds, and packs closed over what hits refer to."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..functions.folds import running_total
from ..sources.storage import materialize
from .answers import search_terms, search_tokens
from .retrieval import top

_NONE = "cast(array() as array<string>)"


def records(kind: str, rows: DataFrame, key: str, title, said, nodes=None, sources=None, evidence=None) -> DataFrame:
    """Uniform records (kind, id, title, said, nodes, sources, evidence) of one kind."""
    refs = lambda c: F.coalesce(c, F.expr(_NONE)) if c is not None else F.expr(_NONE)
    return rows.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), title.alias("title"), said.alias("said"), refs(nodes).alias("nodes"), refs(sources).alias("sources"), refs(evidence).alias("evidence"))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def search(snapshot: DataFrame, queries: DataFrame, limit: int = 24) -> DataFrame:
    """(query_id, rank, kind, id, title, score): records of all kinds by how often their text holds the query's stems.
    ``queries`` (query_id, text) is a stated list."""
    asked = queries.select("query_id", search_terms(F.col("text")).alias("terms")).where(F.size("terms") > 0)
    words = snapshot.select("kind", "id", "title", search_tokens(F.col("said")).alias("words"))
    met = words.join(F.broadcast(asked)).withColumn("score", tx.frequency_score(F.col("words"), F.col("terms"))).where("score > 0")
    return top(met, ["query_id"], [F.desc("score"), F.col("title"), F.col("kind"), F.col("id")], limit).select("query_id", "rank", "kind", "id", "title", "score")


def _grown(found: DataFrame, snapshot: DataFrame, kind: str, by: list[str]) -> DataFrame:
    """``found`` (query_id, kind, id) with the records of a kind that refer to something found, and with what these
    refer to."""
    rows = snapshot.where(F.col("kind") == kind)
    hits = [found.where(F.col("kind") == kind).select("query_id", "id")]
    for other in by:
        refs = rows.select(F.col("id"), F.explode({"node": "nodes", "source": "sources", "evidence": "evidence"}[other]).alias("ref"))
        hits.append(found.where(F.col("kind") == other).select("query_id", F.col("id").alias("ref")).join(refs, "ref").select("query_id", "id"))
    chosen = union(hits).distinct()
    met = chosen.join(rows, "id")
    more = [chosen.select("query_id", F.lit(kind).alias("kind"), "id")]
    more += [met.select("query_id", F.lit(k).alias("kind"), F.explode(c).alias("id")) for k, c in (("node", "nodes"), ("source", "sources"), ("evidence", "evidence"))]
    return materialize(found.unionByName(union(more)).distinct(), f"closure_{kind}")


def selection(snapshot: DataFrame, hits: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """(query_id, kind, id): hits and selected nodes (query_id, id) closed over references in two hops: evidence of their
    sources, nodes and claims that touch these, relations that touch those, and what all of them rest on. Each
    step is one join by reference; nothing is collected."""
    found = hits.select("query_id", "kind", "id")
    if selected is not None:
        own = selected.join(snapshot.where("kind = 'node'").select("id", "sources", "evidence"), "id")
        found = union([found, own.select("query_id", F.lit("node").alias("kind"), "id"), own.select("query_id", F.lit("source").alias("kind"), F.explode("sources").alias("id")), own.select("query_id", F.lit("evidence").alias("kind"), F.explode("evidence").alias("id"))])
    found = materialize(found.distinct(), "selected")
    found = _grown(found, snapshot, "evidence", ["source"])
    found = _grown(found, snapshot, "node", ["source", "evidence"])
    found = _grown(found, snapshot, "claim", ["node", "source", "evidence"])
    found = _grown(found, snapshot, "relation", ["node", "evidence"])
    found = _grown(found, snapshot, "node", [])
    found = _grown(found, snapshot, "wiki_page", ["node", "source", "evidence"])
    return found.join(snapshot.select("kind", "id"), ["kind", "id"], "left_semi").select("query_id", "kind", "id")


def protected(evidence: DataFrame, seeds: DataFrame, following: int = 4, pages: int = 2) -> DataFrame:
    """(query_id, evidence_id): seeds (query_id, evidence_id) and what follows them in their source: the next rows in page
    order, and rows of the same and the next pages. ``evidence``: evidence_id, source_id, page."""
    numbered = running_total(evidence.select("evidence_id", "source_id", "page"), ["source_id"], ["page", "evidence_id"], F.lit(1))
    numbered = materialize(numbered.withColumnRenamed("before", "n"), "numbered_evidence")
    own = seeds.join(numbered, "evidence_id").select("query_id", "source_id", F.col("page").alias("from_page"), F.col("n").alias("from_n"))
    by_place = own.select("query_id", "source_id", F.explode(F.sequence(F.col("from_n"), F.col("from_n") + following)).alias("n")).join(numbered, ["source_id", "n"])
    by_page = own.where("from_page is not null").select("query_id", "source_id", F.explode(F.sequence(F.col("from_page"), F.col("from_page") + pages)).alias("page")).join(numbered, ["source_id", "page"])
    return by_place.select("query_id", "evidence_id").unionByName(by_page.select("query_id", "evidence_id")).distinct()


def pack_warnings(packs: DataFrame) -> DataFrame:
    """(query_id, warnings) of packs (query_id, n_nodes, n_evidence, lowest_confidence, budget)."""
    flags = F.array(
        F.when(F.col("n_nodes") == 0, "no_nodes"), F.when(F.col("n_evidence") == 0, "no_evidence"), F.when(F.coalesce("lowest_confidence", F.lit(1.0)) < 0.6, "low_confidence"), F.when(F.col("budget") < 2000, "small_budget")
    )
    return packs.select("query_id", F.array_compact(flags).alias("warnings"))
