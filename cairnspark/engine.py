"""One object with the engine's commands: reads, packs, history, corrections, checks.

Tables are DataFrames given once; every method returns a DataFrame (or several). Retrieval writes the few
rows of its intermediate steps to the shared folder when it is called; what is returned is lazy."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions import folds, text as tx
from .operators import documents, evals, graph, history, packs, retrieval
from .operators.hybrid import HIDDEN, Corpus, HybridSearch
from .sources import readers, writers
from .streaming import materialise



@dataclass
class KnowledgeEngine:
    """``tables``: sources (source_id, workspace_id, title, status), evidence (evidence_id, source_id,
    workspace_id, evidence_type, text), nodes, edges, events, ... by name."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        return self.tables[name]

    # reads
    def sources(self, workspace: str) -> DataFrame:
        return self.table("sources").where((F.col("workspace_id") == workspace) & ~F.col("status").isin(*HIDDEN)).orderBy("source_id")

    def evidence(self, workspace: str) -> DataFrame:
        """Evidence of visible sources."""
        return self.table("evidence").where(F.col("workspace_id") == workspace).join(self.sources(workspace).select("source_id"), "source_id", "left_semi")

    def read(self, name: str, **equal) -> DataFrame:
        df = self.table(name)
        for column, value in equal.items():
            df = df.where(F.col(column).eqNullSafe(F.lit(value)))
        return df

    def recent_events(self, n: int = 20) -> DataFrame:
        return self.table("events").orderBy(F.desc("created_at"), F.desc("event_id")).limit(n)

    def counts(self) -> DataFrame:
        return readers.table_counts(self.tables)

    # retrieval
    def search(self, workspace: str, query: str, limit: int = 24) -> DataFrame:
        """(rank, evidence_id, source_id, evidence_type, score, text): all terms in the text by BM25
        with boosts for the type and the nodes citing it; if nothing holds all terms, single terms."""
        return self._ranked(workspace, query, limit).drop("source_title")

    def _ranked(self, workspace: str, query: str, limit: int) -> DataFrame:
        rows = self.evidence(workspace)
        asked = retrieval.query_terms(self.spark.createDataFrame([(0, query)], "q int, text string"), "q", "text")
        found = retrieval.bm25(rows, "evidence_id", "text", asked, "q")
        terms = tx.search_terms(F.lit(query))
        loose = rows.where(F.exists(terms, lambda t: F.contains(F.lower("text"), t))).select(F.lit(0).alias("q"), "evidence_id", F.lit(0.0).alias("score"))
        # single terms count only where nothing holds all of them
        hits = found.unionByName(loose.join(found.select("q").limit(1), "q", "left_anti")).join(rows, "evidence_id")
        cited = self._citing(rows)
        scored = hits.join(cited, "evidence_id", "left").withColumn("score", F.col("score") + tx.typed_boost(F.col("evidence_type"), query) + F.least(F.coalesce("citing", F.lit(1)), F.lit(10)) * 0.01)
        titles = self.table("sources").select("source_id", F.col("title").alias("source_title"))
        ranked = retrieval.top(scored, ["q"], [F.desc("score"), F.col("evidence_id")], limit)
        return ranked.join(titles, "source_id", "left").select("rank", "evidence_id", "source_id", "evidence_type", F.round("score", 9).alias("score"), "text", "source_title")

    def _citing(self, rows: DataFrame) -> DataFrame:
        if "nodes" not in self.tables:
            return rows.select("evidence_id", F.lit(None).cast("bigint").alias("citing")).limit(0)
        nodes = self.table("nodes")
        live = nodes.where("valid_to is null") if "valid_to" in nodes.columns else nodes
        return live.select(F.explode("evidence_ids").alias("evidence_id")).groupBy("evidence_id").agg(F.count("*").alias("citing"))

    def hybrid_search(self, corpus: Corpus, queries: DataFrame, limit: int = 24) -> DataFrame:
        """(query_id, rank, evidence_id, source_id, evidence_type, score, stage) for a table of queries."""
        return HybridSearch(corpus, queries, limit).ranked()

    def search_everything(self, corpus: Corpus, queries: DataFrame, limit: int = 24) -> DataFrame:
        """(query_id, rank, kind, id, title, score) over evidence, nodes, relations and wiki pages."""
        return HybridSearch(corpus, queries, limit).everything()

    def context_pack(self, workspace: str, query: str, budget: int = 8000) -> DataFrame:
        """One nested row: ordered evidence with the best window of each text, sources, types, warnings."""
        terms = tx.search_terms(F.lit(query))
        hits = self._ranked(workspace, query, min(max(budget, 1), 24))
        quoted = hits.withColumn("quote", tx.context_window(F.col("text"), terms)).withColumn("workspace_id", F.lit(workspace))
        pack = packs.nested(quoted, "workspace_id")
        used = F.aggregate("evidence", F.lit(0), lambda a, e: a + F.length(e["quote"]))
        return pack.withColumn("warnings", packs.warnings(F.size("evidence"), F.size("sources"), used, F.lit(budget * 4)))

    def chunks(self, docs: DataFrame, source: Column, text: Column) -> DataFrame:
        return folds.chunk_markdown(docs, source, text)

    # graph
    def neighbours(self, node_ids: list[str]) -> DataFrame:
        seeds = self.spark.createDataFrame([(n,) for n in node_ids], "node string")
        return graph.neighbours(seeds, self.table("edges"))

    def trail(self, evidence_ids: list[str]) -> DataFrame:
        chosen = self.spark.createDataFrame([(e,) for e in evidence_ids], "evidence_id string")
        edges = self.table("edges")
        index = graph.evidence_index({"node": self.table("nodes").select(F.col("node_id").alias("id"), "evidence_ids"), "relation": edges.select(F.col("edge_id").alias("id"), "evidence_ids")})
        return graph.trail(chosen, index, edges)

    def correct(self, kind: str, **how) -> KnowledgeEngine:
        """A new engine with the correction applied: rename, merge, keep_separate, split or delete."""
        nodes, edges = self.table("nodes"), self.table("edges")
        if kind == "rename":
            nodes, edges = graph.rename_node(nodes, edges, how["node_id"], how["label"])
        elif kind == "merge":
            nodes, edges = graph.merge_nodes(nodes, edges, how["source"], how["target"])
        elif kind == "keep_separate":
            nodes = graph.keep_separate(nodes, how["node_id"])
        elif kind == "split":
            nodes = graph.split_node(nodes, how["node_id"], how["parts"])
        elif kind == "delete":
            nodes, edges = graph.delete_nodes(nodes, edges, self.spark.createDataFrame([(n,) for n in how["node_ids"]], "node_id string"))
        else:
            raise ValueError(f"unknown correction {kind!r}")
        return KnowledgeEngine(self.spark, self.tables | {"nodes": nodes, "edges": edges})

    def lint(self) -> DataFrame:
        """(kind, id, missing): edges without an end, nodes nothing refers to."""
        edges, nodes = self.table("edges"), self.table("nodes").select(F.col("node_id").alias("node"), "evidence_ids")
        loose = graph.dangling(edges, nodes).select(F.lit("orphan_edge").alias("kind"), F.col("edge_id").alias("id"), "missing")
        held = nodes.where(F.size("evidence_ids") > 0).select("node")
        alone = graph.orphans(nodes.select("node"), edges, held).select(F.lit("orphan_node").alias("kind"), F.col("node").alias("id"), F.lit(None).cast("string").alias("missing"))
        return loose.unionByName(alone)

    # history and writes
    def as_of(self, name: str, at: Column) -> DataFrame:
        return history.as_of(self.table(name), at)

    def apply_snapshot(self, name: str, incoming: DataFrame, key: list[str], content: list[str], at: Column, by: Column) -> KnowledgeEngine:
        late = history.not_monotonic(self.table(name), incoming.withColumn("valid_from", at), key)
        if late.limit(1).count():
            raise ValueError(f"{name}: a live version is as new as the incoming one")
        return KnowledgeEngine(self.spark, self.tables | {name: history.merge(self.table(name), incoming, key, content, at, by)})

    def delete_source(self, source_id: str) -> KnowledgeEngine:
        held = {n: df for n, df in self.tables.items() if "source_id" in df.columns}
        return KnowledgeEngine(self.spark, self.tables | writers.deleted(held, source_id))

    def follow_events(self, source: DataFrame, key: list[str], order: list[str], path: str, checkpoint: str):
        return materialise.follow(source, key, order, path, checkpoint, once=False)

    # patches and evaluation
    def check_patch(self, operations: DataFrame, known: DataFrame) -> DataFrame:
        return documents.patch_violations(operations, known)

    def compare_runs(self, runs: DataFrame, ours: str, direct: str) -> DataFrame:
        return evals.outcomes(runs, ours, direct)
