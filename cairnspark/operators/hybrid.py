"""Hybrid search in stages: evidence, pages, source metadata, graph neighbours, wiki pages, substrings.

All tables of queries at once; every stage keeps a bounded number of rows for each query, so that what
the stages hand on is small however large the corpus is. A stage sees the hits of the ones before."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..sources.storage import materialize
from . import retrieval as rt
from .graph import both_ways

#: Sources in these states are never searched.
HIDDEN = ("failed", "stale", "hash_mismatched", "unapproved")
#: Of so many sources the queries of single stages look up the metadata, as the reference does.
NEWEST_SOURCES = 200


@dataclass
class Corpus:
    """What is searched. ``sources``: source_id, title, updated_at, status; ``evidence``: evidence_id,
    source_id, evidence_type, text, page, active; ``pages``: source_id, page, text; ``nodes``: node_id,
    label, aliases, source_ids, evidence_ids, live; ``edges``: edge_id, src, dst, kind, label,
    evidence_ids, live; ``wiki``: page_id, path, title, text, evidence_refs, live."""

    sources: DataFrame
    evidence: DataFrame
    pages: DataFrame
    nodes: DataFrame
    edges: DataFrame
    wiki: DataFrame

    def visible(self) -> DataFrame:
        """Active evidence of sources that may be searched, with the number of live nodes citing it."""
        allowed = self.sources.where(~F.col("status").isin(*HIDDEN)).select("source_id")
        cited = self.nodes.where("live").select(F.explode("evidence_ids").alias("evidence_id")).groupBy("evidence_id").agg(F.count("*").alias("citing"))
        return self.evidence.where("active").join(allowed, "source_id", "left_semi").join(cited, "evidence_id", "left")


def _boosts(query: Column, kind: Column) -> Column:
    return tx.typed_boost(kind, query) + F.least(F.coalesce("citing", F.lit(1)), F.lit(10)) * 0.01


def _accepted(rows: DataFrame, order: list[Column], room: Column) -> DataFrame:
    """Rows of a stage in their order, up to and without the first new one for which there is no room.
    ``new``: the evidence isn't a hit yet."""
    before = Window.partitionBy("query_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.withColumn("news", F.coalesce(F.sum(F.col("new").cast("int")).over(before), F.lit(0)))
    return counted.where(F.when(F.col("new"), F.col("news") < room).otherwise(F.col("news") <= room))


_HIT = ["query_id", "evidence_id", "source_id", "evidence_type", "stage", "at", "delta", "held", "new"]


class HybridSearch:
    """``queries``: query_id, text. Every method gives (query_id, evidence_id, source_id, evidence_type,
    stage, at, delta, held, new): what a stage adds to the score of an evidence; ``held`` is the
    length of the passage held for it."""

    def __init__(self, corpus: Corpus, queries: DataFrame, limit: int, newest: int | None = None):
        """``newest``: only so many sources, those updated last, are looked up by their metadata."""
        self.corpus, self.limit, self.wide, self.newest = corpus, limit, 3 * limit, newest
        self.queries = queries.select("query_id", F.col("text").alias("query"), tx.search_terms(F.col("text")).alias("terms"))
        self.terms = self.queries.select("query_id", F.explode("terms").alias("term"))
        self.visible = corpus.visible()

    def _ranked(self, rows: DataFrame, order: list[Column]) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(*order)
        return rows.withColumn("at", F.row_number().over(w))

    def _mark(self, rows: DataFrame, hits: DataFrame) -> DataFrame:
        """``new`` and the length held of rows against the hits so far, and how many hits there are."""
        known = hits.groupBy("query_id", "evidence_id").agg(F.max("held").alias("known_held"))
        count = known.groupBy("query_id").agg(F.count("*").alias("n_hits"))
        return rows.join(known, ["query_id", "evidence_id"], "left").join(count, "query_id", "left").withColumns({"new": F.col("known_held").isNull(), "n_hits": F.coalesce("n_hits", F.lit(0))})

    def evidence_hits(self) -> DataFrame:
        found = rt.bm25(self.visible, "evidence_id", "text", self.terms, "query_id")
        best = rt.top(found, ["query_id"], [F.desc("score"), F.col("evidence_id")], self.limit, "at")
        rows = best.join(self.visible, "evidence_id").join(self.queries, "query_id")
        delta = F.col("score") + _boosts(F.col("query"), F.col("evidence_type"))
        return rows.withColumns({"stage": F.lit(1), "delta": delta, "held": F.length("text"), "new": F.lit(True)}).select(*_HIT)

    def page_hits(self, hits: DataFrame) -> DataFrame:
        key = F.concat_ws("\x1f", "source_id", "page")
        pages = self.corpus.pages.withColumn("page_key", key)
        found = rt.bm25(pages, "page_key", "text", self.terms, "query_id")
        cited = self.visible.drop("text").where("page is not null").withColumn("page_key", key)
        best = rt.top(found.join(cited, "page_key"), ["query_id"], [F.desc("score"), F.col("evidence_id")], self.wide, "at")
        rows = best.join(pages.select("page_key", "text"), "page_key").join(self.queries, "query_id")
        # few rows with much work each, which would be taken for one partition
        rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)
        rows = self._mark(rows.withColumn("held", F.length(tx.context_window(F.col("text"), F.col("terms")))), hits)
        rows = _accepted(rows, [F.col("at")], F.lit(self.wide) - F.col("n_hits"))
        longer = F.when(F.col("known_held") < F.col("held"), 0.08).otherwise(0.0)
        delta = F.when(F.col("new"), F.col("score") + 0.03 + _boosts(F.col("query"), F.col("evidence_type"))).otherwise(longer)
        return rows.withColumns({"stage": F.lit(2), "delta": delta}).select(*_HIT)

    def metadata_hits(self, hits: DataFrame) -> DataFrame:
        allowed = self.corpus.sources.where(~F.col("status").isin(*HIDDEN))
        if self.newest is not None:
            allowed = allowed.orderBy(F.desc("updated_at"), "source_id").limit(self.newest)
        said = F.concat_ws(" ", "source_id", "title")
        specific = F.filter("terms", lambda t: ~t.isin(*tx.GENERIC))
        kind = F.when(F.col("evidence_type") == "summary_evidence", 0).when(F.col("evidence_type") == "text_evidence", 1).otherwise(2)
        order = [F.when(F.col("page").isNull(), 1).otherwise(0), F.col("page"), kind, F.col("evidence_id")]
        first = rt.top(self.corpus.evidence.where("active").select("evidence_id", "source_id", "evidence_type", "page"), ["source_id"], order, min(self.wide, 4), "of_source")
        first = materialize(first, "first_of_source")
        # a stated list of queries against all sources that have evidence
        named = allowed.join(first.select("source_id").distinct(), "source_id", "left_semi").join(F.broadcast(self.queries)).where(tx.matched(said, specific) > 0)
        # what is taken ends with the ``wide``-th new one, and no more than the hits so far aren't new
        named = rt.top(named, ["query_id"], [F.desc("updated_at"), F.col("source_id")], 2 * self.wide + self.limit, "of_query").drop("of_query")
        named = named.withColumn("boost", F.lit(0.75) + tx.metadata_score(said, F.col("terms")) / 100 * 0.35)
        cited = self.visible.select("evidence_id", "citing")
        rows = named.join(first, "source_id").join(cited, "evidence_id", "left")
        rows = self._ranked(self._mark(rows, hits), [F.desc("updated_at"), F.col("source_id"), F.col("of_source")])
        rows = _accepted(rows, [F.col("at")], F.lit(self.wide)).where(F.col("new") | (F.col("news") < self.wide))
        fresh = F.col("boost") + _boosts(F.col("query"), F.col("evidence_type")) + F.when(F.col("page").isNotNull(), 0.08).otherwise(0.0)
        return rows.withColumns({"stage": F.lit(3), "delta": F.when(F.col("new"), fresh).otherwise(F.col("boost")), "held": F.lit(0)}).select(*_HIT)

    def first_evidence(self) -> DataFrame:
        """(node, evidence_id): of each live node the first ``wide`` visible evidence by id. A query takes up to ``wide`` less its
        hits of those that aren't hits yet, so later ones of a node are never reached."""
        own = self.corpus.nodes.where("live").select(F.col("node_id").alias("node"), F.explode("evidence_ids").alias("evidence_id")).distinct()
        seen = self.visible.select("evidence_id").distinct()
        return rt.top(own.join(seen, "evidence_id"), ["node"], [F.col("evidence_id")], self.wide, "of_node").select("node", "evidence_id")

    def neighbour_hits(self, hits: DataFrame) -> DataFrame:
        seeds = hits.select("query_id", "evidence_id").distinct()
        live = self.corpus.nodes.where("live")
        edges = self.corpus.edges.where("live")
        of_node = live.select("node_id", F.explode("evidence_ids").alias("evidence_id"))
        seed_nodes = seeds.join(of_node, "evidence_id").select("query_id", F.col("node_id").alias("node")).distinct()
        lines = both_ways(edges.select("src", "dst", "evidence_ids"))
        near = seed_nodes.join(lines, "node").join(live.select(F.col("node_id").alias("other")), "other")
        # relations that rest on a seed give what their ends rest on, if both live
        ends = edges.select(F.explode("evidence_ids").alias("evidence_id"), "src", "dst").join(seeds, "evidence_id").select("query_id", "src", "dst").distinct()
        one = lambda c: live.select(F.col("node_id").alias(c))
        both = ends.join(one("src"), "src").join(one("dst"), "dst").select("query_id", F.explode(F.array("src", "dst")).alias("node"))
        reached = near.select("query_id", F.col("other").alias("node")).unionByName(both).distinct()
        # ids of nodes meet, then the bounded lists of these
        rested = reached.join(materialize(self.first_evidence(), "first_evidence"), "node").select("query_id", "evidence_id")
        found = near.select("query_id", F.explode("evidence_ids").alias("evidence_id"))
        rows = found.unionByName(rested).distinct().join(self.visible.drop("text"), "evidence_id").join(self.queries, "query_id")
        rows = self._ranked(self._mark(rows, hits).where("new"), [F.col("evidence_id")]).where(F.col("at") <= F.lit(self.wide) - F.col("n_hits"))
        return rows.withColumns({"stage": F.lit(4), "delta": F.lit(0.04) + _boosts(F.col("query"), F.col("evidence_type")), "held": F.lit(0)}).select(*_HIT)

    def wiki_hits(self, hits: DataFrame) -> DataFrame:
        live = self.corpus.wiki.where("live").withColumn("said", F.concat_ws("\n", "title", "text"))
        best = rt.top(rt.bm25(live, "page_id", "said", self.terms, "query_id"), ["query_id"], [F.desc("score"), F.col("page_id")], self.limit, "by_score")
        rows = best.join(live.select("page_id", F.get("evidence_refs", F.lit(0)).alias("evidence_id")), "page_id").where("evidence_id is not null").join(self.queries, "query_id")
        rows = rows.join(self.visible.select("evidence_id", "citing"), "evidence_id", "left")
        rows = rt.top(self._mark(rows, hits).where("new"), ["query_id", "evidence_id"], [F.col("by_score")], 1, "once")
        rows = self._ranked(rows, [F.col("by_score")]).where(F.col("at") <= F.lit(self.limit) - F.col("n_hits"))
        delta = F.col("score") + 0.02 + _boosts(F.col("query"), F.lit("wiki_evidence"))
        return rows.withColumns({"source_id": F.col("page_id"), "evidence_type": F.lit("wiki_evidence"), "stage": F.lit(5), "delta": delta, "held": F.lit(0)}).select(*_HIT)

    def substring_hits(self, hits: DataFrame) -> DataFrame:
        """For queries without any hit: evidence that contains a term, by term and id."""
        empty = self.queries.join(hits.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "query", F.posexplode("terms").alias("n", "term"))
        low = self.visible.withColumn("low", F.lower("text"))
        held = low.join(F.broadcast(empty), F.contains("low", "term"))  # a stated list of terms against all texts
        first = rt.top(held, ["query_id", "n"], [F.col("evidence_id")], self.limit, "of_term")
        rows = rt.top(first, ["query_id", "evidence_id"], [F.col("n")], 1, "once")
        rows = self._ranked(rows, [F.col("n"), F.col("evidence_id")]).where(F.col("at") <= self.limit)
        return rows.withColumns({"stage": F.lit(6), "delta": _boosts(F.col("query"), F.col("evidence_type")), "held": F.lit(0), "new": F.lit(True)}).select(*_HIT)

    def stages(self, last: int = 6) -> DataFrame:
        """The hits of all stages up to the ``last``."""
        hits = materialize(self.evidence_hits(), "evidence_hits")
        for name in ("page_hits", "metadata_hits", "neighbour_hits", "wiki_hits", "substring_hits")[: last - 1]:
            hits = hits.unionByName(materialize(getattr(self, name)(hits), name))
        return hits

    def ranked(self, hits: DataFrame | None = None) -> DataFrame:
        """(query_id, rank, evidence_id, source_id, evidence_type, score, stage): the best ``limit`` of each query;
        ties go to the earlier hit."""
        hits = self.stages() if hits is None else hits
        first = F.min_by(F.struct("source_id", "evidence_type", "stage", "at"), F.struct("stage", "at"))
        total = hits.groupBy("query_id", "evidence_id").agg(F.round(F.sum("delta"), 6).alias("score"), first.alias("x")).select("query_id", "evidence_id", "score", "x.*")
        best = rt.top(total, ["query_id"], [F.desc("score"), F.col("stage"), F.col("at")], self.limit)
        return best.select("query_id", "rank", "evidence_id", "source_id", "evidence_type", "score", "stage")

    def everything(self) -> DataFrame:
        """(query_id, rank, kind, id, title, score): evidence, nodes, relations and wiki pages in one order:
        evidence by a thousand times its score, the others by 100 for each term they contain."""
        found = self.ranked().select("query_id", F.when(F.col("evidence_type") == "wiki_evidence", "wiki_page").otherwise("evidence").alias("kind"), F.col("evidence_id").alias("id"), F.col("source_id").alias("title"), F.round(F.greatest("score", F.lit(0.0)) * 1000).cast("bigint").alias("score"))
        c = self.corpus
        records = (
            c.nodes.where("live").select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), F.col("label").alias("title"), F.concat_ws(" ", "node_id", "label", F.array_join("aliases", " "), F.array_join("source_ids", " ")).alias("said"))
            .unionByName(c.edges.where("live").select(F.lit("relation").alias("kind"), F.col("edge_id").alias("id"), F.col("label").alias("title"), F.concat_ws(" ", "edge_id", "kind", "src", "dst", "label", F.array_join("evidence_ids", " ")).alias("said")))
            .unionByName(c.wiki.where("live").select(F.lit("wiki_page").alias("kind"), F.col("page_id").alias("id"), "title", F.concat_ws(" ", "path", "title", "text").alias("said")))
        )
        low = records.withColumn("said", F.lower("said"))
        met = low.join(F.broadcast(self.queries), F.exists("terms", lambda t: F.contains("said", t)))  # a stated list of queries
        more = met.select("query_id", "kind", "id", "title", tx.match_score(F.col("said"), F.col("terms")).cast("bigint").alias("score"))
        once = rt.top(found.unionByName(more), ["query_id", "kind", "id"], [F.desc("score"), F.col("title")], 1, "once")
        return rt.top(once, ["query_id"], [F.desc("score"), F.col("title"), F.col("kind"), F.col("id")], self.limit).select("query_id", "rank", "kind", "id", "title", "score")
