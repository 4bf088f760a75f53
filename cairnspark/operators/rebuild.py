"""Rebuilding a workspace graph: compaction, checks, origins that are carried on, ordered corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.storage import materialize
from . import graph as gr
from .components import components
from .retrieval import top

TARGET_CONCEPTS, MOST_RELATIONS, MOST_CLAIMS, MOST_NODE_EVIDENCE, MOST_RELATION_EVIDENCE, MOST_ALIASES = 18, 48, 12, 8, 6, 8
SYMMETRIC = ["related_to", "same_as"]
_NONE = "cast(array() as array<string>)"


def singular(word: Column) -> Column:
    n = F.length(word)
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    return F.when((n > 4) & word.endswith("ies"), F.concat(cut(3), F.lit("y"))).when((n > 3) & word.endswith("s") & ~word.endswith("ss"), cut(1)).otherwise(word)


def concept_key(label: Column) -> Column:
    """A concept's identity: ASCII words in the singular, without a kind before and an article in front."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(label, F.lit("")))), "^(concept:)?(topic:)?(node:)?(concept-)?(topic-)?(node-)?", "")
    words = F.filter(F.transform(F.split(F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " ")), " "), singular), lambda w: (w != "") & (w != "s"))
    return F.array_join(F.when(F.get(words, F.lit(0)) == "the", F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))).otherwise(words), " ")


def safe_name(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")


def compacted_nodes(nodes: DataFrame, evidence: DataFrame, degree: DataFrame) -> DataFrame:
    """(source_id, node_id, raw_ids, label, aliases, evidence_ids, confidence, score, rank): concepts of each source
    merged to a fixpoint where they share a normal label or alias or an evidence that isn't a chunk, and ranked by
    the sum of their parts' salience. ``nodes``: source_id, node_id, label, aliases, evidence_ids, confidence;
    ``evidence``: evidence_id, page, titled; ``degree``: node_id, degree. Merging is connected components, so a
    chain of any length is one concept; nodes without evidence or label drop out."""
    rows = nodes.withColumn("keys", F.array_sort(F.array_distinct(F.filter(F.transform(F.concat(F.array("label"), "aliases"), concept_key), lambda k: k != ""))))
    rows = rows.where((F.size("evidence_ids") > 0) & (F.size("keys") > 0)).withColumn("item", F.xxhash64("source_id", "node_id"))
    rows = materialize(rows, "concepts")
    by_key = rows.select("source_id", "item", F.explode("keys").alias("k")).select("item", F.concat_ws("\x1f", F.lit("k"), "source_id", "k").alias("by"))
    by_ref = rows.select("source_id", "item", F.explode("evidence_ids").alias("k")).where("not startswith(k, 'retrieved:')").select("item", F.concat_ws("\x1f", F.lit("e"), "source_id", "k").alias("by"))
    shared = by_key.unionByName(by_ref)
    low = shared.groupBy("by").agg(F.min("item").alias("low"))
    groups = components(shared.join(low, "by").select(F.col("item").alias("a"), F.col("low").alias("b")))
    member = rows.join(groups.withColumnRenamed("node", "item"), "item", "left").withColumn("concept", F.coalesce("component", "item"))
    refs = rows.select("item", F.explode("evidence_ids").alias("evidence_id")).join(evidence, "evidence_id", "left").groupBy("item").agg(
        F.countDistinct("page").alias("pages"), F.countDistinct(F.when(F.startswith("evidence_id", F.lit("retrieved:")), F.col("evidence_id"))).alias("chunks"), F.count_if(F.col("titled")).alias("headings"))
    member = member.join(refs, "item").join(degree, "node_id", "left").fillna(0, ["degree"])
    parts = {c: F.col(c) for c in ("pages", "chunks", "headings", "degree")} | {"evidence": F.size("evidence_ids"), "label": F.get("keys", F.lit(0)), "aliases": F.size("aliases"), "confidence": F.coalesce("confidence", F.lit(0.0))}
    member = member.withColumn("salience", gr.compaction_salience(parts).cast("bigint"))
    unite = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    shortest = F.min(F.struct(F.length(F.trim("label")).alias("n"), F.col("label").alias("label")))["label"]
    made = member.groupBy("source_id", "concept").agg(shortest.alias("label"), unite(F.concat(F.array("label"), "aliases")).alias("aliases"), unite("keys").alias("keys"), unite("evidence_ids").alias("evidence_ids"), F.array_sort(F.collect_set("node_id")).alias("raw_ids"), F.max("confidence").alias("confidence"), F.sum("salience").alias("score"))
    named = made.withColumn("node_id", F.concat_ws(":", F.lit("concept"), "source_id", safe_name(F.get("keys", F.lit(0))))).withColumn("aliases", F.slice(F.filter("aliases", lambda a: F.trim(a) != F.col("label")), 1, MOST_ALIASES))
    ranked = top(named, ["source_id"], [F.desc("score"), F.desc(F.size("evidence_ids")), F.col("label"), F.col("node_id")], 2**31 - 1)
    return ranked.select("source_id", "node_id", "raw_ids", "label", "aliases", F.slice("evidence_ids", 1, MOST_NODE_EVIDENCE).alias("evidence_ids"), "confidence", "score", "rank")


def compacted_relations(relations: DataFrame, kept: DataFrame, most: int = MOST_RELATIONS) -> DataFrame:
    """(source_id, relation_id, kind, src, dst, evidence_ids, confidence, score, rank): relations (source_id, kind,
    src, dst, evidence_ids, confidence) between kept concepts, each once; as many as the kept concepts
    leave room for, of which one link to the source each."""
    names = kept.select("source_id", F.explode("raw_ids").alias("raw"), "node_id", F.col("score").alias("node_score"))
    end = lambda c, p: names.select("source_id", F.col("raw").alias(c), F.col("node_id").alias(p), F.col("node_score").alias(f"{p}_score"))
    met = relations.where(F.size("evidence_ids") > 0).join(end("src", "a"), ["source_id", "src"]).join(end("dst", "b"), ["source_id", "dst"]).where("a <> b")
    turn = F.col("kind").isin(*SYMMETRIC) & (F.col("a") > F.col("b"))
    own = F.size("evidence_ids") * 4 + F.when(F.col("kind") == "related_to", 1).when(F.col("kind") == "source_of", 0).otherwise(4) + F.floor(F.coalesce("confidence", F.lit(0.0)) * 4).cast("int")
    rows = met.select("source_id", "kind", F.when(turn, F.col("b")).otherwise(F.col("a")).alias("src"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("dst"), "evidence_ids", "confidence", (own + F.floor((F.col("a_score") + F.col("b_score")) / 10)).alias("worth"))
    unite = F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids"))))
    made = rows.groupBy("source_id", "kind", "src", "dst").agg(unite.alias("evidence_ids"), F.max("confidence").alias("confidence"), F.sum("worth").cast("bigint").alias("score"))
    made = made.withColumn("relation_id", F.concat_ws("-", F.lit("rel"), "kind", safe_name(F.col("src")), safe_name(F.col("dst"))))
    room = kept.groupBy("source_id").agg((F.lit(most) - F.count("*")).alias("room"))
    ranked = top(made, ["source_id"], [F.desc("score"), F.desc(F.size("evidence_ids")), F.col("relation_id")], most).join(room, "source_id").where(F.col("rank") <= F.col("room"))
    return ranked.select("source_id", "relation_id", "kind", "src", "dst", F.slice("evidence_ids", 1, MOST_RELATION_EVIDENCE).alias("evidence_ids"), "confidence", "score", "rank")


def compacted_claims(claims: DataFrame, kept: DataFrame, most: int = MOST_CLAIMS) -> DataFrame:
    """The first claims (source_id, claim_id, place, topic_refs, evidence_refs) of each source about kept concepts."""
    names = kept.select("source_id", F.explode("raw_ids").alias("topic"), "node_id")
    met = claims.where(F.size("evidence_refs") > 0).select("source_id", "claim_id", "place", F.explode("topic_refs").alias("topic")).join(names, ["source_id", "topic"])
    made = met.groupBy("source_id", "claim_id", "place").agg(F.array_sort(F.collect_set("node_id")).alias("topic_refs"))
    return top(made, ["source_id"], [F.col("place"), F.col("claim_id")], most).drop("rank")


def source_edges(nodes: DataFrame, relations: DataFrame, evidence: DataFrame) -> DataFrame:
    """(source_id, relation_id, node_id, evidence_ids): links from a source to those of its nodes (source_id, node_id, evidence_ids)
    that have none; a node without evidence rests on all of the source's."""
    linked = relations.where("kind = 'source_of'").select("source_id", F.col("dst").alias("node_id")).distinct()
    every = evidence.groupBy("source_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("all_ids"))
    rows = nodes.join(linked, ["source_id", "node_id"], "left_anti").join(every, "source_id", "left")
    refs = F.when(F.size("evidence_ids") > 0, F.col("evidence_ids")).otherwise(F.coalesce("all_ids", F.expr(_NONE)))
    return rows.select("source_id", F.concat_ws("-", F.lit("rel-source_of"), safe_name(F.col("source_id")), safe_name(F.col("node_id"))).alias("relation_id"), "node_id", refs.alias("evidence_ids")).where(F.size("evidence_ids") > 0)


# checks
def missing_references(records: dict[str, DataFrame], known: dict[str, DataFrame]) -> DataFrame:
    """(kind, id, refers_to, missing) of references to records that don't exist. ``records``: kind -> rows with
    ``id`` and arrays named ``<other>_refs``; ``known``: other -> rows with ``id``."""
    out = None
    for kind, rows in records.items():
        for other, ids in known.items():
            if f"{other}_refs" in rows.columns:
                refs = rows.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), F.lit(other).alias("refers_to"), F.explode(f"{other}_refs").alias("missing"))
                bad = refs.join(ids.select(F.col("id").cast("string").alias("missing")).distinct(), "missing", "left_anti").select("kind", "id", "refers_to", "missing").distinct()
                out = bad if out is None else out.unionByName(bad)
    return out


def snapshot_faults(sources: DataFrame, baseline: DataFrame, nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """(fault, id) of a source-local graph: sources that aren't those of the baseline, sources without a node,
    nodes that rest on nothing or that their source doesn't link to. Nodes: node_id, source_refs, evidence_refs."""
    ids = lambda df: df.select("source_id").distinct()
    name = F.concat(F.lit("source:"), "source_id")
    more = ids(sources).join(ids(baseline), "source_id", "left_anti").select(F.lit("source_unknown").alias("fault"), F.col("source_id").alias("id"))
    less = ids(baseline).join(ids(sources), "source_id", "left_anti").select(F.lit("source_missing").alias("fault"), F.col("source_id").alias("id"))
    bare = ids(sources).select("source_id", name.alias("node_id")).join(nodes, "node_id", "left_anti").select(F.lit("source_node_missing").alias("fault"), F.col("node_id").alias("id"))
    own = nodes.where(~F.startswith("node_id", F.lit("source:")))
    loose = own.where((F.size("source_refs") == 0) & (F.size("evidence_refs") == 0)).select(F.lit("not_grounded").alias("fault"), F.col("node_id").alias("id"))
    linked = relations.where(F.startswith("src", F.lit("source:"))).select(F.col("dst").alias("node_id")).distinct()
    alone = own.join(linked, "node_id", "left_anti").select(F.lit("not_linked").alias("fault"), F.col("node_id").alias("id"))
    return more.unionByName(less).unionByName(bare).unionByName(loose).unionByName(alone)


def first_fault(faults: DataFrame, order: list[str]) -> DataFrame:
    """The fault that a check reports: the first by kind, then by id."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("fault"))
    return faults.orderBy(rank, "id").limit(1)


# origins
def carried_origins(records: DataFrame, previous: DataFrame, fresh: DataFrame, evidence: DataFrame, known: DataFrame) -> DataFrame:
    """(kind, id, event_id) of records (kind, id, source_refs, evidence_refs, node_refs) that a linking run made and that
    still stand: all they refer to is known (``known``: kind, id), their evidence spans several sources, as do their own
    sources where they name any, and no newer run (``fresh``) made them anew. ``previous``: kind, id, event_id, operation."""
    linking = previous.where("operation = 'workspace_linking'").join(fresh.select("kind", "id"), ["kind", "id"], "left_anti")
    rows = materialize(records.join(linking, ["kind", "id"]), "linked_records")
    refs = [rows.select("kind", "id", F.lit(k).alias("of"), F.explode(f"{k}_refs").alias("ref")) for k in ("source", "evidence", "node")]
    each = refs[0].unionByName(refs[1]).unionByName(refs[2])
    broken = each.join(known.select(F.col("kind").alias("of"), F.col("id").alias("ref")), ["of", "ref"], "left_anti").select("kind", "id").distinct()
    spans = refs[1].join(evidence.select(F.col("evidence_id").alias("ref"), "source_id"), "ref").groupBy("kind", "id").agg(F.countDistinct("source_id").alias("spans"))
    own = F.size(F.array_distinct("source_refs"))
    met = rows.join(broken, ["kind", "id"], "left_anti").join(spans, ["kind", "id"], "left")
    return met.where((F.coalesce("spans", F.lit(0)) > 1) & ((F.col("kind") == "relation") | (own > 1))).select("kind", "id", "event_id")


def legacy_origins(records: DataFrame, evidence: DataFrame, generated: DataFrame) -> DataFrame:
    """(kind, id, stale): old records without an origin that can only come from linking, since their evidence spans
    sources; those that the newest source-local run made itself aren't meant, and those with evidence that is gone are stale."""
    refs = records.select("kind", "id", F.explode("evidence_refs").alias("evidence_id")).join(evidence, "evidence_id", "left")
    seen = refs.groupBy("kind", "id").agg(F.countDistinct("source_id").alias("spans"), F.max(F.col("source_id").isNull()).alias("stale"))
    return seen.where("spans > 1").join(generated.select("kind", "id"), ["kind", "id"], "left_anti").select("kind", "id", "stale")


def cleanup_scope(events: DataFrame) -> DataFrame:
    """(kind, id) of what events (operation, records: array of kind and id) may clean up: all that
    materialisations other than linking wrote."""
    return events.where(~F.col("operation").eqNullSafe(F.lit("workspace_linking"))).select(F.explode("records").alias("r")).select("r.kind", "r.id").distinct()


def readable_labels(nodes: DataFrame) -> DataFrame:
    """Nodes (node_id, label, aliases) whose label is an id get their first readable alias, else words made from the id."""
    machine = lambda x: (F.trim(x) == "") | (F.trim(x) == F.col("node_id")) | F.rlike(F.trim(x), F.lit("^(source-|concept:|source:)"))
    alias = F.get(F.filter(F.transform("aliases", lambda a: F.trim(a)), lambda a: ~machine(a)), F.lit(0))
    parts = F.filter(F.split(F.substring_index("node_id", ":", -1), "[-_]"), lambda p: F.trim(p) != "")
    words = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 2**31 - 1))), " ")
    return nodes.withColumn("label", F.when(machine(F.coalesce("label", F.lit(""))), F.coalesce(alias, words)).otherwise(F.col("label")))


# corrections
def split_faults(parts: DataFrame, nodes: DataFrame, node_id: str) -> DataFrame:
    """(label, fault) of a split (part: place, label, node_id, evidence_ids): at least two parts, with labels and with
    evidence of the node alone, and ids that are new and differ."""
    own = nodes.where(F.col("node_id") == node_id).select(F.col("evidence_ids").alias("own_ids"))
    met = parts.join(F.broadcast(own))  # one node
    blank = met.where(F.trim(F.coalesce("label", F.lit(""))) == "").select("label", F.lit("blank_label").alias("fault"))
    empty = met.where(F.size("evidence_ids") == 0).select("label", F.lit("no_evidence").alias("fault"))
    alien = met.where(F.size(F.array_except("evidence_ids", "own_ids")) > 0).select("label", F.lit("foreign_evidence").alias("fault"))
    twice = parts.groupBy("node_id").agg(F.count("*").alias("n"), F.max("label").alias("label")).where("n > 1").select("label", F.lit("id_twice").alias("fault"))
    taken = parts.join(nodes.select("node_id"), "node_id", "left_semi").select("label", F.when(F.col("node_id") == node_id, "original_id").otherwise("id_taken").alias("fault"))
    few = parts.agg(F.count("*").alias("n")).where("n < 2").select(F.lit(None).cast("string").alias("label"), F.lit("too_few_parts").alias("fault"))
    return blank.unionByName(empty).unionByName(alien).unionByName(twice).unionByName(taken).unionByName(few)


def parse_split(value: Column) -> Column:
    """The parts of a split as they are written: a JSON list of label, node_id, aliases, evidence_ids and edge_ids."""
    return F.from_json(value, "array<struct<label:string,node_id:string,aliases:array<string>,evidence_ids:array<string>,edge_ids:array<string>>>")


def split_edges(edges: DataFrame, parts: DataFrame, node_id: str) -> DataFrame:
    """Edges (edge_id, src, dst, kind, evidence_ids) after a split: each part takes over those edges of the node that it
    names or that share evidence with it; others of the node go, as do loops."""
    touches = (F.col("src") == node_id) | (F.col("dst") == node_id)
    chosen = parts.select(F.col("node_id").alias("part_id"), F.col("evidence_ids").alias("part_evidence"), F.coalesce("edge_ids", F.expr(_NONE)).alias("part_edges"))
    met = edges.where(touches).join(F.broadcast(chosen))  # the parts of one node
    met = met.where(F.when(F.size("part_edges") > 0, F.array_contains("part_edges", F.col("edge_id"))).otherwise(F.arrays_overlap("part_evidence", "evidence_ids")))
    end = lambda c: F.when(F.col(c) == node_id, F.col("part_id")).otherwise(F.col(c)).alias(c)
    moved = met.select("edge_id", end("src"), end("dst"), "kind", "evidence_ids").where("src <> dst")
    moved = moved.withColumn("edge_id", F.concat_ws("-", F.lit("edge"), "src", "dst"))
    return edges.where(~touches).select("edge_id", "src", "dst", "kind", "evidence_ids").unionByName(moved)


def corrected(nodes: DataFrame, edges: DataFrame, corrections: list[dict]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after a workspace's corrections, in their order. The list is short and stated; every step is a plan, and
    lineage is cut behind each, so that a long list doesn't make a long plan."""
    for c in corrections:
        kind = c["kind"]
        if kind == "rename":
            nodes, edges = gr.rename_node(nodes, edges, c["node_id"], c["label"])
        elif kind == "merge":
            nodes, edges = gr.merge_nodes(nodes, edges, c["node_id"], c["target"])
        elif kind == "keep_separate":
            nodes = gr.keep_separate(nodes, c["node_id"])
        elif kind == "delete":
            gone = nodes.where(F.col("node_id") == c["node_id"]).select("node_id")
            nodes, edges = gr.delete_nodes(nodes, edges, gone)
        else:
            raise ValueError(f"unknown correction {kind!r}")
        nodes, edges = materialize(nodes, "corrected_nodes"), materialize(edges, "corrected_edges")
    return nodes, edges


def refreshed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, label, degree, n_evidence, n_sources) of nodes (node_id, label, evidence_ids, source_ids) after their edges changed."""
    return nodes.join(gr.degrees(edges).withColumnRenamed("node", "node_id"), "node_id", "left").select("node_id", "label", F.coalesce("degree", F.lit(0)).alias("degree"), F.size("evidence_ids").alias("n_evidence"), F.size(F.array_distinct("source_ids")).alias("n_sources"))


# runs
def gates(sources: DataFrame, runs: DataFrame, fields: list[str]) -> DataFrame:
    """(source_id, decision) whether a source's graph is built: not without text, not if a finished run has the same
    fingerprint, and not while one is running."""
    on = [F.col(f"s.{f}").eqNullSafe(F.col(f"r.{f}")) for f in ["source_id", *fields]]
    told = sources.alias("s").join(runs.alias("r"), on, "left").groupBy("s.source_id").agg(F.max(F.col("s.n_chars")).alias("n_chars"), F.max(F.col("r.status") == "done").alias("done"), F.max(F.col("r.status") == "running").alias("running"))
    decision = F.when(F.coalesce("n_chars", F.lit(0)) == 0, "skip_empty").when(F.coalesce("done", F.lit(False)), "reuse").when(F.coalesce("running", F.lit(False)), "wait").otherwise("run")
    return told.select("source_id", decision.alias("decision"))


def linking_chunks(chunks: DataFrame, candidates: DataFrame, nodes: DataFrame, per_source: int = 4, most: int = 24) -> DataFrame:
    """(chunk_id, source_id, names, rank): chunks (chunk_id, source_id, text) that name most of the candidate nodes
    (node_id) of their source, a few of each source, for a linking run to read."""
    wanted = nodes.join(candidates.select("node_id").distinct(), "node_id", "left_semi").select(F.explode("source_ids").alias("source_id"), F.lower("label").alias("name")).distinct()
    met = chunks.withColumn("low", F.lower("text")).join(wanted, "source_id").where(F.contains("low", "name")).groupBy("chunk_id", "source_id").agg(F.count("*").alias("names"))
    few = top(met, ["source_id"], [F.desc("names"), F.col("chunk_id")], per_source, "of_source")
    return top(few.withColumn("all", F.lit(1)), ["all"], [F.desc("names"), F.col("chunk_id")], most).select("chunk_id", "source_id", "names", "rank")
