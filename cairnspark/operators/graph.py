"""Entity graphs: hops, merges by alias, edges, salience, corrections, lint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..sources.storage import materialize, release
from .components import components
from .overlaps import covering
from .retrieval import top


def both_ways(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    keep = [c for c in edges.columns if c not in (src, dst)]
    out = edges.select(F.col(src).alias("node"), F.col(dst).alias("other"), F.lit("out").alias("direction"), *keep)
    return out.unionByName(edges.select(F.col(dst).alias("node"), F.col(src).alias("other"), F.lit("in").alias("direction"), *keep))


def neighbours(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, other, direction): one hop from the seeds in both directions."""
    return both_ways(edges).join(seeds.select("node").distinct(), "node", "left_semi").dropDuplicates(["node", "other", "direction"])


def hops(seeds: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(node, distance) within ``most`` hops; each round joins only the newest nodes, and known ones
    are taken out before the next."""
    links = both_ways(edges).select("node", "other").where("other is not null")
    found = materialize(seeds.select("node").distinct().withColumn("distance", F.lit(0)), "hops")
    edge = found
    for d in range(1, most + 1):
        edge = links.join(edge.select("node"), "node", "left_semi").select(F.col("other").alias("node")).distinct().join(found, "node", "left_anti")
        edge = materialize(edge.withColumn("distance", F.lit(d)), "hops")
        found = found.unionByName(edge)
    return found


def merge_by_alias(labels: DataFrame) -> DataFrame:
    """(item, position, keys) -> (item, group_key). Items sharing any key are one group, named by the
    smallest of the keys that began a group in arrival order: an item begins one if none of its keys
    was seen in an earlier item."""
    keys = labels.select("item", "position", F.posexplode("keys").alias("at", "key")).where("key <> ''")
    first_seen = keys.groupBy("key").agg(F.min("position").alias("seen"), F.min("item").alias("low"))
    joined = keys.join(first_seen, "key")
    edges = joined.where("item <> low").select(F.col("item").alias("a"), F.col("low").alias("b"))
    groups = components(edges)
    member = labels.select("item", "position").join(groups.withColumnRenamed("node", "item"), "item", "left").select("item", F.coalesce("component", "item").alias("component"))
    began = joined.groupBy("item", "position").agg(F.min("seen").alias("earliest"), F.min_by("key", "at").alias("own")).where("earliest = position").select("item", "own")
    named = member.join(began, "item").groupBy("component").agg(F.min("own").alias("group_key"))
    return member.join(named, "component").select("item", "group_key")


def remap_edges(edges: DataFrame, mapping: DataFrame, symmetric: list[str]) -> DataFrame:
    """Edges (src, dst, kind) between merged nodes (mapping: old, new): renamed at both ends, without
    self-loops, symmetric kinds ordered, each once with its number of originals."""
    left = mapping.toDF("src", "s")
    right = mapping.toDF("dst", "d")
    named = edges.join(left, "src", "left").join(right, "dst", "left").select(F.coalesce("s", "src").alias("a"), F.coalesce("d", "dst").alias("b"), "kind")
    turn = F.col("kind").isin(*symmetric) & (F.col("a") > F.col("b"))
    return named.where("a <> b").select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("src"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("dst"), "kind").groupBy("src", "dst", "kind").agg(F.count("*").alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("node").agg(F.count("*").alias("degree"))


def compaction_salience(row: dict[str, Column]) -> Column:
    words = F.size(F.split(F.trim(row["label"]), r"\s+"))
    return (
        row["evidence"] * 5 + row["pages"] * 3 + row["chunks"] * 2 + F.least(row["headings"], F.lit(3)) + F.least(row["degree"], F.lit(8)) * 2
        + row["aliases"] + F.floor(row["confidence"] * 4).cast("int")
        - F.when((words == 1) & (row["evidence"] <= 1), 2).otherwise(0) - F.greatest(words - 6, F.lit(0))
    )


def projection(nodes: DataFrame, edges: DataFrame, most_nodes: int, most_edges: int) -> DataFrame:
    """Visible (kind 'node'/'edge', id, score) of nodes (id, label, evidence, confidence) and edges
    (id, src, dst, evidence, kind, confidence); edges need both ends visible."""
    full = nodes.join(degrees(edges).withColumnRenamed("node", "id"), "id", "left").fillna(0, ["degree"])
    score = F.col("evidence") * 100 + F.col("degree") * 12 + F.round(F.col("confidence") * 100).cast("bigint") - F.when(F.length("label") > 80, 50).otherwise(0)
    ranked = top(full.withColumn("score", score).withColumn("all", F.lit(1)), ["all"], [F.desc("score"), F.desc("evidence"), F.col("label"), F.col("id")], most_nodes)
    seen = materialize(ranked.select("id", "score"), "visible_nodes")
    ends = edges.join(seen.select(F.col("id").alias("src")), "src", "left_semi").join(seen.select(F.col("id").alias("dst")), "dst", "left_semi")
    weight = F.col("evidence") * 100 + F.when(F.col("kind") == "source_document", 20).when(F.col("kind") == "related_to", 10).otherwise(0) + F.round(F.col("confidence") * 100).cast("bigint")
    lines = top(ends.withColumn("score", weight).withColumn("all", F.lit(1)), ["all"], [F.desc("score"), F.desc("evidence"), F.col("kind"), F.col("id")], most_edges)
    return seen.select(F.lit("node").alias("part"), "id", "score").unionByName(lines.select(F.lit("edge").alias("part"), "id", "score"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edge ends that aren't nodes: (edge_id, missing)."""
    ends = edges.select("edge_id", F.explode(F.array("src", "dst")).alias("missing"))
    return ends.join(nodes.select(F.col("node").alias("missing")), "missing", "left_anti").select("edge_id", "missing").distinct()


def orphans(nodes: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    linked = both_ways(edges).select("node").union(evidence.select("node")).distinct()
    return nodes.join(linked, "node", "left_anti")


def rare_tokens(sets: DataFrame, tokens: str, needed: Column, within: list[str]) -> DataFrame:
    """The columns of ``sets`` but its tokens, and ``token``: of each set the tokens that it must share one
    of with any set that has ``needed`` tokens in common with it, from rare to frequent (within groups
    of the columns ``within``). Tokens that all share lie at the end and seldom come along."""
    keep = [c for c in sets.columns if c != tokens]
    each = sets.select(*keep, F.size(tokens).alias("_size"), needed.cast("int").alias("_needed"), F.explode(tokens).alias("token"))
    often = each.groupBy(*within, "token").agg(F.count("*").alias("_often"))
    ranked = each.join(often, [*within, "token"]).groupBy(*keep, "_size", "_needed").agg(F.array_sort(F.collect_list(F.struct("_often", "token"))).alias("_sorted"))
    first = F.slice("_sorted", 1, F.greatest(F.col("_size") - F.col("_needed") + 1, F.lit(0)))
    return ranked.select(*keep, F.explode(first).alias("_x")).select(*keep, F.col("_x.token").alias("token"))


#: Claims of one class are paired in blocks of about so many, in tasks of about so many pairs.
CLASS_BLOCK, TASK_PAIRS = 512, 4_000_000


def claim_conflicts(claims: DataFrame, least_shared: int = 3) -> DataFrame:
    """(left_id, right_id, shared) of claims (claim_id, topic, statement) that share a topic, of which
    exactly one is negated, and that share terms. Claims of equal topic, negation and terms are one class; classes
    meet by their rarest terms within a topic and are compared on all of them once, so that a term that all
    claims hold pairs none. The claims of conflicting classes are paired block by block, so no task holds a class."""
    rows = claims.select("claim_id", "topic", tx.negated(F.col("statement")).alias("no"), tx.claim_terms(F.col("statement")).alias("terms")).distinct()
    rows = materialize(rows.where(F.size("terms") >= least_shared), "claims")
    kinds = rows.where("topic is not null and no is not null").groupBy("topic", "no", "terms").agg(F.count("*").alias("n"))
    kinds = materialize(kinds.withColumn("kind", F.monotonically_increasing_id()), "claim_classes")
    rare = rare_tokens(kinds.select("kind", "topic", "no", "terms"), "terms", F.lit(least_shared), ["topic"])
    a, b = rare.where("no").select("topic", "token", F.col("kind").alias("x")), rare.where("not no").select("topic", "token", F.col("kind").alias("y"))
    pairs = a.join(b, ["topic", "token"]).select("x", "y").distinct()
    held = lambda c: kinds.select(F.col("kind").alias(c), F.col("terms").alias(f"{c}_terms"), F.col("n").alias(f"{c}_n"))
    met = pairs.join(held("x"), "x").join(held("y"), "y").select("x", "y", F.size(F.array_intersect("x_terms", "y_terms")).cast("bigint").alias("shared"), (F.col("x_n") * F.col("y_n")).alias("work"))
    met = materialize(met.where(F.col("shared") >= least_shared), "conflicting_classes")
    block = F.pmod(F.xxhash64("claim_id"), F.ceil(F.col("n") / CLASS_BLOCK))
    blocks = rows.join(kinds, ["topic", "no", "terms"]).groupBy("kind", block.alias("block")).agg(F.collect_list("claim_id").alias("ids"))
    blocks = materialize(blocks, "claim_blocks")
    of = lambda c: blocks.select(F.col("kind").alias(c), F.col("ids").alias(f"{c}_ids"))
    work = met.agg(F.coalesce(F.sum("work"), F.lit(0))).first()[0]
    dealt = met.join(of("x"), "x").join(of("y"), "y").select("shared", "x_ids", "y_ids").repartition(1 + work // TASK_PAIRS)
    each = dealt.select("shared", "y_ids", F.explode("x_ids").alias("x")).select("shared", "x", F.explode("y_ids").alias("y")).where("x <> y")
    found = each.select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"), "shared")
    # only a claim that is in several classes can be paired with another one twice
    return found.distinct() if rows.groupBy("claim_id").count().where("count > 1").head(1) else found


def link_candidates(left: DataFrame, right: DataFrame, most: int = 32, first: int = 16) -> DataFrame:
    """Candidates between two sets of nodes (id, name, terms): 10 000 for an equal normal name, else
    1 000 for two shared terms; 100 for each shared term up to eight; the best ``most``.

    Equal scores rank by id. So once the ``first`` left nodes give ``most`` pairs of the highest score there is, later ones can't enter,
    and pairs by terms can't where enough have equal names. Only where that doesn't decide, all meet: by name, or by their
    rarest terms, compared on all terms. Of nodes with equal name and terms the ``most`` smallest ids are enough."""
    key = lambda df, side: df.select(F.lit(side).alias("side"), "id", tx.normal_key(F.col("name")).alias("key"), F.array_sort(F.array_distinct("terms")).alias("terms"))
    both = materialize(top(key(left, 0).unionByName(key(right, 1)), ["side", "key", "terms"], [F.col("id")], most, "_n").drop("_n"), "linked_nodes")
    of = lambda side, p: both.where(F.col("side") == side).select(F.col("id").alias(f"{p}_id"), F.col("key").alias(f"{p}_key"), F.col("terms").alias(f"{p}_terms"))
    l, r = of(0, "l"), of(1, "r")
    direct, shared = F.coalesce((F.col("l_key") == F.col("r_key")) & (F.col("l_key") != ""), F.lit(False)), F.size(F.array_intersect("l_terms", "r_terms"))
    best_of = lambda df: df.orderBy(F.desc("score"), "l_id", "r_id").limit(most)

    def scored(met: DataFrame, named: bool) -> DataFrame:
        met = met.select("l_id", "r_id", direct.alias("direct"), shared.alias("shared")).where("direct" if named else "not direct and shared >= 2")
        return best_of(met.withColumn("score", F.lit(10_000 if named else 1_000) + F.least(F.col("shared"), F.lit(8)) * 100))

    def early(nodes: DataFrame, named: bool, met, enough: int) -> DataFrame | None:
        """The best of the first nodes, if no later one can be among the best."""
        some = F.broadcast(nodes.orderBy("l_id").limit(first))
        found = materialize(scored(met(some), named), "best_links")
        return found if found.where(F.col("score") == (10_800 if named else 1_800)).count() >= enough else None

    named = l.where("l_key <> ''").join(r.select(F.col("r_key").alias("l_key")).distinct(), "l_key", "left_semi")
    by_name = lambda some: some.join(r, F.col("l_key") == F.col("r_key"))
    best = early(named, True, by_name, most)
    if best is None:
        best = materialize(scored(by_name(named), True), "best_links")
    missing = most - best.count()
    if missing:
        by_term = early(l, False, lambda some: some.join(r), missing)
        if by_term is None:
            rare = rare_tokens(both.select("side", "id", "terms"), "terms", F.lit(2), [])
            met = lambda side, p: rare.where(F.col("side") == side).select(F.col("id").alias(f"{p}_id"), "token")
            pairs = met(0, "l").join(met(1, "r"), "token").select("l_id", "r_id").distinct()
            by_term = scored(pairs.join(l, "l_id").join(r, "r_id"), False)
        best = best_of(best.unionByName(by_term))
    return top(best.withColumn("all", F.lit(1)), ["all"], [F.desc("score"), F.col("l_id"), F.col("r_id")], most).drop("all")


def rename_node(nodes: DataFrame, edges: DataFrame, old: str, new_label: str) -> tuple[DataFrame, DataFrame]:
    """The node gets a label and an id made from it; its old label stays as an alias."""
    new = F.concat(F.lit("concept-"), F.replace(tx.normal_key(F.lit(new_label)), F.lit(" "), F.lit("-")))
    is_it = F.col("node_id") == old
    renamed = nodes.withColumn("aliases", F.when(is_it, F.array_sort(F.array_union("aliases", F.array("label")))).otherwise(F.col("aliases"))).withColumn("label", F.when(is_it, F.lit(new_label)).otherwise(F.col("label"))).withColumn("node_id", F.when(is_it, new).otherwise(F.col("node_id")))
    end = lambda c: F.when(F.col(c) == old, new).otherwise(F.col(c)).alias(c)
    return renamed, edges.select(*[end(c) if c in ("src", "dst") else F.col(c) for c in edges.columns])


def merge_nodes(nodes: DataFrame, edges: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """``source`` goes into ``target``: aliases and evidence united, the larger confidence up to .94."""
    pair = nodes.where(F.col("node_id").isin(source, target))
    one = pair.agg(
        F.max(F.when(F.col("node_id") == target, F.col("label"))).alias("label"),
        F.array_sort(F.array_distinct(F.concat(F.flatten(F.collect_list("aliases")), F.collect_list(F.when(F.col("node_id") == source, F.col("label")))))).alias("aliases"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("evidence_ids"),
        F.least(F.max(F.coalesce("confidence", F.lit(0.72))), F.lit(0.94)).alias("confidence"),
    ).withColumn("node_id", F.lit(target))
    rest = nodes.where(~F.col("node_id").isin(source, target))
    end = lambda c: F.when(F.col(c) == source, F.lit(target)).otherwise(F.col(c)).alias(c)
    moved = edges.select(*[end(c) if c in ("src", "dst") else F.col(c) for c in edges.columns]).where("src <> dst").dropDuplicates(["src", "dst", "kind"])
    return rest.unionByName(one.select(*nodes.columns)), moved


def keep_separate(nodes: DataFrame, node_id: str) -> DataFrame:
    """Every alias becomes a node of its own with the same evidence; the node loses its aliases."""
    it = F.col("node_id") == node_id
    own = nodes.where(it).select(F.explode("aliases").alias("label"), "evidence_ids", F.least("confidence", F.lit(0.82)).alias("confidence"))
    made = own.select(F.concat(F.lit("concept-"), F.replace(tx.normal_key(F.col("label")), F.lit(" "), F.lit("-"))).alias("node_id"), "label", F.expr("cast(array() as array<string>)").alias("aliases"), "evidence_ids", "confidence")
    return nodes.withColumn("aliases", F.when(it, F.expr("cast(array() as array<string>)")).otherwise(F.col("aliases"))).unionByName(made.select(*nodes.columns))


def split_node(nodes: DataFrame, node_id: str, parts: DataFrame) -> DataFrame:
    """The node is replaced by parts (label, evidence_ids), each with the evidence it names of the node's own."""
    own = nodes.where(F.col("node_id") == node_id).select("evidence_ids", "confidence").withColumnRenamed("evidence_ids", "all_ids")
    made = parts.join(F.broadcast(own)).select(F.concat(F.lit("concept-"), F.replace(tx.normal_key(F.col("label")), F.lit(" "), F.lit("-"))).alias("node_id"), "label", F.expr("cast(array() as array<string>)").alias("aliases"), F.array_sort(F.array_intersect("evidence_ids", "all_ids")).alias("evidence_ids"), "confidence")
    return nodes.where(F.col("node_id") != node_id).unionByName(made.where(F.size("evidence_ids") > 0).select(*nodes.columns))


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without those in ``gone`` (node_id), edges without an end there."""
    ids = gone.select("node_id").distinct()
    left = edges.join(ids.select(F.col("node_id").alias("src")), "src", "left_anti").join(ids.select(F.col("node_id").alias("dst")), "dst", "left_anti")
    return nodes.join(ids, "node_id", "left_anti"), left.select(*edges.columns)


def clean_references(rows: DataFrame, key: str, refs: str, known: DataFrame, id_column: str) -> DataFrame:
    """Rows whose reference arrays hold known ids only, in their order."""
    held = rows.select(key, F.posexplode(refs).alias("at", "ref")).join(known.select(F.col(id_column).alias("ref")).distinct(), "ref", "left_semi")
    lists = held.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ref"))), lambda x: x["ref"]).alias("kept"))
    return rows.join(lists, key, "left").withColumn(refs, F.coalesce("kept", F.expr("cast(array() as array<string>)"))).drop("kept")


def evidence_index(kinds: dict[str, DataFrame]) -> DataFrame:
    """(evidence_id, record_kind, record_id) of all records with ``id`` and ``evidence_ids``."""
    rows = [df.select(F.explode("evidence_ids").alias("evidence_id"), F.lit(kind).alias("record_kind"), F.col("id").cast("string").alias("record_id")) for kind, df in kinds.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.distinct()


def trail(selected: DataFrame, index: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """(evidence_id, stage, record_id): records citing the evidence, then the ends and other edges
    next to them, each record once and at most ``most`` of a stage. Rows of ``index`` and ``edges`` may repeat.

    What is next to a node is listed once for each node, and of it the first ``2 * most`` records: an evidence leaves out at most
    ``most`` that are direct, and ends come first. Of these only as many go on as the evidence has room for. Each evidence is one
    row of bounded lists; repeated rows are passed over by rank, so rows are dealt once by what they are grouped by; shuffle files of a
    step go when it is written."""
    spark = index.sparkSession
    rows = index.join(selected.select("evidence_id").distinct(), "evidence_id", "left_semi").withColumn("ordinal", F.when(F.col("record_kind") == "node", 0).otherwise(1))
    by_evidence = Window.partitionBy("evidence_id").orderBy("ordinal", "record_id", "record_kind")
    direct = rows.withColumn("rank", F.dense_rank().over(by_evidence)).where(F.col("rank") <= most)
    heads = direct.groupBy("evidence_id").agg(F.array_sort(F.collect_set(F.struct("rank", "record_kind", "record_id"))).alias("direct"))
    heads = materialize(heads, "direct_records")
    release(spark)
    of_kind = lambda kind: F.transform(F.filter("direct", lambda x: x["record_kind"] == kind), lambda x: x["record_id"])
    none = F.expr("cast(array() as array<string>)")

    lines = edges.select(F.col("edge_id").cast("string").alias("edge_id"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    by_edge = lines.groupBy("edge_id").agg(F.collect_set(F.struct("src", "dst")).alias("pairs"))
    ends = heads.select("evidence_id", F.explode(of_kind("relation")).alias("edge_id")).join(by_edge, "edge_id")
    ends = ends.select("evidence_id", F.flatten(F.transform("pairs", lambda x: F.array(x["src"], x["dst"]))).alias("ends"))
    ends = ends.groupBy("evidence_id").agg(F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_list("ends"))))).alias("ends"))
    own = F.transform("direct", lambda x: x["record_id"])
    held = heads.join(ends, "evidence_id", "left").select("evidence_id", "direct", F.array_except(F.coalesce("ends", none), own).alias("ends"))
    held = materialize(held, "trail_heads")
    release(spark)

    beside = both_ways(lines).select("node", F.explode(F.array("edge_id", "other")).alias("record_id")).where("node is not null and record_id is not null")
    beside = beside.withColumn("rank", F.dense_rank().over(Window.partitionBy("node").orderBy("record_id"))).where(F.col("rank") <= 2 * most)
    beside = beside.groupBy("node").agg(F.array_sort(F.collect_set("record_id")).alias("beside"))
    room = F.lit(most) - F.size("ends")
    asked = held.where(room > 0).select("evidence_id", own.alias("own"), "ends", F.explode(of_kind("node")).alias("node"))
    left = F.slice(F.array_except(F.array_except("beside", "own"), "ends"), 1, room)
    touching = materialize(asked.join(beside, "node").select("evidence_id", left.alias("left")).where(F.size("left") > 0), "touching_records")
    release(spark)

    both = held.select("evidence_id", "ends", none.alias("left")).unionByName(touching.select("evidence_id", none.alias("ends"), "left"))
    near = both.groupBy("evidence_id").agg(F.flatten(F.collect_list("ends")).alias("ends"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("left")))).alias("left"))
    near = near.select("evidence_id", F.posexplode(F.slice(F.concat("ends", "left"), 1, most)).alias("at", "record_id")).select("evidence_id", "record_id", (F.col("at") + 1).alias("rank"))
    direct = held.select("evidence_id", F.explode("direct").alias("x")).select("evidence_id", "x.record_id", "x.rank")
    pick = lambda df, stage: df.select("evidence_id", F.lit(stage).alias("stage"), "record_id", "rank")
    return pick(direct, "direct").unionByName(pick(near, "adjacent"))


def memory_matches(new: DataFrame, known: DataFrame) -> DataFrame:
    """Best known memory (id, title, body, evidence_ids) of each new one with a score: 950 equal body,
    900 equal title, 850 shared evidence, else 700 and the larger coverage in percent if four terms,
    80 % of the smaller and 65 % of the larger set are shared.

    Bodies and titles meet by their SHA-256. Of the known ones with an equal body, title or evidence the two smallest ids are
    enough: one may be the new one itself. Terms, told by 64-bit hashes, are compared for new ones without a better match only: these
    are held in blocks against the known ones, whose terms never leave their task."""
    def shaped(df: DataFrame, p: str) -> DataFrame:
        told = lambda c: F.unhex(F.sha2(tx.normal_key(F.col(c)), 256)).alias(c)
        return materialize(df.select(F.col("id").alias(p), told("body"), told("title"), F.col("evidence_ids").alias("ev")), "memories")

    def two(df: DataFrame, by: str) -> DataFrame:
        low = df.groupBy(by).agg(F.min("k").alias("k"))
        later = df.join(low.withColumnRenamed("k", "low"), by).where("k > low").groupBy(by).agg(F.min("k").alias("k"))
        return low.unionByName(later)

    a, b = shaped(new, "n"), shaped(known, "k")
    same = lambda x, y, by, score: x.select("n", by).join(two(y.select("k", by), by), by).where("n <> k").select("n", "k", F.lit(score).alias("score"))
    cited = lambda df, p: df.select(p, F.explode("ev").alias("e"))
    equal = same(a, b, "body", 950).unionByName(same(a, b, "title", 900)).unionByName(same(cited(a, "n"), cited(b, "k"), "e", 850))
    first = equal.groupBy("n", "score").agg(F.min("k").alias("k")).groupBy("n").agg(F.max_by(F.struct("k", "score"), "score").alias("x")).select("n", "x.k", "x.score")
    first = materialize(first, "equal_memories")
    tokens = lambda df, p: df.select(F.col("id").alias(p), F.transform(tx.claim_terms(F.col("body")), lambda t: F.xxhash64(t)).alias("tokens")).where(F.size("tokens") >= 4)
    wanted = materialize(materialize(tokens(new, "n"), "new_terms").join(first, "n", "left_anti"), "unmatched_terms")
    out = first
    for met in covering(wanted, tokens(known, "k"), 80, 65, 4):
        near = top(met.withColumn("score", (F.lit(700) + F.col("larger")).cast("int")), ["n"], [F.desc("score"), F.col("k")], 1, "r")
        out = out.unionByName(materialize(near.select("n", "k", "score"), "near_memories"))
    return out.select(F.col("n").alias("id"), F.col("k").alias("memory_id"), "score")
