"""Rebuilding graphs, extraction from markdown, origins and corrections over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..operators import documents as dc, extraction as ex, history as hs, rebuild as rb
from .answer_queries import _tokens
from .registry import Tables, query

_EMPTY = "CAST([] AS VARCHAR[])"


# compaction
def _raw_nodes(t: Tables) -> DataFrame:
    """Parts as extracted concepts of their brand; names repeat, and some parts share an evidence."""
    k = F.col("p_partkey")
    refs = F.when(k % 29 == 0, F.expr(rb._NONE)).when(k % 13 == 0, F.array(F.concat(F.lit("e"), k % 40), F.concat(F.lit("retrieved:"), k))).otherwise(F.array(F.concat(F.lit("p"), k)))
    return t.part.select(F.col("p_brand").alias("source_id"), F.concat(F.lit("n"), k).alias("node_id"), F.concat_ws(" ", "p_name", F.when(k % 3 == 0, "s").otherwise(F.concat(F.lit("of "), (k % 50).cast("string")))).alias("label"), F.when(k % 7 == 0, F.array(F.concat_ws(" ", F.lit("The"), "p_type"))).otherwise(F.expr(rb._NONE)).alias("aliases"), refs.alias("evidence_ids"), (F.col("p_size") / 64).alias("confidence"))


def _evidence_rows(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    rows = t.part.select(F.concat(F.lit("p"), k).alias("evidence_id"), (k % 9).alias("page"), (k % 2 == 0).alias("titled"))
    return rows.unionByName(t.part.where("p_partkey < 40").select(F.concat(F.lit("e"), k).alias("evidence_id"), (k % 4).alias("page"), F.lit(True).alias("titled")))


_SINGULAR = "CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END"


def _key(label: str) -> str:
    words = f"list_filter(list_transform(string_split(trim(regexp_replace(lower(trim({label}, ' ')), '[^a-z0-9]+', ' ', 'g'), ' '), ' '), lambda w: {_SINGULAR}), lambda w: w <> '' AND w <> 's')"
    return f"array_to_string(CASE WHEN {words}[1] = 'the' THEN {words}[2:] ELSE {words} END, ' ')"


_COMPACT = f"""
raw AS (SELECT p_brand AS source_id, p_partkey AS k, 'n' || p_partkey AS node_id, p_name || ' ' || CASE WHEN p_partkey % 3 = 0 THEN 's' ELSE 'of ' || (p_partkey % 50) END AS label, CASE WHEN p_partkey % 7 = 0 THEN ['The ' || p_type] ELSE {_EMPTY} END AS aliases,
  CASE WHEN p_partkey % 29 = 0 THEN {_EMPTY} WHEN p_partkey % 13 = 0 THEN ['e' || (p_partkey % 40), 'retrieved:' || p_partkey] ELSE ['p' || p_partkey] END AS ev, p_size / 64 AS confidence FROM part),
own AS (SELECT *, list_sort(list_distinct(list_filter(list_transform(list_concat([label], aliases), lambda x: {_key('x')}), lambda x: x <> ''))) AS keys FROM raw WHERE len(ev) > 0),
by_ AS (SELECT k, source_id || '|k|' || unnest(keys) AS b FROM own UNION SELECT k, source_id || '|e|' || e FROM (SELECT k, source_id, unnest(ev) AS e FROM own) WHERE NOT starts_with(e, 'retrieved:')),
low AS (SELECT b, min(k) AS low FROM by_ GROUP BY 1),
link AS (SELECT DISTINCT k AS a, low AS b FROM by_ JOIN low USING (b) UNION SELECT DISTINCT low, k FROM by_ JOIN low USING (b)),
cc(id, c) USING KEY (id) AS (SELECT k, k FROM own UNION (SELECT l.a, min(v.c) FROM cc v JOIN link l ON l.b = v.id JOIN recurring.cc u ON u.id = l.a WHERE v.c < u.c GROUP BY l.a)),
evi AS (SELECT 'p' || p_partkey AS e, p_partkey % 9 AS page, p_partkey % 2 = 0 AS titled FROM part UNION ALL SELECT 'e' || p_partkey, p_partkey % 4, true FROM part WHERE p_partkey < 40),
refs AS (SELECT k, count(DISTINCT page) AS pages, count(DISTINCT e) FILTER (starts_with(e, 'retrieved:')) AS chunks, count(*) FILTER (titled) AS headings FROM (SELECT k, unnest(ev) AS e FROM own) LEFT JOIN evi USING (e) GROUP BY 1),
deg AS (SELECT l_partkey AS k, count(*) AS degree FROM lineitem WHERE l_quantity > 40 GROUP BY 1),
sal AS (SELECT own.*, c, 5 * len(ev) + 3 * pages + 2 * chunks + least(headings, 3) + 2 * least(coalesce(degree, 0), 8) + len(aliases) + CAST(floor(4 * confidence) AS INT)
  - CASE WHEN len(string_split(keys[1], ' ')) = 1 AND len(ev) <= 1 THEN 2 ELSE 0 END - greatest(len(string_split(keys[1], ' ')) - 6, 0) AS s FROM own JOIN cc ON cc.id = own.k JOIN refs USING (k) LEFT JOIN deg USING (k)),
mg AS (SELECT source_id, c, arg_min(label, (length(trim(label, ' ')), label)) AS label, list_sort(list_distinct(flatten(list(list_concat([label], aliases))))) AS al, list_sort(list_distinct(flatten(list(keys)))) AS keys, list_sort(list_distinct(flatten(list(ev)))) AS ev, list_sort(list(node_id)) AS raw_ids, max(confidence) AS confidence, sum(s) AS score FROM sal GROUP BY 1, 2),
nm AS (SELECT *, 'concept:' || source_id || ':' || regexp_replace(keys[1], '[^a-z0-9]+', '-', 'g') AS node_id FROM mg),
cn AS (SELECT source_id, node_id, raw_ids, label, list_filter(al, lambda x: trim(x, ' ') <> label)[1:8] AS aliases, ev[1:8] AS evidence_ids, confidence, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, len(ev) DESC, label, node_id) AS rank FROM nm),
kept AS (SELECT * FROM cn WHERE rank <= 18)"""


def _concepts(t: Tables) -> DataFrame:
    degree = t.lineitem.where("l_quantity > 40").groupBy(F.concat(F.lit("n"), "l_partkey").alias("node_id")).agg(F.count("*").alias("degree"))
    return rb.compacted_nodes(_raw_nodes(t), _evidence_rows(t), degree)


@query(f"WITH RECURSIVE {_COMPACT} SELECT source_id, node_id, raw_ids, label, aliases, evidence_ids, round(confidence, 6) AS confidence, score, CAST(rank AS INT) AS rank FROM cn")
def compaction_nodes(t: Tables) -> DataFrame:
    return _concepts(t).withColumn("confidence", F.round("confidence", 6))


_RELATIONS = "rel AS (SELECT p_brand AS source_id, CASE l_linenumber % 3 WHEN 0 THEN 'related_to' WHEN 1 THEN 'supports' ELSE 'same_as' END AS kind, 'n' || l_partkey AS src, 'n' || ((l_partkey + 25 * (l_suppkey % 7 + 1)) % (SELECT count(*) FROM part)) AS dst, CASE WHEN l_orderkey % 17 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['o' || l_orderkey] END AS ev, l_discount AS confidence FROM lineitem JOIN part ON p_partkey = l_partkey)"


@query(f"""WITH RECURSIVE {_COMPACT}, {_RELATIONS},
nm2 AS (SELECT source_id, unnest(raw_ids) AS raw, node_id, score FROM kept),
m AS (SELECT r.*, a.node_id AS x, b.node_id AS y, 4 * len(ev) + CASE kind WHEN 'related_to' THEN 1 ELSE 4 END + CAST(floor(4 * confidence) AS INT) + (a.score + b.score) // 10 AS worth FROM rel r JOIN nm2 a ON a.source_id = r.source_id AND a.raw = src JOIN nm2 b ON b.source_id = r.source_id AND b.raw = dst WHERE len(ev) > 0 AND a.node_id <> b.node_id),
o AS (SELECT source_id, kind, CASE WHEN kind IN ('related_to', 'same_as') AND x > y THEN y ELSE x END AS src, CASE WHEN kind IN ('related_to', 'same_as') AND x > y THEN x ELSE y END AS dst, ev, confidence, worth FROM m),
g AS (SELECT source_id, kind, src, dst, list_sort(list_distinct(flatten(list(ev)))) AS ev, max(confidence) AS confidence, CAST(sum(worth) AS BIGINT) AS score, 'rel-' || kind || '-' || regexp_replace(lower(src), '[^a-z0-9]+', '-', 'g') || '-' || regexp_replace(lower(dst), '[^a-z0-9]+', '-', 'g') AS relation_id FROM o GROUP BY 1, 2, 3, 4),
rk AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, len(ev) DESC, relation_id) AS rank FROM g)
SELECT source_id, relation_id, kind, src, dst, ev[1:6] AS evidence_ids, round(confidence, 6) AS confidence, score, CAST(rank AS INT) AS rank FROM rk JOIN (SELECT source_id, 48 - count(*) AS room FROM kept GROUP BY 1) USING (source_id) WHERE rank <= room""")
def compaction_relations(t: Tables) -> DataFrame:
    n = t.part.agg(F.count("*").alias("parts"))
    kind = F.when(F.col("l_linenumber") % 3 == 0, "related_to").when(F.col("l_linenumber") % 3 == 1, "supports").otherwise("same_as")
    other = (F.col("l_partkey") + 25 * (F.col("l_suppkey") % 7 + 1)) % F.col("parts")
    rows = t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey")).join(F.broadcast(n)).select(F.col("p_brand").alias("source_id"), kind.alias("kind"), F.concat(F.lit("n"), "l_partkey").alias("src"), F.concat(F.lit("n"), other).alias("dst"), F.when(F.col("l_orderkey") % 17 == 0, F.expr(rb._NONE)).otherwise(F.array(F.concat(F.lit("o"), "l_orderkey"))).alias("evidence_ids"), F.col("l_discount").alias("confidence"))
    return rb.compacted_relations(rows, _concepts(t).where(F.col("rank") <= rb.TARGET_CONCEPTS)).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH RECURSIVE {_COMPACT},
cl AS (SELECT p_brand AS source_id, 'c' || p_partkey AS claim_id, p_partkey % 500 AS place, ['n' || p_partkey, 'n' || (p_partkey + 25)] AS topics FROM part WHERE p_partkey % 5 <> 0),
m AS (SELECT DISTINCT cl.source_id, claim_id, place, kept.node_id FROM (SELECT source_id, claim_id, place, unnest(topics) AS topic FROM cl) cl JOIN (SELECT source_id, unnest(raw_ids) AS raw, node_id FROM kept) kept ON kept.source_id = cl.source_id AND raw = topic),
g AS (SELECT source_id, claim_id, place, list_sort(list(node_id)) AS topic_refs FROM m GROUP BY 1, 2, 3)
SELECT source_id, claim_id, place, topic_refs FROM g QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY place, claim_id) <= 12""")
def compaction_claims(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    claims = t.part.select(F.col("p_brand").alias("source_id"), F.concat(F.lit("c"), k).alias("claim_id"), (k % 500).alias("place"), F.array(F.concat(F.lit("n"), k), F.concat(F.lit("n"), k + 25)).alias("topic_refs"), F.when(k % 5 == 0, F.expr(rb._NONE)).otherwise(F.array(F.lit("e"))).alias("evidence_refs"))
    return rb.compacted_claims(claims, _concepts(t).where(F.col("rank") <= rb.TARGET_CONCEPTS))


@query(f"""
WITH n AS (SELECT p_brand AS source_id, 'n' || p_partkey AS node_id, CASE WHEN p_partkey % 4 = 0 THEN {_EMPTY} ELSE ['e' || p_partkey] END AS ev FROM part),
l AS (SELECT DISTINCT p_brand AS source_id, 'n' || p_partkey AS node_id FROM part WHERE p_size > 30), a AS (SELECT p_brand AS source_id, list_sort(list(DISTINCT 's' || (p_size % 4))) AS every FROM part WHERE p_size < 6 GROUP BY 1),
m AS (SELECT n.source_id, n.node_id, CASE WHEN len(ev) > 0 THEN ev ELSE coalesce(every, {_EMPTY}) END AS evidence_ids FROM n ANTI JOIN l USING (source_id, node_id) LEFT JOIN a ON a.source_id = n.source_id)
SELECT source_id, 'rel-source_of-' || regexp_replace(lower(source_id), '[^a-z0-9]+', '-', 'g') || '-' || node_id AS relation_id, node_id, evidence_ids FROM m WHERE len(evidence_ids) > 0""")
def source_edges(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.lit("n"), k)
    nodes = t.part.select(F.col("p_brand").alias("source_id"), name.alias("node_id"), F.when(k % 4 == 0, F.expr(rb._NONE)).otherwise(F.array(F.concat(F.lit("e"), k))).alias("evidence_ids"))
    linked = t.part.where("p_size > 30").select(F.col("p_brand").alias("source_id"), F.lit("source_of").alias("kind"), name.alias("dst"))
    evidence = t.part.where("p_size < 6").select(F.col("p_brand").alias("source_id"), F.concat(F.lit("s"), F.col("p_size") % 4).alias("evidence_id"))
    return rb.source_edges(nodes, linked, evidence)


# checks
@query("""
WITH r AS (SELECT 'node' AS kind, 'n' || p_partkey AS id, 'source' AS refers_to, 's' || (p_partkey % 120) AS missing FROM part UNION SELECT 'node', 'n' || p_partkey, 'evidence', 'e' || (p_size * 3) FROM part
  UNION SELECT 'relation', CAST(l_orderkey AS VARCHAR), 'node', 'n' || l_partkey FROM lineitem),
k AS (SELECT 'source' AS refers_to, 's' || s_suppkey AS missing FROM supplier UNION SELECT 'evidence', 'e' || n_nationkey FROM nation UNION SELECT 'node', 'n' || p_partkey FROM part WHERE p_size < 48)
SELECT * FROM r ANTI JOIN k USING (refers_to, missing)""")
def missing_references(t: Tables) -> DataFrame:
    nodes = t.part.select(F.concat(F.lit("n"), "p_partkey").alias("id"), F.array(F.concat(F.lit("s"), F.col("p_partkey") % 120)).alias("source_refs"), F.array(F.concat(F.lit("e"), F.col("p_size") * 3)).alias("evidence_refs"))
    relations = t.lineitem.select(F.col("l_orderkey").alias("id"), F.array(F.concat(F.lit("n"), "l_partkey")).alias("node_refs"))
    known = {"source": t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id")), "evidence": t.nation.select(F.concat(F.lit("e"), "n_nationkey").alias("id")), "node": t.part.where("p_size < 48").select(F.concat(F.lit("n"), "p_partkey").alias("id"))}
    return rb.missing_references({"node": nodes, "relation": relations}, known).select("kind", "id", "refers_to", "missing")


_FAULTS = """
so AS (SELECT DISTINCT 'b' || p_size AS s FROM part WHERE p_size > 3), ba AS (SELECT DISTINCT 'b' || p_size AS s FROM part WHERE p_size < 49),
no AS (SELECT 'n' || p_partkey AS id, p_partkey % 6 <> 0 AS grounded FROM part UNION ALL SELECT DISTINCT 'source:b' || p_size, true FROM part WHERE p_size % 10 <> 7),
fa AS (SELECT 'source_unknown' AS fault, s AS id FROM so ANTI JOIN ba USING (s) UNION ALL SELECT 'source_missing', s FROM ba ANTI JOIN so USING (s)
  UNION ALL SELECT 'source_node_missing', 'source:' || s FROM so WHERE 'source:' || s NOT IN (SELECT id FROM no) UNION ALL SELECT 'not_grounded', id FROM no WHERE NOT grounded AND NOT starts_with(id, 'source:')
  UNION ALL SELECT 'not_linked', id FROM no WHERE NOT starts_with(id, 'source:') AND id NOT IN (SELECT 'n' || p_partkey FROM part WHERE p_size > 2))"""


def _faults(t: Tables) -> DataFrame:
    source = F.concat(F.lit("b"), "p_size")
    own = t.part.select(F.concat(F.lit("n"), "p_partkey").alias("node_id"), F.expr(rb._NONE).alias("source_refs"), F.when(F.col("p_partkey") % 6 != 0, F.array(F.lit("e"))).otherwise(F.expr(rb._NONE)).alias("evidence_refs"))
    roots = t.part.where("p_size % 10 <> 7").select(F.concat(F.lit("source:"), source).alias("node_id")).distinct().select("node_id", F.expr(rb._NONE).alias("source_refs"), F.array(F.lit("e")).alias("evidence_refs"))
    links = t.part.where("p_size > 2").select(F.concat(F.lit("source:"), source).alias("src"), F.concat(F.lit("n"), "p_partkey").alias("dst"))
    return rb.snapshot_faults(t.part.where("p_size > 3").select(source.alias("source_id")), t.part.where("p_size < 49").select(source.alias("source_id")), own.unionByName(roots), links)


@query(f"WITH {_FAULTS} SELECT * FROM fa")
def snapshot_validation(t: Tables) -> DataFrame:
    return _faults(t)


@query(f"WITH {_FAULTS} SELECT * FROM fa ORDER BY list_position(['source_missing', 'source_unknown', 'source_node_missing', 'not_grounded', 'not_linked'], fault), id LIMIT 1")
def snapshot_first_fault(t: Tables) -> DataFrame:
    return rb.first_fault(_faults(t), ["source_missing", "source_unknown", "source_node_missing", "not_grounded", "not_linked"])


# origins
_RECORDS = """
rec AS (SELECT CASE l_linenumber % 4 WHEN 0 THEN 'relation' WHEN 1 THEN 'claim' WHEN 2 THEN 'memory' ELSE 'wiki' END AS kind, l_orderkey || '-' || l_linenumber AS id, l_orderkey, l_linenumber, list('s' || (l_suppkey % 40) ORDER BY l_suppkey) AS s, list('e' || l_partkey ORDER BY l_partkey) AS e, list('n' || (l_partkey % 30) ORDER BY l_partkey) AS n
  FROM (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_suppkey + 1, (l_partkey + l_suppkey) % (SELECT count(*) FROM part) FROM lineitem WHERE l_quantity > 10) GROUP BY 1, 2, 3, 4),
evs AS (SELECT 'e' || p_partkey AS ev, 's' || (p_partkey % 40) AS source_id FROM part WHERE p_size < 48)"""


def _linked_records(t: Tables) -> DataFrame:
    n = t.part.agg(F.count("*").alias("parts"))
    base = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    more = t.lineitem.where("l_quantity > 10").join(F.broadcast(n)).select("l_orderkey", "l_linenumber", (F.col("l_suppkey") + 1).alias("l_suppkey"), ((F.col("l_partkey") + F.col("l_suppkey")) % F.col("parts")).alias("l_partkey"))
    k = F.col("l_linenumber") % 4
    lists = lambda p, c: F.collect_list(F.concat(F.lit(p), c))
    made = base.unionByName(more).groupBy("l_orderkey", "l_linenumber").agg(lists("s", F.col("l_suppkey") % 40).alias("source_refs"), lists("e", F.col("l_partkey")).alias("evidence_refs"), lists("n", F.col("l_partkey") % 30).alias("node_refs"))
    return made.select(F.when(k == 0, "relation").when(k == 1, "claim").when(k == 2, "memory").otherwise("wiki").alias("kind"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "source_refs", "evidence_refs", "node_refs", "l_orderkey")


@query(f"""WITH {_RECORDS},
prev AS (SELECT kind, id, 'ev' || (l_orderkey % 7) AS event_id FROM rec WHERE l_orderkey % 3 <> 0), fresh AS (SELECT kind, id FROM rec WHERE l_orderkey % 11 = 0),
own AS (SELECT rec.*, event_id FROM rec JOIN prev USING (kind, id) ANTI JOIN fresh USING (kind, id)),
known AS (SELECT 'source' AS k, 's' || i AS id FROM range(0, 38) t(i) UNION SELECT 'evidence', ev FROM evs UNION SELECT 'node', 'n' || i FROM range(0, 29) t(i)),
r AS (SELECT kind, id, 'source' AS k, unnest(s) AS ref FROM own UNION ALL SELECT kind, id, 'evidence', unnest(e) FROM own UNION ALL SELECT kind, id, 'node', unnest(n) FROM own),
bad AS (SELECT DISTINCT kind, id FROM r WHERE (k, ref) NOT IN (SELECT (k, id) FROM known)),
sp AS (SELECT kind, id, count(DISTINCT source_id) AS spans FROM r JOIN evs ON k = 'evidence' AND ev = ref GROUP BY 1, 2)
SELECT own.kind, own.id, event_id FROM own JOIN sp USING (kind, id) WHERE spans > 1 AND (own.kind = 'relation' OR len(list_distinct(s)) > 1) AND (own.kind, own.id) NOT IN (SELECT (kind, id) FROM bad)""")
def carried_origins(t: Tables) -> DataFrame:
    rows = _linked_records(t)
    previous = rows.where("l_orderkey % 3 <> 0").select("kind", "id", F.concat(F.lit("ev"), F.col("l_orderkey") % 7).alias("event_id"), F.lit("workspace_linking").alias("operation")).unionByName(rows.where("l_orderkey % 3 = 0").select("kind", "id", F.lit("x").alias("event_id"), F.lit("graph_materialized").alias("operation")))
    evidence = t.part.where("p_size < 48").select(F.concat(F.lit("e"), "p_partkey").alias("evidence_id"), F.concat(F.lit("s"), F.col("p_partkey") % 40).alias("source_id"))
    known = t.spark.range(38).select(F.lit("source").alias("kind"), F.concat(F.lit("s"), "id").alias("id")).unionByName(evidence.select(F.lit("evidence").alias("kind"), F.col("evidence_id").alias("id"))).unionByName(t.spark.range(29).select(F.lit("node").alias("kind"), F.concat(F.lit("n"), "id").alias("id")))
    return rb.carried_origins(rows.drop("l_orderkey"), previous, rows.where("l_orderkey % 11 = 0"), evidence, known)


@query(f"""WITH {_RECORDS},
r AS (SELECT kind, id, source_id FROM (SELECT kind, id, unnest(e) AS ev FROM rec) LEFT JOIN evs USING (ev)),
g AS (SELECT kind, id, count(DISTINCT source_id) AS spans, bool_or(source_id IS NULL) AS stale FROM r GROUP BY 1, 2)
SELECT kind, id, stale FROM g WHERE spans > 1 AND (kind, id) NOT IN (SELECT (kind, id) FROM rec WHERE l_orderkey % 4 = 0)""")
def legacy_origins(t: Tables) -> DataFrame:
    rows = _linked_records(t)
    evidence = t.part.where("p_size < 48").select(F.concat(F.lit("e"), "p_partkey").alias("evidence_id"), F.concat(F.lit("s"), F.col("p_partkey") % 40).alias("source_id"))
    return rb.legacy_origins(rows, evidence, rows.where("l_orderkey % 4 = 0"))


@query("""SELECT DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN 'node' ELSE 'claim' END AS kind, 'p' || l_partkey AS id FROM lineitem WHERE l_returnflag <> 'R'""")
def cleanup_scope(t: Tables) -> DataFrame:
    record = F.struct(F.when(F.col("l_linenumber") % 2 == 0, "node").otherwise("claim").alias("kind"), F.concat(F.lit("p"), "l_partkey").alias("id"))
    events = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.collect_set(record).alias("records")).select(F.when(F.col("l_returnflag") == "R", "workspace_linking").when(F.col("l_returnflag") == "A", "graph_materialized").alias("operation"), "records")
    return rb.cleanup_scope(events)


@query("""
WITH n AS (SELECT p_partkey AS k, 'concept:' || lower(p_brand) || ':' || replace(p_name, ' ', CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE '_' END) AS node_id, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'source-12' WHEN 2 THEN p_type WHEN 3 THEN 'concept:' || p_name ELSE NULL END AS label, CASE WHEN p_partkey % 3 = 0 THEN [' concept:x', ' ' || p_type || ' '] ELSE CAST([] AS VARCHAR[]) END AS aliases FROM part)
SELECT node_id, CASE WHEN k % 5 = 2 THEN label WHEN k % 3 = 0 THEN trim(aliases[2], ' ') ELSE array_to_string(list_transform(list_filter(regexp_split_to_array(string_split(node_id, ':')[3], '[-_]'), lambda x: x <> ''), lambda x: upper(x[1]) || x[2:]), ' ') END AS label, aliases FROM n""")
def readable_labels(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    node = F.concat(F.lit("concept:"), F.lower("p_brand"), F.lit(":"), F.when(k % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("-"))).otherwise(F.replace("p_name", F.lit(" "), F.lit("_"))))
    label = F.when(k % 5 == 0, "").when(k % 5 == 1, "source-12").when(k % 5 == 2, F.col("p_type")).when(k % 5 == 3, F.concat(F.lit("concept:"), "p_name"))
    aliases = F.when(k % 3 == 0, F.array(F.lit(" concept:x"), F.concat(F.lit(" "), "p_type", F.lit(" ")))).otherwise(F.expr(rb._NONE))
    return rb.readable_labels(t.part.select(node.alias("node_id"), label.alias("label"), aliases.alias("aliases")))


# corrections
_SPLIT = """'[{"label":"Left half","node_id":"left","aliases":[],"evidence_ids":["e1","e2"],"edge_ids":[]},{"label":" ","node_id":"left","aliases":["x"],"evidence_ids":["e9"],"edge_ids":["r3"]},{"label":"Empty","node_id":"n4","evidence_ids":[]},{"label":"Self","node_id":"n7","evidence_ids":["e3"]}]'"""


def _split(t: Tables) -> DataFrame:
    return t.spark.range(1).select(F.explode(rb.parse_split(F.lit(_SPLIT[1:-1]))).alias("p")).select("p.*")


def _nation_nodes(t: Tables) -> DataFrame:
    n = F.col("n_nationkey")
    return t.nation.select(F.concat(F.lit("n"), n).alias("node_id"), F.col("n_name").alias("label"), F.array(F.lit("e1"), F.lit("e2"), F.lit("e3")).alias("evidence_ids"))


@query("""SELECT * FROM (VALUES (' ', 'blank_label'), ('Empty', 'no_evidence'), (' ', 'foreign_evidence'), ('Left half', 'id_twice'), ('Empty', 'id_taken'), ('Self', 'original_id')) v(label, fault)""")
def split_validation(t: Tables) -> DataFrame:
    return rb.split_faults(_split(t), _nation_nodes(t), "n7")


_NATION_EDGES = "ed AS (SELECT 'r' || n_nationkey AS edge_id, 'n' || n_nationkey AS src, 'n' || ((n_nationkey * 3 + 1) % 25) AS dst, 'related_to' AS kind, ['e' || (n_nationkey % 5)] AS ev FROM nation UNION ALL SELECT 't' || n_nationkey, 'n7', 'n' || n_nationkey, 'x', ['e' || (n_nationkey % 5)] FROM nation)"


@query(f"""WITH {_NATION_EDGES},
pt AS (SELECT * FROM (VALUES ('left', ['e1', 'e2'], CAST([] AS VARCHAR[])), ('right', ['e3'], ['r3', 't5'])) v(p, pe, pr)),
m AS (SELECT CASE WHEN src = 'n7' THEN p ELSE src END AS src, CASE WHEN dst = 'n7' THEN p ELSE dst END AS dst, kind, ev FROM ed, pt WHERE (src = 'n7' OR dst = 'n7') AND CASE WHEN len(pr) > 0 THEN list_contains(pr, edge_id) ELSE list_has_any(pe, ev) END)
SELECT edge_id, src, dst, kind, ev AS evidence_ids FROM ed WHERE src <> 'n7' AND dst <> 'n7' UNION ALL SELECT 'edge-' || src || '-' || dst, src, dst, kind, ev FROM m WHERE src <> dst""")
def correction_split(t: Tables) -> DataFrame:
    """Edges after a split, of which one part names its edges and the other takes those it shares evidence with."""
    n = F.col("n_nationkey")
    name = lambda c: F.concat(F.lit("n"), c)
    ref = F.array(F.concat(F.lit("e"), n % 5))
    edges = t.nation.select(F.concat(F.lit("r"), n).alias("edge_id"), name(n).alias("src"), name((n * 3 + 1) % 25).alias("dst"), F.lit("related_to").alias("kind"), ref.alias("evidence_ids")).unionByName(t.nation.select(F.concat(F.lit("t"), n).alias("edge_id"), F.lit("n7").alias("src"), name(n).alias("dst"), F.lit("x").alias("kind"), ref.alias("evidence_ids")))
    parts = t.spark.createDataFrame([("left", ["e1", "e2"], None), ("right", ["e3"], ["r3", "t5"])], "node_id string, evidence_ids array<string>, edge_ids array<string>")
    return rb.split_edges(edges, parts, "n7")


@query("""
WITH n AS (SELECT 'n' || n_nationkey AS id, n_name AS label, ['a' || n_regionkey] AS al, ['e' || n_nationkey] AS ev, n_nationkey / 25 AS c FROM nation)
SELECT CASE id WHEN 'n1' THEN 'concept-first-name' ELSE id END AS node_id, CASE id WHEN 'n1' THEN 'First Name' ELSE label END AS label, CASE id WHEN 'n1' THEN list_sort(list_concat(al, [label])) WHEN 'n5' THEN list_sort(list_distinct(list_concat(list_concat(al, ['a2']), ['NATION_2']))) WHEN 'n6' THEN CAST([] AS VARCHAR[]) ELSE al END AS aliases,
  CASE id WHEN 'n5' THEN ['e2', 'e5'] ELSE ev END AS evidence_ids, CASE id WHEN 'n5' THEN least(c, 0.94) ELSE c END AS confidence FROM n WHERE id NOT IN ('n2', 'n9')
UNION ALL SELECT 'concept-' || al[1], al[1], CAST([] AS VARCHAR[]), ev, least(c, 0.82) FROM n WHERE id = 'n6'""")
def corrections_in_order(t: Tables) -> DataFrame:
    """A workspace's list of corrections, applied one after the other."""
    n = F.col("n_nationkey")
    nodes = t.nation.select(F.concat(F.lit("n"), n).alias("node_id"), F.col("n_name").alias("label"), F.array(F.concat(F.lit("a"), "n_regionkey")).alias("aliases"), F.array(F.concat(F.lit("e"), n)).alias("evidence_ids"), (n / 25).alias("confidence"))
    edges = t.nation.select(F.concat(F.lit("n"), n).alias("src"), F.concat(F.lit("n"), (n + 1) % 25).alias("dst"), F.lit("x").alias("kind"))
    steps = [{"kind": "rename", "node_id": "n1", "label": "First Name"}, {"kind": "merge", "node_id": "n2", "target": "n5"}, {"kind": "keep_separate", "node_id": "n6"}, {"kind": "delete", "node_id": "n9"}]
    return rb.corrected(nodes, edges, steps)[0].select("node_id", "label", "aliases", "evidence_ids", "confidence")


@query("""
SELECT 'n' || n_nationkey AS node_id, n_name AS label, coalesce(d, 0) AS degree, 1 AS n_evidence, 1 AS n_sources FROM nation LEFT JOIN (SELECT k, count(*) AS d FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1) ON k = n_nationkey""")
def refreshed_counts(t: Tables) -> DataFrame:
    nodes = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.col("n_name").alias("label"), F.array(F.lit("e")).alias("evidence_ids"), F.array(F.lit("s"), F.lit("s")).alias("source_ids"))
    edges = t.customer.select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst")).unionByName(t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst")))
    return rb.refreshed(nodes, edges)


@query("""
WITH s AS (SELECT c_custkey AS source_id, c_mktsegment AS model, CASE WHEN c_nationkey = 3 THEN 0 ELSE 10 END AS n FROM customer), r AS (SELECT o_custkey AS source_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'BUILDING' WHEN '2-HIGH' THEN 'MACHINERY' ELSE 'AUTOMOBILE' END AS model, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'running' ELSE 'failed' END AS status FROM orders),
g AS (SELECT s.source_id, max(n) AS n, bool_or(status = 'done') AS done, bool_or(status = 'running') AS running FROM s LEFT JOIN r ON r.source_id = s.source_id AND r.model = s.model GROUP BY 1)
SELECT source_id, CASE WHEN n = 0 THEN 'skip_empty' WHEN done THEN 'reuse' WHEN running THEN 'wait' ELSE 'run' END AS decision FROM g""")
def rebuild_gate(t: Tables) -> DataFrame:
    sources = t.customer.select(F.col("c_custkey").alias("source_id"), F.col("c_mktsegment").alias("model"), F.when(F.col("c_nationkey") == 3, 0).otherwise(10).alias("n_chars"))
    model = F.when(F.col("o_orderpriority") == "1-URGENT", "BUILDING").when(F.col("o_orderpriority") == "2-HIGH", "MACHINERY").otherwise("AUTOMOBILE")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "running").otherwise("failed")
    return rb.gates(sources, t.orders.select(F.col("o_custkey").alias("source_id"), model.alias("model"), status.alias("status")), ["model"])


@query("""
WITH n AS (SELECT DISTINCT 'n' || p_partkey AS node_id, lower(split_part(p_name, ' ', 1)) AS name, ['src' || (p_partkey % 20), 'src3'] AS s FROM part), w AS (SELECT DISTINCT unnest(s) AS source, name FROM n),
m AS (SELECT doc_id, source, count(*) AS names FROM documents JOIN w USING (source) WHERE contains(lower(text || ' ' || CASE WHEN doc_id % 4 = 0 THEN 'Red hot' ELSE 'small' END), name) GROUP BY 1, 2),
f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY source ORDER BY names DESC, doc_id) <= 4)
SELECT doc_id AS chunk_id, source AS source_id, names, CAST(row_number() OVER (ORDER BY names DESC, doc_id) AS INT) AS rank FROM f QUALIFY rank <= 24""")
def linking_chunks(t: Tables) -> DataFrame:
    nodes = t.part.select(F.concat(F.lit("n"), "p_partkey").alias("node_id"), F.split("p_name", " ")[0].alias("label"), F.array(F.concat(F.lit("src"), F.col("p_partkey") % 20), F.lit("src3")).alias("source_ids"))
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_id"), F.concat_ws(" ", "text", F.when(F.col("doc_id") % 4 == 0, "Red hot").otherwise("small")).alias("text"))
    return rb.linking_chunks(chunks, nodes, nodes)


# extraction
_MARKDOWN = r"""md AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN '---' || chr(10) || 'k: v' || chr(10) || '---' || chr(10) ELSE '' END || '## The ' || source || ' report of things' || chr(10) || '1. In the ' || lang || ' language (many words) we read' || chr(10) || 'See [the guide](docs/' || source || '.md) depends on alpha beta.' || chr(10) || text AS text FROM documents)"""


def _markdown(t: Tables) -> DataFrame:
    front = F.when(F.col("doc_id") % 6 == 0, "---\nk: v\n---\n").otherwise("")
    body = F.concat(front, F.lit("## The "), "source", F.lit(" report of things\n1. In the "), "lang", F.lit(" language (many words) we read\nSee [the guide](docs/"), "source", F.lit(".md) depends on alpha beta.\n"), "text")
    return t.documents.select("doc_id", body.alias("text"))


_LEADING = "[" + ", ".join(f"'{w}'" for w in ex.LEADING) + "]"
_CONCEPTS = rf"""
cl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM md),
cb AS (SELECT doc_id, k, CASE WHEN b = '' OR regexp_matches(b, '^(!\[|_AI analysis unavailable|# |## Page )') THEN '' ELSE regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '^#+', ''), '^-+', ''), '^\*+', ''), '^[0-9.)]+', ''), ' '), '[`*]', '', 'g') END AS c FROM (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS b FROM cl)),
cw AS (SELECT doc_id, k, list_filter(list_transform(regexp_split_to_array(trim(regexp_split_to_array(c, '[.:;()\[\]]')[1], ' '), '\s+'), lambda w: regexp_replace(w, '^[^\p{{L}}\p{{N}}/-]+|[^\p{{L}}\p{{N}}/-]+$', '', 'g')), lambda w: w <> '') AS w FROM cb),
cf AS (SELECT *, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains({_LEADING}, lower(w[i])))[1] AS f FROM cw),
cp AS (SELECT doc_id, k, array_to_string(w[f:f + 5], ' ') AS label, len(w) - f + 1 AS rest FROM cf WHERE f IS NOT NULL),
ck AS (SELECT doc_id, k, label, regexp_replace(regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS concept FROM cp WHERE rest >= 2 AND octet_length(encode(label)) >= 10),
c1 AS (SELECT * FROM ck QUALIFY row_number() OVER (PARTITION BY doc_id, concept ORDER BY k) = 1),
con AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS rank, label, concept FROM c1)"""


@query(f"WITH {_MARKDOWN}, {_CONCEPTS} SELECT doc_id, CAST(rank AS INT) AS rank, label, concept FROM con WHERE rank <= 3")
def concept_candidates(t: Tables) -> DataFrame:
    return ex.concepts(_markdown(t), ["doc_id"], "text")


_CLAIM_LINES = rf"""
ml AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM md),
mk AS (SELECT doc_id, CASE WHEN trim(ls[1], ' ') = '---' AND list_position(ls[2:], '---') > 0 THEN list_position(ls[2:], '---') + 1 ELSE 0 END AS skip, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS k FROM ml),
ms AS (SELECT doc_id, k, trim(regexp_replace(trim(line, ' '), '^([-*+]|[0-9]+[.)])\s+', ''), ' ') AS s FROM mk WHERE k >= skip AND NOT regexp_matches(trim(line, ' '), '^(#|!\[|$)')),
mc AS (SELECT *, left(regexp_replace(regexp_replace(lower(s), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80) AS ckey FROM ms WHERE len(regexp_split_to_array(s, '\s+')) >= 3),
m1 AS (SELECT * FROM mc WHERE ckey <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, ckey ORDER BY k) = 1),
clm AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS rank, k + 1 AS line_no, s AS statement, ckey AS claim_key FROM m1 QUALIFY rank <= 32)"""
_DECISION = "CASE WHEN len(list_filter([" + ", ".join(f"'{w}'" for w in tx.DECISIONS) + "], lambda m: contains(' ' || lower(statement) || ' ', m))) > 0 THEN 'decision' ELSE 'durable_fact' END"


@query(f"WITH {_MARKDOWN}, {_CLAIM_LINES} SELECT doc_id, CAST(rank AS INT) AS rank, CAST(line_no AS INT) AS line_no, statement, claim_key, {_DECISION} AS kind FROM clm")
def claim_candidates(t: Tables) -> DataFrame:
    return ex.claim_lines(_markdown(t), "doc_id", "text")


_NAMES = ["alpha", "beta", "guide", "report", "the", "docs", "md"]
_CUES = "CASE " + " ".join(f"WHEN regexp_matches(lower(s), '{'|'.join(c)}') THEN '{k}'" for k, c in tx.RELATION_CUES) + " END"
_RELATION_LINES = f"""
rs AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?\\n]')) AS s, generate_subscripts(regexp_split_to_array(text, '[.!?\\n]'), 1) AS at_ FROM md),
rk AS (SELECT *, {_CUES} AS kind FROM rs), rw AS (SELECT doc_id, at_, kind, list_filter(regexp_split_to_array(lower(s), '[^a-z0-9]+'), lambda w: list_contains({_NAMES!r}, w)) AS seen FROM rk WHERE kind IS NOT NULL),
rp AS (SELECT doc_id, at_, kind, seen[1] AS src, seen[2] AS dst FROM rw WHERE len(seen) >= 2 AND seen[1] <> seen[2]),
r1 AS (SELECT * FROM rp QUALIFY row_number() OVER (PARTITION BY doc_id, src, dst, kind ORDER BY at_) = 1),
rel AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY at_, src, dst) AS rank, src, dst, kind FROM r1 QUALIFY rank <= 32)"""


def _names(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(n,) for n in _NAMES], "name string")


@query(f"WITH {_MARKDOWN}, {_RELATION_LINES} SELECT doc_id, CAST(rank AS INT) AS rank, src, dst, kind FROM rel")
def relation_candidates(t: Tables) -> DataFrame:
    return ex.relation_lines(_markdown(t), "doc_id", "text", _names(t))


@query(f"""WITH {_MARKDOWN}, {_CONCEPTS}, {_CLAIM_LINES}, {_RELATION_LINES},
a AS (SELECT doc_id, list(concept ORDER BY rank) AS concepts FROM con WHERE rank <= 20 GROUP BY 1), b AS (SELECT doc_id, list(claim_key ORDER BY rank) AS claims FROM clm GROUP BY 1), c AS (SELECT doc_id, list(src || ' ' || kind || ' ' || dst ORDER BY rank) AS relations FROM rel GROUP BY 1)
SELECT doc_id, coalesce(concepts, {_EMPTY}) AS concepts, coalesce(claims, {_EMPTY}) AS claims, coalesce(relations, {_EMPTY}) AS relations FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)""")
def extraction_artifact(t: Tables) -> DataFrame:
    return ex.artifact(_markdown(t), "doc_id", "text", _names(t))


_WEIGHTS = rf"""
kl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM md),
kh AS (SELECT doc_id, length(regexp_extract(line, '^(#+)', 1)) AS level, regexp_replace(line, '^#+', '') AS said FROM kl WHERE regexp_matches(line, '^#{{1,6}}\s+\S')),
kk AS (SELECT doc_id, unnest(regexp_extract_all(text, '\[([^\]]+)\]\(([^)\s]+)\)', 1)) AS label, unnest(regexp_extract_all(text, '\[([^\]]+)\]\(([^)\s]+)\)', 2)) AS target FROM md),
kw AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({_tokens('text')}) AS term FROM md) WHERE length(term) >= 4 GROUP BY 1, 2 HAVING count(*) >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, term) <= 16),
ka AS (SELECT doc_id, unnest({_tokens('source')}) AS term, 8 AS weight FROM documents UNION ALL SELECT doc_id, unnest({_tokens('said')}), 7 FROM kh WHERE level = 1 UNION ALL SELECT doc_id, unnest({_tokens('said')}), 5 FROM kh WHERE level > 1
  UNION ALL SELECT doc_id, unnest({_tokens('label')}), 4 FROM kk UNION ALL SELECT doc_id, unnest({_tokens('target')}), 3 FROM kk UNION ALL SELECT doc_id, term, least(n, 4) FROM kw),
wt AS (SELECT doc_id, term, CAST(sum(weight) AS BIGINT) AS weight FROM ka GROUP BY 1, 2)"""


def _weights(t: Tables) -> DataFrame:
    rows = _markdown(t).join(t.documents.select("doc_id", "source"), "doc_id")
    return ex.keyword_weights(rows, "doc_id", F.col("source"), "text")


@query(f"WITH {_MARKDOWN}, {_WEIGHTS} SELECT * FROM wt")
def signal_weights(t: Tables) -> DataFrame:
    return _weights(t)


@query(f"""WITH {_MARKDOWN}, {_WEIGHTS},
wk AS (SELECT 'w' || source AS page_id, 'wiki/' || source AS path, source || ' guide' AS metadata, arg_min(text, doc_id) AS body FROM documents GROUP BY source),
wm AS (SELECT page_id, term, count(*) AS m FROM (SELECT page_id, unnest({_tokens('metadata')}) AS term FROM wk) GROUP BY 1, 2), wb AS (SELECT page_id, term, count(*) AS b FROM (SELECT page_id, unnest({_tokens('body')}) AS term FROM wk) GROUP BY 1, 2),
wc AS (SELECT coalesce(wm.page_id, wb.page_id) AS page_id, coalesce(wm.term, wb.term) AS term, coalesce(m, 0) AS m, coalesce(b, 0) AS b FROM wm FULL JOIN wb ON wm.page_id = wb.page_id AND wm.term = wb.term),
s AS (SELECT doc_id, page_id, sum(weight * (8 * m + 2 * b) + 3) AS score, count(*) AS matched FROM wt JOIN wc USING (term) GROUP BY 1, 2)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, path, page_id) AS INT) AS rank, page_id, CAST(score AS BIGINT) AS score, matched FROM s JOIN wk USING (page_id) QUALIFY rank <= 8""")
def related_wiki_pages(t: Tables) -> DataFrame:
    wiki = t.documents.groupBy("source").agg(F.min_by("text", "doc_id").alias("body")).select(F.concat(F.lit("w"), "source").alias("page_id"), F.concat(F.lit("wiki/"), "source").alias("path"), F.concat("source", F.lit(" guide")).alias("metadata"), "body")
    return ex.related_pages(_weights(t), "doc_id", wiki)


@query(r"""
WITH m AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE 'before' || chr(13) || chr(10) || '## Page 1' || chr(13) || chr(10) || ' ' || source || chr(10) || '## Page  2 of 2' || chr(10) || text || chr(10) || '## Page 9' END AS text FROM documents),
p AS (SELECT doc_id, string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '(?m)^## Page ', chr(1), 'g'), chr(1)) AS ps FROM m),
e AS (SELECT doc_id, ps, unnest(range(0, greatest(len(ps) - 1, 1))) AS i FROM p)
SELECT doc_id, CAST(i AS INT) AS page_index, CASE WHEN len(ps) = 1 THEN 'Imported text' ELSE 'Page ' || trim(string_split(ps[i + 2], chr(10))[1], ' ') END AS page_label,
  CASE WHEN len(ps) = 1 THEN ps[1] WHEN contains(ps[i + 2], chr(10)) THEN regexp_replace(substr(ps[i + 2], instr(ps[i + 2], chr(10)) + 1), '^\s+|\s+$', '', 'g') ELSE '' END AS content FROM e""")
def page_sections(t: Tables) -> DataFrame:
    marked = F.concat(F.lit("before\r\n## Page 1\r\n "), "source", F.lit("\n## Page  2 of 2\n"), "text", F.lit("\n## Page 9"))
    return ex.page_sections(t.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(marked).alias("text")), "doc_id", "text")


@query("""
SELECT p_brand AS source, 'node' AS kind, CAST(p_partkey AS VARCHAR) AS id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS INT) AS rank FROM part QUALIFY rank <= 24
UNION ALL SELECT p_brand, 'claim', CAST(p_partkey AS VARCHAR), CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS INT) AS rank FROM part WHERE p_size > 9 QUALIFY rank <= 32
UNION ALL SELECT p_brand, 'relation', CAST(p_partkey AS VARCHAR), CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS INT) AS rank FROM part WHERE p_size < 40 QUALIFY rank <= 32""")
def extraction_caps(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_brand").alias("source"), F.col("p_partkey").alias("id"), F.col("p_size").alias("place"))
    return ex.capped(rows, rows.where("place > 9"), rows.where("place < 40"), "source", "place")


@query("""
WITH c AS (SELECT c_custkey AS id, c_mktsegment AS v, 10 AS f FROM customer WHERE c_acctbal > 0), i AS (SELECT c_custkey AS id, c_mktsegment || '!' AS v FROM customer WHERE c_nationkey <> 3)
SELECT id, v, CAST(f AS BIGINT) AS valid_from, CAST(20 AS BIGINT) AS valid_to FROM c UNION ALL SELECT id, v, 20, NULL FROM i""")
def replace_live(t: Tables) -> DataFrame:
    """All live rows are closed, the new projection is live."""
    cust = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("v"), "c_nationkey", "c_acctbal")
    current = cust.where("c_acctbal > 0").select("id", "v", F.lit(10).cast("bigint").alias("valid_from"), F.lit(None).cast("bigint").alias("valid_to"))
    return dc.replaced_live(current, cust.where("c_nationkey <> 3").select("id", F.concat("v", F.lit("!")).alias("v")), F.lit(20))


@query("""
SELECT i.c_custkey AS id, CASE WHEN i.c_nationkey % 4 = 0 THEN 5 ELSE 15 END AS valid_from FROM customer i WHERE i.c_acctbal > 0 AND CASE WHEN i.c_nationkey % 4 = 0 THEN 5 ELSE 15 END <= 10 AND c_nationkey % 5 <> 0""")
def monotonic_violations(t: Tables) -> DataFrame:
    """Incoming rows that aren't newer than the live row of their id: such a write is refused as a whole."""
    own = t.customer.select(F.col("c_custkey").alias("id"), "c_nationkey", "c_acctbal")
    current = own.where("c_acctbal > 0").select("id", F.lit(10).alias("valid_from"), F.when(F.col("c_nationkey") % 5 == 0, 12).alias("valid_to"))
    return hs.not_monotonic(current, own.select("id", F.when(F.col("c_nationkey") % 4 == 0, 5).otherwise(15).alias("valid_from")), ["id"])
