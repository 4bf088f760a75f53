"""Graph operators over the order tables: parts and suppliers as nodes, line items as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..operators import graph as gr
from ..operators.retrieval import top
from .registry import Tables, query


def supply_edges(t: Tables) -> DataFrame:
    """(src part, dst supplier) pairs with the number of line items."""
    pairs = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return pairs.select(F.concat(F.lit("p"), F.col("l_partkey")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst"), F.col("n").alias("evidence"))


_EDGES = "e AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, count(*) AS evidence FROM lineitem GROUP BY 1, 2)"


@query("""
WITH e AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
s AS (SELECT 'c' || c_custkey AS node FROM customer WHERE c_nationkey = 7)
SELECT DISTINCT src AS node, dst AS other, 'out' AS direction FROM e JOIN s ON s.node = e.src
UNION SELECT DISTINCT dst, src, 'in' FROM e JOIN s ON s.node = e.dst""")
def neighbour_hop(t: Tables) -> DataFrame:
    edges = t.orders.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"))
    edges = edges.unionByName(t.customer.select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst")))
    seeds = t.customer.where("c_nationkey = 7").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    return gr.neighbours(seeds, edges).select("node", "other", "direction")


@query("""
WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
h AS (SELECT 'r2' AS node, 0 AS d UNION SELECT u.b, h.d + 1 FROM h JOIN u ON u.a = h.node WHERE h.d < 3)
SELECT node, min(d) AS distance FROM h GROUP BY node""")
def hops_within_three(t: Tables) -> DataFrame:
    link = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"))
    edges = link(t.nation, "r", "n_regionkey", "n", "n_nationkey").unionByName(link(t.customer, "n", "c_nationkey", "c", "c_custkey")).unionByName(link(t.supplier, "n", "s_nationkey", "s", "s_suppkey"))
    return gr.hops(t.spark.createDataFrame([("r2",)], "node string"), edges, 3)


@query("""
WITH a AS (SELECT l_orderkey, list_distinct(list(l_partkey)) AS parts FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey FROM a WHERE list_has_any(parts, [1, 17, 40, 99])""")
def evidence_overlap(t: Tables) -> DataFrame:
    orders = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    return orders.where(F.arrays_overlap("parts", F.array(*[F.lit(x).cast("bigint") for x in (1, 17, 40, 99)]))).select("l_orderkey")


_ALIAS = r"""
k AS (SELECT p_partkey AS item, trim(regexp_replace(lower(p_name), '[^\p{L}\p{N}]+', ' ', 'g')) AS k1, trim(regexp_replace(lower(p_brand || ' ' || p_size), '[^\p{L}\p{N}]+', ' ', 'g')) AS k2 FROM part),
keys AS (SELECT item, 0 AS place, k1 AS key FROM k UNION ALL SELECT item, 1, k2 FROM k),
seen AS (SELECT key, min(item) AS seen FROM keys GROUP BY key),
star AS (SELECT item, seen AS low FROM keys JOIN seen USING (key)),
link AS (SELECT item AS a, low AS b FROM star UNION SELECT low, item FROM star),
cc(id, c) USING KEY (id) AS (SELECT item, item FROM k UNION (SELECT l.a, min(v.c) FROM cc v JOIN link l ON l.b = v.id JOIN recurring.cc u ON u.id = l.a WHERE v.c < u.c GROUP BY l.a)),
comp AS (SELECT id AS item, c AS component FROM cc),
began AS (SELECT item, arg_min(key, place) AS own FROM keys JOIN seen USING (key) GROUP BY item HAVING min(seen) = item),
named AS (SELECT component, min(own) AS group_key FROM comp JOIN began USING (item) GROUP BY component)"""


@query(f"WITH RECURSIVE {_ALIAS} SELECT item, group_key FROM comp JOIN named USING (component)")
def alias_components(t: Tables) -> DataFrame:
    keys = F.array(tx.normal_key(F.col("p_name")), tx.normal_key(F.concat_ws(" ", "p_brand", "p_size")))
    return gr.merge_by_alias(t.part.select(F.col("p_partkey").alias("item"), F.col("p_partkey").alias("position"), keys.alias("keys")))


@query("""
WITH s AS (SELECT l_partkey, count(*) AS evidence, count(DISTINCT l_suppkey) AS pages, count(DISTINCT l_shipmonth) AS chunks, count(DISTINCT l_returnflag) AS headings FROM (SELECT *, date_trunc('month', l_shipdate) AS l_shipmonth FROM lineitem) GROUP BY 1),
v AS (SELECT p_partkey, p_brand, p_name, 5 * evidence + 3 * pages + 2 * chunks + least(headings, 3) + 2 * least(pages, 8) + 1 + CAST(floor(4 * 0.72) AS INT)
  - CASE WHEN len(string_split_regex(trim(p_name), '\\s+')) = 1 AND evidence <= 1 THEN 2 ELSE 0 END - greatest(len(string_split_regex(trim(p_name), '\\s+')) - 6, 0) AS salience, evidence
  FROM part JOIN s ON p_partkey = l_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY salience DESC, evidence DESC, p_name, p_partkey) AS k FROM v)
SELECT p_partkey, p_brand, CAST(salience AS BIGINT) AS salience, CAST(k AS INT) AS rank FROM r WHERE k <= 18""".replace("\\\\", "\\"))
def compaction_rank(t: Tables) -> DataFrame:
    items = t.lineitem.withColumn("month", F.date_trunc("month", "l_shipdate"))
    stats = items.groupBy("l_partkey").agg(F.count("*").alias("evidence"), F.countDistinct("l_suppkey").alias("pages"), F.countDistinct("month").alias("chunks"), F.countDistinct("l_returnflag").alias("headings"))
    rows = t.part.join(stats, F.col("p_partkey") == F.col("l_partkey"))
    parts = {c: F.col(c) for c in ("evidence", "pages", "chunks", "headings")} | {"label": F.col("p_name"), "degree": F.col("pages"), "aliases": F.lit(1), "confidence": F.lit(0.72)}
    scored = rows.withColumn("salience", gr.compaction_salience(parts).cast("bigint"))
    return top(scored, ["p_brand"], [F.desc("salience"), F.desc("evidence"), F.col("p_name"), F.col("p_partkey")], 18).select("p_partkey", "p_brand", "salience", "rank")


@query("""
WITH m AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name) AS new FROM part),
e AS (SELECT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
n AS (SELECT coalesce(x.new, src) AS a, coalesce(y.new, dst) AS b FROM e LEFT JOIN m x ON x.p_partkey = src LEFT JOIN m y ON y.p_partkey = dst)
SELECT least(a, b) AS src, greatest(a, b) AS dst, 'related_to' AS kind, count(*) AS n FROM n WHERE a <> b GROUP BY 1, 2""")
def edge_remap(t: Tables) -> DataFrame:
    low = t.part.groupBy("p_name").agg(F.min("p_partkey").alias("new"))
    mapping = t.part.join(low, "p_name").select(F.col("p_partkey").alias("old"), "new")
    a = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("src"))
    b = t.lineitem.select("l_orderkey", (F.col("l_linenumber") - 1).alias("line"), F.col("l_partkey").alias("dst"))
    edges = a.join(b, ["l_orderkey", "line"]).select("src", "dst", F.lit("related_to").alias("kind"))
    return gr.remap_edges(edges, mapping, ["related_to", "same_as"])


@query(f"""
WITH {_EDGES}, n AS (SELECT 'p' || p_partkey AS id, p_name AS label, p_size AS evidence, 0.72 AS confidence FROM part UNION ALL SELECT 's' || s_suppkey, s_name, 1, 0.9 FROM supplier),
d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id),
s AS (SELECT n.*, 100 * evidence + 12 * coalesce(degree, 0) + CAST(round(confidence * 100) AS BIGINT) - CASE WHEN length(label) > 80 THEN 50 ELSE 0 END AS score FROM n LEFT JOIN d USING (id)),
v AS (SELECT id, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, evidence DESC, label, id) AS k FROM s) WHERE k <= 60),
w AS (SELECT src || '-' || dst AS id, 100 * evidence + 10 + 68 AS score, evidence FROM e WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v))
SELECT 'node' AS part, id, CAST(score AS BIGINT) AS score FROM v
UNION ALL SELECT 'edge', id, CAST(score AS BIGINT) FROM (SELECT *, row_number() OVER (ORDER BY score DESC, evidence DESC, id) AS k FROM w) WHERE k <= 90""")
def ui_projection(t: Tables) -> DataFrame:
    nodes = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_size").alias("evidence"), F.lit(0.72).alias("confidence"))
    nodes = nodes.unionByName(t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("label"), F.lit(1).alias("evidence"), F.lit(0.9).alias("confidence")))
    edges = supply_edges(t).select(F.concat_ws("-", "src", "dst").alias("id"), "src", "dst", "evidence", F.lit("related_to").alias("kind"), F.lit(0.68).alias("confidence"))
    return gr.projection(nodes, edges, 60, 90).withColumn("score", F.col("score").cast("bigint"))


@query("""
WITH e AS (SELECT l_orderkey || '-' || l_linenumber AS edge_id, 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem),
n AS (SELECT 'o' || o_orderkey AS node FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'p' || p_partkey FROM part WHERE p_size < 49)
SELECT edge_id, src AS missing FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE node = src)
UNION SELECT edge_id, dst FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE node = dst)""")
def lint_dangling(t: Tables) -> DataFrame:
    edges = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("edge_id"), F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    nodes = t.orders.where("o_orderstatus <> 'P'").select(F.concat(F.lit("o"), "o_orderkey").alias("node")).union(t.part.where("p_size < 49").select(F.concat(F.lit("p"), "p_partkey")))
    return gr.dangling(edges, nodes)


@query("""
SELECT 'c' || c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL) AND c_acctbal >= 0
UNION ALL SELECT 'p' || p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL)""")
def lint_orphans(t: Tables) -> DataFrame:
    name = lambda kind, c: F.concat(F.lit(kind), c)
    edges = t.orders.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst")).union(t.lineitem.select(name("p", "l_partkey"), name("s", "l_suppkey")))
    nodes = t.customer.select(name("c", "c_custkey").alias("node")).union(t.part.select(name("p", "p_partkey")))
    return gr.orphans(nodes, edges, t.customer.where("c_acctbal < 0").select(name("c", "c_custkey").alias("node")))


_CLAIMS = r"""
c AS (SELECT p_partkey AS claim_id, p_brand AS topic, p_name || ' ' || p_type || CASE WHEN p_size > 25 THEN ' not' ELSE '' END AS statement FROM part),
w AS (SELECT claim_id, topic, list_filter(regexp_split_to_array(lower(statement), '[^a-z0-9]+'), lambda x: TRUE) AS ws FROM c),
k AS (SELECT claim_id, topic, len(list_filter(ws, lambda x: x IN ('no', 'not', 'never', 'without'))) > 0 AS neg,
  list_distinct(list_filter(ws, lambda x: length(x) >= 4 AND x NOT IN ('this', 'that', 'with', 'from', 'into', 'evidence', 'backed'))) AS terms FROM w)"""


@query(f"""WITH {_CLAIMS}
SELECT least(a.claim_id, b.claim_id) AS left_id, greatest(a.claim_id, b.claim_id) AS right_id, len(list_intersect(a.terms, b.terms)) AS shared
FROM k a JOIN k b ON a.topic = b.topic AND a.neg AND NOT b.neg WHERE len(list_intersect(a.terms, b.terms)) >= 3""")
def claim_conflicts(t: Tables) -> DataFrame:
    statement = F.concat("p_name", F.lit(" "), "p_type", F.when(F.col("p_size") > 25, " not").otherwise(""))
    return gr.claim_conflicts(t.part.select(F.col("p_partkey").alias("claim_id"), F.col("p_brand").alias("topic"), statement.alias("statement")))


@query(r"""
SELECT doc_id, CASE WHEN len(list_filter([' decision ', ' decided ', ' chose ', ' chosen ', ' approved ', ' accepted ', ' source of truth ', ' must ', ' should ', ' will ', ' no human approval ', ' records approved '], lambda m: contains(' ' || lower(s) || ' ', m))) > 0 THEN 'decision' ELSE 'durable_fact' END AS kind,
  CASE WHEN regexp_matches(lower(s), ' depends on | relies on | requires | blocked by ') THEN 'depends_on' WHEN regexp_matches(lower(s), ' supports | enables | grounds | backs | cites ') THEN 'supports'
  WHEN regexp_matches(lower(s), ' contradicts | conflicts with ') THEN 'contradicts' WHEN regexp_matches(lower(s), ' supersedes | replaces ') THEN 'supersedes'
  WHEN regexp_matches(lower(s), ' same as | alias of ') THEN 'same_as' WHEN regexp_matches(lower(s), '->|<->| links ') THEN 'related_to' END AS relation
FROM (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'It depends on ' WHEN 1 THEN 'X supports ' WHEN 2 THEN 'A -> ' WHEN 3 THEN 'We should see ' WHEN 4 THEN 'This replaces ' ELSE '' END || text AS s FROM documents)""")
def claim_and_relation_kinds(t: Tables) -> DataFrame:
    n = F.col("doc_id") % 7
    head = F.when(n == 0, "It depends on ").when(n == 1, "X supports ").when(n == 2, "A -> ").when(n == 3, "We should see ").when(n == 4, "This replaces ").otherwise("")
    said = t.documents.select("doc_id", F.concat(head, "text").alias("s"))
    return said.select("doc_id", tx.claim_kind(F.col("s")).alias("kind"), tx.relation_kind(F.col("s")).alias("relation"))


@query(r"""
WITH d AS (SELECT doc_id, source, trim(regexp_replace(lower(string_split(text, chr(10))[1]), '[^\p{L}\p{N}]+', ' ', 'g')) AS key, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 7)) AS terms FROM documents),
m AS (SELECT a.doc_id AS l_id, b.doc_id AS r_id, a.key = b.key AND a.key <> '' AS direct, len(list_intersect(a.terms, b.terms)) AS shared FROM d a JOIN d b ON a.source = 'src1' AND b.source <> 'src1'),
s AS (SELECT l_id, r_id, direct, shared, CASE WHEN direct THEN 10000 ELSE 1000 END + 100 * least(shared, 8) AS score FROM m WHERE direct OR shared >= 2)
SELECT l_id, r_id, direct, CAST(shared AS BIGINT) AS shared, CAST(score AS BIGINT) AS score, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, l_id, r_id) AS k FROM s) WHERE k <= 32""")
def link_candidates(t: Tables) -> DataFrame:
    terms = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= 7))
    rows = t.documents.select(F.col("doc_id").alias("id"), F.split("text", "\n")[0].alias("name"), terms.alias("terms"), "source")
    found = gr.link_candidates(rows.where("source = 'src1'"), rows.where("source <> 'src1'"))
    return found.withColumns({"shared": F.col("shared").cast("bigint"), "score": F.col("score").cast("bigint")})


@query(r"""
WITH d AS (SELECT doc_id AS id, source, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS body, trim(regexp_replace(lower(string_split(text, chr(10))[1]), '[^\p{L}\p{N}]+', ' ', 'g')) AS title,
  list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 4 AND x NOT IN ('this', 'that', 'with', 'from', 'into', 'evidence', 'backed'))) AS terms FROM documents),
p AS (SELECT a.id AS n, b.id AS k, a.body = b.body AS eb, a.title = b.title AS et, len(list_intersect(a.terms, b.terms)) AS c, len(a.terms) AS sa, len(b.terms) AS sb FROM d a JOIN d b ON a.source = 'src2' AND b.source <> 'src2'),
s AS (SELECT n, k, CASE WHEN eb THEN 950 WHEN et THEN 900 WHEN c >= 4 AND 100 * c // least(sa, sb) >= 80 AND 100 * c // greatest(sa, sb) >= 65 THEN 700 + 100 * c // greatest(sa, sb) END AS score FROM p)
SELECT n AS id, k AS memory_id, CAST(score AS INT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, k) AS r FROM s WHERE score IS NOT NULL) WHERE r = 1""")
def memory_match(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("body"), F.split("text", "\n")[0].alias("title"), F.expr("cast(array() as array<string>)").alias("evidence_ids"), "source")
    return gr.memory_matches(rows.where("source = 'src2'"), rows.where("source <> 'src2'"))


def _brand_nodes(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_brand").alias("label")).agg(F.array_sort(F.collect_set("p_type")).alias("aliases"), F.array_sort(F.collect_set(F.col("p_partkey").cast("string"))).alias("evidence_ids"), F.least(F.round(F.avg("p_size") / 50, 4), F.lit(0.94)).alias("confidence")).withColumn("node_id", F.replace(F.lower("label"), F.lit("#"), F.lit("-")))


_BRANDS = "b AS (SELECT replace(lower(p_brand), '#', '-') AS node_id, p_brand AS label, list_sort(list_distinct(list(p_type))) AS aliases, list_sort(list_distinct(list(CAST(p_partkey AS VARCHAR)))) AS evidence_ids, least(round(avg(p_size) / 50, 4), 0.94) AS confidence FROM part GROUP BY p_brand)"
_SOME = "two AS (SELECT min(node_id) AS x, max(node_id) AS y FROM b)"


@query(f"""WITH {_BRANDS}, {_SOME}
SELECT b.node_id, b.label, b.aliases, b.evidence_ids, b.confidence FROM b, two WHERE node_id NOT IN (x, y)
UNION ALL SELECT y, b2.label, list_sort(list_distinct(list_concat(list_concat(b1.aliases, b2.aliases), [b1.label]))), list_sort(list_distinct(list_concat(b1.evidence_ids, b2.evidence_ids))), least(greatest(b1.confidence, b2.confidence), 0.94)
FROM two JOIN b b1 ON b1.node_id = x JOIN b b2 ON b2.node_id = y""")
def correction_merge(t: Tables) -> DataFrame:
    nodes = _brand_nodes(t)
    ends = nodes.agg(F.min("node_id"), F.max("node_id")).first()  # a stated pair of ids
    empty = t.spark.createDataFrame([], "src string, dst string, kind string")
    return gr.merge_nodes(nodes, empty, ends[0], ends[1])[0].select("node_id", "label", "aliases", "evidence_ids", "confidence")


@query(f"""WITH {_BRANDS}, {_SOME}
SELECT b.node_id, label, CASE WHEN node_id = x THEN CAST([] AS VARCHAR[]) ELSE aliases END AS aliases, evidence_ids, confidence FROM b, two
UNION ALL SELECT 'concept-' || replace(trim(regexp_replace(lower(a), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ', '-'), a, CAST([] AS VARCHAR[]), evidence_ids, least(confidence, 0.82) FROM (SELECT unnest(aliases) AS a, evidence_ids, confidence FROM b, two WHERE node_id = x)""")
def correction_keep_separate(t: Tables) -> DataFrame:
    nodes = _brand_nodes(t)
    return gr.keep_separate(nodes, nodes.agg(F.min("node_id")).first()[0]).select("node_id", "label", "aliases", "evidence_ids", "confidence")


@query(f"""WITH {_BRANDS}, {_SOME}
SELECT CASE WHEN node_id = x THEN 'concept-new-name' ELSE node_id END AS node_id, CASE WHEN node_id = x THEN 'New Name' ELSE label END AS label, CASE WHEN node_id = x THEN list_sort(list_distinct(list_concat(aliases, [label]))) ELSE aliases END AS aliases, evidence_ids, confidence FROM b, two""")
def correction_rename(t: Tables) -> DataFrame:
    nodes = _brand_nodes(t)
    empty = t.spark.createDataFrame([], "src string, dst string, kind string")
    return gr.rename_node(nodes, empty, nodes.agg(F.min("node_id")).first()[0], "New Name")[0].select("node_id", "label", "aliases", "evidence_ids", "confidence")


@query(f"WITH {_EDGES} SELECT src, dst, evidence FROM e WHERE src NOT IN (SELECT 'p' || p_partkey FROM part WHERE p_size > 40) AND dst NOT IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal < 0)")
def correction_delete_cascade(t: Tables) -> DataFrame:
    gone = t.part.where("p_size > 40").select(F.concat(F.lit("p"), "p_partkey").alias("node_id")).union(t.supplier.where("s_acctbal < 0").select(F.concat(F.lit("s"), "s_suppkey")))
    return gr.delete_nodes(gone, supply_edges(t), gone)[1]


@query("""
WITH o AS (SELECT l_orderkey, list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS refs FROM lineitem GROUP BY 1)
SELECT l_orderkey, list_filter(refs, lambda x: list_contains(known, x)) AS refs FROM o, (SELECT list(CAST(p_partkey AS VARCHAR)) AS known FROM part WHERE p_size > 10)""")
def clean_references(t: Tables) -> DataFrame:
    lists = t.lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").cast("string").alias("p")))), lambda x: x["p"]).alias("refs"))
    known = t.part.where("p_size > 10").select(F.col("p_partkey").cast("string").alias("id"))
    return gr.clean_references(lists, "l_orderkey", "refs", known, "id")


@query("""
WITH i AS (SELECT DISTINCT 'o' || l_orderkey AS evidence_id, 'node' AS record_kind, 'p' || l_partkey AS record_id FROM lineitem UNION SELECT DISTINCT 'o' || l_orderkey, 'relation', 'p' || l_partkey || '-s' || l_suppkey FROM lineitem)
SELECT record_kind, record_id, count(*) AS n, min(evidence_id) AS first_evidence FROM i GROUP BY 1, 2""")
def evidence_record_index(t: Tables) -> DataFrame:
    base = t.lineitem.select(F.concat(F.lit("p"), "l_partkey").alias("p"), F.concat_ws("-", F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")).alias("ps"), F.array(F.concat(F.lit("o"), "l_orderkey")).alias("evidence_ids"))
    index = gr.evidence_index({"node": base.select(F.col("p").alias("id"), "evidence_ids"), "relation": base.select(F.col("ps").alias("id"), "evidence_ids")})
    return index.groupBy("record_kind", "record_id").agg(F.count("*").alias("n"), F.min("evidence_id").alias("first_evidence"))


@query("""
WITH ed AS (SELECT DISTINCT 'p' || l_partkey || '-s' || l_suppkey AS edge_id, 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem),
i AS (SELECT DISTINCT 'o' || l_orderkey AS evidence_id, 0 AS o, 'p' || l_partkey AS record_id FROM lineitem UNION SELECT DISTINCT 'o' || l_orderkey, 1, 'p' || l_partkey || '-s' || l_suppkey FROM lineitem),
d AS (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY o, record_id) AS k FROM i),
d8 AS (SELECT * FROM d WHERE k <= 8),
adj AS (
  SELECT evidence_id, unnest([src, dst]) AS record_id, 0 AS o FROM d8 JOIN ed ON d8.o = 1 AND d8.record_id = ed.edge_id
  UNION ALL SELECT evidence_id, unnest([edge_id, dst]), 1 FROM d8 JOIN ed ON d8.o = 0 AND d8.record_id = ed.src
  UNION ALL SELECT evidence_id, unnest([edge_id, src]), 1 FROM d8 JOIN ed ON d8.o = 0 AND d8.record_id = ed.dst),
a AS (SELECT evidence_id, record_id, min(o) AS o FROM adj GROUP BY 1, 2),
a8 AS (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY o, record_id) AS k FROM a WHERE NOT EXISTS (SELECT 1 FROM d8 WHERE d8.evidence_id = a.evidence_id AND d8.record_id = a.record_id))
SELECT evidence_id, 'direct' AS stage, record_id, CAST(k AS INT) AS rank FROM d8 UNION ALL SELECT evidence_id, 'adjacent', record_id, CAST(k AS INT) FROM a8 WHERE k <= 8""")
def graph_trail(t: Tables) -> DataFrame:
    p, s, o = (F.concat(F.lit(c), col) for c, col in (("p", "l_partkey"), ("s", "l_suppkey"), ("o", "l_orderkey")))
    edges = t.lineitem.select(F.concat_ws("-", p, s).alias("edge_id"), p.alias("src"), s.alias("dst"))
    own = t.lineitem
    index = own.select(o.alias("evidence_id"), F.lit("node").alias("record_kind"), p.alias("record_id")).unionByName(own.select(o.alias("evidence_id"), F.lit("relation").alias("record_kind"), F.concat_ws("-", p, s).alias("record_id")))
    return gr.trail(own.select(o.alias("evidence_id")), index, edges)
