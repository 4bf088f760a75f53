"""Workspace rules over the order tables and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..operators import retrieval as rt, workspace as ws
from .registry import Tables, query

_REL = "rel AS (SELECT l_orderkey AS id, list_sort(list_distinct(list(CAST(l_partkey AS VARCHAR)))) AS ev FROM lineitem GROUP BY 1), e AS (SELECT CAST(p_partkey AS VARCHAR) AS evidence_id, p_brand AS source_id FROM part)"


def _relations(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("evidence_ids"))


def _evidence(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").cast("string").alias("evidence_id"), F.col("p_brand").alias("source_id"))


@query(f"WITH {_REL}, x AS (SELECT id, unnest(ev) AS evidence_id FROM rel) SELECT id, list_sort(list(DISTINCT source_id)) AS sources, count(DISTINCT source_id) > 1 AS cross_source FROM x JOIN e USING (evidence_id) GROUP BY id")
def cross_source_relations(t: Tables) -> DataFrame:
    return ws.source_sets(_relations(t), _evidence(t))


@query(f"WITH {_REL}, x AS (SELECT id, unnest(ev) AS evidence_id FROM rel) SELECT DISTINCT id FROM x JOIN e USING (evidence_id) WHERE source_id IN ('Brand#11', 'Brand#12')")
def eligibility_filter(t: Tables) -> DataFrame:
    return ws.eligible(_relations(t), _evidence(t), t.spark.createDataFrame([("Brand#11",), ("Brand#12",)], "source_id string")).select("id")


@query("""
WITH c AS (SELECT least(l_partkey, l_suppkey) AS lo, greatest(l_partkey, l_suppkey) AS hi, max(CAST(l_linenumber = 1 AS INT)) = 1 AS direct FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2),
r AS (SELECT l_orderkey * 10 + l_linenumber AS id, least(l_partkey, l_suppkey) AS lo, greatest(l_partkey, l_suppkey) AS hi, l_returnflag AS label, 0.6 + l_tax * 4 AS confidence FROM lineitem)
SELECT r.id, direct IS NULL AS no_candidate FROM r LEFT JOIN c USING (lo, hi) WHERE direct IS NULL OR lower(label) = 'r' OR confidence < CASE WHEN direct THEN 0.75 ELSE 0.85 END""")
def unverified_relations(t: Tables) -> DataFrame:
    cand = t.lineitem.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), (F.col("l_linenumber") == 1).alias("direct"))
    rel = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_returnflag").alias("label"), (F.lit(0.6) + F.col("l_tax") * 4).alias("confidence"))
    return ws.unverified(rel, cand, ["r"])


@query("""
WITH m AS (SELECT DISTINCT l_orderkey AS place, l_partkey AS concept FROM lineitem),
p AS (SELECT x.concept AS a, y.concept AS b, count(*) AS shared FROM m x JOIN m y ON x.place = y.place AND x.concept < y.concept GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS r FROM p)
SELECT a, b, shared, CAST(r AS INT) AS rank FROM k WHERE r <= 16""")
def cooccurrence_edges(t: Tables) -> DataFrame:
    return ws.cooccurrence(t.lineitem.select(F.col("l_orderkey").alias("place"), F.col("l_partkey").alias("concept")))


@query("""
WITH s AS (SELECT doc_id, unnest(string_split(text, '.')) AS s, generate_subscripts(string_split(text, '.'), 1) AS k FROM documents),
m AS (SELECT DISTINCT doc_id || '.' || k AS place, w AS concept FROM s, (SELECT unnest(['the', 'and', 'with', 'from', 'this']) AS w) WHERE list_contains(regexp_split_to_array(lower(s), '[^a-z]+'), w))
SELECT x.concept AS a, y.concept AS b, count(*) AS shared FROM m x JOIN m y ON x.place = y.place AND x.concept < y.concept GROUP BY 1, 2""")
def mention_pairs(t: Tables) -> DataFrame:
    s = t.documents.select("doc_id", F.posexplode(F.split("text", r"\.")).alias("k", "s"))
    held = F.filter(tx.literals(["the", "and", "with", "from", "this"]), lambda w: F.array_contains(F.split(F.lower("s"), "[^a-z]+"), w))
    return ws.cooccurrence(s.select(F.concat_ws(".", "doc_id", "k").alias("place"), F.explode(held).alias("concept"))).select("a", "b", "shared")


@query("""
WITH c AS (SELECT o_custkey % 200 AS claim_id, o_orderkey AS ordinal, o_orderpriority AS statement, ['t' || (o_orderkey % 5)] AS topics, ['e' || (o_orderkey % 7), 'e1'] AS ev, CASE o_orderstatus WHEN 'F' THEN 'supported' WHEN 'O' THEN 'accepted' ELSE 'candidate' END AS status, epoch(o_orderdate)::BIGINT AS at_ FROM orders)
SELECT claim_id, arg_min(statement, ordinal) AS statement, list_sort(list_distinct(flatten(list(topics)))) AS topic_refs, list_sort(list_distinct(flatten(list(ev)))) AS evidence_ids,
  CASE WHEN bool_or(status = 'supported') THEN 'supported' WHEN bool_or(status = 'accepted') THEN 'accepted' ELSE 'candidate' END AS status, max(at_) AS updated_at FROM c GROUP BY 1""")
def claim_group_merge(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "supported").when(F.col("o_orderstatus") == "O", "accepted").otherwise("candidate")
    return ws.merge_claims(t.orders.select((F.col("o_custkey") % 200).alias("claim_id"), k.alias("ordinal"), F.col("o_orderpriority").alias("statement"), F.array(F.concat(F.lit("t"), k % 5)).alias("topic_refs"), F.array(F.concat(F.lit("e"), k % 7), F.lit("e1")).alias("evidence_ids"), status.alias("status"), F.unix_timestamp("o_orderdate").alias("updated_at")))


@query(r"""
WITH s AS (SELECT p_partkey AS id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS t FROM part),
p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.t, b.t)) AS c, len(a.t) AS na, len(b.t) AS nb FROM s a JOIN s b ON a.id < b.id AND len(a.t) > 0)
SELECT a, b, similarity FROM (SELECT a, b, CASE WHEN c = na + nb - c THEN 1.0 WHEN c = least(na, nb) AND c > 0 THEN 0.86 WHEN c / (na + nb - c) >= 0.72 THEN c / (na + nb - c) END::DOUBLE AS similarity FROM p) WHERE similarity IS NOT NULL""")
def label_similarity(t: Tables) -> DataFrame:
    return ws.all_similar_labels(t.part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("label")))


@query("SELECT lang AS evidence_type, count(*) FILTER (n_chars > 2000) AS selected, count(*) AS available FROM documents GROUP BY 1")
def type_trace(t: Tables) -> DataFrame:
    rows = t.documents.withColumnRenamed("lang", "evidence_type")
    return ws.type_trace(rows, rows.where("n_chars > 2000"))


@query("""
WITH p AS (SELECT p_partkey AS entity, 'name' AS key, p_name AS value FROM part UNION ALL SELECT p_partkey, 'brand', p_brand FROM part WHERE p_size > 10)
SELECT entity, max(value) FILTER (key = 'name') AS name, max(value) FILTER (key = 'brand') AS brand FROM p GROUP BY 1""")
def eav_pivot(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_partkey").alias("entity"), F.lit("name").alias("key"), F.col("p_name").alias("value")).unionByName(t.part.where("p_size > 10").select(F.col("p_partkey").alias("entity"), F.lit("brand").alias("key"), F.col("p_brand").alias("value")))
    return ws.pivot_properties(rows, ["name", "brand"])


@query("""
WITH h AS (SELECT doc_id, source, text, len(list_filter(['ention', 'thion', 'erer', 'elle'], lambda x: contains(lower(text), x))) * 100 AS score FROM documents)
SELECT source AS source_id, left(arg_min(text, (-score, doc_id)), 180) AS snippet, CAST(max(score) AS INT) AS score FROM h WHERE score > 0 GROUP BY 1""")
def best_snippet_per_source(t: Tables) -> DataFrame:
    score = tx.match_score(F.col("text"), tx.literals(["ention", "thion", "erer", "elle"]))
    hits = t.documents.select(F.col("source").alias("source_id"), "doc_id", F.substring("text", 1, 180).alias("snippet"), score.alias("matched")).where("matched > 0")
    return ws.best_snippets(hits, "matched", ["doc_id"])


@query("""
WITH p AS (SELECT o_orderkey % 3 AS part, o_custkey AS id, max(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT id, part, v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY part) AS k FROM p) WHERE k = 1""")
def merge_first_wins(t: Tables) -> DataFrame:
    parts = t.orders.groupBy((F.col("o_orderkey") % 3).alias("part"), F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("v"))
    return ws.merged_snapshots(parts, "id", "part").select("id", "part", "v")


@query("""
WITH f AS (SELECT DISTINCT url AS path, sha256(html) AS hash FROM pages), s AS (SELECT url AS path, max(CASE WHEN length(html) > 2000 THEN sha256(html) ELSE 'old' END) AS hash FROM pages WHERE url NOT LIKE '%ref=%' GROUP BY 1)
SELECT f.path, f.hash, CASE WHEN s.hash = f.hash THEN 'no_op' WHEN s.hash IS NULL THEN 'queued' ELSE 'changed' END AS action FROM f LEFT JOIN s ON f.path = s.path""")
def markdown_queue(t: Tables) -> DataFrame:
    hashed = F.sha2("html", 256)
    state = t.pages.where("url not like '%ref=%'").groupBy(F.col("url").alias("path")).agg(F.max(F.when(F.length("html") > 2000, hashed).otherwise("old")).alias("hash"))
    return ws.queue_new(t.pages.select(F.col("url").alias("path"), hashed.alias("hash")), state)


@query("""
WITH w AS (SELECT o_orderkey AS id, o_custkey AS source, NULLIF(o_orderstatus, 'P') AS model, o_orderpriority AS pr FROM orders), r AS (SELECT DISTINCT source, model FROM w WHERE pr = '2-HIGH')
SELECT id FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.source = w.source AND r.model IS NOT DISTINCT FROM w.model)""")
def fingerprint_reuse(t: Tables) -> DataFrame:
    wanted = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source"), F.nullif("o_orderstatus", F.lit("P")).alias("model"), "o_orderpriority")
    return ws.reusable(wanted.where("o_orderpriority = '2-HIGH'"), wanted, ["source", "model"]).select("id")


@query(r"""
WITH q AS (SELECT ['ention', 'thion', 'erer'] AS terms), f AS (SELECT ['n1', 'n2'] AS fn, ['src1', 'src2'] AS fs),
c AS (SELECT doc_id AS id, text AS body, ['n' || (doc_id % 9)] AS nodes, [source] AS sources FROM documents),
s AS (SELECT id, len(list_filter(terms, lambda x: contains(lower(body), x))) AS m, 18 * len(list_intersect(nodes, fn)) + 8 * len(list_intersect(sources, fs)) AS bias FROM c, q, f)
SELECT id, CAST(m AS BIGINT) AS match, CAST(bias AS BIGINT) AS bias, CAST(m * 10 + bias AS BIGINT) AS total FROM s WHERE m > 0""")
def answer_candidates(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("doc_id").alias("id"), F.lit("").alias("title"), F.col("text").alias("body"), F.array(F.concat(F.lit("n"), F.col("doc_id") % 9)).alias("nodes"), F.array("source").alias("sources"))
    focus = t.spark.createDataFrame([(["n1", "n2"], ["src1", "src2"])], "f_nodes array<string>, f_sources array<string>")
    got = ws.answer_candidates(rows, focus, "what is ention thion erer")
    return got.select("id", *[F.col(c).cast("bigint").alias(c) for c in ("match", "bias", "total")])


@query(r"""
WITH q AS (SELECT item_id AS query_id, CASE WHEN item_id % 5 = 0 THEN 'Src' || (item_id % 20) || 'x' ELSE array_to_string((string_split(text, ' '))[2:3], ' ') || ' a' END AS text FROM benchmark),
w AS (SELECT query_id, list_filter(regexp_split_to_array(lower(trim(text, ' ')), '\s+'), lambda x: octet_length(encode(x)) >= 2) AS words FROM q),
h AS (SELECT query_id, doc_id AS evidence_id, doc_id * 7 % 1000 AS a FROM documents, w WHERE len(list_filter(words, lambda x: contains(lower(text), x))) > 0),
b AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY a, evidence_id) AS rank, evidence_id FROM h QUALIFY rank <= 12),
s AS (SELECT source AS source_id, lower(source || 'x ' || max(lang)) AS body FROM documents GROUP BY source), f AS (SELECT source, doc_id AS evidence_id, doc_id * 7 % 1000 AS a FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY a, doc_id) = 1),
m AS (SELECT query_id, evidence_id, a FROM w JOIN s ON len(list_filter(words, lambda x: contains(body, x))) > 0 JOIN f ON f.source = s.source_id WHERE query_id NOT IN (SELECT query_id FROM b))
SELECT query_id, CAST(rank AS INT) AS rank, evidence_id FROM b UNION ALL SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY a, evidence_id) AS INT) AS rank, evidence_id FROM m QUALIFY rank <= 12""")
def cloud_retrieval(t: Tables) -> DataFrame:
    words = F.concat(F.array_join(F.slice(F.split("text", " "), 2, 2), " "), F.lit(" a"))
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 5 == 0, F.concat(F.lit("Src"), F.col("item_id") % 20, F.lit("x"))).otherwise(words).alias("text"))
    rows = t.documents.select(F.col("doc_id").alias("evidence_id"), F.col("source").alias("source_id"), F.col("text").alias("said"), (F.col("doc_id") * 7 % 1000).alias("at"))
    sources = t.documents.groupBy(F.col("source").alias("source_id")).agg(F.concat(F.first("source"), F.lit("x "), F.max("lang")).alias("body"))
    return ws.cloud_hits(rows, sources, queries, 12)


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents),
g AS (SELECT doc_id, source, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS n FROM r WHERE k <= 16)
SELECT doc_id, source, CAST(n AS INT) AS rank FROM g WHERE n <= 120""")
def outline_limits(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source", "n_chars", F.lit(1).alias("all"))
    return rt.top_with_source_cap(rows, "all", "source", [F.desc("n_chars"), F.col("doc_id")], 16, 120).select("doc_id", "source", "rank")


@query("SELECT c_custkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey DESC) AS k FROM customer) WHERE k = 1")
def canvas_dedupe(t: Tables) -> DataFrame:
    return rt.top(t.customer, ["c_nationkey", "c_mktsegment"], [F.desc("c_custkey")], 1).select("c_custkey", "c_name")


@query("""
SELECT a.doc_id, list_sort(list(b.doc_id)) AS near FROM documents a JOIN documents b ON a.source = b.source AND b.doc_id > a.doc_id AND b.doc_id <= a.doc_id + 40 GROUP BY 1""")
def page_window(t: Tables) -> DataFrame:
    return ws.next_within(t.documents, "source", "doc_id", 40)
