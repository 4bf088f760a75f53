"""Documents, wiki pages, patches, extraction replies, reads and writes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..operators import documents as dc, history as hs
from ..sources import readers, writers
from ..sources.storage import shared_dir
from .registry import Tables, query


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
h AS (SELECT *, regexp_matches(line, '^#{1,6}\s*\S') AS heading FROM l),
s AS (SELECT *, sum(heading::INT) OVER (PARTITION BY doc_id ORDER BY k) AS section_no FROM h)
SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, max(CASE WHEN heading THEN trim(regexp_replace(line, '^#+', ''), ' ') END) AS title, trim(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT heading), ''), ' ') AS body FROM s GROUP BY 1, 2""")
def wiki_sections(t: Tables) -> DataFrame:
    return dc.sections(t.documents, "doc_id", "text")


@query(r"""
SELECT doc_id, trim(CASE WHEN regexp_extract(text, '(?m)^#{1,6}\s*(\S[^\n]*)$', 1) <> '' THEN regexp_extract(text, '(?m)^#{1,6}\s*(\S[^\n]*)$', 1) ELSE regexp_extract(text, '(?m)^\s*(\S[^\n]*)$', 1) END, ' ') AS title FROM documents""")
def document_titles(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", dc.title_of(F.col("text")).alias("title"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
h AS (SELECT *, regexp_matches(line, '^#{1,6}\s*\S') AS heading FROM l),
s AS (SELECT *, sum(heading::INT) OVER (PARTITION BY doc_id ORDER BY k) AS section_no FROM h),
b AS (SELECT doc_id, section_no, max(CASE WHEN heading THEN trim(regexp_replace(line, '^#+', ''), ' ') END) AS title, trim(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT heading), ''), ' ') AS body FROM s GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_no) AS n FROM b WHERE body <> '')
SELECT doc_id, 'evidence:' || doc_id || ':' || n AS evidence_id, coalesce(title, '') AS title, left(body, 220) AS excerpt, 0.72::DOUBLE AS confidence FROM n WHERE n <= 8""")
def compile_project(t: Tables) -> DataFrame:
    return dc.compile_project(t.documents, "doc_id", "text")


@query("""
WITH cur AS (SELECT c_custkey AS page_id, c_mktsegment AS body, 1 AS revision, CASE WHEN c_nationkey < 12 THEN 'ev-1' ELSE 'ev-2' END AS event FROM customer WHERE c_acctbal > 0),
p AS (SELECT c_custkey AS page_id, c_mktsegment || '!' AS nb FROM customer WHERE c_nationkey <> 4),
m AS (SELECT coalesce(cur.page_id, p.page_id) AS page_id, body, revision, event, nb FROM cur FULL JOIN p ON cur.page_id = p.page_id)
SELECT page_id, CASE WHEN event = 'ev-2' AND nb IS NOT NULL THEN nb ELSE body END AS body, revision, event, CAST(5 AS BIGINT) AS valid_from, CAST(CASE WHEN event = 'ev-2' AND nb IS NOT NULL THEN NULL ELSE 9 END AS BIGINT) AS valid_to FROM m WHERE revision IS NOT NULL
UNION ALL SELECT page_id, nb, coalesce(revision, 0) + 1, 'ev-2', 9, NULL FROM m WHERE nb IS NOT NULL AND (revision IS NULL OR event <> 'ev-2')""")
def wiki_revisions(t: Tables) -> DataFrame:
    page = t.customer.select(F.col("c_custkey").alias("page_id"), F.col("c_mktsegment").alias("body"), "c_nationkey", "c_acctbal")
    current = page.where("c_acctbal > 0").select("page_id", "body", F.lit(1).alias("revision"), F.when(F.col("c_nationkey") < 12, "ev-1").otherwise("ev-2").alias("event"), F.lit(5).cast("bigint").alias("valid_from"), F.lit(None).cast("bigint").alias("valid_to"))
    return dc.revise(page.where("c_nationkey <> 4").select("page_id", F.concat("body", F.lit("!")).alias("body")), current, F.lit("ev-2"), F.lit(9))


@query("""
WITH n AS (SELECT CAST(p_partkey AS VARCHAR) AS node_id, p_name AS label FROM part),
c AS (SELECT CAST(l_partkey AS VARCHAR) AS node_id, l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS claim_id, 'shipped ' || l_returnflag AS statement, ['o' || l_orderkey] AS ev FROM lineitem),
a AS (SELECT node_id, string_agg('- ' || statement, chr(10) ORDER BY claim_id, statement) AS lines, list_sort(list_distinct(flatten(list(ev)))) AS refs FROM c GROUP BY 1)
SELECT n.node_id, 'wiki/' || replace(trim(regexp_replace(lower(label), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ', '-') || '.md' AS path, '# ' || label || chr(10) || chr(10) || coalesce(lines, '') AS body, coalesce(refs, CAST([] AS VARCHAR[])) AS evidence_refs FROM n LEFT JOIN a USING (node_id)""".replace("\\\\", "\\"))
def wiki_materialise(t: Tables) -> DataFrame:
    nodes = t.part.select(F.col("p_partkey").cast("string").alias("node_id"), F.col("p_name").alias("label"))
    claims = t.lineitem.select(F.col("l_partkey").cast("string").alias("node_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("claim_id"), F.concat(F.lit("shipped "), "l_returnflag").alias("statement"), F.array(F.concat(F.lit("o"), "l_orderkey")).alias("evidence_ids"))
    return dc.wiki_pages(nodes, claims)


def _replies(t: Tables) -> DataFrame:
    body = F.to_json(F.struct(
        F.array(F.struct(F.concat(F.lit("n"), "p_size").alias("id"), F.lit("concept").alias("kind"), F.col("p_name").alias("label"), F.array(F.concat(F.lit("e"), F.col("p_partkey") % 10), F.lit("e1")).alias("evidence_ids"), F.lit(0.7).alias("confidence")),
                F.struct(F.lit("blank").alias("id"), F.lit("concept").alias("kind"), F.lit(" ").alias("label"), F.array(F.lit("e1")).alias("evidence_ids"), F.lit(0.7).alias("confidence"))).alias("nodes"),
        F.array(F.struct(F.concat(F.lit("c"), "p_partkey").alias("id"), F.col("p_type").alias("statement"), F.array(F.lit("t")).alias("topic_refs"), F.array(F.concat(F.lit("e"), F.col("p_partkey") % 10)).alias("evidence_ids"))).alias("claims"),
    ))
    return t.part.select("p_partkey", F.concat(F.lit("Here you are:\n```json\n"), F.when(F.col("p_partkey") % 13 == 0, "{broken").otherwise(body), F.lit("\n```")).alias("reply"))


@query("""
WITH k AS (SELECT 'e' || i AS e FROM range(0, 5) t(i)), p AS (SELECT *, 'e' || (p_partkey % 10) AS own FROM part WHERE p_partkey % 13 <> 0)
SELECT p_partkey, 'nodes' AS record, 'n' || p_size AS id, list_sort(list_distinct(CASE WHEN own IN (SELECT e FROM k) THEN [own, 'e1'] ELSE ['e1'] END)) AS evidence_ids FROM p
UNION ALL SELECT p_partkey, 'claims', 'c' || p_partkey, [own] FROM p WHERE own IN (SELECT e FROM k)""")
def supported_records(t: Tables) -> DataFrame:
    known = t.spark.range(0, 5).select(F.concat(F.lit("e"), "id").alias("evidence_id"))
    return dc.supported(dc.parse_extraction(_replies(t), "p_partkey", "reply"), "p_partkey", known)


def _operations(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("part")).select(
        F.col("l_orderkey").alias("patch_id"), n.alias("ordinal"),
        F.when(n == 1, "upsert_node").when(n == 2, "upsert_wiki_page").when(n == 3, "remove").when(n == 4, "upsert_claim").when(n == 7, "explode").otherwise("upsert_relation").alias("op"),
        F.concat(F.lit("p"), F.col("part") % 40).alias("target"), F.when(F.col("part") % 9 == 0, " ").otherwise(F.concat(F.lit("L"), "part")).alias("label"),
        F.when(F.col("part") % 4 == 0, "../up.md").otherwise("wiki/a.md").alias("path"), F.array(F.concat(F.lit("p"), F.col("part") % 45)).alias("refs"))


_OPS = """g AS (SELECT l_orderkey AS patch_id, l_linenumber AS ordinal, max(l_partkey) AS part FROM lineitem GROUP BY 1, 2),
o AS (SELECT patch_id, ordinal, part, CASE ordinal WHEN 1 THEN 'upsert_node' WHEN 2 THEN 'upsert_wiki_page' WHEN 3 THEN 'remove' WHEN 4 THEN 'upsert_claim' WHEN 7 THEN 'explode' ELSE 'upsert_relation' END AS op,
  'p' || (part % 40) AS target, CASE WHEN part % 9 = 0 THEN ' ' ELSE 'L' || part END AS label, 'p' || (part % 45) AS ref FROM g),
v AS (SELECT patch_id, ordinal, 'target_twice' AS rule FROM (SELECT *, row_number() OVER (PARTITION BY patch_id, target ORDER BY ordinal) AS n FROM o) WHERE n > 1
  UNION SELECT patch_id, ordinal, 'blank_label' FROM o WHERE op IN ('upsert_node', 'upsert_claim') AND trim(label) = ''
  UNION SELECT patch_id, ordinal, 'unsafe_path' FROM o WHERE op = 'upsert_wiki_page' AND part % 4 = 0
  UNION SELECT patch_id, ordinal, 'unknown_reference' FROM o WHERE ref NOT IN (SELECT 'p' || i FROM range(0, 43) t(i))
  UNION SELECT patch_id, ordinal, 'unknown_operation' FROM o WHERE op = 'explode')"""


@query(f"WITH {_OPS} SELECT * FROM v")
def graph_patch_policy(t: Tables) -> DataFrame:
    return dc.patch_violations(_operations(t), t.spark.range(0, 43).select(F.concat(F.lit("p"), "id").alias("id")))


@query(f"""WITH {_OPS}, ok AS (SELECT * FROM o WHERE patch_id NOT IN (SELECT patch_id FROM v)),
l AS (SELECT target AS id, op, label AS nl FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY patch_id DESC, ordinal DESC) AS n FROM ok) WHERE n = 1),
r AS (SELECT 'p' || i AS id, 'old' AS label FROM range(0, 30) t(i))
SELECT coalesce(r.id, l.id) AS id, coalesce(nl, label) AS label FROM r FULL JOIN l ON r.id = l.id WHERE op IS NULL OR op <> 'remove'""")
def graph_patch_apply(t: Tables) -> DataFrame:
    ops = _operations(t)
    bad = dc.patch_violations(ops, t.spark.range(0, 43).select(F.concat(F.lit("p"), "id").alias("id")))
    return dc.apply_patch(t.spark.range(0, 30).select(F.concat(F.lit("p"), "id").alias("id"), F.lit("old").alias("label")), ops, bad)


@query("""
WITH s AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'ingested' ELSE 'failed' END AS status FROM events),
p AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior FROM s)
SELECT prior, status, user_id, event_id FROM p WHERE prior <> status AND (prior, status) NOT IN (('queued', 'processing'), ('processing', 'ingested'), ('processing', 'failed'), ('failed', 'queued'))""")
def import_lifecycle_check(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "view", "queued").when(kind == "click", "processing").when(kind == "purchase", "ingested").otherwise("failed")
    return dc.bad_transitions(t.events.select("user_id", "event_id", "ts", status.alias("status")), "user_id", ["ts", "event_id"]).select("prior", "status", "user_id", "event_id")


@query("""
SELECT event_id, event_type FROM events WHERE value > 50 UNION ALL SELECT event_id, event_type FROM events WHERE value > 20 AND value <= 50 AND event_type IN ('purchase', 'click')""")
def event_preservation(t: Tables) -> DataFrame:
    rows = lambda low: t.events.where(F.col("value") > low).select("event_id", "event_type")
    return dc.preserved_events(rows(50), rows(20), ["purchase", "click"])


@query("""
SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, 'N' FROM orders WHERE o_orderpriority = '1-URGENT'""")
def upsert_rows(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), "o_orderpriority")
    new = rows.where("o_orderpriority = '1-URGENT'").withColumn("status", F.lit("N"))
    return writers.upserted(rows.where("status <> 'P'").select("id", "status"), new, ["id"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def prune_rows(t: Tables) -> DataFrame:
    keep = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return writers.pruned(t.orders, keep, ["o_custkey"]).select("o_orderkey")


@query("""
WITH a AS (SELECT * FROM part WHERE p_size > 3), b AS (SELECT p_partkey, CASE WHEN p_size = 20 THEN 'x' ELSE p_name END AS p_name FROM part WHERE p_size < 45)
SELECT count(*) FILTER (a.p_partkey IS NULL) AS added, count(*) FILTER (b.p_partkey IS NULL) AS removed, count(*) FILTER (a.p_name <> b.p_name) AS changed FROM a FULL JOIN b ON a.p_partkey = b.p_partkey""")
def graph_diff(t: Tables) -> DataFrame:
    new = t.part.where("p_size < 45").select("p_partkey", F.when(F.col("p_size") == 20, "x").otherwise(F.col("p_name")).alias("p_name"))
    return writers.diff_summary(t.part.where("p_size > 3").select("p_partkey", "p_name"), new, ["p_partkey"])


@query("SELECT l_orderkey AS id, 'p' || l_partkey AS missing FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 45) GROUP BY 1, 2")
def evidence_ref_validation(t: Tables) -> DataFrame:
    records = t.lineitem.select(F.col("l_orderkey").alias("id"), F.array(F.concat(F.lit("p"), "l_partkey")).alias("refs"))
    return writers.unknown_references(records, "refs", t.part.where("p_size < 45").select(F.concat(F.lit("p"), "p_partkey").alias("evidence_id")))


@query("""
SELECT CASE WHEN event_id % 2 = 0 THEN 'memory_accepted' ELSE 'graph_materialized' END AS event_type, count(*) AS n, CAST(max(floor(epoch(ts))) AS BIGINT) AS newest FROM events WHERE value > 20 GROUP BY 1""")
def event_log_round_trip(t: Tables) -> DataFrame:
    """Events appended as JSON lines and read again; unknown kinds and broken lines are dropped."""
    path = f"{shared_dir(t.spark)}/cairn/{uuid.uuid4().hex}/events"
    kind = F.when(F.col("value") <= 20, "from_the_future").when(F.col("event_id") % 2 == 0, "memory_accepted").otherwise("graph_materialized")
    writers.append_events(t.events.select(F.col("event_id").cast("string").alias("event_id"), kind.alias("event_type"), F.unix_timestamp("ts").alias("created_at")), path)
    t.spark.createDataFrame([("{not json",)], "value string").write.mode("append").text(path)
    return readers.events(t.spark, path).groupBy("event_type").agg(F.count("*").alias("n"), F.max("created_at").alias("newest"))


@query("""
SELECT lang, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT lang, CASE WHEN lang = 'fr' THEN text || '!' ELSE text END AS text FROM documents) GROUP BY 1""")
def chunk_index_upsert(t: Tables) -> DataFrame:
    """A partitioned index of which one partition is replaced."""
    path = f"{shared_dir(t.spark)}/cairn/{uuid.uuid4().hex}/chunks"
    writers.replace_partitions(t.documents.select("doc_id", "text", "lang"), path, "lang")
    writers.replace_partitions(t.documents.where("lang = 'fr'").select("doc_id", F.concat("text", F.lit("!")).alias("text"), "lang"), path, "lang")
    return t.spark.read.parquet(path).groupBy("lang").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))


@query("SELECT 'documents' AS table_name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'events', count(*) FROM events")
def table_counts(t: Tables) -> DataFrame:
    return readers.table_counts({"documents": t.documents, "pages": t.pages, "events": t.events})


@query("SELECT p_partkey, p_name, 'left' AS side FROM part WHERE p_size = 3 UNION ALL SELECT p_partkey, p_name, 'right' FROM part WHERE p_size = 4")
def read_model_validate(t: Tables) -> DataFrame:
    rows = lambda size: t.part.where(F.col("p_size") != size).select("p_partkey", "p_name")
    return readers.differences(rows(4), rows(3))


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n, CAST(sum(CAST(('0x' || left(md5(c_nationkey || '|' || c_mktsegment || '|' || c_custkey), 15)) AS BIGINT)) AS VARCHAR) AS checksum FROM customer GROUP BY 1, 2")
def checkpoint_counts(t: Tables) -> DataFrame:
    return hs.checkpoint(t.customer.select("c_nationkey", "c_mktsegment", "c_custkey"), ["c_nationkey", "c_mktsegment"])


@query("SELECT source, CASE WHEN count(*) FILTER (n_chars < 300) = 0 THEN 'ingested' WHEN count(*) FILTER (n_chars >= 300) = 0 THEN 'failed' ELSE 'partial' END AS status FROM documents GROUP BY 1")
def page_import_status(t: Tables) -> DataFrame:
    return dc.import_status(t.documents, "source", F.col("n_chars") < 300)


@query("SELECT doc_id, CASE WHEN n_chars < 300 THEN 'again' ELSE text END AS text, CASE WHEN n_chars < 300 THEN 'ok' ELSE 'done' END AS status FROM documents")
def retry_failed_pages(t: Tables) -> DataFrame:
    pages = t.documents.select("doc_id", "text", F.when(F.col("n_chars") < 300, "failed").otherwise("done").alias("status"))
    again = pages.where("status = 'failed'").select("doc_id", F.lit("again").alias("text"), F.lit("ok").alias("status"))
    return dc.retried(pages, again, ["doc_id"])


@query("SELECT doc_id, CAST(['a', 'b' || doc_id] AS VARCHAR[]) AS refs FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, CAST([] AS VARCHAR[]) FROM documents WHERE lang <> 'en'")
def tolerant_list_decode(t: Tables) -> DataFrame:
    stored = F.when(F.col("lang") == "en", F.to_json(F.array(F.lit("a"), F.concat(F.lit("b"), "doc_id")))).otherwise("not json")
    return t.documents.select("doc_id", stored.alias("s")).select("doc_id", readers.string_list("s").alias("refs"))


@query(r"""SELECT doc_id, 'concept-' || replace(trim(regexp_replace(lower(string_split(text, chr(10))[1]), '[^\p{L}\p{N}]+', ' ', 'g')), ' ', '-') AS node_id, regexp_extract('p. ' || doc_id, '(\d+)', 1) AS page FROM documents""")
def ids_and_locators(t: Tables) -> DataFrame:
    slug = F.concat(F.lit("concept-"), F.replace(tx.normal_key(F.split("text", "\n")[0]), F.lit(" "), F.lit("-")))
    return t.documents.select("doc_id", slug.alias("node_id"), F.regexp_extract(F.concat(F.lit("p. "), "doc_id"), r"(\d+)", 1).alias("page"))
