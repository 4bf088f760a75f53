"""Import artifacts, packs on disk, jobs, uploads, proposals and trials over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..operators import artifacts as ar, jobs as jb
from ..sources.storage import shared_dir
from .registry import Tables, query

_EMPTY = "CAST([] AS VARCHAR[])"


def _folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/cairn/{uuid.uuid4().hex}/{name}"


def _pages(t: Tables) -> DataFrame:
    """Documents as pages of their source; every ninth couldn't be read."""
    n = F.col("doc_id")
    return t.documents.select(F.col("source").alias("source_id"), n.alias("page"), F.concat(F.lit("Page "), n).alias("label"), F.when(n % 9 == 0, "unreadable").alias("error"), "text")


def _sources(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.col("source").alias("source_id")).agg(F.lit("w").alias("workspace_id"), F.concat(F.lit("/in/"), F.first("source"), F.lit(".pdf")).alias("path"), F.md5(F.max("text")).alias("content_hash"), F.lit("local").alias("provider_route"), F.lit(True).alias("local_only"))


@query("""
SELECT 'source_pack.v0' AS schema_version, 'w' AS workspace_id, source AS source_id, source || '.pdf' AS original_filename, md5(max(text)) AS content_hash, 'local' AS provider_route, true AS local_only, count(*) AS page_count, count(*) FILTER (doc_id % 9 = 0) AS failed_pages,
  CASE WHEN count(*) FILTER (doc_id % 9 = 0) = 0 THEN 'ingested' WHEN count(*) FILTER (doc_id % 9 = 0) = count(*) THEN 'failed' ELSE 'partial' END AS ingestion_status FROM documents GROUP BY source""")
def import_source_packs(t: Tables) -> DataFrame:
    return ar.source_packs(_sources(t), _pages(t))


@query(r"""
WITH h AS (SELECT source, md5(max(text)) AS hash FROM documents GROUP BY 1),
l AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS l FROM documents WHERE doc_id % 9 <> 0 AND length(trim(text, ' ')) > 0)
SELECT 'evidence:' || source || ':' || (doc_id + 1) AS evidence_ref, source AS source_id, doc_id + 1 AS page,
  CASE WHEN len(list_filter(range(1, len(l)), lambda i: length(l[i]) - length(replace(l[i], '|', '')) >= 2 AND regexp_full_match(l[i + 1], '[\s|:-]+') AND contains(l[i + 1], '-') AND length(l[i + 1]) - length(replace(l[i + 1], '|', '')) >= 2)) > 0 THEN 'table' ELSE 'text' END AS evidence_type,
  left(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), 420) AS quoted_text, hash AS content_hash FROM l JOIN h USING (source)""")
def import_evidence_items(t: Tables) -> DataFrame:
    return ar.evidence_items(_pages(t), ar.source_packs(_sources(t), _pages(t)))


@query("""
SELECT source AS source_id, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (doc_id % 9 <> 0 AND length(trim(text, ' ')) > 0) AS evidence, max('local') AS provider_route FROM documents GROUP BY 1""")
def output_package(t: Tables) -> DataFrame:
    """An import written to disk and read again: manifest, pages, evidence."""
    packs, pages, path = ar.source_packs(_sources(t), _pages(t)), _pages(t), _folder(t, "package")
    evidence = ar.evidence_items(pages, packs)
    ar.write_package(packs, pages, evidence, path)
    a, b, c = ar.read_package(t.spark, path, packs.schema, pages.schema, evidence.schema)
    seen = b.groupBy("source_id").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"))
    return a.select("source_id", "provider_route").join(seen, "source_id").join(c.groupBy("source_id").agg(F.count("*").alias("evidence")), "source_id", "left").select("source_id", "pages", "chars", F.coalesce("evidence", F.lit(0)).alias("evidence"), "provider_route")


def _artifacts(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as sources, with packs and indexes of which some are missing, of another version, source, workspace, hash or provider."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    sid, h = F.concat(F.lit("s"), k), F.md5("c_name")
    sources = t.customer.select(sid.alias("source_id"), F.lit("w").alias("workspace_id"), F.when(n % 7 != 1, F.concat(F.lit("file-"), h)).alias("file_hash"))
    packs = t.customer.where("c_custkey % 11 <> 0").select(
        sid.alias("for_source"), F.when(k % 13 == 0, "source_pack.v9").otherwise(ar.SOURCE_PACK).alias("schema_version"), F.when(k % 17 == 0, "other").otherwise("w").alias("workspace_id"), F.when(k % 19 == 0, "else").otherwise(sid).alias("source_id"),
        h.alias("content_hash"), F.lit("local").alias("provider_route"), F.lit(True).alias("local_only"), F.when(k % 5 == 0, F.array(F.lit("low_text"), F.lit("low_text"))).otherwise(F.expr("cast(array() as array<string>)")).alias("warnings"), (k % 3).alias("failed_pages"),
    )
    indexes = t.customer.where("c_custkey % 6 <> 0").select(
        sid.alias("for_source"), F.when(k % 23 == 0, "evidence_index.v7").when(k % 2 == 0, "evidence_index.v0").otherwise("evidence_index.v1").alias("schema_version"), F.when(k % 29 == 0, "other").otherwise("w").alias("workspace_id"), F.when(k % 31 == 0, "else").otherwise(sid).alias("source_id"),
        F.when(k % 7 == 0, "old").otherwise(h).alias("content_hash"), F.when(k % 37 == 0, "hosted").otherwise("local").alias("provider_route"), F.lit(True).alias("local_only"), F.when(k % 4 == 1, F.array(F.lit("few_pages"))).otherwise(F.expr("cast(array() as array<string>)")).alias("warnings"),
    )
    return sources, packs, indexes


_CHECKED = f"""
s AS (SELECT c_custkey AS k, 's' || c_custkey AS source_id, md5(c_name) AS h, CASE WHEN c_nationkey % 7 <> 1 THEN 'file-' || md5(c_name) END AS file_hash FROM customer),
p AS (SELECT *, CASE WHEN k % 11 = 0 THEN ['source_pack_missing'] ELSE list_filter([CASE WHEN k % 13 = 0 THEN 'source_pack_schema_mismatch' END, CASE WHEN k % 19 = 0 THEN 'source_pack_source_mismatch' END, CASE WHEN k % 17 = 0 THEN 'source_pack_workspace_mismatch' END], lambda x: x IS NOT NULL) END AS pf FROM s),
o AS (SELECT *, len(pf) = 0 AS pack_ok, CASE WHEN len(pf) = 0 THEN h ELSE file_hash END AS content_hash, CASE WHEN len(pf) = 0 THEN 'local' WHEN file_hash IS NOT NULL THEN 'unknown' END AS provider_route, CASE WHEN len(pf) = 0 THEN true WHEN file_hash IS NOT NULL THEN false END AS local_only FROM p),
i AS (SELECT *, CASE WHEN content_hash IS NULL THEN {_EMPTY} WHEN k % 6 = 0 THEN CASE WHEN pack_ok THEN ['evidence_index_missing'] ELSE {_EMPTY} END ELSE list_filter([CASE WHEN k % 23 = 0 THEN 'evidence_index_schema_mismatch' END, CASE WHEN k % 31 = 0 THEN 'evidence_index_source_mismatch' END, CASE WHEN k % 29 = 0 THEN 'evidence_index_workspace_mismatch' END,
  CASE WHEN pack_ok AND k % 37 = 0 THEN 'evidence_index_provider_mismatch' END, CASE WHEN content_hash <> CASE WHEN k % 7 = 0 THEN 'old' ELSE h END THEN 'evidence_index_stale_content_hash' END], lambda x: x IS NOT NULL)[1:1] END AS jf FROM o),
chk AS (SELECT *, content_hash IS NOT NULL AND k % 6 <> 0 AND len(jf) = 0 AS index_ok FROM i),
chw AS (SELECT *, list_concat(list_concat(pf, jf), list_concat(CASE WHEN pack_ok AND k % 5 = 0 THEN ['low_text'] ELSE {_EMPTY} END, CASE WHEN index_ok AND k % 4 = 1 THEN ['few_pages'] ELSE {_EMPTY} END)) AS warnings FROM chk)"""


@query(f"WITH {_CHECKED} SELECT source_id, content_hash, provider_route, local_only, warnings, pack_ok, index_ok FROM chw")
def artifact_checks(t: Tables) -> DataFrame:
    return ar.checked(*_artifacts(t))


@query(f"WITH {_CHECKED} SELECT w AS warning, count(*) AS sources FROM (SELECT unnest(warnings) AS w FROM chw) GROUP BY 1")
def artifact_warnings(t: Tables) -> DataFrame:
    return ar.warning_counts(ar.checked(*_artifacts(t)))


@query(f"""WITH {_CHECKED},
x AS (SELECT source_id, CASE WHEN pack_ok AND index_ok THEN 'matched' WHEN list_contains(warnings, 'evidence_index_stale_content_hash') THEN 'mismatched' WHEN pack_ok THEN 'source_pack_only' ELSE 'unknown' END AS hash_status, CASE WHEN k % 11 = 0 THEN 0 ELSE k % 3 END AS failed_pages, pack_ok, len(warnings) AS n FROM chw)
SELECT source_id, hash_status, failed_pages, CAST(n AS INT) AS n_warnings, CASE WHEN hash_status = 'mismatched' THEN 'stale' WHEN NOT pack_ok THEN 'incomplete' WHEN failed_pages > 0 THEN 'degraded' WHEN n > 0 THEN 'warned' ELSE 'healthy' END AS health FROM x""")
def source_health(t: Tables) -> DataFrame:
    sources, packs, indexes = _artifacts(t)
    return ar.health(ar.checked(sources, packs, indexes), packs)


@query(f"""WITH {_CHECKED},
it AS (SELECT 's' || o_custkey AS f, 'e' || o_orderkey AS ref, CASE WHEN o_orderkey % 41 = 0 THEN 'else' ELSE 's' || o_custkey END AS sid, CAST(o_orderkey % 9 AS INT) AS page, CASE WHEN o_orderkey % 10 = 3 THEN 'old' END AS bad FROM orders),
m AS (SELECT it.*, k, CASE WHEN sid <> f THEN 'evidence_item_source_mismatch' WHEN bad IS NOT NULL OR content_hash <> h THEN 'evidence_item_stale_content_hash' END AS warning FROM it JOIN chw ON chw.source_id = f AND index_ok)
SELECT f AS source_id, coalesce(warning, 'usable') AS state, count(*) AS n, min(page) AS first_page FROM m GROUP BY 1, 2""")
def artifact_evidence(t: Tables) -> DataFrame:
    """Evidence items held against the checked sources: usable ones and warnings."""
    k = F.col("o_orderkey")
    own = t.customer.select(F.concat(F.lit("s"), "c_custkey").alias("for_source"), F.md5("c_name").alias("h"))
    items = t.orders.select(F.concat(F.lit("s"), "o_custkey").alias("for_source"), F.concat(F.lit("e"), k).alias("evidence_ref"), F.when(k % 41 == 0, "else").otherwise(F.concat(F.lit("s"), "o_custkey")).alias("source_id"), (k % 9).cast("int").alias("page"), F.when(k % 10 == 3, "old").alias("bad"))
    items = items.join(own, "for_source").withColumn("content_hash", F.coalesce("bad", "h"))
    good, bad = ar.usable_evidence(ar.checked(*_artifacts(t)), items)
    both = good.select(F.col("for_source").alias("source_id"), F.lit("usable").alias("state"), "page").unionByName(bad.select("source_id", F.col("warning").alias("state"), "page"))
    return both.groupBy("source_id", "state").agg(F.count("*").alias("n"), F.min("page").alias("first_page"))


def _packs(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p")).alias("x"))
    listed = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("x")).alias("xs"))
    item = lambda x: F.struct(F.concat(F.lit("e"), x["p"]).alias("evidence_id"), F.concat(F.lit("text "), x["n"]).alias("quoted_text"), F.when(x["n"] % 2 == 0, F.create_map(F.lit("content_hash"), F.concat(F.lit("h"), x["p"]), F.lit("page"), x["n"].cast("string"))).otherwise(F.create_map(F.lit("other"), F.lit("x"))).alias("metadata"))
    return listed.select(F.concat(F.lit("pack"), "l_orderkey").alias("pack_id"), F.lit(8000).alias("budget"), F.transform("xs", item).alias("evidence"))


@query("""
WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber AS n, l_partkey AS p FROM lineitem)
SELECT 'pack' || l_orderkey AS pack_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY n, p) - 1 AS INT) AS place, 'e' || p AS evidence_id, 'text ' || n AS quoted_text, CASE WHEN n % 2 = 0 THEN 'h' || p END AS content_hash, CASE WHEN n % 2 = 0 THEN n END AS page FROM r""")
def pack_persist_and_items(t: Tables) -> DataFrame:
    """Packs written as artifacts, read again by their schema, and their evidence with what its metadata tells."""
    path = _folder(t, "packs")
    ar.persist_pack(_packs(t), path)
    schema = "struct<budget:int,evidence:array<struct<evidence_id:string,quoted_text:string,metadata:map<string,string>>>>"
    return ar.pack_items(ar.read_pack(t.spark, path, schema))


@query("""
WITH k AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem)
SELECT 'part' AS kind, p_partkey AS id FROM part WHERE p_partkey IN (SELECT p FROM k) UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE s_suppkey IN (SELECT s FROM k)""")
def pack_row_loads(t: Tables) -> DataFrame:
    packs = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"), F.collect_set("l_suppkey").alias("suppliers"))
    rows = ar.loaded_rows(packs, {"part": t.part.withColumnRenamed("p_partkey", "part_id"), "supplier": t.supplier.withColumnRenamed("s_suppkey", "supplier_id")}, {"part": "parts", "supplier": "suppliers"})
    return rows["part"].select(F.lit("part").alias("kind"), F.col("part_id").alias("id")).unionByName(rows["supplier"].select(F.lit("supplier").alias("kind"), F.col("supplier_id").alias("id")))


@query(r"""
SELECT 'e' || doc_id AS evidence_id, '/in/' || source || '.pdf' AS source_path, doc_id AS page, CASE WHEN doc_id % 3 <> 0 THEN left(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), 600) END AS page_text FROM documents""")
def evidence_proof(t: Tables) -> DataFrame:
    pages = _pages(t).where("page % 3 <> 0")
    return ar.proofs(t.documents.select(F.concat(F.lit("e"), "doc_id").alias("evidence_id"), F.col("source").alias("source_id"), F.col("doc_id").alias("page")), pages, _sources(t))


@query("SELECT DISTINCT l_orderkey AS page_id FROM lineitem WHERE l_suppkey IN (3, 5, 8)")
def wiki_by_source(t: Tables) -> DataFrame:
    wiki = t.lineitem.groupBy(F.col("l_orderkey").alias("page_id")).agg(F.collect_set("l_suppkey").alias("source_refs"))
    return ar.wiki_by_source(wiki, t.spark.createDataFrame([(3,), (5,), (8,)], "source_id bigint")).select("page_id")


@query("SELECT event_id, strftime(make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def iso_times(t: Tables) -> DataFrame:
    return t.events.select("event_id", ar.iso_time(F.unix_timestamp("ts")).alias("at"))


# uploads and jobs
@query("""
SELECT 'u' || doc_id || '.' || e AS name, CASE WHEN e IN ('md', 'txt') THEN 'text' WHEN e = 'html' THEN 'markup' WHEN e = 'pdf' THEN 'external' ELSE 'unknown' END AS route,
  CASE WHEN e = 'pdf' THEN 'waiting' WHEN e = 'xyz' THEN 'failed' WHEN length(body) = 0 THEN 'failed' ELSE 'parsed' END AS status, CASE WHEN e IN ('md', 'txt', 'html') THEN body ELSE '' END AS text,
  CASE WHEN e = 'xyz' THEN ['unknown_format'] WHEN e <> 'pdf' AND length(body) = 0 THEN ['no_text'] ELSE CAST([] AS VARCHAR[]) END AS warnings
FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'md' WHEN 1 THEN 'txt' WHEN 2 THEN 'html' WHEN 3 THEN 'pdf' ELSE 'xyz' END AS e, CASE WHEN doc_id % 35 = 0 THEN '' WHEN doc_id % 5 = 2 THEN trim(lang || ' ' || source, ' ') ELSE source || chr(10) || lang END AS body FROM documents)""")
def parse_documents(t: Tables) -> DataFrame:
    """Uploads of several formats, routed by their names."""
    n = F.col("doc_id")
    kind = F.when(n % 5 == 0, "md").when(n % 5 == 1, "txt").when(n % 5 == 2, "html").when(n % 5 == 3, "pdf").otherwise("xyz")
    body = F.when(n % 35 == 0, "").when(n % 5 == 2, F.concat(F.lit("<html><script>var a='<p>';</script><p>"), "lang", F.lit("</p>\n <b>"), "source", F.lit("</b></html>"))).otherwise(F.concat("source", F.lit("\r\n"), "lang", F.lit(" \n\n")))
    files = t.documents.select(F.concat(F.lit("u"), n, F.lit("."), kind).alias("path"), body.cast("binary").alias("content"))
    return jb.parse_documents(files).withColumnRenamed("path", "name")


@query("""
SELECT 'u' || doc_id AS path, CAST(i - 1 AS INT) AS pos, s[i] AS event FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ['started', 'page_parsed', 'finished'] WHEN 1 THEN ['started', 'handed_over'] ELSE ['started', 'failed'] END AS s FROM documents))""")
def parse_events(t: Tables) -> DataFrame:
    n = F.col("doc_id")
    parsed = t.documents.select(F.concat(F.lit("u"), n).alias("path"), F.when(n % 3 == 0, "parsed").when(n % 3 == 1, "waiting").otherwise("failed").alias("status"))
    return jb.parse_events(parsed).withColumnRenamed("at", "pos")


@query("""
WITH u AS (SELECT lang AS w, source AS title, text, doc_id AS a, sha256(text) AS h FROM documents UNION ALL SELECT lang, 'again', text, doc_id + 100000, sha256(text) FROM documents WHERE doc_id % 4 = 0),
i AS (SELECT *, left(sha256(w || '|' || h), 32) AS sid FROM u)
SELECT sid AS source_id, w AS workspace_id, arg_min(title, (a, title)) AS title, h AS content_hash, min(a) AS at_, 'job-' || sid AS job_id, 'queued' AS status, octet_length(encode(any_value(text))) AS bytes FROM i GROUP BY sid, w, h""")
def upload_ingest(t: Tables) -> DataFrame:
    """Uploaded texts as sources, blobs and jobs; the same text again is the same source."""
    d = t.documents
    uploads = d.select(F.col("lang").alias("workspace_id"), F.col("source").alias("title"), "text", F.col("doc_id").alias("at")).unionByName(d.where("doc_id % 4 = 0").select(F.col("lang").alias("workspace_id"), F.lit("again").alias("title"), "text", (F.col("doc_id") + 100000).alias("at")))
    sources, blobs, jobs = jb.ingested(uploads)
    met = sources.select("source_id", "workspace_id", "title", "content_hash", F.col("at").alias("at_")).join(jobs.select("source_id", "job_id", "status"), "source_id")
    return met.join(blobs.select(F.col("key").alias("content_hash"), F.length("content").cast("bigint").alias("bytes")), "content_hash")


def _jobs(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "queued").otherwise("processing")
    lease = F.when(F.col("o_orderstatus") == "P", k % 900)
    return t.orders.select(k.alias("job_id"), F.col("o_custkey").alias("source_id"), status.alias("status"), (F.col("o_custkey") % 4).alias("attempts"), (k % 1000).alias("available_at"), lease.alias("lease_until"), F.concat(F.lit("w"), k % 3).alias("worker"))


_JOBS = """j AS (SELECT o_orderkey AS job_id, o_custkey AS source_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'queued' ELSE 'processing' END AS status, o_custkey % 4 AS attempts, o_orderkey % 1000 AS available_at, CASE WHEN o_orderstatus = 'P' THEN o_orderkey % 900 END AS lease_until, 'w' || (o_orderkey % 3) AS worker FROM orders)"""


@query(f"""WITH {_JOBS} SELECT job_id, 'processing' AS status, attempts + 1 AS attempts, available_at, CAST(800 AS BIGINT) AS lease_until, 'me' AS worker FROM j WHERE attempts < 3 AND ((status = 'queued' AND available_at <= 500) OR (status = 'processing' AND lease_until < 500)) ORDER BY available_at, job_id LIMIT 16""")
def job_claim(t: Tables) -> DataFrame:
    return jb.claimed(_jobs(t), F.lit(500), "me").withColumn("lease_until", F.col("lease_until").cast("bigint"))


@query(f"""WITH {_JOBS} SELECT job_id, CASE WHEN status = 'processing' AND lease_until < 500 THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END ELSE status END AS status, attempts, available_at, CASE WHEN status = 'processing' AND lease_until < 500 THEN NULL ELSE lease_until END AS lease_until FROM j""")
def job_recovery(t: Tables) -> DataFrame:
    """One round of the recovery loop, over a stored table that it rewrites."""
    path = _folder(t, "jobs")
    _jobs(t).write.parquet(f"{path}/0")
    state = [f"{path}/0"]

    def write(rows: DataFrame) -> None:
        rows.write.parquet(f"{path}/{len(state)}")
        state.append(f"{path}/{len(state)}")

    jb.recovery_loop(lambda: t.spark.read.parquet(state[-1]), write, 2, 0.0, lambda: 500)
    return t.spark.read.parquet(state[-1]).select("job_id", "status", "attempts", "available_at", "lease_until")


@query(f"""WITH {_JOBS},
r AS (SELECT o_orderkey AS job_id, 'w' || (o_orderkey % 2) AS who, o_orderkey % 5 < 2 AS ok, o_orderkey % 5 < 4 AS retry FROM orders WHERE o_orderkey % 7 <> 0),
m AS (SELECT j.*, ok, retry, coalesce(status = 'processing' AND worker = who AND lease_until >= 300, false) AS holds FROM j LEFT JOIN r USING (job_id))
SELECT job_id, CASE WHEN NOT holds THEN status WHEN ok THEN 'succeeded' WHEN retry AND attempts < 3 THEN 'queued' ELSE 'failed' END AS status, attempts, CASE WHEN holds AND NOT ok AND retry AND attempts < 3 THEN 330 ELSE available_at END AS available_at FROM m""")
def job_results(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    results = t.orders.where("o_orderkey % 7 <> 0").select(k.alias("job_id"), F.concat(F.lit("w"), k % 2).alias("worker"), (k % 5 < 2).alias("ok"), (k % 5 < 4).alias("retry"))
    return jb.finished(_jobs(t), results, F.lit(300)).withColumn("available_at", F.col("available_at").cast("bigint"))


@query(f"WITH {_JOBS} SELECT job_id, source_id, status, CASE WHEN status <> 'failed' AND source_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'graph_ready' ELSE 'pending' END AS graph_status FROM j")
def job_graph_status(t: Tables) -> DataFrame:
    jobs = _jobs(t).select("job_id", "source_id", "status", F.lit("pending").alias("graph_status"))
    return jb.graph_status(jobs, t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("source_id")), "graph_ready")


@query(f"WITH {_JOBS} SELECT c_custkey AS source_id, c_name AS title, job_id, status AS job_status FROM customer JOIN j ON c_custkey = source_id WHERE status IN ('queued', 'processing') AND c_acctbal > 0")
def dispatchable_sources(t: Tables) -> DataFrame:
    sources = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("title"))
    return jb.dispatchable(sources, _jobs(t), ["queued", "processing"])


@query(f"""WITH {_JOBS}, n AS (SELECT source_id, job_id, status, row_number() OVER (PARTITION BY source_id ORDER BY available_at DESC, job_id DESC) AS k FROM j)
SELECT c_custkey AS source_id, c_name AS title, job_id, status AS job_status FROM customer LEFT JOIN n ON c_custkey = source_id AND k = 1""")
def snapshot_sources(t: Tables) -> DataFrame:
    sources = t.customer.select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("title"))
    return jb.with_jobs(sources, _jobs(t).withColumnRenamed("available_at", "at")).select("source_id", "title", "job_id", "job_status")


@query("""
WITH o AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'wiki_page' WHEN 'F' THEN 'memory' ELSE 'graph_change' END AS kind, repeat('line' || chr(10), CAST(o_orderkey % 60 AS INT)) || repeat('x', CAST(o_orderkey % 2500 AS INT)) AS body FROM orders)
SELECT id AS proposal_id, kind, kind <> 'memory' AND (length(body) > 2000 OR len(string_split(body, chr(10))) > 40) AS needs_approval, CASE WHEN kind <> 'memory' AND (length(body) > 2000 OR len(string_split(body, chr(10))) > 40) THEN 'pending' ELSE 'committed' END AS status FROM o""")
def write_proposals(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.when(F.col("o_orderstatus") == "O", "wiki_page").when(F.col("o_orderstatus") == "F", "memory").otherwise("graph_change")
    body = F.concat(F.repeat(F.lit("line\n"), (k % 60).cast("int")), F.repeat(F.lit("x"), (k % 2500).cast("int")))
    return jb.approvals(t.orders.select(k.alias("proposal_id"), kind.alias("kind"), body.alias("body")))


@query("""
WITH p AS (SELECT o_orderkey AS proposal_id, CASE o_orderstatus WHEN 'F' THEN 'committed' WHEN 'O' THEN 'pending' ELSE 'ready' END AS status, o_custkey % 3 AS v, o_custkey % 2 = 0 AS approved FROM orders WHERE o_orderkey % 5 <> 0),
c AS (SELECT o_orderkey AS proposal_id, CAST(1 AS BIGINT) AS at_v FROM orders)
SELECT proposal_id, fault FROM (SELECT c.proposal_id, CASE WHEN status IS NULL THEN 'unknown' WHEN status = 'committed' THEN 'already_committed' WHEN status = 'pending' AND NOT approved THEN 'not_approved' WHEN v <> at_v THEN 'stale_version' END AS fault FROM c LEFT JOIN p USING (proposal_id)) WHERE fault IS NOT NULL""")
def commit_validation(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "committed").when(F.col("o_orderstatus") == "O", "pending").otherwise("ready")
    proposals = t.orders.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("proposal_id"), status.alias("status"), (F.col("o_custkey") % 3).alias("base_version"), (F.col("o_custkey") % 2 == 0).alias("approved"))
    return jb.commit_faults(proposals, t.orders.select(F.col("o_orderkey").alias("proposal_id"), F.lit(1).alias("base_version")))


@query("""
WITH r AS (SELECT user_id AS log_id, event_type, event_id FROM events), a AS (SELECT log_id, count(*) AS runs, count(*) FILTER (event_type = 'purchase' AND event_id % 2 = 0) AS cited, count(*) FILTER (event_type = 'click') AS second_query, count(*) FILTER (event_type = 'error') AS second_document FROM r GROUP BY 1),
b AS (SELECT user_id AS log_id, count(*) AS reuse, count(*) FILTER (event_id % 9 = 1) AS day_1, count(*) FILTER (event_id % 9 = 7) AS day_7 FROM events WHERE value > 60 GROUP BY 1),
w AS (SELECT a.*, coalesce(reuse, 0) AS reuse, coalesce(day_1, 0) AS day_1, coalesce(day_7, 0) AS day_7 FROM a LEFT JOIN b USING (log_id)), l AS (UNPIVOT w ON runs, cited, second_query, second_document, reuse, day_1, day_7 INTO NAME gate VALUE value)
SELECT log_id, gate, value, value >= CASE gate WHEN 'runs' THEN 10 WHEN 'cited' THEN 5 WHEN 'second_query' THEN 3 WHEN 'reuse' THEN 10 ELSE 1 END AS passed FROM l""")
def dry_run_metrics(t: Tables) -> DataFrame:
    """Trial logs (one for each user) against the gates."""
    kind, n = F.col("event_type"), F.col("event_id")
    done = F.array_compact(F.array(F.when(kind == "purchase", "source_refs"), F.when(kind == "purchase", "page_refs"), F.when((kind == "purchase") & (n % 2 == 0), "evidence_refs"), F.when(kind == "click", "second_query"), F.when(kind == "error", "second_document")))
    runs = t.events.select(F.col("user_id").alias("log_id"), done.alias("milestones"))
    reuse = t.events.select(F.col("user_id").alias("log_id"), (F.col("value") > 60).alias("same_set"), (n % 9).alias("day_offset"))
    return jb.trial_gates(runs, reuse)
