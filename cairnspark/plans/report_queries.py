"""Packs, answers, evaluations, and plain SQL capabilities (``ext_``) that Spark brings along."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import evals, packs, retrieval as rt
from ..sources.storage import materialize
from .registry import Tables, query
from .text_queries import _BM25

_EV = f"""{_BM25},
hits AS (SELECT item_id, doc_id, round(score, 6) AS score FROM hit),
ev AS (SELECT h.item_id, h.doc_id AS evidence_id, d.source AS source_id, CASE WHEN d.lang = 'en' THEN 'text' ELSE 'claim_evidence' END AS evidence_type, d.text AS quote, score + CASE WHEN h.doc_id % 50 = 0 THEN 10000 ELSE 0 END AS score FROM hits h JOIN documents d USING (doc_id)),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, evidence_id) AS rank FROM ev) WHERE rank <= 8)"""


def _evidence(t: Tables) -> DataFrame:
    asked = rt.query_terms(t.benchmark, "item_id", "text")
    hits = rt.bm25(t.documents, "doc_id", "text", asked, "item_id").withColumn("score", F.round("score", 6))
    kind = F.when(F.col("lang") == "en", "text").otherwise("claim_evidence")
    scored = hits.select("item_id", F.col("doc_id").alias("evidence_id"), F.col("score").alias("bm25"))
    # few rows an item are kept, and the texts of these alone are read
    kept = materialize(packs.kept_evidence(scored, "item_id", F.col("bm25"), F.col("evidence_id") % 50 == 0, 4000), "kept_evidence")
    texts = t.documents.select(F.col("doc_id").alias("evidence_id"), F.col("source").alias("source_id"), kind.alias("evidence_type"), F.col("text").alias("quote"))
    return texts.join(kept, "evidence_id")


@query(f"WITH {_EV} SELECT item_id, evidence_id, source_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM kept")
def pack_caps(t: Tables) -> DataFrame:
    return _evidence(t).select("item_id", "evidence_id", "source_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_EV}
SELECT item_id, CAST(count(*) AS BIGINT) AS n, list(evidence_id ORDER BY rank) AS evidence, list_sort(list(DISTINCT source_id)) AS sources, list_sort(list(DISTINCT evidence_type)) AS types,
  CASE WHEN count(DISTINCT source_id) = 1 THEN ['single_source'] ELSE CAST([] AS VARCHAR[]) END AS warnings FROM kept GROUP BY item_id""")
def pack_nested(t: Tables) -> DataFrame:
    packed = packs.nested(_evidence(t), "item_id")
    n = F.size("evidence")
    return packed.select("item_id", n.cast("bigint").alias("n"), F.col("evidence.evidence_id").alias("evidence"), "sources", F.array_sort(F.map_keys("types")).alias("types"), packs.warnings(n, F.size("sources"), F.lit(0), F.lit(1)).alias("warnings"))


@query(f"""WITH {_EV},
f AS (SELECT item_id, source_id, evidence_id, score, row_number() OVER (PARTITION BY item_id, source_id ORDER BY score DESC, evidence_id) AS k FROM ev),
c AS (SELECT item_id, source_id, evidence_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, evidence_id) AS rank FROM f WHERE k = 1),
n AS (SELECT item_id, count(*) AS n FROM c WHERE rank <= 4 GROUP BY 1)
SELECT b.item_id, coalesce(n, 0) AS citations, CASE WHEN n > 0 THEN 'grounded' ELSE 'blocked' END AS status FROM benchmark b LEFT JOIN n USING (item_id)""")
def answer_citations(t: Tables) -> DataFrame:
    asked = rt.query_terms(t.benchmark, "item_id", "text")
    hits = rt.bm25(t.documents, "doc_id", "text", asked, "item_id").withColumn("score", F.round("score", 6) + F.when(F.col("doc_id") % 50 == 0, 10_000).otherwise(0)).join(t.documents.select("doc_id", F.col("source").alias("source_id")), "doc_id")
    cited = packs.citations(hits, "item_id", [F.desc("score"), F.col("doc_id")]).groupBy("item_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return t.benchmark.join(cited, "item_id", "left").select("item_id", n.alias("citations"), packs.answer_status(n, n).alias("status"))


@query("""
WITH d AS (SELECT source, doc_id, trim(text, ' ') AS said FROM documents),
b AS (SELECT *, coalesce(sum(length(said)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT source, CAST(before // 16777216 AS INT) AS part, string_agg('## Page ' || (doc_id + 1) || chr(10) || chr(10) || said, chr(10) || chr(10) ORDER BY doc_id) AS markdown FROM b GROUP BY 1, 2""")
def build_markdown(t: Tables) -> DataFrame:
    return packs.markdown(t.documents, "source", "doc_id", "text")


@query("""
WITH e AS (SELECT DISTINCT lang AS grp, source AS item FROM documents), f AS (SELECT DISTINCT lang AS grp, source AS item FROM documents WHERE n_chars > 6000)
SELECT e.grp, count(*) AS expected, count(f.item) AS found, count(f.item) / count(*) AS recall FROM e LEFT JOIN f ON e.grp = f.grp AND e.item = f.item GROUP BY e.grp""")
def eval_scores(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("lang").alias("grp"), F.col("source").alias("item"), "n_chars")
    return evals.recall(rows, rows.where("n_chars > 6000"), "grp", "item")


_RUNS = """runs AS (SELECT CASE l_shipmode WHEN 0 THEN 'context_page' WHEN 1 THEN 'direct' WHEN 2 THEN 'search' ELSE 'none' END AS baseline, 'd' || (l_suppkey % 5) AS document, 't' || (l_partkey % 9) AS task,
  l_quantity / 50 AS correct, l_returnflag = 'R' AS unsupported, l_extendedprice / 100 AS answer_ms FROM (SELECT *, l_orderkey % 4 AS l_shipmode FROM lineitem))"""


def _runs(t: Tables) -> DataFrame:
    n = F.col("l_orderkey") % 4
    name = F.when(n == 0, "context_page").when(n == 1, "direct").when(n == 2, "search").otherwise("none")
    return t.lineitem.select(name.alias("baseline"), F.concat(F.lit("d"), F.col("l_suppkey") % 5).alias("document"), F.concat(F.lit("t"), F.col("l_partkey") % 9).alias("task"), (F.col("l_quantity") / 50).alias("correct"), (F.col("l_returnflag") == "R").alias("unsupported"), (F.col("l_extendedprice") / 100).alias("answer_ms"))


@query(f"""WITH {_RUNS},
m AS (SELECT avg(correct) FILTER (baseline = 'context_page') AS c1, avg(correct) FILTER (baseline = 'direct') AS c2, avg(unsupported::INT) FILTER (baseline = 'context_page') AS u1, avg(unsupported::INT) FILTER (baseline = 'direct') AS u2, avg(answer_ms) FILTER (baseline = 'context_page') AS a1, avg(answer_ms) FILTER (baseline = 'direct') AS a2 FROM runs)
SELECT 'correctness' AS metric, CASE WHEN abs(c1 - c2) <= 0.0001 THEN 'tie' WHEN c1 > c2 THEN 'win' ELSE 'loss' END AS outcome FROM m
UNION ALL SELECT 'unsupported_rate', CASE WHEN abs(u1 - u2) <= 0.0001 THEN 'tie' WHEN u1 < u2 THEN 'win' ELSE 'loss' END FROM m
UNION ALL SELECT 'answer_ms', CASE WHEN abs(a1 - a2) <= greatest(a2 * 0.05, 1) THEN 'tie' WHEN a1 < a2 THEN 'win' ELSE 'loss' END FROM m""")
def bench_compare(t: Tables) -> DataFrame:
    return evals.outcomes(_runs(t), "context_page", "direct")


@query(f"WITH {_RUNS} SELECT baseline, round(avg(correct), 6) AS correctness, round(avg(unsupported::INT), 6) AS unsupported_rate, round(avg(answer_ms), 4) AS answer_ms FROM runs GROUP BY 1")
def bench_baselines(t: Tables) -> DataFrame:
    wide = evals.baselines(_runs(t)).groupBy("baseline").pivot("metric", ["correctness", "unsupported_rate", "answer_ms"]).agg(F.first("value"))
    return wide.select("baseline", F.round("correctness", 6).alias("correctness"), F.round("unsupported_rate", 6).alias("unsupported_rate"), F.round("answer_ms", 4).alias("answer_ms"))


@query("""
WITH r AS (SELECT o_custkey % 97 AS report, 'd' || (o_orderkey % 3) AS document, 't' || (o_custkey % 11) || (o_orderkey % 4) AS task, o_orderpriority AS baseline, CAST(o_totalprice AS BIGINT) - CASE WHEN o_orderkey % 500 = 0 THEN 1000000 ELSE 0 END AS ms, o_orderkey % 700 // 100 AS conf FROM orders),
t AS (SELECT report, document, task, count(DISTINCT baseline) AS kinds, count(*) AS runs, count(*) FILTER (ms <= 0) AS untimed, count(*) FILTER (conf NOT BETWEEN 1 AND 5) AS odd FROM r GROUP BY 1, 2, 3),
d AS (SELECT report, document, count(*) AS tasks, min(kinds) AS kinds, sum(runs) AS runs, sum(untimed) AS untimed, sum(odd) AS odd FROM t GROUP BY 1, 2),
a AS (SELECT report, count(*) AS documents, min(tasks) AS fewest, min(kinds) AS kinds, sum(runs) AS runs, sum(untimed) AS untimed, sum(odd) AS odd FROM d GROUP BY 1)
SELECT report, list_filter([CASE WHEN documents < 2 THEN 'documents' END, CASE WHEN fewest < 3 THEN 'tasks' END, CASE WHEN runs < 24 THEN 'runs' END, CASE WHEN kinds < 4 THEN 'baselines' END, CASE WHEN untimed > 0 THEN 'times' END, CASE WHEN odd > 0 THEN 'confidences' END], lambda x: x IS NOT NULL) AS lacks FROM a""")
def bench_report_check(t: Tables) -> DataFrame:
    """Many reports, most of which lack something."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    late = F.when(k % 500 == 0, 1_000_000).otherwise(0)
    runs = t.orders.select((c % 97).alias("report"), F.concat(F.lit("d"), k % 3).alias("document"), F.concat(F.lit("t"), c % 11, k % 4).alias("task"), F.col("o_orderpriority").alias("baseline"), (F.round("o_totalprice").cast("bigint") - late).alias("answer_ms"), F.floor(k % 700 / 100).alias("confidence"))
    return evals.report_errors(runs)


@query("""
WITH c AS (SELECT l_orderkey % 400 AS case_id, l_partkey % 60 AS evidence_id, l_suppkey % 7 AS claim_id FROM lineitem WHERE l_returnflag = 'R'), f AS (SELECT DISTINCT l_orderkey % 400 AS case_id, l_partkey % 60 AS evidence_id FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45),
w AS (SELECT DISTINCT case_id, evidence_id FROM c), b AS (SELECT coalesce(w.case_id, f.case_id) AS case_id, count(w.evidence_id) AS w, count(f.evidence_id) AS g, count(*) FILTER (w.evidence_id IS NOT NULL AND f.evidence_id IS NOT NULL) AS hit FROM w FULL JOIN f ON w.case_id = f.case_id AND w.evidence_id = f.evidence_id GROUP BY 1),
h AS (SELECT case_id, avg(CASE WHEN got THEN 1.0 ELSE 0.0 END) AS coverage FROM (SELECT c.case_id, claim_id, bool_or(f.evidence_id IS NOT NULL) AS got FROM c LEFT JOIN f ON c.case_id = f.case_id AND c.evidence_id = f.evidence_id GROUP BY 1, 2) GROUP BY 1)
SELECT case_id, round(hit / nullif(w, 0), 6) AS recall, round(hit / nullif(g, 0), 6) AS precision, round(coalesce(coverage, 0), 6) AS coverage, g - hit AS unsupported FROM b LEFT JOIN h USING (case_id)""")
def eval_cases(t: Tables) -> DataFrame:
    rows = t.lineitem.select((F.col("l_orderkey") % 400).alias("case_id"), (F.col("l_partkey") % 60).alias("evidence_id"), (F.col("l_suppkey") % 7).alias("claim_id"), "l_returnflag", "l_quantity")
    got = evals.case_scores(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag = 'A' and l_quantity > 45"))
    return got.select("case_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "coverage")], "unsupported")


@query("""SELECT p_partkey, CASE WHEN p_size IS NULL THEN 'unknown' WHEN p_size / 50.0 >= 0.8 THEN 'high' WHEN p_size / 50.0 >= 0.5 THEN 'medium' ELSE 'low' END AS bucket FROM part""")
def confidence_buckets(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", tx.confidence_bucket(F.col("p_size") / 50).alias("bucket"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace('see ' || '/home/u' || doc_id || '/a.txt and C:\tmp\x ' || text, '/home(/[^\s"''<>|,;)]+)+', '[path]', 'g'), '\b[A-Za-z]:\\[^\s"''<>|,;)]+', '[path]', 'g') AS safe, doc_id % 2 = 0 AS relative FROM documents""")
def path_redaction(t: Tables) -> DataFrame:
    said = F.concat(F.lit("see /home/u"), "doc_id", F.lit("/a.txt and C:\\tmp\\x "), "text")
    path = F.when(F.col("doc_id") % 2 == 0, "wiki/page.md").otherwise("../secret")
    return t.documents.select("doc_id", tx.redact_paths(said).alias("safe"), tx.safe_path(path).alias("relative"))


@query("""SELECT n_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)""")
def ext_rollup(t: Tables) -> DataFrame:
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.rollup("n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def ext_cube(t: Tables) -> DataFrame:
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CAST(rank() OVER w AS INT) AS r, CAST(ntile(4) OVER w AS INT) AS quartile, round(sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS recent FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def ext_window(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.rank().over(w).alias("r"), F.ntile(4).over(w).alias("quartile"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("recent"))


@query("""SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0""")
def ext_setops(t: Tables) -> DataFrame:
    pick = lambda s: t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return pick("O").intersect(pick("F")).subtract(t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("k")))


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def ext_pricing_summary(t: Tables) -> DataFrame:
    kept = t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return kept.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' GROUP BY 1""")
def ext_star_join(t: Tables) -> DataFrame:
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
