"""Hybrid search over a workspace made of the documents: every stage, the ranking, and the union of kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..operators.hybrid import NEWEST_SOURCES, Corpus, HybridSearch
from .registry import Tables, query
from .text_queries import _GENERIC, _SPLIT, _distinct_terms

_LIMIT = 6


def workspace(t: Tables) -> Corpus:
    """Sources, evidence and pages (whole documents), nodes, edges and wiki pages."""
    d = t.documents
    n, k = F.col("doc_id"), F.col("doc_id") % 200
    kind = F.when(n % 5 == 0, "text").when(n % 5 == 1, "summary").when(n % 5 == 2, "claim").when(n % 5 == 3, "table").otherwise("relationship")
    ref = F.concat(F.lit("e"), "doc_id")
    sources = d.groupBy(F.col("source").alias("source_id")).agg(
        F.concat(F.lit("Report "), F.first("source"), F.lit(" "), F.substring(F.min_by("text", "doc_id"), 1, 60)).alias("title"), F.max("doc_id").alias("updated_at"), F.when(F.first("source") == "src3", "failed").otherwise("ingested").alias("status")
    )
    nodes = d.withColumn("k", k).groupBy("k").agg(
        F.split(F.min_by("text", "doc_id"), " ")[0].alias("label"), F.array_sort(F.collect_set("source")).alias("source_ids"), F.array_sort(F.collect_list(ref)).alias("evidence_ids")
    )
    name = lambda c: F.concat(F.lit("n"), c)
    edges = nodes.select(
        F.concat(F.lit("r"), "k").alias("edge_id"), name(F.col("k")).alias("src"), name((F.col("k") * 7 + 3) % 200).alias("dst"), F.lit("related_to").alias("kind"),
        F.lit("Related in source").alias("label"), F.array(F.concat(F.lit("e"), "k")).alias("evidence_ids"), (F.col("k") % 8 != 0).alias("live"),
    )
    wiki = d.groupBy("source").agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("low")).select(
        F.concat(F.lit("w"), "source").alias("page_id"), F.concat(F.lit("wiki/"), "source", F.lit(".md")).alias("path"), F.col("source").alias("title"), "text", F.array(F.concat(F.lit("e"), "low")).alias("evidence_refs"), (F.col("source") != "src5").alias("live")
    )
    return Corpus(
        sources=sources,
        evidence=d.select(ref.alias("evidence_id"), F.col("source").alias("source_id"), F.concat(kind, F.lit("_evidence")).alias("evidence_type"), "text", F.when(n % 7 != 0, n).alias("page"), (n % 11 != 0).alias("active")),
        pages=d.select(F.col("source").alias("source_id"), n.alias("page"), "text"),
        nodes=nodes.select(name(F.col("k")).alias("node_id"), "label", F.expr("cast(array() as array<string>)").alias("aliases"), "source_ids", "evidence_ids", (F.col("k") % 9 != 0).alias("live")),
        edges=edges, wiki=wiki,
    )


def asked(t: Tables) -> DataFrame:
    """Two words of each benchmark item; every fourth asks for relations by a word that no text holds."""
    words = F.array_join(F.slice(F.split("text", " "), 3, 2), " ")
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.concat(words, F.when(F.col("item_id") % 4 == 0, " 관계").otherwise("")).alias("text"))


def _search(t: Tables, newest: int | None = NEWEST_SOURCES) -> HybridSearch:
    return HybridSearch(workspace(t), asked(t), _LIMIT, newest)


def _has(q: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({q}), '{w}')" for w in words) + ")"


def _boost(q: str, kind: str) -> str:
    want = {k: _has(q, w) for k, w in tx.INTENTS.items()}
    return f"""(CASE WHEN {kind} = 'table_evidence' AND {want['table']} THEN 0.14 WHEN {kind} IN ('image_region_evidence', 'ocr_evidence', 'caption_evidence') AND {want['image']} THEN 0.12
  WHEN {kind} IN ('summary_evidence', 'wiki_evidence') AND {want['summary']} THEN 0.10 WHEN {kind} = 'claim_evidence' AND {want['claim']} THEN 0.10 WHEN {kind} = 'relationship_evidence' AND {want['relationship']} THEN 0.10
  WHEN {kind} = 'claim_evidence' AND {want['relationship']} THEN 0.06 WHEN {kind} = 'relationship_evidence' AND {want['claim']} THEN 0.06 ELSE 0.0 END
  + CASE WHEN {kind} = 'text_evidence' THEN 0.05 WHEN {kind} IN ('summary_evidence', 'claim_evidence', 'wiki_evidence') THEN 0.02 ELSE 0.0 END)::DOUBLE"""


def _bm25_of(name: str, rows: str, key: str, text: str) -> str:
    """Common tables that end in ``name``(query_id, key, score)."""
    return f"""
{name}_w AS (SELECT {key} AS key, {_SPLIT.format(text)} AS words FROM {rows}),
{name}_p AS (SELECT key, term, count(*) AS tf FROM (SELECT key, unnest(words) AS term FROM {name}_w) GROUP BY 1, 2),
{name}_d AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY 1),
{name}_s AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM {name}_w),
{name}_b AS (SELECT query_id, key, count(*) AS held, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / avgdl))) AS score
  FROM qt JOIN {name}_p USING (term) JOIN {name}_d USING (term) JOIN {name}_w USING (key) CROSS JOIN {name}_s GROUP BY 1, 2),
{name} AS (SELECT query_id, key, score FROM {name}_b JOIN (SELECT query_id, count(*) AS need FROM qt GROUP BY 1) USING (query_id) WHERE held = need)"""


_EXPLAIN = "[" + ", ".join(f"'{w}'" for w in tx.EXPLAINING) + "]"


def _windows(name: str, rows: str) -> str:
    """Common tables that end in ``name``(query_id, key, said): context windows of ``rows``(query_id, key, t, terms)."""
    return f"""
{name}_x AS (SELECT query_id, key, regexp_replace(coalesce(t, ''), '^\\s+|\\s+$', '', 'g') AS t, terms FROM {rows}),
{name}_t AS (SELECT *, unnest(CASE WHEN len(terms) > 1 THEN list_append(terms, array_to_string(terms, ' ')) ELSE terms END) AS term FROM {name}_x),
{name}_k AS (SELECT query_id, key, t, terms, term, unnest(string_split(lower(t), term)) AS part, generate_subscripts(string_split(lower(t), term), 1) AS k, len(string_split(lower(t), term)) AS n FROM {name}_t),
{name}_p AS (SELECT DISTINCT query_id, key, t, terms, p FROM (SELECT *, CAST(sum(length(part) + length(term)) OVER (PARTITION BY query_id, key, term ORDER BY k) - length(term) AS BIGINT) AS p FROM {name}_k) WHERE k < n),
{name}_b AS (SELECT *, CASE WHEN contains(left(t, p), chr(10) || chr(10)) THEN p - instr(reverse(left(t, p)), chr(10) || chr(10)) + 1 WHEN contains(left(t, p), chr(10)) THEN p - instr(reverse(left(t, p)), chr(10)) + 1 ELSE 0 END AS begin FROM {name}_p),
{name}_w AS (SELECT query_id, key, p, terms, left(regexp_replace(substr(t, 1 + CASE WHEN p - begin > 240 THEN greatest(p - 120, 0) ELSE begin END), '^\\s+', ''), 1600) AS said FROM {name}_b),
{name}_c AS (SELECT *, lower(said) AS low, list_transform(terms, lambda z: (length(lower(said)) - length(replace(lower(said), z, ''))) // length(z)) AS counts FROM {name}_w),
{name}_g AS (SELECT *, list_sum(list_transform(counts, lambda c: CASE WHEN c > 0 THEN 1000 + 30 * least(c, 8) ELSE 0 END)) + CASE WHEN p > 400 THEN 220 ELSE 0 END
  + 25 * len(list_filter({_EXPLAIN}, lambda z: contains(low, z))) - CASE WHEN p < 500 AND contains(low, 'contents') AND contains(low, '8.1') AND contains(low, '8.2') AND contains(low, '8.3') THEN 900 ELSE 0 END AS s FROM {name}_c),
{name} AS (SELECT x.query_id, x.key, coalesce(arg_max(said, (s, p)), any_value(left(x.t, 1600))) AS said FROM {name}_x x LEFT JOIN {name}_g g ON g.query_id = x.query_id AND g.key = x.key GROUP BY 1, 2)"""


_GRAPH = "least(coalesce(citing, 1), 10) * 0.01::DOUBLE"
_W = 3 * _LIMIT
_WORKSPACE = f"""
q AS (SELECT item_id AS query_id, array_to_string((string_split(text, ' '))[3:4], ' ') || CASE WHEN item_id % 4 = 0 THEN ' 관계' ELSE '' END AS query FROM benchmark),
qq AS (SELECT query_id, query, {_distinct_terms('query')} AS terms FROM q),
qt AS (SELECT query_id, unnest(terms) AS term FROM qq),
s AS (SELECT source AS source_id, 'Report ' || source || ' ' || left(arg_min(text, doc_id), 60) AS title, max(doc_id) AS updated_at, source = 'src3' AS failed FROM documents GROUP BY source),
e AS (SELECT 'e' || doc_id AS evidence_id, source AS source_id, CASE doc_id % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'summary' WHEN 2 THEN 'claim' WHEN 3 THEN 'table' ELSE 'relationship' END || '_evidence' AS evidence_type,
  text, CASE WHEN doc_id % 7 <> 0 THEN doc_id END AS page, doc_id % 11 <> 0 AS active FROM documents),
n AS (SELECT doc_id % 200 AS k, 'n' || (doc_id % 200) AS node_id, (string_split(arg_min(text, doc_id), ' '))[1] AS label, list_sort(list(DISTINCT source)) AS source_ids, list('e' || doc_id) AS evidence_ids, (doc_id % 200) % 9 <> 0 AS live FROM documents GROUP BY doc_id % 200),
ed AS (SELECT 'r' || k AS edge_id, 'n' || k AS src, 'n' || ((k * 7 + 3) % 200) AS dst, 'e' || k AS ref FROM n WHERE k % 8 <> 0),
w AS (SELECT 'w' || source AS page_id, 'wiki/' || source || '.md' AS path, source AS title, arg_min(text, doc_id) AS text, 'e' || min(doc_id) AS ref FROM documents WHERE source <> 'src5' GROUP BY source),
c AS (SELECT ref AS evidence_id, count(*) AS citing FROM (SELECT unnest(evidence_ids) AS ref FROM n WHERE live) GROUP BY 1),
v AS (SELECT e.*, citing FROM e JOIN s USING (source_id) LEFT JOIN c USING (evidence_id) WHERE active AND NOT failed)"""

_STAGES = f"""{_WORKSPACE},
{_bm25_of('b1', 'v', 'evidence_id', 'text')},
h1 AS (SELECT query_id, evidence_id, source_id, evidence_type, 1 AS stage, row_number() OVER (PARTITION BY query_id ORDER BY b1.score DESC, evidence_id) AS pos, b1.score + {_boost('query', 'evidence_type')} + {_GRAPH} AS delta, length(text) AS held
  FROM b1 JOIN v ON v.evidence_id = b1.key JOIN qq USING (query_id) QUALIFY pos <= {_LIMIT}),
{_bm25_of('b2', 'documents', 'doc_id', 'text')},
r2 AS (SELECT query_id, query, evidence_id, v.source_id, evidence_type, b2.score, citing, terms, b2.key, row_number() OVER (PARTITION BY query_id ORDER BY b2.score DESC, evidence_id) AS pos FROM b2 JOIN v ON v.page = b2.key JOIN qq USING (query_id) QUALIFY pos <= {_W}),
x2 AS (SELECT query_id, r2.key, d.text AS t, terms FROM r2 JOIN documents d ON d.doc_id = r2.key),
{_windows('w2', 'x2')},
n1 AS (SELECT query_id, count(*) AS n FROM h1 GROUP BY 1),
m2 AS (SELECT r2.*, length(w2.said) AS held, h1.held AS known, h1.evidence_id IS NULL AS new, coalesce(n1.n, 0) AS n1 FROM r2 JOIN w2 ON w2.query_id = r2.query_id AND w2.key = r2.key LEFT JOIN h1 ON h1.query_id = r2.query_id AND h1.evidence_id = r2.evidence_id LEFT JOIN n1 ON n1.query_id = r2.query_id),
a2 AS (SELECT *, coalesce(sum(new::INT) OVER (PARTITION BY query_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS news FROM m2),
h2 AS (SELECT query_id, evidence_id, source_id, evidence_type, 2 AS stage, pos, CASE WHEN new THEN score + 0.03::DOUBLE + {_boost('query', 'evidence_type')} + {_GRAPH} WHEN known < held THEN 0.08 ELSE 0 END AS delta, held FROM a2
  WHERE CASE WHEN new THEN news < {_W} - n1 ELSE news <= {_W} - n1 END),
h12 AS (SELECT query_id, evidence_id FROM h1 UNION SELECT query_id, evidence_id FROM h2),
ss AS (SELECT * FROM s WHERE NOT failed ORDER BY updated_at DESC, source_id LIMIT 200),
named AS (SELECT query_id, query, source_id, updated_at, len(list_filter(terms, lambda z: contains(lower(source_id || ' ' || title), z))) AS m, len(list_filter(terms, lambda z: z NOT IN {_GENERIC} AND contains(lower(source_id || ' ' || title), z))) AS sp FROM qq, ss),
first4 AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY page IS NULL, page, CASE evidence_type WHEN 'summary_evidence' THEN 0 WHEN 'text_evidence' THEN 1 ELSE 2 END, evidence_id) AS k FROM e WHERE active QUALIFY k <= 4),
r3 AS (SELECT query_id, query, f.evidence_id, f.source_id, f.evidence_type, f.page, citing, 0.75::DOUBLE + (100 * m + 200 * sp) / 100 * 0.35::DOUBLE AS boost, row_number() OVER (PARTITION BY query_id ORDER BY updated_at DESC, f.source_id, k) AS pos FROM named JOIN first4 f USING (source_id) LEFT JOIN c ON c.evidence_id = f.evidence_id WHERE sp > 0),
m3 AS (SELECT r3.*, h12.evidence_id IS NULL AS new FROM r3 LEFT JOIN h12 ON h12.query_id = r3.query_id AND h12.evidence_id = r3.evidence_id),
a3 AS (SELECT *, coalesce(sum(new::INT) OVER (PARTITION BY query_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS news FROM m3),
h3 AS (SELECT query_id, evidence_id, source_id, evidence_type, 3 AS stage, pos, CASE WHEN new THEN boost + {_boost('query', 'evidence_type')} + {_GRAPH} + CASE WHEN page IS NOT NULL THEN 0.08 ELSE 0 END::DOUBLE ELSE boost END AS delta, 0 AS held FROM a3 WHERE news < {_W}),
h123 AS (SELECT * FROM h12 UNION SELECT query_id, evidence_id FROM h3),
k3 AS (SELECT query_id, count(*) AS n FROM h123 GROUP BY 1),
ln AS (SELECT node_id, evidence_ids FROM n WHERE live),
lr AS (SELECT node_id, unnest(evidence_ids) AS evidence_id FROM ln),
seed AS (SELECT DISTINCT query_id, node_id FROM h123 JOIN lr USING (evidence_id)),
near AS (SELECT query_id, dst AS other, ref FROM seed JOIN ed ON src = node_id UNION ALL SELECT query_id, src, ref FROM seed JOIN ed ON dst = node_id),
alive AS (SELECT near.*, ln.evidence_ids FROM near JOIN ln ON ln.node_id = other),
ends AS (SELECT query_id, a.evidence_ids AS x, b.evidence_ids AS y FROM h123 JOIN ed ON ed.ref = h123.evidence_id JOIN ln a ON a.node_id = src JOIN ln b ON b.node_id = dst),
cand AS (SELECT query_id, ref AS evidence_id FROM alive UNION SELECT query_id, unnest(evidence_ids) FROM alive UNION SELECT query_id, unnest(x) FROM ends UNION SELECT query_id, unnest(y) FROM ends),
r4 AS (SELECT query_id, evidence_id, row_number() OVER (PARTITION BY query_id ORDER BY evidence_id) AS pos FROM cand JOIN v USING (evidence_id) WHERE NOT EXISTS (SELECT 1 FROM h123 h WHERE h.query_id = cand.query_id AND h.evidence_id = cand.evidence_id)),
h4 AS (SELECT r4.query_id, r4.evidence_id, v.source_id, v.evidence_type, 4 AS stage, pos, 0.04::DOUBLE + {_boost('query', 'v.evidence_type')} + {_GRAPH} AS delta, 0 AS held FROM r4 JOIN v USING (evidence_id) JOIN qq ON qq.query_id = r4.query_id LEFT JOIN k3 ON k3.query_id = r4.query_id WHERE pos <= {_W} - coalesce(k3.n, 0)),
h1234 AS (SELECT * FROM h123 UNION SELECT query_id, evidence_id FROM h4),
k4 AS (SELECT query_id, count(*) AS n FROM h1234 GROUP BY 1),
{_bm25_of('b5', 'w', 'page_id', "title || chr(10) || text")},
r5 AS (SELECT query_id, w.page_id, w.ref AS evidence_id, b5.score, row_number() OVER (PARTITION BY query_id ORDER BY b5.score DESC, page_id) AS k FROM b5 JOIN w ON w.page_id = b5.key QUALIFY k <= {_LIMIT}),
m5 AS (SELECT r5.*, row_number() OVER (PARTITION BY query_id ORDER BY k) AS pos FROM (SELECT * FROM r5 WHERE NOT EXISTS (SELECT 1 FROM h1234 h WHERE h.query_id = r5.query_id AND h.evidence_id = r5.evidence_id) QUALIFY row_number() OVER (PARTITION BY query_id, evidence_id ORDER BY k) = 1) r5),
h5 AS (SELECT m5.query_id, m5.evidence_id, m5.page_id AS source_id, 'wiki_evidence' AS evidence_type, 5 AS stage, pos, m5.score + 0.02::DOUBLE + {_boost('query', "'wiki_evidence'")} + {_GRAPH} AS delta, 0 AS held FROM m5 JOIN qq ON qq.query_id = m5.query_id LEFT JOIN v ON v.evidence_id = m5.evidence_id LEFT JOIN k4 ON k4.query_id = m5.query_id WHERE pos <= {_LIMIT} - coalesce(k4.n, 0)),
h12345 AS (SELECT * FROM h1234 UNION SELECT query_id, evidence_id FROM h5),
un AS (SELECT query_id, query, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS n FROM qq WHERE query_id NOT IN (SELECT query_id FROM h12345)),
f6 AS (SELECT query_id, query, n, v.*, row_number() OVER (PARTITION BY query_id, n ORDER BY evidence_id) AS k FROM un JOIN v ON contains(lower(v.text), term) QUALIFY k <= {_LIMIT}),
o6 AS (SELECT * FROM f6 QUALIFY row_number() OVER (PARTITION BY query_id, evidence_id ORDER BY n) = 1),
h6 AS (SELECT query_id, evidence_id, source_id, evidence_type, 6 AS stage, row_number() OVER (PARTITION BY query_id ORDER BY n, evidence_id) AS pos, {_boost('query', 'evidence_type')} + {_GRAPH} AS delta, 0 AS held FROM o6 QUALIFY pos <= {_LIMIT}),
hits AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3 UNION ALL SELECT * FROM h4 UNION ALL SELECT * FROM h5 UNION ALL SELECT * FROM h6),
tot AS (SELECT query_id, evidence_id, round(sum(delta), 6) AS score, arg_min(source_id, (stage, pos)) AS source_id, arg_min(evidence_type, (stage, pos)) AS evidence_type, min(stage) AS stage, arg_min(pos, (stage, pos)) AS pos FROM hits GROUP BY 1, 2),
best AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, stage, pos) AS rank, evidence_id, source_id, evidence_type, score, stage FROM tot QUALIFY rank <= {_LIMIT})"""


def _stage(number: int):
    return f"WITH {_STAGES} SELECT query_id, evidence_id, source_id, evidence_type, CAST(pos AS INT) AS pos, round(delta, 6) AS delta FROM hits WHERE stage = {number}"


def _of_stage(t: Tables, number: int) -> DataFrame:
    return _search(t).stages(number).where(F.col("stage") == number).select("query_id", "evidence_id", "source_id", "evidence_type", F.col("at").cast("int").alias("pos"), F.round("delta", 6).alias("delta"))


@query(_stage(1))
def hybrid_evidence_hits(t: Tables) -> DataFrame:
    return _of_stage(t, 1)


@query(_stage(2))
def hybrid_page_hits(t: Tables) -> DataFrame:
    return _of_stage(t, 2)


@query(_stage(3))
def hybrid_metadata_hits(t: Tables) -> DataFrame:
    return _of_stage(t, 3)


@query(_stage(4))
def hybrid_neighbour_hits(t: Tables) -> DataFrame:
    return _of_stage(t, 4)


@query(f"""WITH {_STAGES.replace("h1234 AS (SELECT * FROM h123 UNION SELECT query_id, evidence_id FROM h4)", "h1234 AS (SELECT query_id, evidence_id FROM h1)")}
SELECT query_id, evidence_id, source_id, evidence_type, CAST(pos AS INT) AS pos, round(delta, 6) AS delta FROM hits WHERE stage = 5""")
def hybrid_wiki_hits(t: Tables) -> DataFrame:
    """Wiki pages after the first stage alone; after all others there is seldom room for them."""
    search = _search(t)
    got = search.wiki_hits(search.evidence_hits())
    return got.select("query_id", "evidence_id", "source_id", "evidence_type", F.col("at").cast("int").alias("pos"), F.round("delta", 6).alias("delta"))


@query(_stage(6))
def hybrid_substring_hits(t: Tables) -> DataFrame:
    return _of_stage(t, 6)


@query(f"""WITH {_STAGES.replace("ss AS (SELECT * FROM s WHERE NOT failed ORDER BY updated_at DESC, source_id LIMIT 200)", "ss AS (SELECT * FROM s WHERE NOT failed)")}
SELECT query_id, CAST(rank AS INT) AS rank, evidence_id, source_id, evidence_type, score, stage FROM best""")
def hybrid_search(t: Tables) -> DataFrame:
    """All sources are looked up by their metadata; the stages' own queries look up the newest."""
    return _search(t, None).ranked()


@query(f"""WITH {_STAGES},
recs AS (SELECT 'node' AS kind, node_id AS id, label AS title, lower(node_id || ' ' || label || '  ' || array_to_string(source_ids, ' ')) AS said FROM n WHERE live
  UNION ALL SELECT 'relation', edge_id, 'Related in source', lower(edge_id || ' related_to ' || src || ' ' || dst || ' Related in source ' || ref) FROM ed
  UNION ALL SELECT 'wiki_page', page_id, title, lower(path || ' ' || title || ' ' || text) FROM w),
met AS (SELECT query_id, kind, id, title, 100 * len(list_filter(terms, lambda z: contains(said, z))) AS score FROM recs, qq),
al AS (SELECT query_id, CASE WHEN evidence_type = 'wiki_evidence' THEN 'wiki_page' ELSE 'evidence' END AS kind, evidence_id AS id, source_id AS title, CAST(round(greatest(score, 0) * 1000) AS BIGINT) AS score FROM best
  UNION ALL SELECT * FROM met WHERE score > 0),
o AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY query_id, kind, id ORDER BY score DESC, title) = 1)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, kind, id) AS INT) AS rank, kind, id, title, CAST(score AS BIGINT) AS score FROM o QUALIFY rank <= {_LIMIT}""")
def search_all_kinds(t: Tables) -> DataFrame:
    return _search(t).everything()


@query(f"""
WITH q AS (SELECT DISTINCT p_name || ' ' || CASE p_size % 9 WHEN 0 THEN 'balance sheet' WHEN 1 THEN 'which chart' WHEN 2 THEN 'an overview' WHEN 3 THEN 'the claim' WHEN 4 THEN 'edge' WHEN 5 THEN '관계' WHEN 6 THEN 'claim and relation' WHEN 7 THEN '요약' ELSE 'plain' END AS query FROM part),
k AS (SELECT unnest(['text_evidence', 'summary_evidence', 'claim_evidence', 'table_evidence', 'relationship_evidence', 'caption_evidence', 'wiki_evidence', 'other']) AS kind)
SELECT query, kind, round({_boost('query', 'kind')}, 6) AS boost FROM q, k""")
def query_intents(t: Tables) -> DataFrame:
    """Boosts of every type of evidence for a table of queries."""
    n = F.col("p_size") % 9
    said = F.when(n == 0, "balance sheet").when(n == 1, "which chart").when(n == 2, "an overview").when(n == 3, "the claim").when(n == 4, "edge").when(n == 5, "관계").when(n == 6, "claim and relation").when(n == 7, "요약").otherwise("plain")
    queries = t.part.select(F.concat_ws(" ", "p_name", said).alias("query")).distinct()
    kinds = tx.literals(["text_evidence", "summary_evidence", "claim_evidence", "table_evidence", "relationship_evidence", "caption_evidence", "wiki_evidence", "other"])
    return queries.select("query", F.explode(kinds).alias("kind")).select("query", "kind", F.round(tx.typed_boost(F.col("kind"), F.col("query")), 6).alias("boost"))
