"""Answers, reader packs and chat plans over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..operators import answers as an, reader as rd
from .registry import Tables, query
from .text_queries import _distinct_terms

_EMPTY = "CAST([] AS VARCHAR[])"


def _stem(w: str) -> str:
    return f"""CASE WHEN {w} LIKE '%ies' AND length({w}) > 4 THEN left({w}, length({w}) - 3) || 'y' WHEN {w} LIKE '%ing' AND length({w}) > 5 THEN left({w}, length({w}) - 3)
  WHEN ({w} LIKE '%ed' OR {w} LIKE '%es') AND length({w}) > 4 AND {w} NOT LIKE '%ses' THEN left({w}, length({w}) - 2)
  WHEN {w} LIKE '%s' AND length({w}) > 4 AND {w} NOT LIKE '%ss' AND {w} NOT LIKE '%us' THEN left({w}, length({w}) - 1) ELSE {w} END"""


def _tokens(text: str) -> str:
    return f"list_filter(list_transform(list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^a-z0-9]+'), lambda w: length(w) > 1), lambda w: {_stem('w')}), lambda w: length(w) > 1)"


def _score(words: str, terms: str) -> str:
    """The match of stemmed words with stemmed terms."""
    each = f"""list_transform({terms}, lambda t: CASE WHEN list_contains({words}, t) THEN 8 + 2 * len(list_filter({words}, lambda x: x = t))
    WHEN length(t) > 3 AND len(list_filter({words}, lambda x: starts_with(x, t) OR starts_with(t, x))) > 0 THEN 3 ELSE 0 END)"""
    hits = f"len(list_filter({each}, lambda x: x > 0))"
    return f"(CASE WHEN {hits} > 0 THEN list_sum({each}) + {hits} * {hits} + CASE WHEN {hits} = len({terms}) THEN 10 ELSE 0 END ELSE 0 END)"


def _segments(name: str, rows: str, key: str, text: str) -> str:
    """Common tables that end in ``name``(key, at, segment): the useful segments of ``rows``' texts in order."""
    return f"""
{name}_l AS (SELECT {key} AS key, unnest(string_split(coalesce({text}, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce({text}, ''), chr(10)), 1) AS a FROM {rows}),
{name}_c AS (SELECT key, a, trim(regexp_replace(ltrim(trim(regexp_replace(replace(replace(replace(l, chr(13), ' '), '**', ''), '`', ''), '\\s+', ' ', 'g'), ' '), '#-*• '), '\\s+', ' ', 'g'), ' ') AS l FROM {name}_l),
{name}_n AS (SELECT key, a, l, string_split(regexp_replace(replace(l, ' ', '  '), '(^| )(\\d+\\.\\d+ )', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS parts FROM {name}_c WHERE l <> ''),
{name}_s AS (SELECT key, a, unnest(CASE WHEN len(parts) > 2 THEN list_filter(list_transform(parts[2:], lambda p: trim(replace(p, '  ', ' '), ' ')), lambda p: p <> '') ELSE [l] END) AS s, generate_subscripts(CASE WHEN len(parts) > 2 THEN list_filter(list_transform(parts[2:], lambda p: trim(replace(p, '  ', ' '), ' ')), lambda p: p <> '') ELSE [l] END, 1) AS b FROM {name}_n),
{name}_p AS (SELECT key, a, b, unnest(CASE WHEN length(s) > 320 THEN string_split(regexp_replace(s, '([.!?。؟])(\\s)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) ELSE [s] END) AS p, generate_subscripts(CASE WHEN length(s) > 320 THEN string_split(regexp_replace(s, '([.!?。؟])(\\s)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) ELSE [s] END, 1) AS c, length(s) > 320 AS cut FROM {name}_s),
{name}_k AS (SELECT key, a, b, c, i, CASE WHEN cut THEN trim(substr(p, 260 * i + 1, 260), ' ') ELSE p END AS segment FROM (SELECT *, unnest(range(0, CASE WHEN cut THEN greatest(CAST(ceil(length(p) / 260) AS BIGINT), 1) ELSE 1 END)) AS i FROM {name}_p)),
{name} AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY a, b, c, i) - 1 AS pos, segment FROM {name}_k WHERE length(segment) >= 8 AND NOT starts_with(lower(segment), 'source evidence prepared from') AND NOT starts_with(lower(segment), 'derived graph nodes') AND lower(segment) <> 'no visible evidence snippet is available yet.')"""


_LINED = "(SELECT doc_id, '## **About** 1.1 Alpha beta 2.2 ' || lang || ' gamma delta' || chr(10) || '- `item` ' || source || chr(13) || chr(10) || text AS said FROM documents)"


@query(f"WITH {_segments('seg', _LINED, 'doc_id', 'said')} SELECT key AS doc_id, CAST(pos AS INT) AS pos, segment FROM seg")
def answer_segments(t: Tables) -> DataFrame:
    head = F.concat(F.lit("## **About** 1.1 Alpha beta 2.2 "), "lang", F.lit(" gamma delta\n- `item` "), "source", F.lit("\r\n"), "text")
    return t.documents.select("doc_id", F.posexplode(an.segments(head)).alias("pos", "segment"))


def _tables(t: Tables) -> dict[str, DataFrame]:
    d, n = t.documents, F.col("doc_id")
    cat = lambda p, c: F.concat(F.lit(p), F.col(c))
    return {
        "chunk": d.select(cat("k", "doc_id").alias("chunk_id"), F.array("source", "lang").alias("heading_path"), "text", F.col("source").alias("source_id")),
        "evidence": d.select(cat("e", "doc_id").alias("evidence_id"), cat("Page ", "doc_id").alias("page_label"), F.col("text").alias("snippet"), F.col("source").alias("source_id")),
        "claim": t.part.select(cat("c", "p_partkey").alias("claim_id"), F.concat_ws(" ", "p_name", "p_type").alias("statement"), F.array(F.concat(F.lit("n"), F.col("p_partkey") % 25)).alias("topic_refs"), F.array(F.concat(F.lit("src"), F.col("p_partkey") % 20)).alias("source_refs"), F.array(F.concat(F.lit("e"), F.col("p_partkey") % 300), cat("e", "p_partkey")).alias("evidence_refs")),
        "memory": t.supplier.select(cat("m", "s_suppkey").alias("memory_id"), F.col("s_name").alias("title"), F.concat_ws(" ", F.lit("ring widget of"), "s_nationkey").alias("body"), F.expr(an._NONE).alias("source_refs"), F.array(F.concat(F.lit("e"), F.col("s_suppkey") % 90)).alias("evidence_refs")),
        "relation": t.nation.select(cat("r", "n_nationkey").alias("relation_id"), F.col("n_name").alias("label"), F.lit("RelatedTo").alias("kind"), cat("n", "n_nationkey").alias("src"), F.concat(F.lit("n"), (F.col("n_nationkey") * 7 + 1) % 25).alias("dst"), F.array(cat("e", "n_nationkey")).alias("evidence_ids")),
        "node": t.nation.select(cat("n", "n_nationkey").alias("node_id"), F.col("n_name").alias("label"), F.array(F.lit("small"), F.concat_ws(" ", F.lit("bolt"), "n_regionkey")).alias("aliases"), F.array(F.concat(F.lit("src"), F.col("n_nationkey") % 20)).alias("source_ids"), F.array(cat("e", "n_nationkey"), F.lit("e1")).alias("evidence_ids")),
        "wiki": t.region.select(cat("w", "r_regionkey").alias("page_id"), cat("wiki/", "r_name").alias("path"), F.col("r_name").alias("title"), F.concat_ws(" ", F.lit("All about the red gear and"), "r_name").alias("body"), F.array(cat("n", "r_regionkey")).alias("node_refs"), F.expr(an._NONE).alias("source_refs"), F.array(F.lit("e2")).alias("evidence_refs")),
        "source": d.groupBy(F.col("source").alias("source_id")).agg(F.concat(F.lit("in/"), F.first("source")).alias("path"), F.concat(F.lit("Holds "), F.count("*").cast("string"), F.lit(" texts")).alias("description")),
    }


_KINDS = f"""
cand AS (
  SELECT 'source chunk' AS kind, 0 AS kind_rank, 'k' || doc_id AS id, source || ' / ' || lang AS title, text AS body, {_EMPTY} AS nodes, {_EMPTY} AS relations, [source] AS sources, {_EMPTY} AS evidence FROM documents
  UNION ALL SELECT 'evidence', 1, 'e' || doc_id, 'Page ' || doc_id, text, {_EMPTY}, {_EMPTY}, [source], ['e' || doc_id] FROM documents
  UNION ALL SELECT 'claim', 2, 'c' || p_partkey, p_name || ' ' || p_type, p_name || ' ' || p_type || ' n' || (p_partkey % 25) || ' src' || (p_partkey % 20), ['n' || (p_partkey % 25)], {_EMPTY}, ['src' || (p_partkey % 20)], ['e' || (p_partkey % 300), 'e' || p_partkey] FROM part
  UNION ALL SELECT 'memory', 3, 'm' || s_suppkey, s_name, s_name || ' ring widget of ' || s_nationkey, {_EMPTY}, {_EMPTY}, {_EMPTY}, ['e' || (s_suppkey % 90)] FROM supplier
  UNION ALL SELECT 'relation', 4, 'r' || n_nationkey, n_name, 'RelatedTo: n' || n_nationkey || ' ' || n_name || ' n' || ((n_nationkey * 7 + 1) % 25), ['n' || n_nationkey, 'n' || ((n_nationkey * 7 + 1) % 25)], ['r' || n_nationkey], {_EMPTY}, ['e' || n_nationkey] FROM nation
  UNION ALL SELECT 'node', 5, 'n' || n_nationkey, n_name, 'n' || n_nationkey || ' ' || n_name || ' small bolt ' || n_regionkey || ' src' || (n_nationkey % 20), ['n' || n_nationkey], {_EMPTY}, ['src' || (n_nationkey % 20)], ['e' || n_nationkey, 'e1'] FROM nation
  UNION ALL SELECT 'wiki page', 6, 'w' || r_regionkey, r_name, 'wiki/' || r_name || ' ' || r_name || ' All about the red gear and ' || r_name, ['n' || r_regionkey], {_EMPTY}, {_EMPTY}, ['e2'] FROM region
  UNION ALL SELECT 'source', 7, source, source, source || ' in/' || source || ' Holds ' || count(*) || ' texts', {_EMPTY}, {_EMPTY}, [source], {_EMPTY} FROM documents GROUP BY source)"""


@query(f"WITH {_KINDS} SELECT kind, kind_rank, id, title, md5(body) AS body, nodes, relations, sources, evidence FROM cand")
def answer_kinds(t: Tables) -> DataFrame:
    return an.all_candidates(_tables(t)).withColumn("body", F.md5("body"))


def _questions(t: Tables) -> DataFrame:
    """Words of a part, words of a document, and one that nothing holds."""
    some = t.part.where("p_partkey % 100 = 7").select(F.concat(F.lit("p"), "p_partkey").alias("question_id"), F.concat_ws(" ", F.lit("which"), "p_name", F.lit("nation"), F.col("p_partkey") % 25).alias("question"))
    more = t.benchmark.select(F.concat(F.lit("b"), "item_id").alias("question_id"), F.array_join(F.slice(F.split("text", " "), 3, 2), " ").alias("question"))
    return some.unionByName(more).unionByName(t.spark.createDataFrame([("x", "zzzzqqq ??"), ("y", "!!")], "question_id string, question string"))


_ASKED = f"""
qs AS (SELECT 'p' || p_partkey AS question_id, 'which ' || p_name || ' nation ' || (p_partkey % 25) AS question FROM part WHERE p_partkey % 100 = 7
  UNION ALL SELECT 'b' || item_id, array_to_string((string_split(text, ' '))[3:4], ' ') FROM benchmark UNION ALL SELECT 'x', 'zzzzqqq ??' UNION ALL SELECT 'y', '!!'),
qt AS (SELECT question_id, question, list_sort(list_distinct({_tokens('question')})) AS terms FROM qs)"""


def _focal_nodes(t: Tables) -> DataFrame:
    return _questions(t).where("startswith(question_id, 'p')").select("question_id", F.concat(F.lit("n"), F.substring("question_id", 2, 9).cast("int") % 25).alias("node_id"))


def _focal(t: Tables, lists) -> DataFrame:
    own = _tables(t)
    return lists(_focal_nodes(t), own["node"], own["relation"], own["claim"])


_FOCUS = f"""
fi AS (SELECT question_id, 'n' || (CAST(substr(question_id, 2) AS INT) % 25) AS node_id FROM qs WHERE starts_with(question_id, 'p')),
nd AS (SELECT 'n' || n_nationkey AS node_id, n_name, n_regionkey, ['src' || (n_nationkey % 20)] AS s, ['e' || n_nationkey, 'e1'] AS e FROM nation),
rl AS (SELECT 'r' || n_nationkey AS r, 'n' || n_nationkey AS a, 'n' || ((n_nationkey * 7 + 1) % 25) AS b, ['e' || n_nationkey] AS e FROM nation),
cl AS (SELECT 'n' || (p_partkey % 25) AS node_id, ['src' || (p_partkey % 20)] AS s, ['e' || (p_partkey % 300), 'e' || p_partkey] AS e FROM part),
fu AS (SELECT question_id, [node_id] AS n, {_EMPTY} AS r, s, e, list_sort(list_distinct({_tokens("n_name || ' small bolt ' || n_regionkey")})) AS t FROM fi JOIN nd USING (node_id)
  UNION ALL SELECT question_id, [a, b], [r], {_EMPTY}, e, {_EMPTY} FROM fi JOIN rl ON a = node_id OR b = node_id
  UNION ALL SELECT question_id, [node_id], {_EMPTY}, s, e, {_EMPTY} FROM fi JOIN cl USING (node_id)),
fo AS (SELECT question_id, list_sort(list_distinct(flatten(list(n)))) AS f_nodes, list_sort(list_distinct(flatten(list(r)))) AS f_relations, list_sort(list_distinct(flatten(list(s)))) AS f_sources, list_sort(list_distinct(flatten(list(e)))) AS f_evidence, list_sort(list_distinct(flatten(list(t)))) AS f_terms FROM fu GROUP BY 1)"""


@query(f"WITH {_ASKED}, {_FOCUS} SELECT * FROM fo")
def answer_focus(t: Tables) -> DataFrame:
    return _focal(t, an.focus)


_SCORED = f"""{_KINDS}, {_ASKED}, {_FOCUS},
cw AS (SELECT *, {_tokens("title || ' ' || body")} AS words FROM cand),
sc AS (SELECT qt.question_id, cw.*, {_score('words', 'terms')} AS query_score, fo.* EXCLUDE (question_id) FROM cw JOIN qt ON len(terms) > 0 LEFT JOIN fo ON fo.question_id = qt.question_id),
sb AS (SELECT *, CASE WHEN f_terms IS NULL THEN 0 ELSE 18 * len(list_intersect(nodes, f_nodes)) + 12 * len(list_intersect(relations, f_relations)) + 8 * len(list_intersect(sources, f_sources)) + 6 * len(list_intersect(evidence, f_evidence)) + CASE WHEN len(f_terms) > 0 THEN least({_score('words', 'f_terms')}, 12) ELSE 0 END END AS bias FROM sc WHERE query_score > 0),
best AS (SELECT *, query_score * 100 + least(bias, 60) AS total, row_number() OVER (PARTITION BY question_id ORDER BY query_score * 100 + least(bias, 60) DESC, query_score DESC, bias DESC, kind_rank, title, id) AS place FROM sb QUALIFY place <= 8)"""


@query(f"WITH {_SCORED} SELECT question_id, CAST(place AS INT) AS place, kind, id, CAST(query_score AS BIGINT) AS query_score, CAST(bias AS BIGINT) AS bias, CAST(total AS BIGINT) AS total FROM best")
def answer_scored(t: Tables) -> DataFrame:
    got = an.scored(_questions(t), an.all_candidates(_tables(t)), _focal_nodes(t), _focal(t, an.focus_items))
    return got.select("question_id", "place", "kind", "id", *[F.col(c).cast("bigint").alias(c) for c in ("query_score", "bias", "total")])


_ANSWERS = f"""{_SCORED},
sp AS (SELECT row_number() OVER (ORDER BY kind_rank, title, id) AS place, * FROM cand QUALIFY place <= 3),
rw AS (SELECT question_id, place, body, nodes, evidence, true AS matched FROM best UNION ALL SELECT question_id, place, body, nodes, evidence, false FROM qs, sp WHERE question_id NOT IN (SELECT question_id FROM best)),
told AS (SELECT question_id, bool_or(matched) AS matched, list_sort(list_distinct(flatten(list(nodes))))[1:8] AS related FROM rw GROUP BY 1),
ce AS (SELECT question_id, place, unnest(evidence) AS ev, generate_subscripts(evidence, 1) AS pos FROM rw),
ck AS (SELECT question_id, ev, min((place, pos)) AS x FROM ce WHERE ev IN (SELECT 'e' || doc_id FROM documents) GROUP BY 1, 2),
cn AS (SELECT question_id, ev, row_number() OVER (PARTITION BY question_id ORDER BY x, ev) AS n FROM ck QUALIFY n <= 4),
ci AS (SELECT question_id, list(ev ORDER BY n) AS citations FROM cn GROUP BY 1),
sr AS (SELECT question_id || chr(2) || place AS k, body FROM rw),
{_segments('sg', 'sr', 'k', 'body')},
pt AS (SELECT string_split(key, chr(2))[1] AS question_id, CAST(string_split(key, chr(2))[2] AS INT) AS place, pos, CASE WHEN length(flat) > 260 THEN rtrim(left(flat, 259), ' ') || '…' ELSE flat END AS point FROM (SELECT key, pos, trim(regexp_replace(segment, '\\s+', ' ', 'g'), ' ') AS flat FROM sg)),
po AS (SELECT * FROM pt QUALIFY row_number() OVER (PARTITION BY question_id, lower(point) ORDER BY place, pos) = 1),
pn AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY place, pos) AS n FROM po QUALIFY n <= 7),
pl AS (SELECT question_id, list(point ORDER BY n) AS points FROM pn GROUP BY 1),
al AS (SELECT qs.question_id, question, matched, coalesce(citations, {_EMPTY}) AS citations, coalesce(points, {_EMPTY}) AS points, coalesce(related, {_EMPTY}) AS related FROM qs LEFT JOIN told USING (question_id) LEFT JOIN ci USING (question_id) LEFT JOIN pl USING (question_id)),
fin AS (SELECT *, CASE WHEN matched AND len(citations) > 0 THEN 'grounded' WHEN matched IS NOT NULL THEN 'low_confidence' ELSE 'blocked' END AS status FROM al)"""


@query(f"""WITH {_ANSWERS}
SELECT question_id, status, citations, points, related AS related_nodes,
  CASE WHEN status = 'grounded' THEN 'Here is what the workspace says about your question.' ELSE 'Weak direct overlap was found, but these workspace notes are closest.' END
  || CASE WHEN len(points) > 0 THEN chr(10) || chr(10) || array_to_string(list_transform(points, lambda p: '- ' || p), chr(10)) ELSE '' END
  || CASE WHEN len(citations) > 0 THEN chr(10) || chr(10) || 'Sources: ' || array_to_string(citations[1:3], ', ') ELSE '' END AS text FROM fin""")
def answer_workspace(t: Tables) -> DataFrame:
    own = _tables(t)
    return an.answers(_questions(t), an.all_candidates(own), own["evidence"], _focal_nodes(t), _focal(t, an.focus_items))


@query(f"""WITH {_KINDS} SELECT CAST(row_number() OVER (ORDER BY kind_rank, title, id) AS INT) AS place, kind, id FROM cand QUALIFY place <= 3""")
def answer_fallback(t: Tables) -> DataFrame:
    return an.fallback(an.all_candidates(_tables(t))).withColumn("place", F.row_number().over(an._by("kind_rank", "title", "id"))).select("place", "kind", "id")


@query("""
WITH q AS (SELECT 'q' || item_id AS question_id, text AS question FROM benchmark),
e AS (SELECT 'q' || (doc_id % 40) AS question_id, doc_id AS evidence_id, source AS page_label, left(text, 400) AS snippet FROM documents),
s AS (SELECT question_id, evidence_id, page_label, len(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower(question), '[^a-z0-9]+'), lambda w: length(w) >= 3)), list_distinct(list_filter(regexp_split_to_array(lower(snippet), '[^a-z0-9]+'), lambda w: length(w) >= 3)))) AS score FROM e JOIN q USING (question_id)),
h AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, page_label, evidence_id) AS rank, evidence_id, score FROM s WHERE score > 0 QUALIFY rank <= 3),
o AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY evidence_id) AS rank, evidence_id, score FROM s WHERE question_id NOT IN (SELECT question_id FROM h) QUALIFY rank <= 2)
SELECT question_id, CAST(rank AS INT) AS rank, evidence_id, CAST(score AS INT) AS score FROM h UNION ALL SELECT question_id, CAST(rank AS INT), evidence_id, CAST(score AS INT) FROM o""")
def answer_best_evidence(t: Tables) -> DataFrame:
    questions = t.benchmark.select(F.concat(F.lit("q"), "item_id").alias("question_id"), F.col("text").alias("question"))
    rows = t.documents.select(F.concat(F.lit("q"), F.col("doc_id") % 40).alias("question_id"), F.col("doc_id").alias("evidence_id"), F.col("source").alias("page_label"), F.substring("text", 1, 400).alias("snippet"))
    return an.best_evidence(questions, rows).withColumn("score", F.col("score").cast("int"))


@query("""
SELECT p_partkey AS node_id, CASE WHEN coalesce(n, 0) > 0 THEN 'grounded' ELSE 'low_confidence' END AS status, p_name || ' currently has ' || coalesce(n, 0) || ' visible evidence refs across ' || coalesce(pages, 0) || ' page(s).' AS text
FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_orderkey) AS n, count(DISTINCT l_suppkey) AS pages FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30 GROUP BY 1) ON l_partkey = p_partkey""")
def answer_nodes(t: Tables) -> DataFrame:
    seen = t.lineitem.where("l_returnflag = 'R' and l_quantity > 30").select(F.col("l_partkey").alias("node_id"), F.col("l_orderkey").alias("evidence_id"), F.col("l_suppkey").alias("page_label"))
    return an.node_answers(t.part.select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("label")), seen)


_LABELS = "CASE p_size % 4 WHEN 0 THEN 'Separated by correction' WHEN 1 THEN 'Supports' WHEN 2 THEN 'odd one' ELSE 'Related in source' END"
_OTHER = "CASE p_partkey % 3 WHEN 0 THEN 'Separated by correction' WHEN 1 THEN 'Contradicts' ELSE 'something' END"


@query(f"""
WITH e AS (SELECT p_partkey AS edge_id, CASE WHEN p_size % 5 = 0 THEN 'source_document' ELSE 'related_to' END AS kind, {_LABELS} AS label, {_OTHER} AS other, 'n' || (p_partkey % 25) AS src, 'n' || (p_size % 30) AS dst, p_size AS n FROM part),
l AS (SELECT e.*, coalesce(a.n_name, src) AS x, coalesce(b.n_name, dst) AS y FROM e LEFT JOIN nation a ON 'n' || a.n_nationkey = src LEFT JOIN nation b ON 'n' || b.n_nationkey = dst)
SELECT edge_id, CASE WHEN kind = 'source_document' THEN 'Compiled from source' WHEN label IN ('Separated by correction', 'Supports', 'Contradicts', 'Supersedes', 'Same as', 'Depends on') THEN label ELSE 'Related in source' END AS label,
  CASE WHEN kind = 'source_document' THEN 'Compiled from source' WHEN 'Separated by correction' IN (label, other) THEN 'Separated by correction' WHEN label <> 'Related in source' THEN label WHEN other IN ('Supports', 'Contradicts', 'Supersedes', 'Same as', 'Depends on') THEN other ELSE 'Related in source' END AS merged,
  CASE WHEN kind = 'source_document' THEN 'The source document is linked to ' || y || ', which is grounded in cited snippets of it.' WHEN label = 'Separated by correction' THEN x || ' and ' || y || ' are kept separate by a correction.'
    ELSE x || ' and ' || y || ' are linked by ' || n || ' shared evidence ref(s).' END AS explanation FROM l""")
def edge_texts(t: Tables) -> DataFrame:
    n, k = F.col("p_size"), F.col("p_partkey")
    label = F.when(n % 4 == 0, "Separated by correction").when(n % 4 == 1, "Supports").when(n % 4 == 2, "odd one").otherwise("Related in source")
    other = F.when(k % 3 == 0, "Separated by correction").when(k % 3 == 1, "Contradicts").otherwise("something")
    edges = t.part.select(k.alias("edge_id"), F.when(n % 5 == 0, "source_document").otherwise("related_to").alias("kind"), label.alias("label"), other.alias("other"), F.concat(F.lit("n"), k % 25).alias("src"), F.concat(F.lit("n"), n % 30).alias("dst"), n.alias("n_evidence"))
    nodes = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.col("n_name").alias("label"))
    said = edges.select("edge_id", an.edge_label(F.col("kind"), F.col("label")).alias("label"), an.merged_edge_label(F.col("kind"), F.col("label"), F.col("other")).alias("merged"))
    return said.join(an.edge_explanations(edges, nodes), "edge_id")


@query("""
SELECT c_custkey AS node_id, a AS action, a <> 'keep_separate' OR c_nationkey % 3 <> 0 AS enabled FROM customer, (SELECT unnest(['merge', 'keep_separate', 'rename', 'split', 'delete']) AS a) WHERE c_mktsegment <> 'BUILDING' OR a = 'delete'""")
def correction_actions(t: Tables) -> DataFrame:
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "source").otherwise("concept")
    aliases = F.when(F.col("c_nationkey") % 3 == 0, F.expr(an._NONE)).otherwise(F.array(F.lit("x")))
    return an.correction_actions(t.customer.select(F.col("c_custkey").alias("node_id"), kind.alias("kind"), aliases.alias("aliases")))


_GENERIC_HIT = "(" + " OR ".join(f"contains(lower(said), '{w}')" for w in tx.GENERIC) + ")"
_GENERIC_IN = "(" + ", ".join(f"'{w}'" for w in tx.GENERIC) + ")"
_TALK_IN = "(" + ", ".join(f"'{w}'" for w in an.SMALL_TALK) + ")"
_MESSAGES = "(SELECT conv_id, turn, role, CASE WHEN (conv_id * 7 + turn) % 11 = 0 THEN '  Thank   you!! ' WHEN (conv_id + turn) % 5 = 0 THEN 'Summarize the document' WHEN (conv_id + turn) % 7 = 0 THEN '??' ELSE text END AS text FROM conversations)"
_PLANS = f"""
u AS (SELECT conv_id, turn, trim(coalesce(text, ''), ' ') AS said FROM {_MESSAGES} WHERE role = 'user'),
c AS (SELECT *, array_to_string({_distinct_terms('said')}, ' ') AS clean FROM u),
p AS (SELECT *, last_value(CASE WHEN clean <> '' THEN said END IGNORE NULLS) OVER w AS prior, last_value(CASE WHEN clean <> '' THEN clean END IGNORE NULLS) OVER w AS prior_clean FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, {_GENERIC_HIT} AS ev, trim(lower(regexp_replace(regexp_replace(said, '^[[:punct:]。，、！？…·ㅋㅎ]+|[[:punct:]。，、！？…·ㅋㅎ]+$', '', 'g'), '\\s+', ' ', 'g')), ' ') IN {_TALK_IN} AS talk, list_filter(string_split(clean, ' '), lambda x: x <> '') AS ts FROM p),
g AS (SELECT *, len(ts) = 0 OR (len(ts) <= 1 AND ev) OR len(list_filter(ts, lambda x: x NOT IN {_GENERIC_IN})) = 0 AS vague FROM f),
qy AS (SELECT *, [CASE WHEN vague AND prior IS NOT NULL THEN prior || ' ' || said ELSE said END, CASE WHEN prior IS NOT NULL THEN prior || ' ' || said END, CASE WHEN clean <> '' THEN clean END, CASE WHEN prior_clean IS NOT NULL THEN CASE WHEN clean <> '' THEN prior_clean || ' ' || clean ELSE prior_clean END END] AS raw FROM g),
tr AS (SELECT *, list_filter(list_transform(list_filter(raw, lambda x: x IS NOT NULL), lambda x: trim(x, ' ')), lambda x: x <> '') AS xs FROM qy),
plans AS (SELECT conv_id, turn, talk AS small_talk, ev AS evidence_question, NOT talk AS retrieve, list_filter(xs, lambda x, i: list_position(xs, x) = i) AS queries FROM tr)"""


def _messages(t: Tables) -> DataFrame:
    n = F.col("conv_id") + F.col("turn")
    text = F.when((F.col("conv_id") * 7 + F.col("turn")) % 11 == 0, "  Thank   you!! ").when(n % 5 == 0, "Summarize the document").when(n % 7 == 0, "??").otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", "role", text.alias("text"))


@query(f"WITH {_PLANS} SELECT * FROM plans")
def chat_plans(t: Tables) -> DataFrame:
    return an.chat_plans(_messages(t))


@query(f"""WITH {_PLANS},
h AS (SELECT conv_id, turn, min(conv_id % 6) AS first FROM plans WHERE conv_id % 6 < 4 GROUP BY 1, 2)
SELECT conv_id, turn, CASE WHEN small_talk OR first IS NOT NULL THEN 'answered' ELSE 'blocked' END AS state, CAST(CASE WHEN small_talk THEN 0 ELSE coalesce(first + 1, least(len(queries), 4)) END AS INT) AS tries FROM plans LEFT JOIN h USING (conv_id, turn)""")
def chat_workflow(t: Tables) -> DataFrame:
    plans = an.chat_plans(_messages(t))
    return an.workflow_states(plans, plans.select("conv_id", "turn", (F.col("conv_id") % 6).alias("attempt")))


# reader packs
def _snapshot(t: Tables) -> DataFrame:
    own = _tables(t)
    c = F.col
    said = lambda *x: F.concat_ws(" ", *x)
    one = lambda x: F.array(x)
    entity = t.supplier.select(F.concat(F.lit("y"), "s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("e"), F.col("s_suppkey") % 60)).alias("evidence_refs"))
    event = t.events.select(F.concat(F.lit("v"), "event_id").alias("event_id"), "event_type", "props")
    return rd.union([
        rd.records("source", own["source"], "source_id", c("source_id"), said("source_id", "path"), sources=one("source_id")),
        rd.records("node", own["node"], "node_id", c("label"), said("node_id", "label", F.array_join("aliases", " ")), nodes=one("node_id"), sources=c("source_ids"), evidence=c("evidence_ids")),
        rd.records("entity", entity, "entity_id", c("name"), said("entity_id", "name"), evidence=c("evidence_refs")),
        rd.records("claim", own["claim"], "claim_id", c("statement"), said("claim_id", "statement"), nodes=c("topic_refs"), sources=c("source_refs"), evidence=c("evidence_refs")),
        rd.records("relation", own["relation"], "relation_id", c("label"), said("relation_id", "label", "src", "dst"), nodes=F.array("src", "dst"), evidence=c("evidence_ids")),
        rd.records("memory", own["memory"], "memory_id", c("title"), said("title", "body"), evidence=c("evidence_refs")),
        rd.records("wiki_page", own["wiki"], "page_id", c("title"), said("path", "title", "body"), nodes=c("node_refs"), evidence=c("evidence_refs")),
        rd.records("evidence", own["evidence"], "evidence_id", c("page_label"), said("evidence_id", "snippet"), sources=one("source_id")),
        rd.records("event", event, "event_id", c("event_type"), said("event_id", "event_type", "props")),
    ])


_SNAPSHOT = f"""
snap AS (
  SELECT 'source' AS kind, source AS id, source AS title, source || ' in/' || source AS said, {_EMPTY} AS nodes, [source] AS sources, {_EMPTY} AS evidence FROM documents GROUP BY source
  UNION ALL SELECT 'node', 'n' || n_nationkey, n_name, 'n' || n_nationkey || ' ' || n_name || ' small bolt ' || n_regionkey, ['n' || n_nationkey], ['src' || (n_nationkey % 20)], ['e' || n_nationkey, 'e1'] FROM nation
  UNION ALL SELECT 'entity', 'y' || s_suppkey, s_name, 'y' || s_suppkey || ' ' || s_name, {_EMPTY}, {_EMPTY}, ['e' || (s_suppkey % 60)] FROM supplier
  UNION ALL SELECT 'claim', 'c' || p_partkey, p_name || ' ' || p_type, 'c' || p_partkey || ' ' || p_name || ' ' || p_type, ['n' || (p_partkey % 25)], ['src' || (p_partkey % 20)], ['e' || (p_partkey % 300), 'e' || p_partkey] FROM part
  UNION ALL SELECT 'relation', 'r' || n_nationkey, n_name, 'r' || n_nationkey || ' ' || n_name || ' n' || n_nationkey || ' n' || ((n_nationkey * 7 + 1) % 25), ['n' || n_nationkey, 'n' || ((n_nationkey * 7 + 1) % 25)], {_EMPTY}, ['e' || n_nationkey] FROM nation
  UNION ALL SELECT 'memory', 'm' || s_suppkey, s_name, s_name || ' ring widget of ' || s_nationkey, {_EMPTY}, {_EMPTY}, ['e' || (s_suppkey % 90)] FROM supplier
  UNION ALL SELECT 'wiki_page', 'w' || r_regionkey, r_name, 'wiki/' || r_name || ' ' || r_name || ' All about the red gear and ' || r_name, ['n' || r_regionkey], {_EMPTY}, ['e2'] FROM region
  UNION ALL SELECT 'evidence', 'e' || doc_id, 'Page ' || doc_id, 'e' || doc_id || ' ' || text, {_EMPTY}, [source], {_EMPTY} FROM documents
  UNION ALL SELECT 'event', 'v' || event_id, event_type, 'v' || event_id || ' ' || event_type || ' ' || props, {_EMPTY}, {_EMPTY}, {_EMPTY} FROM events),
rq AS (SELECT query_id, list_sort(list_distinct({_tokens('q')})) AS terms FROM (SELECT * FROM (VALUES (1, 'red gears of asia'), (2, 'small click'), (3, 'supplier europe'), (4, 'in src7')) v(query_id, q))),
rw AS (SELECT kind, id, title, {_tokens('said')} AS words FROM snap),
found AS (SELECT query_id, kind, id, title, {_score('words', 'terms')} AS score FROM rw, rq WHERE {_score('words', 'terms')} > 0),
hits AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, kind, id) AS rank, kind, id, title, score FROM found QUALIFY rank <= 24)"""


def _reader_hits(t: Tables, snapshot: DataFrame) -> DataFrame:
    asked = t.spark.createDataFrame([(1, "red gears of asia"), (2, "small click"), (3, "supplier europe"), (4, "in src7")], "query_id int, text string")
    return rd.search(snapshot, asked)


@query(f"WITH {_SNAPSHOT} SELECT query_id, CAST(rank AS INT) AS rank, kind, id, title, CAST(score AS BIGINT) AS score FROM hits")
def reader_search(t: Tables) -> DataFrame:
    return _reader_hits(t, _snapshot(t)).withColumn("score", F.col("score").cast("bigint"))


def _step(name: str, prior: str, kind: str, by: list[str]) -> str:
    column = {"node": "nodes", "source": "sources", "evidence": "evidence"}
    own = f"SELECT query_id, id FROM {prior} WHERE kind = '{kind}'"
    met = "".join(f" UNION SELECT f.query_id, x.id FROM {prior} f JOIN (SELECT id, unnest({column[o]}) AS ref FROM snap WHERE kind = '{kind}') x ON f.kind = '{o}' AND f.id = x.ref" for o in by)
    more = "".join(f" UNION SELECT c.query_id, '{k}', unnest(s.{v}) FROM {name}_c c JOIN snap s ON s.kind = '{kind}' AND s.id = c.id" for k, v in column.items())
    return f"{name}_c AS ({own}{met}), {name} AS (SELECT query_id, kind, id FROM {prior} UNION SELECT query_id, '{kind}', id FROM {name}_c{more})"


@query(f"""WITH {_SNAPSHOT},
f0 AS (SELECT query_id, kind, id FROM hits UNION SELECT 2, 'node', 'n3' UNION SELECT 2, 'source', unnest(sources) FROM snap WHERE kind = 'node' AND id = 'n3' UNION SELECT 2, 'evidence', unnest(evidence) FROM snap WHERE kind = 'node' AND id = 'n3'),
{_step('f1', 'f0', 'evidence', ['source'])}, {_step('f2', 'f1', 'node', ['source', 'evidence'])}, {_step('f3', 'f2', 'claim', ['node', 'source', 'evidence'])}, {_step('f4', 'f3', 'relation', ['node', 'evidence'])},
{_step('f5', 'f4', 'node', [])}, {_step('f6', 'f5', 'wiki_page', ['node', 'source', 'evidence'])}
SELECT query_id, kind, id FROM f6 WHERE (kind, id) IN (SELECT (kind, id) FROM snap)""")
def reader_selection(t: Tables) -> DataFrame:
    snapshot = _snapshot(t)
    chosen = t.spark.createDataFrame([(2, "n3")], "query_id int, id string")
    return rd.selection(snapshot, _reader_hits(t, snapshot), chosen)


@query("""
WITH e AS (SELECT doc_id AS evidence_id, source AS source_id, n_chars // 100 AS page FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY page, evidence_id) AS n FROM e),
s AS (SELECT DISTINCT item_id AS query_id, (item_id * 37) % (SELECT max(doc_id) FROM documents) AS evidence_id FROM benchmark), o AS (SELECT query_id, source_id, page AS p, n AS k FROM s JOIN n USING (evidence_id))
SELECT query_id, evidence_id FROM o JOIN n USING (source_id) WHERE n.n BETWEEN k AND k + 4 UNION SELECT query_id, evidence_id FROM o JOIN n USING (source_id) WHERE n.page BETWEEN p AND p + 2""")
def reader_protected(t: Tables) -> DataFrame:
    last = t.documents.agg(F.max("doc_id").alias("last"))
    seeds = t.benchmark.join(F.broadcast(last)).select(F.col("item_id").alias("query_id"), ((F.col("item_id") * 37) % F.col("last")).alias("evidence_id")).distinct()
    return rd.protected(t.documents.select(F.col("doc_id").alias("evidence_id"), F.col("source").alias("source_id"), F.floor(F.col("n_chars") / 100).alias("page")), seeds)


@query("""
SELECT p_partkey AS query_id, list_filter([CASE WHEN p_size % 7 = 0 THEN 'no_nodes' END, CASE WHEN p_size % 5 = 0 THEN 'no_evidence' END, CASE WHEN p_size / 50 < 0.6 THEN 'low_confidence' END, CASE WHEN p_retailprice < 1000 THEN 'small_budget' END], lambda x: x IS NOT NULL) AS warnings FROM part""")
def reader_warnings(t: Tables) -> DataFrame:
    n = F.col("p_size")
    return rd.pack_warnings(t.part.select(F.col("p_partkey").alias("query_id"), (n % 7).alias("n_nodes"), (n % 5).alias("n_evidence"), (n / 50).alias("lowest_confidence"), F.when(F.col("p_retailprice") < 1000, 1000).otherwise(4000).alias("budget")))
