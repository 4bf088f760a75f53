"""Scans, text functions and retrieval over documents. ``lang`` stands for the workspace, ``source``
for the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import folds, text as tx
from ..operators import retrieval as rt
from .registry import Tables, query

_SPLIT = r"list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: length(t) > 0)"
_STOP = "(" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + ")"
_GENERIC = "(" + ", ".join(f"'{w}'" for w in tx.GENERIC) + ")"


def _distinct_terms(column: str, most: int | None = None) -> str:
    """Distinct search terms in the order of their first use."""
    kept = f"list_filter({_SPLIT.format(column)}, lambda t: t NOT IN {_STOP})"
    first = f"list_filter({kept}, lambda t, i: list_position({kept}, t) = i)"
    return f"({first})[1:{most}]" if most else first


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND source NOT IN ('src3', 'src7') AND n_chars >= 200")
def doc_scan_filter(t: Tables) -> DataFrame:
    return t.documents.where((F.col("lang") == "en") & ~F.col("source").isin("src3", "src7") & (F.col("n_chars") >= 200)).select("doc_id", "source", "n_chars")


@query(f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({_SPLIT.format('text')}) AS term FROM documents) WHERE term NOT IN {_STOP} GROUP BY term")
def text_terms_freq(t: Tables) -> DataFrame:
    return rt.term_frequencies(t.documents, "text").where(~F.col("term").isin(*tx.STOPWORDS))


@query(r"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents)
SELECT word, CASE WHEN word LIKE '%ies' AND length(word) > 4 THEN left(word, length(word) - 3) || 'y'
  WHEN word LIKE '%ing' AND length(word) > 5 THEN left(word, length(word) - 3)
  WHEN (word LIKE '%ed' OR word LIKE '%es') AND length(word) > 4 AND word NOT LIKE '%ses' THEN left(word, length(word) - 2)
  WHEN word LIKE '%s' AND length(word) > 4 AND word NOT LIKE '%ss' AND word NOT LIKE '%us' THEN left(word, length(word) - 1)
  ELSE word END AS stem
FROM w WHERE length(word) > 1""")
def stem_terms(t: Tables) -> DataFrame:
    words = t.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("word")).where(F.length("word") > 1).distinct()
    return words.select("word", tx.stem(F.col("word")).alias("stem"))


@query("""
WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS parts, text FROM documents)
SELECT doc_id, i - 1 AS chunk_no, c AS text FROM (
  SELECT doc_id, unnest(range(1, least(len(parts), 16) + 1)) AS i, unnest(parts[1:16]) AS c FROM p WHERE len(parts) > 0)
UNION ALL SELECT doc_id, 0, '' FROM p WHERE len(parts) = 0""")
def chunk_paragraphs(t: Tables) -> DataFrame:
    trim = lambda x: F.regexp_replace(x, r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    parts = F.slice(F.filter(F.transform(F.split("text", "\n\n"), trim), lambda x: x != ""), 1, 16)
    held = F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("")))
    return t.documents.select("doc_id", F.posexplode(held).alias("chunk_no", "text")).withColumn("chunk_no", F.col("chunk_no").cast("bigint"))


@query()
def chunk_markdown(t: Tables) -> DataFrame:
    return folds.chunk_markdown(t.documents, F.col("doc_id"), F.col("text"))


_BM25 = f"""
d AS (SELECT doc_id, unnest({_SPLIT.format('text')}) AS term FROM documents),
len AS (SELECT doc_id, len({_SPLIT.format('text')}) AS length FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT count(*) AS n, avg(length) AS avgdl FROM len),
q AS (SELECT item_id, unnest({_distinct_terms('text')}) AS term FROM benchmark),
need AS (SELECT item_id, count(*) AS need FROM q GROUP BY item_id),
bm AS (SELECT q.item_id, p.doc_id, count(*) AS held,
  sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avgdl))) AS score
  FROM q JOIN p USING (term) JOIN df USING (term) JOIN len USING (doc_id) CROSS JOIN s GROUP BY 1, 2),
hit AS (SELECT item_id, doc_id, score FROM bm JOIN need USING (item_id) WHERE held = need)"""


@query(f"WITH {_BM25} SELECT item_id, doc_id, round(score, 6) AS score FROM hit")
def postings_bm25(t: Tables) -> DataFrame:
    asked = rt.query_terms(t.benchmark, "item_id", "text")
    return rt.bm25(t.documents, "doc_id", "text", asked, "item_id").select("item_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_BM25},
r AS (SELECT h.*, d.source, row_number() OVER (PARTITION BY item_id, source ORDER BY round(score, 6) DESC, doc_id) AS k FROM hit h JOIN documents d USING (doc_id)),
g AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM r WHERE k <= 4)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, source, round(score, 6) AS score FROM g WHERE rank <= 10""")
def topk_per_source(t: Tables) -> DataFrame:
    asked = rt.query_terms(t.benchmark, "item_id", "text")
    hits = rt.bm25(t.documents, "doc_id", "text", asked, "item_id").withColumn("score", F.round("score", 6)).join(t.documents.select("doc_id", "source"), "doc_id")
    return rt.top_with_source_cap(hits, "item_id", "source", [F.desc("score"), F.col("doc_id")], 4, 10).select("item_id", "rank", "doc_id", "source", "score")


@query(f"""WITH {_BM25},
kind AS (SELECT doc_id, source, CASE WHEN n_chars > 4000 THEN 'summary' WHEN lang = 'en' THEN 'text' ELSE 'claim_evidence' END AS type FROM documents),
typed AS (SELECT doc_id, source, CASE type WHEN 'text' THEN 0.05 ELSE 0.02 END AS boost FROM kind),
fts AS (SELECT item_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS k FROM hit) WHERE k <= 8),
meta AS (SELECT q.item_id, k.doc_id FROM q JOIN (SELECT DISTINCT doc_id, unnest({_SPLIT.format('string_split(text, chr(10))[1]')}) AS term FROM documents) k USING (term) GROUP BY 1, 2),
meta8 AS (SELECT item_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS k FROM meta) WHERE k <= 4),
st AS (SELECT item_id, doc_id, score + boost + 0.01 AS delta FROM fts JOIN typed USING (doc_id)
  UNION ALL SELECT item_id, doc_id, CASE WHEN EXISTS (SELECT 1 FROM fts f WHERE f.item_id = meta8.item_id AND f.doc_id = meta8.doc_id) THEN 0.75 ELSE 0.75 + boost + 0.01 END FROM meta8 JOIN typed USING (doc_id)),
tot AS (SELECT item_id, doc_id, round(sum(delta), 6) AS score FROM st GROUP BY 1, 2)
SELECT item_id, doc_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM tot) WHERE rank <= 8""")
def hybrid_topk(t: Tables) -> DataFrame:
    k = 8
    asked = rt.query_terms(t.benchmark, "item_id", "text")
    kind = F.when(F.col("n_chars") > 4000, "summary").when(F.col("lang") == "en", "text").otherwise("claim_evidence")
    typed = t.documents.select("doc_id", tx.typed_boost(kind, "what is this").alias("boost"))
    hits = rt.top(rt.bm25(t.documents, "doc_id", "text", asked, "item_id"), ["item_id"], [F.desc(F.round("score", 6)), F.col("doc_id")], k)
    fts = hits.join(typed, "doc_id").select("item_id", "doc_id", F.lit(1).alias("stage"), (F.col("score") + F.col("boost") + 0.01).alias("delta"), F.lit(True).alias("fresh"))
    # a document's first line stands for its title
    starts = t.documents.select("doc_id", F.explode(tx.tokens(F.split("text", "\n")[0])).alias("term"))
    meta = rt.top(starts.join(asked, "term").select("item_id", "doc_id").distinct(), ["item_id"], [F.col("doc_id")], 4)
    known = fts.select("item_id", "doc_id", F.lit(True).alias("held"))
    more = meta.join(typed, "doc_id").join(known, ["item_id", "doc_id"], "left")
    named = more.select("item_id", "doc_id", F.lit(3).alias("stage"), F.when(F.col("held"), 0.75).otherwise(F.col("boost") + 0.76).alias("delta"), F.lit(True).alias("fresh"))
    total = rt.combine_stages([fts, named], "item_id", "doc_id").withColumn("score", F.round("score", 6))
    return rt.top(total, ["item_id"], [F.desc("score"), F.col("doc_id")], k).select("item_id", "doc_id", "score", "rank")


@query(f"""
WITH q AS (SELECT ['idiot', 'document', 'the', 'page', 'ention'] AS terms)
SELECT doc_id, CAST(100 * len(list_filter(terms, lambda x: contains(lower(text), x))) AS BIGINT)
  + 200 * len(list_filter(terms, lambda x: x NOT IN {_GENERIC} AND contains(lower(text), x))) AS score
FROM documents, q""")
def metadata_match(t: Tables) -> DataFrame:
    terms = tx.literals(["idiot", "document", "the", "page", "ention"])
    return t.documents.select("doc_id", tx.metadata_score(F.col("text"), terms).cast("bigint").alias("score"))


@query(r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents),
s AS (SELECT doc_id, t, term, string_split(lower(t), term) AS parts FROM d, (SELECT unnest(['ention thion', 'ention', 'thion']) AS term)),
k AS (SELECT doc_id, t, term, unnest(parts) AS part, generate_subscripts(parts, 1) AS k, len(parts) AS n FROM s),
p AS (SELECT DISTINCT doc_id, t, p FROM (SELECT doc_id, t, k, n, CAST(sum(length(part) + length(term)) OVER (PARTITION BY doc_id, term ORDER BY k) - length(term) AS BIGINT) AS p FROM k) WHERE k < n),
b AS (SELECT *, CASE WHEN contains(left(t, p), chr(10) || chr(10)) THEN p - instr(reverse(left(t, p)), chr(10) || chr(10)) + 1 WHEN contains(left(t, p), chr(10)) THEN p - instr(reverse(left(t, p)), chr(10)) + 1 ELSE 0 END AS begin FROM p),
w AS (SELECT doc_id, p, left(regexp_replace(substr(t, 1 + CASE WHEN p - begin > 240 THEN greatest(p - 120, 0) ELSE begin END), '^\s+', ''), 1600) AS said FROM b),
c AS (SELECT *, lower(said) AS low, (length(said) - length(replace(lower(said), 'ention', ''))) // 6 AS x, (length(said) - length(replace(lower(said), 'thion', ''))) // 5 AS y FROM w),
g AS (SELECT *, 1000 * ((x > 0)::INT + (y > 0)::INT) + 30 * (least(x, 8) + least(y, 8)) + CASE WHEN p > 400 THEN 220 ELSE 0 END
  + 25 * len(list_filter([' using ', ' fixed ', ' directory', ' directories', ' bucket', ' split', ' overflow', ' insert', ' delete', ' search', ' stored', ' address', ' grows', ' shrinks'], lambda z: contains(low, z)))
  - CASE WHEN p < 500 AND contains(low, 'contents') AND contains(low, '8.1') AND contains(low, '8.2') AND contains(low, '8.3') THEN 900 ELSE 0 END AS score FROM c),
best AS (SELECT doc_id, arg_max(said, (score, p)) AS said FROM g GROUP BY 1)
SELECT doc_id, coalesce(said, left(t, 1600)) AS passage FROM d LEFT JOIN best USING (doc_id)""")
def context_window(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.context_window(F.col("text"), tx.literals(["ention", "thion"])).alias("passage"))


@query("SELECT doc_id, term FROM documents, (SELECT unnest(['thnt', 'que la', '555-']) AS term) WHERE contains(lower(text), term)")
def contains_fallback(t: Tables) -> DataFrame:
    held = F.filter(tx.literals(["thnt", "que la", "555-"]), lambda x: F.contains(F.lower("text"), x))
    return t.documents.select("doc_id", F.explode(held).alias("term"))


@query(r"""
SELECT doc_id, CASE WHEN len(list_filter(range(1, len(l)), lambda i:
    length(l[i]) - length(replace(l[i], '|', '')) >= 2 AND regexp_full_match(l[i + 1], '[\s|:-]+') AND contains(l[i + 1], '-')
    AND length(l[i + 1]) - length(replace(l[i + 1], '|', '')) >= 2)) > 0 THEN 'table' ELSE 'text' END AS evidence_type
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def infer_evidence_type(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.evidence_type(F.col("text")).alias("evidence_type"))


@query("""
WITH p AS (SELECT doc_id, list_min(list_filter([instr(lower(text), 'ention'), instr(lower(text), 'elle')], lambda x: x > 0)) AS place, text FROM documents)
SELECT doc_id, trim(substr(text, greatest(coalesce(place, 1) - 48, 1), 180), ' ') AS snippet FROM p""")
def best_snippet(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.best_snippet(F.col("text"), tx.literals(["ention", "elle"])).alias("snippet"))


@query("""
WITH q AS (SELECT ['thnt', 'be', 'anly'] AS terms),
w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1) AS words, terms FROM documents, q),
e AS (SELECT doc_id, list_transform(terms, lambda t: CASE WHEN len(list_filter(words, lambda x: x = t)) > 0 THEN 8 + 2 * len(list_filter(words, lambda x: x = t))
   WHEN length(t) > 3 AND len(list_filter(words, lambda x: starts_with(x, t) OR starts_with(t, x))) > 0 THEN 3 ELSE 0 END) AS s FROM w)
SELECT doc_id, CAST(CASE WHEN m > 0 THEN total + m * m + CASE WHEN m = 3 THEN 10 ELSE 0 END ELSE 0 END AS BIGINT) AS score
FROM (SELECT doc_id, list_sum(s) AS total, len(list_filter(s, lambda x: x > 0)) AS m FROM e)""")
def frequency_score(t: Tables) -> DataFrame:
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 1)
    return t.documents.select("doc_id", words.alias("words")).select("doc_id", tx.frequency_score(F.col("words"), tx.literals(["thnt", "be", "anly"])).cast("bigint").alias("score"))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '\[[^\]]+\]\([^)\s]+\)')) AS BIGINT) AS links, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*#{1,6}\s*\S'))) AS BIGINT) AS headings FROM documents""")
def link_and_heading_parser(t: Tables) -> DataFrame:
    links = F.size(F.regexp_extract_all("text", F.lit(r"\[[^\]]+\]\([^)\s]+\)"), F.lit(0)))
    headings = F.size(F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"^\s*#{1,6}\s*\S"))))
    return t.documents.select("doc_id", links.cast("bigint").alias("links"), headings.cast("bigint").alias("headings"))


@query("""
WITH w AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 4)) AS word FROM documents),
c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT doc_id, word, n, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS k FROM c) WHERE k <= 16""")
def keyword_signals(t: Tables) -> DataFrame:
    words = t.documents.select("doc_id", F.explode(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= 4)).alias("word"))
    counts = words.groupBy("doc_id", "word").agg(F.count("*").alias("n")).where("n >= 2")
    return rt.top(counts, ["doc_id"], [F.desc("n"), F.col("word")], 16).select("doc_id", "word", "n", "rank")


@query(r"""
WITH w AS (SELECT doc_id, source, array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ') AS said, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS words FROM documents),
q AS (SELECT item_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ') AS phrase, (list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 3))[1:8] AS terms FROM benchmark),
s AS (SELECT item_id, doc_id, len(list_filter(list_distinct(terms), lambda x: list_contains(words, x))) + CASE WHEN contains(said, phrase) THEN 3.0 ELSE 0.0 END AS score FROM w, q),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM s WHERE score > 0)
SELECT item_id, doc_id, CAST(score AS DOUBLE) AS score, CAST(k AS INT) AS rank FROM r WHERE k <= 5""")
def import_retrieval(t: Tables) -> DataFrame:
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_id"), F.lit(1).alias("line"), F.lit("").alias("heading"), "text")
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), "text", F.expr("cast(array() as array<string>)").alias("identifier"))
    scored = rt.chunk_scores(chunks, asked)
    return rt.top(scored, ["query_id"], [F.desc("score"), F.col("chunk_id")], 5).select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), "score", "rank")


@query("""
SELECT doc_id, left(text, 96) AS label, sha256(text) AS content_hash, left(sha256('document' || '|' || lang || '|' || CAST(doc_id AS VARCHAR)), 32) AS version_id,
  CASE WHEN n_chars = 0 THEN ['empty'] WHEN n_chars < 50 THEN ['short'] ELSE CAST([] AS VARCHAR[]) END AS warnings FROM documents""")
def hashes_and_labels(t: Tables) -> DataFrame:
    warn = F.when(F.col("n_chars") == 0, F.array(F.lit("empty"))).when(F.col("n_chars") < 50, F.array(F.lit("short"))).otherwise(F.expr("cast(array() as array<string>)"))
    version = F.substring(F.sha2(F.concat_ws("|", F.lit("document"), "lang", F.col("doc_id").cast("string")), 256), 1, 32)
    return t.documents.select("doc_id", F.substring("text", 1, 96).alias("label"), F.sha2("text", 256).alias("content_hash"), version.alias("version_id"), warn.alias("warnings"))
