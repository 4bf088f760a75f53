"""What outlives a query: text index, key dictionary, snapshots, resumed rebuilds; and names, anchors and sketches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..operators import components, names, retrieval as rt, sketches
from ..operators.dictionary import KeyDictionary
from ..operators.rebuild_driver import Rebuild
from ..operators.text_index import TextIndex
from ..sources.snapshots import Snapshots
from ..sources.storage import shared_dir
from .registry import Tables, query
from .text_queries import _SPLIT, _distinct_terms


def _folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/cairn/{uuid.uuid4().hex}/{name}"


def _indexed(t: Tables) -> TextIndex:
    """First the sources of all documents as their texts, then the texts, then those with labels again; sources that went are pruned."""
    index = TextIndex(t.spark, _folder(t, "index"))
    docs = t.documents.select(F.col("doc_id").alias("key"), "text", "source")
    index.upsert(docs.select("key", F.col("source").alias("text")))
    index.upsert(docs)
    index.upsert(docs.join(t.labels.select(F.col("doc_id").alias("key")).distinct(), "key", "left_semi").select("key", F.concat_ws(" ", "text", F.lit("quality toxic")).alias("text")))
    index.prune(docs.where("source <> 'src3'"))
    return index


_INDEXED = f"""
now AS (SELECT doc_id, concat_ws(' ', text, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'quality toxic' END) AS text FROM documents WHERE source <> 'src3'),
d AS (SELECT doc_id, unnest({_SPLIT.format("coalesce(text, '')")}) AS term FROM now),
len AS (SELECT doc_id, len({_SPLIT.format("coalesce(text, '')")}) AS length FROM now),
p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT count(*) AS n, avg(length) AS avgdl FROM len)"""


@query(f"""
WITH {_INDEXED},
q AS (SELECT item_id, unnest({_distinct_terms('text')}) AS term FROM benchmark),
need AS (SELECT item_id, count(*) AS need FROM q GROUP BY item_id),
bm AS (SELECT q.item_id, p.doc_id, count(*) AS held,
  sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avgdl))) AS score
  FROM q JOIN p USING (term) JOIN df USING (term) JOIN len USING (doc_id) CROSS JOIN s GROUP BY 1, 2)
SELECT item_id, doc_id, round(score, 6) AS score FROM bm JOIN need USING (item_id) WHERE held = need""")
def index_bm25(t: Tables) -> DataFrame:
    asked = rt.query_terms(t.benchmark, "item_id", "text")
    return _indexed(t).bm25(asked, "item_id").select("item_id", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"WITH {_INDEXED} SELECT doc_id, term, tf, length FROM p JOIN len USING (doc_id)")
def index_compacted(t: Tables) -> DataFrame:
    index = _indexed(t)
    index.compact()
    return index.postings().select(F.col("key").alias("doc_id"), "term", "tf", "length")


def _named(t: Tables) -> DataFrame:
    """Names of one to four words, each within the next, from the benchmark."""
    words = F.filter(F.split(tx.normal_key(F.col("text")), " "), lambda w: w != "")
    return t.benchmark.select("item_id", words.alias("w")).select(F.explode(F.array(*[F.struct(F.concat_ws("-", "item_id", F.lit(k)).alias("name_id"), F.array_join(F.slice("w", 3, k), " ").alias("name")) for k in range(1, 5)])).alias("x")).select("x.*")


_MENTIONS = f"""
b AS (SELECT item_id, {_SPLIT.format('text')} AS w FROM benchmark),
n AS (SELECT DISTINCT concat_ws('-', item_id, k) AS name_id, w[3:2 + k] AS parts FROM b, (SELECT unnest(range(1, 5)) AS k)),
w AS (SELECT doc_id, words, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM (SELECT doc_id, {_SPLIT.format('text')} AS words FROM documents)),
m AS (SELECT doc_id, name_id, CAST(p - 1 AS INT) AS place FROM n JOIN w ON w.word = n.parts[1] AND words[p:p + len(parts) - 1] = parts WHERE len(parts) > 0)"""


@query(f"WITH {_MENTIONS} SELECT doc_id, name_id, count(*) AS n, min(place) AS first_word, max(place) AS last_word FROM m GROUP BY 1, 2")
def name_mentions(t: Tables) -> DataFrame:
    found = names.mentions(t.documents.select(F.col("doc_id").alias("text_id"), "text"), _named(t))
    return found.groupBy(F.col("text_id").alias("doc_id"), "name_id").agg(F.count("*").alias("n"), F.min("at").alias("first_word"), F.max("at").alias("last_word"))


@query(r"""
WITH n AS (SELECT s_suppkey AS l, s_name AS name, CASE WHEN s_acctbal > 0 THEN 'Deals in ' || n_name || ' mostly.' ELSE '' END AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey),
o AS (SELECT n_nationkey AS r, n_name AS name, coalesce((SELECT string_agg(s_name, ', ') FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal <= 0), '') AS text FROM nation),
k AS (SELECT l, r, ' ' || trim(regexp_replace(lower(n.text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS lt, ' ' || trim(regexp_replace(lower(o.text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS rt,
  ' ' || trim(regexp_replace(lower(n.name), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS ln, ' ' || trim(regexp_replace(lower(o.name), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS rn FROM n, o)
SELECT l AS l_id, r AS r_id FROM k WHERE contains(rt, ln) OR contains(lt, rn)""")
def linked_by_name(t: Tables) -> DataFrame:
    deals = F.when(F.col("s_acctbal") > 0, F.concat(F.lit("Deals in "), "n_name", F.lit(" mostly."))).otherwise("")
    suppliers = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), deals.alias("text"))
    held = t.supplier.where("s_acctbal <= 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_join(F.collect_list("s_name"), ", ").alias("said"))
    nations = t.nation.join(held, "n_nationkey", "left").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("said").alias("text"))
    return names.direct_links(suppliers, nations)


@query("""
WITH o AS (SELECT o_orderkey, o_custkey AS src, o_orderkey % 997 AS dst FROM orders),
l AS (SELECT DISTINCT * FROM (SELECT src AS node, dst AS other FROM o UNION ALL SELECT dst, src FROM o)),
a AS (SELECT DISTINCT c_custkey AS node FROM customer WHERE c_nationkey = 7 AND c_acctbal > 5000),
h0 AS (SELECT node, 0 AS hops, node AS anchor FROM a),
h1 AS (SELECT other AS node, 1 AS hops, min(anchor) AS anchor FROM h0 JOIN l USING (node) WHERE other NOT IN (SELECT node FROM h0) GROUP BY 1),
h2 AS (SELECT other AS node, 2 AS hops, min(anchor) AS anchor FROM h1 JOIN l USING (node) WHERE other NOT IN (SELECT node FROM h0 UNION SELECT node FROM h1) GROUP BY 1),
h3 AS (SELECT other AS node, 3 AS hops, min(anchor) AS anchor FROM h2 JOIN l USING (node) WHERE other NOT IN (SELECT node FROM h0 UNION SELECT node FROM h1 UNION SELECT node FROM h2) GROUP BY 1)
SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3""")
def anchors_within_three(t: Tables) -> DataFrame:
    lines = t.orders.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 997).alias("dst"))
    return components.nearest_anchors(t.customer.where("c_nationkey = 7 AND c_acctbal > 5000").select(F.col("c_custkey").alias("node")), lines)


_KEYS = rf"""
one AS (SELECT DISTINCT unnest({_SPLIT.format("concat_ws(' ', p_name, p_brand, p_type)")}) AS key FROM part),
two AS (SELECT DISTINCT unnest({_SPLIT.format("text")}) AS key FROM documents),
k AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS id FROM one
  UNION ALL SELECT key, row_number() OVER (ORDER BY key) - 1 + (SELECT count(*) FROM one) FROM two WHERE key NOT IN (SELECT key FROM one))"""


def _keys(t: Tables) -> tuple[KeyDictionary, DataFrame, DataFrame]:
    words = lambda c: F.explode(tx.tokens(c)).alias("key")
    return KeyDictionary(t.spark, _folder(t, "keys")), t.part.select("p_partkey", words(F.concat_ws(" ", "p_name", "p_brand", "p_type"))), t.documents.select("doc_id", words(F.col("text")))


@query(f"WITH {_KEYS} SELECT key, CAST(id AS BIGINT) AS id FROM k")
def key_intern(t: Tables) -> DataFrame:
    keys, parts, docs = _keys(t)
    keys.intern(parts)
    return keys.intern(docs)


@query(f"""WITH {_KEYS},
w AS (SELECT doc_id, unnest({_SPLIT.format("text")}) AS key FROM documents),
v AS (SELECT doc_id AS entity, key, CAST(count(*) AS VARCHAR) AS value FROM w GROUP BY 1, 2)
SELECT entity, CAST(id AS BIGINT) AS key_id, value FROM v JOIN k USING (key)""")
def property_write(t: Tables) -> DataFrame:
    keys, parts, docs = _keys(t)
    keys.intern(parts)
    return keys.properties(docs.groupBy(F.col("doc_id").alias("entity"), "key").agg(F.count("*").cast("string").alias("value")))


@query("""SELECT 'clients' AS name, 2 AS snapshot, count(*) AS n_rows, count(DISTINCT client_id) AS n_keys FROM clients WHERE source <> 'crm'
UNION ALL SELECT 'sales', 2, count(*), count(DISTINCT sale_id) FROM sales""")
def snapshot_read(t: Tables) -> DataFrame:
    """Two whole snapshots and one that was stopped before its marker."""
    kept = Snapshots(t.spark, _folder(t, "snapshots"))
    kept.write({"clients": t.clients, "sales": t.sales})
    kept.write({"clients": t.clients.where("source <> 'crm'"), "sales": t.sales})
    kept.write({"clients": t.clients.where("source = 'crm'")}, mark=False)
    whole, number = kept.read(), F.lit(kept.latest())
    count = lambda name, key: whole[name].agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys")).select(F.lit(name).alias("name"), number.alias("snapshot"), "n_rows", "n_keys")
    return count("clients", "client_id").union(count("sales", "sale_id"))


@query(r"""
WITH c AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
n AS (SELECT source, list_filter(string_split_regex(lower(line), '[^\p{L}\p{N}]+'), lambda x: x <> '')[1] AS term FROM c),
g AS (SELECT source, term, count(*) AS n FROM n WHERE term IS NOT NULL GROUP BY 1, 2)
SELECT a.source AS left_source, b.source AS right_source, count(*) AS shared, CAST(sum(least(a.n, b.n)) AS BIGINT) AS weight
FROM g a JOIN g b ON a.term = b.term AND a.source < b.source WHERE a.term IN (SELECT term FROM g GROUP BY term HAVING count(*) <= 8) GROUP BY 1, 2""")
def workspace_rebuild(t: Tables) -> DataFrame:
    """Lines, their first terms by source, and links of sources by rare terms; stopped after the terms and started again."""
    stages = [
        ("lines", lambda d: d.select("source", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")), ["documents"]),
        ("terms", lambda c: c.select("source", F.get(tx.tokens(F.col("line")), F.lit(0)).alias("term")).where("term is not null").groupBy("source", "term").agg(F.count("*").alias("n")), ["lines"]),
        ("links", _shared_terms, ["terms"]),
    ]
    path, inputs = _folder(t, "rebuild"), {"documents": t.documents.select("doc_id", "source", "text")}
    Rebuild(t.spark, path, stages).run(inputs, until="terms")
    return Rebuild(t.spark, path, stages).run(inputs)["links"]


def _shared_terms(terms: DataFrame) -> DataFrame:
    rare = terms.groupBy("term").agg(F.count("*").alias("held")).where("held <= 8").select("term")
    of = lambda side: terms.join(rare, "term", "left_semi").select("term", F.col("source").alias(f"{side}_source"), F.col("n").alias(f"{side}_n"))
    met = of("left").join(of("right"), "term").where("left_source < right_source")
    return met.groupBy("left_source", "right_source").agg(F.count("*").alias("shared"), F.sum(F.least("left_n", "right_n")).alias("weight"))


@query("""SELECT kind, count(DISTINCT client_id) AS clients, true AS within_bound, true AS merge_equals_one_pass FROM clicks GROUP BY kind""")
def sketch_distinct(t: Tables) -> DataFrame:
    """Sketches of each day united by kind, against those of one pass and the exact counts."""
    clicks = t.clicks.withColumn("day", F.to_date("ts"))
    daily = sketches.sketched(clicks, ["kind", "day"], F.col("client_id"))
    merged = sketches.united(daily, ["kind"]).select("kind", sketches.estimate(F.col("sketch")).alias("merged"))
    once = sketches.sketched(clicks, ["kind"], F.col("client_id")).select(F.col("kind").alias("_kind"), sketches.estimate(F.col("sketch")).alias("once"))
    exact = clicks.groupBy(F.col("kind").alias("of")).agg(F.countDistinct("client_id").alias("clients"))
    met = merged.join(once, F.col("kind").eqNullSafe(F.col("_kind"))).join(exact, F.col("kind").eqNullSafe(F.col("of")))
    return met.select("kind", "clients", (F.abs(F.col("merged") - F.col("clients")) <= F.col("clients") * sketches.BOUND).alias("within_bound"), (F.col("merged") == F.col("once")).alias("merge_equals_one_pass"))
