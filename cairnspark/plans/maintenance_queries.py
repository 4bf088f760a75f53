"""Repairs: missing pages to a fixpoint, names without clashes and links that follow them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import maintenance, output_names
from .registry import Tables, query


def _path(kind: str, number) -> F.Column:
    return F.concat(F.lit(f"{kind}/"), number.cast("string"))


def _orders(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    return t.orders.select(_path("order", key).alias("path"), F.col("o_orderpriority").alias("title"), _path("order", F.floor(key / 8)).alias("up"), _path("client", F.col("o_custkey")).alias("client"), "o_orderstatus")


def _wiki(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Filled orders are pages, open ones and customers records of what a page might tell; of others nothing is known."""
    orders = _orders(t)
    pages = orders.where("o_orderstatus = 'F'").select("path", F.array("up", "client").alias("refs"))
    customers = t.customer.select(_path("client", F.col("c_custkey")).alias("path"), F.col("c_name").alias("title"), F.array(_path("nation", F.col("c_nationkey"))).alias("refs"))
    return pages, orders.where("o_orderstatus = 'O'").select("path", "title", F.array("up").alias("refs")).union(customers)


_WIKI = """
pages AS (SELECT 'order/' || o_orderkey AS path, ['order/' || (o_orderkey // 8), 'client/' || o_custkey] AS refs FROM orders WHERE o_orderstatus = 'F'),
records AS (SELECT 'order/' || o_orderkey AS path, o_orderpriority AS title, ['order/' || (o_orderkey // 8)] AS refs FROM orders WHERE o_orderstatus = 'O'
  UNION ALL SELECT 'client/' || c_custkey, c_name, ['nation/' || c_nationkey] FROM customer),
steps AS (SELECT path AS named_by, unnest(refs) AS path, 1 AS round FROM pages
  UNION SELECT s.path, unnest(r.refs), s.round + 1 FROM steps s JOIN records r ON r.path = s.path WHERE s.path NOT IN (SELECT path FROM pages) AND s.round < 12),
stubs AS (SELECT path, min(round) AS round, arg_min(named_by, (round, named_by)) AS named_by FROM steps WHERE path NOT IN (SELECT path FROM pages) GROUP BY path)"""


@query(f"""
WITH RECURSIVE {_WIKI}
SELECT path, coalesce(title, string_split(path, '/')[-1]) AS title, round, named_by, coalesce(len(refs), 0) AS n_refs FROM stubs LEFT JOIN records USING (path)""")
def wiki_repair(t: Tables) -> DataFrame:
    return maintenance.repair(*_wiki(t)).select("path", "title", "round", "named_by", F.size("refs").alias("n_refs"))


_NAMED = """
n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment || '-' || c_nationkey WHEN c_custkey % 7 = 0 THEN c_mktsegment || '-' || c_nationkey || '-2' ELSE c_mktsegment END AS name FROM customer),
k AS (SELECT id, name, row_number() OVER (PARTITION BY name ORDER BY id) - 1 AS r FROM n),
s AS (SELECT name, unnest(range(2, 2 + (SELECT count(*) FROM n m WHERE m.name = b.name) + 30)) AS suffix FROM (SELECT DISTINCT name FROM n) b),
f AS (SELECT name, suffix, row_number() OVER (PARTITION BY name ORDER BY suffix) AS r FROM s WHERE name || '-' || suffix NOT IN (SELECT name FROM n)),
o AS (SELECT id, name, CASE WHEN r = 0 THEN name ELSE name || '-' || suffix END AS output FROM k LEFT JOIN f USING (name, r))"""


def _named(t: Tables) -> DataFrame:
    nation = F.concat_ws("-", "c_mktsegment", "c_nationkey")
    name = F.when(F.col("c_custkey") % 5 == 0, nation).when(F.col("c_custkey") % 7 == 0, F.concat(nation, F.lit("-2"))).otherwise(F.col("c_mktsegment"))
    return t.customer.select(F.col("c_custkey").alias("id"), name.alias("name"))


@query(f"WITH {_NAMED} SELECT * FROM o")
def output_names_without_clash(t: Tables) -> DataFrame:
    return output_names.clash_free(_named(t))


@query(f"""
WITH {_NAMED}
SELECT o_orderkey AS text_id, 'Order of [this](' || coalesce(output || '.md', 'c' || o_custkey) || ') in [that](n1), see ![it](' || coalesce(output || '.md', 'c' || o_custkey) || ')' || o_orderstatus AS text,
  3 AS n_links, CASE WHEN output IS NULL THEN 0 ELSE 2 END AS n_rewritten FROM orders LEFT JOIN o ON id = o_custkey""")
def links_rewritten(t: Tables) -> DataFrame:
    client = F.concat(F.lit("c"), "o_custkey")
    texts = t.orders.select(F.col("o_orderkey").alias("text_id"), F.concat(F.lit("Order of [this]("), client, F.lit(") in [that](n1), see ![it]("), client, F.lit(")"), "o_orderstatus").alias("text"))
    outputs = output_names.clash_free(_named(t)).select(F.concat(F.lit("c"), "id").alias("target"), F.concat("output", F.lit(".md")).alias("output"))
    return output_names.rewrite_links(texts, outputs)
