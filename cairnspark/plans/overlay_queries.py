"""Overlays by record kind: orders as claims about parts, with suppliers as sources and lines as evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import overlays
from .registry import Tables, query

_RECORDS = """
l AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT CAST(l_suppkey AS VARCHAR))) AS sources, list_sort(list(DISTINCT l_orderkey || '-' || l_linenumber)) AS evidence, list_sort(list(DISTINCT CAST(l_partkey AS VARCHAR))) AS topics FROM lineitem GROUP BY 1),
k AS (SELECT l_orderkey AS id, coalesce(list_sort(list(DISTINCT CAST(l_suppkey AS VARCHAR)) FILTER (l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0))), []) AS sources,
  coalesce(list_sort(list(DISTINCT l_orderkey || '-' || l_linenumber) FILTER (l_quantity <= 10)), []) AS evidence,
  coalesce(list_sort(list(DISTINCT CAST(l_partkey AS VARCHAR)) FILTER (l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 10))), []) AS topics,
  count(DISTINCT l_suppkey) FILTER (l_quantity <= 10) AS spread FROM lineitem GROUP BY 1),
c AS (SELECT o_orderkey AS id, 'old' AS content, l.* EXCLUDE (id) FROM orders JOIN l ON l.id = o_orderkey WHERE o_orderstatus IN ('O', 'P')),
n AS (SELECT o_orderkey AS id, 'new' AS content, k.* EXCLUDE (id) FROM orders JOIN k ON k.id = o_orderkey WHERE o_orderstatus IN ('F', 'O'))"""
_SAID = "id, content, list_aggregate(sources, 'string_agg', ',') AS sources, list_aggregate(evidence, 'string_agg', ',') AS evidence, list_aggregate(topics, 'string_agg', ',') AS topics"


def _overlaid(t: Tables, kind: str, linking: bool) -> DataFrame:
    ref = lambda c: F.sort_array(F.collect_set(c))
    line = F.concat_ws("-", "l_orderkey", "l_linenumber")
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(ref(F.col("l_suppkey").cast("string")).alias("source_refs"), ref(line).alias("evidence_refs"), ref(F.col("l_partkey").cast("string")).alias("topic_refs"))
    columns = ["source_refs", "evidence_refs", "topic_refs"]
    of = lambda *s: t.orders.where(F.col("o_orderstatus").isin(*s)).select(F.col("o_orderkey").alias("id")).join(lines, "id")
    known = {
        "source_refs": t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("ref")),
        "evidence_refs": t.lineitem.where("l_quantity <= 10").select(line.alias("ref")),
        "topic_refs": t.part.where("p_size <= 10").select(F.col("p_partkey").cast("string").alias("ref")),
    }
    rows = lambda s, said: of(*s).select("id", F.lit(said).alias("content"), *columns)
    sources = t.lineitem.where("l_quantity <= 10").select(line.alias("ref"), F.col("l_suppkey").alias("source"))
    got = overlays.overlay(kind, rows(("O", "P"), "old"), rows(("F", "O"), "new"), known, sources, linking)
    said = lambda c: F.nullif(F.array_join(c, ","), F.lit(""))
    return got.select("id", "content", said("source_refs").alias("sources"), said("evidence_refs").alias("evidence"), said("topic_refs").alias("topics"))


@query(f"""
WITH {_RECORDS}, w AS (SELECT * FROM n WHERE len(sources) + len(evidence) > 0 AND len(topics) > 0)
SELECT {_SAID} FROM (SELECT * FROM c WHERE id NOT IN (SELECT id FROM w) UNION ALL SELECT * EXCLUDE (spread) FROM w)""")
def overlay_claims(t: Tables) -> DataFrame:
    return _overlaid(t, "claims", False)


@query(f"""
WITH {_RECORDS}, w AS (SELECT * FROM n WHERE len(topics) > 0 AND len(sources) > 1 AND spread > 1 AND id NOT IN (SELECT id FROM c))
SELECT {_SAID} FROM (SELECT * FROM c UNION ALL SELECT * EXCLUDE (spread) FROM w)""")
def overlay_linked_claims(t: Tables) -> DataFrame:
    return _overlaid(t, "claims", True)
