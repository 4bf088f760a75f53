"""Versions, replay and event logs over orders and events, and streaming over the same rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import folds, text as tx
from ..operators import history as hs
from ..operators.retrieval import top
from ..streaming import materialise
from .registry import Tables, query

_HIST = """
ch AS (SELECT o_custkey, o_orderstatus, o_orderdate, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderstatus) AS prior, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderstatus) AS k FROM orders),
h AS (SELECT o_custkey, o_orderstatus, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderstatus) AS valid_to,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderstatus) AS INT) AS version FROM ch WHERE k = 1 OR prior IS DISTINCT FROM o_orderstatus)"""


def _history(t: Tables) -> DataFrame:
    return hs.versions(t.orders, ["o_custkey"], "o_orderdate", ["o_orderstatus"])


@query(f"WITH {_HIST} SELECT * FROM h")
def scd2_history(t: Tables) -> DataFrame:
    return _history(t)


@query(f"WITH {_HIST} SELECT * FROM h WHERE valid_from <= TIMESTAMP '1996-06-30' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1996-06-30')")
def as_of(t: Tables) -> DataFrame:
    return hs.as_of(_history(t), F.lit("1996-06-30").cast("timestamp_ntz"))


@query(f"WITH {_HIST} SELECT o_orderstatus, count(*) AS n, max(version) AS most_versions FROM h WHERE valid_to IS NULL GROUP BY 1")
def live_snapshot(t: Tables) -> DataFrame:
    return hs.live(_history(t)).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max("version").alias("most_versions"))


@query("""
WITH c AS (SELECT c_custkey AS id, c_mktsegment AS segment, 10 AS valid_from FROM customer WHERE c_acctbal > 0),
i AS (SELECT c_custkey AS id, CASE WHEN c_nationkey = 5 THEN 'CHANGED' ELSE c_mktsegment END AS segment FROM customer WHERE c_nationkey <> 3)
SELECT c.id, c.segment, CAST(c.valid_from AS BIGINT) AS valid_from, CAST(CASE WHEN i.segment = c.segment THEN NULL ELSE 20 END AS BIGINT) AS valid_to, CASE WHEN i.segment = c.segment THEN NULL ELSE 'ev-2' END AS superseded_by FROM c LEFT JOIN i USING (id)
UNION ALL SELECT i.id, i.segment, 20, NULL, NULL FROM i LEFT JOIN c USING (id) WHERE c.id IS NULL OR c.segment <> i.segment""")
def version_merge(t: Tables) -> DataFrame:
    cust = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), "c_nationkey", "c_acctbal")
    current = cust.where("c_acctbal > 0").select("id", "segment", F.lit(10).cast("bigint").alias("valid_from"), F.lit(None).cast("bigint").alias("valid_to"), F.lit(None).cast("string").alias("superseded_by"))
    incoming = cust.where("c_nationkey <> 3").withColumn("segment", F.when(F.col("c_nationkey") == 5, "CHANGED").otherwise(F.col("segment")))
    return hs.merge(current, incoming, ["id"], ["segment"], F.lit(20).cast("bigint"), F.lit("ev-2"))


_DAYS = "ev AS (SELECT user_id AS scope, CAST(ts AS DATE) AS day, event_type AS item, count(*) % 3 AS content FROM events GROUP BY 1, 2, 3)"


@query(f"""
WITH {_DAYS},
st AS (SELECT scope, day, row_number() OVER (PARTITION BY scope ORDER BY day) AS step FROM (SELECT DISTINCT scope, day FROM ev)),
k AS (SELECT ev.*, step, lag(step) OVER w AS ps, lag(content) OVER w AS pc FROM ev JOIN st USING (scope, day) WINDOW w AS (PARTITION BY scope, item ORDER BY step)),
r AS (SELECT *, sum(CASE WHEN ps IS NULL OR step - ps <> 1 OR pc <> content THEN 1 ELSE 0 END) OVER (PARTITION BY scope, item ORDER BY step) AS run FROM k),
g AS (SELECT scope, item, run, any_value(content) AS content, min(step) AS from_step, max(step) AS to_step FROM r GROUP BY 1, 2, 3),
f AS (SELECT scope, max(step) AS final FROM st GROUP BY 1)
SELECT scope, item, content, CAST(from_step AS INT) AS from_step, CAST(CASE WHEN to_step < final THEN to_step + 1 END AS INT) AS closed_step FROM g JOIN f USING (scope)""")
def replay_state(t: Tables) -> DataFrame:
    return hs.replay(_daily_states(t), ["scope"], "item", [F.col("day")], "content")


def _daily_states(t: Tables) -> DataFrame:
    days = t.events.groupBy(F.col("user_id").alias("scope"), F.to_date("ts").alias("day"), F.col("event_type").alias("item"))
    return days.agg((F.count("*") % 3).alias("content"))


@query("""
SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n, max_by(event_id, (ts, event_id)) AS latest FROM events
WHERE event_type IN ('click', 'purchase') AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' GROUP BY 1, 2""".replace("max_by(event_id, (ts, event_id))", "arg_max(event_id, (ts, event_id))"))
def event_history_filter(t: Tables) -> DataFrame:
    kept = t.events.where(F.col("event_type").isin("click", "purchase") & F.col("ts").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz")))
    return kept.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_per_key(t: Tables) -> DataFrame:
    return hs.latest(t.events, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("""
WITH b AS (SELECT o_custkey AS scope, o_orderkey AS id, o_totalprice AS v FROM orders WHERE o_orderstatus <> 'P'), c AS (SELECT o_custkey AS scope, o_orderkey AS id, o_totalprice + 1 AS v FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT * FROM b WHERE scope NOT IN (SELECT scope FROM c) UNION ALL SELECT * FROM c""")
def overlay_state(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"), "o_orderstatus", "o_orderpriority")
    return hs.overlay(rows.where("o_orderstatus <> 'P'").select("scope", "id", "v"), rows.where("o_orderpriority = '1-URGENT'").withColumn("v", F.col("v") + 1), ["id"], ["scope"])


@query(f"WITH {_HIST} SELECT count(*) AS broken FROM h WHERE valid_to < valid_from")
def lint_validity(t: Tables) -> DataFrame:
    return _history(t).where("valid_to < valid_from").agg(F.count("*").alias("broken"))


@query("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, event_type IN ('click', 'view', 'purchase') AS known, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events""")
def event_payloads(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("event_type").isin("click", "view", "purchase").alias("known"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))


@query("SELECT url, page_id FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE url LIKE '%ref=%')")
def scan_new_paths(t: Tables) -> DataFrame:
    return t.pages.join(t.pages.where("url like '%ref=%'").select("url"), "url", "left_anti").select("url", "page_id")


@query("""
SELECT status, count(*) AS n FROM (SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus = 'F') = 0 THEN 'ingested' WHEN count(*) FILTER (o_orderstatus <> 'F') = 0 THEN 'failed' ELSE 'partial' END AS status FROM orders GROUP BY 1) GROUP BY 1""")
def ingest_status(t: Tables) -> DataFrame:
    failed, good = F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus") != "F")
    each = t.orders.groupBy("o_custkey").agg(F.when(failed == 0, "ingested").when(good == 0, "failed").otherwise("partial").alias("status"))
    return each.groupBy("status").agg(F.count("*").alias("n"))


@query("""
WITH j AS (SELECT o_orderkey AS job, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'queued' ELSE 'processing' END AS status, o_custkey % 4 AS attempts, epoch(o_orderdate) % 600 AS lease FROM orders)
SELECT job, CASE WHEN status = 'processing' AND lease <= 300 THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END ELSE status END AS status, CAST(attempts AS BIGINT) AS attempts FROM j""")
def import_job_expiry(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "queued").otherwise("processing")
    jobs = t.orders.select(F.col("o_orderkey").alias("job"), status.alias("status"), (F.col("o_custkey") % 4).alias("attempts"), (F.unix_timestamp("o_orderdate") % 600).alias("lease"))
    expired = (F.col("status") == "processing") & (F.col("lease") <= 300)
    return jobs.select("job", F.when(expired, F.when(F.col("attempts") >= 3, "failed").otherwise("queued")).otherwise(F.col("status")).alias("status"), "attempts")


@query("""
SELECT job, CAST(k AS INT) AS rank FROM (SELECT o_orderkey AS job, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O') WHERE k <= 16""")
def import_job_claim(t: Tables) -> DataFrame:
    queued = t.orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("job"), "o_orderdate", F.lit(1).alias("all"))
    return top(queued, ["all"], [F.col("o_orderdate"), F.col("job")], 16).select("job", "rank")


@query("""
WITH w AS (SELECT source, doc_id, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT source, doc_id, CAST(least(n_chars, greatest(40000 - before, 0)) AS BIGINT) AS kept FROM w""")
def budget_trim(t: Tables) -> DataFrame:
    return folds.spend_budget(t.documents, ["source"], ["doc_id"], F.col("n_chars"), 40_000).select("source", "doc_id", "kept")


@query()
def batch_plan(t: Tables) -> DataFrame:
    return folds.batch_plan(t.documents, "source", "doc_id", "n_chars")


@query(f"""
WITH {_DAYS},
l AS (SELECT scope, item, arg_max(content, day) AS content, max(day) AS day FROM ev GROUP BY 1, 2)
SELECT scope, item, content, CAST(day AS VARCHAR) AS day FROM l""")
def stream_materialise(t: Tables) -> DataFrame:
    states = _daily_states(t).withColumn("day", F.col("day").cast("string"))
    return materialise.run_once(states, ["scope", "item"], ["day"]).select("scope", "item", "content", "day")


@query("""
SELECT CAST(time_bucket(INTERVAL 1 DAY, ts) AS VARCHAR)[1:10] AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def ext_tumbling_window(t: Tables) -> DataFrame:
    w = F.window(F.col("ts"), "1 day")
    return t.events.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, count(DISTINCT s) AS sessions, count(*) AS events FROM s GROUP BY 1""")
def ext_session_window(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts")
    new = F.when(F.col("ts") > F.lag("ts").over(w) + F.expr("interval 2 hours"), 1).otherwise(0)
    s = t.events.select("user_id", "ts", new.alias("new")).withColumn("s", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id").agg(F.countDistinct("s").alias("sessions"), F.count("*").alias("events"))


@query("""SELECT e.event_id, p.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'view') e ASOF JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def ext_asof_join(t: Tables) -> DataFrame:
    """The last purchase at or before each view: a union and a running ``last`` instead of pairs."""
    rows = t.events.where("event_type in ('view', 'purchase')").select("user_id", "ts", "event_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "purchase", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("purchase_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w))
    return seen.where("event_type = 'view' and purchase_id is not null").select("event_id", "purchase_id")


@query("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def ext_stream_windows(t: Tables) -> DataFrame:
    got = materialise.run_windowed(t.events.select("ts", "event_type", "value"), "ts", "event_type", "1 day")
    return got.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))
