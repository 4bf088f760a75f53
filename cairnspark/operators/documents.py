"""Documents: sections, wiki pages and revisions, projects, ingest packages, extraction artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import text as tx


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_no, title, body): markdown cut at its headings; what stands before the first
    heading is a section without a title."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "line"))
    is_heading = F.rlike("line", F.lit(r"^#{1,6}\s*\S"))
    w = Window.partitionBy(key).orderBy("line_no")
    cut = lines.withColumn("heading", is_heading).withColumn("section_no", F.sum(F.col("heading").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    title = F.max(F.when(F.col("heading"), F.trim(F.regexp_replace("line", r"^#+", ""))))
    rows = F.array_sort(F.collect_list(F.when(~F.col("heading"), F.struct("line_no", "line"))))
    return cut.groupBy(key, "section_no").agg(title.alias("title"), F.trim(F.array_join(F.transform(rows, lambda x: x["line"]), "\n")).alias("body"))


def title_of(text: Column) -> Column:
    """The first heading, else the first line that isn't blank."""
    heading = F.regexp_extract(text, r"(?m)^#{1,6}\s*(\S[^\n]*)$", 1)
    return F.trim(F.when(heading != "", heading).otherwise(F.regexp_extract(text, r"(?m)^\s*(\S[^\n]*)$", 1)))


def compile_project(docs: DataFrame, key: str, text: str, most: int = 8, excerpt: int = 220) -> DataFrame:
    """A source node for each text and one evidence for each of its first sections."""
    rows = sections(docs, key, text).where(F.length("body") > 0)
    w = Window.partitionBy(key).orderBy("section_no")
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select(key, F.concat_ws(":", F.lit("evidence"), key, F.col("n")).alias("evidence_id"), F.coalesce("title", F.lit("")).alias("title"), F.substring("body", 1, excerpt).alias("excerpt"), F.lit(0.72).alias("confidence"))


def revise(pages: DataFrame, current: DataFrame, event: Column, at: Column) -> DataFrame:
    """Wiki revisions. ``pages``: page_id, body; ``current``: page_id, body, revision, event,
    valid_from, valid_to. A new event closes the live revision and adds the next one even if the body
    is unchanged; the same event overwrites in place; absent pages are closed."""
    live = current.where("valid_to is null")
    met = live.join(pages.withColumnRenamed("body", "new_body"), "page_id", "full_outer")
    same = F.col("event").eqNullSafe(event)
    had, has = F.col("revision").isNotNull(), F.col("new_body").isNotNull()
    kept = met.where(had).select("page_id", F.when(same & has, F.col("new_body")).otherwise(F.col("body")).alias("body"), "revision", "event", "valid_from", F.when(same & has, F.lit(None)).otherwise(at).cast("bigint").alias("valid_to"))
    new = met.where(has & (~had | ~same)).select("page_id", F.col("new_body").alias("body"), (F.coalesce("revision", F.lit(0)) + 1).alias("revision"), event.alias("event"), at.cast("bigint").alias("valid_from"), F.lit(None).cast("bigint").alias("valid_to"))
    return current.where("valid_to is not null").unionByName(kept).unionByName(new)


def wiki_pages(nodes: DataFrame, claims: DataFrame) -> DataFrame:
    """One page for each node (node_id, label): its claims (node_id, claim_id, statement, evidence_ids)
    as a list, with the references it rests on."""
    lines = claims.groupBy("node_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_id", "statement"))), lambda c: F.concat(F.lit("- "), c["statement"])), "\n").alias("lines"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("evidence_refs"),
    )
    slug = F.replace(tx.normal_key(F.col("label")), F.lit(" "), F.lit("-"))
    return nodes.join(lines, "node_id", "left").select("node_id", F.concat(F.lit("wiki/"), slug, F.lit(".md")).alias("path"), F.concat(F.lit("# "), "label", F.lit("\n\n"), F.coalesce("lines", F.lit(""))).alias("body"), F.coalesce("evidence_refs", F.expr("cast(array() as array<string>)")).alias("evidence_refs"))


#: The shape of one extracted record set as providers return it.
EXTRACTION = (
    "struct<nodes:array<struct<id:string,kind:string,label:string,evidence_ids:array<string>,confidence:double>>,"
    "claims:array<struct<id:string,statement:string,topic_refs:array<string>,evidence_ids:array<string>>>,"
    "relations:array<struct<id:string,kind:string,source:string,target:string,evidence_ids:array<string>,confidence:double>>>"
)


def first_json(reply: Column) -> Column:
    """The outermost JSON object in a reply that may have prose or fences around it."""
    return F.regexp_extract(reply, r"(?s)(\{.*\})", 1)


def parse_extraction(replies: DataFrame, key: str, reply: str) -> DataFrame:
    """(key, extraction): typed records; what can't be parsed is null."""
    return replies.select(key, F.from_json(first_json(F.col(reply)), EXTRACTION).alias("extraction"))


def supported(extractions: DataFrame, key: str, evidence: DataFrame, most_nodes: int = 24, most_other: int = 8) -> DataFrame:
    """Records whose references are all known, with labels or statements, each id once, capped by
    their order: (key, record, id, evidence_ids)."""
    parts = []
    for record, said, most in (("nodes", "label", most_nodes), ("claims", "statement", most_other), ("relations", "kind", most_other)):
        rows = extractions.select(key, F.posexplode(f"extraction.{record}").alias("at", "r")).where(F.length(F.trim(F.col(f"r.{said}"))) > 0)
        refs = rows.select(key, "at", "r.id", F.explode("r.evidence_ids").alias("evidence_id")).join(evidence.select("evidence_id").distinct(), "evidence_id", "left_semi")
        known = refs.groupBy(key, "at", "id").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))
        w = Window.partitionBy(key).orderBy("at")
        first = known.withColumn("again", F.row_number().over(Window.partitionBy(key, "id").orderBy("at"))).where("again = 1").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
        parts.append(first.select(key, F.lit(record).alias("record"), "id", "evidence_ids"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def patch_violations(operations: DataFrame, known: DataFrame) -> DataFrame:
    """(patch_id, ordinal, rule) of all broken rules of graph patches. ``operations``: patch_id,
    ordinal, op, target, label, path, refs; the first row by ordinal decides, nothing is applied if
    there is one."""
    rule = lambda df, name: df.select("patch_id", "ordinal", F.lit(name).alias("rule"))
    twice = operations.withColumn("n", F.row_number().over(Window.partitionBy("patch_id", "target").orderBy("ordinal"))).where("n > 1")
    blank = operations.where(F.col("op").isin("upsert_node", "upsert_claim") & (F.length(F.trim(F.coalesce("label", F.lit("")))) == 0))
    path = operations.where((F.col("op") == "upsert_wiki_page") & ~tx.safe_path(F.col("path")))
    refs = operations.select("patch_id", "ordinal", F.explode("refs").alias("id")).join(known.select("id"), "id", "left_anti").distinct()
    unknown = operations.where(~F.col("op").isin("upsert_node", "upsert_claim", "upsert_relation", "upsert_wiki_page", "remove"))
    return rule(twice, "target_twice").unionByName(rule(blank, "blank_label")).unionByName(rule(path, "unsafe_path")).unionByName(rule(refs, "unknown_reference")).unionByName(rule(unknown, "unknown_operation")).distinct()


def apply_patch(rows: DataFrame, operations: DataFrame, violations: DataFrame) -> DataFrame:
    """``rows`` (id, label) after all valid patches, in order of patch and ordinal."""
    valid = operations.join(violations.select("patch_id").distinct(), "patch_id", "left_anti")
    w = Window.partitionBy("target").orderBy(F.desc("patch_id"), F.desc("ordinal"))
    last = valid.withColumn("n", F.row_number().over(w)).where("n = 1").select(F.col("target").alias("id"), "op", F.col("label").alias("new_label"))
    return rows.join(last, "id", "full_outer").where(F.col("op").isNull() | (F.col("op") != "remove")).select("id", F.coalesce("new_label", "label").alias("label"))


def import_status(pages: DataFrame, source: str, failed: Column) -> DataFrame:
    bad, good = F.count_if(failed), F.count_if(~failed)
    return pages.groupBy(source).agg(F.when(bad == 0, "ingested").when(good == 0, "failed").otherwise("partial").alias("status"))


def retried(pages: DataFrame, again: DataFrame, key: list[str]) -> DataFrame:
    """Pages with the results of a second attempt (key, text, status) where there is one."""
    return pages.join(again.select(*key, F.col("text").alias("t2"), F.col("status").alias("s2")), key, "left").select(*key, F.coalesce("t2", "text").alias("text"), F.coalesce("s2", "status").alias("status"))


#: Allowed steps of an import.
TRANSITIONS = [("queued", "processing"), ("processing", "ingested"), ("processing", "partial"), ("processing", "failed"), ("failed", "queued"), ("partial", "queued"), ("ingested", "graph_ready"), ("partial", "graph_ready"), ("graph_ready", "queued")]


def bad_transitions(steps: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Steps (key, status, order) whose status can't follow the one before."""
    spark = steps.sparkSession
    before = F.lag("status").over(Window.partitionBy(key).orderBy(*order))
    pairs = steps.withColumn("prior", before).where("prior is not null and prior <> status")
    return pairs.join(F.broadcast(spark.createDataFrame(TRANSITIONS, "prior string, status string")), ["prior", "status"], "left_anti")


def preserved_events(new: DataFrame, old: DataFrame, kinds: list[str]) -> DataFrame:
    """New events, and old ones of kinds that outlive a rebuild whose id is new."""
    return new.unionByName(old.where(F.col("event_type").isin(*kinds)).join(new.select("event_id"), "event_id", "left_anti").select(*new.columns))


def replaced_live(current: DataFrame, projection: DataFrame, at: Column) -> DataFrame:
    """Every live row of ``current`` (valid_from, valid_to) closed, and the rows of a new projection live."""
    columns = [c for c in current.columns if c not in ("valid_from", "valid_to")]
    closed = current.withColumn("valid_to", F.coalesce("valid_to", at.cast("bigint")))
    return closed.unionByName(projection.select(*columns, at.cast("bigint").alias("valid_from"), F.lit(None).cast("bigint").alias("valid_to")))
