"""Readers: text files, chunk indexes, event logs, artifacts, blobs. All are lazy Spark scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EVENT = (
    "event_id string, workspace_id string, event_type string, operation_type string, payload_json string, "
    "actor struct<actor_type:string,actor_id:string>, source_refs array<string>, node_refs array<string>, edge_refs array<string>, "
    "causality struct<materialized_version:bigint>, created_at bigint"
)
CHUNK = "chunk_id string, workspace_id string, source_id string, heading_path array<string>, line_start int, line_end int, text_hash string, text string"
#: Event kinds of the model; others are dropped on reading.
EVENT_KINDS = ["source_queued", "source_compiled", "observation_appended", "memory_accepted", "maintenance_run", "graph_materialized", "wiki_materialized", "correction_applied", "proposal_committed"]


def text_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(source_id, path, text, content_hash) of whole files, found recursively."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.input_file_name().alias("path"), F.regexp_replace(F.regexp_replace("value", "\r\n?", "\n"), r"\s+$", "").alias("text")).select(F.substring(F.sha2("path", 256), 1, 32).alias("source_id"), "path", "text", F.sha2("text", 256).alias("content_hash"))


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """(key, length, content): files named by the hash of their bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.sha2("content", 256).alias("key"), "length", "content")


def chunks(spark: SparkSession, path: str, source_id: str | None = None) -> DataFrame:
    rows = spark.read.schema(CHUNK).json(path)
    return rows if source_id is None else rows.where(F.col("source_id") == source_id)


def events(spark: SparkSession, path: str) -> DataFrame:
    """Events of known kinds; lines that aren't JSON are dropped."""
    return spark.read.schema(EVENT).option("mode", "PERMISSIVE").json(path).where(F.col("event_type").isin(*EVENT_KINDS))


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT).json(path).where(F.col("event_type").isin(*EVENT_KINDS))


def new_files(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files (path) whose path isn't known; a changed file at a known path isn't new."""
    return found.join(known.select("path").distinct(), "path", "left_anti")


def string_list(column: str):
    """A JSON list of strings, empty if it can't be read."""
    return F.coalesce(F.from_json(column, "array<string>"), F.expr("cast(array() as array<string>)"))


def latest_marker(events_: DataFrame) -> DataFrame:
    """(workspace_id, event_id, created_at) of the newest materialisation."""
    done = events_.where("event_type = 'graph_materialized'")
    return done.groupBy("workspace_id").agg(F.max_by(F.struct("event_id", "created_at"), F.struct("created_at", "event_id")).alias("m")).select("workspace_id", "m.*")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with the side: empty if two read models agree."""
    columns = a.columns
    return a.exceptAll(b.select(*columns)).withColumn("side", F.lit("left")).unionByName(b.select(*columns).exceptAll(a).withColumn("side", F.lit("right")))
