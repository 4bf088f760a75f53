"""Artifacts of imports and packs: source packs, evidence indexes, packages on disk, their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as tx

SOURCE_PACK, EVIDENCE_INDEX = "source_pack.v0", ("evidence_index.v0", "evidence_index.v1")
_NONE = "cast(array() as array<string>)"


def source_packs(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """One row for each source (source_id, workspace_id, path, content_hash, provider_route, local_only) of what
    was imported: its pages (source_id, page, label, error) are counted, not listed, since a source may have any
    number of them; they stay rows of their own."""
    seen = pages.groupBy("source_id").agg(F.count("*").alias("page_count"), F.count_if(F.col("error").isNotNull()).alias("failed_pages"))
    out = sources.join(seen, "source_id", "left").fillna(0, ["page_count", "failed_pages"])
    status = F.when(F.col("failed_pages") == 0, "ingested").when(F.col("failed_pages") == F.col("page_count"), "failed").otherwise("partial")
    name = F.element_at(F.split("path", "/"), -1)
    return out.select(F.lit(SOURCE_PACK).alias("schema_version"), "workspace_id", "source_id", name.alias("original_filename"), "content_hash", "provider_route", "local_only", "page_count", "failed_pages", status.alias("ingestion_status"))


def evidence_items(pages: DataFrame, packs: DataFrame) -> DataFrame:
    """(evidence_ref, source_id, page, evidence_type, quoted_text, content_hash) of every page that could be read."""
    read = pages.where("error is null and length(trim(text)) > 0").join(packs.select("source_id", "content_hash"), "source_id")
    return read.select(
        F.concat_ws(":", F.lit("evidence"), "source_id", F.col("page") + 1).alias("evidence_ref"), "source_id", (F.col("page") + 1).alias("page"), tx.evidence_type(F.col("text")).alias("evidence_type"),
        F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 420).alias("quoted_text"), "content_hash",
    )


def write_package(manifest: DataFrame, pages: DataFrame, evidence: DataFrame, path: str) -> None:
    """An import on disk: the manifest, the pages by source, the evidence index; each is written whole or not at all."""
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    pages.write.mode("overwrite").partitionBy("source_id").parquet(f"{path}/pages")
    evidence.write.mode("overwrite").partitionBy("source_id").json(f"{path}/evidence")


def read_package(spark: SparkSession, path: str, manifest_schema, page_schema, evidence_schema) -> tuple[DataFrame, DataFrame, DataFrame]:
    return spark.read.schema(manifest_schema).json(f"{path}/manifest"), spark.read.schema(page_schema).parquet(f"{path}/pages"), spark.read.schema(evidence_schema).json(f"{path}/evidence")


def exports(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(path, name, size): export files below a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))


def preserved(spark: SparkSession, path: str, pattern: str, aside: str) -> DataFrame:
    """Copies of export files aside, as rows (name, content_hash, content) that outlive a rebuild."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("content_hash"), "content").write.mode("append").parquet(aside)
    return spark.read.parquet(aside)


def _mismatch(present: Column, checks: list[tuple[Column, str]]) -> Column:
    """Names of the checks that fail, of a row that is there."""
    return F.array_compact(F.array(*[F.when(present & ~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in checks]))


def checked(sources: DataFrame, packs: DataFrame, indexes: DataFrame) -> DataFrame:
    """(source_id, content_hash, provider_route, local_only, warnings, pack_ok, index_ok): each source
    (source_id, workspace_id, file_hash: null if there is no file) with its source pack and evidence index (both: for_source, schema_version,
    workspace_id, source_id, content_hash, provider_route, local_only, warnings). A pack that doesn't fit
    is passed over for the file's hash; an index counts only if it fits the source and the hash."""
    as_ = lambda df, p: df.select(F.col("for_source").alias("source_id"), *[F.col(c).alias(f"{p}_{c}") for c in ("schema_version", "workspace_id", "source_id", "content_hash", "provider_route", "local_only", "warnings")])
    met = sources.join(as_(packs, "p"), "source_id", "left").join(as_(indexes, "i"), "source_id", "left")
    has_pack, has_index = F.col("p_schema_version").isNotNull(), F.col("i_schema_version").isNotNull()
    pack_faults = _mismatch(has_pack, [(F.col("p_schema_version") == SOURCE_PACK, "source_pack_schema_mismatch"), (F.col("p_source_id") == F.col("source_id"), "source_pack_source_mismatch"), (F.col("p_workspace_id") == F.col("workspace_id"), "source_pack_workspace_mismatch")])
    met = met.withColumn("pack_faults", F.when(has_pack, pack_faults).otherwise(F.array(F.lit("source_pack_missing")))).withColumn("pack_ok", F.size("pack_faults") == 0)
    met = met.withColumns({
        "content_hash": F.when(F.col("pack_ok"), F.col("p_content_hash")).otherwise(F.col("file_hash")),
        "provider_route": F.when(F.col("pack_ok"), F.col("p_provider_route")).when(F.col("file_hash").isNotNull(), "unknown"),
        "local_only": F.when(F.col("pack_ok"), F.col("p_local_only")).when(F.col("file_hash").isNotNull(), False),
    })
    known = F.col("content_hash").isNotNull()
    # the first fault of an index decides
    faults = _mismatch(has_index, [
        (F.col("i_schema_version").isin(*EVIDENCE_INDEX), "evidence_index_schema_mismatch"), (F.col("i_source_id") == F.col("source_id"), "evidence_index_source_mismatch"),
        (F.col("i_workspace_id") == F.col("workspace_id"), "evidence_index_workspace_mismatch"),
        (~F.col("pack_ok") | (F.col("i_provider_route") == F.col("provider_route")) & (F.col("i_local_only") == F.col("local_only")), "evidence_index_provider_mismatch"),
        (F.col("i_content_hash") == F.col("content_hash"), "evidence_index_stale_content_hash"),
    ])
    missing = F.when(F.col("pack_ok"), F.array(F.lit("evidence_index_missing"))).otherwise(F.expr(_NONE))
    index_faults = F.when(~known, F.expr(_NONE)).when(has_index, F.slice(faults, 1, 1)).otherwise(missing)
    met = met.withColumn("index_faults", index_faults).withColumn("index_ok", known & has_index & (F.size("index_faults") == 0))
    own = F.concat(F.when(F.col("pack_ok"), F.coalesce("p_warnings", F.expr(_NONE))).otherwise(F.expr(_NONE)), F.when(F.col("index_ok"), F.coalesce("i_warnings", F.expr(_NONE))).otherwise(F.expr(_NONE)))
    return met.select("source_id", "content_hash", "provider_route", "local_only", F.array_distinct(F.concat("pack_faults", "index_faults", own)).alias("warnings"), "pack_ok", "index_ok")


def usable_evidence(checked_sources: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence items (for_source, evidence_ref, source_id, page, content_hash, ...) of sources whose index fits,
    and (source_id, page, warning) of those that don't fit themselves."""
    known = checked_sources.where("index_ok").select(F.col("source_id").alias("for_source"), F.col("content_hash").alias("selected_hash"))
    met = items.join(known, "for_source").withColumn("warning", F.when(~F.col("source_id").eqNullSafe(F.col("for_source")), "evidence_item_source_mismatch").when(~F.col("content_hash").eqNullSafe(F.col("selected_hash")), "evidence_item_stale_content_hash"))
    return met.where("warning is null").select(*items.columns), met.where("warning is not null").select(F.col("for_source").alias("source_id"), "page", "warning")


def health(checked_sources: DataFrame, packs: DataFrame) -> DataFrame:
    """(source_id, hash_status, failed_pages, n_warnings, health) of each source: what the artifacts of the
    import tell, from whole ones to none."""
    pages = packs.select(F.col("for_source").alias("source_id"), "failed_pages")
    met = checked_sources.join(pages, "source_id", "left").fillna(0, ["failed_pages"])
    status = F.when(F.col("pack_ok") & F.col("index_ok"), "matched").when(F.array_contains("warnings", "evidence_index_stale_content_hash"), "mismatched").when(F.col("pack_ok"), "source_pack_only").otherwise("unknown")
    sick = F.when(status == "mismatched", "stale").when(~F.col("pack_ok"), "incomplete").when(F.col("failed_pages") > 0, "degraded").when(F.size("warnings") > 0, "warned").otherwise("healthy")
    return met.select("source_id", status.alias("hash_status"), "failed_pages", F.size("warnings").alias("n_warnings"), sick.alias("health"))


def warning_counts(checked_sources: DataFrame) -> DataFrame:
    """(warning, sources): how many sources each warning is about."""
    return checked_sources.select("source_id", F.explode("warnings").alias("warning")).groupBy("warning").agg(F.countDistinct("source_id").alias("sources"))


# packs as artifacts
def persist_pack(packs: DataFrame, path: str) -> None:
    """Packs (pack_id, query, budget, evidence: array of structs, ...) as JSON rows that can be found by id."""
    packs.select("pack_id", F.to_json(F.struct(*[c for c in packs.columns if c != "pack_id"])).alias("body")).write.mode("append").parquet(path)


def read_pack(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(pack_id, pack): packs as they were written, parsed by a schema."""
    return spark.read.parquet(path).select("pack_id", F.from_json("body", schema).alias("pack"))


def pack_items(packs: DataFrame, metadata: str = "metadata") -> DataFrame:
    """(pack_id, place, evidence_id, quoted_text, content_hash, page): evidence of packs (pack_id, pack) with
    what its map of metadata tells; keys that are missing are null."""
    each = packs.select("pack_id", F.posexplode("pack.evidence").alias("place", "e"))
    return each.select("pack_id", "place", "e.evidence_id", "e.quoted_text", F.element_at(f"e.{metadata}", "content_hash").alias("content_hash"), F.element_at(f"e.{metadata}", "page").cast("int").alias("page"))


def loaded_rows(packs: DataFrame, tables: dict[str, DataFrame], refs: dict[str, str]) -> dict[str, DataFrame]:
    """Of each table (kind -> rows with ``<kind>_id``) the rows that some pack's array of references names."""
    return {kind: rows.join(packs.select(F.explode(refs[kind]).alias(f"{kind}_id")).distinct(), f"{kind}_id", "left_semi") for kind, rows in tables.items()}


def proofs(evidence: DataFrame, pages: DataFrame, sources: DataFrame, most: int = 600) -> DataFrame:
    """(evidence_id, source_path, page, page_text): where each evidence (evidence_id, source_id, page) stands; the
    page's text is clipped."""
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    clipped = pages.select("source_id", "page", F.substring(text, 1, most).alias("page_text"))
    return evidence.join(sources.select("source_id", F.col("path").alias("source_path")), "source_id").join(clipped, ["source_id", "page"], "left").select("evidence_id", "source_path", "page", "page_text")


def wiki_by_source(wiki: DataFrame, source_ids: DataFrame) -> DataFrame:
    """Wiki pages (page_id, source_refs, ...) that refer to one of the sources."""
    hit = wiki.select("page_id", F.explode("source_refs").alias("source_id")).join(source_ids.distinct(), "source_id", "left_semi").select("page_id").distinct()
    return wiki.join(hit, "page_id", "left_semi")


def iso_time(seconds: Column) -> Column:
    """Unix seconds as an ISO time in UTC, whatever the session's time zone."""
    at = F.timestamp_seconds(seconds)
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
