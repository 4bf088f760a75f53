"""Import jobs, uploads and parsing: what is done with files and with the state of their imports."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as tx
from .retrieval import top

#: Formats whose text can be read as it is; others need a parser of their own.
TEXT_FORMATS, MARKUP_FORMATS = ["md", "markdown", "txt"], ["html", "htm"]
LEASE_SECONDS, RECOVERY_BATCH, MOST_ATTEMPTS = 300, 16, 3


def file_format(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def route(path: Column) -> Column:
    """How a file is parsed: as text, as markup, or by a parser outside."""
    kind = file_format(path)
    return F.when(kind.isin(*TEXT_FORMATS), "text").when(kind.isin(*MARKUP_FORMATS), "markup").when(kind.isin("pdf", "docx", "doc", "png", "jpg", "jpeg"), "external").otherwise("unknown")


def parse_documents(files: DataFrame) -> DataFrame:
    """(path, route, status, text, warnings) of files (path, content): texts are normalised, markup is stripped of its
    tags; what needs another parser waits for it."""
    body = F.decode("content", "UTF-8")
    plain = F.regexp_replace(F.regexp_replace(body, "\r\n?", "\n"), r"\s+$", "")
    stripped = tx.trimmed(F.regexp_replace(F.regexp_replace(body, r"(?is)<(script|style)[^>]*>.*?</\1>|<[^>]*>", " "), r"\s+", " "))
    how = route(F.col("path"))
    text = F.when(how == "text", plain).when(how == "markup", stripped)
    status = F.when(how.isin("external", "unknown"), F.when(how == "external", "waiting").otherwise("failed")).when(F.length(text) == 0, "failed").otherwise("parsed")
    warnings = F.array_compact(F.array(F.when(how == "unknown", "unknown_format"), F.when(text.isNotNull() & (F.length(text) == 0), "no_text"), F.when(F.contains(text, F.lit("�")), "broken_encoding")))
    return files.select("path", how.alias("route"), status.alias("status"), F.coalesce(text, F.lit("")).alias("text"), warnings.alias("warnings"))


def parse_events(parsed: DataFrame) -> DataFrame:
    """(path, at, event): the steps of each file's parsing, as they are reported."""
    steps = F.when(F.col("status") == "parsed", tx.literals(["started", "page_parsed", "finished"])).when(F.col("status") == "waiting", tx.literals(["started", "handed_over"])).otherwise(tx.literals(["started", "failed"]))
    return parsed.select("path", F.posexplode(steps).alias("at", "event"))


def ingested(uploads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, blobs, jobs) of uploaded texts (workspace_id, title, text, at): a source for each unlike text of a
    workspace, the bytes by their hash, a queued job. The same text again is the same source."""
    hashed = uploads.withColumn("content_hash", F.sha2("text", 256)).withColumn("source_id", F.substring(F.sha2(F.concat_ws("|", "workspace_id", "content_hash"), 256), 1, 32))
    first = top(hashed, ["source_id"], [F.col("at"), F.col("title")], 1, "once")
    sources = first.select("source_id", "workspace_id", "title", "content_hash", F.lit("queued").alias("status"), "at")
    blobs = hashed.select(F.col("content_hash").alias("key"), F.col("text").cast("binary").alias("content")).dropDuplicates(["key"])
    jobs = first.select(F.concat(F.lit("job-"), "source_id").alias("job_id"), "source_id", F.lit("queued").alias("status"), F.lit(0).alias("attempts"), F.col("at").alias("available_at"))
    return sources, blobs, jobs


def graph_status(jobs: DataFrame, sources: DataFrame, status: str) -> DataFrame:
    """Jobs (job_id, source_id, status, graph_status) of which those of the sources get a graph status; failed ones keep theirs."""
    hit = sources.select("source_id").distinct().withColumn("hit", F.lit(True))
    new = F.when(F.col("hit") & (F.col("status") != "failed"), status).otherwise(F.col("graph_status"))
    return jobs.join(hit, "source_id", "left").select("job_id", "source_id", "status", new.alias("graph_status"))


def claimed(jobs: DataFrame, now: Column, worker: str, most: int = RECOVERY_BATCH) -> DataFrame:
    """The jobs (job_id, status, attempts, available_at, lease_until) that a worker takes next, with a lease: queued ones
    and those whose lease has run out, by the time they became available."""
    free = ((F.col("status") == "queued") & (F.col("available_at") <= now)) | ((F.col("status") == "processing") & (F.col("lease_until") < now))
    best = jobs.where(free & (F.col("attempts") < MOST_ATTEMPTS)).orderBy("available_at", "job_id").limit(most)
    return best.select("job_id", F.lit("processing").alias("status"), (F.col("attempts") + 1).alias("attempts"), "available_at", (now + LEASE_SECONDS).alias("lease_until"), F.lit(worker).alias("worker"))


def recovered(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs of which those with a lease that ran out are queued again, or failed after ``MOST_ATTEMPTS``."""
    late = (F.col("status") == "processing") & (F.col("lease_until") < now)
    status = F.when(late, F.when(F.col("attempts") >= MOST_ATTEMPTS, "failed").otherwise("queued")).otherwise(F.col("status"))
    return jobs.select("job_id", status.alias("status"), "attempts", "available_at", F.when(late, F.lit(None)).otherwise(F.col("lease_until")).cast("bigint").alias("lease_until"))


def finished(jobs: DataFrame, results: DataFrame, now: Column, wait: int = 30) -> DataFrame:
    """Jobs after the results (job_id, worker, ok, retry) of workers, which count only while their lease holds: done,
    queued again after a pause, or failed."""
    met = jobs.join(results.select("job_id", F.col("worker").alias("by"), "ok", "retry"), "job_id", "left")
    holds = (F.col("status") == "processing") & (F.col("worker") == F.col("by")) & (F.col("lease_until") >= now)
    status = F.when(~F.coalesce(holds, F.lit(False)), F.col("status")).when(F.col("ok"), "succeeded").when(F.col("retry") & (F.col("attempts") < MOST_ATTEMPTS), "queued").otherwise("failed")
    again = F.coalesce(holds, F.lit(False)) & ~F.col("ok") & F.col("retry") & (F.col("attempts") < MOST_ATTEMPTS)
    return met.select("job_id", status.alias("status"), "attempts", F.when(again, now + wait).otherwise(F.col("available_at")).alias("available_at"))


def recovery_loop(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], rounds: int, pause: float = 1.0, now: Callable[[], int] = lambda: int(time.time())) -> int:
    """Run ``recovered`` over the stored jobs ``rounds`` times; returns how many rounds changed something."""
    changed = 0
    for n in range(rounds):
        jobs = read()
        at = F.lit(now())
        if jobs.where((F.col("status") == "processing") & (F.col("lease_until") < at)).limit(1).count():
            write(recovered(jobs, at))
            changed += 1
        if n + 1 < rounds:
            time.sleep(pause)
    return changed


# proposals and trials
def approvals(proposals: DataFrame) -> DataFrame:
    """(proposal_id, kind, needs_approval, status) of proposed writes (proposal_id, kind, body): long wiki pages and graph
    changes wait for approval, others are committed."""
    long_ = (F.length("body") > 2000) | (F.size(F.split("body", "\n")) > 40)
    needs = F.col("kind").isin("wiki_page", "graph_change") & long_
    return proposals.select("proposal_id", "kind", needs.alias("needs_approval"), F.when(needs, "pending").otherwise("committed").alias("status"))


def commit_faults(proposals: DataFrame, commits: DataFrame) -> DataFrame:
    """(proposal_id, fault) of commits (proposal_id, base_version) that can't be made: unknown or already committed
    proposals (proposal_id, status, base_version, approved), unapproved ones, and those made for an older version."""
    met = commits.select("proposal_id", F.col("base_version").alias("at_version")).join(proposals, "proposal_id", "left")
    fault = F.when(F.col("status").isNull(), "unknown").when(F.col("status") == "committed", "already_committed").when((F.col("status") == "pending") & ~F.coalesce("approved", F.lit(False)), "not_approved").when(F.col("base_version") != F.col("at_version"), "stale_version")
    return met.select("proposal_id", fault.alias("fault")).where("fault is not null")


#: What the log of a trial must hold.
TRIAL_GATES = {"runs": 10, "cited": 5, "second_query": 3, "reuse": 10, "second_document": 1, "day_1": 1, "day_7": 1}


def trial_gates(runs: DataFrame, reuse: DataFrame) -> DataFrame:
    """(log_id, gate, value, passed) of trial logs: runs (log_id, milestones: array) and reuse events (log_id, same_set,
    day_offset), against the least numbers of ``TRIAL_GATES``."""
    has = lambda m: F.array_contains("milestones", F.lit(m))
    cited = has("source_refs") & has("page_refs") & has("evidence_refs")
    a = runs.groupBy("log_id").agg(F.count("*").alias("runs"), F.count_if(cited).alias("cited"), F.count_if(has("second_query")).alias("second_query"), F.count_if(has("second_document")).alias("second_document"))
    b = reuse.where("same_set").groupBy("log_id").agg(F.count("*").alias("reuse"), F.count_if(F.col("day_offset") == 1).alias("day_1"), F.count_if(F.col("day_offset") == 7).alias("day_7"))
    wide = a.join(b, "log_id", "left").fillna(0, ["reuse", "day_1", "day_7"])
    long_ = wide.unpivot(["log_id"], list(TRIAL_GATES), "gate", "value")
    least = F.create_map(*[F.lit(x) for kv in TRIAL_GATES.items() for x in kv])
    return long_.select("log_id", "gate", "value", (F.col("value") >= F.element_at(least, F.col("gate"))).alias("passed"))


def dispatchable(sources: DataFrame, jobs: DataFrame, states: list[str]) -> DataFrame:
    """Sources that have a job in one of the states, with it."""
    return sources.join(jobs.where(F.col("status").isin(*states)).select("source_id", "job_id", F.col("status").alias("job_status")), "source_id")


def with_jobs(sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """Sources with the newest job (source_id, job_id, status, at) of each, if there is one."""
    newest = top(jobs, ["source_id"], [F.desc("at"), F.desc("job_id")], 1, "n").select("source_id", "job_id", F.col("status").alias("job_status"))
    return sources.join(newest, "source_id", "left")
