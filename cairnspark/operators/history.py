"""Versions: closing and opening validity, as-of reads, replay of event logs, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def versions(rows: DataFrame, key: list[str], at: str, content: list[str]) -> DataFrame:
    """Version rows of a change log: a row whose content equals the one before is no version; each
    version ends where the next one begins."""
    w = Window.partitionBy(*key).orderBy(at, *content)
    mark = F.xxhash64(*content)
    changed = rows.withColumn("mark", mark).withColumn("same", F.lag("mark").over(w).eqNullSafe(F.col("mark")) & (F.row_number().over(w) > 1)).where(~F.col("same"))
    w = Window.partitionBy(*key).orderBy(at, *content)
    return changed.select(*key, *content, F.col(at).alias("valid_from"), F.lead(at).over(w).alias("valid_to"), F.row_number().over(w).alias("version"))


def live(rows: DataFrame) -> DataFrame:
    return rows.where("valid_to is null")


def as_of(rows: DataFrame, at: Column) -> DataFrame:
    return rows.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def merge(current: DataFrame, incoming: DataFrame, key: list[str], content: list[str], at: Column, by: Column) -> DataFrame:
    """One step of history: ``current`` has key, content, valid_from, valid_to, superseded_by;
    ``incoming`` key and content. Live rows that are absent or changed are closed, new and changed
    ones are appended, equal ones stay; closed rows are carried on."""
    mark = lambda df: df.withColumn("mark", F.xxhash64(*content))
    now = mark(live(current)).alias("a")
    new = mark(incoming.select(*key, *content)).alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    both = now.join(new, on, "full_outer").select(F.col("a.mark").alias("ma"), F.col("b.mark").alias("mb"), *[F.col(f"a.{c}").alias(f"a_{c}") for c in [*key, *content, "valid_from"]], *[F.col(f"b.{c}").alias(f"b_{c}") for c in [*key, *content]])
    keep = F.col("ma").eqNullSafe(F.col("mb"))
    old = both.where(F.col("ma").isNotNull()).select(*[F.col(f"a_{c}").alias(c) for c in [*key, *content, "valid_from"]], F.when(~keep, at).alias("valid_to"), F.when(~keep, by).alias("superseded_by"))
    fresh = both.where(F.col("mb").isNotNull() & ~keep).select(*[F.col(f"b_{c}").alias(c) for c in [*key, *content]], at.alias("valid_from"), F.lit(None).cast(current.schema["valid_to"].dataType).alias("valid_to"), F.lit(None).cast("string").alias("superseded_by"))
    return current.where("valid_to is not null").unionByName(old).unionByName(fresh)


def not_monotonic(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows (with valid_from) that don't come after the live row of their key."""
    return incoming.alias("n").join(live(current).alias("c"), key).where("n.valid_from <= c.valid_from").select("n.*")


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*[o.desc() for o in order])
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def replay(events: DataFrame, scope: list[str], key: str, order: list[Column], content: str, until: Column | None = None) -> DataFrame:
    """State that an event log leads to. Each event (``scope``, order) carries the whole state of its
    scope as rows (key, content); a key absent from an event is closed by it.

    Expressed over change points: per key the events that hold it are numbered within all events of
    the scope; a gap in the numbers, or other content, begins a new version."""
    rows = events if until is None else events.where(until)
    steps = rows.select(*scope, *[o.alias(f"o{i}") for i, o in enumerate(order)]).distinct()
    names = [f"o{i}" for i in range(len(order))]
    w = Window.partitionBy(*scope).orderBy(*names)
    steps = steps.withColumn("step", F.row_number().over(w))
    final = steps.groupBy(*scope).agg(F.max("step").alias("final"))
    keyed = rows.select("*", *[o.alias(f"o{i}") for i, o in enumerate(order)]).join(steps, [*scope, *names])
    k = Window.partitionBy(*scope, key).orderBy("step")
    new = (F.col("step") - F.lag("step").over(k) != 1) | ~F.col(content).eqNullSafe(F.lag(content).over(k)) | F.lag("step").over(k).isNull()
    grouped = keyed.withColumn("run", F.sum(F.when(new, 1).otherwise(0)).over(k)).groupBy(*scope, key, "run").agg(F.min_by(content, "step").alias(content), F.min("step").alias("from_step"), F.max("step").alias("to_step"))
    return grouped.join(final, scope).select(*scope, key, content, "from_step", F.when(F.col("to_step") < F.col("final"), F.col("to_step") + 1).alias("closed_step"))


def overlay(base: DataFrame, changes: DataFrame, key: list[str], scope: list[str]) -> DataFrame:
    """Rows of ``base`` and of later runs: changes win over the base by key, and base rows of a
    changed scope that the changes don't hold are gone."""
    scopes = changes.select(*scope).distinct()
    return base.join(scopes, scope, "left_anti").unionByName(changes.select(*base.columns))


def checkpoint(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """Counts by kind and a checksum that doesn't depend on the order of rows: the sum of the first 60 bits of
    each row's MD5, its columns written as text."""
    said = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns])
    bits = F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(*kinds).agg(F.count("*").alias("n"), F.sum(bits).cast("string").alias("checksum"))
