"""Evaluation: recall and coverage, baseline aggregates and comparisons, report checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LOWER_IS_BETTER = ("unsupported_rate", "answer_ms")


def compare(metric: Column, ours: Column, direct: Column) -> Column:
    """win, tie or loss: times tie within the larger of 5 % and 1 ms, other metrics within 0.0001."""
    slack = F.when(metric == "answer_ms", F.greatest(direct * 0.05, F.lit(1.0))).otherwise(0.0001)
    better = F.when(metric.isin(*LOWER_IS_BETTER), ours < direct).otherwise(ours > direct)
    return F.when(F.abs(ours - direct) <= slack, "tie").when(better, "win").otherwise("loss")


def baselines(runs: DataFrame) -> DataFrame:
    """(baseline, metric, value) of runs (baseline, correct, unsupported, answer_ms)."""
    means = runs.groupBy("baseline").agg(F.avg("correct").alias("correctness"), F.avg(F.col("unsupported").cast("double")).alias("unsupported_rate"), F.avg("answer_ms").alias("answer_ms"))
    return means.unpivot(["baseline"], ["correctness", "unsupported_rate", "answer_ms"], "metric", "value")


def outcomes(runs: DataFrame, ours: str, direct: str) -> DataFrame:
    values = baselines(runs)
    pick = lambda name, c: values.where(F.col("baseline") == name).select("metric", F.col("value").alias(c))
    met = pick(ours, "ours").join(pick(direct, "direct"), "metric")
    return met.select("metric", compare(F.col("metric"), F.col("ours"), F.col("direct")).alias("outcome"))


def report_errors(runs: DataFrame, documents: int = 2, tasks: int = 3, total: int = 24, kinds: int = 4) -> DataFrame:
    """(report, lacks): what each benchmark report (report, document, task, baseline, answer_ms, confidence) lacks: documents,
    tasks of each, runs, a baseline for every task, times and confidences that can be."""
    task = runs.groupBy("report", "document", "task").agg(F.countDistinct("baseline").alias("kinds"), F.count("*").alias("runs"), F.count_if(F.col("answer_ms") <= 0).alias("untimed"), F.count_if(~F.col("confidence").between(1, 5)).alias("odd"))
    per = task.groupBy("report", "document").agg(F.count("*").alias("tasks"), F.min("kinds").alias("kinds"), *[F.sum(c).alias(c) for c in ("runs", "untimed", "odd")])
    all_ = per.groupBy("report").agg(F.count("*").alias("documents"), F.min("tasks").alias("fewest"), F.min("kinds").alias("kinds"), *[F.sum(c).alias(c) for c in ("runs", "untimed", "odd")])
    flags = [(F.col("documents") < documents, "documents"), (F.col("fewest") < tasks, "tasks"), (F.col("runs") < total, "runs"), (F.col("kinds") < kinds, "baselines"), (F.col("untimed") > 0, "times"), (F.col("odd") > 0, "confidences")]
    return all_.select("report", F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in flags])).alias("lacks"))


def case_scores(cases: DataFrame, found: DataFrame) -> DataFrame:
    """(case_id, recall, precision, coverage, unsupported) of evaluation cases: expected evidence (case_id, evidence_id,
    claim_id) against what was found (case_id, evidence_id): the shares of evidence found and of findings that
    were expected, of claims with any evidence found, and the number of findings that support none."""
    want, got = cases.select("case_id", "evidence_id").distinct(), found.select("case_id", "evidence_id").distinct()
    both = want.withColumn("w", F.lit(1)).join(got.withColumn("g", F.lit(1)), ["case_id", "evidence_id"], "full_outer").groupBy("case_id").agg(F.count("w").alias("w"), F.count("g").alias("g"), F.count_if(F.col("w").isNotNull() & F.col("g").isNotNull()).alias("hit"))
    held = cases.join(got.withColumn("g", F.lit(1)), ["case_id", "evidence_id"], "left").groupBy("case_id", "claim_id").agg(F.max("g").alias("g")).groupBy("case_id").agg((F.count("g") / F.count("*")).alias("coverage"))
    return both.join(held, "case_id", "left").select("case_id", F.try_divide("hit", "w").alias("recall"), F.try_divide("hit", "g").alias("precision"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), (F.col("g") - F.col("hit")).alias("unsupported"))


def recall(expected: DataFrame, found: DataFrame, group: str, item: str) -> DataFrame:
    """Share of expected items that were found; null where nothing was expected."""
    hit = found.select(group, item).distinct().withColumn("hit", F.lit(1))
    return expected.select(group, item).distinct().join(hit, [group, item], "left").groupBy(group).agg(F.count("*").alias("expected"), F.count("hit").alias("found"), (F.count("hit") / F.count("*")).alias("recall"))
