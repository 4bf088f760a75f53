"""A rebuild in stages that goes on where it was stopped."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.storage import complete

Stage = tuple[str, Callable[..., DataFrame], list[str]]


def content(df: DataFrame) -> str:
    """A fingerprint of a table's rows in any order, repeated ones counted: one aggregate, one row."""
    h = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}))
    told = df.select(h.alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("sum"), F.bit_xor("h").alias("x")).first()
    return hashlib.sha256(f"{sorted(df.dtypes)}|{told['n']}|{told['sum']}|{told['x']}".encode()).hexdigest()


class Rebuild:
    """Runs ``stages`` (name, function, names of what it takes: inputs or earlier stages) below ``path``. The fingerprint of a stage
    is made of its name, its version and the fingerprints of what it takes; its rows are written to a folder of that name, which
    counts when it's whole. A stage whose folder is whole is read, not run; so a run that was stopped goes on after the last
    whole stage, and a change of one input runs again only what depends on it. ``ran`` names the stages that were run."""

    def __init__(self, spark: SparkSession, path: str, stages: list[Stage], version: str = "1"):
        self.spark, self.path, self.stages, self.version = spark, path.rstrip("/"), stages, version
        self.ran: list[str] = []

    def run(self, inputs: dict[str, DataFrame], until: str | None = None) -> dict[str, DataFrame]:
        tables, marks = dict(inputs), {name: content(df) for name, df in inputs.items()}
        for name, make, takes in self.stages:
            said = "|".join([name, self.version, *[f"{t}={marks[t]}" for t in takes]])
            marks[name] = hashlib.sha256(said.encode()).hexdigest()[:24]
            at = f"{self.path}/{name}"
            if marks[name] not in complete(self.spark, at):
                make(*[tables[t] for t in takes]).write.mode("overwrite").parquet(f"{at}/{marks[name]}")
                self.ran.append(name)
            tables[name] = self.spark.read.parquet(f"{at}/{marks[name]}")
            if name == until:
                break
        return tables
