"""Snapshots of several tables that become readable at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .storage import complete


class Snapshots:
    """Numbered snapshots below ``path``. All tables of one are written first; its marker, which lists them with their rows, comes
    last. Readers take the newest marker whose tables are all there, so half a snapshot is passed over."""

    MARKER = "name string, n_rows bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, tables: dict[str, DataFrame], mark: bool = True) -> int:
        taken = complete(self.spark, f"{self.path}/ready")
        number = max((int(n[1:]) for n in taken), default=0) + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/tables/v{number}/{name}")
        if mark:
            self.mark(number, [*tables])
        return number

    def mark(self, number: int, names: list[str]) -> None:
        counted = [self.spark.read.parquet(f"{self.path}/tables/v{number}/{n}").agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("name"), "n_rows") for n in names]
        rows = self.spark.createDataFrame([], self.MARKER)
        for one in counted:
            rows = rows.union(one)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ready/v{number}")

    def latest(self) -> int | None:
        """The newest snapshot whose marker and listed tables are whole."""
        for number in sorted((int(n[1:]) for n in complete(self.spark, f"{self.path}/ready")), reverse=True):
            listed = {r["name"] for r in self.marker(number).collect()}
            if listed <= set(complete(self.spark, f"{self.path}/tables/v{number}")):
                return number
        return None

    def marker(self, number: int) -> DataFrame:
        return self.spark.read.schema(self.MARKER).parquet(f"{self.path}/ready/v{number}")

    def read(self) -> dict[str, DataFrame]:
        """Table by name, of the latest whole snapshot; none if there is none."""
        number = self.latest()
        if number is None:
            return {}
        return {r["name"]: self.spark.read.parquet(f"{self.path}/tables/v{number}/{r['name']}") for r in self.marker(number).collect()}
