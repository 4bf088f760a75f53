"""A text index that outlives a query: segments of postings, and heads that tell which of them hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..sources.storage import complete, materialize
from .retrieval import asked_terms, score_postings

BUCKETS = 64


def _bucket(term: Column | str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _counted(texts: DataFrame) -> DataFrame:
    """(key, term, tf) of each row of ``texts`` (key, text), and its length as the tf of the empty term. Equal terms of a row, which
    lie side by side once they are sorted, are counted in their row."""
    words = texts.select("key", F.array_sort(tx.tokens(F.col("text"))).alias("words"))
    first = F.transform("words", lambda w, i: F.when((i == 0) | (F.get("words", i - 1) != w), i))
    runs = words.select("key", "words", F.filter(first, lambda i: i.isNotNull()).alias("starts"))
    end = lambda i: F.coalesce(F.get("starts", i + 1), F.size("words"))
    made = lambda term, tf: F.struct(term.alias("term"), tf.cast("bigint").alias("tf"))
    all_runs = F.transform("starts", lambda at, i: made(F.get("words", at), end(i) - at))
    return runs.select("key", F.explode(F.concat(F.array(made(F.lit(""), F.size("words"))), all_runs)).alias("x")).select("key", "x.*")


class TextIndex:
    """An inverted index below ``path``. Each change writes a segment: postings (key, term, tf), dealt by buckets
    of terms, and heads (key, live, length), a removed text being a head that isn't live. The newest head of a key holds, and
    only postings of its own segment, so nothing that was written is ever changed. A segment counts from
    the moment its heads are written, which is last; half of one is never seen.

    The length of a text stands among its postings, under the empty term; postings of a compaction tell it themselves.
    A search reads the buckets of its terms and the heads, no text. Rows of one key that come in one
    change are one text; null texts are empty; null keys are left out."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "bigint"):
        self.spark, self.path, self.kind = spark, path.rstrip("/"), kind

    def _segments(self) -> list[int]:
        """Those since the last compaction, which begins a list of its own."""
        found = sorted(int(n[1:]) for n in complete(self.spark, f"{self.path}/heads"))
        return [n for n in found if n >= max(self._compacted(), default=0)]

    def _compacted(self) -> list[int]:
        return sorted(int(n[1:]) for n in complete(self.spark, f"{self.path}/whole"))

    def _next(self) -> int:
        return max((int(n[1:]) for n in complete(self.spark, f"{self.path}/heads")), default=0) + 1

    def _write(self, postings: DataFrame | None, heads: DataFrame | None = None) -> int:
        """Each task deals its own postings to the buckets' folders, so that none is shuffled for it. Without ``heads`` these are read
        off the lengths among the postings that were written."""
        n = self._next()
        if postings is not None:
            path = f"{self.path}/postings/v{n}"
            postings.withColumn("bucket", _bucket()).write.mode("overwrite").partitionBy("bucket").parquet(path)
        if heads is None:
            heads = self.spark.read.schema(self._schema()).parquet(path).where((F.col("bucket") == _bucket(F.lit(""))) & (F.col("term") == ""))
            heads = heads.groupBy("key").agg(F.lit(True).alias("live"), F.sum("tf").alias("length"))
        heads.write.mode("overwrite").parquet(f"{self.path}/heads/v{n}")
        return n

    def _schema(self) -> str:
        return f"key {self.kind}, term string, tf bigint, length bigint, bucket int"

    def upsert(self, texts: DataFrame) -> None:
        """``texts``: key, text. A text replaces what its key had."""
        texts = texts.where("key is not null").select("key", "text")
        each = _counted(texts)
        # a text is counted within its row, only those of several rows meet
        twice = materialize(texts.groupBy("key").count().where("count > 1").select("key"), "keys_of_several_rows")
        if not twice.isEmpty():
            many = _counted(texts.join(twice, "key", "left_semi")).groupBy("key", "term").agg(F.sum("tf").alias("tf"))
            each = _counted(texts.join(twice, "key", "left_anti")).unionByName(many)
        self._write(each)

    def remove(self, keys: DataFrame) -> None:
        gone = self.heads().select("key").join(keys.select("key"), "key", "left_semi")
        self._write(None, gone.select("key", F.lit(False).alias("live"), F.lit(0).cast("bigint").alias("length")))

    def prune(self, keep: DataFrame) -> None:
        """Remove all texts whose keys aren't in ``keep``."""
        self.remove(self.heads().join(keep.select("key"), "key", "left_anti"))

    def _union(self, folder: str, schema: str) -> DataFrame:
        own = complete(self.spark, f"{self.path}/{folder}")
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{folder}/v{n}").withColumn("segment", F.lit(n)) for n in self._segments() if f"v{n}" in own]
        rows = self.spark.createDataFrame([], f"{schema}, segment int")
        for part in parts:
            rows = rows.unionByName(part)
        return rows

    def heads(self) -> DataFrame:
        """(key, segment, length) of the texts that hold."""
        newest = self._union("heads", f"key {self.kind}, live boolean, length bigint").groupBy("key").agg(F.max_by(F.struct("live", "length"), "segment").alias("x"), F.max("segment").alias("segment"))
        return newest.where("x.live").select("key", "segment", "x.length")

    def postings(self, terms: DataFrame | None = None, buckets: list[int] | None = None) -> DataFrame:
        """(key, term, tf, length, bucket) of the texts that hold; of ``terms`` in ``buckets`` only, if given, which are chosen before the heads are met."""
        rows = self._union("postings", self._schema()).where("term <> ''")
        if terms is not None:
            rows = rows.where(F.col("bucket").isin(buckets)).join(terms, "term", "left_semi")
        names = ["key", "term", "tf", "length", "bucket"]
        if self._segments() == self._compacted()[-1:]:
            return rows.select(*names)  # nothing has changed since: all hold, and tell their lengths
        # heads are one for a text, so a partition's are held in memory and postings needn't be sorted
        return rows.drop("length").join(self.heads().hint("shuffle_hash"), ["key", "segment"]).select(*names)

    def bm25(self, queries: DataFrame, query_key: str) -> DataFrame:
        """(query_key, key, score) of texts that hold every term of a query (``queries``: query_key, term)."""
        asked = asked_terms(queries)
        # at most BUCKETS numbers, which choose the folders that are read
        buckets = [r[0] for r in asked.select(_bucket()).distinct().collect()]
        found = materialize(self.postings(asked, buckets), "asked_postings")
        told = self.heads().agg(F.count("*").alias("n"), F.avg("length").alias("avgdl"))
        return score_postings(found, told, queries, query_key, "key")

    def compact(self) -> None:
        """Write what holds as one segment, which later readers begin with. The marker comes last: without it the old segments hold
        on, and the new one says the same as they do."""
        rows, heads = self.postings().select("key", "term", "tf", "length"), self.heads().select("key", F.lit(True).alias("live"), "length")
        n = self._write(rows, heads)
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/whole/v{n}")
