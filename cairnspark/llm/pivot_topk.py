"""Exact top-k inner products by pivot-table elimination.

Every vector gets a row of distances to a fixed number of pivots. For a query q and a candidate x
the largest |d(q, p) - d(x, p)| over the pivots is a lower bound of their distance, which with the
two norms gives an upper bound of the inner product. Candidates are evaluated in the order of
their bounds until the k-th best score is above the next bound, so the result is exact.

Elimination starts before anything is shuffled. A query's k-th best score within a sample is a score
that its results must reach. Candidates are cut into blocks of about ``ROW_BLOCK`` vectors with the same
nearest pivot; the least and largest distances and the largest norm of a block bound the scores of all of it,
and a query is sent only to blocks whose bound reaches its score. Queries meet a block in parts of at
most ``QUERY_BLOCK``, and a block is copied only for parts with a query for it; no task sees more at
a time, and the k best of each block are merged at the end. Pivots are chosen farthest-first from the
sample of ``PIVOT_SAMPLE`` vectors; pivots and sample affect speed only.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do
rows without an id; an id that comes more than once counts once (with its smallest vector); vectors
of unlike lengths aren't compared; vectors without components score 0 with one another; an empty table
gives no rows; ties go to the smaller id; inner products must fit into a long; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ._util import materialize, table

PIVOTS = 16
PIVOT_SAMPLE = 1_000
ROW_BLOCK = 4_096
QUERY_BLOCK = 4_096
_CHUNK = 256


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): components as floor(256 * x), one row for each id."""
    usable = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")), F.lit(False)))
    v = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    return vectors.where(usable & finite).groupBy(F.col("vec_id").cast("bigint").alias("vec_id")).agg(F.min(v).alias("v"))


def pivots(rows: DataFrame, n: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each vector length in the sample: pivots, each the farthest from those before it, and ids
    and vectors of the sample."""
    got = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    out = {}
    for size in sorted({len(r["v"]) for r in got}):
        part = [r for r in got if len(r["v"]) == size]
        x = np.array([r["v"] for r in part], float).reshape(len(part), size)
        picked = [0]
        nearest = np.linalg.norm(x - x[0], axis=1)
        while len(picked) < min(n, len(x)):
            picked.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, np.linalg.norm(x - x[picked[-1]], axis=1))
        out[size] = x[picked], np.array([r["vec_id"] for r in part], np.int64), x
    return out


def measures(ids: np.ndarray, x: np.ndarray, query: np.ndarray, chosen: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distances to the pivots, norms, least score of each result) of vectors of one length. The least
    score is a little below the k-th best of the sample, to be safe from rounding."""
    p, sample_id, sample = chosen
    norm = (x**2).sum(1)
    d = np.sqrt(np.maximum(norm[:, None] + (p**2).sum(1) - 2 * x @ p.T, 0))
    least = np.full(len(x), -np.inf)
    if len(sample) > k and query.any():
        score = x[query] @ sample.T
        score[ids[query][:, None] == sample_id] = -np.inf
        kth = np.partition(score, len(sample) - k, axis=1)[:, len(sample) - k]
        least[query] = kth - 1e-6 * (1 + np.sqrt(norm[query] * (sample**2).sum(1).max()))
    return d, norm, least


def _measured(rows: DataFrame, k: int) -> DataFrame:
    """(vec_id, v, query, size, d, cell, norm, least) of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots(rows))
    kind = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy()
            query = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(at))
                if size in shared.value:
                    x = np.asarray(part.column(1).flatten(), float).reshape(len(at), size)
                    d, norm, least = measures(ids[at], x, query[at], shared.value[size], k)
                    cell = d.argmin(1)
                else:  # a length that isn't in the sample: no bounds
                    d, norm, least, cell = np.zeros((len(at), 0)), np.full(len(at), np.inf), np.full(len(at), -np.inf), np.full(len(at), -1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * d.shape[1], pa.int32()), pa.array(d.ravel(), pa.float64()))
                columns = [*part.columns, pa.array(np.full(len(at), size), pa.int32()), lists.cast(kind), pa.array(cell, pa.int32()), pa.array(norm, pa.float64()), pa.array(least, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "query", "size", "d", "cell", "norm", "least"])

    return rows.mapInArrow(run, "vec_id bigint, v array<bigint>, query boolean, size int, d array<double>, cell int, norm double, least double")


def _block(part: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = part.column("vec_id").to_numpy()
    x = np.asarray(part.column("v").combine_chunks().flatten(), np.int64).reshape(len(ids), size)
    flat = np.asarray(part.column("d").combine_chunks().flatten(), float)
    return ids, x, flat.reshape(len(ids), len(flat) // max(len(ids), 1))


def best_of_block(queries: pa.Table, rows: pa.Table, size: int, k: int) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of the k best rows of the block for each query, but for rows that
    can't reach the query's least score."""
    q_id, q, q_d = _block(queries, size)
    x_id, x, x_d = _block(rows, size)
    least = queries.column("least").to_numpy()
    exact = size * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) < 2**52
    q, x = (q.astype(float), x.astype(float)) if exact else (q, x)
    q_norm, x_norm = (q.astype(float) ** 2).sum(1), (x.astype(float) ** 2).sum(1)
    out = []
    for i in range(len(q)):
        apart = np.abs(x_d - q_d[i]).max(1, initial=0)
        norms = q_norm[i] + x_norm
        bound = (norms - np.square(np.maximum(apart - 1e-6 * (1 + np.sqrt(norms)), 0))) / 2 + 1e-6 * (1 + norms)
        live = np.flatnonzero((bound >= least[i]) & (x_id != q_id[i]))
        order = live[np.argsort(-bound[live], kind="stable")]
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(order), _CHUNK):
            if len(ids) >= k and scores[k - 1] > bound[order[at]]:
                break
            part = order[at : at + _CHUNK]
            ids = np.concatenate([ids, x_id[part]])
            scores = np.concatenate([scores, np.rint(x[part] @ q[i]).astype(np.int64) if exact else x[part] @ q[i]])
            top = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[top], scores[top]
        out += [(int(q_id[i]), a, b) for a, b in zip(ids.tolist(), scores.tolist(), strict=True)]
    return out


def _reachable(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Queries and the blocks whose bound reaches the least score of the query."""
    met = queries.join(blocks, ["size", "part"])
    gap = F.zip_with("d", F.zip_with("low", "high", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x, y: F.greatest(y["a"] - x, x - y["b"], F.lit(0.0)))
    norms = F.col("norm") + F.col("most")
    apart = F.greatest(F.aggregate(gap, F.lit(0.0), lambda a, b: F.greatest(a, b)) - F.lit(1e-6) * (1 + F.sqrt(norms)), F.lit(0.0))
    bound = (norms - apart * apart) / 2 + F.lit(1e-6) * (1 + norms)
    return met.where((F.size("d") == 0) | (bound >= F.col("least"))).select("size", "cell", "salt", "part", "vec_id", "v", "d", "least")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query with all other rows."""
    rows = quantised(vectors)
    rows = materialize(_measured(rows.withColumn("query", F.coalesce(is_query, F.lit(False))), k), "pivot_table")
    n_queries = rows.where("query").count()
    cells = rows.groupBy("size", "cell").agg(F.ceil(F.count("*") / ROW_BLOCK).cast("int").alias("salts"))
    placed = rows.join(cells, ["size", "cell"]).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int"))
    key = ["size", "cell", "salt"]
    ends = [f(F.get("d", F.lit(i))).alias(f"{n}{i}") for i in range(PIVOTS) for n, f in (("a", F.min), ("b", F.max))]
    blocks = placed.groupBy(*key).agg(F.max("norm").alias("most"), F.max(F.size("d")).alias("pivots"), *ends)
    side = lambda n: F.slice(F.array(*[f"{n}{i}" for i in range(PIVOTS)]), 1, F.col("pivots"))
    blocks = materialize(blocks.select(*key, "most", F.when(F.col("pivots") > 0, side("a")).alias("low"), F.when(F.col("pivots") > 0, side("b")).alias("high")), "blocks")
    parts = -(-n_queries // QUERY_BLOCK) or 1
    queries = rows.where("query").withColumn("part", F.pmod(F.xxhash64(F.lit("q"), "vec_id"), F.lit(parts)).cast("int")).drop("cell")
    met = materialize(_reachable(queries, blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))), "reached_blocks")
    wanted = met.select(*key, F.col("part").alias("for_part")).distinct()
    candidates = placed.select(*key, "vec_id", "v", "d").join(wanted, key)
    kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = best_of_block(left, right, key[0].as_py(), k) if left.num_rows and right.num_rows else []
        return pa.Table.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], schema=kind)

    best = met.groupBy(*key, "part").cogroup(candidates.groupBy(*key, "for_part")).applyInArrow(meet, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, min(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY 1),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""
