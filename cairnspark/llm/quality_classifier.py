"""Quality scores by random Fourier features over document statistics.

Statistics of each text (shares of character classes, repetition of words and lines, lengths) are
standardised and sent through ``FEATURES`` random cosines, which approximates a Gaussian kernel;
each partition sums its part of the normal equations, the driver solves the ridge system of that
fixed size, and scores are calibrated by isotonic regression on another fold of the sample.

The model is fitted on at most about ``SAMPLE`` labelled rows (of those that aren't held out); every
text is scored whole.

Defined results: null and empty texts have all-zero statistics and are scored like any other;
without labels every score is 0; with labels of one class every score is their mean; repeated rows
get equal scores; an empty table gives no rows; a text of any length is one row of work; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _text
from ._labels import held_out, labelled_sample
from ._util import slices, small_batches, table, text_buffers

SAMPLE = 20_000
FEATURES = 384
RIDGE = 1e-2
_PUNCT = [c for c in range(0x21, 0x7F) if not chr(c).isalnum()]
_CLASSES = [
    _text.class_table(lambda b: 0x41 <= b <= 0x5A),
    _text.class_table(lambda b: 0x61 <= b <= 0x7A),
    _text.class_table(lambda b: 0x30 <= b <= 0x39),
    _text.class_table(lambda b: b == 0x20),
    _text.class_table(lambda b: b == 0x0A),
    _text.class_table(lambda b: b in b".,;:?"),
    _text.class_table(lambda b: b == 0x21),
    _text.class_table(lambda b: b in _PUNCT and b not in b".,;:?!'\"-()"),
    _text.class_table(lambda b: b >= 0x80),
    _text.class_table(lambda b: b < 0x20 and b not in (0x0A, 0x09, 0x0D)),
    _text.class_table(lambda b: b in b"{}<>=/\\_"),
    _text.class_table(lambda b: b == 0x7C),
]
_CODES = np.full(256, len(_CLASSES), np.uint8)
for _i in reversed(range(len(_CLASSES))):
    _CODES[_CLASSES[_i]] = _i
_NOT_NEWLINE = _text.class_table(lambda b: b != 0x0A)
STATISTICS = len(_CLASSES) + 14


def _repeats(hashes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: number of items, of distinct items, and the count of the commonest one."""
    count = np.bincount(row, minlength=rows)
    distinct, top = np.zeros(rows), np.zeros(rows)
    ends = np.concatenate([[0], np.cumsum(count)])
    for i in np.flatnonzero(count).tolist():
        part = np.sort(hashes[ends[i] : ends[i + 1]])
        edge = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
        distinct[i], top[i] = len(edge) - 1, np.diff(edge).max()
    return count.astype(float), distinct, top


def statistics(column: pa.Array) -> np.ndarray:
    """A row of ``STATISTICS`` numbers for each text."""
    data, offsets = text_buffers(column)
    rows = len(offsets) - 1
    size = np.diff(offsets)
    codes = _CODES[data].astype(np.int64)
    row_of = np.repeat(np.arange(rows), size)
    by_class = np.bincount(row_of * (len(_CLASSES) + 1) + codes, minlength=rows * (len(_CLASSES) + 1)).reshape(rows, -1)[:, :-1]
    low = _text.LOWER[data]
    hashes, row, start, end = _text.words(low, offsets, _text.NOT_SPACE)
    n, distinct, top = _repeats(hashes, row, rows)
    length = (end - start).astype(float)
    total = np.bincount(row, length, rows)
    square = np.bincount(row, length**2, rows)
    short = np.bincount(row, length <= 3, rows)
    long_ = np.bincount(row, length > 20, rows)
    line_hash, line_row, line_start, line_end = _text.words(low, offsets, _NOT_NEWLINE)
    lines, line_distinct, line_top = _repeats(line_hash, line_row, rows)
    line_size = np.bincount(line_row, (line_end - line_start).astype(float), rows)
    first, pair = _text.windows(hashes, row, 2)
    pairs, pair_distinct, pair_top = _repeats(pair, row[first], rows)
    upper = np.bincount(row, (data[np.minimum(start, max(len(data) - 1, 0))] != low[np.minimum(start, max(len(data) - 1, 0))]) if len(data) else None, rows)
    some = lambda x: np.maximum(x, 1)
    mean = total / some(n)
    made = [
        np.log1p(size), np.log1p(n), np.log1p(lines), mean, np.sqrt(np.maximum(square / some(n) - mean**2, 0)),
        short / some(n), long_ / some(n), distinct / some(n), top / some(n), line_distinct / some(lines),
        line_top / some(lines), np.log1p(line_size / some(lines)), pair_distinct / some(pairs), upper / some(n),
    ]
    return np.column_stack([by_class / some(size)[:, None], *made])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.cos(z @ self.waves + self.phase) * np.sqrt(2 / len(self.phase)), z * 0.1, np.ones(len(z))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.steps)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a nondecreasing calibration from raw score to probability."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([b, 1.0, a])
        while len(pools) > 1 and (pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]):
            s, n, at = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2] + at]
    return np.array([p[2] / p[1] for p in pools]), np.array([(p[0] + 0.5) / (p[1] + 1) if 0 < p[0] / p[1] < 1 else p[0] / p[1] for p in pools])


def _sums(frame: DataFrame, column: str, made, parts: int = 8) -> list[np.ndarray]:
    """Sums over a bounded sample of what ``made(statistics, y)`` gives for each piece, as one array
    of a fixed size from each of ``parts`` partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for piece in slices(batch, column):
                y = piece.column(piece.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
                got = made(statistics(piece.column(piece.schema.get_field_index(column))), y)
                total = got if total is None else [a + b for a, b in zip(total, got, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[a.astype(float).tobytes() for a in total]], pa.list_(pa.binary()))], names=["sums"])

    rows = frame.coalesce(parts).mapInArrow(run, "sums array<binary>").collect()
    return [sum(np.frombuffer(x, float) for x in same) for same in zip(*[r["sums"] for r in rows], strict=True)] if rows else []


def _fold(frame: DataFrame, calibrate: bool) -> DataFrame:
    third = F.pmod(F.xxhash64(F.lit("fold"), F.coalesce("text", F.lit(""))), F.lit(3)) == 0
    return frame.where(third if calibrate else ~third)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, features: int = FEATURES, seed: int = 7) -> Model:
    """A model of ``labels.quality``; see the module's text for the method and its bounds."""
    sample = labelled_sample(docs, labels, "quality", most)
    flat = Model(np.zeros(STATISTICS), np.ones(STATISTICS), np.zeros((STATISTICS, 1)), np.zeros(1), np.zeros(STATISTICS + 2), (np.zeros(1), np.zeros(1)))
    told = sample.agg(F.count("y").alias("n"), F.coalesce(F.avg("y"), F.lit(0.0)).alias("mean")).first()
    if not 0 < told["mean"] < 1:
        flat.steps = (np.zeros(1), np.array([told["mean"]]))
        return flat
    count, total, square = _sums(sample, "text", lambda x, y: [np.array([len(x)]), x.sum(0), (x**2).sum(0)])
    mean = total / count
    scale = np.sqrt(np.maximum(square / count - mean**2, 0)) + 1e-6
    random = np.random.default_rng(seed)
    waves = random.normal(0, 0.35, (STATISTICS, features))
    model = Model(mean, scale, waves, random.uniform(0, 2 * np.pi, features), np.zeros(features + STATISTICS + 1), flat.steps)

    def normal(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        z = model.features(x)
        return [(z.T @ z).ravel(), z.T @ y]

    got = _sums(_fold(sample, False), "text", normal)
    if not got:
        flat.steps = (np.zeros(1), np.array([told["mean"]]))
        return flat
    a, b = got
    d = len(b)
    model.weights = np.linalg.solve(a.reshape(d, d) + RIDGE * np.eye(d), b)
    scored = _map_scores(_fold(sample, True), lambda x: model.raw(x), ["y"]).collect()
    raw, y = np.array([r["score"] for r in scored]), np.array([r["y"] for r in scored])
    model.steps = isotonic(raw, y) if len(raw) else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def _map_scores(docs: DataFrame, score, keep: list[str]) -> DataFrame:
    named = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], docs["text"].alias("scored_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "scored_text"):
                got = score(statistics(piece.column(len(keep))))
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(keep)], pa.array(got, pa.float64())], names=[*piece.schema.names[: len(keep)], "score"])

    schema = "".join(f"k{i} {named.schema[f'k{i}'].dataType.simpleString()}, " for i in range(len(keep)))
    return small_batches(named).mapInArrow(run, schema + "score double").withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def scores(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, **fit_options) -> DataFrame:
    """The ``keep`` columns (default doc_id) with ``score``, between 0 and 1."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **fit_options))
    return _map_scores(docs, lambda x: np.clip(model.value.score(x), 0, 1), keep or ["doc_id"])


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose score is ``least`` or more; columns as before."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("text", F.col(f"c{names.index('text')}")).withColumn("doc_id", F.col(f"c{names.index('doc_id')}"))
    got = scores(plain, labels, [f"c{i}" for i in range(len(names))])
    return got.where(F.col("score") >= least).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op7_quality_rff(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
