"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against the
token windows of every training text.

Items are cut into windows of ``n`` words (an item of fewer words is one window). The windows of a benchmark
of at most ``MOST_BYTES`` of text are broadcast, hashes and words, and every hash hit is verified
against the words themselves. Of a larger benchmark only a bitmap of ``FILTER_BITS`` bits is broadcast;
document windows that it lets through are joined with the benchmark's windows on their words, so that
neither the driver nor a task holds the benchmark, and the texts are read twice whatever its size.
Contaminated documents are removed (``decontaminate``) or lose the passages found (``without_passages``).

Defined results: null texts have no words; an empty benchmark hits nothing, an empty table gives no rows; repeated
rows are scanned each on its own; repeated items count once by id; a null item id hits words but is listed
nowhere; a text of any length is one row of work; columns beside those named are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _text
from ._util import materialize, slices, small_batches, table, text_buffers

N = 10
MOST_BYTES = 2 << 20
FILTER_BITS = 26
#: Most rows of hits that are broadcast to the documents; more are joined.
BROADCAST_HITS = 200_000


def _word_lists(column: pa.Array) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    data, offsets = text_buffers(column)
    data = _text.LOWER[data]
    hashes, row, start, end = _text.words(data, offsets, _text.ALNUM_OR_WIDE)
    raw = data.tobytes()
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    for i in range(len(offsets) - 1):
        a, b = bounds[i], bounds[i + 1]
        yield i, hashes[a:b], [raw[s:e] for s, e in zip(start[a:b], end[a:b], strict=True)]


def item_windows(column: pa.Array, n: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(row, size, hash, words joined by spaces) of every window of the items."""
    for i, hashes, words in _word_lists(column):
        size = min(n, len(words))
        if size:
            first, got = _text.windows(hashes, np.zeros(len(hashes), np.int64), size)
            for k, h in zip(first.tolist(), got.tolist(), strict=True):
                yield i, size, h, b" ".join(words[k : k + size])


class Words:
    """The words of a piece of the texts, and its windows among given hashes."""

    def __init__(self, column: pa.Array):
        data, self.offsets = text_buffers(column)
        self.data = _text.LOWER[data]
        self.hashes, self.row, self.start, self.end = _text.words(self.data, self.offsets, _text.ALNUM_OR_WIDE)
        self.bounds = np.searchsorted(self.row, np.arange(len(self.offsets)))

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def windows(self, size: int, among) -> Iterator[tuple[int, int, int, bytes]]:
        """(row, first word, hash, words joined by spaces) of the windows whose hashes ``among`` marks."""
        first, got = _text.windows(self.hashes, self.row, size)
        for j in np.flatnonzero(among(got)).tolist():
            k = int(first[j])
            r = int(self.row[k])
            yield r, k - int(self.bounds[r]), int(got[j]), b" ".join(self.data[self.start[x] : self.end[x]].tobytes() for x in range(k, k + size))


class WindowSet:
    """Window hashes by window length, with the words and items of each hash for verification."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        found: dict[int, dict[int, dict[bytes, set[str]]]] = defaultdict(lambda: defaultdict(dict))
        for i, size, h, said in item_windows(pa.array([t for _, t in items], pa.string()), n):
            ids = found[size][h].setdefault(said, set())
            if items[i][0] is not None:
                ids.add(items[i][0])
        self.sizes = {size: (np.array(sorted(by), dtype=_text.U64), dict(by)) for size, by in found.items()}

    def scan(self, column: pa.Array) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """(number of words, hit word spans, items) of each row."""
        words = Words(column)
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items: dict[int, set[str]] = defaultdict(set)
        for size, (known, by) in self.sizes.items():
            for r, k, h, said in words.windows(size, lambda got: known[np.minimum(np.searchsorted(known, got), len(known) - 1)] == got):
                ids = by[h].get(said)
                if ids is not None:
                    spans[r].append((k, k + size))
                    items[r] |= ids
        return [(int(n), merged(spans.get(r, [])), sorted(items.get(r, ()))) for r, n in enumerate(words.counts())]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_SPANS_SQL = "array<struct<first:bigint,last:bigint>>"


def _with(named: DataFrame, extra: str, made) -> DataFrame:
    """The rows of ``named`` without ``scan_text``, with columns that ``made(piece)`` gives."""
    names = [c for c in named.columns if c != "scan_text"]
    schema = ", ".join([*(f"{c} {named.schema[c].dataType.simpleString()}" for c in names if c not in ("hit_spans", "hit_items")), extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "scan_text"):
                new = made(piece)
                old = [c for c in names if c not in ("hit_spans", "hit_items")]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in old), *new.values()], names=[*old, *new])

    return small_batches(named).mapInArrow(run, schema)


def _scan_broadcast(named: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    items = [(r["item"], r["text"]) for r in benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null").collect()]
    shared = named.sparkSession.sparkContext.broadcast(WindowSet(items, n))

    def made(piece: pa.RecordBatch) -> dict[str, pa.Array]:
        got = shared.value.scan(piece.column("scan_text"))
        spans = [[{"first": a, "last": b} for a, b in s] for _, s, _ in got]
        return {"n_words": pa.array([x[0] for x in got], pa.int64()), "spans": pa.array(spans, _SPANS), "items": pa.array([x[2] for x in got], pa.list_(pa.string()))}

    return _with(named, f"n_words bigint, spans {_SPANS_SQL}, items array<string>", made)


def _benchmark_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """(size, hash, words, items) of every distinct window of the benchmark."""
    kind = pa.schema([("item", pa.string()), ("size", pa.int32()), ("hash", pa.int64()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 1 << 16):
                ids = piece.column(0).to_pylist()
                rows = [(ids[i], size, int(np.uint64(h).astype(np.int64)), said) for i, size, h, said in item_windows(piece.column(1), n)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kind)], schema=kind)

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(run, "item string, size int, hash bigint, words binary")
    return rows.groupBy("size", "hash", "words").agg(F.collect_set("item").alias("items"))


def _scan_joined(named: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    known = materialize(_benchmark_windows(benchmark, n), "benchmark_windows")
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # at most n
    bit = F.col("hash").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = known.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toPandas()
    bitmap = np.zeros(1 << FILTER_BITS - 6, np.int64)
    bitmap[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    shared = named.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))
    # a text is known by two hashes: equal texts have equal hits
    keyed = named.withColumns({"text_key": F.xxhash64("scan_text"), "text_key2": F.xxhash64(F.lit("second"), "scan_text")})
    kind = pa.schema([("text_key", pa.int64()), ("text_key2", pa.int64()), ("size", pa.int32()), ("first", pa.int64()), ("hash", pa.int64()), ("words", pa.binary())])

    def may_hit(got: np.ndarray) -> np.ndarray:
        b = got & np.uint64((1 << FILTER_BITS) - 1)
        return (shared.value[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "scan_text"):
                one, two = (piece.column(c).to_pylist() for c in ("text_key", "text_key2"))
                texts = Words(piece.column("scan_text"))
                for size in sizes:
                    rows = [(one[r], two[r], size, k, int(np.uint64(h).astype(np.int64)), said) for r, k, h, said in texts.windows(size, may_hit)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(kind)], schema=kind)

    met = keyed.select("text_key", "text_key2", "scan_text").mapInArrow(run, "text_key bigint, text_key2 bigint, size int, first bigint, hash bigint, words binary")
    met = materialize(met, "window_candidates").distinct().join(known, ["size", "hash", "words"])
    key = ["text_key", "text_key2"]
    hits = met.groupBy(*key).agg(F.collect_set(F.struct("first", (F.col("first") + F.col("size")).alias("last"))).alias("hit_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("hit_items"))
    hits = materialize(hits, "window_hits")
    told = keyed.join(F.broadcast(hits) if hits.count() <= BROADCAST_HITS else hits, key, "left").drop(*key)

    def made(piece: pa.RecordBatch) -> dict[str, pa.Array]:
        spans = [[{"first": a, "last": b} for a, b in merged([(x["first"], x["last"]) for x in s or []])] for s in piece.column("hit_spans").to_pylist()]
        items = [s or [] for s in piece.column("hit_items").to_pylist()]
        return {"n_words": pa.array(Words(piece.column("scan_text")).counts(), pa.int64()), "spans": pa.array(spans, _SPANS), "items": pa.array(items, pa.list_(pa.string()))}

    return _with(told, f"n_words bigint, spans {_SPANS_SQL}, items array<string>", made)


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, most_bytes: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: the ``keep`` columns (default doc_id), ``n_words``, ``spans`` (hit word
    ranges, end exclusive, merged) and ``items``."""
    keep = keep or ["doc_id"]
    named = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").alias("scan_text"))
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    out = (_scan_broadcast if size <= (MOST_BYTES if most_bytes is None else most_bytes) else _scan_joined)(named, benchmark, n)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_words", "spans", "items")


def _scanned(docs: DataFrame, benchmark: DataFrame, n: int, most_bytes: int | None) -> tuple[DataFrame, list[str]]:
    plain = [f"c{i}" for i in range(len(docs.columns))]
    return scan(docs.toDF(*plain).withColumn("text", F.col(f"c{docs.columns.index('text')}")), benchmark, n, most_bytes, plain), plain


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, most_bytes: int | None = None) -> DataFrame:
    """Documents without those that hold a window of the benchmark; columns as before."""
    kept, plain = _scanned(docs, benchmark, n, most_bytes)
    return kept.where(F.size("spans") == 0).select(*[F.col(p).alias(c) for p, c in zip(plain, docs.columns, strict=True)])


def without_passages(docs: DataFrame, benchmark: DataFrame, n: int = N, most_bytes: int | None = None) -> DataFrame:
    """All documents, their texts without the passages found (from the first letter of a merged run of
    hit words to the last); columns as before."""
    found, plain = _scanned(docs, benchmark, n, most_bytes)
    own = plain[docs.columns.index("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(own)
            for piece in slices(batch, own):
                texts, said = Words(piece.column(at)), piece.column(at).to_pylist()
                for r, spans in enumerate(piece.column("spans").to_pylist()):
                    if spans:
                        raw, low = said[r].encode(), int(texts.offsets[r])
                        place = lambda k: int(texts.bounds[r]) + k  # noqa: B023, E731
                        cuts = [(int(texts.start[place(x["first"])]) - low, int(texts.end[place(x["last"] - 1)]) - low) for x in spans]
                        ends = [0, *(b for _, b in cuts)]
                        said[r] = b"".join(raw[a:b] for a, b in zip(ends, [*(a for a, _ in cuts), len(raw)], strict=True)).decode()
                columns = [pa.array(said, pa.string()) if i == at else c for i, c in enumerate(piece.columns[: len(plain)])]
                yield pa.RecordBatch.from_arrays(columns, names=plain)

    schema = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in plain)
    clean = found.where(F.size("spans") == 0).select(*plain).unionByName(found.where(F.size("spans") > 0).select(*plain, "spans").mapInArrow(run, schema))
    return clean.select(*[F.col(p).alias(c) for p, c in zip(plain, docs.columns, strict=True)])


def hit_report(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["last"] - x["first"])
    return scan(docs, benchmark, n).select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hit_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Plain SQL for the same rows: every document window joined with every item window of that size.
ORACLE_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM grams),
placed AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)),
hits AS (SELECT DISTINCT a.doc_id, a.i, a.size, g.item_id FROM placed a JOIN grams g ON a.size = g.size AND a.gram = g.gram),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS said FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
