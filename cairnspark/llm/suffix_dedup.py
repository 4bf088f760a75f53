"""Removal of repeated 100-byte strings by sorted, sampled suffixes.

The suffixes are sampled by content (the least hash in every window of ``LENGTH`` bytes), which
makes a cover in the sense of difference covers: two equal strings of ``LENGTH`` bytes hold samples
at equal offsets, so any two such suffixes can be compared from a common sampled one. Sampled
suffixes are named by their first ``GRAM`` bytes and, among suffixes of one name, by their
context: all the bytes of the strings whose sample they are. As order matters to a
depth of ``LENGTH`` bytes only, these names settle it and no recursion is needed. Suffixes of unique
names can't be repeated and go. Of equal contexts all but the earliest are repeated as a whole. The
remaining suffixes (all places whose sample has a shared name) are merged with them by name,
offset and prefix: sorted so, a suffix whose prefix equals that of the one before is repeated.

Defined results: a null text is empty; texts shorter than ``LENGTH`` keep every byte; rows with a
null id neither lose bytes nor count as earlier; repeated rows of one id and text count as one
document (none is earlier) and get equal results; rows of one id with unlike texts share the spans
found in any of them, cut to their length; an empty table gives no rows; a text of any length is one
row of work (about 20 bytes of memory for each of its bytes); other columns are ignored.

Equality: contexts and the prefixes of hot names are told by two independent 64-bit hashes, all other
prefixes by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _text
from ._util import materialize, release, slices, small_batches, table, text_buffers

LENGTH = 100
GRAM = 32
#: Names with more contexts than this are cut by ``CUTS`` ranges of offsets, each named by the bytes that its strings share; pieces of
#: names that still have more are compared as rows of a table, not in a task's memory.
HOT = 1_000
CUTS = 4
BROADCAST_IDS = 2_000_000
#: Up to so many spans (16 bytes each) are broadcast to the texts, more are joined.
BROADCAST_SPANS = 1_000_000
_BATCH = 10_000


def samples(column: pa.Array, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, place, left, right, name, context, twin) of the sampled suffixes of each text. The strings
    of ``length`` bytes whose sample is this place lie side by side: they begin ``left`` bytes before it
    at the earliest and end ``right`` bytes behind it at the latest, which is the context; ``context``
    and ``twin`` are two independent hashes of it."""
    data, offsets = text_buffers(column)
    n, reach = len(data), length - gram
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    lane = _text.lanes(data)
    at = np.arange(n, dtype=np.int64)
    key = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    whole = at[: n - gram + 1][at[: n - gram + 1] + gram <= row_end[: n - gram + 1]]
    # any order by the bytes alone will do for choosing; equality isn't decided here
    order = np.zeros(n - gram + 1, np.uint64)
    for k in [*range(0, gram - 8, 8), gram - 8]:
        order = (order ^ lane[k : k + n - gram + 1]) * np.uint64(0x9E3779B97F4A7C15)
        order ^= order >> np.uint64(29)
    key[whole] = order[whole] & np.uint64(0xFFFFFFFF00000000) | whole.astype(np.uint64)
    low, width = key, 1
    while 2 * width <= reach + 1:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    rest = reach + 1 - width
    if rest:
        low = np.minimum(low[: len(low) - rest], low[rest:])
    starts = at[: n - length + 1]
    starts = starts[starts + length <= row_end[: n - length + 1]]
    chosen = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]])) if len(chosen) else np.zeros(0, np.int64)
    place, first = chosen[edge], starts[edge]
    last = starts[np.concatenate([edge[1:], [len(chosen)]]) - 1] if len(edge) else first
    row = np.searchsorted(offsets[1:], place, side="right")
    left, right = place - first, last + length - place
    name = _text.span_hash(data, lane, place, place + gram)
    context, twin = (_text.mix(_text.span_hash(data, lane, place - left, place + right, k) + left.astype(np.uint64)) for k in (0, 1))
    return row, place - offsets[row], left, right, name.astype(np.int64), context.astype(np.int64), twin.astype(np.int64)


def _samples(docs: DataFrame, length: int, gram: int) -> DataFrame:
    kind = pa.schema([("name", pa.int64()), ("context", pa.int64()), ("twin", pa.int64()), ("doc", pa.int64()), ("place", pa.int64()), ("left", pa.int32()), ("right", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "bytes_of"):
                row, place, left, right, name, context, twin = samples(piece.column(1), length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(context), pa.array(twin), piece.column(0).take(pa.array(row)), pa.array(place), pa.array(left, pa.int32()), pa.array(right, pa.int32())], schema=kind)

    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc"), F.col("text").alias("bytes_of"))
    return small_batches(named).mapInArrow(run, "name bigint, context bigint, twin bigint, doc bigint, place bigint, left int, right int")


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the contexts in ``wanted`` (name, doc, place, left, right)."""
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("name", "place", "left", "right")).alias("asked"))
    ids = materialize(wanted.select("doc").distinct(), "asked_docs")
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc"), F.col("text").alias("bytes_of"))
    if ids.count() <= BROADCAST_IDS:
        named = named.join(F.broadcast(ids), "doc", "left_semi")
    kind = pa.schema([("name", pa.int64()), ("doc", pa.int64()), ("place", pa.int64()), ("left", pa.int32()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "bytes_of"):
                data, offsets = text_buffers(piece.column(1))
                rows = []
                for i, (doc, asked) in enumerate(zip(piece.column(0).to_pylist(), piece.column(2).to_pylist(), strict=True)):
                    own = data[offsets[i] : offsets[i + 1]].tobytes()
                    rows += [(x["name"], doc, x["place"], x["left"], own[x["place"] - x["left"] : x["place"] + x["right"]]) for x in asked if x["place"] + x["right"] <= len(own)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kind)], schema=kind)

    return named.join(lists, "doc").mapInArrow(run, "name bigint, doc bigint, place bigint, left int, bytes binary")


def _suffixes(part: pa.Table, length: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """(name, left, two hashes of the prefix, doc, place) of every suffix in the contexts that is long
    enough, and the lanes of its prefix (a row for each suffix)."""
    size = np.array([len(x) for x in part.column("bytes").to_pylist()], np.int64)
    data = np.frombuffer(b"".join(part.column("bytes").to_pylist()), np.uint8)
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    count = np.maximum(size - length + 1, 0)
    row = np.repeat(np.arange(len(size)), count)
    inner = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(count)])[:-1], count)
    start = begin[row] + inner
    lane = _text.lanes(data)
    prefix, twin = (_text.span_hash(data, lane, start, start + length, k).astype(np.int64) for k in (0, 1))
    get = lambda c: part.column(c).to_numpy()
    at = np.array([*range(0, length - 8, 8), length - 8])
    return (get("name")[row], get("left")[row].astype(np.int64) - inner, prefix, twin, get("doc")[row], get("place")[row]), lane[start[:, None] + at]


def _runs(doc: np.ndarray, start: np.ndarray, length: int) -> pa.RecordBatch:
    """Spans of bytes that the strings of ``length`` at these starts cover."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + length)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(doc)]]) - 1 if len(first) else first
    return pa.RecordBatch.from_arrays([pa.array(doc[first], pa.int64()), pa.array(start[first], pa.int64()), pa.array(start[last] + length, pa.int64())], names=["doc", "first", "last"])


def _merged_suffixes(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of suffixes whose prefix equals that of an earlier one; contexts of a name are in one
    partition, one after the other."""

    def repeated(rows: pa.Table) -> pa.RecordBatch:
        columns, said = _suffixes(rows, length)
        order = np.lexsort(columns[::-1])
        name, left, prefix, twin, doc, place = (x[order] for x in columns)
        same = (name[1:] == name[:-1]) & (left[1:] == left[:-1]) & (prefix[1:] == prefix[:-1]) & (twin[1:] == twin[:-1])
        # what the hashes call equal is compared byte by byte
        at = np.flatnonzero(same)
        same[at] = (said[order[at]] == said[order[at + 1]]).all(1)
        # a suffix and its own copy (a repeated row) aren't earlier than one another
        again = same & ((doc[1:] != doc[:-1]) | (place[1:] != place[:-1]))
        hit = np.zeros(len(name), bool)
        hit[1:] = again
        group = np.concatenate([[0], np.cumsum(~same)]) if len(name) else np.zeros(0, np.int64)
        hit = np.maximum.accumulate(np.where(hit, group, -1)) == group if len(name) else hit
        return _runs(doc[hit], place[hit] - left[hit], length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows >= _BATCH:
                names = held.column("name").to_numpy()
                cut = int(np.searchsorted(names, names[-1]))
                if cut:
                    yield repeated(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield repeated(held)

    return contexts.repartition("name").sortWithinPartitions("name").mapInArrow(run, "doc bigint, first bigint, last bigint")


def pieces(part: pa.Table, length: int, gram: int) -> pa.RecordBatch:
    """The contexts (name, doc, place, left, bytes) cut by ranges of offsets before the sample. All strings of a range
    share the bytes from its first offset to the end of its last string, at least three quarters of
    ``length`` with the defaults: equal strings meet under the name of these, and each is in one piece of its context."""
    name, left, said = part.column("name").to_numpy(), part.column("left").to_numpy().astype(np.int64), part.column("bytes").to_pylist()
    size = np.array([len(x) for x in said], np.int64)
    data = np.frombuffer(b"".join(said), np.uint8)
    sample = np.concatenate([[0], np.cumsum(size)])[:-1] + left
    right, lane, made = size - left, _text.lanes(data), []
    edges = [k * (length - gram + 1) // CUTS for k in range(CUTS + 1)]
    for low, high in ((a, b - 1) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b):
        row = np.flatnonzero((left >= low) & (right >= length - high) & (size >= length))
        core = _text.mix(_text.span_hash(data, lane, sample[row] - low, sample[row] + length - high) + name[row].astype(np.uint64) + np.uint64(low))
        own, end = np.minimum(left[row], high), np.minimum(right[row], length - low)
        kept = [data[a:b].tobytes() for a, b in zip(sample[row] - own, sample[row] + end, strict=True)]
        made.append([core.astype(np.int64), part.column("doc").to_numpy()[row], part.column("place").to_numpy()[row], own.astype(np.int32), kept])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    columns = [pa.array(np.concatenate([m[k] for m in made]) if k < 4 else [x for m in made for x in m[4]], kind) for k, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["name", "doc", "place", "left", "bytes"])


def _cut(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """Pieces of the contexts and how many have their name (``n``), without those of unique names, whose strings can't be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                yield pieces(pa.Table.from_batches([batch.slice(at, 4096)]), length, gram)

    made = materialize(small_batches(contexts).mapInArrow(run, "name bigint, doc bigint, place bigint, left int, bytes binary"), "pieces")
    return materialize(made.join(made.groupBy("name").agg(F.count("*").alias("n")).where("n > 1"), "name"), "open_pieces")


def _merged_hot(contexts: DataFrame, length: int) -> DataFrame:
    """The same for names with very many contexts: suffixes as rows, the earliest of each prefix by
    an aggregate that starts before the shuffle, and a join that Spark can split."""
    schema = "name bigint, left bigint, prefix bigint, twin bigint, doc bigint, place bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                got, _ = _suffixes(pa.Table.from_batches([batch.slice(at, 4096)]), length)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in got], names=["name", "left", "prefix", "twin", "doc", "place"])

    rows = materialize(small_batches(contexts).mapInArrow(run, schema), "hot_suffixes")
    keys = ["name", "left", "prefix", "twin"]
    first = rows.groupBy(*keys).agg(F.min(F.struct("doc", "place")).alias("earliest"))
    later = rows.join(first, keys).where(F.struct("doc", "place") > F.col("earliest"))
    return later.select("doc", (F.col("place") - F.col("left")).alias("first"), (F.col("place") - F.col("left") + length).alias("last"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, first, last): byte spans, overlapping or not, that together are all that is repeated."""
    spark = docs.sparkSession
    sampled = _samples(docs, length, gram)
    # written first: a join of two scans can be split where a name is on very many places
    shared = materialize(sampled.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"), "shared_names")
    sampled = materialize(sampled.join(shared, "name"), "shared_samples")
    release(spark)
    keys = ["name", "context", "twin"]
    first = materialize(sampled.groupBy(*keys).agg(F.min(F.struct("doc", "place", "left", "right")).alias("x")), "first_contexts")
    # the same holds for the copies of one context
    copies = sampled.join(first.select(*keys, F.col("x.doc").alias("doc0"), F.col("x.place").alias("place0")), keys).where("doc > doc0 or doc = doc0 and place > place0")
    spans = materialize(copies.select("doc", (F.col("place") - F.col("left")).alias("first"), (F.col("place") + F.col("right")).alias("last")), "copied_contexts")
    several = materialize(first.groupBy("name").agg(F.count("*").alias("n")).where("n > 1"), "several_contexts")
    wanted = materialize(first.join(several, "name").select("name", "n", "x.*"), "open_contexts")
    release(spark)
    contexts = materialize(_contexts(docs, wanted).join(several, "name"), "contexts")
    release(spark)
    cut = _cut(contexts.where(F.col("n") > HOT).drop("n"), length, gram)
    few = contexts.unionByName(cut).where(F.col("n") <= HOT).drop("n")
    return spans.unionByName(_merged_suffixes(few, length)).unionByName(_merged_hot(cut.where(F.col("n") > HOT).drop("n"), length))


def _merged_runs(spans: DataFrame) -> DataFrame:
    """(doc, spans): the spans of each document, in order, with those that overlap or touch made one."""
    lists = spans.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"))
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for own in batch.column(1).to_pylist():
                runs: list[dict[str, int]] = []
                for x in own:
                    if runs and x["first"] <= runs[-1]["last"]:
                        runs[-1]["last"] = max(runs[-1]["last"], x["last"])
                    else:
                        runs.append(x)
                made.append(runs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, kind)], names=["doc", "spans"])

    return lists.mapInArrow(run, "doc bigint, spans array<struct<first:bigint,last:bigint>>")


def _apply(docs: DataFrame, length: int, gram: int, schema: str, kind: pa.Schema, made) -> DataFrame:
    """``made(doc_id, bytes, merged spans)`` gives a row for each document."""
    spans = materialize(repeated_spans(docs, length, gram), "spans")
    release(docs.sparkSession)
    lists = materialize(_merged_runs(spans), "span_lists")
    few = lists.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0] <= BROADCAST_SPANS
    named = docs.select(F.col("doc_id"), F.col("doc_id").cast("bigint").alias("doc"), F.col("text").alias("bytes_of"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "bytes_of"):
                data, offsets = text_buffers(piece.column(1))
                rows = []
                for i, (doc, spans) in enumerate(zip(piece.column(0).to_pylist(), piece.column(2).to_pylist(), strict=True)):
                    own, runs = data[offsets[i] : offsets[i + 1]].tobytes(), []
                    for x in spans or []:
                        a, b = x["first"], min(x["last"], len(own))
                        if runs and a <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], b)
                        elif a < b:
                            runs.append([a, b])
                    rows.append(made(doc, own, runs))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kind)], schema=kind)

    joined = named.join(F.broadcast(lists) if few else lists, "doc", "left").select("doc_id", "bytes_of", "spans")
    return small_batches(joined).mapInArrow(run, schema)


def _kept(own: bytes, runs: list[list[int]]) -> bytes:
    at, out = 0, []
    for a, b in runs:
        out.append(own[at:a])
        at = b
    return b"".join([*out, own[at:]])


def report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def made(doc, own: bytes, runs):
        return doc, len(own), sum(b - a for a, b in runs), len(runs), hashlib.sha256(_kept(own, runs)).hexdigest()

    ids = docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return _apply(ids, length, gram, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", kind, made)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 200)) AS s, substr(h, 2 * i + 1, 200) AS said
      FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY said ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
edges AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) + 100 AS new FROM later),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edges) GROUP BY doc_id, r),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prior FROM runs),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS tail,
               string_agg(substr(h, 2 * prior + 1, 2 * (a - prior)), '' ORDER BY a) AS head FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
