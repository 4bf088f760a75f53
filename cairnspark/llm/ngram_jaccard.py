"""Exact Jaccard join of documents on word shingles with adaptive multi-match prefixes.

Texts with equal shingle sets are one node (numbered in the order of their smallest ids, since an id may
come with unlike texts). Shingles are ordered from rare to frequent by a sketch
of their document frequencies (any order gives right results; this one gives few candidates). A
document's prefix is its first n - ceil(t n) + l shingles: two similar documents share at least
min(l, l') of their prefixes. Each document takes the l that minimises its estimated cost, postings
read plus verifications, of which a larger l asks fewer because more shingles must be shared.

Groups of copies never become all their pairs. First every posting links its members with the
one of the smallest id; the verified links give components. Only postings that still hold several components
are then compared, in blocks of bounded size, by parity bitmaps, which bound the overlap from
above; pairs that pass in enough postings are verified on the words of their texts. No similar pair is
lost: it is in one component already, or it meets in as many postings as its prefixes share.

Defined results: texts of fewer than ``width`` words are one shingle; null texts and texts without
words have an empty set and are linked with nothing; each row of a repeated id gets the result of
its own text, whose component is named by the smallest id reached; rows with a null id link nothing
and are their own (null) component; an empty table gives no rows; a text of any length is one row of
work; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.components import components
from . import _text
from ._util import materialize, release, slices, small_batches, table, text_buffers

WIDTH = 5
LEAST_PERCENT = 80
SKETCH_BITS = 20
MOST_MATCHES = 6
#: Cost of one verification against that of reading one posting entry.
VERIFY_COST = 8
BLOCK = 2_048
#: Postings up to this size give their pairs as rows.
SMALL = 16
#: Up to so many ids (16 MB) are broadcast to pick documents, more are joined.
BROADCAST_IDS = 2_000_000


def shingle_sets(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = text_buffers(column)
    words, row, _, _ = _text.words(_text.LOWER[data], offsets, _text.NOT_SPACE)
    first, hashes = _text.windows(words, row, width)
    rows = len(offsets) - 1
    ends = np.searchsorted(row[first], np.arange(rows + 1))
    cuts = np.searchsorted(row, np.arange(rows + 1))
    out = []
    for i in range(rows):
        n = cuts[i + 1] - cuts[i]
        if 0 < n < width:
            got = _text.windows(words[cuts[i] : cuts[i + 1]], np.zeros(n, np.int64), int(n))[1]
        else:
            got = np.sort(hashes[ends[i] : ends[i + 1]])
            got = got[np.concatenate([[True], got[1:] != got[:-1]])] if len(got) else got
        out.append(got)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, said, shingled_text): ``said`` tells unlike texts of one id apart."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("said"), F.col("text").alias("shingled_text"))


def _map_sets(keyed: DataFrame, fields: list[tuple[str, pa.DataType]], made, width: int) -> DataFrame:
    """The columns of ``keyed`` but its text, and those that ``made(shingle sets)`` gives for each piece."""
    names = [c for c in keyed.columns if c != "shingled_text"]
    schema = "".join(f"{c} {keyed.schema[c].dataType.simpleString()}, " for c in names) + ", ".join(f"{c} {_SQL[t]}" for c, t in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "shingled_text"):
                columns = made(shingle_sets(piece.column("shingled_text"), width))
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in names] + [pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[*names, *(c for c, _ in fields)])

    return small_batches(keyed).mapInArrow(run, schema)


_SQL = {pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary", pa.list_(pa.int64()): "array<bigint>"}


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, said, n_shingles, signature): equal sets have equal signatures (BLAKE2b, 128 bits)."""

    def made(sets):
        return [len(s) for s in sets], [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]

    return _map_sets(_keyed(docs), [("n_shingles", pa.int64()), ("signature", pa.binary())], made, width)


def frequency_sketch(docs: DataFrame, width: int = WIDTH, bits: int = SKETCH_BITS) -> np.ndarray:
    """Document frequencies of shingles added up by the low bits of their hash, over all documents:
    counts of a fixed number of buckets, summed in groups of at most 64 partial sums."""
    parts, chunk = 64, (1 << bits) // 64
    named = docs.select(F.col("text").alias("shingled_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint64)
        for batch in batches:
            for piece in slices(batch, "shingled_text"):
                for s in shingle_sets(piece.column(0), width):
                    np.add.at(total, (s & np.uint64((1 << bits) - 1)).astype(np.int64), np.uint64(1))
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([total[i * chunk : (i + 1) * chunk].astype(np.uint32).tobytes() for i in range(parts)], pa.binary())], names=["part", "counts"])

    def add(key, group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.uint32).astype(np.uint64) for x in group.column("counts").to_pylist())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    schema = "part int, counts binary"
    out = small_batches(named).mapInArrow(count, schema).withColumn("task", F.spark_partition_id())
    tasks = out.rdd.getNumPartitions()
    while True:
        out = out.withColumn("task", F.floor(F.col("task") / 64)).groupBy("part", "task").applyInArrow(lambda key, group: add(key, group).append_column("task", pa.array([key[1].as_py()], pa.int64())), schema + ", task bigint")
        tasks = -(-tasks // 64)
        if tasks <= 1:
            break
    got = {r["part"]: r["counts"] for r in out.collect()}
    return np.concatenate([np.frombuffer(got[i], np.uint32) if i in got else np.zeros(chunk, np.uint32) for i in range(parts)])


def matches_and_prefix(s: np.ndarray, sketch: np.ndarray, noise: float, percent: int = LEAST_PERCENT) -> tuple[int, np.ndarray]:
    """(l, prefix) of a set: the prefix in the common order, with the cheapest l."""
    count = sketch[(s & np.uint64(len(sketch) - 1)).astype(np.int64)].astype(np.uint64)
    order = np.argsort(np.minimum(count, 2**20 - 1) << np.uint64(44) | s >> np.uint64(20), kind="stable")
    needed = -(-percent * len(s) // 100)
    base = len(s) - needed
    most = max(1, min(MOST_MATCHES, needed))
    estimate = np.maximum(count[order[: base + most]].astype(float) - noise, 1)
    read = np.cumsum(estimate)[base:]
    cost = read + VERIFY_COST * read / np.arange(1, most + 1) * math.log2(len(s) + 2)
    matches = int(cost.argmin()) + 1
    return matches, s[order[: base + matches]]


def parity_bitmap(s: np.ndarray) -> bytes:
    """Parities of the set's hashes over about four bits each: two bitmaps differ in no more bits
    than their sets in elements, and a bitmap of twice the size folds into the smaller one."""
    bits = 1 << min(16, max(6, (4 * len(s) - 1).bit_length()))
    count = np.bincount((s >> np.uint64(40)).astype(np.int64) & (bits - 1), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()


def _with_node(keyed: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``keyed`` whose (doc_id, said) is in ``chosen`` (doc_id, said, node), with its ``node``."""
    return keyed.join(chosen, ["doc_id", "said"])


def _prefixes(docs: DataFrame, representative: DataFrame, sketch: np.ndarray, width: int, percent: int) -> DataFrame:
    """(node, n, matches, prefix, bitmap) of the representatives."""
    chosen = representative.select("doc_id", "said", "node")
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    noise = float(np.median(sketch)) + 3 * math.sqrt(float(np.median(sketch)))

    def made(sets):
        got = [matches_and_prefix(s, shared.value, noise, percent) if len(s) else (1, s) for s in sets]
        return [len(s) for s in sets], [m for m, _ in got], [p.view(np.int64).tolist() for _, p in got], [parity_bitmap(s) for s in sets]

    fields = [("n", pa.int64()), ("matches", pa.int32()), ("prefix", pa.list_(pa.int64())), ("bitmap", pa.binary())]
    keyed = _keyed(docs.where("doc_id is not null"))
    if chosen.count() <= BROADCAST_IDS:
        got = _map_sets(_with_node(keyed, F.broadcast(chosen)), fields, made, width)
    else:  # prefixes are shuffled, texts are not
        got = _with_node(_map_sets(keyed, fields, made, width), chosen)
    return got.select("node", "n", "matches", "prefix", "bitmap")


def _words_of(maps: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and bitmaps (as 64-bit words) by number of words."""
    by: dict[int, list[int]] = {}
    for i, m in enumerate(maps):
        by.setdefault(len(m) // 8, []).append(i)
    return {w: (np.array(rows), np.frombuffer(b"".join(maps[i] for i in rows), np.uint64).reshape(len(rows), w)) for w, rows in by.items()}


def _fold(x: np.ndarray, words: int) -> np.ndarray:
    while x.shape[-1] > words:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def may_link(n: np.ndarray, m: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes that differ in at least so many elements may be similar."""
    common = (n + m - differ) // 2
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (100 * common >= percent * (n + m - common))


def _compare(left: dict, right: dict, percent: int, within: bool) -> Iterator[tuple[int, int]]:
    """Node pairs of unlike components that may be similar, between two blocks or within one."""
    columns = {k: np.array(right[k]) for k in ("node", "component", "n")}
    stacks = _words_of(right["bitmap"])
    folded: dict[tuple[int, int], np.ndarray] = {}
    for i in range(len(left["node"])):
        own = np.frombuffer(left["bitmap"][i], np.uint64)
        for words, (rows, maps) in stacks.items():
            least = min(words, len(own))
            if max(words, len(own)) > 2 * least:
                continue
            if (words, least) not in folded:
                folded[words, least] = _fold(maps, least)
            live = rows[columns["component"][rows] != left["component"][i]]
            if within:
                live = live[live > i]
            if not len(live):
                continue
            at = np.searchsorted(rows, live)
            differ = np.bitwise_count(folded[words, least][at] ^ _fold(own, least)).sum(1, dtype=np.int64)
            for j in live[may_link(columns["n"][live], left["n"][i], differ, percent)].tolist():
                a, b = left["node"][i], int(columns["node"][j])
                if a != b:
                    yield min(a, b), max(a, b)


def similar(x: bytes, y: bytes, width: int, percent: int) -> bool:
    """Whether two texts link: the sets of their shingles are compared as words, by exact numbers."""
    x_words, y_words = x.lower().split(), y.lower().split()
    if min(len(x_words), len(y_words)) < width:
        return bool(x_words) and x_words == y_words
    ids: dict[bytes, int] = {}
    word = np.fromiter((ids.setdefault(w, len(ids)) for w in chain(x_words, y_words)), np.int64, len(x_words) + len(y_words))
    code = word
    for k in range(1, width):
        code = np.unique(code[:-1] * len(ids) + word[k:], return_inverse=True)[1]
    a, b = np.unique(code[: len(x_words) - width + 1]), np.unique(code[len(x_words) :])
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _verified(pairs: DataFrame, docs: DataFrame, representative: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar."""
    pairs = materialize(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = materialize(representative.join(ids, "node", "left_semi").select("doc_id", "said", "node", "repeated"), "pair_nodes")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    texts = _with_node(_keyed(docs.where("doc_id is not null")), wanted).select("node", "repeated", F.col("shingled_text").cast("binary").alias("x"))
    # only texts of rows that are there more than once are shuffled to keep one
    texts = texts.where("not repeated").unionByName(texts.where("repeated").dropDuplicates(["node"])).select("node", "x")
    texts = materialize(texts, "pair_texts")
    met = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(x.as_py(), y.as_py(), width, percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return materialize(small_batches(met).mapInArrow(run, "a bigint, b bigint").distinct(), "links")


def _fits(n: str, m: str, percent: int):
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _bitmap_filtered(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their bitmaps allow to be similar."""
    known = nodes.select("node", "n", "bitmap")
    met = pairs.join(known.toDF("a", "n", "x"), "a").join(known.toDF("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            differ = np.zeros(len(n), np.int64)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                least = min(len(x), len(y))
                if max(len(x), len(y)) <= 2 * least:
                    differ[i] = np.bitwise_count(_fold(x, least) ^ _fold(y, least)).sum()
            yield batch.filter(pa.array(may_link(n, m, differ, percent))).select([0, 1])

    return small_batches(met).mapInArrow(run, "a bigint, b bigint").distinct()


def _star_pairs(postings: DataFrame, hubs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Each posting's hub with its other nodes, if they meet like this often enough. What
    is missed here meets again in the comparison across components."""
    met = postings.join(hubs, "token").where((F.col("node") != F.col("hub")) & _fits("n", "hub_n", percent))
    often = met.groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("shared"), F.min(F.least("matches", "hub_matches")).alias("wanted"))
    return _bitmap_filtered(often.where("shared >= wanted").select("a", "b"), nodes, percent)


def _cross_pairs(postings: DataFrame, nodes: DataFrame, linked: DataFrame, percent: int) -> DataFrame:
    """Pairs of unlike components that share as many postings as their prefixes ask for, and whose
    bitmaps allow them. Small postings give their pairs in a join; large ones are compared in blocks
    with their bitmaps at once."""
    labelled = postings.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = labelled.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low <> high")
    open_ = materialize(labelled.join(several.select("token", "size"), "token"), "open_postings")
    small = open_.where(F.col("size") <= SMALL).select("token", "node", "component", "n", "matches")
    left, right = small.toDF("token", "a", "ca", "na", "ma"), small.toDF("token", "b", "cb", "nb", "mb")
    near = left.join(right, "token").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _fits("na", "nb", percent))
    met = near.select("a", "b", F.least("ma", "mb").alias("wanted"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = open_.where(F.col("size") > SMALL).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", "n", "matches")
    dealt = dealt.join(nodes.select("node", "bitmap"), "node")

    def meet(key, group):
        i, j = key[1].as_py(), key[2].as_py()
        columns = {c: group.column(c).to_pylist() for c in ("own", "node", "component", "n", "bitmap", "matches")}
        part = lambda block: {c: [v for v, o in zip(columns[c], columns["own"], strict=True) if o == block] for c in ("node", "component", "n", "bitmap")}
        wanted = dict(zip(columns["node"], columns["matches"], strict=True))
        found = [*_compare(part(i), part(j), percent, i == j)]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64()), "wanted": pa.array([min(wanted[a], wanted[b]) for a, b in found], pa.int32())})

    met = met.unionByName(dealt.groupBy("token", "i", "j").applyInArrow(meet, "a bigint, b bigint, wanted int"))
    often = met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("wanted").alias("wanted")).where("shared >= wanted")
    return _bitmap_filtered(often.select("a", "b"), nodes, percent)


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, said, n_shingles, component, component_id, n_joined) of every row: ``component`` tells
    groups apart (null: linked with nothing), ``component_id`` is its smallest id."""
    signed = materialize(signatures(docs, width), "signatures")
    same = ["n_shingles", "signature"]
    full = signed.where("n_shingles > 0 and doc_id is not null")
    once = full.groupBy("doc_id", "said").agg(F.count("*").alias("rows"))
    first = full.groupBy(*same).agg(F.min("doc_id").alias("doc_id"), F.min_by("said", "doc_id").alias("said"))
    often = once.where("rows > 1").select("doc_id", "said", F.lit(True).alias("repeated"))
    first = first.join(often, ["doc_id", "said"], "left").withColumn("repeated", F.coalesce("repeated", F.lit(False)))
    representative = materialize(first.orderBy("doc_id", "said").withColumn("node", F.monotonically_increasing_id()), "representatives")
    nodes = materialize(_prefixes(docs, representative, frequency_sketch(docs, width), width, percent), "nodes")
    entries = nodes.select(F.explode("prefix").alias("token"), "node", "n", "matches")
    # near copies resemble their original, which mostly has the smallest id, more than one another
    hubs = entries.groupBy("token").agg(F.min("node").alias("hub"), F.min_by("n", "node").alias("hub_n"), F.min_by("matches", "node").alias("hub_matches"), F.count("*").alias("size"))
    hubs = materialize(hubs.where("size > 1").drop("size"), "hubs")
    release(docs.sparkSession)
    postings = materialize(entries.join(hubs.select("token"), "token", "left_semi"), "postings")
    release(docs.sparkSession)
    stars = _verified(_star_pairs(postings, hubs, nodes, percent), docs, representative, width, percent)
    cross = _verified(_cross_pairs(postings, nodes, components(stars), percent), docs, representative, width, percent)
    links = stars.union(cross)
    degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("n_joined"))
    named = representative.join(components(links), "node", "left").join(degree, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialize(named.select(*same, "doc_id", "component", F.coalesce("n_joined", F.lit(0)).alias("n_joined")), "named_nodes")
    # the smallest node of a component is that of its smallest id
    least = representative.select(F.col("node").alias("component"), F.col("doc_id").alias("component_id"))
    out = full.join(named.drop("doc_id").join(least, "component"), same)
    columns = ["doc_id", "said", "n_shingles", "component", "component_id", "n_joined"]
    rest = signed.where("n_shingles = 0 or doc_id is null").withColumns({"component": F.lit(None).cast("bigint"), "component_id": F.col("doc_id"), "n_joined": F.lit(0).cast("bigint")})
    return out.select(*columns).unionByName(rest.select(*columns))


def similarity_components(docs: DataFrame, width: int = WIDTH, percent: int = LEAST_PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_joined) of every row; ids are cast to long. ``n_joined`` is the
    number of verified links by which this row's text was joined to its component: enough of them to
    hold it together, not all that exist within it."""
    return _grouped(docs, width, percent).select("doc_id", "n_shingles", "component_id", "n_joined")


def deduplicated(docs: DataFrame, width: int = WIDTH, percent: int = LEAST_PERCENT) -> DataFrame:
    """One document of each group, the one with the smallest id (of unlike texts of that id, the one
    with the smallest hash; of repeated rows, one); rows that can't link (with a null id, or without
    words) all stay, but for repeated rows of one id and text. Columns as before."""
    rows = _grouped(docs, width, percent).where("doc_id is not null").groupBy("doc_id", "said").agg(F.count("*").alias("n"), F.max("component").alias("component"))
    first = rows.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "said", "n")).alias("x")).select("x.*")
    kept = first.unionByName(rows.where("component is null").drop("component"))
    kept = materialize(kept.toDF("kept_id", "kept_hash", "kept_rows"), "kept")
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text, doc_id = F.col(f"c{names.index('text')}"), F.col(f"c{names.index('doc_id')}").cast("bigint")
    met = plain.join(F.broadcast(kept) if kept.count() <= BROADCAST_IDS else kept, (doc_id == F.col("kept_id")) & (F.xxhash64(text) == F.col("kept_hash")))
    # only rows that are there more than once are shuffled to drop all but one
    once = met.where("kept_rows = 1").unionByName(met.where("kept_rows > 1").dropDuplicates(["kept_id", "kept_hash"]))
    columns = [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    return once.select(*columns).unionByName(plain.where(doc_id.isNull()).select(*columns))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM w LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""
