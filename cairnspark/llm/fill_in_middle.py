r"""Fill-in-the-middle transformation with relational units.

A text is cut into units (white space and the word behind it), whose lengths are exploded with their ordinals. A
window sums them up along each document; cut requests, two ordinals a document drawn from a hash of its id, are joined
with the sums, whose offsets are aggregated per document; ``substring`` then takes prefix, middle and suffix.
Only lengths travel, not texts; the offsets (one row for each text that is cut) are broadcast to the texts up to
``BROADCAST_ROWS`` and joined beyond.

Defined results: a null text is empty and plain; a null id is drawn as an empty one; an empty table gives no rows; repeated rows
are each kept, their units are counted once; rows of one id with unlike texts are cut apart (told by a 64-bit hash
within the id); cuts that meet leave an empty piece; a text of any length is one row of work; columns beside those named
are passed on by ``transform`` and never clash with those made on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ._util import materialize, table

UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BROADCAST_ROWS = 500_000


def _drawn(of: Column, seed: int, group: int) -> Column:
    """The ``group``-th (from 0) eight digits of the seeded hash of an id, as a number."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(of.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(said, 256), 8 * group + 1, 8), 16, 10).cast("bigint")


def _plain(text: Column) -> Column:
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    return (text == "") | marked


def _form(of: Column, text: Column, seed: int, rate: int, spm: int) -> Column:
    plain = _plain(text) | (_drawn(of, seed, 2) % 100 >= rate)
    return F.when(plain, "plain").when(_drawn(of, seed, 3) % 100 < spm, "spm").otherwise("psm")


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, id, text, of, hash): rows with the key of their text, which has no nulls, so that joins and windows on it share a
    partitioning."""
    text = F.coalesce(docs["text"], F.lit(""))
    kind = docs.schema["doc_id"].dataType
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    return docs.select(row, docs["doc_id"].alias("id"), text.alias("text"), F.coalesce(docs["doc_id"], F.lit(0).cast(kind)).alias("of"), F.xxhash64(text, docs["doc_id"].isNull()).alias("hash"))


def requests(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """(of, hash, low, high, sizes) of every row that is cut: the ordinals of its cuts and the lengths of its units."""
    own = _keyed(docs.select("doc_id", "text")).where(_form(F.col("id"), F.col("text"), seed, rate, spm) != "plain")
    sized = own.select("id", "of", "hash", F.transform(F.regexp_extract_all("text", F.lit(UNITS), F.lit(0)), F.length).alias("sizes"))
    cuts = [_drawn(F.col("id"), seed, k) % (F.size("sizes") + 1) for k in (0, 1)]
    return materialize(sized.select("of", "hash", F.least(*cuts).alias("low"), F.greatest(*cuts).alias("high"), "sizes"), "cut_requests")


def offsets(asked: DataFrame) -> DataFrame:
    """(of, hash, low_at, high_at): the places of the cuts in characters, for every text that is cut behind its first unit."""
    key = ["of", "hash"]
    units = asked.select(*key, "sizes").dropDuplicates(key).select(*key, F.posexplode("sizes").alias("unit", "size"))
    along = Window.partitionBy(*key).orderBy("unit").rowsBetween(Window.unboundedPreceding, 0)
    ends = units.select(*key, (F.col("unit") + 1).cast("bigint").alias("ordinal"), F.sum("size").over(along).alias("ends"))
    cuts = asked.groupBy(*key).agg(F.min("low").alias("low"), F.min("high").alias("high"))
    met = ends.join(cuts, key).where((F.col("ordinal") == F.col("low")) | (F.col("ordinal") == F.col("high")))
    at = lambda c: F.coalesce(F.max(F.when(F.col("ordinal") == F.col(c), F.col("ends"))), F.lit(0)).cast("bigint").alias(f"{c}_at")
    return met.groupBy(*key).agg(at("low"), at("high"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """(row, text, n, form, prefix_chars, middle_chars, output) of every row: ``row`` is a struct of all its
    columns; ``rate`` in 100 texts are rearranged, of these ``spm`` in 100 with the suffix first."""
    found = materialize(offsets(requests(docs, seed, rate, spm)), "cut_offsets").withColumnsRenamed({"of": "_of", "hash": "_hash"})
    met = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    joined = _keyed(docs).join(met, (F.col("of") == F.col("_of")) & (F.col("hash") == F.col("_hash")), "left")
    n, form = F.regexp_count("text", F.lit(UNITS)).cast("bigint"), _form(F.col("id"), F.col("text"), seed, rate, spm)
    whole = F.lit(2**31 - 1)
    # a text both of whose cuts stand before its first unit is in no offsets
    low, high = F.coalesce("low_at", F.lit(0)), F.coalesce("high_at", F.lit(0))
    out = joined.select("row", "text", n.alias("n"), form.alias("form"), low.cast("bigint").alias("low_at"), high.cast("bigint").alias("high_at"))
    text, piece = F.col("text"), F.substring
    prefix, middle, suffix = piece(text, F.lit(1), F.col("low_at").cast("int")), piece(text, (F.col("low_at") + 1).cast("int"), (F.col("high_at") - F.col("low_at")).cast("int")), piece(text, (F.col("high_at") + 1).cast("int"), whole)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm_ = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    cut = F.col("form") != "plain"
    made = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(text)
    return out.select("row", "text", "n", "form", F.when(cut, F.col("low_at")).alias("prefix_chars"), F.when(cut, F.col("high_at") - F.col("low_at")).alias("middle_chars"), made.alias("output"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, text, regexp_extract_all(text, '{UNITS}') AS u, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
             CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, text, len(u) AS n, length(array_to_string(u[1:least(h1 % (len(u) + 1), h2 % (len(u) + 1))], '')) AS a,
             length(array_to_string(u[1:greatest(h1 % (len(u) + 1), h2 % (len(u) + 1))], '')) AS b,
             CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || text[1:a] || '{SUFFIX}' || text[b + 1:] || '{MIDDLE}' || text[a + 1:b]
                          ELSE '{SUFFIX}' || text[b + 1:] || '{PREFIX}' || text[1:a] || '{MIDDLE}' || text[a + 1:b] END AS output FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM o
"""
