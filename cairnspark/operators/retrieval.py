"""Lexical indexes and ranked retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..sources.storage import materialize

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Up to so many asked terms are broadcast, more are joined.
BROADCAST_TERMS = 500_000


def postings(docs: DataFrame, key: str, text: str, keep: list[str] | None = None) -> DataFrame:
    """(keep, key, term, tf): the inverted index of a text column; counts are combined on the map
    side, and a key's whole text is never gathered."""
    terms = docs.select(*(keep or []), key, F.explode(tx.tokens(F.col(text))).alias("term"))
    return terms.groupBy(*(keep or []), key, "term").agg(F.count("*").alias("tf"))


def term_frequencies(docs: DataFrame, text: str) -> DataFrame:
    """(term, n, docs): places of each term, and texts that hold it, in one aggregate by term."""
    words = docs.select(F.array_sort(tx.tokens(F.col(text))).alias("words"))
    # of a text's equal terms, which lie side by side, the first one counts for the text
    first = lambda w, i: F.when((i == 0) | (F.get("words", i - 1) != w), 1).otherwise(0)
    each = words.select(F.explode(F.transform("words", lambda w, i: F.struct(w.alias("term"), first(w, i).alias("first")))).alias("x")).select("x.*")
    return each.groupBy("term").agg(F.count("*").alias("n"), F.sum("first").alias("docs"))


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str) -> DataFrame:
    """(query_key, key, score) of documents holding every term of a query (``queries``: query_key,
    term). Statistics are those of the whole table; higher is better.

    Every text is cut into terms once. Only asked terms (semi-join with the term list, in the scan's own tasks up to
    ``BROADCAST_TERMS`` of them) and one row for each text, which carries its length under the empty term, leave the
    scan; they are written, since counts, lengths and totals are all read off them."""
    words = docs.select(key, tx.tokens(F.col(text)).alias("words")).select(key, F.size("words").alias("length"), F.explode(F.concat(F.array(F.lit("")), "words")).alias("term"))
    wanted = asked_terms(queries.select("term").union(docs.sparkSession.createDataFrame([("",)], "term string")))
    kept = words.join(wanted, "term", "left_semi").groupBy(key, "term", "length").agg(F.count("*").alias("tf"))
    kept = materialize(kept, "asked_postings")
    found, texts = kept.where("term <> ''"), kept.where("term = ''")
    told = texts.agg(F.sum("tf").alias("n"), (F.sum(F.col("length") * F.col("tf")) / F.sum("tf")).alias("avgdl"))
    return score_postings(found, told, queries, query_key, key)


def asked_terms(terms: DataFrame) -> DataFrame:
    """The distinct terms, broadcast if they are few enough."""
    wanted = materialize(terms.select("term").distinct(), "asked_terms")
    return F.broadcast(wanted) if wanted.count() <= BROADCAST_TERMS else wanted


def score_postings(found: DataFrame, told: DataFrame, queries: DataFrame, query_key: str, key: str) -> DataFrame:
    """Scores from the postings of asked terms (key, term, tf, length; written, as they are read thrice) and one row of totals (n, avgdl).

    A text that holds every term of a query holds its rarest one. Only texts that do are candidates, and only for these
    the other terms are looked up; a query with a term that no text holds has none."""
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    asked = materialize(queries.join(df, "term", "left").select(query_key, "term", F.coalesce("df", F.lit(0)).alias("df")), "asked_counts")
    rarest = asked.groupBy(query_key).agg(F.count("*").alias("need"), F.min(F.struct("df", "term")).alias("x")).where("x.df > 0").select(query_key, "need", F.col("x.term").alias("term"))
    # read back, so that Spark knows how small they are
    met = materialize(rarest.join(found.select("term", key), "term").select(query_key, "need", key).distinct(), "candidates")
    pairs = materialize(met.join(asked, query_key).select(query_key, "need", key, "term", "df"), "candidate_terms")
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avgdl")))
    scored = found.join(pairs, [key, "term"]).join(F.broadcast(told))  # one row of totals
    # parts are added from the smallest, so that texts of equal parts have equal scores, whatever order they come in
    sums = scored.groupBy(query_key, key, "need").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return sums.where(F.size("parts") == F.col("need")).select(query_key, key, F.aggregate("parts", F.lit(0.0), lambda a, x: a + x).alias("score"))


def query_terms(queries: DataFrame, key: str, text: str, most: int | None = None) -> DataFrame:
    terms = tx.search_terms(F.col(text))
    return queries.select(key, F.explode(F.slice(terms, 1, most) if most else terms).alias("term"))


def top(rows: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; with such a limit Spark cuts the groups before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def top_with_source_cap(rows: DataFrame, query_key: str, source: str, order: list[Column], per_source: int, k: int) -> DataFrame:
    capped = top(rows, [query_key, source], order, per_source, "source_rank")
    return top(capped, [query_key], order, k)


def combine_stages(stages: list[DataFrame], query_key: str, key: str) -> DataFrame:
    """Stage rows (query_key, key, stage, delta, fresh) into scores: a key enters with its first
    stage that may add rows (``fresh``); later stages add their delta to it."""
    rows = stages[0]
    for other in stages[1:]:
        rows = rows.unionByName(other)
    entry = F.min(F.when(F.col("fresh"), F.col("stage")))
    base = F.sum(F.col("delta"))
    return rows.groupBy(query_key, key).agg(base.alias("score"), entry.alias("entered")).where("entered is not null").select(query_key, key, "score", "entered")


def chunk_scores(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Import retrieval. ``chunks``: chunk_id, source_id, line, heading, text; ``queries``: query_id,
    text, identifier (array). 3 for the whole phrase, 5 for an identifier, 1 for another term, 0.5
    if a heading holds a matched term. Joined by term, so no pair without a common term is formed."""
    asked = queries.select("query_id", tx.normal_key(F.col("text")).alias("phrase"), "identifier", F.slice(F.filter(tx.tokens(F.col("text")), lambda t: F.length(t) >= 3), 1, 8).alias("terms"))
    terms = asked.select("query_id", F.explode(F.array_distinct("terms")).alias("term"), "identifier", "phrase")
    body = chunks.select("*", F.array_distinct(tx.tokens(F.concat_ws(" ", "heading", "text"))).alias("words"), tx.normal_key(F.col("text")).alias("said"))
    # ids and terms meet; texts are joined to the pairs that have met
    met = terms.select("query_id", "term").join(body.select("chunk_id", F.explode("words").alias("term")), "term").groupBy("query_id", "chunk_id").agg(F.collect_set("term").alias("held"))
    pairs = met.join(body.drop("words", "text"), "chunk_id").join(asked.drop("terms"), "query_id")
    weight = F.aggregate("held", F.lit(0.0), lambda a, t: a + F.when(F.array_contains("identifier", t), 5.0).otherwise(1.0))
    phrase = F.when(F.contains("said", "phrase"), 3.0).otherwise(0.0)
    heading = F.when(F.exists("held", lambda t: F.contains(F.lower("heading"), t)), 0.5).otherwise(0.0)
    return pairs.select("query_id", "chunk_id", "source_id", "line", (weight + phrase + heading).alias("score"))
