"""Names in texts: which of many phrases stand where in which texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..sources.storage import materialize


def mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(text_id, name_id, at): every place (in words, from 0) of every name (name_id, name) in every text (text_id, text),
    whole words of the normal form, names that overlap or lie within each other included.

    A name meets texts by its rarest word alone; the words around that place decide. Only words that are the rarest of a
    name leave the scan, each with as many neighbours as the longest name has, so neither texts nor pairs of texts and names travel."""
    words = lambda c: F.filter(F.split(tx.normal_key(F.col(c)), " "), lambda w: w != "")
    phrases = materialize(names.select("name_id", words("name").alias("parts")).where(F.size("parts") > 0).distinct(), "phrases")
    said = texts.select("text_id", words("text").alias("words"))
    own = phrases.select("name_id", "parts", F.posexplode("parts").alias("offset", "word"))
    held = said.select(F.explode("words").alias("word")).join(own.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    # a name with a word that no text holds occurs nowhere, and drops out by the count
    rated = own.join(held, "word").groupBy("name_id", "parts").agg(F.min_by(F.struct("word", "offset"), F.struct("n", "offset")).alias("rare"), F.count("*").alias("known")).where(F.col("known") == F.size("parts"))
    anchors = materialize(rated.select("name_id", "parts", "rare.word", "rare.offset"), "anchors")
    longest = phrases.agg(F.max(F.size("parts"))).first()[0] or 1
    around = lambda p: F.slice("words", F.greatest(p - longest + 2, F.lit(1)), F.lit(2 * longest - 1) - F.greatest(longest - 1 - p, F.lit(0)))
    places = said.select("text_id", F.posexplode("words").alias("p", "word"), "words").join(anchors.select("word").distinct(), "word", "left_semi")
    near = places.select("text_id", "word", "p", around(F.col("p")).alias("near"))
    met = near.join(anchors, "word").withColumn("at", F.col("p") - F.col("offset")).where("at >= 0")
    first = F.col("at") - F.greatest(F.col("p") - longest + 1, F.lit(0))  # of the name, in what is near
    return met.where(F.slice("near", first + 1, F.size("parts")) == F.col("parts")).select("text_id", "name_id", "at")


def direct_links(nodes: DataFrame, others: DataFrame) -> DataFrame:
    """(l_id, r_id): nodes (id, name, text) of two sets one of which has its name in the other's text."""
    named = lambda a, b: mentions(b.select(F.col("id").alias("text_id"), "text"), a.select(F.col("id").alias("name_id"), "name"))
    there = named(nodes, others).select(F.col("name_id").alias("l_id"), F.col("text_id").alias("r_id"))
    back = named(others, nodes).select(F.col("text_id").alias("l_id"), F.col("name_id").alias("r_id"))
    return there.union(back).distinct()
