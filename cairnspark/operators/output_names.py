"""Names of outputs without clashes, and links of texts that follow them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.folds import running_total

_LINK = r"\]\(([^()\s]+)\)"


def clash_free(rows: DataFrame) -> DataFrame:
    """(id, name, output): a name of its own for every id of ``rows`` (id, name).

    The smallest id of a name keeps it. The others, in the order of their ids, take ``name-k`` with the smallest k from 2 on
    that nobody was called from the start. So made names clash neither with those nor with each other, as the last hyphen tells
    name and k apart. Null and empty names are ``untitled``; an id that comes with several names takes the smallest; null ids drop out.
    Ranks are counted in ranges, so one name may be that of any share of the rows."""
    named = rows.where("id is not null").select("id", F.coalesce(F.nullif("name", F.lit("")), F.lit("untitled")).alias("name")).groupBy("id").agg(F.min("name").alias("name"))
    ranked = running_total(named, ["name"], ["id"], F.lit(1)).withColumnRenamed("before", "rank")
    part = lambda i: F.regexp_extract("name", "(?s)^(.*)-([1-9][0-9]{0,17})$", i)
    taken = ranked.where("rank = 0").select(part(1).alias("base"), F.try_to_number(part(2), F.lit("9" * 18)).cast("bigint").alias("k")).where("k >= 2")
    taken = running_total(taken.withColumnRenamed("base", "name"), ["name"], ["k"], F.lit(1))
    # before the i-th taken k lie k - i - 1 free ones: it is passed by all ranks beyond that
    passed = taken.select("name", (F.col("k") - F.col("before") - 2).alias("at"), F.lit(1).alias("taken"), F.lit(None).cast(named.schema["id"].dataType).alias("id"))
    asked = ranked.select("name", F.col("rank").alias("at"), F.lit(0).alias("taken"), "id")
    met = running_total(passed.unionByName(asked), ["name"], ["at", "taken"], F.col("taken")).where("taken = 0")
    output = F.when(F.col("at") == 0, F.col("name")).otherwise(F.concat_ws("-", "name", F.col("at") + 1 + F.col("before")))
    return met.select("id", "name", output.alias("output"))


def rewrite_links(texts: DataFrame, outputs: DataFrame) -> DataFrame:
    """(text_id, text, n_links, n_rewritten): ``texts`` (text_id, text; ids differ) whose links ``[label](target)`` lead to the output of
    their target, as ``outputs`` (target, output; targets differ) tell. Links to anything else stay. A null text is an empty one.
    Only targets travel; a text meets its own list of them again by its id."""
    said = texts.select("text_id", F.coalesce("text", F.lit("")).alias("text"))
    links = said.select("text_id", F.posexplode(F.regexp_extract_all("text", F.lit(_LINK), F.lit(1))).alias("place", "target")).join(outputs.where("target is not null").select("target", "output"), "target", "left")
    own = links.groupBy("text_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", F.coalesce("output", "target").alias("to")))), lambda x: x["to"]).alias("to"), F.count("*").alias("n_links"), F.count("output").alias("n_rewritten"))
    woven = F.array_join(F.zip_with(F.split("text", _LINK, -1), "to", lambda piece, to: F.concat(piece, F.coalesce(F.concat(F.lit("]("), to, F.lit(")")), F.lit("")))), "")
    zero = F.lit(0).cast("bigint")
    return said.join(own, "text_id", "left").select("text_id", F.coalesce(woven, "text").alias("text"), F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_rewritten", zero).alias("n_rewritten"))
