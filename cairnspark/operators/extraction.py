"""Rule-based extraction from markdown: pages, concepts, claims, relations, signals, related wiki pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from .answers import search_tokens
from .retrieval import asked_terms, top

#: Most nodes, claims and relations of one source, concepts of one page, and related wiki pages.
MOST_NODES, MOST_CLAIMS, MOST_RELATIONS, MOST_CONCEPTS, MOST_RELATED = 24, 32, 32, 3, 8
#: Words that a concept's label doesn't begin with.
LEADING = ["a", "an", "and", "as", "for", "from", "in", "into", "of", "on", "or", "the", "this", "that", "to", "with"]
_NONE = "cast(array() as array<string>)"


def page_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page_index, page_label, content): a text cut at its page marks (``## Page 3``); what stands before the
    first goes, and a text without marks is one page."""
    parts = F.split(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), r"(?m)^## Page ", "\u0001"), "\u0001")
    whole = F.array(F.struct(F.lit("Imported text").alias("page_label"), F.get(parts, F.lit(0)).alias("content")))
    page = lambda p: F.struct(F.concat(F.lit("Page "), F.trim(F.substring_index(p, "\n", 1))).alias("page_label"), tx.trimmed(F.when(F.contains(p, F.lit("\n")), F.substring(p, F.instr(p, "\n") + 1, F.lit(2**31 - 1))).otherwise("")).alias("content"))
    pages = F.when(F.size(parts) > 1, F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), page)).otherwise(whole)
    return docs.select(key, F.posexplode(pages).alias("page_index", "p")).select(key, "page_index", "p.page_label", "p.content")


def candidate_line(line: Column) -> Column:
    """The first clause of a line that may name a concept, without marks of headings, lists and numbers; empty if it can't."""

    def unmarked(bare: Column) -> Column:
        marks = r"^#*-*\**[0-9.)]*"
        # no more of a long line is looked at than its marks and its first clause
        clause = tx.trimmed(F.regexp_replace(F.regexp_extract(bare, marks + r"[^.:;()\[\]]*", 0), marks, ""))
        skip = (bare == "") | F.rlike(bare, F.lit(r"^(!\[|_AI analysis unavailable|# |## Page )"))
        return F.when(skip, "").otherwise(F.regexp_extract(F.regexp_replace(clause, "[`*]", ""), r"^[^.:;()\[\]]*", 0))

    return tx.let(F.regexp_replace(line, r"(?U)^\s+", ""), unmarked)


def concept_label(clause: Column) -> Column:
    """Up to six words of a clause, without articles and the like in front; null if fewer than two are left or
    they are shorter than ten bytes."""
    strip = lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}/-]+|[^\p{L}\p{N}/-]+$", "")
    words = F.filter(F.transform(F.split(F.trim(clause), r"\s+"), strip), lambda w: w != "")

    def from_first(words: Column) -> Column:
        """The words from the first one on that may begin a label."""
        first = F.array_position(F.transform(words, lambda w: F.lower(w).isin(*LEADING)), F.lit(False))
        return tx.let(first, lambda at: F.when(at > 0, F.slice(words, F.greatest(at, F.lit(1)).cast("int"), F.size(words))).otherwise(F.expr(_NONE)))

    label = lambda rest: tx.let(F.array_join(F.slice(rest, 1, 6), " "), lambda said: F.when((F.size(rest) >= 2) & (F.octet_length(said) >= 10), said))
    return tx.let(tx.let(words, from_first), label)


def dashed_key(label: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def once_told(rows: DataFrame, keep: list[str], told: Column) -> DataFrame:
    """``keep`` and the fields of the struct ``told``, which is made once for each row: filters and columns that use
    the fields don't repeat its expression, as they do with a column of a projection."""
    return rows.select(*keep, F.explode(F.array(told)).alias("told")).select(*keep, "told.*")


def concepts(pages: DataFrame, key: list[str], text: str, most: int = MOST_CONCEPTS) -> DataFrame:
    """(key, rank, label, concept): the first unlike concepts that the lines of each text name."""
    lines = pages.select(*key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\r?\n")).alias("line_no", "line"))
    told = tx.let(concept_label(candidate_line(F.col("line"))), lambda label: F.struct(label.alias("label"), dashed_key(label).alias("concept")))
    named = once_told(lines, [*key, "line_no"], told).where("label is not null")
    once = top(named, [*key, "concept"], [F.col("line_no")], 1, "once")
    return top(once, key, [F.col("line_no")], most).select(*key, "rank", "label", "concept")


def claim_lines(docs: DataFrame, key: str, text: str, most: int = MOST_CLAIMS) -> DataFrame:
    """(key, rank, line_no, statement, claim_key, kind): the first unlike statements of each text: lines of three words
    or more that aren't headings, images or front matter."""
    lines = docs.select(key, F.split(F.coalesce(text, F.lit("")), "\r?\n").alias("lines"))
    close = F.array_position(F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1))), F.lit("---"))
    body = F.when((F.trim(F.get("lines", F.lit(0))) == "---") & (close > 0), close + 1).otherwise(F.lit(0))
    each = lines.select(key, body.alias("skip"), F.posexplode("lines").alias("line_no", "line")).where("line_no >= skip")
    bare = F.trim(F.regexp_replace(F.trim("line"), r"^([-*+]|[0-9]+[.)])\s+", ""))
    # three words or more: two runs of white space with something between them
    told = tx.let(bare, lambda said: F.when(F.rlike(said, F.lit(r"\s\S+\s")), F.struct(said.alias("statement"), F.substring(dashed_key(said), 1, 80).alias("claim_key"))))
    rows = once_told(each.where(~F.rlike(F.trim("line"), F.lit(r"^(#|!\[|$)"))), [key, "line_no"], told).where("claim_key <> ''")
    once = top(rows, [key, "claim_key"], [F.col("line_no")], 1, "once")
    kept = top(once, [key], [F.col("line_no")], most)
    return kept.select(key, "rank", (F.col("line_no") + 1).alias("line_no"), "statement", "claim_key", tx.claim_kind(F.col("statement")).alias("kind"))


def relation_lines(docs: DataFrame, key: str, text: str, names: DataFrame, most: int = MOST_RELATIONS) -> DataFrame:
    """(key, rank, src, dst, kind): relations that sentences with two known names (name) tell, by their cue words, in
    the order of their places; each once for a text."""
    parts = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"[.!?\n]")).alias("at", "sentence"))
    cued = tx.let(F.lower("sentence"), lambda low: F.struct(tx.relation_kind(low).alias("kind"), low.alias("low")))
    words = once_told(parts, [key, "at"], cued).where("kind is not null").select(key, "at", "kind", F.posexplode(F.split("low", "[^a-z0-9]+")).alias("place", "name"))
    held = words.join(asked_terms(names.select(F.col("name").alias("term"))).withColumnRenamed("term", "name"), "name").groupBy(key, "at", "kind").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("seen"))
    pairs = held.select(key, "at", "kind", F.col("seen")[0]["name"].alias("src"), F.get("seen", F.lit(1))["name"].alias("dst")).where("dst is not null and src <> dst")
    once = top(pairs, [key, "src", "dst", "kind"], [F.col("at")], 1, "once")
    return top(once, [key], [F.col("at"), F.col("src"), F.col("dst")], most).select(key, "rank", "src", "dst", "kind")


def keyword_weights(docs: DataFrame, key: str, title: Column, text: str, most_words: int = 16) -> DataFrame:
    """(key, term, weight): what a text is about: stems of its title weigh 8, of its headings 7 or 5, of its links 4 and 3,
    and its most frequent words what they are counted, up to four."""
    term = lambda df, weight: df.select(key, F.explode(search_tokens(F.col("said"))).alias("term"), F.lit(weight).alias("weight"))
    lines = docs.select(key, F.explode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line"))
    heads = lines.where(F.rlike("line", F.lit(r"^#{1,6}\s+\S"))).select(key, F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), F.regexp_replace("line", "^#+", "").alias("said"))
    links = docs.select(key, F.explode(F.arrays_zip(F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]\(([^)\s]+)\)"), F.lit(1)).alias("label"), F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]\(([^)\s]+)\)"), F.lit(2)).alias("target"))).alias("l"))
    words = docs.select(key, F.explode(F.filter(search_tokens(F.col(text)), lambda w: F.length(w) >= 4)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n")).where("n >= 2")
    often = top(words, [key], [F.desc("n"), F.col("term")], most_words).select(key, "term", F.least("n", F.lit(4)).cast("int").alias("weight"))
    parts = [term(docs.select(key, title.alias("said")), 8), term(heads.where("level = 1"), 7), term(heads.where("level > 1"), 5), term(links.select(key, F.col("l.label").alias("said")), 4), term(links.select(key, F.col("l.target").alias("said")), 3), often]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key, "term").agg(F.sum("weight").alias("weight"))


def related_pages(weights: DataFrame, key: str, wiki: DataFrame, most: int = MOST_RELATED) -> DataFrame:
    """(key, rank, page_id, score, matched): wiki pages (page_id, path, metadata, body) by the weighted terms they hold:
    eight times the weight for each place in the metadata, twice for each in the body, three for each term. Joined by term."""
    held = lambda c, n: wiki.select("page_id", F.explode(search_tokens(F.col(c))).alias("term")).groupBy("page_id", "term").agg(F.count("*").alias(n))
    counts = held("metadata", "m").join(held("body", "b"), ["page_id", "term"], "full_outer").fillna(0, ["m", "b"])
    met = weights.join(counts, "term").groupBy(key, "page_id").agg(F.sum(F.col("weight") * (F.col("m") * 8 + F.col("b") * 2) + 3).cast("bigint").alias("score"), F.count("*").alias("matched"))
    return top(met.join(wiki.select("page_id", "path"), "page_id"), [key], [F.desc("score"), F.col("path"), F.col("page_id")], most).select(key, "rank", "page_id", "score", "matched")


def artifact(docs: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """(key, concepts, claims, relations) as counts and lists of each text: what the rules find in it, capped each."""
    c = concepts(docs, [key], text, 20).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "concept"))), lambda x: x["concept"]).alias("concepts"))
    s = claim_lines(docs, key, text).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "claim_key"))), lambda x: x["claim_key"]).alias("claims"))
    r = relation_lines(docs, key, text, names).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(" ", "src", "kind", "dst").alias("said")))), lambda x: x["said"]).alias("relations"))
    out = docs.select(key).join(c, key, "left").join(s, key, "left").join(r, key, "left")
    return out.select(key, *[F.coalesce(n, F.expr(_NONE)).alias(n) for n in ("concepts", "claims", "relations")])


def capped(nodes: DataFrame, claims: DataFrame, relations: DataFrame, source: str, place: str) -> DataFrame:
    """(source, kind, id, rank): extracted records of each source up to the caps of their kind."""
    parts = [top(df, [source], [F.col(place), F.col("id")], most).select(source, F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "rank") for df, kind, most in ((nodes, "node", MOST_NODES), (claims, "claim", MOST_CLAIMS), (relations, "relation", MOST_RELATIONS))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
