"""Secret scans through a trigram inverted index, in DataFrame expressions only.

For every rule a Boolean query over trigrams is derived from its regular expression: what any
match must contain. The postings of just those trigrams are built from all texts, each rule's
query is evaluated by intersecting and uniting postings, and its expression runs over the
candidates alone. Rules without mandatory trigrams run over every text. Only keys of candidates travel:
they are few, and are broadcast to the texts up to ``BROADCAST_KEYS``, beyond which they are joined.

Defined results: a null text is empty; an empty table gives no rows; repeated rows (also of one doc_id) are
each scanned; null ids are kept; a text of any length is one row of work, in time that grows with its length
and matches; columns beside those named are passed on or ignored. The added rules bound their own matches
(a login in an address has up to 64 and 200 characters, the name in a key's header 40); base kinds are unbounded.
"""

from __future__ import annotations

import re._constants as sre
from dataclasses import dataclass
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ._util import materialize, table

Clauses = list[frozenset[str]]


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches (Java and RE2 syntax alike); those whose ``group`` is shorter than
    ``least`` characters are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules come first. Runs of one character class may state their least length in the
#: pattern: no shorter run can hold a longer one. That isn't so for ``assign``.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{4,}"),
    Rule("url_login", r"[a-z]{2,20}://[^\s:/@]{1,64}:[^\s/@]{3,200}@"),
)
BASE = 3
_MOST_STRINGS = 64
BROADCAST_KEYS = 500_000
#: Matches that are numbered in one go; blocks of them are numbered apart, so that no array is copied for each.
_BLOCK = 256


def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _both(a: Clauses | None, b: Clauses | None) -> Clauses | None:
    if a is None or b is None:
        return b if a is None else a
    return [x | y for x in a for y in b]


def _exact(items) -> set[str] | None:
    """The strings that a parsed piece matches, lower-cased, if they are few."""
    found = {""}
    for op, value in items:
        more = _exact_item(op, value)
        if more is None or len(found) * len(more) > _MOST_STRINGS:
            return None
        found = {a + b for a in found for b in more}
    return found


def _exact_item(op, value) -> set[str] | None:
    if op is sre.LITERAL:
        return {chr(value).lower()}
    if op is sre.IN and all(o is sre.LITERAL for o, _ in value) and len(value) <= 4:
        return {chr(v).lower() for _, v in value}
    if op is sre.SUBPATTERN:
        return _exact(value[3])
    if op is sre.BRANCH:
        parts = [_exact(x) for x in value[1]]
        return None if None in parts else set().union(*parts)
    if op is sre.MAX_REPEAT and value[1] <= 5:
        one = _exact(value[2])
        if one is not None and len(one) == 1:
            s = next(iter(one))
            return {s * n for n in range(value[0], value[1] + 1)}
    return None


def _query(items) -> Clauses | None:
    """Alternatives of trigram sets, one of which every match contains; None: no condition."""
    out: Clauses | None = None
    run = {""}

    def close() -> None:
        nonlocal out, run
        if all(len(s) >= 3 for s in run):
            out = _both(out, [_trigrams(s) for s in sorted(run)])
        run = {""}

    for op, value in items:
        more = _exact_item(op, value)
        if more is not None and len(run) * len(more) <= _MOST_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        close()
        if more is not None:
            run = more
        elif op is sre.SUBPATTERN:
            out = _both(out, _query(value[3]))
        elif op is sre.BRANCH:
            parts = [_query(x) for x in value[1]]
            out = _both(out, None if None in parts else [c for p in parts for c in p])
        elif op is sre.MAX_REPEAT and value[0] > 0:
            out = _both(out, _query(value[2]))
    close()
    return out


def trigram_query(pattern: str) -> Clauses | None:
    """The Boolean trigram query of an expression, in disjunctive form, over lower-cased text."""
    found = _query(_parser.parse(pattern))
    return None if found is None else sorted({*found}, key=sorted)


def _key(text: Column, key: Column) -> Column:
    return F.struct(key.alias("id"), F.xxhash64(text).alias("h"))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index of ``trigrams``: (trigram, key) for each text holding it."""
    low = docs.select(_key(F.col("text"), F.col("doc_id")).alias("key"), F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("key", F.explode(held).alias("trigram")).distinct()


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, rules): texts whose postings satisfy the trigram query of the named rules."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    trigrams = sorted({t for q in queries.values() for clause in q for t in clause})
    held = postings(docs, trigrams).groupBy("key").agg(F.collect_set("trigram").alias("held"))

    def holds(clauses: Clauses) -> Column:
        tests = [F.size(F.array_except(F.array(*map(F.lit, sorted(c))), "held")) == 0 for c in clauses]
        out = tests[0]
        for x in tests[1:]:
            out = out | x
        return out

    named = F.array_compact(F.array(*[F.when(holds(q), F.lit(kind)) for kind, q in queries.items()]))
    return held.select("key", named.alias("rules")).where(F.size("rules") > 0)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, which a lambda's own variable is, whatever is in the body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine, zero: int) -> Column:
    """For each number of an array what ``combine`` makes of those before it, beginning with ``zero``."""
    zero_ = F.lit(zero).cast("bigint")
    none = F.expr("cast(array() as array<bigint>)")

    def scan_(numbers: Column, first: Column) -> Column:
        start = F.struct(first.alias("now"), none.alias("out"))
        step = lambda s, x: F.struct(combine(s["now"], x).cast("bigint").alias("now"), F.array_append(s["out"], s["now"]).alias("out"))
        return F.aggregate(numbers, start, step, lambda s: s["out"])

    def whole(v: Column) -> Column:
        block = lambda b: F.slice(v, b * _BLOCK + 1, _BLOCK)
        blocks = F.sequence(F.lit(0), F.ceil(F.size(v) / _BLOCK).cast("int") - 1)
        begins = scan_(F.transform(blocks, lambda b: F.aggregate(block(b), zero_, lambda s, x: combine(s, x).cast("bigint"))), zero_)
        return F.when(F.size(v) > 0, F.flatten(F.transform(begins, lambda first, b: scan_(block(b), first)))).otherwise(none)

    return _let(values, whole)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end, kind): pieces between matches give the places of the matches."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    said = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    empty = F.expr("cast(array() as array<struct<start:bigint,ord:int,end:bigint,kind:string>>)")
    zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("before"), whole.alias("whole"), said.alias("said"))
    sized = F.transform(F.filter(zipped, lambda x: x["whole"].isNotNull()), lambda x: F.struct(F.length(x["before"]).cast("bigint").alias("gap"), F.length(x["whole"]).cast("bigint").alias("size"), (F.length(x["said"]) >= rule.least).alias("kept")))
    place = lambda x: F.struct((x["b"] + x["x"]["gap"]).alias("start"), F.lit(order).alias("ord"), (x["b"] + x["x"]["gap"] + x["x"]["size"]).alias("end"), F.lit(rule.kind).alias("kind"))

    def placed(v: Column) -> Column:
        ends = running(F.transform(v, lambda x: x["gap"] + x["size"]), lambda a, x: a + x, 0)
        return F.transform(F.filter(F.arrays_zip(v.alias("x"), ends.alias("b")), lambda x: x["x"]["kept"]), place)

    return F.when(F.rlike(text, F.lit(rule.pattern)), _let(sized, placed)).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, text, row, secret_spans) of every row: ``row`` is a struct of all its columns, the
    spans are an array of (start, ord, end, kind), sorted; places in code points, end exclusive."""
    own = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = materialize(candidates(own, rules).select(F.col("key.id").alias("cand_id"), F.col("key.h").alias("cand_hash"), F.col("rules").alias("cand_rules")), "candidates")
    joined = own.join(F.broadcast(found) if found.count() <= BROADCAST_KEYS else found, (F.xxhash64("text") == F.col("cand_hash")) & F.col("cand_id").eqNullSafe(F.col("doc_id")), "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.expr("cast(array() as array<struct<start:bigint,ord:int,end:bigint,kind:string>>)")
    each = []
    for i, rule in enumerate(rules):
        spans = _spans(text, rule, i)
        each.append(spans if trigram_query(rule.pattern) is None else F.when(F.array_contains("cand_rules", F.lit(rule.kind)), spans).otherwise(none))
    return joined.select("doc_id", "text", "row", F.array_sort(F.concat(*each)).alias("secret_spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sign: str = "[REDACTED]") -> DataFrame:
    """Documents with every span replaced by ``sign`` (overlapping spans by one) and ``n_chars``
    following; other columns as before."""
    def cut(chars: Column, spans: Column) -> Column:
        ends = running(F.transform(spans, lambda x: x["end"]), lambda a, x: F.greatest(a, x), 0)
        gap = lambda a, b: F.array_join(F.slice(chars, a.cast("int") + 1, F.greatest(b - a, F.lit(0)).cast("int")), "")
        piece = lambda x: F.when((x["x"]["start"] < x["seen"]) & (x["seen"] > 0), "").otherwise(F.concat(gap(x["seen"], x["x"]["start"]), F.lit(sign)))
        pieces = F.transform(F.arrays_zip(spans.alias("x"), ends.alias("seen")), piece)
        return F.concat(F.array_join(pieces, ""), gap(F.array_max(F.transform(spans, lambda x: x["end"])), F.size(chars).cast("bigint")))

    # the text as an array of its characters, of which the gaps between runs of spans are taken
    done = _let(F.split("text", ""), lambda chars: cut(chars, F.col("secret_spans")))
    hit = F.size("secret_spans") > 0
    out = scan(docs, rules).withColumn("new_text", F.when(hit, done).otherwise(F.col("text")))
    new = {"text": F.col("new_text"), "n_chars": F.when(hit, F.length("new_text").cast("bigint")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    spans = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return scan(docs.select("doc_id", "text"), rules).select(
        "doc_id",
        *[count(r.kind) for r in rules[:BASE]],
        F.sha2(_said(F.filter(spans, lambda x: x["ord"] < BASE)), 256).alias("base_sha256"),
        _said(spans).alias("spans"),
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    plain = [
        (r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        (r"AKIA[A-Z0-9]+", 0, 18),
        (r"[0-9a-f]+", 0, 16),
        *[(r.pattern.replace("'", "''"), 0, 1) for r in RULES[BASE:]],
    ]
    parts = " UNION ALL ".join(
        f"""SELECT doc_id, {i} AS ord, '{RULES[i].kind}' AS kind, unnest(range(1, len(m) + 1)) AS k, unnest(m) AS s, unnest(g) AS g, unnest(p[1:len(m)]) AS p
  FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {g}) AS g, string_split_regex(text, '{p}') AS p FROM t)"""
        for i, (p, g, _) in enumerate(plain)
    )
    least = " ".join(f"WHEN {i} THEN {n}" for i, (_, _, n) in enumerate(plain))
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
parts AS ({parts}),
placed AS (
  SELECT doc_id, ord, kind, s, g, sum(length(p) + length(s)) OVER (PARTITION BY doc_id, ord ORDER BY k) AS e FROM parts),
spans AS (
  SELECT doc_id, ord, kind, e - length(s) AS b, kind || ':' || CAST(e - length(s) AS BIGINT) || ':' || CAST(e AS BIGINT) AS said
  FROM placed WHERE length(g) >= CASE ord {least} END)
SELECT t.doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
       sha256(coalesce(string_agg(said, ',' ORDER BY b, ord) FILTER (ord < {BASE}), '')) AS base_sha256,
       coalesce(string_agg(said, ',' ORDER BY b, ord), '') AS spans
FROM t LEFT JOIN spans USING (doc_id) GROUP BY t.doc_id
"""


ORACLE_SQL = _oracle()
