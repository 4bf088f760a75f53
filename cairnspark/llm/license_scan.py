r"""License scans by ordered signature rules, in DataFrame expressions only.

A text becomes its lower-cased words, each between spaces of its own. A keyword prefilter intersects them with the
words that the rules can't do without; only rules all of whose keywords are there run, over that text. Every detection
is an interval of words. Where detections overlap, one of a better level suppresses those of worse levels, and
within a level one that contains another suppresses it (the earlier rule, of equal intervals); detections of one level that overlap in part
all stay. Base phrases are found beside the rules; they neither suppress nor are suppressed. All of this is
in the row of the text: nothing is shuffled or broadcast.

Defined results: null and empty texts have no words and no labels (an empty string); null ids are kept; repeated
rows are each scanned; an empty table gives no rows; a text of any length is one row of work, in time proportional to its
length for each rule that passes the prefilter, and to n log n for n detections; columns beside those named are passed on by ``scan``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ._util import table
from .license_rules import SIGNATURES
from .secret_scan import _let, running

#: The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
LEVELS = 3
#: How sure a detection of a level is, from the base phrases (0) on.
WEIGHTS = (0.9, 1.0, 0.8, 0.4)
KEYS = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FAR = 1 << 60
_NONE = "cast(array() as array<struct<start:bigint,back:bigint,ord:int,end:bigint,level:int,label:string>>)"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is over words parted by single spaces."""

    label: str
    level: int
    pattern: str

    @property
    def keys(self) -> list[str]:
        """The longest words that every match has."""
        found = mandatory(self.pattern)
        return sorted(found, key=lambda w: (-len(w), w))[:KEYS]

    @property
    def spaced(self) -> str:
        """The expression over words that have a space on both sides each."""
        said = self.pattern.replace("[^ ]", r"\S").replace(" ?", "\0").replace(" ", "  ").replace("\0", "(  )?")
        return f" {said} "


def mandatory(pattern: str) -> set[str]:
    """Whole words that stand outside of groups and next to nothing optional."""

    def group(m: re.Match) -> str:
        inner = m[1].split("|")
        apart = all(x.startswith(" ") for x in inner) or all(x.endswith(" ") for x in inner)
        before, after = pattern[m.start() - 1 : m.start()], pattern[m.end() : m.end() + 1]
        return " " if apart or before in ("", " ") and after in ("", " ") else "#"

    bare = re.sub(r"\(([^()]*)\)\??", group, pattern.replace(" ?", "#"))
    return {w for w in bare.split(" ") if re.fullmatch(r"[a-z0-9]+", w)}


def signatures() -> list[Rule]:
    """The rules by hand, in order, and a tag rule for each label."""
    found: list[Rule] = []
    label = ""
    for line in SIGNATURES.strip().splitlines():
        if line.startswith(" "):
            found.append(Rule(label, int(line[1]), line[3:]))
        else:
            label = line
            found.append(Rule(label, 1, "spdx license identifier " + re.sub(r"[^a-z0-9]+", " ", label) + "( only| or later)?"))
    return found


RULES = tuple(signatures())


def spaced(text: Column) -> Column:
    """The words of a text, each between two spaces of its own; one space where there are none."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, _NO_WORD, "  ")), F.lit(" "))


def _count(said: Column) -> Column:
    """Words in a piece of spaced words."""
    return ((F.length(said) - F.length(F.replace(said, F.lit(" "), F.lit("")))) / 2).cast("bigint")


def _detect(said: Column, rule: Column) -> Column:
    """Array of (start, back, ord, end, level, label) of a rule (a struct); ``back`` is minus ``end``, so that an array of these sorts
    by start, longer ones first."""
    whole = F.regexp_extract_all(said, rule["pattern"], F.lit(0))
    pieces = F.split(said, rule["pattern"], -1)
    sized = F.filter(F.arrays_zip(pieces.alias("before"), whole.alias("whole")), lambda x: x["whole"].isNotNull())
    counted = F.transform(sized, lambda x: F.struct(_count(x["before"]).alias("gap"), _count(x["whole"]).alias("size")))

    def placed(v: Column) -> Column:
        ends = running(F.transform(v, lambda x: x["gap"] + x["size"]), lambda a, x: a + x, 0)
        at = lambda x: x["b"] + x["x"]["gap"]
        made = lambda x: F.struct(at(x).alias("start"), (-at(x) - x["x"]["size"]).alias("back"), rule["ord"].alias("ord"), (at(x) + x["x"]["size"]).alias("end"), rule["level"].alias("level"), rule["label"].alias("label"))
        return F.transform(F.arrays_zip(v.alias("x"), ends.alias("b")), made)

    return _let(counted, placed)


def _table(rules: tuple[Rule, ...], first: int = 0) -> Column:
    row = lambda i, r: F.struct(F.lit(first + i).alias("ord"), F.lit(r.level).alias("level"), F.lit(r.label).alias("label"), F.lit(r.spaced).alias("pattern"), F.lit(r.keys[0]).alias("key"), F.array(*map(F.lit, r.keys[1:])).cast("array<string>").alias("keys"))
    return F.array(*[row(i, r) for i, r in enumerate(rules)])


def _kept(found: Column) -> Column:
    """Of sorted detections those that no other suppresses; each test looks at running extremes only."""
    def level_kept(v: Column, level: int) -> Column:
        before = running(F.transform(v, lambda x: F.when(x["level"] < level, x["end"]).otherwise(0)), F.greatest, 0)
        behind = F.reverse(running(F.reverse(F.transform(v, lambda x: F.when(x["level"] < level, x["start"]).otherwise(_FAR))), F.least, _FAR))
        same = running(F.transform(v, lambda x: F.when(x["level"] == level, x["end"]).otherwise(0)), F.greatest, 0)
        all_ = F.arrays_zip(v.alias("x"), before.alias("before"), behind.alias("behind"), same.alias("same"))
        free = lambda y: (y["x"]["level"] == level) & (y["before"] <= y["x"]["start"]) & (y["behind"] >= y["x"]["end"]) & (y["same"] < y["x"]["end"])
        return F.transform(F.filter(all_, free), lambda y: y["x"])

    return F.when(F.size(found) > 0, _let(found, lambda v: F.concat(*[level_kept(v, k) for k in range(1, LEVELS + 1)]))).otherwise(F.expr(_NONE))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` as a struct ``row``, n_words, and the detections, places in words: ``base`` (all places of base phrases) and ``kept``."""
    words = sorted({k for r in rules for k in r.keys})
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    own = docs.select(row, spaced(docs["text"]).alias("said"))
    own = own.select("row", "said", F.when(F.col("said") == "  ", F.lit(0)).otherwise(_count(F.col("said"))).cast("bigint").alias("n_words"))
    own = own.select("*", F.array_intersect(F.array(*map(F.lit, words)), F.split(F.trim("said"), "  ")).alias("keys"))
    passed = F.filter(_table(rules), lambda r: F.array_contains(F.col("keys"), r["key"]) & (F.size(F.array_except(r["keys"], F.col("keys"))) == 0))
    own = own.select("*", F.when(F.size("keys") > 0, F.flatten(F.transform(passed, lambda r: _detect(F.col("said"), r)))).alias("found"))
    base = []
    for i, (phrase, label) in enumerate(BASE):
        rule = Rule(label, 0, phrase)
        at = _detect(F.col("said"), F.struct(F.lit(i).alias("ord"), F.lit(0).alias("level"), F.lit(label).alias("label"), F.lit(rule.spaced).alias("pattern")))
        base.append(F.when(F.contains("said", F.lit(rule.spaced)), at).otherwise(F.expr(_NONE)))
    own = own.select("row", "n_words", F.concat(*base).alias("base"), F.array_sort(F.coalesce("found", F.expr(_NONE))).alias("found"))
    return own.select("row", "n_words", "base", _kept(F.col("found")).alias("kept"))


def _labels(spans: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["label"]))), ",")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    starts = F.transform("base", lambda x: x["start"])
    sure = F.transform(F.concat("base", "kept"), lambda x: F.element_at(F.array(*map(F.lit, WEIGHTS)), x["level"] + 1))
    return scan(docs.select("doc_id", "text"), rules).select(
        "row.doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        _labels(F.col("base")).alias("base_labels"),
        _labels(F.concat("base", "kept")).alias("labels"),
        F.coalesce(F.array_max(sure), F.lit(0.0)).alias("score"),
    )


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """Rules as rows that meet the texts with their keywords; suppression by looking at all other detections of a text."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    each = [Rule(label, 0, phrase) for phrase, label in BASE] + [*RULES]
    found = " UNION ALL ".join(
        f"""SELECT rid, {i} AS ord, {r.level} AS level, {quoted(r.label)} AS label, unnest(range(1, len(m) + 1)) AS k, unnest(m) AS s, unnest(p[1:len(m)]) AS p
  FROM (SELECT rid, regexp_extract_all(said, {quoted(r.spaced)}) AS m, string_split_regex(said, {quoted(r.spaced)}) AS p FROM t
        WHERE {" AND ".join(f"contains(said, {quoted(f' {k} ')})" for k in r.keys)})"""
        for i, r in enumerate(each)
    )
    weight = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(WEIGHTS))
    return rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, ' ' || trim(regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_NO_WORD}', '  ', 'g'), ' ') || ' ' AS said FROM documents),
parts AS ({found}),
placed AS (
  SELECT rid, ord, level, label, CAST((length(s) - length(replace(s, ' ', ''))) / 2 AS BIGINT) AS size,
         CAST(sum((length(p || s) - length(replace(p || s, ' ', ''))) / 2) OVER (PARTITION BY rid, ord ORDER BY k) AS BIGINT) AS e FROM parts),
d AS (SELECT rid, ord, level, label, e - size AS b, e FROM placed),
kept AS (
  SELECT * FROM d x WHERE level = 0 OR NOT EXISTS (
    SELECT 1 FROM d y WHERE y.rid = x.rid AND y.level > 0 AND y.b < x.e AND x.b < y.e AND (
      y.level < x.level OR y.level = x.level AND y.b <= x.b AND y.e >= x.e AND (y.e - y.b > x.e - x.b OR y.ord < x.ord))))
SELECT doc_id, CASE WHEN said = '  ' THEN 0 ELSE CAST((length(said) - length(replace(said, ' ', ''))) / 2 AS BIGINT) END AS n_words,
       count(*) FILTER (level = 0) AS n_base, min(b) FILTER (level = 0) AS first_word, max(b) FILTER (level = 0) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (level = 0), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
       CAST(coalesce(max(CASE level {weight} END), 0) AS DOUBLE) AS score
FROM t LEFT JOIN kept USING (rid) GROUP BY rid, doc_id, said
"""


ORACLE_SQL = _oracle()
