"""Chat formatting by quotation linking, in DataFrame expressions only.

Lines of a message are parsed into nested quote levels; runs of one level are passages. The
normalised passages and their lines are hashed and joined with the hashes of what messages of the
same conversation say themselves; a passage belongs to the earliest message that says it, if that
one is earlier than the quoting message. A message replies to the message that most characters of
its first quote level belong to. Following the replies upwards (pointer doubling) gives the thread
of each message; sorting by (conv_id, thread_turn, turn) puts every reply behind what it answers, which is
the order of ``conversations``.

Defined results: null texts are empty; null ids or turns never link and are their own thread;
repeated rows are kept and get equal results; rows that share a conversation and turn share one
thread, that of the smallest turn replied to; of several messages that say the same the earliest is the
original; a reply whose quotes tie goes to the latest of the originals; quotes without an original are removed
as well, and originals are looked up in the conversation of the quote only; an empty table gives no rows; a
message is cut in time that grows with its length; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ._util import materialize, table

#: A quote mark is made of ``>`` with up to three blanks before each, and a space. It's read off the run of blanks and ``>``
#: at the start of a line, by expressions without repeated groups, which a long line would make too deep for the JVM's stack.
_RUN, _GAP, _LAST = r"^[ \t>]+", r"[ \t]{4}", r"^.*>"
#: How mail and chat programs introduce a quote, at the end of a line. German ones put the
#: name last: they begin with "Am " and hold " schrieb".
_INTRO = r". (wrote|said|a écrit ?|escribió):\s*$"
_GERMAN = ("Am ", " schrieb", r":\s*$")


def normal(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, r"\s+", " ")))


def _parsed(messages: DataFrame) -> DataFrame:
    """Columns ``own`` (text without quotes) and ``runs`` (array of level and text of passages)."""

    def cut(line: Column) -> Column:
        signs = F.regexp_extract(F.get(F.split(F.regexp_extract(line, _RUN, 0), _GAP, 2), F.lit(0)), _LAST, 0)
        space = (signs != "") & (F.substring(line, F.length(signs) + 1, F.lit(1)) == " ")
        mark = F.concat(signs, F.when(space, " ").otherwise(""))
        german = F.startswith(line, F.lit(_GERMAN[0])) & F.contains(line, F.lit(_GERMAN[1])) & F.rlike(line, F.lit(_GERMAN[2]))
        intro = F.rlike(line, F.lit(_INTRO)) | german
        return F.struct(F.length(F.regexp_replace(mark, "[^>]", "")).alias("level"), F.substring(line, F.length(mark) + 1, F.lit(2**31 - 1)).alias("said"), intro.alias("intro"))

    text = F.coalesce("text", F.lit(""))
    out = messages.select("conv_id", "turn", "role", "text").withColumn("lines", F.transform(F.split(text, "\r?\n"), cut))
    intro = lambda x, i: x["intro"] & F.coalesce(F.get("lines", i + 1)["level"] > 0, F.lit(False))
    own = F.filter("lines", lambda x, i: (x["level"] == 0) & ~intro(x, i))
    # a run begins where the level changes and ends before the next one does
    level = lambda i: F.get("lines", i - 1)["level"]
    out = out.withColumn("starts", F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: ~level(i).eqNullSafe(level(i - 1))))
    ends = F.concat(F.slice("starts", 2, F.greatest(F.size("starts"), F.lit(1))), F.array(F.size("lines") + 1))
    quoted = F.filter(F.arrays_zip(F.col("starts").alias("a"), ends.alias("b")), lambda x: level(x["a"]) > 0)
    said = lambda x: F.array_join(F.transform(F.slice("lines", x["a"], x["b"] - x["a"]), lambda y: y["said"]), "\n")
    none = F.expr("cast(array() as array<struct<level:int,said:string>>)")
    runs = F.when(F.contains(text, F.lit(">")), F.transform(quoted, lambda x: F.struct(level(x["a"]).alias("level"), said(x).alias("said")))).otherwise(none)
    return out.select("conv_id", "turn", "role", "text", F.trim(F.array_join(F.transform(own, lambda x: x["said"]), "\n"), F.lit(" \t\n")).alias("own"), runs.alias("runs"))


def _units(text: Column) -> Column:
    """A passage as a whole, and its lines: (hash, size), each once."""
    parts = F.array_distinct(F.concat(F.array(normal(text)), F.transform(F.split(text, "\n"), normal)))
    return F.transform(F.filter(parts, lambda s: F.length(s) > 0), lambda s: F.struct(F.xxhash64(s).alias("hash"), F.length(s).alias("size")))


def link(messages: DataFrame) -> DataFrame:
    """Per message: conv_id, turn, role, n_quotes, n_linked (passages with a known original),
    reply_to (turn), thread_turn, text (without quotes)."""
    parsed = materialize(_parsed(messages), "parsed_messages")
    said = parsed.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    origins = (
        said.select("conv_id", "turn", F.explode(_units(F.col("own"))).alias("unit"))
        .groupBy("conv_id", F.col("unit.hash").alias("hash")).agg(F.min("turn").alias("first_turn"))
    )
    quoting = said.where(F.size("runs") > 0).select("conv_id", "turn", F.xxhash64("text").alias("key"), "runs").distinct()
    passages = quoting.select("conv_id", "turn", "key", F.posexplode("runs").alias("passage", "run"))
    units = passages.select("conv_id", "turn", "key", "passage", F.col("run.level").alias("level"), F.explode(_units(F.col("run.said"))).alias("unit"))
    found = units.select("conv_id", "turn", "key", "passage", "level", F.col("unit.hash").alias("hash"), F.col("unit.size").alias("size")).join(origins, ["conv_id", "hash"]).where("first_turn < turn")
    message = ["conv_id", "turn", "key"]
    by_origin = found.groupBy(*message, "first_turn").agg(F.sum(F.when(F.col("level") == 1, F.col("size"))).alias("size"))
    reply = by_origin.where("size is not null").groupBy(*message).agg(F.max_by("first_turn", F.struct("size", "first_turn")).alias("reply_to"))
    linked = found.select(*message, "passage").distinct().groupBy(*message).agg(F.count("*").alias("n_linked")).join(reply, message, "left")
    linked = materialize(linked, "linked_messages")
    return _with_threads(parsed, linked)


def _threads(linked: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_turn) of all messages that reply to one."""
    up = materialize(linked.where("reply_to is not null").groupBy("conv_id", "turn").agg(F.min("reply_to").alias("up")), "replies")
    while True:
        above = up.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("higher"))
        step = materialize(up.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("higher", "up").alias("up"), F.col("higher").isNotNull().alias("moved")), "replies")
        if not step.where("moved").limit(1).count():
            return step.select("conv_id", "turn", F.col("up").alias("thread_turn"))
        up = step.drop("moved")


def _with_threads(parsed: DataFrame, linked: DataFrame) -> DataFrame:
    keyed = parsed.withColumn("key", F.xxhash64("text"))
    return (
        keyed.join(linked, ["conv_id", "turn", "key"], "left").join(_threads(linked), ["conv_id", "turn"], "left")
        .select("conv_id", "turn", "role", F.size("runs").cast("bigint").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), "reply_to", F.coalesce("thread_turn", "turn").alias("thread_turn"), F.col("own").alias("text"))
    )


def conversations(messages: DataFrame) -> DataFrame:
    """The linked messages in reply order, each with its chat markup in ``formatted``."""
    said = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("text"), F.lit("\n"))
    return link(messages).withColumn("formatted", said).orderBy("conv_id", "thread_turn", "turn")


def op2_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations"))


_NORMAL = r"trim(lower(regexp_replace({}, '\s+', ' ', 'g')))"
ORACLE_SQL = rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
l0 AS (SELECT id, unnest(string_split_regex(text, '\r?\n')) AS line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS k FROM m),
l1 AS (SELECT id, k, line, regexp_extract(line, '^((?:[ \t]{{0,3}}>)+ ?)', 1) AS mark FROM l0),
l2 AS (SELECT id, k, length(regexp_replace(mark, '[^>]', '', 'g')) AS level, substr(line, length(mark) + 1) AS said, regexp_matches(line, '{_INTRO}') OR (starts_with(line, '{_GERMAN[0]}') AND contains(line, '{_GERMAN[1]}') AND regexp_matches(line, '{_GERMAN[2]}')) AS intro FROM l1),
l3 AS (SELECT *, lead(level) OVER (PARTITION BY id ORDER BY k) AS next_level, lag(level) OVER (PARTITION BY id ORDER BY k) AS prior FROM l2),
own AS (SELECT id, trim(coalesce(string_agg(said, chr(10) ORDER BY k) FILTER (level = 0 AND NOT (intro AND coalesce(next_level, 0) > 0)), ''), ' ' || chr(9) || chr(10)) AS own FROM l3 GROUP BY id),
l4 AS (SELECT *, sum(CASE WHEN level IS DISTINCT FROM prior THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY k) AS run FROM l3),
runs AS (SELECT id, run, any_value(level) AS level, string_agg(said, chr(10) ORDER BY k) AS said FROM l4 WHERE level > 0 GROUP BY id, run),
origin AS (
  SELECT conv_id, unit, min(turn) AS first_turn FROM (
    SELECT m.conv_id, m.turn, {_NORMAL.format('own')} AS unit FROM own JOIN m USING (id)
    UNION ALL SELECT m.conv_id, m.turn, {_NORMAL.format('unnest(string_split(own, chr(10)))')} FROM own JOIN m USING (id))
  WHERE unit <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
asked AS (
  SELECT DISTINCT id, run, level, unit FROM (
    SELECT id, run, level, {_NORMAL.format('said')} AS unit FROM runs
    UNION ALL SELECT id, run, level, {_NORMAL.format('unnest(string_split(said, chr(10)))')} FROM runs) WHERE unit <> ''),
found AS (SELECT a.*, m.conv_id, m.turn, o.first_turn FROM asked a JOIN m USING (id) JOIN origin o ON o.conv_id = m.conv_id AND o.unit = a.unit AND o.first_turn < m.turn),
best AS (SELECT id, first_turn, row_number() OVER (PARTITION BY id ORDER BY sum(length(unit)) DESC, first_turn DESC) AS k FROM found WHERE level = 1 GROUP BY id, first_turn),
linked AS (SELECT id, count(DISTINCT run) AS n_linked FROM found GROUP BY id),
reply AS (SELECT conv_id, turn, min(first_turn) AS up FROM best JOIN m USING (id) WHERE k = 1 GROUP BY 1, 2),
walk AS (SELECT conv_id, turn, up FROM reply UNION ALL SELECT w.conv_id, w.turn, r.up FROM walk w JOIN reply r ON r.conv_id = w.conv_id AND r.turn = w.up),
top AS (SELECT conv_id, turn, min(up) AS thread_turn FROM walk GROUP BY 1, 2)
SELECT m.conv_id, m.turn, m.role, (SELECT count(*) FROM runs r WHERE r.id = m.id) AS n_quotes, coalesce(n_linked, 0) AS n_linked,
       b.first_turn AS reply_to, coalesce(top.thread_turn, m.turn) AS thread_turn, own.own AS text,
       '<|' || coalesce(m.role, 'unknown') || '|>' || chr(10) || own.own || chr(10) AS formatted
FROM m JOIN own USING (id) LEFT JOIN linked USING (id) LEFT JOIN best b ON b.id = m.id AND b.k = 1
LEFT JOIN top ON top.conv_id = m.conv_id AND top.turn = m.turn
"""
