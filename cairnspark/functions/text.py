"""Text rules as column expressions: terms, stems, keys, snippets, scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Words that carry no search meaning.
STOPWORDS = ["a", "an", "the", "about", "what", "is", "are", "tell", "me", "please",
             "내용", "설명", "정리", "요약", "무엇", "뭐야", "어떤", "있어", "있나요", "없어", "없나요"]
#: Words too general to identify a source.
GENERIC = ["document", "documents", "doc", "docs", "source", "sources", "citation", "citations", "evidence", "graph", "node",
           "context", "pdf", "docx", "file", "files", "paper", "papers", "article", "articles", "research", "page", "pages",
           "summarize", "summary", "문서", "자료", "파일", "논문", "연구", "출처", "근거", "인용", "그래프", "노드", "페이지", "요약", "정리"]
#: Words that mark a passage as an explanation.
EXPLAINING = [" using ", " fixed ", " directory", " directories", " bucket", " split", " overflow", " insert", " delete",
              " search", " stored", " address", " grows", " shrinks"]
#: Words in a query that ask for one type of evidence.
INTENTS = {
    "table": ["table", "row", "column", "spreadsheet", "csv", "financial", "balance sheet", "표", "테이블"],
    "image": ["image", "figure", "chart", "diagram", "screenshot", "ocr", "caption", "그림", "이미지", "차트"],
    "summary": ["summary", "summarize", "overview", "요약", "개요"],
    "claim": ["claim", "assertion", "statement", "argument", "주장", "명제"],
    "relationship": ["relationship", "relation", "link", "graph", "connect", "edge", "관계", "연결"],
}
#: Markers in claims.
NEGATIONS = ["no", "not", "never", "without"]
CLAIM_NOISE = ["this", "that", "with", "from", "into", "evidence", "backed"]
DECISIONS = [" decision ", " decided ", " chose ", " chosen ", " approved ", " accepted ", " source of truth ", " must ",
             " should ", " will ", " no human approval ", " records approved "]
RELATION_CUES = [
    ("depends_on", [" depends on ", " relies on ", " requires ", " blocked by "]),
    ("supports", [" supports ", " enables ", " grounds ", " backs ", " cites "]),
    ("contradicts", [" contradicts ", " conflicts with "]),
    ("supersedes", [" supersedes ", " replaces "]),
    ("same_as", [" same as ", " alias of "]),
    ("related_to", ["->", "<->", " links "]),
]
NOT_ALNUM = r"[^\p{L}\p{N}]+"


def literals(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_ALNUM), lambda t: F.length(t) > 0)


def search_terms(text: Column) -> Column:
    """Distinct tokens without stopwords, in the order of their first use (Hangul composed)."""
    return F.array_distinct(F.filter(tokens(compose_hangul(text)), lambda t: ~t.isin(*STOPWORDS)))


def compose_hangul(text: Column) -> Column:
    """Conjoining jamo as syllables; a text without jamo is returned as it is."""
    # the first code points of leading consonants, vowels and (less one) trailing consonants
    first, vowel, last = 0x1100, 0x1161, 0x11A7

    def syllable(m: Column) -> Column:
        lead = F.ascii(F.substring(m, 1, 1)) - first
        mid = F.ascii(F.substring(m, 2, 1)) - vowel
        tail = F.when(F.length(m) > 2, F.ascii(F.substring(m, 3, 1)) - last).otherwise(F.lit(0))
        code = F.lit(0xAC00) + (lead * 21 + mid) * 28 + tail
        utf8 = F.concat(F.hex(F.lit(0xE0) + F.shiftright(code, 12)), F.hex(F.lit(0x80) + F.shiftright(code, 6).bitwiseAND(F.lit(63))), F.hex(F.lit(0x80) + code.bitwiseAND(F.lit(63))))
        return F.decode(F.unhex(utf8), "UTF-8")

    jamo = "[ᄀ-ᄒ][ᅡ-ᅵ][ᆨ-ᇂ]?"
    pieces, found = F.split(text, jamo, -1), F.regexp_extract_all(text, F.lit(jamo), F.lit(0))
    whole = F.concat_ws("", F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(syllable(F.get(found, i)), F.lit("")))))
    return F.when(F.rlike(text, F.lit(jamo)), whole).otherwise(text)


def stem(token: Column) -> Column:
    """Plural and verb endings off ASCII tokens."""
    n = F.length(token)
    cut = lambda k: F.substring(token, F.lit(1), n - k)
    return (
        F.when(token.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(token.endswith("ing") & (n > 5), cut(3))
        .when((token.endswith("ed") | token.endswith("es")) & (n > 4) & ~token.endswith("ses"), cut(2))
        .when(token.endswith("s") & (n > 4) & ~token.endswith("ss") & ~token.endswith("us"), cut(1))
        .otherwise(token)
    )


def normal_key(label: Column) -> Column:
    """A label's identity: lower case, only letters and digits, single spaces."""
    return F.trim(F.regexp_replace(F.lower(label), NOT_ALNUM, " "))


def matched(text: Column, terms: Column) -> Column:
    """Number of distinct terms that the text contains."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.size(F.filter(terms, lambda t: F.contains(low, t)))


def match_score(text: Column, terms: Column) -> Column:
    return matched(text, terms) * 100


def metadata_score(text: Column, terms: Column) -> Column:
    """100 for each matched term, 200 more for each that isn't generic."""
    return match_score(text, terms) + matched(text, F.filter(terms, lambda t: ~t.isin(*GENERIC))) * 200


def frequency_score(words: Column, terms: Column) -> Column:
    """Scores of stemmed words against stemmed terms: 8 + 2f for an exact one, 3 for a term of four letters
    or more that begins a word or is begun by one, the square of the number of matched terms, 10 more if all
    are matched."""
    count = lambda t: F.size(F.filter(words, lambda w: w == t))
    prefixed = lambda t: F.exists(words, lambda w: (F.length(t) > 3) & (w.startswith(t) | t.startswith(w)))
    of = lambda t: let(count(t), lambda n: F.when(n > 0, n * 2 + 8).when(prefixed(t), F.lit(3)).otherwise(F.lit(0)))
    each = F.transform(terms, of)
    all_held = lambda hits: F.when(F.size(hits) == F.size(terms), F.lit(10)).otherwise(F.lit(0))
    total = lambda hits: F.aggregate(hits, F.lit(0), lambda a, x: a + x) + F.size(hits) * F.size(hits) + all_held(hits)
    # a sum refers to the scores of terms several times, which must not be made for each
    return let(F.filter(each, lambda x: x > 0), lambda hits: F.when(F.size(hits) > 0, total(hits)).otherwise(F.lit(0)))


def best_snippet(text: Column, terms: Column) -> Column:
    """180 characters from 48 before the first place of any term; the beginning if there is none."""
    low = F.lower(text)
    places = F.filter(F.transform(terms, lambda t: F.instr(low, t)), lambda p: p > 0)
    start = F.greatest(F.coalesce(F.array_min(places), F.lit(1)) - 48, F.lit(1))
    return F.trim(F.substring(text, start, F.lit(180)))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, as a lambda's variable, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(text: Column) -> Column:
    """Without white space (of Unicode) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def context_window(text: Column, terms: Column, size: int = 1600) -> Column:
    """The window of ``size`` characters of the trimmed text with the highest score: 1000 for each distinct
    term, 30 for each of its first eight places, 220 if it isn't at the beginning, 25 for each explaining
    word, less 900 for a table of contents; the last one wins ties. Places are counted in characters."""
    return let(trimmed(F.coalesce(text, F.lit(""))), lambda t: let(F.lower(t), lambda low: _best_window(t, low, terms, size)))


#: Values that ``running`` takes in one go, and characters of a piece of text that windows are cut from.
_STEP, _PIECE = 256, 1 << 15


def running(values: Column, combine, zero: int) -> Column:
    """For each number of an array what ``combine`` makes of those before it, beginning with ``zero``: in steps, so that no long
    array is copied for each of its elements."""
    none = F.expr("cast(array() as array<bigint>)")

    def scan(numbers: Column, first: Column) -> Column:
        start = F.struct(first.cast("bigint").alias("now"), none.alias("out"))
        step = lambda s, x: F.struct(combine(s["now"], x).cast("bigint").alias("now"), F.array_append(s["out"], s["now"]).alias("out"))
        return F.aggregate(numbers, start, step, lambda s: s["out"])

    def whole(v: Column) -> Column:
        part = lambda k: F.slice(v, k * _STEP + 1, _STEP)
        parts = F.sequence(F.lit(0), F.ceil(F.size(v) / _STEP).cast("int") - 1)
        begins = scan(F.transform(parts, lambda k: F.aggregate(part(k), F.lit(zero).cast("bigint"), lambda s, x: combine(s, x).cast("bigint"))), F.lit(zero))
        return F.when(F.size(v) > 0, F.flatten(F.transform(begins, lambda first, k: scan(part(k), first)))).otherwise(none)

    return let(values, whole)


def places(low: Column, term: Column) -> Column:
    """Where ``term`` stands in a text: its characters before each place, by the lengths of the pieces between them."""
    pieces = F.transform(F.call_function("split", low, F.concat(F.lit("\\Q"), term, F.lit("\\E")), F.lit(-1)), lambda s: F.length(s).cast("bigint"))

    def placed(sizes: Column) -> Column:
        before = running(F.transform(sizes, lambda n: n + F.length(term)), lambda a, n: a + n, 0)
        return F.slice(F.zip_with(before, sizes, lambda a, n: a + n), 1, F.size(sizes) - 1)

    return let(pieces, placed)


def _best_window(text: Column, low: Column, terms: Column, size: int) -> Column:
    phrase = F.when(F.size(terms) > 1, F.array(F.array_join(terms, " "))).otherwise(F.expr("cast(array() as array<string>)"))
    asked = F.filter(F.concat(phrase, terms), lambda t: F.contains(low, t))
    found = F.array_distinct(F.flatten(F.transform(asked, lambda t: places(low, t))))
    whole = F.sequence(F.lit(0), F.floor(F.length(text) / _PIECE).cast("int"))
    pieces = F.transform(whole, lambda k: F.substring(text, (k * _PIECE + 1).cast("int"), F.lit(_PIECE + 2 * size)))
    window = lambda at: let(pieces, lambda cut: _window_at(text, cut, at, terms, size))
    return F.when(F.size(asked) > 0, let(_starts(text, found), window)).otherwise(F.substring(text, 1, size))


def _starts(text: Column, found: Column) -> Column:
    """Of each window its start and the last place that has it, (start, at): a window begins with the paragraph of its place, or
    the line if there are no paragraphs before it, or 120 characters before the place if that is far."""
    ends = places(text, F.lit("\n"))
    mark = lambda kind: lambda p: F.struct(p.alias("p"), F.lit(kind).alias("kind"))

    def marks(ends: Column) -> Column:
        paragraphs = F.filter(ends, lambda p, k: (k > 0) & (F.get(ends, k - 1) == p - 1))
        after = lambda kind: lambda p: mark(kind)(p + 1)
        return F.array_sort(F.concat(F.transform(found, mark(2)), F.transform(ends, after(1)), F.transform(paragraphs, after(0))))

    def begun(all_: Column) -> Column:
        last = lambda kind: running(F.transform(all_, lambda x: F.when(x["kind"] == kind, x["p"]).otherwise(0)), F.greatest, 0)
        begin = lambda x: F.when(x["paragraph"] > 0, x["paragraph"]).otherwise(x["line"])
        start = lambda x: F.when(x["m"]["p"] - begin(x) > 240, F.greatest(x["m"]["p"] - 120, F.lit(0))).otherwise(begin(x))
        each = F.filter(F.arrays_zip(all_.alias("m"), last(0).alias("paragraph"), last(1).alias("line")), lambda x: x["m"]["kind"] == 2)
        return F.transform(each, lambda x: F.struct(start(x).alias("start"), x["m"]["p"].alias("at")))

    # of places that share a start, which come one after the other, the last scores best
    alone = lambda v: F.filter(v, lambda x, k: ~F.get(v, k + 1)["start"].eqNullSafe(x["start"]))
    return let(let(let(ends, marks), begun), alone)


def _window_at(text: Column, pieces: Column, at: Column, terms: Column, size: int) -> Column:
    left = lambda s: F.regexp_replace(s, r"(?U)^\s+", "")

    def window(start: Column) -> Column:
        near = left(F.substring(F.get(pieces, F.floor(start / _PIECE).cast("int")), (start % _PIECE + 1).cast("int"), F.lit(2 * size)))
        far = left(F.substring(text, (start + 1).cast("int"), F.lit(2**31 - 1)))  # behind much white space
        return let(near, lambda s: F.substring(F.when((F.length(s) < size) & (start + 2 * size < F.length(text)), far).otherwise(s), 1, size))

    ranked = F.transform(at, lambda x: F.struct(let(F.lower(window(x["start"])), lambda said: _window_score(said, x["at"], terms)).alias("score"), x["at"].alias("at"), x["start"].alias("start")))
    return window(F.array_max(ranked)["start"])


def _window_score(said: Column, p: Column, terms: Column) -> Column:
    count = lambda t: F.floor((F.length(said) - F.length(F.replace(said, t, F.lit("")))) / F.length(t)).cast("int")
    hits = F.filter(F.transform(terms, count), lambda n: n > 0)
    repeats = F.aggregate(hits, F.lit(0), lambda a, n: a + F.least(n, F.lit(8)))
    contents = (p < 500) & F.contains(said, F.lit("contents")) & F.contains(said, F.lit("8.1")) & F.contains(said, F.lit("8.2")) & F.contains(said, F.lit("8.3"))
    words = F.size(F.filter(literals(EXPLAINING), lambda w: F.contains(said, w)))
    return F.size(hits) * 1000 + repeats * 30 + F.when(p > 400, 220).otherwise(0) + words * 25 - F.when(contents, 900).otherwise(0)


def line_snippet(text: Column, terms: Column) -> Column:
    """240 characters of the line that holds the first term found; of the beginning if none is."""
    low = F.lower(text)
    found = F.get(F.filter(terms, lambda t: F.contains(low, t)), F.lit(0))
    at = F.instr(low, found)
    line = F.concat(F.substring_index(F.substring(text, F.lit(1), at - 1), "\n", -1), F.substring_index(F.substring(text, at, F.lit(2**31 - 1)), "\n", 1))
    return F.substring(trimmed(F.when(found.isNull(), text).otherwise(line)), 1, 240)


def wants(query: Column) -> dict[str, Column]:
    """Whether a query asks for each type of evidence."""
    low = F.lower(query)
    return {kind: F.exists(literals(words), lambda w: F.contains(low, w)) for kind, words in INTENTS.items()}


def typed_boost(evidence_type: Column, query: Column | str) -> Column:
    """What a type of evidence (with or without ``_evidence``) is worth for a query, given as a column or
    as a text: the first intent that fits, and a base."""
    want = wants(F.lit(query) if isinstance(query, str) else query)
    kind = F.regexp_replace(evidence_type, "_evidence$", "")
    intent = F.when(want["table"] & (kind == "table"), 0.14)
    intent = intent.when(want["image"] & kind.isin("image_region", "ocr", "caption"), 0.12)
    intent = intent.when(want["summary"] & kind.isin("summary", "wiki"), 0.10)
    intent = intent.when(want["claim"] & (kind == "claim"), 0.10)
    intent = intent.when(want["relationship"] & (kind == "relationship"), 0.10)
    intent = intent.when(want["relationship"] & (kind == "claim"), 0.06)
    intent = intent.when(want["claim"] & (kind == "relationship"), 0.06).otherwise(0.0)
    return intent + F.when(kind == "text", 0.05).when(kind.isin("summary", "claim", "wiki"), 0.02).otherwise(0.0)


def claim_terms(text: Column) -> Column:
    words = F.split(F.lower(text), "[^a-z0-9]+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*CLAIM_NOISE))))


def negated(text: Column) -> Column:
    return F.exists(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w.isin(*NEGATIONS))


def claim_kind(text: Column) -> Column:
    low = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return let(low, lambda low: F.when(F.exists(literals(DECISIONS), lambda m: F.contains(low, m)), "decision").otherwise("durable_fact"))


def relation_kind(text: Column) -> Column:
    def told(low: Column) -> Column:
        out = None
        for kind, cues in RELATION_CUES:
            test = F.exists(literals(cues), lambda c: F.contains(low, c))
            out = F.when(test, kind) if out is None else out.when(test, kind)
        return out

    return let(F.lower(text), told)


def evidence_type(text: Column) -> Column:
    """'table' if a line with two pipes is followed by a separator line, else 'text'."""
    pipes = lambda s: F.length(s) - F.length(F.replace(s, F.lit("|"), F.lit("")))
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    rule = lambda s: F.rlike(s, F.lit(r"^[\s|:-]+$")) & F.contains(s, F.lit("-")) & (pipes(s) >= 2)
    pairs = F.zip_with(lines, F.slice(lines, 2, F.size(lines)), lambda a, b: (pipes(a) >= 2) & F.coalesce(rule(b), F.lit(False)))
    return F.when(F.exists(pairs, lambda x: F.coalesce(x, F.lit(False))), "table").otherwise("text")


def confidence_bucket(value: Column) -> Column:
    return F.when(value.isNull(), "unknown").when(value >= 0.8, "high").when(value >= 0.5, "medium").otherwise("low")


def redact_paths(text: Column) -> Column:
    """Local absolute paths replaced by a mark."""
    unix = r"(?<![\w/:.])/(?:Users|home|root|var|tmp|etc|private|opt|mnt)(?:/[^\s\"'<>|,;)]+)+"
    return F.regexp_replace(F.regexp_replace(text, unix, "[path]"), r"\b[A-Za-z]:\\[^\s\"'<>|,;)]+", "[path]")


def safe_path(path: Column) -> Column:
    """Whether a path is relative and never climbs."""
    return path.isNotNull() & (F.length(path) > 0) & ~path.startswith("/") & ~F.rlike(path, F.lit(r"^[A-Za-z]:|\\")) & ~F.array_contains(F.split(path, "/"), "..")
