"""Toxicity scores: Levenshtein automata intersected with a lexicon trie, then context windows.

The lexicon (word stems whose share of toxic texts is far above their share of others) and all
weights are learned from at most about ``SAMPLE`` labelled rows that aren't held out. The trie of
the stems and the Levenshtein automaton of distance one are intersected and made deterministic: one
table-driven pass over each word tells the best stem it begins with, exactly or with one edit (a letter
more, less or another, or two neighbours exchanged).
A term weighs what its exact hits tell. A word one edit away
starts from a share of that weight (``FUZZY_SHARE``), so that a spelling never seen counts too; the
more sampled texts hold the very spelling, the more their labels decide instead, so that a common
word which happens to look like a term counts for little. A term near which many spellings turn up
in just one text that isn't toxic gives unseen ones less. A digit or masking sign (``MASKS``)
between two letters may be the letter substituted; such spellings are judged apart.
Every hit is weighed in its window: whether quotation marks stand around it, and how many other
hits are near; quoted hits feed other inputs of the final logistic model than plain ones.

Defined results: null and empty texts have no hits and get the score of such texts; without labels
or with labels of one class every score is near the mean label (0 without labels); repeated rows get
equal scores; an empty table gives no rows; a text of any length is scored whole, as one row of work; other
columns are ignored.

Only the number of labelled rows is bounded. Stems may have any length and all that pass the test stay: up to
``HEAD`` letters every beginning of a word is a candidate, beyond them the places where words of the sample part
and the words themselves, which a longer candidate held by the same texts would cover anyway. The last step sees
the logarithm of summed weights, so that many hits tell more than few, if less and less.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ._labels import held_out, labelled_sample
from ._util import slices, small_batches, table

SAMPLE = 20_000
#: Letters up to which every beginning of a word is a candidate; longer stems are sought among words with frequent ones.
HEAD = 12
#: Least length of a stem for which one edit is allowed.
FUZZY_FROM = 4
#: Share of a term's weight for a word one edit away, and the least share after its loss by false hits.
FUZZY_SHARE, LEAST_FUZZY_SHARE = 0.9, 0.05
#: Summed weight from which on further hits tell clearly less: sums enter as log(1 + sum / BEND).
BEND = 20
#: Signs that stand for a letter when they are inside a word, as digits do.
MASKS = "*#@$!%&+_^~|?"
WINDOW_CHARS, WINDOW_WORDS = 60, 12
_QUOTES = "\"“”„«»‹›‘’>"


class _Letters:
    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            cls.table = np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])
        return cls.table


class _Digits:
    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            cls.table = np.array([chr(c).isdigit() for c in range(0x110000)])
        return cls.table


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased texts, each followed by a line feed, and where each begins."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("".join(t + "\n" for t in low).encode("utf-32-le", "replace"), np.uint32)
    return points, np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])])


def _words(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of letters."""
    inside = _Letters.get()[points]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _masked(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of words with one digit or masking sign between each, and the
    first of the words and the one after the last. ``start`` and ``end`` are those of the words."""
    if not len(start):
        return start, end, start, start
    between = points[end[:-1]]
    mask = np.isin(between, np.array([ord(c) for c in MASKS], np.uint32)) | _Digits.get()[between]
    joined = np.concatenate([[False], (start[1:] - end[:-1] == 1) & mask, [False]])
    first = np.flatnonzero(joined[1:] & ~joined[:-1])
    last = np.flatnonzero(joined[:-1] & ~joined[1:])
    return start[first], end[last], first, last + 1


class LexiconAutomaton:
    """Deterministic automaton over letter classes; ``found[state]`` is the best match that ends in
    a state: 0 none, 1 + 2 * term with one edit, 2 + 2 * term exact (a larger term is a longer one)."""

    def __init__(self, terms: list[str], fuzzy_from: int = FUZZY_FROM):
        self.terms = sorted({*terms}, key=lambda t: (len(t), t))
        self.reach = np.array([len(t) + 1 for t in self.terms], np.int64)
        letters = sorted({c for t in self.terms for c in t})
        self.classes = np.zeros(0x110000, np.int16)
        for i, c in enumerate(letters):
            self.classes[ord(c)] = i + 1
        width = len(letters) + 1
        number = {c: i + 1 for i, c in enumerate(letters)}
        children: list[dict[int, int]] = [{}]
        term_at, may_edit = [-1], [False]
        for k, t in enumerate(self.terms):
            node, path = 0, [0]
            for c in t:
                nxt = children[node].get(number[c])
                if nxt is None:
                    nxt = children[node][number[c]] = len(children)
                    children.append({})
                    term_at.append(-1)
                    may_edit.append(False)
                node = nxt
                path.append(node)
            term_at[node] = k
            if len(t) >= fuzzy_from:
                for n in path:
                    may_edit[n] = True

        def closed(states: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
            """With deletions of a stem's letter; states implied by fewer edits go. Besides 0 and 1 edits a
            state may wait for letter ``c`` as (where the stem goes on, -c): it read the one behind ``c`` first."""
            out = set(states)
            for node, edits in states:
                if edits == 0 and may_edit[node]:
                    out |= {(n, 1) for n in children[node].values() if may_edit[n]}
            return frozenset(s for s in out if s[1] <= 0 or (s[0], 0) not in out)

        def step(states: frozenset[tuple[int, int]], c: int) -> frozenset[tuple[int, int]]:
            out = set()
            for node, edits in states:
                if edits < 0:
                    out |= {(node, 1)} if c == -edits else set()
                    continue
                if (n := children[node].get(c)) is not None:
                    out.add((n, edits))
                if edits == 0 and may_edit[node]:
                    out.add((node, 1))
                    out |= {(n, 1) for n in children[node].values() if may_edit[n]}
                    swapped = {(children[n].get(c, 0), -skipped) for skipped, n in children[node].items() if skipped != c}
                    out |= {(n, skipped) for n, skipped in swapped if may_edit[n] and n}
            return closed(out)

        def best(states: frozenset[tuple[int, int]]) -> int:
            ends = (1 + 2 * term_at[n] + (e == 0) for n, e in states if e >= 0 and term_at[n] >= 0 and (e == 0 or len(self.terms[term_at[n]]) >= fuzzy_from))
            return max(ends, default=0, key=lambda m: (m % 2 == 0, m))

        first = closed({(0, 0)})
        numbers = {frozenset(): 0, first: 1}
        rows, queue = [[0] * width], [first]
        self.found = [0, 0]
        for states in queue:
            row = []
            for c in range(width):
                nxt = step(states, c)
                if nxt not in numbers:
                    numbers[nxt] = len(numbers)
                    queue.append(nxt)
                    self.found.append(best(nxt))
                row.append(numbers[nxt])
            rows.append(row)
        self.next, self.found = np.array(rows, np.int32), np.array(self.found, np.int32)

    def run(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The best match of each word: exact before fuzzy, then the longer stem."""
        out, state = np.zeros(len(start), np.int32), np.ones(len(start), np.int32)
        live, k = np.arange(len(start)), 0
        classes = self.classes[points]
        while len(live):
            state = self.next[state, classes[start[live] + k]]
            got = self.found[state]
            if got.any():
                old = out[live]
                better = (got > 0) & ((got % 2 == 0) & (old % 2 == 1) | (got % 2 == old % 2) & (got > old) | (old == 0))
                out[live[better]] = got[better]
            k += 1
            go = (state > 0) & (start[live] + k < end[live])
            live, state = live[go], state[go]
        return out


def _code(match: int, spelling: str, n_terms: int) -> int:
    """Place of an inexact match among the weights: those of masked words follow the others."""
    return match if spelling.isalpha() else 2 * n_terms + 1 + match // 2


def _hits(texts: list[str], automaton: LexiconAutomaton) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str | None]]:
    """(row, word number, match, quoted, spelling) of every hit: whether quotation marks stand around
    it as its window shows them, and, if it isn't exact, the word (of masked ones one letter more than the term has)."""
    points, begin = _code_points(texts)
    start, end = _words(points)
    match = automaton.run(points, start, end)
    # a word with masked letters is cut into pieces: every piece that has no match of its own may begin a whole one
    _, stop, first, after = _masked(points, start, end)
    inner = np.repeat(np.arange(len(first)), after - first)
    piece = np.arange(len(inner)) - np.repeat(np.cumsum(after - first) - (after - first), after - first) + first[inner]
    whole = automaton.run(points, start[piece], stop[inner])
    longer = (whole > 0) & (match[piece] == 0)
    match[piece[longer]], end[piece[longer]] = whole[longer], stop[inner[longer]]
    told = end.copy()  # runs of masked words overlap, so they are told by as much as a match can span
    told[piece[longer]] = np.minimum(stop[inner[longer]], start[piece[longer]] + automaton.reach[whole[longer] - 1 >> 1])
    hit = np.flatnonzero(match)
    row = np.searchsorted(begin[1:], start[hit], side="right")
    marks = np.concatenate([[0], np.cumsum(np.isin(points, np.array([ord(c) for c in _QUOTES], np.uint32)))])
    left = marks[start[hit]] - marks[np.maximum(start[hit] - WINDOW_CHARS, begin[row])]
    right = marks[np.minimum(end[hit] + WINDOW_CHARS, begin[row + 1])] - marks[end[hit]]
    raw = points.tobytes()
    spelling = [None if m % 2 == 0 else raw[4 * s : 4 * e].decode("utf-32-le") for m, s, e in zip(match[hit].tolist(), start[hit].tolist(), told[hit].tolist(), strict=True)]
    return row, hit, match[hit], (left % 2 == 1) & (right >= 1), spelling


def _inputs(texts: list[str], automaton: LexiconAutomaton, weight: np.ndarray, known: dict[tuple[int, str], float]) -> np.ndarray:
    """Inputs of the logistic model for each text."""
    row, word, match, quoted, spelling = _hits(texts, automaton)
    n = len(texts)
    value = weight[match]
    for i in np.flatnonzero(match % 2).tolist():
        value[i] = known.get((int(match[i]), spelling[i]), weight[_code(match[i], spelling[i], len(automaton.terms))])
    out = np.zeros((n, 6))
    np.maximum.at(out[:, 0], row[~quoted], value[~quoted])
    np.maximum.at(out[:, 1], row[quoted], value[quoted])
    out[:, 2] = np.log1p(np.bincount(row[~quoted], value[~quoted], n) / BEND)
    out[:, 3] = np.log1p(np.bincount(row[quoted], value[quoted], n) / BEND)
    near = np.zeros(len(row))
    if len(row) > 1:
        close = (row[1:] == row[:-1]) & (np.diff(word) <= WINDOW_WORDS)
        near[1:] += close
        near[:-1] += close
    np.maximum.at(out[:, 4], row, near * (value > 0))
    out[:, 5] = 1
    return out


@dataclass
class Model:
    automaton: LexiconAutomaton
    weight: np.ndarray
    known: dict[tuple[int, str], float]
    coefficients: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_inputs(texts, self.automaton, self.weight, self.known) @ self.coefficients, -30, 30)))


def _map(frame: DataFrame, keep: list[str], schema: str, made) -> DataFrame:
    """``made(texts, kept columns)`` gives the arrays of ``schema`` for each piece of the texts."""
    named = frame.select(*[frame[c].alias(f"k{i}") for i, c in enumerate(keep)], frame["text"].alias("tox_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "tox_text"):
                yield from made([t or "" for t in piece.column(len(keep)).to_pylist()], piece.columns[: len(keep)])

    return small_batches(named).mapInArrow(run, schema)


def _counted(sample: DataFrame, made) -> DataFrame:
    """Number of sampled texts for each (item, y), where ``made(texts)`` gives the distinct items of
    each text; items are summed within a piece before they are shuffled."""

    def pieces(texts: list[str], kept) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for items, y in zip(made(texts), kept[0].to_pylist(), strict=True):
            count.update((x, y) for x in items)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in count], pa.string()), pa.array([k[1] for k in count], pa.float64()), pa.array(count.values(), pa.int64())], names=["item", "y", "n"])

    return _map(sample, ["y"], "item string, y double, n bigint", pieces).groupBy("item", "y").agg(F.sum("n").alias("n"))


def _distinct_words(texts: list[str]) -> Iterator[set[str]]:
    points, begin = _code_points(texts)
    start, end = _words(points)
    cut = np.searchsorted(np.searchsorted(begin[1:], start, side="right"), np.arange(len(texts) + 1))
    raw = points.tobytes()
    for i in range(len(texts)):
        yield {raw[4 * s : 4 * e].decode("utf-32-le") for s, e in zip(start[cut[i] : cut[i + 1]].tolist(), end[cut[i] : cut[i + 1]].tolist(), strict=True)}


def _beginnings(texts: list[str]) -> Iterator[set[str]]:
    """Beginnings of words of each text, up to ``HEAD`` letters."""
    for words in _distinct_words(texts):
        yield {w[:k] for w in {w[:HEAD] for w in words} for k in range(1, len(w) + 1)}


class Stems:
    """Which of given stems the words of a text begin with; of long ones only the lengths that their heads have are tried."""

    def __init__(self, stems: set[str]):
        self.stems, self.longer = frozenset(stems), {}
        for s in stems:
            if len(s) > HEAD:
                self.longer.setdefault(s[:HEAD], set()).add(len(s))

    def __call__(self, texts: list[str]) -> Iterator[set[str]]:
        for short, words in zip(_beginnings(texts), _distinct_words(texts), strict=True):
            long = {w[:k] for w in words if len(w) > HEAD for k in self.longer.get(w[:HEAD], ()) if k <= len(w)}
            yield (short | long) & self.stems


def _long_stems(sample: DataFrame, heads: set[str]) -> set[str]:
    """Words of the sample with one of the ``heads``, and the beginnings at which two neighbours of them part."""
    shared = sample.sparkSession.sparkContext.broadcast(frozenset(heads))
    words = _counted(sample, lambda texts: ({w for w in words if len(w) > HEAD and w[:HEAD] in shared.value} for words in _distinct_words(texts))).select("item").distinct()
    near = words.withColumn("prior", F.lag("item").over(Window.partitionBy(F.substring("item", 1, HEAD)).orderBy("item")))

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, prior = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            common = [commonprefix([a, b]) for a, b in zip(item, prior, strict=True) if b is not None]
            yield pa.RecordBatch.from_arrays([pa.array([*item, *(c for c in common if len(c) > HEAD)], pa.string())], names=["stem"])

    return {r["stem"] for r in near.select("item", "prior").mapInArrow(parted, "stem string").distinct().collect()}  # words of the sample, twice at most


def lexicon(sample: DataFrame, toxic: float, other: float) -> list[str]:
    """Stems that a share of the toxic texts holds and hardly any other text; of stems that extend
    one another and are held by about the same texts, the longest."""
    spark = sample.sparkSession
    bad, least = sample.where("y = 1"), max(3.0, 0.006 * toxic)
    counts = lambda rows, made: {r["item"]: r["n"] for r in _counted(rows, made).where(F.col("n") >= least).collect()}
    held = counts(bad, _beginnings)
    heads = {s for s in held if len(s) == HEAD}
    if heads and (longer := _long_stems(bad, heads)):
        stems = spark.sparkContext.broadcast(Stems(longer))
        held |= counts(bad, lambda texts: stems.value(texts))
    known = spark.sparkContext.broadcast(Stems({*held}))
    clean = {r["item"]: r["n"] for r in _counted(sample.where("y = 0"), lambda texts: known.value(texts)).collect()}
    good = {s: n for s, n in held.items() if (clean.get(s, 0) + 0.5) / (other + 1) * 25 < (n + 0.5) / (toxic + 1)}
    lengths = sorted({len(s) for s in good})
    covered = {t[:k] for t, m in good.items() for k in lengths if k < len(t) and m >= 0.9 * good.get(t[:k], np.inf)}
    kept: set[str] = set()
    for s in sorted(good.keys() - covered, key=len):
        # a stem too short for an edit doesn't stand in for longer ones, which allow it
        if not any(s[:k] in kept for k in lengths if FUZZY_FROM <= k < len(s)):
            kept.add(s)
    return sorted(kept)


def weights(terms: list[str], seen: dict[tuple[int, str], list[float]], toxic: float, other: float) -> tuple[np.ndarray, dict[tuple[int, str], float]]:
    """Weight of each match, and that of each inexact spelling ``seen`` as (match, spelling) -> [other
    texts, toxic texts]: a mean of what its n texts tell (n parts) and of the term's share (one part)."""

    def told(b: float, a: float) -> float:
        return max(0.0, np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (other + 1)) - 1)

    n = len(terms)
    weight = np.zeros(3 * n + 1)
    stray = Counter(_code(m, w, n) for (m, w), (b, a) in seen.items() if m % 2 and b == 1 and not a)
    for k in range(n):
        exact = weight[2 + 2 * k] = told(*seen.get((2 + 2 * k, ""), (0.0, 0.0)))
        for code in (1 + 2 * k, 2 * n + 1 + k):
            weight[code] = max(LEAST_FUZZY_SHARE * exact, FUZZY_SHARE * exact - np.log1p(2 * stray[code]))
    return weight, {(m, w): float((weight[_code(m, w, n)] + (b + a) * told(b, a)) / (1 + b + a)) for (m, w), (b, a) in seen.items() if m % 2}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    sample = labelled_sample(docs, labels, "toxic", most)
    told = sample.agg(F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("toxic")).first()
    toxic, other = told["toxic"], told["n"] - told["toxic"]
    if not toxic or not other:
        mean = toxic / max(told["n"], 1)
        bias = np.array([0, 0, 0, 0, 0, 60.0 * (mean - 0.5)])
        return Model(LexiconAutomaton([]), np.zeros(1), {}, bias)
    automaton = LexiconAutomaton(lexicon(sample, toxic, other))
    shared = sample.sparkSession.sparkContext.broadcast(automaton)

    def matches(texts: list[str]) -> Iterator[set[str]]:
        row, _, match, _, spelling = _hits(texts, shared.value)
        own: list[set[str]] = [set() for _ in texts]
        for r, m, w in zip(row.tolist(), match.tolist(), spelling, strict=True):
            own[r].add(f"{m} {w or ''}")
        return own

    seen: dict[tuple[int, str], list[float]] = {}
    for r in _counted(sample, matches).collect():  # at most the words of the sample that begin like a term
        m, _, w = r["item"].partition(" ")
        seen.setdefault((int(m), w), [0.0, 0.0])[int(r["y"])] += r["n"]
    weight, known = weights(automaton.terms, seen, toxic, other)

    def inputs(texts: list[str], kept) -> Iterator[pa.RecordBatch]:
        x = _inputs(texts, shared.value, weight, known)
        yield pa.RecordBatch.from_arrays([kept[0], pa.array([v.tobytes() for v in x], pa.binary())], names=["y", "x"])

    rows = _map(sample, ["y"], "y double, x binary", inputs).collect()  # six numbers for each sampled row
    x, y = np.array([np.frombuffer(r["x"], float) for r in rows]), np.array([r["y"] for r in rows])
    return Model(automaton, weight, known, _logistic(x, y))


def scores(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, score) of every row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))

    def made(texts: list[str], kept) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([kept[0], pa.array(model.value.score(texts), pa.float64())], names=["doc_id", "score"])

    return _map(docs, ["doc_id"], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double", made)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
