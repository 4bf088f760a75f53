"""Sets of stemmed terms held against texts: a text's words are counted within its row, sets are scored on what was counted."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Scores of so many pairs of a text and a set are held at once, and so many words with what they match.
_CELLS, _WORDS = 1 << 19, 200_000
#: Bytes that stand in no word.
_SPACES = bytes(c if c < 128 and (chr(c).isdigit() or chr(c).islower()) else 32 for c in range(256))


def stem(word: bytes) -> bytes:
    """What ``functions.text.stem`` makes of an ASCII word."""
    n = len(word)
    if word.endswith(b"ies") and n > 4:
        return word[:-3] + b"y"
    if word.endswith(b"ing") and n > 5:
        return word[:-3]
    if word.endswith((b"ed", b"es")) and n > 4 and not word.endswith(b"ses"):
        return word[:-2]
    if word.endswith(b"s") and n > 4 and not word.endswith((b"ss", b"us")):
        return word[:-1]
    return word


def _rows_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists of these sizes, laid out one after the other: the list of each element, and its place there."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class TermSets:
    """Numbered sets of terms (a set may be empty), and the terms that a word matches: an equal one, or one of four letters or more
    that begins the word or is begun by it."""

    def __init__(self, sets: list[tuple[str, ...]]):
        self.terms = {t.encode(): k for k, t in enumerate(sorted({t for s in sets for t in s}))}
        self.longer: dict[bytes, list[int]] = {}
        for t, k in self.terms.items():
            for n in range(2, len(t) if len(t) > 3 else 0):
                self.longer.setdefault(t[:n], []).append(k)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.held = np.array([self.terms[t.encode()] for s in sets for t in s], np.int64)
        self.known: dict[bytes, tuple] = {}

    def index(self, n: int) -> None:
        """The first ``n`` sets by their terms, for ``scores``."""
        self.n = n
        terms, sets = self.held[: self.sizes[:n].sum()], np.repeat(np.arange(n), self.sizes[:n])
        self.sets_of = sets[np.argsort(terms, kind="stable")]
        self.n_sets = np.bincount(terms, minlength=len(self.terms))
        self.first_set = np.cumsum(self.n_sets) - self.n_sets

    def _matched(self, word: bytes) -> tuple:
        said, found = stem(word), ()
        if len(said) > 1:
            begun = [*self.longer.get(said, ()), *(k for n in range(4, len(said)) if (k := self.terms.get(said[:n])) is not None)]
            same = self.terms.get(said, -1)
            found = (same, begun) if begun or same >= 0 else ()
        if len(self.known) >= _WORDS:
            self.known.clear()
        self.known[word] = found
        return found

    def hits(self, said: bytes) -> bytes:
        """Of a text in lower case the terms that its words match, and the points of each: 8 and two for each equal word, else 3."""
        same: dict[int, int] = {}
        begun: set[int] = set()
        for word, n in Counter(said.translate(_SPACES).split()).items():
            if len(word) > 1:
                found = self.known.get(word)
                if found is None:
                    found = self._matched(word)
                if found:
                    if found[0] >= 0:
                        same[found[0]] = same.get(found[0], 0) + n
                    begun.update(found[1])
        points = dict.fromkeys(begun, 3) | {k: 8 + 2 * n for k, n in same.items()}
        return np.array(sorted(points.items()), np.int32).tobytes()

    @staticmethod
    def table(hits: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, points) of several texts' hits."""
        flat = np.frombuffer(b"".join(hits), np.int32).astype(np.int64).reshape(-1, 2)
        return np.repeat(np.arange(len(hits)), [len(h) // 8 for h in hits]), flat[:, 0], flat[:, 1]

    def _worth(self, total: np.ndarray, hit: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return total + hit * hit + np.where(hit == sizes, 10, 0)

    def scores(self, hits: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, set, score) of the indexed sets that texts match, a block of texts at a time."""
        step = max(1, _CELLS // max(self.n, 1))
        for at in range(0, len(hits), step):
            row, term, points = self.table(hits[at : at + step])
            of, k = _rows_of(self.n_sets[term])
            cell = row[of] * self.n + self.sets_of[self.first_set[term][of] + k]
            cells = min(step, len(hits) - at) * self.n
            hit = np.bincount(cell, minlength=cells)
            found = np.flatnonzero(hit)
            total = np.bincount(cell, weights=points[of], minlength=cells)[found].astype(np.int64)
            each = found % self.n
            yield at + found // self.n, each, self._worth(total, hit[found], self.sizes[each])

    def score_of(self, hits: list[bytes], rows: np.ndarray, sets: np.ndarray) -> np.ndarray:
        """The score of each named text against the set named with it; 0 where none matches."""
        used, rows = np.unique(rows, return_inverse=True)
        row, term, points = self.table([hits[k] for k in used.tolist()])
        known = np.append(row * len(self.terms) + term, np.iinfo(np.int64).max)
        of, k = _rows_of(self.sizes[sets])
        wanted = rows[of] * len(self.terms) + self.held[self.begins[sets][of] + k]
        at = np.searchsorted(known, wanted)
        met = known[at] == wanted
        hit = np.bincount(of[met], minlength=len(rows))
        total = np.bincount(of[met], weights=points[at[met]], minlength=len(rows)).astype(np.int64)
        return np.where(hit > 0, self._worth(total, hit, self.sizes[sets]), 0)


def counted(rows: DataFrame, said: str, sets) -> DataFrame:
    """``rows`` whose text (``said``, in lower case; it is dropped) matches a term of ``sets`` (a broadcast of ``TermSets``), with
    their hits."""
    kept = [c for c in rows.columns if c != said]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sets.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(said)).cast(pa.binary())
            hits = [own.hits(t.as_py() or b"") for t in texts]
            some = pa.array([k for k, h in enumerate(hits) if h], pa.int64())
            out = batch.select(kept).take(some)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array([h for h in hits if h], pa.binary())], names=[*kept, "hits"])

    schema = rows.select(kept).schema.add("hits", "binary")
    return rows.mapInArrow(run, schema)


def best_levels(hits: DataFrame, sets, most: int) -> DataFrame:
    """(set, score, size): how many texts (``hits``: hits, size) have the best scores of each set; of the scores of a task those that
    fewer than ``most`` of its texts are above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, wide = sets.value, 1 << 40
        key, size, least = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(sets.value.n, np.int64)

        def merged(key: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            # sets one after the other, in each the highest score first
            key, at = np.unique(key, return_inverse=True)
            size = np.bincount(at, weights=size, minlength=len(key)).astype(np.int64)
            first = np.searchsorted(key, key // wide * wide)
            above = np.cumsum(size) - size
            above -= above[first] if len(key) else 0
            some = above < most
            full = some & (above + size >= most)
            least[key[full] // wide] = wide - 1 - key[full] % wide
            return key[some], size[some]

        for batch in batches:
            texts, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for row, each, score in own.scores(texts):
                some = score >= least[each]
                key, size = merged(np.append(key, each[some] * wide + wide - 1 - score[some]), np.append(size, n[row[some]]))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key // wide, wide - 1 - key % wide, size)], names=["set", "score", "size"])

    each = hits.select("hits", "size").mapInArrow(run, "set bigint, score bigint, size bigint")
    return each.groupBy("set", "score").agg(F.sum("size").alias("size"))


def opened(hits: DataFrame, sets, least, classes) -> DataFrame:
    """(key, class, query_score, own): texts (``hits``: key, hits) and the classes for whose set they score ``least`` (by set) or
    more; ``own`` is the score of the class's other set. ``classes``: names, sets and other sets (-1: none), in the order of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, floor, (names, set_of, other) = sets.value, least.value, classes.value
        of_set = np.bincount(set_of, minlength=own.n)
        first, step = np.cumsum(of_set) - of_set, max(1, 65_536 // of_set.max(initial=1))
        names = pa.array(names)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for row, each, score in own.scores(texts):
                some = score >= floor[each]
                row, each, score = row[some], each[some], score[some]
                for at in range(0, len(row), step):
                    r, e, s = (x[at : at + step] for x in (row, each, score))
                    of, k = _rows_of(of_set[e])
                    met = first[e][of] + k
                    asked = np.flatnonzero(other[met] >= 0)
                    pair, back = np.unique(r[of][asked] * len(own.sizes) + other[met][asked], return_inverse=True)
                    worth = np.zeros(len(of), np.int64)
                    worth[asked] = own.score_of(texts, pair // len(own.sizes), pair % len(own.sizes))[back]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r[of])), names.take(pa.array(met)), pa.array(s[of]), pa.array(worth)], names=["key", "class", "query_score", "own"])

    return hits.select("key", "hits").mapInArrow(run, "key binary, class string, query_score bigint, own bigint")
