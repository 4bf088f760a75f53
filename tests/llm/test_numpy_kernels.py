"""Kernels and automata without Spark, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cairnspark.llm import _text, html_extraction, ngram_jaccard, suffix_dedup, toxicity
from cairnspark.llm._util import slices, text_buffers
from cairnspark.llm.bpe_automaton import Encoder, MergeAutomaton, vocabulary_path
from cairnspark.llm.secret_scan import RULES, trigram_query

TEXTS = ["", None, "one", "one two three four five six", "ä\tB\x0bc\x0c d\re\n f", "x" * 5000, "a b " * 700]


def test_words_are_maximal_runs_within_rows():
    data, offsets = text_buffers(pa.array(TEXTS))
    _, row, start, end = _text.words(_text.LOWER[data], offsets, _text.NOT_SPACE)
    got = [[] for _ in TEXTS]
    for r, a, b in zip(row, start, end, strict=True):
        got[r].append(_text.LOWER[data[a:b]].tobytes())
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    assert got == [(t or "").encode().translate(lower).split() for t in TEXTS]


def test_slices_cover_every_row_once():
    batch = pa.record_batch([pa.array(TEXTS), pa.array(range(len(TEXTS)))], names=["t", "i"])
    for most in (1, 3000, 1 << 20):
        assert [i for p in slices(batch, "t", most) for i in p.column(1).to_pylist()] == list(range(len(TEXTS)))


def test_shingle_sets_match_brute_force():
    sets = ngram_jaccard.shingle_sets(pa.array([*TEXTS, "a b c d", "A  B c D", "a b c", "a b c d e"]))
    assert [len(s) for s in sets[:4]] == [0, 0, 1, 2]
    assert sets[-4].tolist() == sets[-3].tolist() != sets[-2].tolist()
    assert len(sets[6]) == 2


@pytest.mark.parametrize("seed", range(3))
def test_prefixes_share_enough_and_bitmaps_never_exclude(seed):
    r = np.random.default_rng(seed)
    sketch = r.integers(0, 50, 1 << 20).astype(np.uint32)
    for _ in range(200):
        n = int(r.integers(5, 120))
        x = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[r.random(len(x)) > 0.1], r.integers(0, 1 << 63, n // 10, dtype=np.uint64)]))
        if not len(y):
            continue
        common = len(np.intersect1d(x, y))
        if 100 * common >= 80 * (len(x) + len(y) - common):
            (lx, px), (ly, py) = (ngram_jaccard.matches_and_prefix(s, sketch, 30.0) for s in (x, y))
            assert len(np.intersect1d(px, py)) >= min(lx, ly)
            a, b = (np.frombuffer(ngram_jaccard.parity_bitmap(s), np.uint64) for s in (x, y))
            least = min(len(a), len(b))
            differ = np.bitwise_count(ngram_jaccard._fold(a, least) ^ ngram_jaccard._fold(b, least)).sum()
            assert ngram_jaccard.may_link(np.array([len(x)]), np.array([len(y)]), np.array([differ]), 80)[0]


def test_equal_strings_hold_equal_samples():
    random.seed(4)
    core = "".join(random.choice("ab cd") for _ in range(160))
    texts = ["".join(random.choice("xyz ") for _ in range(n)) + core + "".join(random.choice("uvw ") for _ in range(n)) for n in (0, 90, 300)]
    row, place, _, _, name, *_ = suffix_dedup.samples(pa.array(texts))
    shared = set.intersection(*[set(name[row == i].tolist()) for i in range(3)])
    assert shared
    assert not len(suffix_dedup.samples(pa.array(["", "x" * 99, None]))[0])
    assert len(suffix_dedup.samples(pa.array(["x" * 400]))[0])


@pytest.mark.parametrize("least", [5, 6])
def test_lexicon_automaton_matches_edit_distance(least):
    def distance(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
                if i > 1 and j > 1 and a[i - 2 : i] == b[j - 2 : j][::-1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    random.seed(least)
    terms = ["scum", "idiot", "idoit", "pathetic", "réeux", "worthless"]
    automaton = toxicity.LexiconAutomaton(terms, least)
    words = ["".join(random.choice("idotscumrwhe") for _ in range(random.randint(1, 9))) for _ in range(400)]
    for t in terms:
        for _ in range(60):
            w = list(t + random.choice(["", "s", "ung"]))
            i = random.randrange(len(w))
            words.append("".join(random.choice([w[:i] + w[i + 1 :], [*w[:i], "q", *w[i:]], [*w[:i], "z", *w[i + 1 :]], [*w[:i], *w[i : i + 2][::-1], *w[i + 2 :]], w])))
    words = [w for w in words if w]
    points = np.frombuffer(" ".join(words).encode("utf-32-le"), np.uint32)
    start, end = toxicity._words(points)
    got = automaton.run(points, start, end)
    for w, g in zip(words, got.tolist(), strict=True):
        exact = [i for i, t in enumerate(automaton.terms) if w.startswith(t)]
        fuzzy = [i for i, t in enumerate(automaton.terms) if len(t) >= least and any(distance(w[:k], t) <= 1 for k in range(len(w) + 1))]
        assert g == (2 + 2 * max(exact) if exact else 1 + 2 * max(fuzzy) if fuzzy else 0), w


def test_trigram_queries():
    by = {r.kind: trigram_query(r.pattern) for r in RULES}
    assert by["hex"] is None
    assert by["access"] == [frozenset({"aki", "kia"})]
    assert frozenset({"tok", "oke", "ken"}) in by["assign"] and len(by["assign"]) == 6
    assert trigram_query("ab.cd") is None
    assert trigram_query("(abc|d)xyz") == [frozenset({"abc", "bcx", "cxy", "xyz"}), frozenset({"dxy", "xyz"})]
    assert trigram_query("(abc|.)") is None


def test_html_blocks():
    page = (
        "<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><a>Menu</a></nav><!-- x <p>no -->"
        "<div class='cookie-notice'>We use</div><article><h1>Head &amp; more</h1><p>One <b>two</b><br>three<p>Four&nbsp;five"
        "<ul><li>a<li>b</ul><div class=ad>Buy</div><form><input>Send</form><section id=comments><p>Reader</p></section></article>"
        "<footer>&copy; us</footer></body></html>"
    )
    assert html_extraction.blocks(page)[0] == ["Head & more", "One two three", "Four five", "a", "b"]
    for odd in (None, "", "plain", "<", "<p", "<!--", "<script>", "</p></p>", "<p>" * 300 + "x", "<b><i>" * 2000 + "deep"):
        html_extraction.blocks(odd)
    assert html_extraction.blocks("plain <b>text</b>")[0] == ["plain text"]


def test_tokens_match_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = vocabulary_path()
    automaton, library = MergeAutomaton.from_file(path), tokenizers.Tokenizer.from_file(path)
    random.seed(2)
    texts = ["", " ", "Hello <|endoftext|> x<|endoftext|>", "\x1c \x85  　x​ ²³ 𝟘٣ñ́ 中文 👩‍👩‍👧 don't I'LL we're", "-" * 999, "aaaa" * 50, "\n\n  a\t\t"]
    texts += ["".join(random.choice("aehinrst 'é中1.\n") for _ in range(200)) for _ in range(300)]
    encoder = Encoder(automaton, 200)
    for part in (texts[:100], texts[100:], texts[:50]):
        for text, (said, ids) in zip(part, encoder.encode_batch(part), strict=True):
            expected = library.encode(text, add_special_tokens=False).ids
            assert ids.tolist() == expected and said.decode() == ",".join(map(str, expected))
            assert automaton.decode(ids).decode() == library.decode(expected, skip_special_tokens=False) == text


def test_arcs_are_those_of_the_gadgets():
    """The table of arcs built explicitly, merge by merge, on a small list of merges."""
    merges = [("a", "b"), ("ab", "a"), ("b", "b"), ("a", "a"), ("aa", "aa"), ("ab", "ab"), ("b", "ab")]
    automaton = MergeAutomaton({c: i for i, c in enumerate([*"ab", *[x + y for x, y in merges]])} | {chr(256 + i): 100 + i for i in range(256)} | {chr(i): 400 + i for i in range(0x21, 0x100) if chr(i) not in "ab"}, merges, {})
    number = {"a": ord("a"), "b": ord("b")} | {x + y: 256 + i for i, (x, y) in enumerate(merges)}
    arcs = {t: {"a", "b"} for t in ("a", "b")}
    for x, y in merges:
        copied = set(arcs[y])
        arcs[x].discard(y)
        arcs[x + y] = copied
        for state in arcs.values():
            if x in state:
                state.add(x + y)
    for s, out in arcs.items():
        for t in number:
            assert automaton.allowed(np.array([number[s]], np.int32), np.array([number[t]], np.int32))[0] == (t in out), (s, t)


def thue_morse(size, flip=False):
    """Two such words (one with letters exchanged) collide under polynomial hashes modulo 2^64."""
    return "".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(size))


@pytest.mark.parametrize("size", [64, 200, 1024, 4096])
def test_hashes_tell_thue_morse_words_apart(size):
    x, y = thue_morse(size), thue_morse(size, True)
    a, b, c = ngram_jaccard.shingle_sets(pa.array([x, y, x]))
    assert a.tolist() == c.tolist() != b.tolist()
    for which in (0, 1):
        data, offsets = text_buffers(pa.array([x, y]))
        h = _text.span_hash(data, _text.lanes(data), offsets[:-1], offsets[1:], which)
        assert h[0] != h[1]


def test_span_hashes_depend_on_the_bytes_alone():
    text = "".join(random.Random(3).choice("abcd") for _ in range(700))
    data, _ = text_buffers(pa.array([text + "|" + text]))
    lane = _text.lanes(data)
    for size in (0, 1, 7, 8, 9, 31, 64, 255, 256, 257, 600):
        start = np.arange(0, 700 - size, 13)
        assert (_text.span_hash(data, lane, start, start + size) == _text.span_hash(data, lane, start + 701, start + 701 + size)).all()


def test_similar_counts_word_shingles():
    r = random.Random(5)
    for _ in range(300):
        x = [r.choice("abcdefgh") for _ in range(r.randint(0, 40))]
        y = [w if r.random() > 0.02 else "z" for w in x]
        sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (x, y)]
        want = bool(x and y) and 100 * len(sets[0] & sets[1]) >= 80 * len(sets[0] | sets[1])
        assert ngram_jaccard.similar(" ".join(x).encode(), "\t".join(y).upper().encode(), 5, 80) == want
