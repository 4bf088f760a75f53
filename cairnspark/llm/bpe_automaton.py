"""BPE encoding and decoding by a deterministic tokenization automaton.

The automaton reads tokens; its states are named by the token read last (every arc labelled ``x``
leads to one state ``S[x]``), and a token sequence has a path exactly if it is what the merge list
produces. It is built by one gadget per merge ``(a, b) -> c``, in the order of the list:

* the arc ``b`` is taken out of ``S[a]`` (a followed by b is no longer a right tokenization);
* ``S[c]`` starts as a copy of ``S[b]`` as it was before this merge;
* every state with an arc ``a`` gets an arc ``c``.

An explicit arc table would have (number of tokens)^2 entries, so the gadgets are kept as three
tables (left part, right part, time of each token; time of each merged pair) and an arc is looked
up by following them back in time: an arc on a younger token exists if the arc on its left part did
when it was made, a younger state has the arcs that the state of its right part had. Each text word
is spelled along the token trie, and the one allowed path is found position by position, for many
words at once. Decoding emits the labels of the arcs.

Defined results: a null text is empty and has no tokens; repeated rows are encoded each; other
columns are ignored; any length of text works (memory follows the text, words are cached up to
``CACHE_WORDS`` for speed only).
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ._util import slices, small_batches, table

#: Fixed value: the pattern by which byte-level vocabularies of this family split text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts without characters beyond Latin letters, in the standard library's syntax,
#: which runs faster: there every word character but digits and the underscore is a letter.
_SPLIT_LATIN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
_BEYOND_LATIN = "[^\\x00-\\x1b\\x20-\\x84\\x86-\u024f]|[\u00b2\u00b3\u00b9\u00bc-\u00be]"
#: A lone surrogate can't be in a text.
_MARK = "\ud800"
CACHE_WORDS = 250_000
_CHUNK = 8_000
_NEVER = np.int32(2**31 - 1)


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class MergeAutomaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], specials: dict[str, int]):
        symbols = _byte_symbols()
        number: dict[str, int] = {s: b for s, b in symbols.items()}
        labels = [bytes([b]) for b in range(256)]
        left, right = [0] * 256, [0] * 256
        pairs: dict[int, int] = {}
        for a, b in merges:
            x, y = number[a], number[b]
            if a + b in number:
                raise ValueError(f"token {a + b!r} has two merges")
            number[a + b] = len(labels)
            labels.append(labels[x] + labels[y])
            left.append(x)
            right.append(y)
            pairs[x << 20 | y] = len(labels) - 256
        n = len(labels)
        self.left, self.right = np.array(left, np.int32), np.array(right, np.int32)
        self.time = np.maximum(np.arange(n, dtype=np.int32) - 255, 0)
        order = np.argsort(np.fromiter(pairs, np.int64, len(pairs)))
        self.pair_key = np.fromiter(pairs, np.int64, len(pairs))[order]
        self.pair_time = np.fromiter(pairs.values(), np.int32, len(pairs))[order]
        self._hash_pairs()
        self.ids = np.zeros(n, np.int32)
        for s, k in number.items():
            self.ids[k] = vocab[s]
        self.specials = dict(specials)
        self._labels(labels)
        self._trie(labels)

    @classmethod
    def from_file(cls, path: str) -> MergeAutomaton:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in told["model"]["merges"]]
        return cls(told["model"]["vocab"], merges, {t["content"]: t["id"] for t in told["added_tokens"]})

    def _hash_pairs(self) -> None:
        """Open addressing for pair -> merge time."""
        size = 1 << 19
        while size < 8 * len(self.pair_key):
            size *= 2
        self.slots = size - 1
        self.slot_key, self.slot_time = np.full(size, -1, np.int64), np.full(size, _NEVER, np.int32)
        todo, step = np.arange(len(self.pair_key)), 0
        self.probes = 0
        while len(todo):
            at = (self._slot(self.pair_key[todo]) + step) & self.slots
            free = self.slot_key[at] < 0
            _, first = np.unique(at, return_index=True)
            take = np.zeros(len(todo), bool)
            take[first] = True
            take &= free
            self.slot_key[at[take]] = self.pair_key[todo[take]]
            self.slot_time[at[take]] = self.pair_time[todo[take]]
            todo, step = todo[~take], step + 1
            self.probes = step

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.slots

    def _merge_time(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x.astype(np.int64) << 20 | y
        slot = self._slot(key)
        out = np.where(self.slot_key[slot] == key, self.slot_time[slot], _NEVER)
        open_ = np.flatnonzero((self.slot_key[slot] >= 0) & (self.slot_key[slot] != key))
        for step in range(1, self.probes):
            if not len(open_):
                break
            at = (slot[open_] + step) & self.slots
            held = self.slot_key[at]
            hit = held == key[open_]
            out[open_[hit]] = self.slot_time[at[hit]]
            open_ = open_[~hit & (held >= 0)]
        return out

    def _labels(self, labels: list[bytes]) -> None:
        most = max([*self.ids.tolist(), *self.specials.values()]) + 1
        by_id = [b""] * most
        for k, label in enumerate(labels):
            by_id[self.ids[k]] = label
        for s, k in self.specials.items():
            by_id[k] = s.encode()
        self.label_at = np.concatenate([[0], np.cumsum([len(x) for x in by_id])]).astype(np.int64)
        self.label_data = np.frombuffer(b"".join(by_id), np.uint8)

    def _trie(self, labels: list[bytes]) -> None:
        child: dict[int, int] = {}
        token = [-1]
        for k, label in enumerate(labels):
            node = 0
            for b in label:
                nxt = child.get(node << 8 | b)
                if nxt is None:
                    nxt = child[node << 8 | b] = len(token)
                    token.append(-1)
                node = nxt
            token[node] = k
        self.node_token = np.array(token, np.int32)
        keys = np.fromiter(child, np.int64, len(child))
        order = np.argsort(keys)
        self.arc_key, self.arc_to = keys[order], np.fromiter(child.values(), np.int32, len(child))[order]
        node_of = (self.arc_key >> 8).astype(np.int64)
        self.arc_from = np.searchsorted(node_of, np.arange(len(token) + 1))
        # first two bytes at once: most spellings end there
        self.root = np.full(256, -1, np.int32)
        first = slice(self.arc_from[0], self.arc_from[1])
        self.root[self.arc_key[first] & 255] = self.arc_to[first]
        self.second = np.full((256, 256), -1, np.int32)
        for b in range(256):
            if self.root[b] >= 0:
                part = slice(self.arc_from[self.root[b]], self.arc_from[self.root[b] + 1])
                self.second[b, self.arc_key[part] & 255] = self.arc_to[part]

    def allowed(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether state S[x] has an arc y, with all gadgets applied."""
        out = np.ones(len(x), bool)
        live = np.arange(len(x))
        until = np.full(len(x), _NEVER - 1, np.int32)
        while len(live):
            gone = self._merge_time(x, y) <= until
            out[live[gone]] = False
            tx, ty = self.time[x], self.time[y]
            go = ~gone & ((tx > 0) | (ty > 0))
            live, x, y, tx, ty = live[go], x[go], y[go], tx[go], ty[go]
            until = np.where(ty > tx, ty, tx - 1)
            x, y = np.where(tx >= ty, self.right[x], x), np.where(ty >= tx, self.left[y], y)
        return out

    def _spellings(self, data: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, token) of every token that is spelled at any place; ``room``: bytes left
        in the word."""
        at = np.arange(len(data))
        found = [(at, np.ones(len(at), np.int32), self.node_token[self.root[data]])]
        at = at[room > 1]
        node = self.second[data[at], data[at + 1]]
        length = 2
        while True:
            at, node = at[node >= 0], node[node >= 0]
            if not len(at):
                break
            token = self.node_token[node]
            some = token >= 0
            found.append((at[some], np.full(int(some.sum()), length, np.int32), token[some]))
            more = room[at] > length
            at, node = at[more], node[more]
            key = node.astype(np.int64) << 8 | data[at + length]
            slot = np.minimum(np.searchsorted(self.arc_key, key), len(self.arc_key) - 1)
            node = np.where(self.arc_key[slot] == key, self.arc_to[slot], -1)
            length += 1
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(vocabulary ids of all words one after the other, number of ids of each word)."""
        got = [self._encode_chunk(words[i : i + _CHUNK]) for i in range(0, len(words), _CHUNK)]
        if not got:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*got, strict=True))

    def _encode_chunk(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words], np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])
        word = np.repeat(np.arange(len(words)), size)
        inner = np.arange(len(data)) - begin[word]
        start, length, token = self._spellings(data, size[word] - inner)
        # a place before each byte and one behind each word
        place, goal = start + word[start], start + length + word[start]
        rank = inner[start] + length
        order = np.lexsort((-length, goal, rank))
        start, place, goal, token, rank = start[order], place[order], goal[order], token[order], rank[order]
        last = np.full(len(data) + len(words) + 1, -1, np.int32)
        back = np.zeros(len(last), np.int64)
        heads = inner[start] == 0
        cuts = np.searchsorted(rank, np.arange(1, int(size.max(initial=0)) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            todo = np.arange(a, b)
            while len(todo):  # the longest token that ends at each place first, then the next one
                lead = np.ones(len(todo), bool)
                lead[1:] = goal[todo[1:]] != goal[todo[:-1]]
                now = todo[lead]
                fits = heads[now].copy()
                ask = np.flatnonzero(~fits)
                fits[ask] = self.allowed(last[place[now[ask]]], token[now[ask]])
                done = now[fits]
                last[goal[done]], back[goal[done]] = token[done], place[done]
                todo = todo[~lead]
                todo = todo[last[goal[todo]] < 0]
        at = begin[1:] + np.arange(len(words))
        head = begin[:-1] + np.arange(len(words))
        who, who_all, tok_all = np.arange(len(words)), [], []
        at, who = at[size > 0], who[size > 0]
        while len(at):
            who_all.append(who)
            tok_all.append(self.ids[last[at]])
            at = back[at]
            go = at > head[who]
            at, who = at[go], who[go]
        if not who_all:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        step = np.repeat(np.arange(len(who_all)), [len(x) for x in who_all])
        who, tok = np.concatenate(who_all), np.concatenate(tok_all)
        return tok[np.lexsort((-step, who))], np.bincount(who, minlength=len(words))

    def decode(self, ids: np.ndarray) -> bytes:
        """The labels of the arcs, one after the other."""
        return self.label_data[spread(self.label_at[ids], self.label_at[ids + 1] - self.label_at[ids])].tobytes()


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, one run after the other."""
    if not len(size):
        return np.zeros(0, np.int64)
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))


class _Numbers(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """Texts to ids and back, with a bounded cache of words."""

    def __init__(self, automaton: MergeAutomaton, cache_words: int = CACHE_WORDS):
        self.automaton, self.most = automaton, cache_words
        self.find = regex.compile(SPLIT).findall
        self.find_latin = re.compile(_SPLIT_LATIN).findall
        self.beyond_latin = re.compile(_BEYOND_LATIN).search
        names = sorted(automaton.specials, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.names = names
        digits = [b"%d," % i for i in range(len(automaton.label_at) - 1)]
        self.digit_at = np.concatenate([[0], np.cumsum([len(d) for d in digits])]).astype(np.int64)
        self.digit_data = np.frombuffer(b"".join(digits), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.number = _Numbers()
        self.at, self.size = np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _learn(self) -> None:
        """Encode the words that were numbered since the last call."""
        known = len(self.size)
        if len(self.number) == known:
            return
        new = list(itertools.islice(self.number, known, None))
        marks = [i for i, w in enumerate(new) if w[:1] == _MARK]
        ids, size = self.automaton.encode_words([b"" if w[:1] == _MARK else w.encode() for w in new])
        for i in reversed(marks):
            ids = np.insert(ids, int(size[:i].sum()), self.automaton.specials[new[i][1:]])
            size[i] = 1
        self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])
        self.at = np.concatenate([[0], np.cumsum(self.size)])

    def split(self, text: str) -> list[str]:
        """Words; a special token in the text is a word behind a mark that no word begins with."""
        find = self.find if self.beyond_latin(text) else self.find_latin
        if self.special is None or not any(n in text for n in self.names):
            return find(text)
        return [w for i, part in enumerate(self.special.split(text)) for w in ([_MARK + part] if i % 2 else find(part))]

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[bytes, np.ndarray]]:
        """(decimal ids joined by commas, ids) of each text."""
        if len(self.number) > self.most:
            self._forget()
        split = [self.split(t) for t in texts]
        count = np.array([len(x) for x in split], np.int64)
        number = np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(count.sum()))
        del split
        self._learn()
        size = self.size[number]
        ids = self.ids[spread(self.at[number], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])]
        for a, b in itertools.pairwise(ends.tolist()):
            one = ids[a:b]
            said = self.digit_data[spread(self.digit_at[one], self.digit_at[one + 1] - self.digit_at[one])]
            yield said[:-1].tobytes(), one


_own: dict[str, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder for each Python worker and vocabulary, so that the cache outlives a task."""
    automaton = shared.value
    mark = hashlib.sha256(automaton.pair_key.tobytes() + automaton.ids.tobytes() + repr(sorted(automaton.specials.items())).encode()).hexdigest()
    if mark not in _own:
        _own.clear()
        _own[mark] = Encoder(automaton)
    return _own[mark]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str, keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """The ``keep`` columns (default doc_id) with ``n_tokens``, ``ids_sha256``, ``decoded_sha256``
    and, if asked for, ``ids`` (array<int>). The automaton that is broadcast has the size of the
    vocabulary."""
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(MergeAutomaton.from_file(path))
    named = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], docs["text"].alias("bpe_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for piece in slices(batch, "bpe_text"):
                texts = [t or "" for t in piece.column(len(keep)).to_pylist()]
                size, said, back, all_ids = [], [], [], []
                for digits, ids in encoder.encode_batch(texts):
                    text = encoder.automaton.decode(ids).decode("utf-8", "replace")
                    size.append(len(ids))
                    said.append(hashlib.sha256(digits).hexdigest())
                    back.append(hashlib.sha256(text.encode()).hexdigest())
                    all_ids.append(ids)
                made = [pa.array(size, pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                    made.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *all_ids]))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(keep)], *made], names=[*piece.schema.names[: len(keep)], *names])

    schema = "".join(f"k{i} {named.schema[f'k{i}'].dataType.simpleString()}, " for i in range(len(keep)))
    ddl = schema + "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return small_batches(named).mapInArrow(run, ddl).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), vocabulary_path(), with_ids=False)
