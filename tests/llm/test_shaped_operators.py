"""License scan, fill-in-middle and sequenced changes against brute force, on odd rows."""

import hashlib
import math
import random
import re
import zlib
from datetime import datetime, timedelta

import pytest

from cairnspark.llm import fill_in_middle, license_scan, quote_linking, sequenced_changes

DOCS = "doc_id bigint, text string, row string, n int, label string"
TEXTS = [
    None, "", " ", "\t\n x", "one", "Under the MIT License, or the Apache License, Version 2.0; CC-BY-NC-ND 4.0",
    "under the mit license " * 400, "mit Geduld under the MIT  licenses under the mit\n\nlicense", " under the mit license",
    "SPDX-License-Identifier: GPL-3.0-or-later\nThis is GNU General Public License v3", "a <P> b c", "ß😀   ü  " * 9, "x" * 5000,
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. The MIT License",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "r", 1, "l") for i, t in enumerate(TEXTS * 5)] + [(None, TEXTS[5], "r", 1, "l"), (3, TEXTS[6], "r", 1, "l"), (3, TEXTS[6], "r", 1, "l"), (None, "a b c d e f", "r", 1, "l"), (0, "a b c d e f", "r", 1, "l")]
    return spark.createDataFrame(rows, DOCS)


def _licenses(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places = {0: 0}
    for w in words:
        places[max(places) + len(w) + 1] = len(places)
    said = " ".join(words)

    def found(rule):
        held = re.compile(rf"(?<!\S)(?:{rule.pattern})(?!\S)".replace(r"\S", "[^ ]"))
        at = 0
        while (m := held.search(said, at)) and m.end() > m.start():
            yield places[m.start()], places.get(m.end() + 1, len(words)), rule
            at = m.end()

    base = [(a, label) for phrase, label in license_scan.BASE for a, _, _ in found(license_scan.Rule(label, 0, phrase))]
    all_ = [(a, b, i, r) for i, rule in enumerate(license_scan.RULES) for a, b, r in found(rule)]
    kept = [
        x for x in all_
        if not any(y[0] < x[1] and x[0] < y[1] and (y[3].level < x[3].level or y[3].level == x[3].level and y[0] <= x[0] and y[1] >= x[1] and (y[1] - y[0] > x[1] - x[0] or y[2] < x[2])) for y in all_)
    ]
    starts = [a for a, _ in base]
    labels = {label for _, label in base}
    sure = [license_scan.WEIGHTS[0]] * bool(base) + [license_scan.WEIGHTS[x[3].level] for x in kept]
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x[3].label for x in kept})), max(sure, default=0.0)


def test_licenses_equal_brute_force(docs):
    got = sorted((tuple(r) for r in license_scan.report(docs).collect()), key=repr)
    assert got == sorted(((r["doc_id"], *_licenses(r["text"])) for r in docs.collect()), key=repr)


def test_every_signature_finds_itself(spark):
    """A text made of a rule's words is found by that rule or by one that contains it, and the prefilter lets it pass."""
    plain = lambda p: re.sub(r"  +", " ", re.sub(r"\[[0-9^]([^\]]*)\]\*?\+?", "1", re.sub(r"\(([^()|]*)[^()]*\)\?", "", re.sub(r"\(([^()|]*)[^()]*\)(?!\?)", r"\1", p.replace("[^ ]", "[0-9]").replace(" ?", " "))))).strip()
    rows = [(i, plain(r.pattern)) for i, r in enumerate(license_scan.RULES)]
    rows = [(i, t) for i, t in rows if re.fullmatch(license_scan.RULES[i].pattern, t)]
    assert len(rows) > 250
    done = {r["row"]["doc_id"]: {x["ord"] for x in r["kept"]} for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(done[i] for i, _ in rows)
    assert all(license_scan.Rule("x", 1, r.pattern).keys for r in license_scan.RULES)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert license_scan.report(none).count() == 0
    assert fill_in_middle.transform(none).count() == 0


def _middle(doc_id, text):
    text = text or ""
    x = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return len(units), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


@pytest.mark.parametrize("most", [0, 500_000])
def test_middles_equal_brute_force(docs, monkeypatch, most):
    monkeypatch.setattr(fill_in_middle, "BROADCAST_ROWS", most)
    done = fill_in_middle.transform(docs)
    got = sorted(((r["row"]["doc_id"], r["row"]["row"], *r[2:]) for r in done.collect()), key=repr)
    assert got == sorted(((r["doc_id"], "r", *_middle(r["doc_id"], r["text"])) for r in docs.collect()), key=repr)
    assert {g[3] for g in got} == {"plain", "psm", "spm"}
    assert not done.where(fill_in_middle.restored(done["output"], done["form"]) != done["text"]).count()


CHANGES = "change_id bigint, client_id bigint, seq bigint, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double, n string"


def _changes(many: int) -> list[tuple]:
    draw = random.Random(7)
    out = []
    for i in range(many):
        client = draw.choice([0, 0, 0, 1, 2, 3, None, draw.randrange(4, 30)])
        at = datetime(2024, 1, 1) + timedelta(days=draw.randrange(0, 40))
        out.append((i, client, draw.choice([None, *range(60)]) if client == 0 else draw.randrange(8), draw.choice("IUUUD"), None if i % 50 == 0 else at, "s", "g", draw.choice([None, "A", "B"]), draw.choice([None, 1.005, -2.5]), "x"))
    return out + out[:40] + [(None, 1, 1, "I", datetime(2024, 1, 2), "s", "g", "A", 1.0, "x"), (many, 1, 2, None, datetime(2024, 1, 2), "s", "g", "A", 1.0, "x")]


def _in_order(rows: list[tuple], batches: int, days: int) -> list[tuple]:
    rows = sorted(set(rows), key=repr)
    ranks = {}
    for r in rows:
        ranks.setdefault(r[1], set()).add(r[2])
    ranks = {c: {s: k for k, s in enumerate(sorted(seqs, key=lambda s: (s is not None, s or 0)), 1)} for c, seqs in ranks.items()}
    fed, state, out, seen = {}, {}, [], None
    for cid, client, seq, op, at, _, _, city, balance, _ in rows:
        if at is None or cid is None or (h := zlib.crc32(str(cid).encode())) % 11 == 0:
            continue
        day = (at - datetime(1970, 1, 1)).days + 9 * (h % 4)
        fed.setdefault(max(1, min(batches, 1 + (day - 19723) * batches // days)), []).append((day, cid, client, ranks[client][seq], op, city, balance))

    def drain(s, b, missed=0):
        while change := s["held"].pop(s["next"], None):
            _, cid, client, n, op, city, balance = change
            if op == "I":
                s["city"], s["balance"] = city, balance
            elif op == "U":
                s["city"], s["balance"] = s["city"] if city is None else city, s["balance"] if balance is None else balance
            elif op == "D":
                s["city"] = s["balance"] = None
            s["next"], s["last"] = n + 1, (len(out), op)
            out.append([cid, client, "applied", b, missed, s["city"], s["balance"], False])
            missed = 0

    for b in range(1, batches + 2):
        for s in state.values():
            while s["held"] and (b > batches or seen is not None and min(x[0] for x in s["held"].values()) + 3 <= seen):
                n = min(s["held"])
                missed, s["next"] = n - s["next"], n
                drain(s, b, missed)
        for change in sorted(fed.get(b, []), key=lambda r: r[:2]):
            s = state.setdefault(change[2], {"next": 1, "held": {}, "city": None, "balance": None, "last": None})
            if change[3] in s["held"] or change[3] < s["next"]:
                out.append([change[1], change[2], "rejected", b, 0, None, None, False])
            else:
                s["held"][change[3]] = change
                drain(s, b)
        seen = max([x[0] for x in fed.get(b, [])] + ([] if seen is None else [seen]), default=None)
    for s in state.values():
        if s["last"] and s["last"][1] != "D":
            out[s["last"][0]][-1] = True
    return [tuple(r) for r in out]


def test_changes_equal_brute_force(spark, monkeypatch):
    """Also with stores for a few waiting changes only, which puts them in blocks of state, few of them in memory."""
    for name, value in (("FEW", 2), ("BLOCK", 4), ("MOST_BLOCKS", 2), ("GROUP", 8)):
        monkeypatch.setattr(sequenced_changes, name, value)
    rows = _changes(600)
    fed = sequenced_changes.in_batches(spark.createDataFrame(rows, CHANGES), batches=5, days=60)
    done = sequenced_changes.apply_changes(fed, 5).select("change_id", "client_id", "status", "batch", "missed", "city", "balance", "current").collect()
    want = _in_order(rows, 5, 60)
    assert sorted(map(tuple, done), key=repr) == sorted(want, key=repr)
    assert {r[3] for r in want if r[2] == "applied"} >= {1, 3, 4, 5} and any(r[4] for r in want) and any(r[2] == "rejected" for r in want)


def test_ticks_are_aimed(spark, tmp_path):
    """Only clients whose earliest held change has expired get a clock row; an empty table runs through."""
    assert sequenced_changes.apply_changes(sequenced_changes.in_batches(spark.createDataFrame([], CHANGES), batches=1), 1).count() == 0
    made = "client_id bigint, n bigint, day int, change_id bigint, op string, city string, balance double"
    feed = sequenced_changes.Feed(spark, str(tmp_path), 3)
    feed.tick(spark.createDataFrame([(1, 2, 10, 1, "I", "A", 1.0), (2, 1, 10, 2, "I", "B", 1.0), (3, 5, 12, 3, "I", "C", 1.0)], made), 1, None)
    feed.tick(spark.createDataFrame([], made), 2, 13)
    fed = spark.read.parquet(str(tmp_path / "feed"))
    assert [r["client_id"] for r in fed.where("n is null").collect()] == [1]
    assert sorted((r["change_id"], r["batch"], r["missed"]) for r in feed.read().collect()) == [(1, 2, 1), (2, 1, 0)]


def test_stores_do_not_follow_other_shuffles(spark, tmp_path, monkeypatch):
    """A session with many small partitions opens no more stores of state than cores, groups and changes call for."""
    made = "client_id bigint, n bigint, day int, change_id bigint, op string, city string, balance double"
    monkeypatch.setattr(sequenced_changes, "STORE_ROWS", 100)
    own = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "53")
    try:
        feed = sequenced_changes.Feed(spark, str(tmp_path), 500, 1_000)
        feed.tick(spark.createDataFrame([(1, 2, 10, 1, "I", "A", 1.0), (2, 1, 10, 2, "I", "B", 1.0)], made), 1, None)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "53"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", own)
    want = max(2 * spark.sparkContext.defaultParallelism, 10)
    assert len([x for x in (tmp_path / "checkpoint" / "state" / "0").iterdir() if x.name.isdigit()]) == want
    assert sequenced_changes.Feed(spark, str(tmp_path), 3, 1_000).stores == 3
    assert sequenced_changes.Feed(spark, str(tmp_path), 500, 100_000).stores == 1_000 // 2


def test_marks_of_any_length(spark):
    """Lines that a repeated group would take beyond the stack; marks are those of the plain expression."""
    heads = [">" * 1_000_000, "> " * 100_000, "  >\t>" * 50_000, " " * 100_000, "> " * 9 + "    > ", "   > x >", "    > no", ">    >", "\t\t\t>\t", ">>  >   >    >", "", ">"]
    lines = [h + "said" for h in heads] + heads
    rows = [(1, i, "user", line) for i, line in enumerate(lines)]
    done = quote_linking._parsed(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")).collect()
    for r in done:
        m = re.match(r"(?:[ \t]{0,3}>)+ ?", r["text"])
        want = [(m[0].count(">"), r["text"][m.end() :])] if m else []
        assert [(x["level"], x["said"]) for x in r["runs"]] == want, r["text"][:40]
