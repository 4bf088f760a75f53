"""Repairs on small cases: chains, cycles and second runs; clashes of clashes; links at the edges of texts."""

import random

from cairnspark.operators import maintenance, output_names, overlays


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


PAGES = "path string, refs array<string>"
RECORDS = "path string, title string, refs array<string>"


def test_repair_follows_chains_and_ends(spark):
    pages = spark.createDataFrame([("a", ["b", "w/x", "a", None]), ("b", None), (None, ["w/y"]), ("c", ["w/x"])], PAGES)
    records = spark.createDataFrame([("w/x", "X", ["w/z", "b"]), ("w/x", "X", ["w/z", "b"]), ("w/z", None, ["w/x", "w/end"]), ("w/unasked", "U", ["a"]), (None, "N", [])], RECORDS)
    stubs = maintenance.repair(pages, records)
    assert rows(stubs) == [("w/end", "end", [], "w/z", 3), ("w/x", "X", ["w/z", "b"], "a", 1), ("w/y", "y", [], None, 1), ("w/z", "z", ["w/x", "w/end"], "w/x", 2)]
    whole = pages.union(stubs.select("path", "refs"))
    assert maintenance.repair(whole, records).count() == 0
    assert maintenance.repair(pages.limit(0), records).count() == 0 == maintenance.repair(whole, records.limit(0)).count()


def by_hand(named):
    """One name after the other: the first holder keeps it, the others try one suffix after the other."""
    first, taken, out = {}, {n for _, n in named}, {}
    for i, n in sorted(named):
        if n not in first:
            first[n] = 1
            out[i] = n
            continue
        while True:
            first[n] += 1
            if f"{n}-{first[n]}" not in taken:
                break
        out[i] = f"{n}-{first[n]}"
    return out


def test_names_do_not_clash(spark):
    r = random.Random(5)
    named = [(i, r.choice(["a", "a-2", "a-3", "a-2-2", "a-02", "b", "-2", "b-7", "a-1", "x\ny", "b-99999999999999999999"])) for i in range(300)]
    got = {x["id"]: x["output"] for x in output_names.clash_free(spark.createDataFrame(named, "id bigint, name string")).collect()}
    assert got == by_hand(named) and len({*got.values()}) == 300
    odd = spark.createDataFrame([(1, None), (2, ""), (2, "z"), (3, "untitled"), (None, "q"), (3, "untitled")], "id bigint, name string")
    assert rows(output_names.clash_free(odd)) == [(1, "untitled", "untitled"), (2, "untitled", "untitled-2"), (3, "untitled", "untitled-3")]
    assert output_names.clash_free(odd.limit(0)).count() == 0


def test_links_follow_outputs(spark):
    texts = spark.createDataFrame([(1, "[a](x)[b](y) (x) ]( x) [c](x)"), (2, None), (3, "no links"), (4, "[a](x" + "y" * 100_000 + ")"), (5, "[$1](x)tail")], "text_id bigint, text string")
    outputs = spark.createDataFrame([("x", "to$1\\x"), (None, "lost"), ("z", None)], "target string, output string")
    want = [(1, "[a](to$1\\x)[b](y) (x) ]( x) [c](to$1\\x)", 3, 2), (2, "", 0, 0), (3, "no links", 0, 0), (4, "[a](x" + "y" * 100_000 + ")", 1, 0), (5, "[$1](to$1\\x)tail", 1, 1)]
    assert rows(output_names.rewrite_links(texts, outputs)) == want


def test_overlays_by_kind(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "ref string")
    known = {"source_refs": ids("s1", "s2"), "evidence_refs": ids("e1", "e2", "e3"), "node_refs": ids("n1", "n2")}
    sources = spark.createDataFrame([("e1", "s1"), ("e2", "s2"), ("e3", "s1")], "ref string, source string")
    shape = "id bigint, content string, evidence_refs array<string>, node_refs array<string>"
    now = spark.createDataFrame([(1, "old", ["gone"], ["n9"]), (2, "old", None, None)], shape)
    new = [(1, "new", ["e1", "e3"], ["n1", "n2"]), (3, "x", ["e1", "e2", "e2", "gone", None], ["n2", "n1"]), (4, "x", ["e1"], ["n1", "n9"]), (5, "x", ["gone"], ["n1"]), (6, "x", None, ["n1"]), (None, "x", ["e1"], ["n1"]), (7, "a", ["e1"], ["n1", "n1"]), (7, "b", ["e2"], ["n2"])]
    got = lambda linking: rows(overlays.overlay("relations", now, spark.createDataFrame(new, shape), known, sources, linking).select("id", "content", "evidence_refs", "node_refs"))
    three = (3, "x", ["e1", "e2"], ["n1", "n2"])
    assert got(False) == [(1, "new", ["e1", "e3"], ["n1", "n2"]), (2, "old", None, None), three, (7, "b", ["e2"], ["n2"])]
    assert got(True) == [(1, "old", ["gone"], ["n9"]), (2, "old", None, None), three]
    assert overlays.overlay("relations", now.limit(0), now.limit(0), known, sources).count() == 0
    plain = spark.createDataFrame([(1, "a", ["s1"]), (2, "b", ["s9"])], "id bigint, content string, source_refs array<string>")
    assert rows(overlays.overlay("evidence", plain.limit(0), plain, known).select("id", "source_refs")) == [(1, ["s1"])]
    assert overlays.overlay("evidence", plain, plain, known, linking=True).count() == 2
