"""Graph, history and storage operators on the small fixtures of FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from cairnspark.operators import components as cc, documents as dc, evals, extraction as ex, graph as gr, history as hs, packs, retrieval as rt, workspace as ws
from cairnspark.sources import readers, storage, writers
from cairnspark.streaming import materialise


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (5, 4)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(3, 3)], []])
def test_components(spark, edges):
    group = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in group:
        for a, b in edges:
            if a != b:
                group[a] = group[b] = min(group[a], group[b])
    assert rows(cc.components(spark.createDataFrame(edges, "a bigint, b bigint"))) == sorted(group.items(), key=repr)


def test_alias_chain(spark):
    for order in (("A", "B", "C"), ("C", "B", "A"), ("B", "A", "C")):
        keys = {"A": ["alpha", "b1"], "B": ["b1", "c1"], "C": ["c1", "gamma"], "D": ["delta"]}
        df = spark.createDataFrame([(i, i, keys[n]) for i, n in enumerate([*order, "D"])], "item bigint, position bigint, keys array<string>")
        got = dict(rows(gr.merge_by_alias(df)))
        assert got[0] == got[1] == got[2] != got[3] == "delta"


def test_versions(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("a", 9, "x"), ("b", 5, None)], "k string, at bigint, v string")
    got = rows(hs.versions(log, ["k"], "at", ["v"]))
    assert got == [("a", "x", 1, 3, 1), ("a", "x", 9, None, 3), ("a", "y", 3, 9, 2), ("b", None, 5, None, 1)]
    assert rows(hs.as_of(hs.versions(log, ["k"], "at", ["v"]), F.lit(3)).select("k", "v")) == [("a", "y")]


def test_merge_keeps_one_live_row(spark):
    schema = "id string, v string, valid_from bigint, valid_to bigint, superseded_by string"
    now = spark.createDataFrame([("same", "1", 1, None, None), ("changed", "1", 1, None, None), ("gone", "1", 1, None, None), ("old", "0", 0, 1, "e0")], schema)
    new = spark.createDataFrame([("same", "1"), ("changed", "2"), ("fresh", "1")], "id string, v string")
    out = hs.merge(now, new, ["id"], ["v"], F.lit(5).cast("bigint"), F.lit("e1"))
    assert rows(out) == sorted([("same", "1", 1, None, None), ("changed", "1", 1, 5, "e1"), ("changed", "2", 5, None, None), ("gone", "1", 1, 5, "e1"), ("fresh", "1", 5, None, None), ("old", "0", 0, 1, "e0")], key=repr)
    again = hs.merge(out, new, ["id"], ["v"], F.lit(6).cast("bigint"), F.lit("e2"))
    assert rows(again) == rows(out)
    assert hs.live(out).groupBy("id").count().where("count > 1").count() == 0
    assert rows(hs.not_monotonic(out, spark.createDataFrame([("same", 1), ("fresh", 9)], "id string, valid_from bigint"), ["id"]).select("id")) == [("same",)]


def test_replay(spark):
    log = spark.createDataFrame([("w", 1, "n1", "a"), ("w", 1, "n2", "a"), ("w", 2, "n1", "a"), ("w", 3, "n1", "b"), ("w", 3, "n2", "a")], "ws string, v bigint, id string, c string")
    got = rows(hs.replay(log, ["ws"], "id", [F.col("v")], "c"))
    assert got == [("w", "n1", "a", 1, 3), ("w", "n1", "b", 3, None), ("w", "n2", "a", 1, 2), ("w", "n2", "a", 3, None)]
    assert rows(hs.replay(log, ["ws"], "id", [F.col("v")], "c", F.col("v") <= 2).where("closed_step is null").select("id")) == [("n1",)]


NODE = "node_id string, label string, aliases array<string>, evidence_ids array<string>, confidence double"


def test_corrections(spark):
    nodes = spark.createDataFrame([("n1", "One", ["uno", "eins"], ["e1"], 0.9), ("n2", "Two", [], ["e2", "e3"], 0.99), ("n3", "Three", [], [], 0.5)], NODE)
    edges = spark.createDataFrame([("n1", "n2", "related_to"), ("n1", "n3", "x"), ("n2", "n3", "x")], "src string, dst string, kind string")
    merged, moved = gr.merge_nodes(nodes, edges, "n1", "n2")
    assert rows(merged.where("node_id = 'n2'")) == [("n2", "Two", ["One", "eins", "uno"], ["e1", "e2", "e3"], 0.94)]
    assert rows(moved) == [("n2", "n3", "x")]
    apart = gr.keep_separate(nodes, "n1")
    assert rows(apart.select("node_id", "evidence_ids")) == [("concept-eins", ["e1"]), ("concept-uno", ["e1"]), ("n1", ["e1"]), ("n2", ["e2", "e3"]), ("n3", [])]
    named, renamed = gr.rename_node(nodes, edges, "n1", "New One")
    assert "concept-new-one" in {r[0] for r in rows(renamed.select("src"))} and rows(named.where("label = 'New One'").select("aliases")) == [(["One", "eins", "uno"],)]
    parts = spark.createDataFrame([("Two A", ["e2"]), ("Two B", ["e9"])], "label string, evidence_ids array<string>")
    assert rows(gr.split_node(nodes, "n2", parts).select("node_id", "evidence_ids")) == [("concept-two-a", ["e2"]), ("n1", ["e1"]), ("n3", [])]
    left, lines = gr.delete_nodes(nodes, edges, nodes.where("node_id = 'n3'").select("node_id"))
    assert rows(left.select("node_id")) == [("n1",), ("n2",)] and rows(lines) == [("n1", "n2", "related_to")]


def test_lint_and_conflicts(spark):
    edges = spark.createDataFrame([("e", "a", "missing"), ("f", "a", "b")], "edge_id string, src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",), ("alone",)], "node string")
    assert rows(gr.dangling(edges, nodes)) == [("e", "missing")]
    assert rows(gr.orphans(nodes, edges.drop("edge_id"), nodes.limit(0))) == [("alone",)]
    claims = spark.createDataFrame([(1, "t", "Cache writes block readers today"), (2, "t", "Cache writes never block readers"), (3, "u", "Cache writes never block readers"), (4, "t", "Unrelated and not similar")], "claim_id bigint, topic string, statement string")
    assert rows(gr.claim_conflicts(claims)) == [(1, 2, 4)]


def test_hops(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "src string, dst string")
    assert rows(gr.hops(spark.createDataFrame([("b",)], "node string"), edges, 1)) == [("a", 1), ("b", 0), ("c", 1)]


def test_bm25_needs_every_term(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red hen"), (3, "blue hen"), (4, None)], "id bigint, text string")
    asked = spark.createDataFrame([(1, "red"), (2, "red"), (2, "hen"), (3, "absent")], "q bigint, term string")
    got = rows(rt.bm25(docs, "id", "text", asked, "q").select("q", "id"))
    assert got == [(1, 1), (1, 2), (2, 2)]


def test_packs(spark):
    ev = spark.createDataFrame([("q", i, f"s{i % 2}", "text", "t", float(i)) for i in range(20)], "g string, evidence_id bigint, source_id string, evidence_type string, quote string, s double")
    kept = packs.kept_evidence(ev, "g", F.col("s"), F.col("evidence_id") == 0, 4000)
    assert [r["evidence_id"] for r in kept.orderBy("rank").collect()] == [0, 19, 18, 17, 16, 15, 14, 13]
    pack = packs.nested(kept, "g").first()
    assert [e["evidence_id"] for e in pack["evidence"]][:2] == [0, 19] and pack["sources"] == ["s0", "s1"]
    claims = spark.createDataFrame([("q", "c1", [19, 18]), ("q", "c2", [1])], "g string, record_id string, evidence_ids array<bigint>")
    relations = spark.createDataFrame([("q", f"r{i}", "related_to" if i else "depends_on", [17]) for i in range(9)], "g string, record_id string, kind string, evidence_ids array<bigint>")
    facts = packs.kept_facts(claims, relations, kept, "g", 4000)
    assert [r["record_id"] for r in facts.orderBy("rank").collect()] == ["c1", "r0", "r1", "r2", "r3"]


def test_compare(spark):
    df = spark.createDataFrame([("answer_ms", 100.0, 104.0), ("answer_ms", 90.0, 100.0), ("correctness", 0.5, 0.50005), ("correctness", 0.4, 0.5), ("unsupported_rate", 0.1, 0.2)], "m string, a double, b double")
    assert [r[0] for r in df.select(evals.compare(F.col("m"), F.col("a"), F.col("b"))).collect()] == ["tie", "win", "tie", "loss", "win"]


def test_read_and_write(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# T\r\nx\n")
    files = readers.text_files(spark, str(tmp_path / "in"), "*.md")
    assert files.first()["text"] == "# T\nx" and readers.new_files(files, files).count() == 0
    assert readers.blobs(spark, str(tmp_path / "in")).first()["length"] == 7
    spark.createDataFrame([(1, "a")], "id int, v string").write.parquet(str(tmp_path / "t"))
    old = spark.read.parquet(str(tmp_path / "t"))
    writers.rewrite(writers.upserted(old, spark.createDataFrame([(1, "b"), (1, "c"), (2, "d")], "id int, v string"), ["id"], ["v"]), str(tmp_path / "t"))
    assert rows(spark.read.parquet(str(tmp_path / "t"))) == [(1, "c"), (2, "d")]


def test_stream_equals_batch(spark):
    log = spark.createDataFrame([("k%d" % (i % 7), i * 37 % 100, i) for i in range(100)], "k string, at bigint, v bigint")
    assert rows(materialise.run_once(log, ["k"], ["at", "v"])) == rows(hs.latest(log, ["k"], [F.col("at"), F.col("v")]))


def test_wiki_revision_rules(spark):
    schema = "page_id bigint, body string, revision int, event string, valid_from bigint, valid_to bigint"
    now = spark.createDataFrame([(1, "a", 1, "e1", 1, None), (2, "b", 3, "e2", 1, None), (3, "c", 1, "e1", 1, None)], schema)
    new = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d")], "page_id bigint, body string")
    got = rows(dc.revise(new, now, F.lit("e2"), F.lit(7)))
    assert got == sorted([(1, "a", 1, "e1", 1, 7), (1, "a", 2, "e2", 7, None), (2, "B", 3, "e2", 1, None), (3, "c", 1, "e1", 1, 7), (4, "d", 1, "e2", 7, None)], key=repr)


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    """A new table object and a new query on the old checkpoint: the state is that of one run."""
    log = spark.createDataFrame([("k%d" % (i % 40), i * 37 % 100, i) for i in range(200)], "k string, at bigint, v bigint")
    log.where("v < 120").coalesce(2).write.parquet(f"{tmp_path}/log")
    source = lambda: spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    first, table = materialise.follow(source(), ["k"], ["at", "v"], f"{tmp_path}/state", f"{tmp_path}/offsets")
    first.awaitTermination()
    assert rows(table.read()) == rows(hs.latest(log.where("v < 120"), ["k"], [F.col("at"), F.col("v")]))
    version = table.version
    log.where("v >= 120").coalesce(3).write.mode("append").parquet(f"{tmp_path}/log")
    second, again = materialise.follow(source(), ["k"], ["at", "v"], f"{tmp_path}/state", f"{tmp_path}/offsets")
    assert rows(materialise.LatestTable(spark, f"{tmp_path}/state", log.schema, ["k"], ["at", "v"]).read())
    second.awaitTermination()
    assert again.version > version
    want = rows(hs.latest(log, ["k"], [F.col("at"), F.col("v")]))
    assert rows(again.read()) == want
    # a batch that comes again changes nothing, one that was cut off before its manifest counts for nothing
    again.merge(log.where("v < 0"), again.version)
    log.withColumn("at", F.lit(999)).withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(f"{tmp_path}/state/rows/v{again.version + 1}")
    assert rows(materialise.LatestTable(spark, f"{tmp_path}/state", log.schema, ["k"], ["at", "v"]).read()) == want


def test_running_totals_and_markdown_parts(spark):
    from cairnspark.functions import folds

    data = [("hot" if i % 3 else f"s{i % 5}", i, i % 7 if i % 11 else None) for i in range(300)] + [(None, 1, 4), (None, 2, 5)]
    df = spark.createDataFrame(data, "g string, o bigint, n bigint").repartition(7)
    got = {(r["g"], r["o"]): r["before"] for r in folds.running_total(df, ["g"], ["o"], F.col("n")).collect()}
    assert got == {(g, o): sum(n or 0 for h, p, n in data if h == g and p < o) for g, o, _ in data}
    pages = spark.createDataFrame([("s", i, "x" * 10) for i in range(9)] + [("t", 0, "y")], "s string, p bigint, t string")
    parts = {(r["s"], r["part"]): r["markdown"] for r in packs.markdown(pages, "s", "p", "t", most_chars=30).collect()}
    assert sorted(parts) == [("s", 0), ("s", 1), ("s", 2), ("t", 0)]
    assert "\n\n".join(parts["s", k] for k in range(3)) == "\n\n".join(f"## Page {i + 1}\n\n" + "x" * 10 for i in range(9))


def test_frequent_terms_pair_nothing(spark):
    """Claims that share frequent terms only; those with a rare one in common are compared."""
    rows_ = [(i, "t", f"common words everywhere stand{'' if i % 2 else ' not'} alone{i}") for i in range(60)] + [(100, "t", "rare pair here common"), (101, "t", "rare pair here not words")]
    claims = spark.createDataFrame(rows_, "claim_id bigint, topic string, statement string")
    from cairnspark.functions import text as tx

    terms = {i: {w for w in s.split() if len(w) >= 4} for i, _, s in rows_}
    no = {i: " not" in s for i, _, s in rows_}
    want = sorted((min(a, b), max(a, b), len(terms[a] & terms[b])) for a in terms for b in terms if no[a] and not no[b] and len(terms[a] & terms[b]) >= 3)
    assert rows(gr.claim_conflicts(claims)) == sorted(want, key=repr)
    sets = claims.select(F.col("claim_id").alias("id"), tx.claim_terms(F.col("statement")).alias("terms"))
    rare = gr.rare_tokens(sets, "terms", F.lit(3), [])
    assert rare.groupBy("token").count().where("token = 'common'").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0] <= 2


def test_deleted_keeps_rows_of_no_source(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "source_id string, v int")
    assert rows(writers.deleted({"t": df}, "a")["t"].select("v")) == [(2,), (3,)]


def test_iso_time_in_any_zone(spark):
    from cairnspark.operators import artifacts as ar

    old = spark.conf.get("spark.sql.session.timeZone")
    for zone in ("UTC", "America/New_York", "Asia/Seoul"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert spark.range(1).select(ar.iso_time(F.lit(1704067207)).alias("t")).first()["t"] == "2024-01-01T00:00:07Z"
        finally:
            spark.conf.set("spark.sql.session.timeZone", old)


def test_sketches_of_equal_values_have_equal_estimates(spark):
    from cairnspark.operators import sketches

    df = spark.range(4000).select(F.explode(F.array(F.lit("a"), F.when(F.col("id") < 2500, "b"))).alias("g"), (F.col("id") % 7).alias("day"), "id").where("g is not null")
    estimates = lambda df: {r["g"]: r["n"] for r in df.select("g", sketches.estimate(F.col("sketch")).alias("n")).collect()}
    once = estimates(sketches.sketched(df.coalesce(1), ["g"], F.col("id")))
    for rows_ in (df.coalesce(1), df.repartition(5)):
        assert once == estimates(sketches.united(sketches.sketched(rows_, ["g", "day"], F.col("id")), ["g"])) == estimates(sketches.sketched(rows_, ["g"], F.col("id")))


def test_similar_labels_meet_by_rare_tokens_and_copies_once(spark):
    from cairnspark.operators import workspace as ws

    words = ["red", "blue", "bolt", "ring", "gear", "nut", "pin"]
    labels = [(i, " ".join(w for k, w in enumerate(words) if i * 37 % 128 >> k & 1)) for i in range(300)]
    sets = {i: frozenset(t.split()) for i, t in labels if t}
    first = {}
    for i, t in sorted(sets.items()):
        first.setdefault(t, i)
    want = [(first[t], i, 1.0) for i, t in sets.items() if first[t] < i]
    for s, a in first.items():
        for t, b in first.items():
            c = len(s & t)
            if a < b and (c == min(len(s), len(t)) or c / len(s | t) >= 0.72):
                want.append((a, b, 0.86 if c == min(len(s), len(t)) else c / len(s | t)))
    assert rows(ws.similar_labels(spark.createDataFrame(labels, "id bigint, label string"))) == sorted(want, key=repr)
    many = spark.range(20_000).select("id", F.lit("same label of all").alias("label"))
    assert ws.similar_labels(many).count() == 19_999


def test_equal_questions_and_candidates_are_scored_once(spark):
    """10 000 equal questions about one node of 10 000 claims: 10^8 pairs, of which none is formed."""
    from cairnspark.operators import answers as an

    none = F.expr("cast(array() as array<string>)")
    n = F.col("id").cast("string")
    questions = spark.range(10_000).select(F.concat(F.lit("q"), n).alias("question_id"), F.lit("small bolts").alias("question"))
    claims = spark.range(10_000).select(F.concat(F.lit("c"), F.lpad(n, 5, "0")).alias("claim_id"), F.lit("small bolt").alias("statement"), F.array(F.lit("n1")).alias("topic_refs"), none.alias("source_refs"), F.array(F.concat(F.lit("e"), n)).alias("evidence_refs"))
    node = spark.createDataFrame([("n1", "Bolt", [], [], ["e0"])], "node_id string, label string, aliases array<string>, source_ids array<string>, evidence_ids array<string>")
    relation = spark.createDataFrame([], "relation_id string, src string, dst string, evidence_ids array<string>")
    ids = questions.select("question_id", F.lit("n1").alias("node_id"))
    got = an.scored(questions, an.all_candidates({"claim": claims}), ids, an.focus_items(ids, node, relation, claims))
    assert got.count() == 80_000
    # bolt 8 + 2 x 2 (title and body), small 12, both 4 and 10: 38; node 18, evidence 6, own term 12 at most
    want = [(k + 1, f"c{k:05}", 38, 36, 3836) for k in range(8)]
    assert rows(got.where("question_id = 'q77'").select("place", "id", "query_score", "bias", "total")) == want


def test_best_links_of_any_rank_equal_all_pairs(spark):
    """Early ends, equal names, terms only, and sets in which few share much."""
    for n, words, names, most in ((60, 9, 3, 5), (60, 9, 60, 5), (40, 3, 1000, 50), (40, 30, 7, 200)):
        nodes = [(i, f"Name {i * 7 % names}", sorted({f"w{(i * k * 13 + k) % 40}" for k in range(1, 2 + i % words)})) for i in range(n)]
        left, right = [x for x in nodes if x[0] % 3 == 0], [x for x in nodes if x[0] % 3]
        want = []
        for a, x, s in left:
            for b, y, t in right:
                c = len({*s} & {*t})
                if x == y or c >= 2:
                    want.append((-(10_000 if x == y else 1_000) - 100 * min(c, 8), a, b, x == y, c))
        df = lambda r: spark.createDataFrame(r, "id bigint, name string, terms array<string>")
        got = gr.link_candidates(df(left), df(right), most, first=4).orderBy("rank").select("score", "l_id", "r_id", "direct", "shared")
        assert [(-r[0], *r[1:]) for r in map(tuple, got.collect())] == sorted(want)[:most]


def test_memories_of_copies_match_the_smallest_other(spark):
    """Copies on both sides, ids on both sides, and every pair against the rule."""
    words = lambda i: " ".join(f"word{(i // 4 * 5 + k * (1 + i % 2)) % 23:02}" for k in range(3 + i % 9))
    data = [(i, f"title {i % 17}" if i % 5 else f"own {i}", "the same body of many copies" if i % 6 == 0 else words(i), [f"e{i % 50}"] if i % 7 == 0 else []) for i in range(80)]
    df = spark.createDataFrame(data, "id bigint, title string, body string, evidence_ids array<string>")
    terms = lambda t: {w for w in t.split() if len(w) >= 4}

    def score(a, b):
        x, y = terms(a[2]), terms(b[2])
        c, low, high = len(x & y), min(len(x), len(y)), max(len(x), len(y))
        near = 700 + 100 * c // high if c >= 4 and 100 * c // low >= 80 and 100 * c // high >= 65 else 0
        return max(950 * (a[2] == b[2]), 900 * (a[1] == b[1]), 850 * bool({*a[3]} & {*b[3]}), near)

    want = []
    for a in data[:50]:
        best = min(((-score(a, b), b[0]) for b in data[20:] if a[0] != b[0] and score(a, b)), default=None)
        if best:
            want.append((a[0], best[1], -best[0]))
    assert rows(gr.memory_matches(df.where("id < 50"), df.where("id >= 20"))) == sorted(want, key=repr)
    many = spark.range(20_000).select("id", F.lit("t").alias("title"), F.lit("one body for every one").alias("body"), F.expr("cast(array() as array<string>)").alias("evidence_ids"))
    assert gr.memory_matches(many, many).groupBy("memory_id").count().orderBy("memory_id").collect() == [(0, 19_999), (1, 1)]


def test_claims_of_equal_terms_are_compared_once(spark, monkeypatch):
    """Classes of very many claims meet as one pair; blocks of them, claims of two topics and both kinds of a claim keep every pair once."""
    rows_ = [(i, "t", f"cache writes block readers{' not' if i % 2 else ''}") for i in range(90)] + [(7, "u", "cache writes block readers not"), (8, "u", "cache writes block readers"), (9, "t", "cache writes block readers"), (5, None, "cache writes block readers"), (6, "t", None)]
    claims = spark.createDataFrame(rows_, "claim_id bigint, topic string, statement string")
    own, seen = gr.materialize, {}
    monkeypatch.setattr(gr, "CLASS_BLOCK", 16)
    monkeypatch.setattr(gr, "TASK_PAIRS", 100)
    monkeypatch.setattr(gr, "materialize", lambda df, name: seen.setdefault(name, own(df, name)))
    got = rows(gr.claim_conflicts(claims))
    no = {(i, t, " not" in s) for i, t, s in rows_ if s and t}
    assert got == sorted({(min(a, b), max(a, b), 4) for a, t, x in no for b, u, y in no if t == u and x and not y and a != b}, key=repr)
    assert seen["conflicting_classes"].count() == 2 and seen["claim_blocks"].agg(F.max(F.size("ids"))).first()[0] < 45


def test_ranked_texts_are_chosen_by_the_rarest_term(spark, monkeypatch):
    """Terms that aren't asked leave no scan, and of a query only texts with its rarest term are looked at."""
    docs = spark.createDataFrame([(i, "common words" + (" rare" if i % 10 == 0 else "") + (" pair" if i % 20 == 0 else "")) for i in range(60)], "id bigint, text string")
    asked = spark.createDataFrame([("a", "common"), ("a", "rare"), ("b", "common"), ("b", "rare"), ("b", "pair"), ("c", "common"), ("c", "nowhere")], "q string, term string")
    own, seen = rt.materialize, {}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(rt, "materialize", lambda df, name: seen.setdefault(name, (plan(df), own(df, name)))[1])
    want = [("a", i) for i in range(0, 60, 10)] + [("b", i) for i in range(0, 60, 20)]
    assert rows(rt.bm25(docs, "id", "text", asked, "q").select("q", "id")) == want
    assert "SortMergeJoin" not in seen["asked_postings"][0] and rows(seen["candidates"][1].select("q", "id")) == want
    seen.clear()
    monkeypatch.setattr(rt, "BROADCAST_TERMS", 0)
    assert rows(rt.bm25(docs, "id", "text", asked, "q").select("q", "id")) == want


def test_extraction_makes_each_expression_once(spark):
    said = "  ## 1.) The `long` report of some things we read today: more\n![x](y.md) picture of it\n[see] the guide there\n\n- a the of\n12. long report of some things we\n# Heading that goes away\n\talpha beta depends on gamma"
    docs = spark.createDataFrame([(1, said), (2, None)], "doc_id int, text string")
    found = ex.concepts(docs, ["doc_id"], "text", 9)
    assert rows(found) == [(1, 1, "long report of some things we", "long-report-of-some-things-we"), (1, 2, "alpha beta depends on gamma", "alpha-beta-depends-on-gamma")]
    names = spark.createDataFrame([("alpha",), ("gamma",), ("gamma",), (None,)], "name string")
    told = ex.relation_lines(docs, "doc_id", "text", names)
    assert rows(told) == [(1, 1, "alpha", "gamma", "depends_on")]
    claims = ex.claim_lines(docs, "doc_id", "text")
    assert [r["line_no"] for r in claims.orderBy("rank").collect()] == [1, 3, 5, 6, 8]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # the line's regular expressions stand in the plan once, not again for each filter and column that uses the label
    assert plan.count("_AI analysis unavailable") == 1 and told._jdf.queryExecution().optimizedPlan().toString().count(" relies on ") == 1
    assert claims._jdf.queryExecution().optimizedPlan().toString().count("[-*+]|[0-9]+[.)]") == 1


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_words_are_looked_for_in_distinct_runs(spark, monkeypatch, broadcast):
    monkeypatch.setattr(ws, "BROADCAST_TERMS", broadcast)
    texts = [(i, "s", f"Mixed{i} anabel\tbelana cab  x" if i % 2 else "nothing here", 9 - i) for i in range(8)] + [(8, "s", None, 0), (9, "s", "a b", 0)]
    docs = spark.createDataFrame(texts, "evidence_id int, source_id string, said string, at int")
    asked = spark.createDataFrame([("abe",), ("abe",), ("ab",), ("x5",), ("d5",), ("zz",), ("hing",)], "word string")
    for most in (2, 100):
        want = []
        for w in ("abe", "ab", "x5", "d5", "zz", "hing"):
            held = sorted((at, i) for i, _, said, at in texts if said and w in said.lower())
            want += [(w, i, at) for at, i in held[:most]]
        assert rows(ws.first_holding(docs, asked, most)) == sorted(want, key=repr)


def test_shuffles_are_dealt_for_the_rows_they_carry(spark, monkeypatch):
    name = "spark.sql.shuffle.partitions"
    own = spark.conf.get(name)
    with storage.dealt_for(spark, 50 * storage.TASK_ROWS + 1):
        assert spark.conf.get(name) == "51"
    with storage.dealt_for(spark, 1):
        assert spark.conf.get(name) == own  # a larger number is kept
    with pytest.raises(KeyError), storage.dealt_for(spark, 50 * storage.TASK_ROWS):
        raise KeyError
    assert spark.conf.get(name) == own
    monkeypatch.setattr(ws, "TASK_ROWS", 2)
    monkeypatch.setattr(storage, "TASK_ROWS", 2)
    said = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (None, "a"), (None, "b"), (3, None), (3, "a")], "place int, concept string")
    assert rows(ws.cooccurrence(said)) == [("a", "b", 2, 1), ("a", "c", 1, 2), ("b", "c", 1, 1)]
    assert rows(ws.cooccurrence(said.where("false"))) == [] and spark.conf.get(name) == own


def test_trails_of_repeated_rows_equal_all_records(spark):
    """Index rows and edges come several times; every record of both stages against the rule."""
    index = [(f"o{k % 7}", kind, rec) for k in range(60) for kind, rec in (("node", f"p{k * 5 % 13}"), ("relation", f"p{k * 5 % 13}-s{k % 4}"))]
    edges = [(f"p{a}-s{b}", f"p{a}", f"s{b}" if (a, b) != (3, 1) else None) for a in range(13) for b in range(4)]
    df = lambda rows_, schema: spark.createDataFrame(rows_ * 3, schema)
    most, want = 4, []
    for e in sorted({i[0] for i in index} - {"o6"}):
        direct = sorted({(kind != "node", rec) for o, kind, rec in index if o == e})[:most]
        own = {rec for _, rec in direct}
        near = {(0, x) for k, a, b in edges if (True, k) in direct for x in (a, b)} | {(1, x) for k, a, b in edges for x in (k, b if (False, a) in direct else a) if {(False, a), (False, b)} & {*direct}}
        first = {}
        for n, x in sorted(near, key=repr):
            if x and x not in own:
                first.setdefault(x, n)
        want += [(e, "direct", rec, k + 1) for k, (_, rec) in enumerate(direct)]
        want += [(e, "adjacent", x, k + 1) for k, (n, x) in enumerate(sorted((n, x) for x, n in first.items())[:most])]
    got = gr.trail(df([(f"o{k}",) for k in range(6)], "evidence_id string"), df(index, "evidence_id string, record_kind string, record_id string"), df(edges, "edge_id string, src string, dst string"), most)
    assert rows(got) == sorted(want, key=repr)


def test_all_similar_labels_equal_all_pairs(spark, monkeypatch):
    """Copies in several blocks, sets within others, labels without tokens, in small tasks."""
    monkeypatch.setattr(ws, "CLASS_BLOCK", 4)
    monkeypatch.setattr(ws, "TASK_PAIRS", 50)
    words = ["red", "blue", "bolt", "ring", "gear", "nut", "pin"]
    labels = [(i, " ".join(w for k, w in enumerate(words) if (i * 37 % 128 if i % 3 else 21) >> k & 1)) for i in range(90)] + [(90, ""), (91, "?!")]
    sets = {i: frozenset(t.split()) for i, t in labels if t.strip("?!")}
    want = []
    for a, s in sets.items():
        for b, t in sets.items():
            c = len(s & t)
            if a < b and (c == min(len(s), len(t)) or c / len(s | t) >= 0.72):
                want.append((a, b, 1.0 if s == t else 0.86 if c == min(len(s), len(t)) else c / len(s | t)))
    assert rows(ws.all_similar_labels(spark.createDataFrame(labels, "id bigint, label string"))) == sorted(want, key=repr)
