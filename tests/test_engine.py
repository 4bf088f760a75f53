"""The engine object on a small workspace."""

import pytest
from pyspark.sql import functions as F

from cairnspark.engine import KnowledgeEngine


@pytest.fixture(scope="module")
def engine(spark):
    return KnowledgeEngine(spark, {
        "sources": spark.createDataFrame([("s1", "w", "One", "ingested"), ("s2", "w", "Two", "failed"), ("s3", "v", "Three", "ingested")], "source_id string, workspace_id string, title string, status string"),
        "evidence": spark.createDataFrame([("e1", "s1", "w", "text", "red fox runs"), ("e2", "s1", "w", "claim_evidence", "red hen"), ("e3", "s2", "w", "text", "red fox hidden"), ("e4", "s3", "v", "text", "red fox elsewhere")], "evidence_id string, source_id string, workspace_id string, evidence_type string, text string"),
        "nodes": spark.createDataFrame([("n1", "Fox", [], ["e1"], 0.9), ("n2", "Hen", [], ["e2"], 0.9), ("n3", "Alone", [], [], 0.5)], "node_id string, label string, aliases array<string>, evidence_ids array<string>, confidence double"),
        "edges": spark.createDataFrame([("r1", "n1", "n2", "related_to", ["e1"]), ("r2", "n1", "gone", "x", ["e2"])], "edge_id string, src string, dst string, kind string, evidence_ids array<string>"),
    })


def test_search_sees_visible_sources_only(engine):
    assert [r["evidence_id"] for r in engine.search("w", "red fox").collect()] == ["e1"]
    assert {r["evidence_id"] for r in engine.search("w", "fox absent").collect()} == {"e1"}
    assert engine.search("w", "nothing").count() == 0


def test_pack(engine):
    pack = engine.context_pack("w", "red").first()
    assert pack["sources"] == ["s1"] and pack["warnings"] == ["single_source"] and len(pack["evidence"]) == 2


def test_lint_trail_and_corrections(engine):
    assert sorted((r["kind"], r["id"]) for r in engine.lint().collect()) == [("orphan_edge", "r2"), ("orphan_node", "n3")]
    assert {(r["stage"], r["record_id"]) for r in engine.trail(["e1"]).collect()} >= {("direct", "n1"), ("direct", "r1"), ("adjacent", "n2")}
    fixed = engine.correct("delete", node_ids=["n2"])
    assert {r["node_id"] for r in fixed.table("nodes").collect()} == {"n1", "n3"}
    with pytest.raises(ValueError, match="unknown"):
        engine.correct("explode")
    assert engine.delete_source("s1").table("evidence").where(F.col("source_id") == "s1").count() == 0
