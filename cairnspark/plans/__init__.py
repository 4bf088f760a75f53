"""Query catalogue."""

from . import answer_queries, artifact_queries, document_queries, graph_queries, history_queries, maintenance_queries, overlay_queries, rebuild_queries, report_queries, search_queries, store_queries, text_queries, workspace_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "answer_queries", "artifact_queries", "document_queries", "graph_queries", "history_queries", "maintenance_queries", "overlay_queries", "rebuild_queries", "report_queries", "search_queries", "store_queries", "text_queries", "workspace_queries"]
