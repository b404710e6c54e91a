"""Schemas of the data model and its fixed values."""

from __future__ import annotations

SYMBOLS = "id string, fq_name string, name string, kind string, file string, start_line int, end_line int, signature string, doc string, tokens int, is_test boolean"
EDGES = "from_id string, to_id string, kind string"
ERRORS = "file string, line int, message string"
COVERAGE = "file string, call_sites int, resolved_callees int, attributed_to_caller int, failed_files int"
TASKS = "task_id string, text string, base_commit string, changed_lines map<string,array<int>>"

# Kinds of symbols, kinds of edges in their sorting order, weights of links (forward, backward).
SYMBOL_KINDS = ("CLASS", "INTERFACE", "OBJECT", "FUNCTION", "CONSTRUCTOR", "PROPERTY")
EDGE_KINDS = ("CONTAINS", "CALLS", "EXTENDS", "OVERRIDES", "IMPORTS", "REFERENCES_TYPE")
WEIGHTS = {
    "CALLS": (1.0, 1.0),
    "CONTAINS": (0.5, 1.0),
    "EXTENDS": (0.8, 1.0),
    "OVERRIDES": (0.8, 1.0),
    "IMPORTS": (0.0, 0.0),
    "REFERENCES_TYPE": (0.0, 0.0),
    "SAME_FILE": (1.0, 1.0),
}
OUTCOMES = ("RESOLVED", "UNRESOLVED", "NOT_APPLIED", "NO_ANSWER", "NO_VERDICT")
