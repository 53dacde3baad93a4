"""Kinds, weights and table schemas of the property graph."""

from __future__ import annotations

# The closed vocabularies.
NODE_KINDS = ("File", "Class", "Function", "Method", "Type", "Constant", "Variable", "Parameter", "Test", "Interface", "Module", "Namespace", "Enum", "Struct", "Endpoint", "Callsite")
EDGE_KINDS = ("CALLS", "IMPORTS_FROM", "INHERITS", "IMPLEMENTS", "EXTENDS", "CONTAINS", "TESTS", "TESTED_BY", "DEPENDS_ON", "REFERENCES", "USES", "DEFINES", "READS", "WRITES", "CONTROLS", "PARAMETER_OF")
SEMANTIC_KINDS = ("File", "Class", "Function", "Method", "Type", "Test", "Interface", "Module", "Namespace", "Enum", "Struct", "Endpoint")
SKIPPED_FOR_EMBEDDING = ("Variable", "Parameter", "Callsite", "Constant")
RANKED_EDGES = ("CALLS", "IMPORTS_FROM", "INHERITS", "IMPLEMENTS", "DEPENDS_ON")
IMPACT_EDGES = ("CALLS", "IMPORTS_FROM", "DEPENDS_ON")
TAINT_EDGES = ("WRITES", "READS", "CALLS", "DEPENDS_ON")
OTHER_WEIGHT = 0.1
WEIGHTS = {"CALLS": 1.0, "INHERITS": 0.9, "TESTS": 0.7, "CONTAINS": 0.5, "IMPORTS_FROM": 0.4, "CONTROLS": 0.2, "READS": 0.15, "WRITES": 0.15}
COMMUNITY_WEIGHTS = {"CALLS": 1.0, "INHERITS": 1.0, "TESTS": 0.8, "CONTAINS": 0.5, "IMPORTS_FROM": 0.4, "PARAMETER_OF": 0.3, "CONTROLS": 0.15, "READS": 0.1, "WRITES": 0.1}
KIND_LABELS = {"Endpoint": "api endpoint", "Test": "test function"}

# Table schemas as DDL.
NODES = "qualified_name string, kind string, name string, file_path string, language string, range_start int, range_end int, parent_qualified string, is_test boolean, extra string, params array<string>, modifiers array<string>, return_type string, docstring string"
EDGES = "edge_id long, kind string, source string, target string, file_path string, confidence double, extra string"
OCCURRENCES = "symbol string, file_path string, line int, col int, role string"
SYMBOLS = "qualified_name string, kind string, file_path string, line int, col int, language string, module_path string, display_name string, mtime double"


def weight_column(kind, weights: dict[str, float] = WEIGHTS):
    """The weight of an edge kind as a column: a literal map, so that no join is needed."""
    from pyspark.sql import functions as F

    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit(OTHER_WEIGHT))
