"""Relations of an index, their enumerations, request scope and budgets."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame

# The relations' columns.
RELATIONS = {
    "files": "file_id string, path string, sha256 string, project_id string, is_virtual boolean, decompiled_source string, content string",
    "symbols": "symbol_id string, fqname string, kind string, file_id string, span_start int, span_end int, signature string, documentation string, namespace string, containing_type string, visibility string, confidence string, stable_id string, name_tokens array<string>, is_decompiled int, project_name string",
    "refs": "from_symbol_id string, to_symbol_id string, ref_kind string, file_id string, loc_start int, loc_end int, resolution_state string, to_name string, to_container_hint string, stable_from_id string, stable_to_id string, is_decompiled boolean",
    "facts": "symbol_id string, stable_id string, fact_kind string, value string, file_id string, loc_start int, loc_end int, confidence string",
    "type_relations": "type_symbol_id string, related_symbol_id string, relation_kind string, display_name string, stable_type_id string, stable_related_id string",
    "projects": "project_name string, compiled boolean, symbol_count int, reference_count int, is_test boolean",
}

# Enumerations in ordinal order (for confidence and level, the last is the worst).
SYMBOL_KINDS = ["Class", "Struct", "Interface", "Enum", "Delegate", "Record", "Method", "Property", "Field", "Event", "Constant", "Constructor", "Indexer", "Operator"]
TYPE_KINDS = ["Class", "Struct", "Interface", "Enum", "Delegate", "Record"]
REF_KINDS = ["Call", "Read", "Write", "Instantiate", "Override", "Implementation"]
CALL_KINDS = ["Call", "Instantiate"]
FACT_KINDS = ["Route", "Config", "DbTable", "DiRegistration", "Middleware", "Exception", "Log", "RetryPolicy", "RazorInject", "RazorParameter"]
CONFIDENCES = ["High", "Medium", "Low"]
LEVELS = ["Full", "Partial", "SyntaxOnly"]
RELATIONSHIPS = ["Identical", "Ancestor", "MergeBase", "Divergent"]


@dataclass(frozen=True)
class Index:
    """The relations of one snapshot, or of many under partition columns."""

    files: DataFrame
    symbols: DataFrame
    refs: DataFrame
    facts: DataFrame
    type_relations: DataFrame
    projects: DataFrame | None = None


@dataclass(frozen=True)
class Budget:
    """Limits of one request: clamped to the caps, with a record of what was clamped."""

    max_results: int = 20
    max_references: int = 50
    max_depth: int = 3
    max_lines: int = 120
    max_chars: int = 12_000

    def clamp(self) -> tuple[Budget, dict[str, tuple[int, int]]]:
        own, applied = {}, {}
        for f in fields(self):
            asked, cap = getattr(self, f.name), getattr(CAPS, f.name)
            own[f.name] = min(max(asked, 1), cap)
            if own[f.name] != asked:
                applied[f.name] = (asked, own[f.name])
        return Budget(**own), applied


CAPS = Budget(100, 500, 6, 400, 40_000)


@dataclass(frozen=True)
class Scope:
    """Whose snapshot a request reads."""

    repo_id: str
    solution_id: str | None = None
    commit_sha: str | None = None
    workspace_id: str | None = None
    consistency: str = "Committed"
    virtual_files: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.commit_sha is not None and not re.fullmatch("[0-9a-f]{40}", self.commit_sha):
            raise ValueError("a commit is 40 lower-case hex digits")
        if self.consistency not in ("Committed", "Workspace", "Ephemeral"):
            raise ValueError("unknown consistency mode")
