"""Requests against published snapshots: whose view is read (Scope), and within which limits (Budget).

Committed requests read a snapshot; workspace requests lay the workspace's overlay over it; ephemeral
ones also put given texts in place of files. Every answer comes with the limits that were applied:
what was asked, and what the caps left of it. A symbol that the view does not hold is an error, NOT_FOUND.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgrid.operators import graph, refs, search, spans, trigrams, workspace
from symgrid.operators.adjacency import Adjacency, among
from symgrid.operators.workspace import Overlay
from symgrid.schema import Budget, Index, Scope
from symgrid.sources import store
from symgrid.sources.store import Snapshot

Answer = tuple[DataFrame, dict[str, tuple[int, int]]]


class Engine:
    def __init__(self, spark: SparkSession, root: str, overlays: dict[str, Overlay] | None = None):
        """root: where snapshots are published; overlays: by workspace."""
        self.spark, self.root, self.overlays = spark, root, overlays or {}

    def snapshot(self, scope: Scope) -> Snapshot:
        """The scope's snapshot, or the newest published one that fits it: one version, which a request
        finds once and takes all that it reads from."""
        found = store.newest(self.spark, self.root, scope.repo_id, scope.solution_id, scope.commit_sha)
        if found is None:
            raise LookupError(f"INDEX_NOT_AVAILABLE: {scope.repo_id}")
        return found

    def overlay(self, scope: Scope) -> Overlay | None:
        if scope.consistency == "Committed" or (scope.consistency == "Ephemeral" and scope.workspace_id is None):
            return None
        if scope.workspace_id not in self.overlays:
            raise LookupError(f"NOT_FOUND: workspace {scope.workspace_id}")
        return self.overlays[scope.workspace_id]

    def index(self, scope: Scope, outgoing: bool = False, at: Snapshot | None = None) -> Index:
        """The relations in view; references sorted by target, or by source if outgoing."""
        base, own = (at or self.snapshot(scope)).index(outgoing), self.overlay(scope)
        view = base if own is None else workspace.merged(base, own)
        if scope.consistency == "Ephemeral" and scope.virtual_files:
            texts = self.spark.createDataFrame(list(scope.virtual_files.items()), "path string, content string")
            view = Index(spans.overlay_content(view.files, view.files.limit(0), texts), view.symbols, view.refs, view.facts, view.type_relations)
        return view

    def calls(self, scope: Scope, at: Snapshot, incoming: bool) -> Adjacency:
        """The call edges in view."""
        own = self.overlay(scope)
        return at.calls(incoming) if own is None else workspace.calls(at.calls(incoming), own, incoming)

    def search(self, scope: Scope, query: str, budget: Budget = Budget(), **filters) -> Answer:
        own, applied = budget.clamp()
        overlay, at = self.overlay(scope), self.snapshot(scope)
        base = at.index()
        if overlay is not None:
            return workspace.search_merged(base, overlay, query, own.max_results, at.table("postings"), **filters), applied
        symbols = base.symbols.join(base.files.select("file_id", "path"), "file_id", "left")
        return search.search(symbols, at.table("postings"), query, own.max_results, **filters), applied

    def search_text(self, scope: Scope, pattern: str, path_prefix: str | None = None, glob: str | None = None, ignore_case: bool = False, budget: Budget = Budget()) -> Answer:
        """Lines that a pattern meets. With an index of texts, of the snapshot's files only those that hold the
        pattern's trigrams are read; what the workspace or the request brings is always searched."""
        own, applied = budget.clamp()
        at, overlay = self.snapshot(scope), self.overlay(scope)
        files, index, need = self.index(scope, at=at).files, at.trigrams(), trigrams.need(pattern)
        if index is not None and need is not None:
            paths = trigrams.candidates(index, need)
            if overlay is not None:
                paths = paths.unionByName(overlay.files.filter("path is not null").select("path"))
            typed = [p.lower() for p in scope.virtual_files] if scope.consistency == "Ephemeral" else []
            paths = paths.unionByName(files.filter(F.lower("path").isin(typed)).select("path")) if typed else paths
            files = among(files, "path", paths)
        return spans.search_text(files, pattern, path_prefix, glob, ignore_case, own.max_results), applied

    def references(self, scope: Scope, symbol_id: str, kind: str | None = None, state: str | None = None, budget: Budget = Budget()) -> Answer:
        own, applied = budget.clamp()
        view = self.index(scope)
        self._known(scope, view, symbol_id)
        refs_ = view.refs.filter(F.col("to_symbol_id") == symbol_id)
        return refs.find(self._one(symbol_id), refs_, view.files, kind, state, own.max_references), applied

    def callers(self, scope: Scope, symbol_id: str, budget: Budget = Budget(), follow_interface: bool = False) -> Answer:
        own, applied = budget.clamp()
        at = self.snapshot(scope)
        self._known(scope, self.index(scope, at=at), symbol_id)
        base = at.index()
        more = (base.type_relations, base.symbols) if follow_interface else (None, None)
        return graph.callers(self._one(symbol_id, "root"), self.calls(scope, at, True), *more, depth=own.max_depth, per_level=own.max_references)[0], applied

    def callees(self, scope: Scope, symbol_id: str, budget: Budget = Budget()) -> Answer:
        own, applied = budget.clamp()
        at = self.snapshot(scope)
        self._known(scope, self.index(scope, at=at), symbol_id)
        return graph.callees(self._one(symbol_id, "root"), self.calls(scope, at, False), own.max_depth, own.max_references)[0], applied

    def trace(self, scope: Scope, symbol_id: str, budget: Budget = Budget()) -> Answer:
        own, applied = budget.clamp()
        at = self.snapshot(scope)
        view = self.index(scope, at=at)
        self._known(scope, view, symbol_id)
        return graph.trace(self._one(symbol_id, "root"), self.calls(scope, at, False), view.facts, own.max_depth, own.max_references, view.symbols, own.max_references), applied

    def definition(self, scope: Scope, symbol_id: str, context: int = 2, budget: Budget = Budget()) -> Answer:
        own, applied = budget.clamp()
        view = self.index(scope)
        self._known(scope, view, symbol_id)
        asked = view.symbols.filter(F.col("symbol_id") == symbol_id)
        return spans.definitions(asked, view.files, context, own.max_lines, own.max_chars), applied

    def context(self, scope: Scope, symbol_id: str, callee_depth: int = 1, max_callees: int = 10) -> DataFrame:
        at = self.snapshot(scope)
        view = self.index(scope, at=at)
        self._known(scope, view, symbol_id)
        return spans.contexts(self._one(symbol_id), self.calls(scope, at, False), view.symbols, view.files, view.facts, callee_depth, max_callees)

    def _known(self, scope: Scope, view: Index, symbol_id: str) -> None:
        """An error for a symbol that the workspace deleted, and one that the view does not hold."""
        own = self.overlay(scope)
        if own is not None and not own.deleted.filter(F.col("symbol_id") == symbol_id).isEmpty():
            raise LookupError(f"NOT_FOUND: symbol {symbol_id} (deleted in workspace {scope.workspace_id})")
        if view.symbols.filter(F.col("symbol_id") == symbol_id).isEmpty():
            raise LookupError(f"NOT_FOUND: symbol {symbol_id}")

    def _one(self, symbol_id: str, column: str = "symbol_id") -> DataFrame:
        return self.spark.createDataFrame([(symbol_id,)], f"{column} string")
