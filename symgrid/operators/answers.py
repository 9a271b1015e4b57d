"""Sentences on results, as columns. Their wording is a fixed value: clients show and match it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _said(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _counted(n: Column, one: str, more: str | None = None) -> Column:
    """A number and what it counts."""
    return _said(n, " ", F.when(n == 1, one).otherwise(more or one + "s"))


def _if(condition: Column, *parts: Column | str) -> Column:
    return F.when(condition, _said(*parts)).otherwise("")


def _or(nothing: Column, sentence: Column, otherwise: Column) -> Column:
    return F.when(nothing, sentence).otherwise(otherwise)


def search(n: Column, query: Column, truncated: Column) -> Column:
    return _or(n == 0, _said("No symbols found matching '", query, "'."), _said("Found ", n, " symbols matching '", query, "'", _if(truncated, " (truncated)"), ". Use symbols.get_card for details."))


def card(kind: Column, fqname: Column, signature: Column) -> Column:
    return _said(kind, " ", fqname, " — ", signature)


def span(path: Column, start: Column, stop: Column, lines: Column) -> Column:
    return _said("Lines ", start, "–", stop, " of ", path, " (", lines, " total)")


def definition(kind: Column, fqname: Column, start: Column, stop: Column) -> Column:
    return _said("Definition of ", kind, " ", fqname, " — lines ", start, "–", stop)


def references(symbol_id: Column, n: Column, kind: Column | None, truncated: Column) -> Column:
    of = F.lit("") if kind is None else _if(kind.isNotNull(), " (kind: ", F.coalesce(kind, F.lit("")), ")")
    return _or(n == 0, _said("No references found for '", symbol_id, "'", of, "."), _said("Found ", _counted(n, "reference"), " to '", symbol_id, "'", of, _if(truncated, " (showing first ", n, ")"), "."))


def call_graph(symbol_id: Column, direction: Column, n: Column, depth: Column, truncated: Column) -> Column:
    """direction: callers or callees."""
    at = _said(" (depth: ", depth, ")")
    return _or(n == 0, _said("No ", direction, " found for '", symbol_id, "'", at, "."), _said("Found ", n, " ", direction, " of '", symbol_id, "'", at, _if(truncated, " (truncated)"), "."))


def hierarchy(symbol_id: Column, base: Column, interfaces: Column, derived: Column) -> Column:
    """base: the base type's name, or null."""
    parts = F.array_compact(F.array(F.when(base.isNotNull(), _said("base: ", base)), F.when(interfaces > 0, _counted(interfaces, "interface")), F.when(derived > 0, _counted(derived, "derived type"))))
    return _or(F.size(parts) == 0, _said("Type '", symbol_id, "' has no hierarchy relationships."), _said("Type '", symbol_id, "' — ", F.array_join(parts, ", "), "."))


def surface(what: str, n: Column, truncated: Column, path: Column | None = None, method: Column | None = None, key_prefix: Column | None = None, table_prefix: Column | None = None) -> Column:
    """what: HTTP endpoint, configuration key or database table. Filters that are null or empty are not named."""
    named = [("path: ", path, "'"), ("method: ", method, ""), ("key prefix: ", key_prefix, "'"), ("table prefix: ", table_prefix, "'")]
    filters = F.array_compact(F.array(*[F.when(c != "", _said(label, mark, c, mark)) for label, c, mark in named if c is not None])) if any(c is not None for _, c, _ in named) else F.array().cast("array<string>")
    return _or(n == 0, F.lit(f"No {what}s found."), _said("Found ", _counted(n, what), _if(F.size(filters) > 0, " (", F.array_join(filters, ", "), ")"), _if(truncated, " (truncated)"), "."))


def trace(name: Column, n: Column, depth: Column, truncated: Column) -> Column:
    return _said("Traced feature from '", name, "' across ", _counted(n, "node"), " at depth ", depth, _if(truncated, " (truncated)"), ".")


def summary(solution: Column, sections: Column, facts: Column) -> Column:
    return _said("Summary of '", solution, "': ", _counted(sections, "section"), ", ", _counted(facts, "fact"), " indexed.")


def context(name: Column, callees: Column, found: Column) -> Column:
    more = _if(found > callees, " (", found, " total found, showing ", callees, ")")
    return _or(callees > 0, _said("Context for '", name, "': card + code + ", _counted(callees, "callee"), more, "."), _said("Context for '", name, "': card + code (no callees found)."))


def text(pattern: Column, n: Column, files: Column, truncated: Column) -> Column:
    of = _said(" for `", pattern, "` ")
    return F.when(n == 0, _said("No matches", of, "in ", files, " indexed files.")).when(truncated, _said("Found ", n, "+ matches", of, "across ", files, " files (results capped — increase limit to see more).")).otherwise(_said("Found ", _counted(n, "match", "matches"), of, "across ", files, " files."))
