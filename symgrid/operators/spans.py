"""Text of files: line spans, definitions, contexts, regular-expression search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgrid.functions import text as X


def read_spans(requests: DataFrame, files: DataFrame, context: int = 0, max_lines: int = 400, max_chars: int = 40_000, gutter: bool = False) -> DataFrame:
    """requests: path, first, last (1-based). Adds total_lines, start, stop, code, clamped: the span with
    its context lines, cut to the file, to max_lines and to max_chars."""
    own = requests.join(files.select("path", X.lines_of(F.col("content")).alias("__lines")), "path")
    cut = _cut(F.col("__lines"), F.col("first"), F.col("last"), context, max_lines, max_chars, gutter)
    return own.select(*requests.columns, cut.alias("__cut")).select(*requests.columns, "__cut.*")


def _cut(lines: Column, first: Column, last: Column, context: int, max_lines: int, max_chars: int, gutter: bool = False) -> Column:
    """total_lines, start, stop, code, clamped of a span."""
    total = F.size(lines)
    start = F.greatest(F.lit(1), F.least(first, total) - context)
    whole = F.least(total, F.greatest(last, first) + context)
    stop = F.least(whole, start + (max_lines - 1))
    some = F.slice(lines, start, F.greatest(F.lit(0), stop - start + 1))
    if gutter:
        some = F.transform(some, lambda x, i: F.concat(F.lpad((i + start).cast("string"), 5, " "), F.lit(" | "), x))
    said = lambda code: F.struct(total.alias("total_lines"), start.alias("start"), stop.alias("stop"), F.substring(code, 1, max_chars).alias("code"), ((stop < whole) | (F.length(code) > max_chars)).alias("clamped"))
    return X.once(F.array_join(some, "\n"), said)


def definitions(symbols: DataFrame, files: DataFrame, context: int = 2, max_lines: int = 120, max_chars: int = 40_000) -> DataFrame:
    """The code of symbols: symbol_id and the columns of read_spans."""
    asked = symbols.join(files.select("file_id", "path"), "file_id").select("symbol_id", "path", F.col("span_start").alias("first"), F.col("span_end").alias("last"))
    return read_spans(asked, files, context, max_lines, max_chars)


def contexts(anchors: DataFrame, edges: DataFrame, symbols: DataFrame, files: DataFrame, facts: DataFrame | None = None, callee_depth: int = 1, max_callees: int = 10, own_lines: int = 200, callee_lines: int = 50) -> DataFrame:
    """For each anchor symbol one row of its own card and code (role self) and one per callee, the first
    max_callees (25 at most) by depth (callee_depth, 0 to 2) and id. Callees without a symbol are left
    out; a symbol without a span has no code. With facts, a card holds its symbol's, sorted."""
    from symgrid.operators.graph import first_callees

    depth, most = min(max(callee_depth, 0), 2), min(max(max_callees, 0), 25)
    asked = anchors.select(F.col("symbol_id").alias("root")).distinct()
    chosen = asked.select("root", F.col("root").alias("symbol_id"), F.lit(0).alias("depth"))
    if depth and most:
        chosen = chosen.unionByName(first_callees(asked, edges, depth, most).select("root", F.col("node").alias("symbol_id"), "depth"))
    card = symbols.join(chosen.select("symbol_id").distinct(), "symbol_id", "left_semi").select("symbol_id", "fqname", "kind", "signature", "visibility", "file_id", "span_start", "span_end")
    # Only texts of files that hold a symbol move; each is cut into lines once, and a symbol's code once for both roles.
    spans = card.filter("span_start > 0 and span_end > 0").select("symbol_id", "file_id", "span_start", "span_end")
    held = files.join(spans.select("file_id").distinct(), "file_id", "left_semi").select("file_id", "path", X.lines_of(F.col("content")).alias("__lines"))
    code = lambda most: _cut(F.col("__lines"), F.col("span_start"), F.col("span_end"), 0, most, 40_000)
    cut = spans.join(held, "file_id").select("symbol_id", "path", code(own_lines).alias("self"), code(callee_lines).alias("callee"))
    card = card.drop("file_id", "span_start", "span_end").join(cut, "symbol_id", "left")
    out = chosen.withColumn("role", F.when(F.col("depth") == 0, "self").otherwise("callee")).join(card, "symbol_id")
    out = out.withColumn("__cut", F.when(F.col("depth") == 0, F.col("self")).otherwise(F.col("callee"))).select("root", "role", "depth", "symbol_id", "fqname", "kind", "signature", "visibility", "path", "__cut.start", "__cut.stop", "__cut.code", "__cut.clamped")
    columns = ["root", "role", "depth", "symbol_id", "fqname", "kind", "signature", "visibility", "path", "start", "stop", "code", "clamped"]
    if facts is not None:
        said = facts.groupBy("symbol_id").agg(F.array_sort(F.collect_list(F.struct("fact_kind", "value"))).alias("facts"))
        out, columns = out.join(said, "symbol_id", "left"), [*columns, "facts"]
    return out.select(*columns)


def contents(files: DataFrame) -> DataFrame:
    """All contents in order of path, any case."""
    return files.filter("content is not null").select("path", "content").orderBy(F.lower("path"), "path")


def search_text(files: DataFrame, pattern: str, path_prefix: str | None = None, glob: str | None = None, ignore_case: bool = False, limit: int = 100) -> DataFrame:
    """path, line, excerpt of the lines that a regular expression meets, in path and line order. At most
    100 rows, as the limit is capped; the pattern is checked first."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"INVALID_ARGUMENT: {e}") from e
    own = files.filter("content is not null")
    if path_prefix:
        own = own.filter(X.starts_with(F.col("path"), path_prefix))
    if glob:
        own = own.filter(F.col("path").rlike(X.glob_regex(glob)))
    expression = ("(?i)" if ignore_case else "") + pattern
    # Whole texts are tested before they are cut into lines.
    own = own.filter(F.col("content").rlike(f"(?m)(?:{expression})" if not ignore_case else f"(?mi)(?:{pattern})")) if not re.search(r"\\[AzZ]|\(\?<?[!=]|[$^]", pattern) else own
    lines = own.select("path", F.posexplode(X.lines_of(F.col("content"))).alias("line", "text"))
    hits = lines.filter(F.col("text").rlike(expression))
    return hits.select("path", (F.col("line") + 1).alias("line"), X.excerpt(F.col("text")).alias("excerpt")).orderBy(F.lower("path"), "path", "line").limit(min(limit, 100))


def overlay_content(files: DataFrame, overlay: DataFrame, virtual: DataFrame | None = None) -> DataFrame:
    """files with the content a workspace sees: a virtual file before an overlay's before the snapshot's."""
    o = overlay.select(F.lower("path").alias("__p"), F.col("content").alias("__o"))
    out = files.withColumn("__p", F.lower("path")).join(o, "__p", "left")
    best = [F.col("__o"), F.col("content")]
    if virtual is not None:
        out = out.join(virtual.select(F.lower("path").alias("__p"), F.col("content").alias("__v")), "__p", "left")
        best = [F.col("__v"), *best]
    return out.withColumn("content", F.coalesce(*best)).select(files.columns)
