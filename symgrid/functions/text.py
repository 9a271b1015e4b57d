"""Column builders for names, tokens, hashes, lines and fact values. All are built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where names come apart, and what separates the words of a query.
CAMEL = "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
SEPARATORS = r"[._\-/\\ \t]+"


def once(value: Column, use) -> Column:
    """use(value), with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def camel_parts(c: Column) -> Column:
    return F.split(c, CAMEL)


def _long_lower(parts: Column) -> Column:
    return F.transform(F.filter(parts, lambda p: F.length(p) > 1), lambda p: F.lower(p))


def strip_doc_id(c: Column) -> Column:
    """A documentation id without its kind letter, parameters and generic arity."""
    return F.regexp_replace(F.regexp_replace(c, "^.:(?=.)", ""), "[(`].*$", "")


def display_name(c: Column) -> Column:
    return F.element_at(F.split(strip_doc_id(c), "\\."), -1)


def short_name(c: Column) -> Column:
    """The last two dotted segments."""
    return F.substring_index(strip_doc_id(c), ".", -2)


def parent_name(c: Column) -> Column:
    """The containing name, empty for a name without dots."""
    return F.when(F.instr(strip_doc_id(c), ".") > 0, F.regexp_replace(strip_doc_id(c), "\\.[^.]*$", "")).otherwise(F.lit(""))


def name_tokens(display: Column) -> Column:
    return F.array_distinct(F.concat(F.array(F.lower(display)), _long_lower(camel_parts(display))))


def tokens(fqname: Column, display: Column, namespace: Column, signature: Column, documentation: Column) -> Column:
    """Search tokens of a symbol: display name and its camel parts, namespace segments, full name,
    words of signature and documentation and their camel parts. Nulls count as empty."""
    text = lambda c: F.coalesce(c, F.lit(""))
    said = F.split(F.concat_ws(" ", text(signature), text(documentation)), "[^a-zA-Z0-9]+")
    every = F.concat(
        F.array(F.lower(text(display)), F.lower(strip_doc_id(text(fqname)))),
        _long_lower(camel_parts(text(display))),
        _long_lower(F.split(text(namespace), "\\.")),
        _long_lower(said),
        F.flatten(F.transform(F.filter(said, lambda w: F.length(w) > 1), lambda w: _long_lower(camel_parts(w)))),
    )
    return F.array_distinct(F.filter(every, lambda t: t != ""))


def query_tokens(query: str) -> list[str]:
    """A search text's tokens: lower-cased segments, and their letter and digit runs of two or more."""
    segments = [s for s in re.split(SEPARATORS, query.strip().rstrip("*").lower()) if s]
    parts = [p for s in segments for p in re.split("(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])", s) if len(p) > 1]
    return list(dict.fromkeys(segments + parts))


def sanitize_query(query: str) -> str:
    """Drops a leading ^ and, where quotes don't pair, all quotes."""
    own = query.strip().lstrip("^").strip()
    return own.replace('"', "") if own.count('"') % 2 else own


def relevance(display: Column, fqname: Column, names: Column, query: str, asked: list[str]) -> Column:
    """100 exact name, 80 exact full name or its end, 40 prefix, else 10; 20 by token coverage; 5 short."""
    q, d, f = query.strip().rstrip("*").lower(), F.lower(display), F.lower(strip_doc_id(fqname))
    base = F.when(d == q, 100).when((f == q) | f.endswith("." + q), 80).when(d.startswith(q), 40).otherwise(10)
    begins = lambda t: F.exists(names, lambda n: n.startswith(t)).cast("int")
    hits = sum((begins(t) for t in asked), F.lit(0))
    return base + F.floor(F.lit(20.0) * hits / max(len(asked), 1)).cast("int") + F.when(F.length(display) < 30, 5).otherwise(0)


def excerpt(c: Column) -> Column:
    """One trimmed line of 200 characters at most."""
    own = F.regexp_replace(c, "^\\s+|\\s+$", "")
    return F.when(F.length(own) > 200, F.concat(F.substring(own, 1, 197), F.lit("..."))).otherwise(own)


def lines_of(content: Column) -> Column:
    """Lines without their carriage returns; a final newline leaves an empty last line."""
    return F.transform(F.split(content, "\n"), lambda x: F.regexp_replace(x, "\r$", ""))


def glob_regex(pattern: str) -> str:
    """** is anything, * anything within a folder, ? one character; case doesn't matter."""
    out = "".join({"**": ".*", "*": "[^/]*", "?": "."}.get(p, re.escape(p)) for p in re.findall(r"\*\*|\*|\?|[^*?]+", pattern))
    return f"(?i)^{out}$"


def starts_with(c: Column, prefix: str) -> Column:
    return F.lower(c).startswith(prefix.lower())


def canonical_path(c: Column) -> Column:
    """Forward slashes, no empty or . segments, .. resolved; null if rooted or escaping."""
    flat = F.translate(c, "\\", "/")
    step = lambda acc, s: F.when(acc.isNull(), acc).when((s == "") | (s == "."), acc).when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1))).otherwise(F.concat(acc, F.array(s)))
    joined = F.array_join(F.aggregate(F.split(flat, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(~flat.startswith("/") & ~flat.rlike("^[A-Za-z]:"), joined)


def language(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.endswith(".cs"), "csharp").when(p.endswith(".vb"), "vb").when(p.endswith(".fs") | p.endswith(".fsi"), "fsharp").when(p.endswith(".razor"), "razor").otherwise("other")


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4)


def stable_id(kind: Column, fqname: Column, project: Column) -> Column:
    """The name-dependent fallback id."""
    return F.concat(F.lit("sym_"), F.substring(F.sha2(F.concat_ws("\0", kind, fqname, F.coalesce(project, F.lit(""))), 256), 1, 16))


def fingerprint(*parts: Column) -> Column:
    """The name-independent id of a symbol's structure."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 16)


def repo_id(url: Column) -> Column:
    """16 hex digits of the hash of a remote's address without scheme, user, .git and case."""
    own = F.lower(F.trim(url))
    own = F.regexp_replace(own, "^[a-z+]+://", "")
    own = F.regexp_replace(own, "^[^@/]*@", "")
    own = F.regexp_replace(F.regexp_replace(own, "^([^/:]+):(?!\\d+/)", "$1/"), "(\\.git)?/*$", "")
    return F.substring(F.sha2(own, 256), 1, 16)


def combine_route(prefix: Column, template: Column) -> Column:
    """A controller's prefix and an action's template as one path."""
    tail = F.regexp_replace(F.coalesce(template, F.lit("")), "^/+", "")
    head = F.regexp_replace(prefix, "/+$", "")
    path = F.when(F.coalesce(template, F.lit("")) == "", head).otherwise(F.concat(head, F.lit("/"), tail))
    return F.when(prefix.isNull(), F.concat(F.lit("/"), tail)).when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def controller_route(route: Column, class_name: Column) -> Column:
    return F.regexp_replace(route, F.lit("(?i)\\[controller\\]"), F.lower(F.regexp_replace(class_name, "Controller$", "")))


# Words and catalogue schemas that are no user tables.
SQL_WORDS = "select where set table database view index inner outer left right cross full on".split()
CATALOGUES = "sys information_schema pg_catalog mysql performance_schema".split()


def sql_tables(c: Column) -> Column:
    """Names after FROM, INTO, UPDATE and JOIN, brackets stripped, one spelling per name, sorted."""
    flat = F.regexp_replace(c, "\\s+", " ")
    found = F.regexp_extract_all(flat, F.lit("(?i)\\b(?:FROM|INTO|UPDATE|JOIN) (\\[?\\w+\\]?\\.?\\[?\\w+\\]?)"), 1)
    bare = F.transform(found, lambda t: F.lower(F.regexp_replace(t, "[\\[\\]]", "")))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda t: ~t.isin(SQL_WORDS) & ~F.substring_index(t, ".", 1).isin(CATALOGUES) & ~t.startswith("sqlite_"))))


def before_pipe(c: Column) -> Column:
    return F.substring_index(c, "|", 1)


def after_pipe(c: Column) -> Column:
    """What follows the first pipe, which may hold more; null without one."""
    return F.when(F.instr(c, "|") > 0, F.substring(c, F.instr(c, "|") + 1, F.length(c)))


def after_last_pipe(c: Column) -> Column:
    return F.when(F.instr(c, "|") > 0, F.substring_index(c, "|", -1))


def doc_summary(xml: Column) -> Column:
    """The summary element's text of a documentation comment."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(xml, "(?s)<summary>(.*?)</summary>", 1), "<[^>]*>", ""), "\\s+", " "))


def member_name(c: Column) -> Column:
    """The simple name of a member from its documentation id."""
    return F.regexp_extract(c, "^.:(?:[^(]*\\.)?([^.(`]+)", 1)


# Estimated tokens saved and prices per thousand tokens.
def saved_by_search(hits: Column) -> Column:
    return F.greatest(F.lit(0), hits * (800 - 50))


def saved_by_span(file_lines: Column, returned: Column) -> Column:
    return F.greatest(F.lit(0), (file_lines - returned) * 10)


def saved_by_context(symbols: Column) -> Column:
    return F.greatest(F.lit(0), symbols * 1_500)


def saved_by_text(files: Column, matches: Column) -> Column:
    return F.greatest(F.lit(0), files * 200 - matches * 20)


PRICES = {"claude_sonnet": "0.003", "claude_opus": "0.015", "gpt4": "0.01"}


def cost_avoided(tokens_saved: Column, price: str) -> Column:
    return (tokens_saved.cast("decimal(18,0)") / F.lit("1000").cast("decimal(5,0)") * F.lit(price).cast("decimal(6,4)")).cast("decimal(18,9)")
