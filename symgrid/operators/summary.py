"""Summaries and exports of a snapshot as numbered lines of sections, cut to a budget of tokens.

Every section is bounded by its caps, so the lines are few whatever the snapshot's size; rendering to
Markdown or JSON happens on the driver.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgrid.functions import text as X
from symgrid.operators import report
from symgrid.operators.identity import is_made, is_test
from symgrid.schema import Index

# Sections with the name that selects them, in order, and the kinds of facts that fill them.
SECTIONS = [
    ("overview", "Solution Overview", []),
    ("api", "API Surface", ["Route"]),
    ("data", "Data Layer", ["DbTable"]),
    ("config", "Configuration", ["Config"]),
    ("di", "Dependency Injection", ["DiRegistration"]),
    ("di", "Blazor Components", ["RazorInject", "RazorParameter"]),
    ("middleware", "Middleware Pipeline", ["Middleware"]),
    ("resilience", "Resilience", ["RetryPolicy"]),
    ("exceptions", "Error Handling", ["Exception"]),
    ("logging", "Logging", ["Log"]),
    ("metrics", "Key Metrics", []),
    ("public_api", "Public API Surface", []),
    ("dependencies", "Service Dependencies", []),
    ("interfaces", "Interface Contracts", []),
    ("all_symbols", "All Symbols", []),
    ("references", "Reference Matrix", []),
]
NUMBER = {title: i for i, (_, title, _) in enumerate(SECTIONS)}
DETAILS = {"summary": 11, "standard": 14, "full": 16}
API_KINDS, MEMBER_KINDS = ["Class", "Interface", "Record", "Struct"], ["Method", "Property"]


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c, F.lit("")) for c in cells]), F.lit(" |"))


def _lines(df: DataFrame, title: str, at: tuple, line: Column, items: Column | int = 1) -> DataFrame:
    """sec, at (the order in the section), line, items (what the line counts for)."""
    a, b, c = (x if isinstance(x, Column) else F.lit(x) for x in at)
    items = items if isinstance(items, Column) else F.lit(items)
    order = F.struct(a.cast("string").alias("a"), b.cast("int").alias("b"), c.cast("int").alias("c"))
    return df.select(F.lit(NUMBER[title]).alias("sec"), order.alias("at"), line.alias("line"), items.cast("int").alias("items"))


def _fact_lines(facts: DataFrame, cap: int) -> DataFrame:
    own = report.parsed(report.capped(facts, cap))
    short = X.short_name(F.col("symbol_id"))
    of = lambda title, kind, at, line, df=own: _lines(df.filter(F.col("fact_kind") == kind), title, at, line)
    ord_, head, tail = F.col("ord"), F.col("head"), F.coalesce("tail", F.lit(""))
    first = Window.partitionBy("fact_kind", F.lower("head")).orderBy("ord")
    tables = own.withColumn("__n", F.row_number().over(first)).filter("__n = 1")
    group = F.substring_index("head", ":", 1)
    config = own.filter("fact_kind = 'Config'")
    component = F.element_at(F.split("symbol_id", "\\."), -1)
    parts = [
        of("API Surface", "Route", ("", 0, ord_), _row(head, tail, short), own.filter("instr(value, ' ') > 0")),
        of("Data Layer", "DbTable", ("", 0, ord_), _row(head, tail), tables),
        _lines(config.select(group.alias("g")).distinct(), "Configuration", (F.col("g"), 0, 0), F.concat(F.lit("### "), F.col("g")), 0),
        of("Configuration", "Config", (group, 1, ord_), F.concat(F.lit("- `"), head, F.lit("` — "), tail)),
        of("Dependency Injection", "DiRegistration", ("", 0, ord_), _row(head, F.when(tail == "", head).otherwise(tail), F.col("lifetime")), own.filter("instr(value, '|') > 0")),
        of("Blazor Components", "RazorInject", ("inject", 0, ord_), _row(component, head, tail)),
        of("Blazor Components", "RazorParameter", ("parameter", 0, ord_), _row(component, head, tail)),
        of("Middleware Pipeline", "Middleware", ("", F.coalesce("position", F.lit(0)), ord_), F.concat(F.coalesce("position", F.lit(0)).cast("string"), F.lit(". "), head, F.when(F.col("terminal"), " *(terminal)*").otherwise(""))),
        of("Resilience", "RetryPolicy", ("", 0, ord_), F.concat(F.lit("- "), head, F.lit(" — "), tail)),
        of("Error Handling", "Exception", ("", 0, ord_), _row(head, tail, short)),
        of("Logging", "Log", ("", 0, ord_), _row(tail, head, short)),
    ]
    return reduce(DataFrame.unionByName, parts)


def _project_lines(facts: DataFrame, projects: DataFrame, cap: int) -> DataFrame:
    all_ = projects.agg(F.count("*").alias("n"), F.coalesce(F.sum("symbol_count"), F.lit(0)).alias("s"), F.coalesce(F.sum("reference_count"), F.lit(0)).alias("r"), F.count_if("compiled").alias("ok"))
    level = F.when(F.col("ok") == F.col("n"), "Full").when(F.col("ok") == 0, "SyntaxOnly").otherwise("Partial")
    counted = facts.groupBy("fact_kind").agg(F.least(F.count("*"), F.lit(cap)).alias("n"))
    number = F.format_string
    n = F.col("n").cast("long")
    kinds = [k for _, _, some in SECTIONS for k in some]
    place = F.array_position(F.lit(kinds), F.col("fact_kind"))
    return reduce(DataFrame.unionByName, [
        _lines(all_, "Solution Overview", ("", 0, 0), number("%d projects, %d symbols, %d references", n, F.col("s"), F.col("r")), 0),
        _lines(all_, "Solution Overview", ("", 1, 0), F.concat(F.lit("Semantic level: "), level), 0),
        _lines(projects, "Solution Overview", (F.concat(F.lit("~"), "project_name"), 0, 0), _row(F.col("project_name"), F.when(F.col("compiled"), "✓").otherwise("✗"), F.col("symbol_count").cast("string"))),
        _lines(all_, "Key Metrics", ("", 0, 0), number("- Projects: %d, symbols: %d, references: %d", n, F.col("s"), F.col("r")), 0),
        _lines(counted, "Key Metrics", ("", 1, place), number("- %s: %d", F.col("fact_kind"), n), n),
        _lines(all_, "Key Metrics", ("~", 0, 0), F.concat(F.lit("- Index quality: "), level), 0),
    ])


def _first(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def _detail_lines(index: Index, detail: str) -> DataFrame:
    """Types (100 at most) with members (of the first 1,000), what services call, interfaces, and in full
    detail symbols and references; without tests and made types unless in full detail."""
    paths = index.files.select("file_id", "path")
    symbols = index.symbols.join(paths, "file_id", "left").withColumn("full", X.strip_doc_id(F.col("fqname")))
    order = ["fqname", "symbol_id"]
    types, members = (_first(symbols.filter(F.col("kind").isin(k)), n, *order) for k, n in ((API_KINDS, 100), (MEMBER_KINDS, 1_000)))
    if detail != "full":
        types, members = types.filter(~is_test(F.col("path")) & ~is_made(F.col("fqname"))), members.filter(~is_test(F.col("path")))
    mine = members.select(X.parent_name(F.col("fqname")).alias("full"), F.col("signature").alias("said"), F.col("fqname").alias("member"), F.col("symbol_id").alias("member_id"))
    held = types.select("full", "kind", "symbol_id").join(mine, "full").withColumn("ord", F.row_number().over(Window.partitionBy("full", "symbol_id").orderBy("member", "member_id")))
    said = F.concat(F.lit("- `"), F.col("said"), F.lit("`"))
    key = F.concat_ws("\0", "full", "symbol_id")
    api = _lines(types, "Public API Surface", (key, 0, 0), F.concat(F.lit("### "), F.col("kind"), F.lit(" `"), F.col("full"), F.lit("`")))
    contracts = types.filter("kind = 'Interface'")
    services = _first(report.services(types), 20, *order)
    # Few symbols are told of: their references are found where they lie, and paths are asked for these alone.
    out = index.refs.filter("ref_kind = 'Call'").join(F.broadcast(services.select(F.col("symbol_id").alias("from_symbol_id"), F.col("full").alias("service"))), "from_symbol_id").join(paths, "file_id", "left")  # 20 rows
    by = Window.partitionBy("from_symbol_id").orderBy("path", "loc_start", "loc_end", "to_symbol_id")
    calls = out.withColumn("n", F.row_number().over(by)).filter("n <= 10 and resolution_state = 'Resolved' and to_symbol_id <> ''").groupBy("service", "to_symbol_id").agg(F.min("n").alias("n"))
    calls = calls.withColumn("k", F.row_number().over(Window.partitionBy("service").orderBy("n"))).filter("k <= 5")
    parts = [
        api,
        _lines(held.filter("ord <= 20"), "Public API Surface", (key, 1, F.col("ord")), said, 0),
        _lines(calls.select("service").distinct(), "Service Dependencies", (F.col("service"), 0, 0), F.concat(F.lit("**"), F.substring_index("service", ".", -2), F.lit("** calls:"))),
        _lines(calls, "Service Dependencies", (F.col("service"), 1, F.col("k")), F.concat(F.lit("  → "), X.short_name(F.col("to_symbol_id"))), 0),
        _lines(contracts, "Interface Contracts", (key, 0, 0), F.concat(F.lit("#### `"), F.col("full"), F.lit("`"))),
        _lines(held.filter("ord <= 15 and kind = 'Interface'"), "Interface Contracts", (key, 1, F.col("ord")), said, 0),
    ]
    if detail == "full":
        few = _first(symbols, 500, *order)
        parts.append(_lines(few, "All Symbols", (F.concat_ws("\0", *order), 0, 0), _row(F.col("kind"), F.concat(F.lit("`"), X.short_name(F.col("fqname")), F.lit("`")), F.col("path"), F.col("span_start").cast("string"))))
        some = _first(types, 30, *order)
        out = index.refs.join(F.broadcast(some.select(F.col("symbol_id").alias("from_symbol_id"), "fqname")), "from_symbol_id").join(paths, "file_id", "left")  # 30 rows
        out = out.withColumn("n", F.row_number().over(by)).filter("n <= 10 and resolution_state = 'Resolved' and to_symbol_id <> ''")
        parts.append(_lines(out, "Reference Matrix", (F.concat_ws("\0", "fqname", "from_symbol_id"), 0, F.col("n")), _row(X.short_name(F.col("fqname")), F.col("ref_kind"), X.short_name(F.col("to_symbol_id"))), 0))
    return reduce(DataFrame.unionByName, parts)


def _numbered(lines: DataFrame, only: list[str] | None) -> DataFrame:
    if only:
        wanted = [i for i, (name, _, _) in enumerate(SECTIONS) if name in {o.lower() for o in only}]
        lines = lines.filter(F.col("sec").isin(wanted))
    titles = F.lit([t for _, t, _ in SECTIONS])
    own = lines.withColumn("ord", F.row_number().over(Window.partitionBy("sec").orderBy("at", "line")))
    return own.select("sec", F.get(titles, F.col("sec")).alias("section"), "ord", "line", F.sum("items").over(Window.partitionBy("sec")).alias("items"))


def summary(facts: DataFrame, projects: DataFrame, cap: int = 50, only: list[str] | None = None) -> DataFrame:
    """sec, section, ord, line, items (things in the section): the sections that have lines, of those named
    in `only` if any. Of each kind the first `cap` facts by value are shown."""
    cap = max(cap, 1)
    return _numbered(_fact_lines(facts, cap).unionByName(_project_lines(facts, projects, cap)), only)


def export(index: Index, projects: DataFrame, detail: str = "standard", max_tokens: int = 4_000, only: list[str] | None = None) -> DataFrame:
    """The lines of `summary`, in standard detail also of types, services and interfaces, in full detail
    also of symbols and references, cut to a budget; truncated marks the section that was cut.

    A section costs a quarter of its characters. Sections come in while the budget lasts, those after
    the summary while a tenth of it is left; the one that crosses it keeps the whole lines that fit, or
    if its first does not fit, that line's start."""
    lines = _fact_lines(index.facts, 50).unionByName(_project_lines(index.facts, projects, 50))
    if detail != "summary":
        lines = lines.unionByName(_detail_lines(index, detail))
    return within(_numbered(lines.filter(F.col("sec") < DETAILS[detail]), only), max(max_tokens, 100))


def within(lines: DataFrame, budget: int) -> DataFrame:
    """lines: sec, section, ord, line, items. The lines that a budget of tokens leaves."""
    size = F.length("line") + 1
    costs = lines.groupBy("sec").agg(F.floor(F.sum(size) / 4).alias("cost"))
    # One row per section.
    spent = costs.withColumn("spent", F.coalesce(F.sum("cost").over(Window.orderBy("sec").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    gate = F.when(F.col("sec") < DETAILS["summary"], budget).otherwise(0.9 * budget)
    open_ = spent.filter(F.col("spent") < gate).select("sec", ((budget - F.col("spent")) * 4).alias("left"), (F.col("spent") + F.col("cost") > budget).alias("truncated"))
    run = F.sum(size).over(Window.partitionBy("sec").orderBy("ord"))
    own = lines.withColumn("__run", run).join(open_, "sec")
    fits = ~F.col("truncated") | (F.col("__run") <= F.col("left"))
    part = F.col("truncated") & (F.col("ord") == 1) & (F.col("__run") > F.col("left"))
    return own.filter(fits | part).select("sec", "section", "ord", F.when(part, F.expr("substring(line, 1, cast(left as int))")).otherwise(F.col("line")).alias("line"), "items", "truncated")


def render(lines: DataFrame, solution: str, format: str = "markdown") -> str:
    """The text of already cut lines, on the driver."""
    rows = lines.orderBy("sec", "ord").collect()
    sections: dict[str, dict] = {}
    for r in rows:
        own = sections.setdefault(r["section"], {"title": r["section"], "item_count": r["items"], "lines": []})
        own["lines"].append(r["line"])
    if format == "json":
        return json.dumps({"solution": solution, "sections": [{"title": s["title"], "item_count": s["item_count"], "content": "\n".join(s["lines"])} for s in sections.values()]}, ensure_ascii=False)
    return "\n\n".join([f"# {solution}", *("\n".join([f"## {s['title']} ({s['item_count']})", *s["lines"]]) for s in sections.values())])
