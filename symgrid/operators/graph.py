"""Graph operators over references: bounded breadth-first search for a batch of roots, closures, traces.

The frontier of all roots advances together, one join a level, over edges that were summed up once
(`adjacency`). Depth is at most six, so the driver's loop is short.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgrid.functions import text as X
from symgrid.operators import blocks
from symgrid.operators.adjacency import FEW, REACHED, Adjacency, Front, among, dealt_out, front, of_refs, sides
from symgrid.schema import CAPS
from symgrid.session import durable


def adjacency(refs: DataFrame | Adjacency, incoming: bool = False) -> Adjacency:
    return refs if isinstance(refs, Adjacency) else of_refs(refs, incoming)


def bfs(roots: DataFrame, edges: Adjacency, depth: int = 3, per_level: int | None = None, first: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """roots: root, node (one row per start). Returns nodes (root, node, depth, truncated) and edges
    (root, parent, child, depth of the parent). `first`: edges (node, next) of the first level only.

    Every edge of an expanded node is kept, also to visited ones. With per_level, a level takes its
    new nodes in the order of parents and edges and stops at that many; later ones are cut and the
    level says so (truncated on its nodes' rows). The last level of a large search has most of the rows: it is
    left to whoever reads the nodes, and not stored.
    """
    depth = clamped(depth)
    # place: a node's place in its level, which orders its children under a limit.
    place = F.lit(0) if per_level is None else F.row_number().over(Window.partitionBy("root").orderBy("node"))
    now = front(roots.select("root", "node").distinct().select("root", "node", place.alias("place"), F.lit(0).alias("depth"), F.lit(False).alias("truncated")))
    visited, walked, growth, seen = now.rows, [], 1.0, now.count
    for level in range(1, depth + 1):
        expected = now.count * growth
        step = edges.step(now, reached=expected)
        if level == 1 and first is not None:
            # Calls through interfaces come after a node's own.
            last = F.struct(F.lit("~").alias("file_id"), F.lit(0).alias("loc_start"), F.col("next").alias("id"))
            step = step.unionByName(now.rows.join(first, "node").select(*now.rows.columns, "next", last.alias("ord")))
        walked.append(step.select("root", F.col("node").alias("parent"), F.col("next").alias("child"), "depth"))
        fresh = step.select("root", F.col("next").alias("child"), "place", "ord")
        if per_level is None:
            known = nearest(visited, fresh, level, seen + expected)
            new = known.filter(F.col("depth") == level)
        else:
            fresh = fresh.join(visited.select("root", F.col("node").alias("child")), ["root", "child"], "left_anti")
            at = fresh.groupBy("root", "child").agg(F.min(F.struct("place", "ord")).alias("at"))
            at = at.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy("at", "child")))
            more = F.count("*").over(Window.partitionBy("root")) > per_level
            new = at.select("root", F.col("child").alias("node"), "place", F.lit(level).alias("depth"), more.alias("truncated")).filter(F.col("place") <= per_level)
        if level == depth and now.nodes is None:
            visited = visited.unionByName(new) if per_level is not None else known
            break
        before, now = now.count, front(new, small=now.nodes is not None)
        if not now.count:
            break
        growth, seen = max(1.0, now.count / before), seen + now.count
        visited = visited.unionByName(now.rows)
    out = reduce(DataFrame.unionByName, walked)
    # A root reaches a node once, so pairs that are there once are walked once.
    return visited.drop("place"), out if edges.pairs and first is None else out.distinct()


def nearest(visited: DataFrame, fresh: DataFrame, level: int, expected: float) -> DataFrame:
    """The nodes visited before and those of fresh (root, child), each once, at its least depth. Both are grouped
    in one shuffle, in tasks by their expected rows: an optimizer moves an anti-join before a repartitioning."""
    reached = fresh.select("root", "child", F.lit(level).alias("depth"))
    both = dealt_by(visited.select("root", F.col("node").alias("child"), "depth").unionByName(reached), expected)
    least = both.groupBy("root", "child").agg(F.min("depth").alias("depth"))
    return least.select("root", F.col("child").alias("node"), F.lit(0).alias("place"), "depth", F.lit(False).alias("truncated"))


def dealt_by(fresh: DataFrame, expected: float) -> DataFrame:
    """The rows by root and child, in more tasks than a shuffle has if so many are expected: a frontier grows
    from level to level, so the tables' size says little of its own."""
    return dealt_out(fresh, int(expected // REACHED), "root", "child")


def clamped(depth: int) -> int:
    return min(max(depth, 1), CAPS.max_depth)


def windowed_edges(refs: DataFrame, files: DataFrame, incoming: bool, limit: int, compat: bool = False) -> DataFrame:
    """call_edges with at most limit + 1 neighbours per node, by path and position. compat counts
    other references too when it looks at the first 2 * (limit + 1), as the surveyed engine does."""
    a, b = ("to_symbol_id", "from_symbol_id") if incoming else ("from_symbol_id", "to_symbol_id")
    own = refs.filter("to_symbol_id <> '' and from_symbol_id <> ''").join(files.select("file_id", "path"), "file_id", "left")
    if compat:
        w = Window.partitionBy(a).orderBy("path", "loc_start", "loc_end", b, "ref_kind")
        own = own.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= 2 * (limit + 1))
    own = own.filter("ref_kind in ('Call', 'Instantiate')").groupBy(F.col(a).alias("node"), F.col(b).alias("next")).agg(F.min(F.struct("path", "loc_start", b)).alias("ord"))
    w = Window.partitionBy("node").orderBy("ord")
    return own.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= limit + 1).drop("__n")


def hydrate(nodes: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """nodes (node) with fqname, kind, path, line; an unknown symbol has its id as name, kind Method, line 0."""
    own = symbols.join(files.select("file_id", "path"), "file_id", "left").select(F.col("symbol_id").alias("node"), "fqname", "kind", "path", "span_start")
    out = nodes.join(own, "node", "left")
    return out.select(*nodes.columns, F.coalesce("fqname", "node").alias("fqname"), F.coalesce("kind", F.lit("Method")).alias("kind"), "path", F.coalesce("span_start", F.lit(0)).alias("line"))


def interface_members(anchors: DataFrame, type_relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbol_id, member: for a member K:Container.Name(args) every existing K:Interface.Name(args) of
    the interfaces that its container implements. An explicit implementation's name is peeled first."""
    own = anchors.select("symbol_id").distinct()
    own = own.select("symbol_id", F.substring("symbol_id", 1, 2).alias("k"), F.regexp_extract("symbol_id", "^.:([^(]*)", 1).alias("path"), F.regexp_extract("symbol_id", "(\\(.*\\))$", 1).alias("args"))
    own = own.withColumn("container", F.regexp_replace("path", "\\.[^.]*$", "")).withColumn("name", F.element_at(F.split(F.regexp_replace("path", "#", "."), "\\."), -1))
    types = own.select(F.explode(F.array("container", F.concat(F.lit("T:"), "container"))).alias("type")).distinct()
    relations = among(type_relations, "type_symbol_id", types)
    iface = relations.filter("relation_kind = 'Interface'").select(F.regexp_replace("type_symbol_id", "^T:", "").alias("container"), F.regexp_replace("related_symbol_id", "^T:", "").alias("iface"))
    made = own.join(iface, "container").select("symbol_id", F.concat("k", "iface", F.lit("."), "name", "args").alias("member"))
    known = among(symbols, "symbol_id", made.select("member").distinct()).select(F.col("symbol_id").alias("member"))
    return made.join(known, "member", "left_semi").distinct()


def callers_by_interface(anchors: DataFrame, type_relations: DataFrame, symbols: DataFrame, refs: DataFrame | Adjacency) -> DataFrame:
    """symbol_id, caller: callers of the interface members that the anchors implement."""
    members = interface_members(anchors, type_relations, symbols).select("symbol_id", F.col("member").alias("node"))
    return adjacency(refs, incoming=True).step(front(members)).select("symbol_id", F.col("next").alias("caller")).distinct()


def interface_hint(anchors: DataFrame, type_relations: DataFrame, symbols: DataFrame, refs: DataFrame | Adjacency, cap: int = 50) -> DataFrame:
    """symbol_id, hint: how many distinct callers come through interfaces, counted up to the cap."""
    return callers_by_interface(anchors, type_relations, symbols, refs).groupBy("symbol_id").agg(F.least(F.count("*"), F.lit(cap)).alias("hint"))


def callers(roots: DataFrame, refs: DataFrame | Adjacency, type_relations: DataFrame | None = None, symbols: DataFrame | None = None, depth: int = 2, per_level: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Breadth-first callers of roots (root). With relations and symbols, the first level (no other) also
    takes the callers of the interface members that a root implements."""
    edges, first = adjacency(refs, incoming=True), None
    if type_relations is not None and symbols is not None:
        more = callers_by_interface(roots.select(F.col("root").alias("symbol_id")), type_relations, symbols, edges)
        first = more.select(F.col("symbol_id").alias("node"), F.col("caller").alias("next"))
    return bfs(roots.select("root", F.col("root").alias("node")), edges, depth, per_level, first)


def callees(roots: DataFrame, refs: DataFrame | Adjacency, depth: int = 2, per_level: int | None = None) -> tuple[DataFrame, DataFrame]:
    return bfs(roots.select("root", F.col("root").alias("node")), adjacency(refs), depth, per_level)


def reached(roots: DataFrame, refs: DataFrame | Adjacency, depth: int, incoming: bool = False) -> DataFrame:
    """root, node, depth of an unlimited search from roots (root), without the edges that it walked: more than FEW
    roots go by blocks, and by rows only where a block reaches too much for one task."""
    edges, left, out = adjacency(refs, incoming), roots, None
    if len(roots.select("root").distinct().limit(FEW + 1).collect()) > FEW:
        out, left = blocks.reached(roots, edges, clamped(depth))
    if left is not None:
        by_rows = bfs(left.select("root", F.col("root").alias("node")), edges, depth)[0].select("root", "node", "depth")
        out = by_rows if out is None else out.unionByName(by_rows)
    return out


def first_callees(roots: DataFrame, refs: DataFrame | Adjacency, depth: int, most: int) -> DataFrame:
    """root, node, depth (1 or 2): the first `most` callees of each root (root, distinct) by depth and id.

    Of a node's callees the first most + 1 by id suffice: if the root and its k < most callees are left out, which
    are all known, the first most - k of the second level have at most k + 1 and most - k - 1 before them in any
    list. So a node is one row with a short list, and the second level moves lists, not all that it reaches.
    A published search goes from its roots, and reads only what they reach."""
    if isinstance(refs, Adjacency):
        found = callees(roots, refs, depth)[0].filter("depth > 0").withColumn("__n", F.row_number().over(Window.partitionBy("root").orderBy("depth", "node")))
        return found.filter(F.col("__n") <= most).select("root", "node", "depth")
    few = sides(refs, False).select("node", "next").distinct().withColumn("__n", F.row_number().over(Window.partitionBy("node").orderBy("next"))).filter(F.col("__n") <= most + 1)
    lists = durable(few.groupBy("node").agg(F.array_sort(F.collect_list("next")).alias("next")))
    start = roots.join(lists.withColumnRenamed("node", "root"), "root").select("root", F.slice(F.array_remove("next", F.col("root")), 1, most).alias("one"))
    placed = lambda nodes, n: F.transform(nodes, lambda x: F.struct(x.alias("node"), F.lit(n).alias("depth")))
    if depth == 1:
        return start.select("root", F.inline(placed(F.col("one"), 1)))
    start = durable(start)
    steps = start.filter(F.size("one") < most).select("root", F.explode("one").alias("node")).join(lists, "node", "left")
    both = steps.groupBy("root").agg(F.collect_set("node").alias("one"), F.flatten(F.collect_list("next")).alias("two"))
    two = F.slice(F.array_sort(F.array_except("two", F.concat("one", F.array("root")))), F.lit(1), F.lit(most) - F.size("one"))
    full = start.filter(F.size("one") >= most).select("root", placed(F.col("one"), 1).alias("found"))
    found = durable(full.unionByName(both.select("root", F.concat(placed(F.col("one"), 1), placed(two, 2)).alias("found"))))
    return found.select("root", F.inline("found"))


def trace(roots: DataFrame, refs: DataFrame | Adjacency, facts: DataFrame, depth: int = 3, per_level: int | None = None, symbols: DataFrame | None = None, max_rows: int | None = CAPS.max_references) -> DataFrame:
    """Paths from each root along the edges that the search walked, cycles unrolled to the depth (1 to 6):
    root, node, depth, path, and facts (kind:text before the first pipe, sorted, comma-joined). With
    symbols, also name (the signature, else the id), stable_id and is_decompiled. A level keeps the
    first max_rows paths of a root in their order, and `truncated` says that it had more; None keeps all.

    A search without a limit per level walks every edge of what it reaches, so paths then go along the edges
    themselves. All paths of many roots are far more than the edges: what facts and symbols say comes with the
    edges that lead to a node, and the last level, which has most of the rows, isn't moved again.
    """
    depth, edges, walked = clamped(depth), adjacency(refs), None
    said = facts.select(F.col("symbol_id").alias("node"), F.concat_ws(":", "fact_kind", F.trim(X.before_pipe(F.col("value")))).alias("f")).distinct()
    cards = said.groupBy("node").agg(F.array_join(F.array_sort(F.collect_list("f")), ",").alias("facts"))
    columns = ["root", "node", "depth", "path", F.coalesce("card.facts", F.lit("")).alias("facts"), "truncated"]
    if symbols is not None:
        cards = cards.join(symbols.select(F.col("symbol_id").alias("node"), "signature", "stable_id", "is_decompiled"), "node", "full_outer")
        columns += [F.coalesce("card.signature", "node").alias("name"), "card.stable_id", (F.coalesce("card.is_decompiled", F.lit(1)) != 0).alias("is_decompiled")]
    cards = cards.select("node", F.struct(*cards.columns[1:]).alias("card"))
    if per_level is not None:
        walked = durable(callees(roots, edges, depth, per_level)[1].select("root", F.col("parent").alias("node"), F.col("child").alias("next")).distinct())

    def longer(step: DataFrame, n: int, *more: str) -> DataFrame:
        return step.select("root", F.col("next").alias("node"), F.lit(n).alias("depth"), F.concat("path", F.array("next")).alias("path"), F.lit(False).alias("truncated"), *more)

    level = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.array("root").alias("path"), F.lit(False).alias("truncated"))
    # plain: levels that get their cards at the end; carded: those that bring them.
    plain, carded, told = [level], [], None
    for n in range(1, depth + 1):
        if walked is None:
            now = front(level)
            if plain[-1] is level:
                plain[-1] = now.rows
            if max_rows is None and now.nodes is None:
                told = told or edges.told(cards)
                carded.append(longer(told.step(now, "card"), n, "card"))
                level = longer(edges.step(now), n) if edges.pairs else longer(edges.step(now), n).distinct()
                continue
            level = longer(edges.step(now), n) if edges.pairs else longer(edges.step(now), n).distinct()
        else:
            level = longer(level.join(walked, ["root", "node"]), n)
        if max_rows is not None:
            w = Window.partitionBy("root")
            level = level.withColumn("truncated", F.count("*").over(w) > max_rows).withColumn("__n", F.row_number().over(w.orderBy("path"))).filter(F.col("__n") <= max_rows).drop("__n")
        plain.append(level)
    out = reduce(DataFrame.unionByName, plain).join(cards, "node", "left").select(columns)
    return reduce(DataFrame.unionByName, [c.select(columns) for c in carded], out)


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node: everything reachable from the starts (node) along edges (node, next), themselves
    included. The frontier of all starts advances together, so only what they reach is kept; rounds are
    as many as the longest path. For graphs of projects; of symbols, use bfs."""
    edges = durable(edges.select("node", "next").distinct())
    front = durable(starts.select(F.col("node").alias("start"), "node").distinct())
    parts = [front]
    while not front.isEmpty():
        seen = parts[0]
        for p in parts[1:]:
            seen = seen.unionByName(p)
        if len(parts) > 20:
            # Few, long plans rather than ever longer ones.
            seen = durable(seen)
            parts = [seen]
        front = durable(front.join(edges, "node").select("start", F.col("next").alias("node")).distinct().join(seen, ["start", "node"], "left_anti"))
        parts.append(front)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
