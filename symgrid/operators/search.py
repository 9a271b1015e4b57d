"""Symbol search: postings, ranked prefix search, browsing, point lookups, name resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgrid.functions import text as X
from symgrid.operators.adjacency import among


def postings(symbols: DataFrame, *more: str) -> DataFrame:
    """token, symbol_id (and more columns): the inverted index. Written sorted by token, prefix filters
    prune row groups."""
    own = X.tokens(F.col("fqname"), X.display_name(F.col("fqname")), F.col("namespace"), F.col("signature"), F.col("documentation"))
    return symbols.select(F.explode(own).alias("token"), "symbol_id", *more)


def filtered(symbols: DataFrame, kinds: list[str] | None = None, namespace: str | None = None, path: str | None = None, project: str | None = None, decompiled: bool = True, tests: bool = True) -> DataFrame:
    """Kind membership, namespace and path prefixes, project equality; case matters in kinds only."""
    out = symbols
    if kinds:
        out = out.filter(F.col("kind").isin(kinds))
    if namespace:
        out = out.filter(X.starts_with(F.col("namespace"), namespace))
    if path:
        out = out.filter(X.starts_with(F.col("path"), path))
    if project:
        out = out.filter(F.lower("project_name") == project.lower())
    if not decompiled:
        out = out.filter("coalesce(is_decompiled, 0) = 0")
    if not tests:
        out = out.filter("not coalesce(is_test, false)")
    return out


def matching(index: DataFrame, query: str) -> DataFrame:
    """symbol_id of those whose tokens hold every query token as a prefix. A query token of one
    character stands for the first 50 tokens it begins."""
    asked = X.query_tokens(query)
    found: DataFrame | None = None
    for i, t in enumerate(asked):
        part = index.filter(F.col("token").startswith(t))
        if len(t) == 1:
            some = part.select("token").distinct().orderBy("token").limit(50)
            part = part.join(F.broadcast(some), "token", "left_semi")  # 50 rows
        part = part.select("symbol_id", F.lit(i).alias("t"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return index.select("symbol_id").limit(0)
    return found.groupBy("symbol_id").agg(F.count_distinct("t").alias("n")).filter(F.col("n") == len(asked)).select("symbol_id")


def search(symbols: DataFrame, index: DataFrame, query: str, limit: int = 20, **filters) -> DataFrame:
    """Ranked hits with `score`, best first, ties by symbol_id; filters apply before the limit. Without
    query tokens, browses by the filters in order of name."""
    query = X.sanitize_query(query)
    asked = X.query_tokens(query)
    if not asked:
        return browse(symbols, limit, **filters)
    hits = among(filtered(symbols, **filters), "symbol_id", matching(index, query))
    display = X.display_name(F.col("fqname"))
    return hits.withColumn("score", X.relevance(display, F.col("fqname"), X.name_tokens(display), query, asked)).orderBy(F.desc("score"), "symbol_id").limit(limit)


def browse(symbols: DataFrame, limit: int = 20, **filters) -> DataFrame:
    return filtered(symbols, **filters).withColumn("score", F.lit(0)).orderBy("fqname", "symbol_id").limit(limit)


def truncated(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows in order, and whether there were more: one row beyond the limit is looked at."""
    probe = df.orderBy(*order).limit(limit + 1)
    numbered = probe.select("*", F.row_number().over(Window.orderBy(*order)).alias("__n"), F.count("*").over(Window.partitionBy()).alias("__all"))
    return numbered.filter(F.col("__n") <= limit).withColumn("truncated", F.col("__all") > limit).drop("__n", "__all")


def cards(symbols: DataFrame, facts: DataFrame, anchors: DataFrame, key: str = "symbol_id") -> DataFrame:
    """Cards of the anchors' symbols with their facts, sorted; a repeated key keeps the first symbol."""
    own = symbols.join(anchors.select(key).distinct(), key, "left_semi")
    own = own.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("fqname", "file_id", "span_start"))).filter("__n = 1").drop("__n")
    said = facts.select(F.col("symbol_id").alias("__id"), F.struct("fact_kind", "value").alias("fact"))
    said = said.groupBy("__id").agg(F.array_sort(F.collect_list("fact")).alias("facts"))
    return own.join(said, own.symbol_id == said["__id"], "left").drop("__id")


def by_stable_id(symbols: DataFrame, facts: DataFrame, anchors: DataFrame) -> DataFrame:
    return cards(symbols.filter("stable_id is not null"), facts, anchors, "stable_id")


def resolve_names(symbols: DataFrame, names: DataFrame, limit: int = 21) -> DataFrame:
    """names: name. For each the outcome ok, AMBIGUOUS or NOT_FOUND of a lookup by simple or full name,
    the number of different symbols (counted up to limit) and up to five of them, sorted; a name that is
    a symbol's id means that symbol. `resolve` takes one name through ranked search."""
    asked = names.select("name").distinct().withColumn("__k", F.lower("name"))
    keyed = symbols.select("symbol_id", F.explode(F.array_distinct(F.array(F.lower(X.display_name(F.col("fqname"))), F.lower(X.strip_doc_id(F.col("fqname")))))).alias("__k"))
    named = asked.join(symbols.select(F.col("symbol_id").alias("name")), "name", "left_semi").select("name", F.col("name").alias("symbol_id"))
    hits = asked.join(named, "name", "left_anti").join(keyed, "__k").select("name", "symbol_id").distinct().unionByName(named)
    hits = hits.withColumn("__n", F.row_number().over(Window.partitionBy("name").orderBy("symbol_id"))).filter(F.col("__n") <= limit)
    found = hits.groupBy("name").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("__n") <= 5, F.col("symbol_id")))).alias("candidates"))
    out = asked.select("name").join(found, "name", "left")
    status = F.when(F.col("n").isNull(), "NOT_FOUND").when(F.col("n") == 1, "ok").otherwise("AMBIGUOUS")
    return out.select("name", status.alias("outcome"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))


def resolve(symbols: DataFrame, index: DataFrame, query: str, explicit: str | None = None, limit: int = 21) -> DataFrame:
    """One row: outcome (ok, AMBIGUOUS, NOT_FOUND), the number of different symbols found (counted up to
    limit) and up to five of them in order of rank. An explicit id is taken as it is, found or not;
    otherwise a name is resolved through search, so a part of a name finds its symbol too."""
    if explicit:
        return symbols.sparkSession.range(1).select(F.lit("ok").alias("outcome"), F.lit(1).cast("long").alias("n"), F.array(F.lit(explicit)).alias("candidates"))
    hits = search(symbols, index, query, limit).select("symbol_id", "score")
    hits = hits.groupBy("symbol_id").agg(F.max("score").alias("score"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("r"), "symbol_id")))
    found = hits.agg(F.count("*").alias("n"), F.transform(F.slice(ranked, 1, 5), lambda x: x["symbol_id"]).alias("candidates"))
    return found.select(F.when(F.col("n") == 0, "NOT_FOUND").when(F.col("n") == 1, "ok").otherwise("AMBIGUOUS").alias("outcome"), "n", "candidates")


def did_you_mean(asked: DataFrame, known: DataFrame, distance: int = 3) -> DataFrame:
    """asked: name. The closest known name within the edit distance, ties by name.

    A known name is cut into distance + 1 segments, of which so few edits leave one whole, moved by at
    most `distance` places. So names meet by equality of length class, segment and its text."""
    parts = distance + 1
    n, i = F.col("__len"), F.col("__i")
    # Segment i of a name of length n: from floor(n * i / parts) to floor(n * (i + 1) / parts).
    first, size = F.expr(f"cast(__len * __i div {parts} as int)"), F.expr(f"cast(__len * (__i + 1) div {parts} - __len * __i div {parts} as int)")
    pieces = F.explode(F.sequence(F.lit(0), F.lit(distance)))
    k = known.select(F.col("name").alias("suggestion")).distinct().withColumn("__len", F.length("suggestion")).withColumn("__i", pieces)
    k = k.select("suggestion", n, i, F.substring("suggestion", first + 1, size).alias("__text"))
    a = asked.select("name").distinct().withColumn("__len", F.explode(F.sequence(F.greatest(F.lit(0), F.length("name") - distance), F.length("name") + distance))).withColumn("__i", pieces)
    a = a.withColumn("__at", F.explode(F.sequence(F.greatest(F.lit(0), first - distance), F.least(first + distance, F.greatest(F.lit(0), F.length("name"))))))
    a = a.select("name", n, i, F.substring("name", F.col("__at") + 1, size).alias("__text")).distinct()
    pairs = a.join(k, ["__len", "__i", "__text"]).select("name", "suggestion").distinct()
    near = pairs.withColumn("distance", F.levenshtein("name", "suggestion")).filter(F.col("distance") <= distance)
    best = near.groupBy("name").agg(F.min(F.struct("distance", "suggestion")).alias("b"))
    return best.select("name", "b.suggestion", "b.distance")
