"""A workspace's overlay: applying what was read again, and search and graphs over the merged view."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgrid.functions import text as X
from symgrid.operators import graph, overlay, refs, search
from symgrid.operators.adjacency import Adjacency, among, by_file, sides
from symgrid.operators.hierarchy import derived_merged
from symgrid.schema import LEVELS, Index
from symgrid.session import dealt, durable


@dataclass(frozen=True)
class Overlay:
    """What a workspace changed: its files and their rows, and the deleted symbols (symbol_id, stable_id)."""

    files: DataFrame
    symbols: DataFrame
    refs: DataFrame
    facts: DataFrame
    type_relations: DataFrame
    deleted: DataFrame
    revision: int = 0


def empty(baseline: Index) -> Overlay:
    none = lambda df: df.limit(0)
    return Overlay(none(baseline.files), none(baseline.symbols), none(baseline.refs), none(baseline.facts), none(baseline.type_relations), none(baseline.symbols).select("symbol_id", "stable_id"))


def apply(own: Overlay, fresh: Index, gone: DataFrame, removed: DataFrame | None = None) -> Overlay:
    """The overlay after a revision: `fresh` holds the files read again and their rows, `gone` the symbols
    that they lost (symbol_id, stable_id), `removed` files that were deleted (file_id).

    In this order: earlier rows of these files go, references to and from their earlier symbols too;
    deleted symbols are hidden; then files, symbols, references, relations and facts come in. A symbol
    that comes back is no longer deleted.
    """
    touched = fresh.files.select("file_id")
    if removed is not None:
        touched = touched.unionByName(removed.select("file_id"))
    touched = touched.distinct()
    kept = lambda df: df.join(touched, "file_id", "left_anti")
    earlier = own.symbols.join(touched, "file_id", "left_semi").select("symbol_id").distinct()
    to, from_ = (earlier.withColumnRenamed("symbol_id", c) for c in ("to_symbol_id", "from_symbol_id"))
    edges = kept(own.refs).join(to, "to_symbol_id", "left_anti").join(from_, "from_symbol_id", "left_anti").select(own.refs.columns)
    symbols = overlay.symbols(kept(own.symbols).select(own.symbols.columns), fresh.symbols.select(own.symbols.columns), gone).drop("origin")
    relations = own.type_relations.join(earlier.withColumnRenamed("symbol_id", "type_symbol_id"), "type_symbol_id", "left_anti")
    relations = relations.join(fresh.type_relations.select("type_symbol_id").distinct(), "type_symbol_id", "left_anti").select(own.type_relations.columns)
    facts = kept(own.facts).join(earlier, "symbol_id", "left_anti").select(own.facts.columns)
    files = kept(own.files).select(own.files.columns).unionByName(fresh.files.select(own.files.columns))
    if removed is not None:
        # A deleted file stays known, without content, so that its baseline rows are hidden.
        ghost = removed.select("file_id").distinct().select(*[F.col(c) if c == "file_id" else F.lit(None).cast(own.files.schema[c].dataType).alias(c) for c in own.files.columns])
        files = files.unionByName(ghost)
    deleted = own.deleted.unionByName(gone.select(own.deleted.columns)).distinct().join(fresh.symbols.select("symbol_id").distinct(), "symbol_id", "left_anti").select(own.deleted.columns)
    return Overlay(
        files, symbols, edges.unionByName(fresh.refs.select(own.refs.columns)), facts.unionByName(fresh.facts.select(own.facts.columns)),
        relations.unionByName(fresh.type_relations.select(own.type_relations.columns)), deleted, own.revision + 1,
    )


def lost(before: DataFrame, fresh: Index, removed: DataFrame | None = None) -> DataFrame:
    """symbol_id, stable_id of the symbols (before: the view compared with) of the files read again or
    deleted that are not among the fresh ones."""
    touched = fresh.files.select("file_id")
    if removed is not None:
        touched = touched.unionByName(removed.select("file_id"))
    old = before.join(touched.distinct(), "file_id", "left_semi")
    return old.join(fresh.symbols.select("symbol_id").distinct(), "symbol_id", "left_anti").select("symbol_id", "stable_id").distinct()


def refresh(baseline: Index, own: Overlay, fresh: Index, removed: DataFrame | None = None, seed: Overlay | None = None, level: str = "Full") -> Overlay:
    """The overlay after files were read again: what they lost against the baseline is deleted (against
    the seed's merged view, for a workspace that starts from another's), the rows are applied, and
    references without target are bound to the baseline's symbols, unless only syntax was read."""
    before = baseline.symbols
    if seed is not None:
        before = before.unionByName(seed.symbols.select(before.columns)) if seed is own else merged(baseline, seed).symbols.select(before.columns)
    out = apply(own, fresh, lost(before, fresh, removed), removed)
    if level == "SyntaxOnly":
        return out
    again = fresh.files.select("file_id").distinct()
    part = refs.resolve(out.refs.join(again, "file_id", "left_semi").select(out.refs.columns), baseline.symbols, baseline.files)
    rest = out.refs.join(again, "file_id", "left_anti").select(out.refs.columns)
    return Overlay(out.files, out.symbols, rest.unionByName(part), out.facts, out.type_relations, out.deleted, out.revision)


def merged(baseline: Index, own: Overlay) -> Index:
    """The index as the workspace sees it. Symbols have a column origin (baseline or overlay)."""
    files = baseline.files.join(own.files.select("file_id").distinct(), "file_id", "left_anti").select(baseline.files.columns)
    symbols = overlay.symbols(baseline.symbols, own.symbols.select(baseline.symbols.columns), own.deleted, own.files)
    facts = overlay.facts_of_symbols(overlay.by_file(baseline.facts, own.facts.limit(0), own.files), own.facts)
    facts = facts.join(own.deleted.select("symbol_id").distinct(), "symbol_id", "left_anti").select(baseline.facts.columns)
    relations = derived_merged(baseline.type_relations, own.type_relations, own.files, baseline.symbols, own.deleted).select(baseline.type_relations.columns)
    return Index(files.unionByName(own.files.select(files.columns)), symbols, merged_refs(baseline.refs, own), facts, relations)


def merged_refs(baseline: DataFrame, own: Overlay) -> DataFrame:
    """References of the overlay, and the baseline's from files that the overlay does not hold; none
    from or to a deleted symbol."""
    out = overlay.by_file(baseline, own.refs, own.files)
    for c in ("from_symbol_id", "to_symbol_id"):
        out = out.join(own.deleted.select(F.col("symbol_id").alias(c)).distinct(), c, "left_anti")
    return out.select(baseline.columns)


def calls(edges: Adjacency, own: Overlay, incoming: bool) -> Adjacency:
    """A snapshot's published edges as the workspace sees them: without those of files that the overlay
    holds, with the overlay's, none from or to a deleted symbol. Only the edges that a search reads
    are compared with the overlay."""
    more = by_file(sides(own.refs, incoming))
    return edges.without(files=own.files).with_edges(more).without(own.deleted.select(F.col("symbol_id").alias("node")))


def callers(roots: DataFrame, baseline: Index, own: Overlay, depth: int = 2, per_level: int | None = None, follow_interface: bool = False, edges: Adjacency | None = None) -> tuple[DataFrame, DataFrame]:
    """Breadth-first callers in the workspace, along the snapshot's published edges if given. Deleted roots
    are not searched. Interface members are taken from the baseline's relations, as the overlay's edits
    seldom change them."""
    live = roots.join(own.deleted.select(F.col("symbol_id").alias("root")).distinct(), "root", "left_anti")
    more = (baseline.type_relations, baseline.symbols) if follow_interface else (None, None)
    return graph.callers(live, merged_refs(baseline.refs, own) if edges is None else calls(edges, own, True), *more, depth=depth, per_level=per_level)


def callees(roots: DataFrame, baseline: Index, own: Overlay, depth: int = 2, per_level: int | None = None, edges: Adjacency | None = None) -> tuple[DataFrame, DataFrame]:
    live = roots.join(own.deleted.select(F.col("symbol_id").alias("root")).distinct(), "root", "left_anti")
    return graph.callees(live, merged_refs(baseline.refs, own) if edges is None else calls(edges, own, False), depth, per_level)


def search_merged(baseline: Index, own: Overlay, query: str, limit: int = 20, index: DataFrame | None = None, **filters) -> DataFrame:
    """Ranked hits in the merged view with `score` and `origin`: the overlay's first, each side best first.
    Hits with one symbol_id, or one stable_id, in one project count once, before the limit; truncated
    says whether there were more.

    Two tiers answer: the snapshot's postings (`index`, published with file_id and stable_id; computed if
    not given), read by the query's prefixes, less what the overlay hides, and the overlay's own."""
    symbols = overlay.symbols(baseline.symbols, own.symbols.select(baseline.symbols.columns), own.deleted, own.files)
    gone = baseline.files.join(own.files.select("file_id").distinct(), "file_id", "left_anti")
    paths = gone.select("file_id", "path").unionByName(own.files.select("file_id", "path"))
    text = X.sanitize_query(query)
    asked = X.query_tokens(text)
    if asked:
        # Tokens cost far more than their symbols' bytes let expect: if not published, they are made once, dealt out by rows.
        tiers = [search.postings(dealt(s) if index is None else s, "file_id", "stable_id") for s in (baseline.symbols, own.symbols)]
        tokens = overlay.symbols(tiers[0] if index is None else index, tiers[1], own.deleted, own.files)
        # Prefixes go into the scan of the first tier, below the comparison with the overlay.
        found = search.matching(tokens, text)
        symbols = among(symbols, "symbol_id", durable(found) if index is None else found)
    hits = search.filtered(symbols.join(paths, "file_id", "left"), **filters)
    display = X.display_name(F.col("fqname"))
    score = X.relevance(display, F.col("fqname"), X.name_tokens(display), text, asked) if asked else F.lit(0)
    hits = hits.withColumn("score", score).withColumn("src_rank", F.when(F.col("origin") == "overlay", 0).otherwise(1))
    hits = hits.withColumn("ord", F.struct("src_rank", (-F.col("score")).alias("s"), *([] if asked else ["fqname"]), "symbol_id"))
    hits = overlay.scoped_distinct(hits, "ord")
    named = hits.filter("stable_id is not null")
    once = Window.partitionBy("stable_id", F.lower(F.coalesce("project_name", F.lit("")))).orderBy("ord")
    named = named.withColumn("__n", F.row_number().over(once)).filter("__n = 1").drop("__n")
    hits = named.unionByName(hits.filter("stable_id is null"))
    return search.truncated(hits, [F.col("ord")], limit).orderBy("ord").drop("ord", "src_rank")


def merge_levels(baseline: DataFrame, own: DataFrame, key: str = "repo_id") -> DataFrame:
    """key, level: of both sides' levels the worse; of one side, that."""
    rank = lambda c: F.array_position(F.lit(LEVELS), F.col(c))
    both = baseline.select(key, F.col("level").alias("b")).join(own.select(key, F.col("level").alias("o")), key, "full_outer")
    worse = F.greatest(*[F.when(F.col(c).isNotNull(), rank(c)) for c in ("b", "o")])
    return both.select(key, F.when(worse > 0, F.get(F.lit(LEVELS), worse.cast("int") - 1)).alias("level"))


def fact_count(own: Overlay) -> int:
    return own.facts.count()
