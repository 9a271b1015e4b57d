"""References: lookups with excerpts, late resolution of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgrid.functions import text as X
from symgrid.operators.adjacency import among
from symgrid.session import durable


def selected(refs: DataFrame, kind: str | None = None, state: str | None = None) -> DataFrame:
    out = refs
    if kind:
        out = out.filter(F.col("ref_kind") == kind)
    if state:
        out = out.filter(F.col("resolution_state") == state)
    return out


def find(anchors: DataFrame, refs: DataFrame, files: DataFrame, kind: str | None = None, state: str | None = None, limit: int = 50, with_excerpt: bool = True) -> DataFrame:
    """References to the anchors (symbol_id), the first `limit` of each by path, position and source;
    references into unknown files are dropped, unknown symbols stay."""
    own = selected(refs, kind, state).join(anchors.select(F.col("symbol_id").alias("to_symbol_id")).distinct(), "to_symbol_id", "left_semi")
    own = own.join(files.select("file_id", "path"), "file_id")
    order = Window.partitionBy("to_symbol_id").orderBy("path", "loc_start", "loc_end", "from_symbol_id", "ref_kind")
    own = own.withColumn("ord", F.row_number().over(order)).filter(F.col("ord") <= limit)
    if with_excerpt:
        # A file is cut into lines once, whatever the number of references into it.
        wanted = own.groupBy("file_id").agg(F.collect_set("loc_start").alias("at")).join(files.select("file_id", "content"), "file_id")
        cut = wanted.select("file_id", "at", F.explode(F.array(X.lines_of(F.col("content")))).alias("lines"))
        said = cut.select("file_id", F.explode(F.transform("at", lambda n: F.struct(n.alias("loc_start"), F.get("lines", n - 1).alias("line")))).alias("x"))
        said = said.select("file_id", "x.loc_start", X.excerpt(F.col("x.line")).alias("excerpt"))
        own = own.join(said, ["file_id", "loc_start"], "left")
    return own


def outgoing(anchors: DataFrame, refs: DataFrame) -> DataFrame:
    return refs.join(anchors.select(F.col("symbol_id").alias("from_symbol_id")).distinct(), "from_symbol_id", "left_semi")


#: Length of the stretch of a hint by which it looks for symbols of a name.
STRETCH = 4


def resolve(refs: DataFrame, symbols: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """refs with unresolved names bound: to the one symbol of that member name (the end of its full name
    before the parameters), or of several to the one whose full name or file's path holds the container
    hint in any case; this and base are no hints. A name with none or several stays unresolved.

    Symbols are counted per name first, so a name with one needs no hint. Of a name with several, hints and
    symbols meet by a stretch of the hint, which a symbol that holds the hint holds too, and not by the name
    alone: a name that very many symbols have does not pair all its hints with all of them."""
    # Computed once, as few beside the references: these may be a view of joins.
    open_ = durable(refs.filter("resolution_state = 'Unresolved' and to_name is not null").select("to_name", F.lower(F.coalesce("to_container_hint", F.lit(""))).alias("hint")).distinct())
    known = symbols if files is None else symbols.join(files.select("file_id", "path"), "file_id", "left")
    path = F.lower(F.coalesce("path", F.lit(""))) if "path" in known.columns else F.lit("")
    known = known.select("symbol_id", F.lower("fqname").alias("full"), path.alias("path"), F.regexp_extract(F.substring_index("fqname", "(", 1), "([^.:]*)$", 1).alias("to_name"))
    # One row per name: the least and the greatest id are the same if there is one symbol.
    names = open_.select("to_name").distinct()
    several = durable(known.join(names, "to_name", "left_semi").groupBy("to_name").agg(F.min("symbol_id").alias("any"), F.max("symbol_id").alias("last")))
    asked = open_.join(several, "to_name")
    alone = asked.filter(F.col("any") == F.col("last")).select("to_name", "hint", F.col("any").alias("bound"))
    # Short hints are their own stretch, at every length that one has.
    hinted = asked.filter((F.col("any") != F.col("last")) & ~F.col("hint").isin("", "this", "base")).select("to_name", "hint", F.substring("hint", 1, STRETCH).alias("stretch"))

    def stretches(text: Column) -> Column:
        # Overlapping matches: a look-ahead gives the stretch at every place, in one pass.
        return F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in range(1, STRETCH + 1)]))

    many = several.filter(F.col("any") != F.col("last")).select("to_name")
    placed = known.join(many, "to_name", "left_semi").select("*", F.explode(F.array_distinct(F.concat(stretches(F.col("full")), stretches(F.col("path"))))).alias("stretch"))
    # Stretches that no hint has go before the rows move, as most hints begin with few.
    pairs = among(placed, "stretch", hinted.select("stretch").distinct()).join(hinted, ["to_name", "stretch"])
    hits = pairs.filter(F.contains("full", F.col("hint")) | F.contains("path", F.col("hint"))).groupBy("to_name", "hint").agg(F.min("symbol_id").alias("bound"), F.max("symbol_id").alias("last"))
    # Computed once: a view of a workspace is read many times.
    one = durable(alone.unionByName(hits.filter(F.col("bound") == F.col("last")).select("to_name", "hint", "bound")))
    out = refs.withColumn("hint", F.lower(F.coalesce("to_container_hint", F.lit("")))).join(one, ["to_name", "hint"], "left")
    late = (F.col("resolution_state") == "Unresolved") & F.col("bound").isNotNull()
    return out.withColumn("to_symbol_id", F.when(late, F.col("bound")).otherwise(F.col("to_symbol_id"))).withColumn("resolution_state", F.when(late, "Resolved").otherwise(F.col("resolution_state"))).select(refs.columns)
