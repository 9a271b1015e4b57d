"""Facts as surfaces: endpoints, configuration keys, database tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgrid.functions import text as X
from symgrid.schema import CONFIDENCES


def _limited(df: DataFrame, keep: Column | None, limit: int | None, compat: bool) -> DataFrame:
    """Order by value; compat takes the limit before the filter, as the surveyed engine does."""
    order = ["value", "file_id", "loc_start", "symbol_id"]
    if limit is not None and compat:
        df = df.orderBy(*order).limit(limit)
    if keep is not None:
        df = df.filter(keep)
    return df.orderBy(*order).limit(limit) if limit is not None and not compat else df


def endpoints(facts: DataFrame, method: str | None = None, prefix: str | None = None, limit: int | None = None, compat: bool = False) -> DataFrame:
    own = facts.filter("fact_kind = 'Route'").select("*", F.substring_index("value", " ", 1).alias("method"), F.expr("case when instr(value, ' ') > 0 then substring(value, instr(value, ' ') + 1) else '' end").alias("route"))
    keep = None
    if method:
        keep = F.upper("method") == method.upper()
    if prefix:
        p = X.starts_with(F.col("route"), prefix)
        keep = p if keep is None else keep & p
    return _limited(own, keep, limit, compat)


def config_keys(facts: DataFrame, prefix: str | None = None, limit: int | None = None, compat: bool = False) -> DataFrame:
    own = facts.filter("fact_kind = 'Config'").select("*", X.before_pipe(F.col("value")).alias("key"), F.coalesce(X.after_pipe(F.col("value")), F.lit("unknown")).alias("pattern"))
    return _limited(own, X.starts_with(F.col("key"), prefix) if prefix else None, limit, compat)


def worst(confidence: Column) -> Column:
    """Aggregate: the worst confidence of a group."""
    rank = F.coalesce(F.array_position(F.lit(CONFIDENCES), confidence), F.lit(1))
    return F.element_at(F.lit(CONFIDENCES), F.max(rank).cast("int"))


def db_tables(facts: DataFrame, prefix: str | None = None, limit: int | None = None, compat: bool = False) -> DataFrame:
    """Tables whose name, with or without its schema, begins with the prefix in any case; the first
    `limit` by name. compat reads as many facts as the surveyed engine does, max(10 * limit, 500).
    One row per table name (any case): table (first spelling), schema_name, n_refs, symbols (distinct,
    sorted), confidence (the worst), entity (the first symbol if the first fact is a DbSet)."""
    own = facts.filter("fact_kind = 'DbTable'").select("*", X.before_pipe(F.col("value")).alias("full"), X.after_pipe(F.col("value")).alias("origin"))
    if limit is not None and compat:
        own = own.orderBy("value", "file_id", "loc_start", "symbol_id").limit(max(10 * limit, 500))
    if prefix:
        own = own.filter(X.starts_with(F.col("full"), prefix) | X.starts_with(F.regexp_replace("full", "^[^.]*\\.", ""), prefix))
    first = F.struct("value", "file_id", "loc_start", "symbol_id")
    out = own.groupBy(F.lower("full").alias("k")).agg(
        F.min_by("full", first).alias("full"), F.count("*").alias("n_refs"), F.array_sort(F.collect_set("symbol_id")).alias("symbols"), worst(F.col("confidence")).alias("confidence"),
        F.min_by(F.when(F.col("origin").startswith("DbSet"), F.col("symbol_id")), first).alias("entity"),
    )
    dotted = F.instr("full", ".") > 0
    out = out.select(F.when(dotted, F.regexp_replace("full", "^[^.]*\\.", "")).otherwise(F.col("full")).alias("table"), F.when(dotted, F.substring_index("full", ".", 1)).alias("schema_name"), "n_refs", "symbols", "confidence", "entity")
    return out if limit is None else out.orderBy("table", "schema_name").limit(limit)
