"""Type hierarchy, one step up and down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgrid.schema import TYPE_KINDS


def hierarchy(anchors: DataFrame, type_relations: DataFrame, symbols: DataFrame, types_only: bool = False) -> DataFrame:
    """symbol_id, role (base, interface, derived), related_id, name. The base is the first by id; a
    relation to an unknown symbol keeps its id as name. With types_only, an anchor that is a symbol
    but no type gives one row of role error and name INVALID_ARGUMENT."""
    own = anchors.select("symbol_id").distinct()
    wrong = symbols.filter(~F.col("kind").isin(TYPE_KINDS)).select("symbol_id").join(own, "symbol_id", "left_semi").distinct() if types_only else None
    if wrong is not None:
        own = own.join(wrong, "symbol_id", "left_anti")
    up = type_relations.join(own, type_relations.type_symbol_id == own.symbol_id).select("symbol_id", F.col("related_symbol_id").alias("related_id"), "relation_kind")
    base = up.filter("relation_kind = 'BaseType'").groupBy("symbol_id").agg(F.min("related_id").alias("related_id")).withColumn("role", F.lit("base"))
    iface = up.filter("relation_kind = 'Interface'").select("symbol_id", "related_id", F.lit("interface").alias("role"))
    down = type_relations.join(own, type_relations.related_symbol_id == own.symbol_id).select("symbol_id", F.col("type_symbol_id").alias("related_id"), F.lit("derived").alias("role"))
    every = base.unionByName(iface).unionByName(down)
    names = symbols.select(F.col("symbol_id").alias("related_id"), "fqname").withColumn("__n", F.row_number().over(Window.partitionBy("related_id").orderBy("fqname"))).filter("__n = 1").drop("__n")
    out = every.join(names, "related_id", "left").select("symbol_id", "role", "related_id", F.coalesce("fqname", "related_id").alias("name"))
    return out if wrong is None else out.unionByName(wrong.select("symbol_id", F.lit("error").alias("role"), F.lit("").alias("related_id"), F.lit("INVALID_ARGUMENT").alias("name")))


def derived_merged(type_relations: DataFrame, overlay: DataFrame, overlay_files: DataFrame, symbols: DataFrame, deleted: DataFrame) -> DataFrame:
    """Relations as a workspace sees them: those of a type whose file was read again come from the
    overlay, others from the snapshot unless the type was deleted."""
    moved = symbols.join(overlay_files.select("file_id").distinct(), "file_id", "left_semi").select(F.col("symbol_id").alias("type_symbol_id"))
    gone = moved.unionByName(deleted.select(F.col("symbol_id").alias("type_symbol_id"))).unionByName(overlay.select("type_symbol_id")).distinct()
    return type_relations.join(gone, "type_symbol_id", "left_anti").unionByName(overlay)
