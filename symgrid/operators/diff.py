"""Semantic diff of two snapshots: symbols by stable id, then by id; facts by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgrid.functions import text as X


def _first(df: DataFrame, *key: str) -> DataFrame:
    """The first row of each key; nulls are kept apart by the callers."""
    w = Window.partitionBy(*key).orderBy("symbol_id", "signature", "visibility")
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def symbols(before: DataFrame, after: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """change, stable_id, from_id, to_id, kind, and signature and visibility of both sides.

    A pair with one stable id is Renamed if its ids differ, else SignatureChanged, else
    VisibilityChanged, else silent. What is left of the first snapshot is matched by id: a match is
    silent or SignatureChanged (without a stable id), no match is Removed. What is left of the second
    is Added. Kinds (of the first side, of the second for Added) are filtered after matching.
    """
    columns = ["symbol_id", "stable_id", "kind", "signature", "visibility"]
    a, b = before.select(*columns), after.select(*columns)
    a1, b1 = _first(a.filter("stable_id is not null"), "stable_id"), _first(b.filter("stable_id is not null"), "stable_id")
    side = lambda df, s: df.select(*[F.col(c).alias(f"{s}_{c}") for c in columns])
    paired = side(a1, "a").join(side(b1, "b"), F.col("a_stable_id") == F.col("b_stable_id"))
    change = F.when(F.col("a_symbol_id") != F.col("b_symbol_id"), "Renamed").when(~F.col("a_signature").eqNullSafe(F.col("b_signature")), "SignatureChanged").when(~F.col("a_visibility").eqNullSafe(F.col("b_visibility")), "VisibilityChanged")
    one = paired.withColumn("change", change).withColumn("stable_id", F.col("a_stable_id"))
    rest_a = _first(a.join(paired.select(F.col("a_symbol_id").alias("symbol_id")), "symbol_id", "left_anti"), "symbol_id")
    rest_b = _first(b.join(paired.select(F.col("b_symbol_id").alias("symbol_id")), "symbol_id", "left_anti"), "symbol_id")
    two = side(rest_a, "a").join(side(rest_b, "b"), F.col("a_symbol_id") == F.col("b_symbol_id"), "full_outer")
    change = F.when(F.col("b_symbol_id").isNull(), "Removed").when(F.col("a_symbol_id").isNull(), "Added").when(~F.col("a_signature").eqNullSafe(F.col("b_signature")), "SignatureChanged")
    two = two.withColumn("change", change).withColumn("stable_id", F.when(F.col("change") == "Removed", F.col("a_stable_id")).when(F.col("change") == "Added", F.col("b_stable_id")))
    out = one.unionByName(two).filter("change is not null")
    out = out.select("change", "stable_id", F.col("a_symbol_id").alias("from_id"), F.col("b_symbol_id").alias("to_id"), F.coalesce("a_kind", "b_kind").alias("kind"), F.col("a_signature").alias("from_signature"), F.col("b_signature").alias("to_signature"), F.col("a_visibility").alias("from_visibility"), F.col("b_visibility").alias("to_visibility"))
    return out.filter(F.col("kind").isin(kinds)) if kinds else out


def fact_key(qualified: bool = False) -> Column:
    """What identifies a fact over snapshots. Keys are not qualified by kind unless asked."""
    own = F.when(F.col("fact_kind") == "Route", F.col("value")).when(F.col("fact_kind").isin("Config", "DbTable"), X.before_pipe(F.col("value"))).when(F.col("fact_kind") == "DiRegistration", F.trim(F.substring_index("value", "→", 1))).otherwise(F.concat_ws(":", "fact_kind", "value"))
    return F.concat_ws("\0", F.col("fact_kind"), own) if qualified else own


def facts(before: DataFrame, after: DataFrame, per_kind: int | None = 500, qualified: bool = False) -> DataFrame:
    """change (Added, Removed, Changed), key, from_value, to_value. The first per_kind facts of a kind by
    value take part (None: all); of equal keys, the first by kind and value."""

    def side(df: DataFrame, name: str) -> DataFrame:
        own = df.select("fact_kind", "value", fact_key(qualified).alias("key"))
        if per_kind is not None:
            own = own.withColumn("__n", F.row_number().over(Window.partitionBy("fact_kind").orderBy("value"))).filter(F.col("__n") <= per_kind)
        return own.groupBy("key").agg(F.min(F.struct("fact_kind", "value")).alias("first")).select("key", F.col("first.value").alias(f"{name}_value"))

    both = side(before, "from").join(side(after, "to"), "key", "full_outer")
    change = F.when(F.col("from_value").isNull(), "Added").when(F.col("to_value").isNull(), "Removed").when(F.col("from_value") != F.col("to_value"), "Changed")
    return both.select(change.alias("change"), "key", "from_value", "to_value").filter("change is not null")


def stats(changes: DataFrame) -> DataFrame:
    """One row: how many symbols were added, removed, renamed and changed."""
    names = {"Added": "added", "Removed": "removed", "Renamed": "renamed", "SignatureChanged": "signature_changed", "VisibilityChanged": "visibility_changed"}
    return changes.agg(*[F.count_if(F.col("change") == k).alias(v) for k, v in names.items()])
