"""Reports: section tables of a snapshot, statistics, an export cut to a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgrid.functions import text as X
from symgrid.operators.identity import is_made, is_test
from symgrid.schema import TYPE_KINDS

SERVICE = "(Service|Controller|Handler|Repository|Manager|Processor)$"


def capped(facts: DataFrame, cap: int = 50, kinds: list[str] | None = None) -> DataFrame:
    """The first `cap` facts of each kind by value, with the kind's total and whether it was cut."""
    own = facts if kinds is None else facts.filter(F.col("fact_kind").isin(kinds))
    w = Window.partitionBy("fact_kind").orderBy("value", "file_id", "loc_start", "symbol_id")
    totals = own.groupBy("fact_kind").agg(F.count("*").alias("total"))
    return own.withColumn("ord", F.row_number().over(w)).filter(F.col("ord") <= cap).join(totals, "fact_kind").withColumn("truncated", F.col("total") > cap)


def parsed(facts: DataFrame) -> DataFrame:
    """Facts with head and tail of their value's grammar, and a pipeline position."""
    v = F.col("value")
    split = lambda sep: (F.substring_index(v, sep, 1), F.when(F.instr(v, sep) > 0, F.expr(f"substring(value, instr(value, '{sep}') + {len(sep)})")))
    arrow, colon, space = split("→"), split(": "), split(" ")
    kind = F.col("fact_kind")
    head = F.when(kind == "Route", space[0]).when(kind == "DiRegistration", F.trim(arrow[0])).when(kind.isin("RazorInject", "RazorParameter"), colon[0]).otherwise(X.before_pipe(v))
    tail = F.when(kind == "Route", space[1]).when(kind == "DiRegistration", F.trim(F.regexp_replace(arrow[1], "\\|[^|]*$", ""))).when(kind.isin("RazorInject", "RazorParameter"), colon[1]).otherwise(X.after_pipe(v))
    position = F.when(kind == "Middleware", F.regexp_extract(v, "\\|pos:(\\d+)", 1))
    return facts.select("*", head.alias("head"), tail.alias("tail"), F.when(kind == "DiRegistration", X.after_last_pipe(v)).alias("lifetime"), F.when(position != "", position.cast("int")).alias("position"), F.coalesce(v.endswith("|terminal") & (kind == "Middleware"), F.lit(False)).alias("terminal"))


def config_groups(facts: DataFrame) -> DataFrame:
    """Settings by the first segment of their key."""
    own = facts.filter("fact_kind = 'Config'").select(X.before_pipe(F.col("value")).alias("key"))
    return own.groupBy(F.substring_index("key", ":", 1).alias("section")).agg(F.count_distinct("key").alias("n_keys"), F.count("*").alias("n"))


def statistics(facts: DataFrame, symbols: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """stat, n: totals, facts by kind, distinct exception types and log templates, sums over projects."""
    own = facts.groupBy(F.concat(F.lit("facts."), "fact_kind").alias("stat")).agg(F.count("*").alias("n"))
    kinds = {"Exception": "exception_types", "Log": "log_templates"}
    heads = facts.filter(F.col("fact_kind").isin(list(kinds))).select("fact_kind", X.before_pipe(F.col("value")).alias("h"))
    heads = heads.groupBy(F.when(F.col("fact_kind") == "Exception", "exception_types").otherwise("log_templates").alias("stat")).agg(F.count_distinct("h").alias("n"))
    out = own.unionByName(heads).unionByName(symbols.agg(F.count("*").alias("n")).select(F.lit("symbols").alias("stat"), "n"))
    if projects is not None:
        for c, name in (("symbol_count", "project_symbols"), ("reference_count", "project_references")):
            out = out.unionByName(projects.agg(F.coalesce(F.sum(c), F.lit(0)).alias("n")).select(F.lit(name).alias("stat"), "n"))
    return out


def semantic_level(projects: DataFrame, *by: str) -> DataFrame:
    """Full if all projects compiled, SyntaxOnly if none, else Partial; of each group `by`, if any."""
    n, ok = F.count("*"), F.count_if("compiled")
    return projects.groupBy(*by).agg(F.when(ok == n, "Full").when(ok == 0, "SyntaxOnly").otherwise("Partial").alias("level"))


def members(symbols: DataFrame, per_type: int = 20, per_interface: int = 15) -> DataFrame:
    """Types and their first members by name: parent, kind, member, ord."""
    types = symbols.filter(F.col("kind").isin("Class", "Struct", "Interface", "Record", "Enum")).select(X.strip_doc_id(F.col("fqname")).alias("parent"), "kind")
    own = symbols.filter(~F.col("kind").isin("Class", "Struct", "Interface", "Record", "Enum", "Delegate")).select(X.parent_name(F.col("fqname")).alias("parent"), F.col("fqname").alias("member"), "symbol_id")
    both = types.distinct().join(own, "parent")
    w = Window.partitionBy("parent", "kind").orderBy("member", "symbol_id")
    return both.withColumn("ord", F.row_number().over(w)).filter(F.col("ord") <= F.when(F.col("kind") == "Interface", per_interface).otherwise(per_type)).select("parent", "kind", "member", "ord")


def services(symbols: DataFrame) -> DataFrame:
    """Types by the end of their full name, without projects of tests and what the compiler made."""
    path = F.col("path") if "path" in symbols.columns else F.lit(None).cast("string")
    return symbols.filter(F.col("kind").isin(TYPE_KINDS) & ~is_test(path) & ~is_made(F.col("fqname")) & F.col("fqname").rlike("(?i)" + SERVICE))


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
