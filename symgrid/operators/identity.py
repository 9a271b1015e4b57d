"""Stable identities of symbols, and what a new reading of files changed in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symgrid.functions import text as X
from symgrid.schema import TYPE_KINDS


# Words before a type in a declaration.
MODIFIERS = "public private protected internal static virtual override abstract sealed async readonly partial extern new unsafe".split()


#: Characters that mean something between brackets of a signature, and what stands for them inside of some.
MARKS = " ,()[]<>{}=:"
HIDDEN = "".join(chr(0xE000 + i) for i in range(len(MARKS)))
#: Words before a parameter's type that are not part of it.
PASSING = "this params ref out in scoped readonly".split()


def masked(text: Column) -> Column:
    """text with other characters for blanks, commas, brackets, equals signs and colons that lie inside of
    brackets, so that what is left of them parts the text at depth 0. An arrow closes nothing."""

    def step(acc: Column, t: Column) -> Column:
        closes = t.isin(*")]>}") & (acc["depth"] > 0) & ~((t == ">") & (acc["last"] == "="))
        depth = acc["depth"] - closes.cast("int")
        shown = F.when(depth > 0, F.translate(t, MARKS, HIDDEN)).otherwise(t)
        return F.struct((depth + t.isin(*"([<{").cast("int")).alias("depth"), F.substring(t, -1, 1).alias("last"), F.concat(acc["out"], shown).alias("out"))

    # A step takes a bracket, or all that lies before the next one.
    tokens = F.regexp_extract_all(text, F.lit("[^()\\[\\]<>{}]+|[()\\[\\]<>{}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("last"), F.lit("").alias("out"))
    return F.aggregate(tokens, start, step, lambda acc: acc["out"])


def shown(text: Column) -> Column:
    return F.translate(text, HIDDEN, MARKS)


def parameter_types(parameters: Column) -> Column:
    """The types of a parameter list: without attributes, defaults, ways of passing and names."""

    def one(p: Column) -> Column:
        own = F.regexp_replace(F.regexp_replace(F.trim(p), "^(\\[[^\\]]*\\] *)+", ""), " *=.*$", "")
        return shown(F.regexp_replace(F.regexp_replace(own, f"^(({'|'.join(PASSING)}) +)+", ""), " +[^ ]+$", ""))

    return F.array_join(F.transform(F.split(masked(parameters), ","), one), ", ")


def structure(symbols: DataFrame) -> Column:
    """A symbol's fingerprint without its name: kind, container, namespace, static or not, and of members
    the type, arity and parameter types, of types the arity. All come from the signature's text, read
    by depth of brackets: parameters are the last brackets at depth 0, after a name; the name, with
    its type parameters, is the last word before them; a parameter's name is the last of its words.
    Constraints, bodies and initial values are left out."""
    has = lambda c: F.col(c) if c in symbols.columns else F.lit("")
    text = masked(F.regexp_replace(F.coalesce("signature", F.lit("")), "\\boperator *(<<|>>|<=|>=|<|>)", "operator op"))
    text = F.rtrim(F.regexp_replace(F.regexp_replace(text, " where .*$", ""), " *(=|\\{).*$", ""))
    listed = "^(.*[^ ]) *[(\\[]([^()\\[\\]]*)[)\\]]$"
    member = ~F.col("kind").isin(TYPE_KINDS)

    def digest(said: Column, head: Column) -> Column:
        bare = F.regexp_replace(head, f"\\b({'|'.join(MODIFIERS)}) +", "")
        type_ = shown(F.regexp_replace(bare, " *[^ ]+ *$", ""))
        parameters = parameter_types(shown(F.regexp_extract(said, listed, 2)))
        mode = F.when(head.rlike("\\bstatic\\b"), "static").otherwise("instance")
        return X.fingerprint(F.col("kind"), F.col("containing_type"), has("namespace"), mode, F.when(member, type_), F.regexp_extract("fqname", "`+([0-9]+)", 1), F.when(member, parameters))

    headed = lambda said: F.when(said.rlike(listed), F.regexp_extract(said, listed, 1)).otherwise(said)
    return X.once(text, lambda said: X.once(headed(said), lambda head: digest(said, head)))


def versioned_id(kind: Column, name: Column, container: Column, namespace: Column, project: Column, static: Column, type_: Column, arity: Column, parameters: Column) -> Column:
    """The name-dependent id of the second version: parts joined by zero bytes. kind is NamedType, Method,
    Property, Field or Event; parameters an array of types. Types have no type of their own, only types
    and methods an arity, only methods and properties parameters."""
    mode = F.when(static, "static").otherwise("instance")
    start = [kind, name, F.coalesce(container, F.lit("")), F.coalesce(namespace, F.lit("")), F.coalesce(project, F.lit("")), mode]
    none = F.array().cast("array<string>")
    parts = F.concat(
        F.array(*start),
        F.when(kind != "NamedType", F.array(type_)).otherwise(none),
        F.when(kind.isin("NamedType", "Method"), F.array(arity.cast("string"))).otherwise(none),
        F.when(kind.isin("Method", "Property"), F.coalesce(parameters, none)).otherwise(none),
    )
    return F.concat(F.lit("sym_"), F.substring(F.sha2(F.array_join(parts, "\0"), 256), 1, 16))


def with_ordinals(symbols: DataFrame) -> DataFrame:
    """Adds fingerprint, ordinal (0 for the first of equal ones in a container, by source position) and
    shared (whether there are others)."""
    own = symbols.withColumn("fingerprint", structure(symbols))
    w = Window.partitionBy("containing_type", "fingerprint")
    return own.withColumn("ordinal", F.row_number().over(w.orderBy("file_id", "span_start", "symbol_id")) - 1).withColumn("shared", F.count("*").over(w) > 1)


def with_structural_ids(symbols: DataFrame) -> DataFrame:
    """stable_id from fingerprint and ordinal, where a symbol brings none."""
    own = with_ordinals(symbols)
    made = F.concat(F.lit("sym_"), X.fingerprint(F.col("fingerprint"), F.col("ordinal").cast("string")))
    return own.withColumn("stable_id", F.coalesce("stable_id", made)).select(symbols.columns)


#: Comments and white space before the first code.
LEADING = r"(?s)^\ufeff?(?:\s+|//[^\n]*|/\*.*?\*/|'[^\n]*|<!--.*?-->)*+"


def is_generated(path: Column, content: Column | None = None) -> Column:
    """Whether a file is a tool's output, which extraction skips: by its path, or a mark in the comments
    before its first code, however long they are."""
    p = F.lower(path)
    out = p.endswith(".g.cs") | p.endswith(".g.vb") | p.endswith(".designer.cs") | p.endswith(".designer.vb") | p.rlike("(^|[/\\\\])obj[/\\\\]")
    return out if content is None else out | F.coalesce(F.regexp_extract(content, LEADING, 0).contains("<auto-generated"), F.lit(False))


def is_test(path: Column) -> Column:
    """Whether a file belongs to a project of tests or benchmarks, which stays out of exports."""
    return F.coalesce(path, F.lit("")).rlike("\\.(Tests|Benchmarks|TestUtilities)[/\\\\]")


def is_made(fqname: Column) -> Column:
    """Whether the compiler made a type, for a program without one."""
    return F.coalesce(fqname.endswith("AutoGeneratedProgram") | fqname.endswith("<Program>$"), F.lit(False))


def classify_changes(before: DataFrame, after: DataFrame, bases_before: DataFrame, bases_after: DataFrame) -> DataFrame:
    """file_id, mode of each file of either reading: NoOp if its symbols are the same, Document if only
    bodies moved, Project if signatures or members changed, Dependency if a type's bases changed."""

    def digest(s: DataFrame, b: DataFrame, side: str) -> DataFrame:
        api = F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "symbol_id", "signature", "visibility"))), "\n"), 256)
        spans = F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "symbol_id", F.col("span_start").cast("string"), F.col("span_end").cast("string")))), "\n"), 256)
        out = s.groupBy("file_id").agg(api.alias(f"{side}_api"), spans.alias(f"{side}_spans"))
        up = b.join(s.select(F.col("symbol_id").alias("type_symbol_id"), "file_id"), "type_symbol_id").groupBy("file_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(">", "type_symbol_id", "related_symbol_id"))), "\n"), 256).alias(f"{side}_up"))
        return out.join(up, "file_id", "left")

    both = digest(before, bases_before, "a").join(digest(after, bases_after, "b"), "file_id", "full_outer")
    mode = F.when(~F.col("a_up").eqNullSafe(F.col("b_up")), "Dependency").when(~F.col("a_api").eqNullSafe(F.col("b_api")), "Project").when(~F.col("a_spans").eqNullSafe(F.col("b_spans")), "Document").otherwise("NoOp")
    return both.select("file_id", mode.alias("mode"))


def shown_name(doc_id: Column, language: Column) -> Column:
    """A documentation id as a name for people: without kind and root namespace marks, generic arity
    in the language's form."""
    bare = F.regexp_replace(F.regexp_replace(doc_id, "^.:(?=.)", ""), "^(Global\\.|global::)", "")
    open_, close = F.when(language == "vb", "(Of ").otherwise("<"), F.when(language == "vb", ")").otherwise(">")
    return F.when(bare.rlike("`+[0-9]+$"), F.concat(F.regexp_replace(bare, "`+[0-9]+$", ""), open_, F.lit("T"), close)).otherwise(bare)


def display_fqname(doc_id: Column, path: Column) -> Column:
    """A documentation id as a full name: without the mark of its kind, under the language's name of the root
    namespace. Null and empty ids stay."""
    body = F.when((F.length(doc_id) > 2) & (F.substring(doc_id, 2, 1) == ":"), F.substring(doc_id, 3, 1 << 30)).otherwise(doc_id)
    root = F.when(F.lower(F.coalesce(path, F.lit(""))).endswith(".vb"), "Global.").otherwise("global::")
    return F.when(doc_id == "", doc_id).otherwise(F.concat(root, body))


def projected(symbols: DataFrame, files: DataFrame, names: Column | None = None) -> DataFrame:
    """Symbols as cards show them: symbol_id, display_fqname, path (unknown without a file), confidence (Low
    without a file, as such symbols come from projects that did not compile; else High), and a signature of
    visibility, kind and display name (`names`, or the end of the full name)."""
    own = symbols.join(files.select("file_id", "path"), "file_id", "left")
    shown_ = X.display_name(F.col("fqname")) if names is None else names
    there = F.coalesce("path", F.lit("")) != ""
    said = F.concat_ws(" ", F.lower(F.coalesce("visibility", F.lit("public"))), F.lower("kind"), shown_)
    return own.select("symbol_id", display_fqname(F.col("symbol_id"), F.col("path")).alias("display_fqname"), F.when(there, F.col("path")).otherwise("unknown").alias("path"), F.when(there, "High").otherwise("Low").alias("confidence"), said.alias("signature"))
