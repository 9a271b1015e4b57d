"""Documentation ids, read by their grammar, as declarations in the form of a language.

An id is a kind, a path of names with arities, parameter types, and the result type of conversions:
M:N.Box`1.Put``1(`0,System.Collections.Generic.List{``0}@,System.Int32[0:,0:][])~System.String.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgrid.functions.text import once as _let
from symgrid.session import dealt, durable

# Types that have a word of their own, in C# and in Visual Basic.
KEYWORDS = {
    "System.Boolean": ("bool", "Boolean"),
    "System.Byte": ("byte", "Byte"),
    "System.SByte": ("sbyte", "SByte"),
    "System.Char": ("char", "Char"),
    "System.Int16": ("short", "Short"),
    "System.UInt16": ("ushort", "UShort"),
    "System.Int32": ("int", "Integer"),
    "System.UInt32": ("uint", "UInteger"),
    "System.Int64": ("long", "Long"),
    "System.UInt64": ("ulong", "ULong"),
    "System.Single": ("float", "Single"),
    "System.Double": ("double", "Double"),
    "System.Decimal": ("decimal", "Decimal"),
    "System.String": ("string", "String"),
    "System.Object": ("object", "Object"),
    "System.DateTime": ("System.DateTime", "Date"),
    "System.Void": ("void", "System.Void"),
}

#: Kind, path, parameters, result.
GRAMMAR = r"^(?:([A-Z!]):(?=.))?([^(~]*)(?:\((.*)\))?(?:~(.*))?$"


def _parted(text: Column) -> Column:
    """The parameters of a list: commas inside of braces and brackets part nothing."""

    def step(acc: Column, t: Column) -> Column:
        depth = acc["depth"] + t.isin("{", "[").cast("int") - t.isin("}", "]").cast("int")
        return F.struct(depth.alias("depth"), F.concat(acc["out"], F.when((t == ",") & (depth == 0), "\n").otherwise(t)).alias("out"))

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))
    tokens = F.regexp_extract_all(text, F.lit("[^{}\\[\\],]+|[{}\\[\\],]"), F.lit(0))
    return F.split(F.aggregate(tokens, start, step, lambda acc: acc["out"]), "\n")


def _number(text: Column, pattern: str) -> Column:
    """The number that a pattern finds, else 0. A failing try_cast costs an exception, so none is tried."""
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found == "", 0).otherwise(found.cast("int"))


OWN, OF_METHOD = "[^`]`([0-9]{1,4})$", "``([0-9]{1,4})$"


def _name(letter: str, several: Column, i: Column) -> Column:
    return F.when(several, F.concat(F.lit(letter), i.cast("string"))).otherwise(letter)


def _ranks(t: Column) -> Column:
    return F.when(t.rlike("^\\[,*\\]"), F.array_join(F.reverse(F.regexp_extract_all(t, F.lit("\\[,*\\]"), F.lit(0))), "")).otherwise(t)


def _typed(t: Column, to: Column) -> Column:
    """A type in the form that `to` describes."""

    def word(t: Column) -> Column:
        i = _number(t, "^`+([0-9]{1,4})$") + 1
        own = F.when(t.startswith("``"), _name("U", to["many_of_method"], i)).otherwise(_name("T", to["many"], i))
        return F.when(t.rlike("^``?[0-9]{1,4}$"), own).otherwise(F.coalesce(F.try_element_at(to["words"], t), t))

    bare = F.regexp_replace(t, "(?<=[\\[,])[0-9]*:[0-9]*(?=[,\\]])", "")
    turned = F.array_join(F.transform(F.regexp_extract_all(bare, F.lit("(?:\\[,*\\])+|[^\\[]+|\\["), F.lit(0)), _ranks), "")
    told = F.array_join(F.transform(F.regexp_extract_all(turned, F.lit("`+[0-9]+|[^`{},\\[\\]@*]+|[`{},\\[\\]@*]"), F.lit(0)), word), "")
    spaced = F.regexp_replace(told, ",(?![,\\]])", ", ")
    in_vb = lambda s: F.replace(F.replace(F.regexp_replace(s, "\\[(,*)\\]", "($1)"), F.lit("{"), F.lit("(Of ")), F.lit("}"), F.lit(")"))
    return _let(spaced, lambda s: F.when(to["vb"], in_vb(s)).otherwise(F.translate(s, "{}", "<>")))


def _path(parts: Column, to: Column) -> Column:
    """The names of a path with their type parameters; types count theirs through all nested ones."""

    def listed(letter: str, several: Column, n: Column, before: Column) -> Column:
        made = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: _name(letter, several, before + i)), ", ")
        return F.concat(F.when(to["vb"], "(Of ").otherwise("<"), made, F.when(to["vb"], ")").otherwise(">"))

    def step(acc: Column, p: Column) -> Column:
        n, bare = _number(p, OWN), F.regexp_replace(p, "`+[0-9]+$", "")
        new = F.when(to["vb"], "New").otherwise(acc["last"])
        said = F.when(bare.isin("#ctor", "#cctor"), new).when(bare.contains("#"), _typed(F.translate(bare, "#@", ".,"), to)).otherwise(bare)
        generic = F.when(p.rlike(OWN), listed("T", to["many"], n, acc["seen"])).when(p.rlike(OF_METHOD), listed("U", to["many_of_method"], _number(p, OF_METHOD), F.lit(0))).otherwise("")
        out = F.concat(acc["out"], F.when(acc["out"] == "", "").otherwise("."), said, generic)
        return F.struct((acc["seen"] + n).alias("seen"), bare.alias("last"), out.alias("out"))

    start = F.struct(F.lit(0).alias("seen"), F.lit("").alias("last"), F.lit("").alias("out"))
    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def _given(listed: Column, to: Column) -> Column:
    passed = lambda t: F.when(t.endswith("@"), F.when(to["vb"], "ByRef ").otherwise("ref ")).otherwise("")
    return F.array_join(F.transform(_parted(listed), lambda t: F.concat(passed(t), _typed(F.regexp_replace(t, "@$", ""), to))), ", ")


def readable(doc_id: Column, language: Column, root: bool = False) -> Column:
    """A documentation id as a declaration, without its kind: type parameters, which an id only counts, as T
    (of types, through all nested ones) and U (of methods), with numbers from 1 where there are several;
    generic arguments, arrays, references and the words for common types as the language ("vb", else C#)
    writes them; constructors by their type's name or New, indexers as this[...] in C#; conversions with
    their result. root adds the language's name of the root namespace. Arrays of arrays are named from
    the outermost, as both languages do and ids do not. Null and empty ids stay, ids of errors lose
    their mark, and text outside of the grammar stays as it is."""
    vb = F.coalesce(language == "vb", F.lit(False))
    words = [F.create_map(*[F.lit(x) for k, w in KEYWORDS.items() for x in (k, w[i])]) for i in (0, 1)]
    count = lambda parts, pattern: F.aggregate(parts, F.lit(0), lambda n, p: n + _number(p, pattern))
    read = F.struct(*[F.regexp_extract(doc_id, GRAMMAR, i).alias(n) for i, n in enumerate(("kind", "path", "listed", "result"), 1)])

    def form(parts: Column) -> Column:
        return F.struct(parts.alias("parts"), vb.alias("vb"), F.when(vb, words[1]).otherwise(words[0]).alias("words"), (count(parts, OWN) != 1).alias("many"), (count(parts, OF_METHOD) != 1).alias("many_of_method"))

    def said(id_: Column, to: Column, full: Column) -> Column:
        call = (id_["kind"] == "M") | (id_["listed"] != "")
        this = (id_["kind"] == "P") & call & ~to["vb"]
        given = F.when(id_["listed"] == "", "").otherwise(_given(id_["listed"], to))
        name = F.when(this, F.regexp_replace(full, "(^|\\.)Item$", "$1this")).otherwise(full)
        brackets = F.concat(F.when(this, "[").otherwise("("), given, F.when(this, "]").otherwise(")"))
        result = F.when(id_["result"] == "", "").otherwise(F.concat(F.when(to["vb"], " As ").otherwise(" : "), _typed(id_["result"], to)))
        return F.concat(name, F.when(call, brackets).otherwise(""), result)

    told = _let(read, lambda id_: _let(form(F.split(id_["path"], "\\.")), lambda to: _let(_path(to["parts"], to), lambda full: said(id_, to, full))))
    head = F.when(vb, "Global.").otherwise("global::") if root else F.lit("")
    return F.when(doc_id == "", "").when(doc_id.startswith("!:"), F.substring(doc_id, 3, 1 << 30)).when(~doc_id.rlike(GRAMMAR), doc_id).otherwise(F.concat(head, told))


def declared(rows: DataFrame, root: bool = False) -> DataFrame:
    """rows (doc_id, language, and more) with their declaration. Reading an id costs far more than moving it, and
    many rows have few ids: each is read once, dealt out by the number of them, and goes to its rows."""
    ids = dealt(durable(rows.select("doc_id", "language").distinct()))
    told = ids.select("doc_id", "language", readable(F.col("doc_id"), F.col("language"), root).alias("declaration"))
    return rows.join(told.hint("shuffle_hash"), ["doc_id", "language"], "left")
