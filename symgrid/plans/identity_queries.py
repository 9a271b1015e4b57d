"""Identities, change classes, exclusions and repository state."""

from __future__ import annotations

from pyspark.sql import functions as F

from symgrid.functions import docids
from symgrid.functions import facts as V
from symgrid.operators import answers as A
from symgrid.operators import identity as I
from symgrid.operators import history, trees
from symgrid.operators import lifecycle as L
from symgrid.plans.bridge import frame
from symgrid.plans.queries import register
from symgrid.session import dealt

_TYPE = r"regexp_replace(regexp_replace(split_part(signature, '(', 1), '\b(public|private|protected|internal|static|virtual|override|abstract|sealed|async|readonly|partial|extern|new|unsafe) +', '', 'g'), ' *[^ ]+ *$', '')"
_PARAMS = r"regexp_replace(regexp_extract(signature, '\((.*)\)', 1), ' +\w+( *= *[^,]*)?(,|$)', '\2', 'g')"
_IS_TYPE = "kind IN ('Class', 'Struct', 'Interface', 'Enum', 'Delegate', 'Record')"
_FP = f"substr(sha256(kind || '|' || coalesce(containing_type, '') || '|' || coalesce(namespace, '') || '|' || CASE WHEN regexp_matches(split_part(signature, '(', 1), '\\bstatic\\b') THEN 'static' ELSE 'instance' END || '|' || CASE WHEN {_IS_TYPE} THEN '' ELSE {_TYPE} END || '|' || regexp_extract(fqname, '`+([0-9]+)', 1) || '|' || CASE WHEN {_IS_TYPE} THEN '' ELSE {_PARAMS} END), 1, 16)"


@register("a12_ordinals", f"""SELECT symbol_id, {_FP} AS fingerprint, CAST(row_number() OVER (PARTITION BY containing_type, {_FP} ORDER BY file_id, span_start, symbol_id) - 1 AS INTEGER) AS ordinal,
  count(*) OVER (PARTITION BY containing_type, {_FP}) > 1 AS shared FROM symbols""")
def a12_ordinals(spark, d):
    return I.with_ordinals(frame(spark, d, "symbols")).select("symbol_id", "fingerprint", "ordinal", "shared")


@register("x10_structural_ids", f"""WITH o AS (SELECT *, {_FP} AS fp, row_number() OVER (PARTITION BY containing_type, {_FP} ORDER BY file_id, span_start, symbol_id) - 1 AS n FROM symbols)
  SELECT symbol_id, coalesce(stable_id, 'sym_' || substr(sha256(fp || '|' || CAST(n AS VARCHAR)), 1, 16)) AS stable_id FROM o""")
def x10_structural_ids(spark, d):
    return I.with_structural_ids(frame(spark, d, "symbols")).select("symbol_id", "stable_id")


@register("x10_rename", "SELECT symbol_id, true AS same FROM symbols WHERE kind = 'Method'")
def x10_rename(spark, d):
    """Every method gets another name, in its full name and its signature; its structural id stays."""
    own = frame(spark, d, "symbols").filter("kind = 'Method'").withColumn("stable_id", F.lit(None).cast("string"))
    renamed = own.withColumns({"fqname": F.regexp_replace("fqname", "[^.]*\\(", "Other("), "signature": F.regexp_replace("signature", "[^ ]*\\(", "Other(")})
    before, after = (I.with_structural_ids(s).select("symbol_id", F.col("stable_id").alias(n)) for s, n in ((own, "a"), (renamed, "b")))
    return before.join(after, "symbol_id").select("symbol_id", (F.col("a") == F.col("b")).alias("same"))


@register("x11_versioned_ids", """SELECT symbol_id, 'sym_' || substr(sha256(concat_ws(chr(0), 'Method', symbol_id, coalesce(containing_type, ''), coalesce(namespace, ''), coalesce(project_name, ''), 'instance', 'void', '0', 'Order')), 1, 16) AS id FROM symbols""")
def x11_versioned_ids(spark, d):
    one = lambda v: F.lit(v)
    return frame(spark, d, "symbols").select("symbol_id", I.versioned_id(one("Method"), F.col("symbol_id"), F.col("containing_type"), F.col("namespace"), F.col("project_name"), one(False), one("void"), one(0), F.array(one("Order"))).alias("id"))


@register("f9_exclusions", """WITH p AS (SELECT page_id, html, url, CASE page_id % 6 WHEN 0 THEN 'src/Api.Tests/' WHEN 1 THEN 'src/Api.Benchmarks/' WHEN 2 THEN 'x/Y.TestUtilities/' WHEN 3 THEN 'src/test/' WHEN 4 THEN 'src/api.tests/' ELSE 'src/' END AS folder, page_id % 4 AS k FROM pages)
  SELECT page_id, page_id % 6 < 3 AS test, k = 1 AS generated, page_id % 5 = 0 AS made FROM p""")
def f9_exclusions(spark, d):
    n = F.col("page_id")
    folder = F.get(F.lit(["src/Api.Tests/", "src/Api.Benchmarks/", "x/Y.TestUtilities/", "src/test/", "src/api.tests/", "src/"]), (n % 6).cast("int"))
    # A mark in the leading comment, in the code, and none.
    content = F.when(n % 4 == 1, F.concat(F.lit("/* "), F.replace("html", F.lit("*/"), F.lit("")), F.lit(" */ // <auto-generated/>"))).when(n % 4 == 2, F.lit("class A { string s = \"<auto-generated\"; }")).otherwise(F.lit("class A {}"))
    name = F.when(n % 5 == 0, "N.AutoGeneratedProgram").otherwise("N.Program__1<T>")
    return frame(spark, d, "pages").select("page_id", I.is_test(F.concat(folder, F.lit("a.cs"))).alias("test"), I.is_generated(F.concat(folder, F.lit("a.cs")), content).alias("generated"), I.is_made(name).alias("made"))


_AFTER = "SELECT symbol_id, file_id, CASE WHEN span_start = 3 THEN signature || '!' ELSE signature END AS signature, visibility, span_start, CASE WHEN span_end = 9 THEN 10 ELSE span_end END AS span_end FROM symbols WHERE symbol_id <> 'P:Parts.P77'"


@register("d1_change_classes", f"""WITH b AS ({_AFTER}),
  x AS (SELECT file_id, string_agg(symbol_id || '|' || signature || '|' || visibility, chr(10) ORDER BY symbol_id) AS api, string_agg(symbol_id || span_start || span_end, chr(10) ORDER BY symbol_id) AS sp FROM symbols GROUP BY file_id),
  y AS (SELECT file_id, string_agg(symbol_id || '|' || signature || '|' || visibility, chr(10) ORDER BY symbol_id) AS api, string_agg(symbol_id || span_start || span_end, chr(10) ORDER BY symbol_id) AS sp FROM b GROUP BY file_id),
  moved AS (SELECT DISTINCT file_id FROM symbols JOIN type_relations ON symbol_id = type_symbol_id WHERE related_symbol_id = 'T:Shop.Nations.NATION_3')
  SELECT file_id, CASE WHEN moved.file_id IS NOT NULL THEN 'Dependency' WHEN x.api IS DISTINCT FROM y.api THEN 'Project' WHEN x.sp IS DISTINCT FROM y.sp THEN 'Document' ELSE 'NoOp' END AS mode
  FROM x FULL JOIN y USING (file_id) LEFT JOIN moved USING (file_id)""")
def d1_change_classes(spark, d):
    before, bases = frame(spark, d, "symbols"), frame(spark, d, "type_relations")
    after = before.filter("symbol_id <> 'P:Parts.P77'").withColumn("signature", F.when(F.col("span_start") == 3, F.concat("signature", F.lit("!"))).otherwise(F.col("signature"))).withColumn("span_end", F.when(F.col("span_end") == 9, 10).otherwise(F.col("span_end")))
    moved = bases.withColumn("related_symbol_id", F.when(F.col("related_symbol_id") == "T:Shop.Nations.NATION_3", "T:Elsewhere").otherwise(F.col("related_symbol_id")))
    return I.classify_changes(before, after, bases, moved)


@register("q29_status", """WITH h AS (SELECT DISTINCT 'r' || CAST(c_nationkey AS VARCHAR) AS repo_id, 'c' || CAST(c_nationkey % 7 AS VARCHAR) AS head FROM customer),
  m AS (SELECT DISTINCT 'r' || CAST(c_nationkey AS VARCHAR) AS repo_id, 'c' || CAST(c_custkey % 4 AS VARCHAR) AS commit_sha FROM customer WHERE c_nationkey <> 5),
  w AS (SELECT 'r' || CAST(c_nationkey AS VARCHAR) AS repo_id, 'c' || CAST(c_custkey % 3 AS VARCHAR) AS base FROM customer WHERE c_mktsegment = 'MACHINERY')
  SELECT repo_id, head, (SELECT count(*) > 0 FROM m WHERE m.repo_id = h.repo_id AND commit_sha = head) AS indexed, (SELECT count(DISTINCT commit_sha) FROM m WHERE m.repo_id = h.repo_id) AS n_snapshots,
         (SELECT count(*) FROM w WHERE w.repo_id = h.repo_id) AS n_workspaces, (SELECT count(*) FROM w WHERE w.repo_id = h.repo_id AND base <> head) AS n_stale FROM h""")
def q29_status(spark, d):
    c = frame(spark, d, "customer").withColumn("repo_id", F.concat(F.lit("r"), F.col("c_nationkey").cast("string")))
    made = lambda e: F.concat(F.lit("c"), F.expr(e).cast("string"))
    heads = c.select("repo_id", made("c_nationkey % 7").alias("head")).distinct()
    manifests = c.filter("c_nationkey <> 5").select("repo_id", made("c_custkey % 4").alias("commit_sha")).distinct()
    registry = c.filter("c_mktsegment = 'MACHINERY'").select("repo_id", made("c_custkey % 3").alias("base_commit"))
    return L.status(heads, manifests, registry)


@register("m23_seed_candidates", "SELECT CAST(c_nationkey AS INTEGER) AS target, 'g' || CAST(c_custkey AS VARCHAR) AS candidate FROM customer WHERE c_mktsegment = 'BUILDING' QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, 'g' || CAST(c_custkey AS VARCHAR)) <= 3")
def m23_seed_candidates(spark, d):
    g = frame(spark, d, "customer").select(F.col("c_nationkey").alias("target"), F.concat(F.lit("g"), F.col("c_custkey").cast("string")).alias("candidate"), F.col("c_mktsegment").alias("compatibility"), F.col("c_acctbal").alias("published_at"))
    return L.seed_candidates(g, "BUILDING", 3).select("target", "candidate")


@register("v1_fact_values", """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'GET /api/' || CAST(page_id AS VARCHAR) WHEN 1 THEN 'K:' || CAST(page_id AS VARCHAR) || '|unknown' WHEN 2 THEN 'dbo.T' || CAST(page_id AS VARCHAR) || '|raw' WHEN 3 THEN 'I → C|Scoped' ELSE 'Auth|pos:' || CAST(page_id AS VARCHAR) || '|terminal' END AS value FROM pages""")
def v1_fact_values(spark, d):
    n, p = F.col("page_id"), F.col("page_id").cast("string")
    value = (
        F.when(n % 5 == 0, V.route(F.lit("get"), F.lit("api/"), p, F.lit("XController")))
        .when(n % 5 == 1, V.config(F.concat(F.lit("K:"), p), F.lit(None).cast("string")))
        .when(n % 5 == 2, V.db_table(F.lit("dbo"), F.concat(F.lit("T"), p), F.lit("raw")))
        .when(n % 5 == 3, V.registration(F.lit("I"), F.lit("C"), F.lit("Scoped")))
        .otherwise(V.middleware(F.lit("Auth"), n, F.lit(True)))
    )
    return frame(spark, d, "pages").select("page_id", value.alias("value"))


_S = "CASE WHEN n = 1 THEN '' ELSE 's' END"


@register("x27_answers", f"""WITH r AS (SELECT to_symbol_id AS id, count(*) AS n FROM refs GROUP BY 1), f AS (SELECT fact_kind, count(*) AS n FROM facts GROUP BY 1), t AS (SELECT related_symbol_id AS id, count(*) AS n FROM type_relations GROUP BY 1)
  SELECT 'refs' AS form, id AS key, 'Found ' || n || ' reference' || {_S} || ' to ''' || id || '''' || CASE WHEN n > 600 THEN ' (showing first ' || n || ')' ELSE '' END || '.' AS answer FROM r
  UNION ALL SELECT 'kind', id, 'No references found for ''' || id || ''' (kind: Override).' FROM r
  UNION ALL SELECT 'graph', id, 'Found ' || n || ' callers of ''' || id || ''' (depth: 2)' || CASE WHEN n > 600 THEN ' (truncated)' ELSE '' END || '.' FROM r
  UNION ALL SELECT 'search', id, 'Found ' || n || ' symbols matching ''' || id || '''. Use symbols.get_card for details.' FROM r
  UNION ALL SELECT 'card', symbol_id, kind || ' ' || fqname || ' — ' || signature FROM symbols
  UNION ALL SELECT 'definition', symbol_id, 'Definition of ' || kind || ' ' || fqname || ' — lines ' || span_start || '–' || span_end FROM symbols
  UNION ALL SELECT 'hierarchy', id, 'Type ''' || id || ''' — ' || n || ' derived type' || {_S} || '.' FROM t
  UNION ALL SELECT 'endpoints', fact_kind, 'Found ' || n || ' HTTP endpoint' || {_S} || ' (path: ''/u'', method: GET) (truncated).' FROM f
  UNION ALL SELECT 'keys', fact_kind, 'Found ' || n || ' configuration key' || {_S} || ' (key prefix: ''A:'').' FROM f
  UNION ALL SELECT 'tables', fact_kind, 'Found ' || n || ' database table' || {_S} || '.' FROM f
  UNION ALL SELECT 'trace', fact_kind, 'Traced feature from ''' || fact_kind || ''' across ' || n || ' node' || {_S} || ' at depth 3.' FROM f
  UNION ALL SELECT 'summary', fact_kind, 'Summary of ''' || fact_kind || ''': 1 section, ' || n || ' fact' || {_S} || ' indexed.' FROM f
  UNION ALL SELECT 'context', id, 'Context for ''' || id || ''': card + code + ' || least(n, 10) || ' callee' || CASE WHEN least(n, 10) = 1 THEN '' ELSE 's' END || CASE WHEN n > 10 THEN ' (' || n || ' total found, showing 10)' ELSE '' END || '.' FROM r
  UNION ALL SELECT 'text', id, CASE WHEN n > 600 THEN 'Found ' || n || '+ matches for `x` across 7 files (results capped — increase limit to see more).' ELSE 'Found ' || n || ' match' || CASE WHEN n = 1 THEN '' ELSE 'es' END || ' for `x` across 7 files.' END FROM r""")
def x27_answers(spark, d):
    """Every form of sentence, on the references, symbols, facts and relations of the tables."""
    r = frame(spark, d, "refs").groupBy(F.col("to_symbol_id").alias("key")).agg(F.count("*").alias("n"))
    f = frame(spark, d, "facts").groupBy(F.col("fact_kind").alias("key")).agg(F.count("*").alias("n"))
    t = frame(spark, d, "type_relations").groupBy(F.col("related_symbol_id").alias("key")).agg(F.count("*").alias("n"))
    s = frame(spark, d, "symbols").withColumnRenamed("symbol_id", "key")
    key, n, no, many = F.col("key"), F.col("n"), F.lit(False), F.col("n") > 600
    parts = [
        (r, "refs", A.references(key, n, None, many)),
        (r, "kind", A.references(key, F.lit(0), F.lit("Override"), no)),
        (r, "graph", A.call_graph(key, F.lit("callers"), n, F.lit(2), many)),
        (r, "search", A.search(n, key, no)),
        (s, "card", A.card(F.col("kind"), F.col("fqname"), F.col("signature"))),
        (s, "definition", A.definition(F.col("kind"), F.col("fqname"), F.col("span_start"), F.col("span_end"))),
        (t, "hierarchy", A.hierarchy(key, F.lit(None).cast("string"), F.lit(0), n)),
        (f, "endpoints", A.surface("HTTP endpoint", n, F.lit(True), path=F.lit("/u"), method=F.lit("GET"))),
        (f, "keys", A.surface("configuration key", n, no, key_prefix=F.lit("A:"))),
        (f, "tables", A.surface("database table", n, no, table_prefix=F.lit(None).cast("string"))),
        (f, "trace", A.trace(key, n, F.lit(3), no)),
        (f, "summary", A.summary(key, F.lit(1), n)),
        (r, "context", A.context(key, F.least(n, F.lit(10)), n)),
        (r, "text", A.text(F.lit("x"), n, F.lit(7), many)),
    ]
    out = None
    for df, form, sentence in parts:
        part = df.select(F.lit(form).alias("form"), "key", sentence.alias("answer"))
        out = part if out is None else out.unionByName(part)
    return out


@register("x10_nested", """SELECT 'P:Parts.P' || CAST(p_partkey AS VARCHAR) || '/' || CAST(form AS VARCHAR) AS id, true AS same, form <> 4 AS typed FROM part, (VALUES (0), (1), (2), (3), (4)) v(form)""")
def x10_nested(spark, d):
    """Members with tuples, nested generics, indexers, defaults, constraints and bodies: their ids stay under
    other names of member and parameters, and change with a type of the parameters or the member."""
    forms = [
        "public (int, string{n}) {m}(int {p})",
        "Dictionary<string, List<T{n}>> {m}<T, U>(Dictionary<int, (int a, string b)> {p} = null, params T{n}[] more) where T : new()",
        "public int this[T{n} {p}, (int, int) q]",
        'static T{n} {m}([In, Out] ref T{n} {p}, string s = "a, b") => Run(1, 2)',
        "public int {m} = 5",
    ]
    # The keys are few bytes and much work: they are dealt out, as all may lie in one file's group.
    keys = dealt(frame(spark, d, "part").select("p_partkey"))
    part = keys.select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("form"))
    number = F.col("p_partkey").cast("string")
    own = part.select("p_partkey", "form", F.concat(F.lit("P:Parts.P"), number, F.lit("/"), F.col("form").cast("string")).alias("id"), F.lit("Method").alias("kind"), F.concat(F.lit("T:C"), number).alias("containing_type"), F.lit("N").alias("namespace"), F.lit("M:N.C.M").alias("fqname"))
    # A row bears its three readings: nothing is joined, so nothing of a part's size goes to the driver.
    for name, member, parameter, n in (("a", "Go", "x", number), ("b", "Other", "yy", number), ("c", "Go", "x", F.concat(number, F.lit("0")))):
        text = F.get(F.lit(forms), F.col("form"))
        for mark, value in (("{m}", F.lit(member)), ("{p}", F.lit(parameter)), ("{n}", n)):
            text = F.replace(text, F.lit(mark), value)
        own = own.withColumn("signature", text)
        own = own.withColumn(name, I.structure(own))
    return own.select("id", (F.col("a") == F.col("b")).alias("same"), (F.col("a") != F.col("c")).alias("typed"))


@register("f14_projection", """WITH f AS (SELECT file_id, CASE WHEN CAST(substr(file_id, 2) AS BIGINT) % 3 = 0 THEN replace(path, '.txt', '.VB') ELSE path END AS path FROM files WHERE CAST(substr(file_id, 2) AS BIGINT) % 7 <> 3)
  SELECT symbol_id, CASE WHEN ends_with(lower(coalesce(path, '')), '.vb') THEN 'Global.' ELSE 'global::' END || substr(symbol_id, 3) AS display_fqname, coalesce(path, 'unknown') AS path, CASE WHEN path IS NULL THEN 'Low' ELSE 'High' END AS confidence,
         lower(visibility) || ' ' || lower(kind) || ' ' || signature AS signature FROM symbols LEFT JOIN f USING (file_id)""")
def f14_projection(spark, d):
    """All symbols as cards; every third file is of another language, every seventh is unknown."""
    n = F.substring("file_id", 2, 20).cast("long")
    files = frame(spark, d, "files").filter(n % 7 != 3).withColumn("path", F.when(n % 3 == 0, F.replace("path", F.lit(".txt"), F.lit(".VB"))).otherwise(F.col("path")))
    return I.projected(frame(spark, d, "symbols"), files, F.col("signature"))


_GIVEN = {
    "G.Dictionary{System.String,G.List{System.Int32}}@": ("ref G.Dictionary<string, G.List<int>>", "ByRef G.Dictionary(Of String, G.List(Of Integer))"),
    "System.Int64[0:,0:][]": ("long[][,]", "Long()(,)"),
    "`0": ("T1", "T1"),
    "G.List{`1[]}": ("G.List<T2[]>", "G.List(Of T2())"),
    "N.Part*": ("N.Part*", "N.Part*"),
}


def _by_part(i: int) -> str:
    return "CASE " + " ".join(f"WHEN l_partkey % 5 = {n} THEN '{x}'" for n, x in enumerate(v[i] for v in _GIVEN.values())) + " END"


@register("f14_declarations", f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_linestatus = 'O' AS vb, l_returnflag AS r, CAST(l_suppkey AS VARCHAR) AS s, CASE WHEN l_linestatus = 'O' THEN {_by_part(1)} ELSE {_by_part(0)} END AS p FROM lineitem)
  SELECT l_orderkey, l_linenumber, CASE WHEN vb THEN 'Global.Shop.Box(Of T1).Slot' || s || '(Of T2).' || CASE r WHEN 'A' THEN 'Pack(Of U)(' || p || ', U)' WHEN 'R' THEN 'New(' || p || ')' ELSE 'Item(' || p || ', Boolean)' END
         ELSE 'global::Shop.Box<T1>.Slot' || s || '<T2>.' || CASE r WHEN 'A' THEN 'Pack<U>(' || p || ', U)' WHEN 'R' THEN 'Slot' || s || '(' || p || ')' ELSE 'this[' || p || ', bool]' END END AS declaration FROM l""")
def f14_declarations(spark, d):
    """Every line as a documentation id: members of nested generic types with all forms of parameters, in
    two languages; each is shown as a declaration."""
    given = F.element_at(F.array(*[F.lit(k) for k in _GIVEN]), (F.col("l_partkey") % len(_GIVEN) + 1).cast("int"))
    kind = F.when(F.col("l_returnflag") == "N", "P").otherwise("M")
    member = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("Pack``1("), given, F.lit(",``0)")))
    member = member.when(F.col("l_returnflag") == "R", F.concat(F.lit("#ctor("), given, F.lit(")"))).otherwise(F.concat(F.lit("Item("), given, F.lit(",System.Boolean)")))
    doc_id = F.concat(kind, F.lit(":Shop.Box`1.Slot"), F.col("l_suppkey").cast("string"), F.lit("`1."), member)
    language = F.when(F.col("l_linestatus") == "O", "vb").otherwise("csharp")
    rows = frame(spark, d, "lineitem").select("l_orderkey", "l_linenumber", doc_id.alias("doc_id"), language.alias("language"))
    return docids.declared(rows, root=True).select("l_orderkey", "l_linenumber", "declaration")


_PARENTS = "p AS (SELECT c_custkey AS c, c_custkey - 1 AS up FROM customer UNION SELECT c_custkey, c_custkey // 2 FROM customer WHERE c_nationkey < 5 AND c_custkey > 1), heads AS (SELECT max(c_custkey) AS h FROM customer GROUP BY c_mktsegment)"


def _commits(spark, d):
    """A history of as many commits as there are customers; those of five nations are merges with an old one."""
    c = frame(spark, d, "customer")
    k = F.col("c_custkey")
    name = lambda n: F.concat(F.lit("c"), n.cast("string"))
    parents = c.select(name(k).alias("commit_sha"), name(k - 1).alias("parent"), F.lit(0).alias("position")).union(c.filter("c_nationkey < 5 and c_custkey > 1").select(name(k), name(F.floor(k / 2)), F.lit(1)))
    return parents, c.groupBy("c_mktsegment").agg(name(F.max(k)).alias("commit_sha")).select("commit_sha")


@register("s13_ancestors", f"""WITH RECURSIVE {_PARENTS}, r AS (SELECT h, h AS n FROM heads UNION SELECT h, up FROM r JOIN p ON c = n)
  SELECT 'c' || CAST(h AS VARCHAR) AS start, 'c' || CAST(n AS VARCHAR) AS node FROM r""")
def s13_ancestors(spark, d):
    """What the newest commit of each segment descends from."""
    return history.ancestors(*_commits(spark, d))


@register("s13_tree_changes", """WITH a AS (SELECT path, sha256(coalesce(content, '')) AS h FROM files), b AS (SELECT path, sha256(coalesce(content, '') || CASE WHEN CAST(substr(file_id, 2) AS BIGINT) % 50 = 7 THEN '!' ELSE '' END) AS h FROM files WHERE CAST(substr(file_id, 2) AS BIGINT) % 40 <> 3)
  SELECT path, CASE WHEN b.h IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a LEFT JOIN b USING (path) WHERE a.h IS DISTINCT FROM b.h
  UNION ALL SELECT path || '/new.txt', 'added' FROM files WHERE CAST(substr(file_id, 2) AS BIGINT) % 40 = 3""")
def s13_tree_changes(spark, d):
    """All files as a hash tree, and a tree in which some have other texts and some made way for a directory."""
    files, n = frame(spark, d, "files"), F.substring("file_id", 2, 20).cast("long")
    text = F.coalesce("content", F.lit(""))
    before = files.select("path", F.sha2(text, 256).alias("sha256"))
    after = files.filter(n % 40 != 3).select("path", F.sha2(F.concat(text, F.when(n % 50 == 7, "!").otherwise("")), 256).alias("sha256"))
    after = after.unionByName(files.filter(n % 40 == 3).select(F.concat("path", F.lit("/new.txt")).alias("path"), F.lit("x").alias("sha256")))
    return trees.changed(trees.tree(before), trees.tree(after))


@register("v2_fact_values", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'E' || CAST(page_id AS VARCHAR) || '|throw new' WHEN 1 THEN 'Took {Ms}' WHEN 2 THEN 'Retry(' || CAST(page_id AS VARCHAR) || ')|Polly' ELSE 'Nav: N.Manager' || CAST(page_id AS VARCHAR) END AS value FROM pages""")
def v2_fact_values(spark, d):
    """Exceptions, log templates (without a level), retry policies, injected properties."""
    n, p = F.col("page_id"), F.col("page_id").cast("string")
    value = (
        F.when(n % 4 == 0, V.piped(F.concat(F.lit("E"), p), F.lit("throw new")))
        .when(n % 4 == 1, V.piped(F.lit("Took {Ms}"), F.lit(None).cast("string")))
        .when(n % 4 == 2, V.piped(F.concat(F.lit("Retry("), p, F.lit(")")), F.lit("Polly")))
        .otherwise(V.razor(F.lit("Nav"), F.concat(F.lit("N.Manager"), p)))
    )
    return frame(spark, d, "pages").select("page_id", value.alias("value"))


@register("q29_rolling", """WITH h AS (SELECT DISTINCT 'r' || CAST(c_nationkey AS VARCHAR) AS repo_id, 'c' || CAST(c_nationkey % 7 AS VARCHAR) AS head FROM customer),
  m AS (SELECT DISTINCT 'r' || CAST(c_nationkey AS VARCHAR) AS repo_id, 'c' || CAST(c_custkey % 4 AS VARCHAR) AS commit_sha FROM customer),
  l AS (SELECT 'r' || CAST(c_nationkey AS VARCHAR) AS repo_id, c_mktsegment AS s, c_custkey AS k FROM customer WHERE c_nationkey % 4 <> 1 QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey DESC) = 1),
  g AS (SELECT repo_id, count(*) AS n, bool_or(k % 5 = 0) AS stale, bool_or(k % 3 <> 0) AS readable FROM l GROUP BY repo_id)
  SELECT h.repo_id, head, EXISTS (SELECT 1 FROM m WHERE m.repo_id = h.repo_id AND commit_sha = head) OR coalesce(readable, false) AS indexed, coalesce(n, 0) AS n_rolling, coalesce(stale, false) AS possibly_stale FROM h LEFT JOIN g USING (repo_id)""")
def q29_rolling(spark, d):
    """The status of repositories with rolling indexes, of each solution the last of its states."""
    c = frame(spark, d, "customer").withColumn("repo_id", F.concat(F.lit("r"), F.col("c_nationkey").cast("string")))
    made = lambda e: F.concat(F.lit("c"), F.expr(e).cast("string"))
    heads = c.select("repo_id", made("c_nationkey % 7").alias("head")).distinct()
    manifests = c.select("repo_id", made("c_custkey % 4").alias("commit_sha")).distinct()
    k = F.col("c_custkey")
    state = F.when(k % 3 == 0, "FullRebuildRequired").when(k % 3 == 1, "UpToDate").otherwise("Failed")
    rolling = c.filter("c_nationkey % 4 <> 1").select("repo_id", F.col("c_mktsegment").alias("solution_id"), state.alias("index_state"), (k % 5 == 0).alias("possibly_stale"), k.alias("updated_at"))
    none = c.limit(0).select("repo_id", F.lit("w").alias("workspace_id"), F.lit("b").alias("base_commit"), F.lit(0).alias("revision"))
    return L.status(heads, manifests, none, rolling).select("repo_id", "head", "indexed", "n_rolling", "possibly_stale")
