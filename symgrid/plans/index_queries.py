"""Surfaces, reports, diffs, ingest and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from symgrid.functions import text as X
from symgrid.operators import diff as D
from symgrid.operators import lifecycle as L
from symgrid.operators import report as R
from symgrid.operators import summary as Y
from symgrid.operators import surfaces as S
from symgrid.operators import workspace as W
from symgrid.plans.bridge import frame, index
from symgrid.plans.queries import register
from symgrid.sources import store

_ORDER = "value, file_id, loc_start, symbol_id"
_SPLIT = "split_part(value, ' ', 1) AS method, CASE WHEN contains(value, ' ') THEN substr(value, strpos(value, ' ') + 1) ELSE '' END AS route"


@register("q17_endpoints", f"SELECT symbol_id, method, route, file_id, loc_start FROM (SELECT *, {_SPLIT} FROM facts WHERE fact_kind = 'Route') x WHERE upper(method) = 'GET' AND starts_with(lower(route), '/u/1') ORDER BY {_ORDER} LIMIT 200")
def q17_endpoints(spark, d):
    return S.endpoints(frame(spark, d, "facts"), "get", "/U/1", 200).select("symbol_id", "method", "route", "file_id", "loc_start")


@register("q17_endpoints_compat", f"SELECT symbol_id, method, route, file_id, loc_start FROM (SELECT *, {_SPLIT} FROM facts WHERE fact_kind = 'Route' ORDER BY {_ORDER} LIMIT 300) x WHERE starts_with(lower(route), '/u/1')")
def q17_endpoints_compat(spark, d):
    return S.endpoints(frame(spark, d, "facts"), None, "/u/1", 300, compat=True).select("symbol_id", "method", "route", "file_id", "loc_start")


_KEY = "split_part(value, '|', 1)"
_TAIL = "CASE WHEN contains(value, '|') THEN substr(value, strpos(value, '|') + 1) END"


@register("q18_config_keys", f"SELECT {_KEY} AS key, coalesce({_TAIL}, 'unknown') AS pattern, symbol_id, loc_start FROM facts WHERE fact_kind = 'Config' AND starts_with(lower({_KEY}), 'user3')")
def q18_config_keys(spark, d):
    return S.config_keys(frame(spark, d, "facts"), "USER3").select("key", "pattern", "symbol_id", "loc_start")


@register("q19_db_tables", f"""WITH own AS (SELECT *, {_KEY} AS full_name, {_TAIL} AS origin, row_number() OVER (PARTITION BY lower({_KEY}) ORDER BY {_ORDER}) AS n FROM facts WHERE fact_kind = 'DbTable')
  SELECT max(CASE WHEN n = 1 THEN regexp_replace(full_name, '^[^.]*[.]', '') END) AS "table", max(CASE WHEN n = 1 AND contains(full_name, '.') THEN split_part(full_name, '.', 1) END) AS schema_name, count(*) AS n_refs,
         string_agg(DISTINCT symbol_id, ',' ORDER BY symbol_id) AS symbols, CASE max(CASE confidence WHEN 'Low' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END) WHEN 3 THEN 'Low' WHEN 2 THEN 'Medium' ELSE 'High' END AS confidence,
         max(CASE WHEN n = 1 AND starts_with(origin, 'DbSet') THEN symbol_id END) AS entity FROM own GROUP BY lower(full_name)""")
def q19_db_tables(spark, d):
    return S.db_tables(frame(spark, d, "facts")).withColumn("symbols", F.array_join("symbols", ","))


@register("q19_db_tables_prefix", f"""WITH own AS (SELECT *, {_KEY} AS full_name, row_number() OVER (PARTITION BY lower({_KEY}) ORDER BY {_ORDER}) AS n FROM facts WHERE fact_kind = 'DbTable' AND (starts_with(lower({_KEY}), 't1') OR starts_with(lower(regexp_replace({_KEY}, '^[^.]*[.]', '')), 't1')))
  SELECT max(CASE WHEN n = 1 THEN regexp_replace(full_name, '^[^.]*[.]', '') END) AS "table", count(*) AS n_refs FROM own GROUP BY lower(full_name) ORDER BY 1 LIMIT 7""")
def q19_db_tables_prefix(spark, d):
    """A prefix without the schema, and a limit."""
    return S.db_tables(frame(spark, d, "facts"), "T1", 7).select("table", "n_refs")


@register("q20_sections", f"""SELECT fact_kind, value, symbol_id, loc_start, CAST(ord AS INTEGER) AS ord, total, total > 50 AS truncated
  FROM (SELECT *, row_number() OVER (PARTITION BY fact_kind ORDER BY {_ORDER}) AS ord, count(*) OVER (PARTITION BY fact_kind) AS total FROM facts) x WHERE ord <= 50""")
def q20_sections(spark, d):
    return R.capped(frame(spark, d, "facts")).select("fact_kind", "value", "symbol_id", "loc_start", "ord", "total", "truncated")


@register("q20_statistics", f"""SELECT 'facts.' || fact_kind AS stat, count(*) AS n FROM facts GROUP BY ALL
  UNION ALL SELECT 'exception_types', count(DISTINCT {_KEY}) FROM facts WHERE fact_kind = 'Exception' UNION ALL SELECT 'symbols', count(*) FROM symbols
  UNION ALL SELECT 'project_symbols', CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM symbols GROUP BY project_name) x UNION ALL SELECT 'project_references', CAST(sum(p_size) AS BIGINT) FROM part""")
def q20_statistics(spark, d):
    symbols = frame(spark, d, "symbols")
    projects = symbols.groupBy("project_name").agg(F.count("*").alias("symbol_count")).withColumn("reference_count", F.lit(0).cast("long"))
    projects = projects.unionByName(frame(spark, d, "part").select(F.col("p_name").alias("project_name"), F.lit(0).cast("long").alias("symbol_count"), F.col("p_size").cast("long").alias("reference_count")))
    return R.statistics(frame(spark, d, "facts"), symbols, projects)


@register("q20_parsed", f"""SELECT fact_kind, CASE WHEN fact_kind = 'Route' THEN split_part(value, ' ', 1) ELSE {_KEY} END AS head,
  CASE WHEN fact_kind = 'Route' THEN substr(value, strpos(value, ' ') + 1) ELSE {_TAIL} END AS tail, count(*) AS n FROM facts GROUP BY ALL""")
def q20_parsed(spark, d):
    return R.parsed(frame(spark, d, "facts")).groupBy("fact_kind", "head", "tail").agg(F.count("*").alias("n"))


@register("a2_config_groups", f"SELECT split_part({_KEY}, ':', 1) AS section, count(DISTINCT {_KEY}) AS n_keys, count(*) AS n FROM facts WHERE fact_kind = 'Config' GROUP BY 1")
def a2_config_groups(spark, d):
    return R.config_groups(frame(spark, d, "facts"))


@register("a6_semantic_level", "SELECT p_brand, CASE WHEN count(*) FILTER (WHERE p_size > 1) = count(*) THEN 'Full' WHEN count(*) FILTER (WHERE p_size > 1) = 0 THEN 'SyntaxOnly' ELSE 'Partial' END AS level FROM part GROUP BY p_brand")
def a6_semantic_level(spark, d):
    return R.semantic_level(frame(spark, d, "part").select("p_brand", (F.col("p_size") > 1).alias("compiled")), "p_brand")


@register("a7_merged_levels", """WITH b AS (SELECT p_brand AS repo_id, CASE WHEN max(p_size) > 48 THEN 'Full' ELSE 'Partial' END AS level FROM part GROUP BY 1), o AS (SELECT p_brand AS repo_id, CASE WHEN min(p_size) > 1 THEN 'SyntaxOnly' ELSE 'Full' END AS level FROM part WHERE p_partkey % 3 = 0 GROUP BY 1)
  SELECT repo_id, CASE WHEN o.level = 'SyntaxOnly' THEN 'SyntaxOnly' ELSE b.level END AS level FROM b LEFT JOIN o USING (repo_id)""")
def a7_merged_levels(spark, d):
    part = frame(spark, d, "part")
    b = part.groupBy(F.col("p_brand").alias("repo_id")).agg(F.when(F.max("p_size") > 48, "Full").otherwise("Partial").alias("level"))
    o = part.filter("p_partkey % 3 = 0").groupBy(F.col("p_brand").alias("repo_id")).agg(F.when(F.min("p_size") > 1, "SyntaxOnly").otherwise("Full").alias("level"))
    return W.merge_levels(b, o)


@register("a11_running_savings", "SELECT user_id AS session, event_id AS seq, sum(event_id % 7) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS total_tokens FROM events")
def a11_running_savings(spark, d):
    calls = frame(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (F.col("event_id") % 7).alias("tokens_saved"), F.lit(0.0).alias("cost"))
    return L.running_savings(calls).select("session", "seq", "total_tokens")


@register("t7_members", r"""WITH f AS (SELECT *, regexp_replace(regexp_replace(fqname, '^.:', ''), '[(`].*$', '') AS full_name FROM symbols),
  types AS (SELECT DISTINCT 'Parts.' || replace(p_brand, '#', '') AS parent, CASE WHEN p_brand > 'Brand#2' THEN 'Interface' ELSE 'Class' END AS kind FROM part)
  SELECT parent, types.kind, fqname AS member, CAST(row_number() OVER (PARTITION BY parent, types.kind ORDER BY fqname, symbol_id) AS INTEGER) AS ord
  FROM types JOIN f ON parent = regexp_replace(full_name, '[.][^.]*$', '') WHERE f.kind = 'Property' QUALIFY ord <= CASE WHEN types.kind = 'Interface' THEN 15 ELSE 20 END""")
def t7_members(spark, d):
    symbols = frame(spark, d, "symbols")
    brand = frame(spark, d, "part").select(F.concat(F.lit("T:Parts."), F.replace("p_brand", F.lit("#"), F.lit(""))).alias("fqname"), F.when(F.col("p_brand") > "Brand#2", "Interface").otherwise("Class").alias("kind")).distinct()
    return R.members(symbols.filter("kind = 'Property'").unionByName(brand, allowMissingColumns=True))


@register("q21_services", r"""WITH s AS (SELECT symbol_id, kind, CASE WHEN regexp_matches(fqname, 'NATION_1|EUROPE') THEN fqname || 'Service' WHEN contains(fqname, 'NATION_2') THEN fqname || 'service' ELSE fqname END AS f, CASE CAST(substr(file_id, 2) AS BIGINT) % 4 WHEN 0 THEN 'src/Api.Benchmarks/a.cs' WHEN 1 THEN 'src/test/a.cs' WHEN 2 THEN 'src/api.tests/a.cs' ELSE 'src/a.cs' END AS path FROM symbols)
  SELECT symbol_id, kind FROM s WHERE kind IN ('Class', 'Struct', 'Interface', 'Enum', 'Delegate', 'Record') AND regexp_matches(lower(f), '(service|controller|handler|repository|manager|processor)$') AND NOT regexp_matches(path, '\.(Tests|Benchmarks|TestUtilities)[/\\]')""")
def q21_services(spark, d):
    n = F.substring("file_id", 2, 20).cast("long") % 4
    path = F.when(n == 0, "src/Api.Benchmarks/a.cs").when(n == 1, "src/test/a.cs").when(n == 2, "src/api.tests/a.cs").otherwise("src/a.cs")
    end = F.when(F.col("fqname").rlike("NATION_1|EUROPE"), "Service").when(F.col("fqname").contains("NATION_2"), "service").otherwise("")
    return R.services(frame(spark, d, "symbols").withColumns({"fqname": F.concat("fqname", end), "path": path})).select("symbol_id", "kind")


_SHORT = r"regexp_extract(regexp_replace(regexp_replace(symbol_id, '^.:', ''), '[(`].*$', ''), '([^.]*[.])?[^.]*$', 0)"
_SUMMARY = f"""c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fact_kind ORDER BY {_ORDER}) AS n FROM facts) x WHERE n <= 50),
  p AS (SELECT project_name, count(*) AS s FROM symbols GROUP BY 1),
  u AS (
    SELECT 1 AS sec, '' AS a, 0 AS b, n AS c, '| ' || split_part(value, ' ', 1) || ' | ' || substr(value, strpos(value, ' ') + 1) || ' | ' || {_SHORT} || ' |' AS line, 1 AS items FROM c WHERE fact_kind = 'Route' AND contains(value, ' ')
    UNION ALL SELECT 2, '', 0, n, '| ' || {_KEY} || ' | ' || coalesce({_TAIL}, '') || ' |', 1 FROM (SELECT * FROM c WHERE fact_kind = 'DbTable' QUALIFY row_number() OVER (PARTITION BY lower({_KEY}) ORDER BY n) = 1) t
    UNION ALL SELECT DISTINCT 3, split_part({_KEY}, ':', 1), 0, 0, '### ' || split_part({_KEY}, ':', 1), 0 FROM c WHERE fact_kind = 'Config'
    UNION ALL SELECT 3, split_part({_KEY}, ':', 1), 1, n, '- `' || {_KEY} || '` — ' || coalesce({_TAIL}, ''), 1 FROM c WHERE fact_kind = 'Config'
    UNION ALL SELECT 8, '', 0, n, '| ' || {_KEY} || ' | ' || coalesce({_TAIL}, '') || ' | ' || {_SHORT} || ' |', 1 FROM c WHERE fact_kind = 'Exception'
    UNION ALL SELECT 0, '', 0, 0, count(*) || ' projects, ' || CAST(sum(s) AS BIGINT) || ' symbols, 0 references', 0 FROM p UNION ALL SELECT 0, '', 1, 0, 'Semantic level: Full', 0
    UNION ALL SELECT 0, '~' || project_name, 0, 0, '| ' || project_name || ' | ✓ | ' || s || ' |', 1 FROM p
    UNION ALL SELECT 10, '', 0, 0, '- Projects: ' || count(*) || ', symbols: ' || CAST(sum(s) AS BIGINT) || ', references: 0', 0 FROM p UNION ALL SELECT 10, '~', 0, 0, '- Index quality: Full', 0
    UNION ALL SELECT 10, '', 1, list_position(['Route','DbTable','Config','Exception'], fact_kind), '- ' || fact_kind || ': ' || count(*), count(*) FROM c GROUP BY fact_kind)"""


def _projects(spark, d):
    return frame(spark, d, "symbols").groupBy("project_name").agg(F.count("*").cast("int").alias("symbol_count")).select("project_name", F.lit(True).alias("compiled"), "symbol_count", F.lit(0).alias("reference_count"), F.lit(False).alias("is_test"))


@register("q20_summary", f"WITH {_SUMMARY} SELECT CAST(sec AS INTEGER) AS sec, CAST(row_number() OVER (PARTITION BY sec ORDER BY a, b, c, line) AS INTEGER) AS ord, line, CAST(sum(items) OVER (PARTITION BY sec) AS BIGINT) AS items FROM u")
def q20_summary(spark, d):
    return Y.summary(frame(spark, d, "facts"), _projects(spark, d)).select("sec", "ord", "line", "items")


@register("q21_export", f"""WITH {_SUMMARY},
  n AS (SELECT sec, row_number() OVER (PARTITION BY sec ORDER BY a, b, c, line) AS ord, line, sum(length(line) + 1) OVER (PARTITION BY sec ORDER BY a, b, c, line) AS run FROM u),
  cost AS (SELECT sec, floor(max(run) / 4) AS cost FROM n GROUP BY sec), spent AS (SELECT sec, cost, coalesce(sum(cost) OVER (ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM cost)
  SELECT CAST(sec AS INTEGER) AS sec, CAST(ord AS INTEGER) AS ord, line, spent + cost > 1800 AS truncated FROM n JOIN spent USING (sec) WHERE spent < 1800 AND (spent + cost <= 1800 OR run <= (1800 - spent) * 4)""")
def q21_export(spark, d):
    own = index(spark, d)
    return Y.export(own, _projects(spark, d), "summary", 1_800).select("sec", "ord", "line", "truncated")


@register("q21_export_full", f"""WITH f AS (SELECT s.*, path, regexp_replace(regexp_replace(fqname, '^.:', ''), '[(`].*$', '') AS fl FROM symbols s LEFT JOIN files USING (file_id)),
  t AS (SELECT * FROM f WHERE kind IN ('Class', 'Interface', 'Record', 'Struct') ORDER BY fqname, symbol_id LIMIT 100),
  few AS (SELECT * FROM f ORDER BY fqname, symbol_id LIMIT 500)
  SELECT 11 AS sec, '### ' || kind || ' `' || fl || '`' AS line FROM t UNION ALL SELECT 13, '#### `' || fl || '`' FROM t WHERE kind = 'Interface'
  UNION ALL SELECT 14, '| ' || kind || ' | `' || {_SHORT.replace('symbol_id', 'fqname')} || '` | ' || coalesce(path, '') || ' | ' || span_start || ' |' FROM few""")
def q21_export_full(spark, d):
    own = index(spark, d)
    return Y.export(own, _projects(spark, d), "full", 1_000_000).filter("sec >= 11").select("sec", "line")


_DIFF = """a1 AS (SELECT * FROM before WHERE stable_id IS NOT NULL), b1 AS (SELECT * FROM after WHERE stable_id IS NOT NULL),
  p AS (SELECT a1.stable_id, a1.symbol_id AS fa, b1.symbol_id AS tb, a1.kind, a1.signature AS sa, b1.signature AS sb, a1.visibility AS va, b1.visibility AS vb FROM a1 JOIN b1 USING (stable_id)),
  ra AS (SELECT * FROM before WHERE symbol_id NOT IN (SELECT fa FROM p)), rb AS (SELECT * FROM after WHERE symbol_id NOT IN (SELECT tb FROM p)),
  o AS (
    SELECT CASE WHEN fa <> tb THEN 'Renamed' WHEN sa <> sb THEN 'SignatureChanged' WHEN va <> vb THEN 'VisibilityChanged' END AS change, stable_id, fa AS from_id, tb AS to_id, kind FROM p
    UNION ALL
    SELECT CASE WHEN rb.symbol_id IS NULL THEN 'Removed' WHEN ra.symbol_id IS NULL THEN 'Added' WHEN ra.signature <> rb.signature THEN 'SignatureChanged' END,
           CASE WHEN rb.symbol_id IS NULL THEN ra.stable_id WHEN ra.symbol_id IS NULL THEN rb.stable_id END, ra.symbol_id, rb.symbol_id, coalesce(ra.kind, rb.kind) FROM ra FULL JOIN rb ON ra.symbol_id = rb.symbol_id)"""


@register("q22_diff", f"WITH {_DIFF} SELECT * FROM o WHERE change IS NOT NULL")
def q22_diff(spark, d):
    return D.symbols(frame(spark, d, "before"), frame(spark, d, "after")).select("change", "stable_id", "from_id", "to_id", "kind")


@register("q22_diff_stats", f"WITH {_DIFF} SELECT count(*) FILTER (WHERE change = 'Added') AS added, count(*) FILTER (WHERE change = 'Removed') AS removed, count(*) FILTER (WHERE change = 'Renamed') AS renamed, count(*) FILTER (WHERE change = 'SignatureChanged') AS signature_changed, count(*) FILTER (WHERE change = 'VisibilityChanged') AS visibility_changed FROM o WHERE kind = 'Method'")
def q22_diff_stats(spark, d):
    return D.stats(D.symbols(frame(spark, d, "before"), frame(spark, d, "after"), ["Method"]))


_SIDE = f"""{{n}} AS (SELECT key, min((CASE fact_kind WHEN 'Config' THEN 'Config' ELSE fact_kind END, value)) AS f FROM (
    SELECT fact_kind, value, CASE WHEN fact_kind = 'Route' THEN value WHEN fact_kind IN ('Config', 'DbTable') THEN {_KEY} ELSE fact_kind || ':' || value END AS key,
           row_number() OVER (PARTITION BY fact_kind ORDER BY value) AS n FROM facts WHERE ts {{op}} TIMESTAMP '2024-01-15 00:00:00') x WHERE n <= {{cap}} GROUP BY key)"""


def _fact_diff(cap: int) -> str:
    return f"""WITH {_SIDE.format(n='a', op='<', cap=cap)}, {_SIDE.format(n='b', op='>=', cap=cap)}
      SELECT CASE WHEN a.key IS NULL THEN 'Added' WHEN b.key IS NULL THEN 'Removed' ELSE 'Changed' END AS change, coalesce(a.key, b.key) AS key, struct_extract_at(a.f, 2) AS from_value, struct_extract_at(b.f, 2) AS to_value
      FROM a FULL JOIN b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR struct_extract_at(a.f, 2) <> struct_extract_at(b.f, 2)"""


@register("q22_fact_diff", _fact_diff(500))
def q22_fact_diff(spark, d):
    facts = frame(spark, d, "facts")
    return D.facts(facts.filter("ts < timestamp '2024-01-15 00:00:00'"), facts.filter("ts >= timestamp '2024-01-15 00:00:00'"))


@register("s2_ingest_check", """WITH f AS (SELECT file_id FROM files WHERE CAST(substr(file_id, 2) AS BIGINT) % 10 <> 3), s AS (SELECT * FROM symbols SEMI JOIN f USING (file_id) WHERE NOT starts_with(symbol_id, 'M:Shop.Suppliers.S1'))
  SELECT 'symbols' AS relation, count(*) AS n, 0 AS odd FROM s
  UNION ALL SELECT 'refs', count(*), count(*) FILTER (WHERE to_symbol_id NOT IN (SELECT symbol_id FROM s)) FROM refs SEMI JOIN f USING (file_id) WHERE from_symbol_id IN (SELECT symbol_id FROM s)
  UNION ALL SELECT 'facts', count(*), 0 FROM facts SEMI JOIN f USING (file_id)
  UNION ALL SELECT 'type_relations', count(*), 0 FROM type_relations WHERE type_symbol_id IN (SELECT symbol_id FROM s)""")
def s2_ingest_check(spark, d):
    own = index(spark, d)
    files = own.files.filter("cast(substring(file_id, 2) as bigint) % 10 <> 3")
    symbols = own.symbols.filter("not startswith(symbol_id, 'M:Shop.Suppliers.S1')").withColumn("name_tokens", F.lit(None).cast("array<string>"))
    out = store.check(store.Index(files, symbols, own.refs, own.facts, own.type_relations))
    n = lambda df, name, odd: df.agg(F.lit(name).alias("relation"), F.count("*").alias("n"), F.count_if(odd).alias("odd"))
    return n(out.symbols, "symbols", F.col("stable_id").isNull()).unionByName(n(out.refs, "refs", F.col("to_symbol_id") == "")).unionByName(n(out.facts, "facts", F.lit(False))).unionByName(n(out.type_relations, "type_relations", F.lit(False)))


@register("q24_list_baselines", "SELECT solution_id, commit_sha, max(created_at) AS created_at, sum(size_bytes)::BIGINT AS size_bytes, count(*) AS n_files FROM (SELECT * FROM baselines UNION ALL SELECT * FROM baselines WHERE o_orderstatus = 'F') x GROUP BY ALL")
def q24_list_baselines(spark, d):
    b = frame(spark, d, "baselines")
    return L.list_baselines(b.unionByName(b.filter("o_orderstatus = 'F'")))


_CLEAN = """c AS (SELECT solution_id, commit_sha, created_at, size_bytes, row_number() OVER (PARTITION BY lower(solution_id) ORDER BY created_at DESC, commit_sha) > 3 AND o_orderstatus <> 'P' AND created_at < TIMESTAMP '2000-06-01 00:00:00' AS removed FROM baselines)"""


def _cleaned(spark, d):
    from datetime import datetime

    b = frame(spark, d, "baselines")
    return L.cleanup(b.drop("o_orderstatus"), b.filter("o_orderstatus = 'P'").select("commit_sha"), 3, datetime(2000, 6, 1))


@register("q25_cleanup", f"WITH {_CLEAN} SELECT solution_id, commit_sha, removed FROM c")
def q25_cleanup(spark, d):
    return _cleaned(spark, d).select("solution_id", "commit_sha", "removed")


@register("q26_reclaimed", f"WITH {_CLEAN} SELECT count(*) FILTER (WHERE removed) AS n_removed, count(*) FILTER (WHERE NOT removed) AS n_kept, CAST(coalesce(sum(size_bytes) FILTER (WHERE removed), 0) AS BIGINT) AS bytes_reclaimed FROM c")
def q26_reclaimed(spark, d):
    return L.reclaimed(_cleaned(spark, d))


@register("q28_workspaces", "SELECT 'w' || CAST(c_custkey AS VARCHAR) AS workspace_id, c_mktsegment AS repo_id, coalesce('b' || CAST(c_custkey % 4 AS VARCHAR) <> h.head, false) AS is_stale FROM customer LEFT JOIN (SELECT DISTINCT c_mktsegment, 'b1' AS head FROM customer WHERE c_mktsegment <> 'MACHINERY') h USING (c_mktsegment)")
def q28_workspaces(spark, d):
    c = frame(spark, d, "customer")
    registry = c.select(F.concat(F.lit("w"), F.col("c_custkey").cast("string")).alias("workspace_id"), F.col("c_mktsegment").alias("repo_id"), F.concat(F.lit("b"), (F.col("c_custkey") % 4).cast("string")).alias("base_commit"))
    heads = c.filter("c_mktsegment <> 'MACHINERY'").select(F.col("c_mktsegment").alias("repo_id"), F.lit("b1").alias("head")).distinct()
    return L.workspaces(registry, heads).select("workspace_id", "repo_id", "is_stale")


_INPUTS = "i AS (SELECT source, lang || '/' || CAST(min(doc_id) AS VARCHAR) AS path, sha256(min(text)) AS hash, 1 + count(*) % 9 AS weight FROM (SELECT *, doc_id % 40 AS b FROM documents) z GROUP BY source, lang, b), "
_SIM = _INPUTS + """x AS (SELECT source, CAST(hash_bucket AS VARCHAR) || path AS path, hash, weight FROM (SELECT source, substr(path, 1, 2) AS path, substr(hash, 1, 1) AS hash, max(weight) AS weight, length(path) AS hash_bucket FROM i GROUP BY source, substr(path, 1, 2), substr(hash, 1, 1), length(path)) q QUALIFY row_number() OVER (PARTITION BY source, path, hash_bucket ORDER BY hash) = 1),
  t AS (SELECT * FROM x WHERE source = 'src1'), c AS (SELECT * FROM x WHERE source <> 'src1'),
  j AS (SELECT cs.source AS candidate, coalesce(c.weight, 0) AS cw, coalesce(t.weight, 0) AS tw, c.hash = t.hash AS same FROM (SELECT DISTINCT source FROM c) cs CROSS JOIN (SELECT DISTINCT path FROM x) ps LEFT JOIN c ON c.source = cs.source AND c.path = ps.path LEFT JOIN t ON t.path = ps.path),
  s AS (SELECT candidate, sum(CASE WHEN same THEN greatest(cw, tw) ELSE 0 END)::DOUBLE / sum(greatest(cw, tw)) AS similarity FROM j GROUP BY candidate)"""


def _similar(spark, d):
    docs = frame(spark, d, "documents").withColumn("b", F.col("doc_id") % 40)
    i = docs.groupBy("source", "lang", "b").agg(F.concat_ws("/", F.first("lang"), F.min("doc_id").cast("string")).alias("path"), F.sha2(F.min("text"), 256).alias("hash"), (1 + F.count("*") % 9).alias("weight"))
    q = i.groupBy("source", F.substring("path", 1, 2).alias("p"), F.substring("hash", 1, 1).alias("hash"), F.length("path").alias("n")).agg(F.max("weight").alias("weight"))
    from pyspark.sql.window import Window

    q = q.withColumn("r", F.row_number().over(Window.partitionBy("source", "p", "n").orderBy("hash"))).filter("r = 1")
    x = q.select("source", F.concat(F.col("n").cast("string"), F.col("p")).alias("path"), "hash", "weight")
    return L.similarity(x.filter("source = 'src1'"), x.filter("source <> 'src1'").withColumnRenamed("source", "candidate"))


@register("j13_similarity", f"WITH {_SIM} SELECT candidate, round(similarity, 9) AS similarity FROM s")
def j13_similarity(spark, d):
    return _similar(spark, d).select("candidate", F.round("similarity", 9).alias("similarity"))


@register("w5_best_seed", """WITH s AS (SELECT c_nationkey AS target, 'c' || CAST(c_custkey AS VARCHAR) AS candidate, (c_custkey % 50) / 50.0 AS similarity, CASE c_custkey % 4 WHEN 0 THEN 'Divergent' WHEN 1 THEN 'Ancestor' WHEN 2 THEN 'MergeBase' ELSE CASE WHEN c_custkey % 97 = 0 THEN 'Identical' ELSE 'Ancestor' END END AS rel, c_custkey % 3 AS changed, c_custkey AS published FROM customer)
  SELECT CAST(target AS INTEGER) AS target, candidate FROM s WHERE rel = 'Identical' OR similarity >= 0.6
  QUALIFY row_number() OVER (PARTITION BY target ORDER BY rel = 'Identical' DESC, similarity DESC, list_position(['Identical','Ancestor','MergeBase','Divergent'], rel), changed, published DESC, candidate) = 1""")
def w5_best_seed(spark, d):
    k = F.col("c_custkey")
    rel = F.when(k % 4 == 0, "Divergent").when(k % 4 == 1, "Ancestor").when(k % 4 == 2, "MergeBase").when(k % 97 == 0, "Identical").otherwise("Ancestor")
    s = frame(spark, d, "customer").select(F.col("c_nationkey").alias("target"), F.concat(F.lit("c"), k.cast("string")).alias("candidate"), ((k % 50) / 50.0).alias("similarity"), rel.alias("relationship"), (k % 3).alias("changed_projects"), k.alias("published_at"))
    return L.best_seed(s).select("target", "candidate")


@register("s13_changed_files", """WITH u AS (SELECT path, 'Modified' AS change, 1 AS r FROM files WHERE hash(1) IS NOT NULL AND CAST(substr(file_id, 2) AS BIGINT) % 2 = 0 UNION ALL SELECT upper(path), 'Deleted', 0 FROM files WHERE CAST(substr(file_id, 2) AS BIGINT) % 3 = 0)
  SELECT path, change FROM u QUALIFY row_number() OVER (PARTITION BY lower(path) ORDER BY r, path) = 1""")
def s13_changed_files(spark, d):
    f = frame(spark, d, "files").withColumn("n", F.substring("file_id", 2, 20).cast("long"))
    return L.changed_files(f.filter("n % 2 = 0").select("path", F.lit("Modified").alias("change")), f.filter("n % 3 = 0").select(F.upper("path").alias("path"), F.lit("Deleted").alias("change")))


@register("m21_impact", """WITH RECURSIVE p AS (SELECT DISTINCT source || '/' || lang AS project, source || '/' || lang AS dir FROM documents), hit AS (SELECT DISTINCT project FROM files JOIN p ON starts_with(lower(path), lower(dir) || '/') WHERE CAST(substr(file_id, 2) AS BIGINT) < 20),
  dep AS (SELECT DISTINCT a.source || '/' || a.lang AS project, 'src' || CAST(CAST(substr(a.source, 4) AS INTEGER) - 7 AS VARCHAR) || '/' || a.lang AS "on" FROM documents a), reach AS (SELECT project FROM hit UNION SELECT dep.project FROM reach JOIN dep ON dep."on" = reach.project)
  SELECT DISTINCT split_part(p.project, '/', 2) || CAST(CAST(substr(split_part(p.project, '/', 1), 4) AS INTEGER) % 5 AS VARCHAR) AS solution FROM p JOIN reach USING (project)""")
def m21_impact(spark, d):
    docs = frame(spark, d, "documents").select("source", "lang").distinct()
    p = F.concat_ws("/", "source", "lang")
    n = F.substring("source", 4, 9).cast("int")
    changes = frame(spark, d, "files").filter("cast(substring(file_id, 2) as bigint) < 20").select("path")
    depends = docs.select(p.alias("project"), F.concat(F.lit("src"), (n - 7).cast("string"), F.lit("/"), F.col("lang")).alias("on"))
    members = docs.select(p.alias("project"), F.concat("lang", (n % 5).cast("string")).alias("solution"))
    return L.impact(changes, docs.select(p.alias("project"), p.alias("dir")), depends, members)


@register("m22_weighted_inputs", """WITH e AS (SELECT path, file_id AS hash, 1 AS weight FROM files UNION ALL SELECT path, file_id || 'p', 5 FROM files WHERE CAST(substr(file_id, 2) AS BIGINT) % 4 = 0 UNION ALL SELECT path, file_id || 's', 8 FROM files WHERE CAST(substr(file_id, 2) AS BIGINT) % 6 = 0)
  SELECT path, hash, CAST(weight AS INTEGER) AS weight FROM e QUALIFY row_number() OVER (PARTITION BY lower(path) ORDER BY weight DESC) = 1""")
def m22_weighted_inputs(spark, d):
    f = frame(spark, d, "files").withColumn("n", F.substring("file_id", 2, 20).cast("long"))
    hashed = lambda df, end: df.select("path", F.concat("file_id", F.lit(end)).alias("hash"))
    return L.weighted_inputs(hashed(f, ""), hashed(f.filter("n % 4 = 0"), "p"), hashed(f.filter("n % 6 = 0"), "s"))


@register("r4_latest_request", "SELECT 'r' || CAST(user_id AS VARCHAR) AS repo_id, max(event_id) AS seq FROM events GROUP BY 1")
def r4_latest_request(spark, d):
    return L.latest_request(frame(spark, d, "events").select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("repo_id"), F.col("event_id").alias("seq"))).select("repo_id", "seq")


@register("m20_visible", "SELECT event_id FROM events WHERE user_id % 3 = 0 AND event_id % 5 = 2")
def m20_visible(spark, d):
    e = frame(spark, d, "events").select("event_id", F.col("user_id").alias("repo_id"), (F.col("event_id") % 5).alias("generation"))
    pointers = e.select("repo_id").distinct().select("repo_id", F.lit(2).cast("long").alias("generation"), F.when(F.col("repo_id") % 3 == 0, "Ready").otherwise("Updating").alias("state"))
    return L.visible(e, pointers).select("event_id")


_URL = "url || CASE page_id % 7 WHEN 0 THEN '/a.CS' WHEN 1 THEN '/b.vb' WHEN 2 THEN '/c.fs' WHEN 3 THEN '/d.fsi' WHEN 4 THEN '/e.Razor' WHEN 5 THEN '.git' ELSE '/' END"


@register("x21_ids", f"""WITH u AS (SELECT page_id, {_URL} AS url FROM pages) SELECT page_id, substr(sha256(regexp_replace(lower(regexp_replace(url, '^[a-z]+://', '')), '(.git)?/*$', '')), 1, 16) AS id,
  CASE page_id % 7 WHEN 0 THEN 'csharp' WHEN 1 THEN 'vb' WHEN 2 THEN 'fsharp' WHEN 3 THEN 'fsharp' WHEN 4 THEN 'razor' ELSE 'other' END AS language FROM u""")
def x21_ids(spark, d):
    own = frame(spark, d, "pages").select("page_id", F.expr(_URL).alias("url"))
    return own.select("page_id", X.repo_id(F.col("url")).alias("id"), X.language(F.col("url")).alias("language"))


@register("s1_publish", """SELECT 'files' AS relation, count(*) AS n, count(DISTINCT path) AS keys, max(path) AS last FROM files UNION ALL SELECT 'symbols', count(*), count(DISTINCT fqname), max(signature) FROM symbols
  UNION ALL SELECT 'refs_by_to', count(*), count(DISTINCT to_symbol_id), max(from_symbol_id) FROM refs UNION ALL SELECT 'refs_by_from', count(*), count(DISTINCT to_symbol_id), max(from_symbol_id) FROM refs
  UNION ALL SELECT 'facts', count(*), count(DISTINCT value), max(symbol_id) FROM facts UNION ALL SELECT 'type_relations', count(*), count(DISTINCT related_symbol_id), max(type_symbol_id) FROM type_relations""")
def s1_publish(spark, d):
    """Checks, writes and reads back a whole snapshot; the manifest makes it visible."""
    import uuid

    from symgrid.session import shared_folder

    own = index(spark, d)
    typed = store.Index(own.files, own.symbols.withColumn("name_tokens", F.lit(None).cast("array<string>")), own.refs, own.facts, own.type_relations)
    root = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    store.publish(store.check(typed), root, "repo", "sln", "a" * 40)
    told = {"files": ("path", "path"), "symbols": ("fqname", "signature"), "refs_by_to": ("to_symbol_id", "from_symbol_id"), "refs_by_from": ("to_symbol_id", "from_symbol_id"), "facts": ("value", "symbol_id"), "type_relations": ("related_symbol_id", "type_symbol_id")}
    out = None
    for name, (key, last) in told.items():
        back = store.open_table(spark, root, name, "repo", "sln", "a" * 40)
        n = back.agg(F.lit(name).alias("relation"), F.count("*").alias("n"), F.count_distinct(key).alias("keys"), F.max(last).alias("last"))
        out = n if out is None else out.unionByName(n)
    return out


@register("s6_lookups", """SELECT 'by_path' AS lookup, count(*) AS n FROM files WHERE path = 'src1/en/1.txt' UNION ALL SELECT 'by_file', count(*) FROM symbols WHERE file_id = 'd7' UNION ALL SELECT 'by_symbol', count(*) FROM facts WHERE symbol_id = 'M:Shop.Customers.C7'
  UNION ALL SELECT 'by_kind', count(*) FROM facts WHERE fact_kind = 'Config' UNION ALL SELECT 'unresolved', count(*) FROM refs WHERE resolution_state = 'Unresolved' AND file_id IN ('d1', 'd2')""")
def s6_lookups(spark, d):
    own = index(spark, d)
    n = lambda df, name: df.agg(F.lit(name).alias("lookup"), F.count("*").alias("n"))
    two = own.files.filter(F.col("file_id").isin("d1", "d2")).select("file_id")
    parts = [n(own.files.filter("path = 'src1/en/1.txt'"), "by_path"), n(own.symbols.filter("file_id = 'd7'"), "by_file"), n(own.facts.filter("symbol_id = 'M:Shop.Customers.C7'"), "by_symbol"), n(own.facts.filter("fact_kind = 'Config'"), "by_kind"), n(own.refs.filter("resolution_state = 'Unresolved'").join(two, "file_id", "left_semi"), "unresolved")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
