"""Workspace overlays: folding, merging, deltas, the change feed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from symgrid.operators import hierarchy as H
from symgrid.operators import overlay as O
from symgrid.operators import spans as P
from symgrid.operators import surfaces as S
from symgrid.operators import workspace as W
from symgrid.plans.bridge import frame, index
from symgrid.plans.queries import register
from symgrid.session import durable, shared_folder
from symgrid.sources import parts, store
from symgrid.streaming import feed

_LAST = "last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY workspace_id, key ORDER BY revision DESC) = 1)"


@register("w6_fold", f"WITH {_LAST} SELECT workspace_id, key, revision, op, payload FROM last")
def w6_fold(spark, d):
    log = frame(spark, d, "log").withColumn("k", F.struct("workspace_id", "key"))
    out = O.fold(log.drop("workspace_id", "key"), "k")
    return out.select("k.workspace_id", "k.key", "revision", "op", "payload")


@register("m13_live", "WITH last AS (SELECT * FROM log WHERE workspace_id = 'w1' QUALIFY row_number() OVER (PARTITION BY key ORDER BY revision DESC) = 1) SELECT key, payload, 'live' AS state FROM last WHERE op <> 'Tombstone' UNION ALL SELECT key, NULL, 'deleted' FROM last WHERE op = 'Tombstone'")
def m13_live(spark, d):
    log = frame(spark, d, "log").filter("workspace_id = 'w1'")
    return O.live(log).select("key", "payload", F.lit("live").alias("state")).unionByName(O.deleted(log).select("key", F.lit(None).cast("string").alias("payload"), F.lit("deleted").alias("state")))


@register("m17_fork", "WITH f AS (SELECT key, revision, op, payload FROM log WHERE workspace_id = 'w2' AND revision <= 8000) SELECT key, op, payload FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY revision DESC) = 1")
def m17_fork(spark, d):
    forked = O.fork(frame(spark, d, "log"), "w2", "new", 8000)
    return O.fold(forked).select("key", "op", "payload")


@register("m18_without", "SELECT workspace_id, count(*) AS n FROM log WHERE workspace_id <> 'w0' GROUP BY 1")
def m18_without(spark, d):
    return O.without(frame(spark, d, "log"), "w0").groupBy("workspace_id").agg(F.count("*").alias("n"))


@register("m12_latest_files", "SELECT file_id, loc_start, value FROM facts QUALIFY event_id // 200 % 4 = max(event_id // 200 % 4) OVER (PARTITION BY file_id)")
def m12_latest_files(spark, d):
    rows = frame(spark, d, "facts").withColumn("revision", F.expr("event_id div 200 % 4"))
    return O.latest_files(rows).select("file_id", "loc_start", "value")


def _parts(spark, d):
    """Snapshot symbols, an overlay with new and changed ones, deleted ids, files read again."""
    symbols = frame(spark, d, "symbols")
    files = frame(spark, d, "files").filter("cast(substring(file_id, 2) as bigint) % 9 = 4").select("file_id")
    fresh = symbols.filter("cast(substring(file_id, 2) as bigint) % 18 = 4").withColumn("signature", F.concat("signature", F.lit(" v2")))
    gone = symbols.filter("startswith(symbol_id, 'M:Shop.Customers.C7')").select("symbol_id")
    return symbols, fresh, gone, files


_N = "CAST(substr(file_id, 2) AS BIGINT)"
_MERGED = f"""f AS (SELECT file_id FROM files WHERE {_N} % 9 = 4), fresh AS (SELECT symbol_id, signature || ' v2' AS signature FROM symbols WHERE {_N} % 18 = 4),
  merged AS (SELECT symbol_id, signature, 'baseline' AS origin FROM symbols WHERE NOT starts_with(symbol_id, 'M:Shop.Customers.C7') AND symbol_id NOT IN (SELECT symbol_id FROM fresh) AND file_id NOT IN (SELECT file_id FROM f)
    UNION ALL SELECT symbol_id, signature, 'overlay' FROM fresh)"""


@register("m1_symbols", f"""WITH f AS (SELECT file_id FROM files WHERE {_N} % 9 = 4), fresh AS (SELECT symbol_id, signature || ' v2' AS signature, stable_id FROM symbols WHERE {_N} % 18 = 4
    UNION ALL SELECT replace(symbol_id, 'Suppliers', 'Renamed'), signature, stable_id FROM symbols WHERE starts_with(symbol_id, 'M:Shop.Suppliers.') AND {_N} % 18 = 5)
  SELECT symbol_id, signature, 'baseline' AS origin FROM symbols WHERE NOT starts_with(symbol_id, 'M:Shop.Customers.C7') AND symbol_id NOT IN (SELECT symbol_id FROM fresh) AND (stable_id IS NULL OR stable_id NOT IN (SELECT stable_id FROM fresh WHERE stable_id IS NOT NULL)) AND file_id NOT IN (SELECT file_id FROM f)
    UNION ALL SELECT symbol_id, signature, 'overlay' FROM fresh""")
def m1_symbols(spark, d):
    """Some suppliers have another id and their old stable id; they show once."""
    symbols, fresh, gone, files = _parts(spark, d)
    renamed = symbols.filter("startswith(symbol_id, 'M:Shop.Suppliers.') and cast(substring(file_id, 2) as bigint) % 18 = 5").withColumn("symbol_id", F.replace("symbol_id", F.lit("Suppliers"), F.lit("Renamed")))
    return O.symbols(symbols, fresh.unionByName(renamed), gone, files).select("symbol_id", "signature", "origin")


def _workspace(spark, d):
    """A baseline of symbols and calls among parts, and an overlay that read every ninth file again and lost some parts."""
    own = index(spark, d)
    calls = frame(spark, d, "calls")
    base = store.Index(own.files, own.symbols, calls, own.facts, own.type_relations)
    n = F.substring("file_id", 2, 20).cast("long")
    seen = lambda df: df.filter(n % 9 == 4)
    symbols = seen(own.symbols).withColumn("signature", F.concat("signature", F.lit(" v2")))
    # The files read again call the other way round.
    turned = seen(calls).withColumns({"from_symbol_id": F.col("to_symbol_id"), "to_symbol_id": F.col("from_symbol_id")})
    gone = own.symbols.filter("startswith(symbol_id, 'P:Parts.P1')").select("symbol_id", "stable_id")
    none = W.empty(base)
    return base, W.Overlay(seen(own.files), symbols.filter("not startswith(symbol_id, 'P:Parts.P1')"), turned, none.facts, none.type_relations, gone)


_VIEW = f"""ok AS (SELECT * FROM (SELECT from_symbol_id AS a, to_symbol_id AS b, ref_kind FROM calls WHERE {_N} % 9 <> 4 UNION ALL SELECT to_symbol_id, from_symbol_id, ref_kind FROM calls WHERE {_N} % 9 = 4) x WHERE NOT starts_with(a, 'P:Parts.P1') AND NOT starts_with(b, 'P:Parts.P1')),
  e AS (SELECT DISTINCT a, b FROM ok WHERE ref_kind = 'Call'), roots AS (SELECT symbol_id AS root FROM symbols WHERE kind = 'Property' AND NOT starts_with(symbol_id, 'P:Parts.P1')),
  reach AS (SELECT root, root AS node, 0 AS depth FROM roots UNION SELECT root, {{next}}, depth + 1 FROM reach JOIN e ON {{this}} = node WHERE depth < 2)
  SELECT root, node, CAST(min(depth) AS INTEGER) AS depth FROM reach GROUP BY root, node"""


@register("g9_workspace_callers", "WITH RECURSIVE " + _VIEW.format(next="a", this="b"))
def g9_workspace_callers(spark, d):
    base, own = _workspace(spark, d)
    roots = base.symbols.filter("kind = 'Property'").select(F.col("symbol_id").alias("root"))
    return W.callers(roots, base, own, 2)[0].select("root", "node", "depth")


@register("g9_workspace_callees", "WITH RECURSIVE " + _VIEW.format(next="b", this="a"))
def g9_workspace_callees(spark, d):
    base, own = _workspace(spark, d)
    roots = base.symbols.filter("kind = 'Property'").select(F.col("symbol_id").alias("root"))
    return W.callees(roots, base, own, 2)[0].select("root", "node", "depth")


@register("m2_search_merged", f"""WITH view AS (SELECT symbol_id, fqname, namespace, signature || CASE WHEN {_N} % 9 = 4 THEN ' v2' ELSE '' END AS signature, documentation, {_N} % 9 = 4 AS o FROM symbols WHERE NOT starts_with(symbol_id, 'P:Parts.P1')),
  hit AS (SELECT *, lower(list_extract(string_split(regexp_replace(regexp_replace(fqname, '^.:', ''), '[(`].*$', ''), '.'), -1)) AS dn FROM view
    WHERE len(list_filter(string_split_regex(lower(coalesce(signature, '')), '[^a-zA-Z0-9]+'), lambda x: starts_with(x, 'ring'))) > 0 OR contains(lower(fqname), '.ring')),
  s AS (SELECT symbol_id, CASE WHEN o THEN 'overlay' ELSE 'baseline' END AS origin, CASE WHEN starts_with(dn, 'ring') THEN 60 ELSE 10 END + CASE WHEN length(dn) < 30 THEN 5 ELSE 0 END AS score, o FROM hit)
  SELECT symbol_id, origin, CAST(score AS INTEGER) AS score, count(*) OVER () > 100 AS truncated FROM s ORDER BY o DESC, score DESC, symbol_id LIMIT 100""")
def m2_search_merged(spark, d):
    base, own = _workspace(spark, d)
    return W.search_merged(base, own, "ring", 100).select("symbol_id", "origin", "score", "truncated")


@register("m11_refresh", f"""WITH fresh AS (SELECT * FROM symbols WHERE {_N} % 18 = 4), again AS (SELECT file_id FROM files WHERE {_N} % 9 = 4)
  SELECT symbol_id, 'baseline' AS state FROM symbols WHERE file_id NOT IN (SELECT file_id FROM again) UNION ALL SELECT symbol_id, 'overlay' FROM fresh
  UNION ALL SELECT symbol_id, 'deleted' FROM symbols SEMI JOIN again USING (file_id) WHERE symbol_id NOT IN (SELECT symbol_id FROM fresh)""")
def m11_refresh(spark, d):
    """A whole refresh: every ninth file is read again, half of them without symbols."""
    own = index(spark, d)
    symbols, fresh, _, files = _parts(spark, d)
    made = store.Index(own.files.join(files, "file_id", "left_semi"), fresh, own.refs.limit(0), own.facts.limit(0), own.type_relations.limit(0))
    done = W.refresh(own, W.empty(own), made, level="SyntaxOnly")
    view = W.merged(own, done).symbols.select("symbol_id", F.col("origin").alias("state"))
    return view.unionByName(done.deleted.select("symbol_id", F.lit("deleted").alias("state")))


@register("m3_scoped_distinct", """WITH r AS (SELECT o_custkey AS symbol_id, o_orderkey AS ord, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE lower(o_orderstatus) END AS s FROM orders),
  x AS (SELECT *, first_value(s) OVER (PARTITION BY symbol_id ORDER BY ord) AS f, row_number() OVER (PARTITION BY symbol_id ORDER BY ord) AS n, row_number() OVER (PARTITION BY symbol_id, s ORDER BY ord) AS k FROM r)
  SELECT symbol_id, ord FROM x WHERE n = 1 OR (f <> '' AND s <> '' AND k = 1)""")
def m3_scoped_distinct(spark, d):
    rows = frame(spark, d, "orders").select(F.col("o_custkey").alias("symbol_id"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderstatus")).alias("project_name"))
    return O.scoped_distinct(rows, "ord").select("symbol_id", "ord")


@register("m4_refs", f"SELECT from_symbol_id, ref_kind, file_id, loc_start, 'b' AS side FROM refs WHERE {_N} % 9 <> 4 UNION ALL SELECT from_symbol_id, 'Call', file_id, loc_start, 'o' FROM refs WHERE {_N} % 18 = 4")
def m4_refs(spark, d):
    refs = frame(spark, d, "refs").withColumn("side", F.lit("b"))
    fresh = refs.filter("cast(substring(file_id, 2) as bigint) % 18 = 4").withColumn("ref_kind", F.lit("Call")).withColumn("side", F.lit("o"))
    return O.by_file(refs, fresh, _parts(spark, d)[3]).select("from_symbol_id", "ref_kind", "file_id", "loc_start", "side")


@register("m5_facts", "SELECT symbol_id, value, loc_start FROM facts WHERE ts < TIMESTAMP '2024-01-20 00:00:00' AND symbol_id NOT IN (SELECT symbol_id FROM facts WHERE ts >= TIMESTAMP '2024-01-29 00:00:00') UNION ALL SELECT symbol_id, value, loc_start FROM facts WHERE ts >= TIMESTAMP '2024-01-29 00:00:00'")
def m5_facts(spark, d):
    facts = frame(spark, d, "facts")
    return O.facts_of_symbols(facts.filter("ts < timestamp '2024-01-20 00:00:00'"), facts.filter("ts >= timestamp '2024-01-29 00:00:00'")).select("symbol_id", "value", "loc_start")


@register("m6_endpoints", f"SELECT symbol_id, split_part(value, ' ', 1) AS method, loc_start FROM facts WHERE fact_kind = 'Route' AND ((ts < TIMESTAMP '2024-01-20 00:00:00' AND {_N} % 9 <> 4) OR (ts >= TIMESTAMP '2024-01-20 00:00:00' AND {_N} % 9 = 4))")
def m6_endpoints(spark, d):
    facts = frame(spark, d, "facts")
    new = facts.filter("ts >= timestamp '2024-01-20 00:00:00' and cast(substring(file_id, 2) as bigint) % 9 = 4")
    return S.endpoints(O.by_file(facts.filter("ts < timestamp '2024-01-20 00:00:00'"), new, _parts(spark, d)[3])).select("symbol_id", "method", "loc_start")


_TABLE = "SELECT lower(regexp_replace(split_part(value, '|', 1), '^[^.]*[.]', '')) AS k, count(*) AS n FROM facts WHERE fact_kind = 'DbTable' AND ts {0} GROUP BY lower(split_part(value, '|', 1)), 1"


@register("m7_tables", f"WITH o AS ({_TABLE.format(chr(62) + '= TIMESTAMP ' + chr(39) + '2024-01-28 00:00:00' + chr(39))}), b AS ({_TABLE.format('< TIMESTAMP ' + chr(39) + '2024-01-20 00:00:00' + chr(39))}) SELECT k, n FROM o UNION ALL SELECT k, n FROM b WHERE k NOT IN (SELECT k FROM o)")
def m7_tables(spark, d):
    facts = frame(spark, d, "facts")
    old, new = (S.db_tables(facts.filter(c)) for c in ("ts < timestamp '2024-01-20 00:00:00'", "ts >= timestamp '2024-01-28 00:00:00'"))
    return O.tables(old, new).select(F.lower("table").alias("k"), F.col("n_refs").alias("n"))


@register("m8_hierarchy", f"""WITH f AS (SELECT file_id FROM files WHERE {_N} % 9 = 4), o AS (SELECT type_symbol_id, 'T:New' AS related_symbol_id FROM type_relations WHERE ends_with(type_symbol_id, '4'))
  SELECT type_symbol_id, related_symbol_id FROM type_relations WHERE type_symbol_id NOT IN (SELECT symbol_id FROM symbols SEMI JOIN f USING (file_id)) AND NOT starts_with(type_symbol_id, 'M:Shop.Customers.C7') AND type_symbol_id NOT IN (SELECT type_symbol_id FROM o) UNION ALL SELECT * FROM o""")
def m8_hierarchy(spark, d):
    symbols, _, gone, files = _parts(spark, d)
    relations = frame(spark, d, "type_relations")
    new = relations.filter("endswith(type_symbol_id, '4')").withColumn("related_symbol_id", F.lit("T:New"))
    return H.derived_merged(relations, new, files, symbols, gone).select("type_symbol_id", "related_symbol_id")


@register("m10_overlay_content", f"SELECT path, sha256(CASE WHEN {_N} % 4 = 0 THEN 'virtual' WHEN {_N} % 6 = 0 THEN 'changed' ELSE content END) AS hash FROM files")
def m10_overlay_content(spark, d):
    files = frame(spark, d, "files").withColumn("n", F.substring("file_id", 2, 20).cast("long"))
    over = files.filter("n % 6 = 0").select(F.upper("path").alias("path"), F.lit("changed").alias("content"))
    virtual = files.filter("n % 4 = 0").select("path", F.lit("virtual").alias("content"))
    return P.overlay_content(files, over, virtual).select("path", F.sha2("content", 256).alias("hash"))


@register("m14_delta", f"WITH f AS (SELECT file_id FROM files WHERE {_N} % 9 = 4), fresh AS (SELECT symbol_id FROM symbols WHERE {_N} % 18 = 4) SELECT symbol_id AS key, 'Tombstone' AS op, 2 AS op_ord FROM symbols SEMI JOIN f USING (file_id) WHERE symbol_id NOT IN (SELECT symbol_id FROM fresh) UNION ALL SELECT symbol_id, 'Symbol', 4 FROM fresh")
def m14_delta(spark, d):
    symbols, fresh, _, files = _parts(spark, d)
    return O.compute_delta(symbols, fresh, files, 7).select("key", "op", "op_ord")


@register("r2_stream_fold", f"WITH {_LAST} SELECT workspace_id, key, payload FROM last WHERE op <> 'Tombstone'")
def r2_stream_fold(spark, d):
    """The log as a stream of several files, folded batch by batch; equal to folding it at once."""
    log = durable(frame(spark, d, "log"))
    home = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    log.repartitionByRange(3, "revision").write.parquet(f"{home}/log")
    query = feed.start(feed.read_log(spark, f"{home}/log", files_per_trigger=1), f"{home}/state", f"{home}/progress")
    query.awaitTermination()
    return feed.snapshot(spark, f"{home}/state").select("workspace_id", "key", "payload")


@register("r3_compacted_fold", f"WITH {_LAST} SELECT workspace_id, key, payload FROM last WHERE op <> 'Tombstone'")
def r3_compacted_fold(spark, d):
    """The log as two feeds of one state, a part of one of them sent again, folded into parts in between."""
    log = durable(frame(spark, d, "log"))
    state = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    late = F.xxhash64("key", "revision") % 2 == 0
    for name, batch in (("one", log.filter(late)), ("two", log.filter(~late)), ("one", log.filter(late))):
        feed.merge_into(spark, state, batch, 0, name)
        feed.compact(spark, state)
    return feed.snapshot(spark, state).select("workspace_id", "key", "payload")


@register("s1_shared_parts", f"""WITH f AS (SELECT *, {_N} AS n FROM files), s AS (SELECT * REPLACE (CASE WHEN {_N} % 9 = 4 THEN signature || ' v2' ELSE signature END AS signature) FROM symbols WHERE {_N} % 9 <> 5),
  r AS (SELECT * FROM refs WHERE {_N} % 9 <> 5), c AS (SELECT * FROM facts WHERE {_N} % 9 NOT IN (4, 5)), t AS (SELECT * FROM type_relations WHERE type_symbol_id NOT IN (SELECT symbol_id FROM symbols WHERE {_N} % 9 IN (4, 5)))
  SELECT 'files' AS relation, count(*) AS n, count(DISTINCT path) AS keys, max(path) AS last FROM f WHERE n % 9 <> 5 UNION ALL SELECT 'symbols', count(*), count(DISTINCT fqname), max(signature) FROM s
  UNION ALL SELECT 'refs', count(*), count(DISTINCT to_symbol_id), max(from_symbol_id) FROM r UNION ALL SELECT 'facts', count(*), count(DISTINCT value), max(symbol_id) FROM c UNION ALL SELECT 'type_relations', count(*), count(DISTINCT related_symbol_id), max(type_symbol_id) FROM t""")
def s1_shared_parts(spark, d):
    """A snapshot of everything, and one derived from it: every ninth file is read again, without facts and type
    relations and with other signatures, and every ninth other one is removed."""
    root, own = f"{shared_folder(spark)}/parts-{uuid.uuid4().hex}", index(spark, d)
    parts.publish(own, root, "repo", "sln", "a" * 40, parts=16)
    n = F.substring("file_id", 2, 20).cast("long")
    again = lambda df: df.filter(n % 9 == 4)
    fresh = store.Index(again(own.files), again(own.symbols).withColumn("signature", F.concat("signature", F.lit(" v2"))), again(own.refs), own.facts.limit(0), own.type_relations.limit(0))
    parts.derive(spark, root, ("repo", "sln", "a" * 40), ("repo", "sln", "b" * 40), fresh, own.files.filter(n % 9 == 5).select("file_id"))
    back, out = parts.read(spark, root, "repo", "sln", "b" * 40), None
    for name, (key, last) in {"files": ("path", "path"), "symbols": ("fqname", "signature"), "refs": ("to_symbol_id", "from_symbol_id"), "facts": ("value", "symbol_id"), "type_relations": ("related_symbol_id", "type_symbol_id")}.items():
        told = getattr(back, name).agg(F.lit(name).alias("relation"), F.count("*").alias("n"), F.count_distinct(key).alias("keys"), F.max(last).alias("last"))
        out = told if out is None else out.unionByName(told)
    return out


def _refreshed(spark, d, level="SyntaxOnly", seed=None):
    """Every ninth file is read again, half of them without symbols, references and facts; what it holds is new:
    its references instantiate and have no target yet, its facts are of low confidence."""
    own = index(spark, d)
    symbols, fresh, _, files = _parts(spark, d)
    half = F.substring("file_id", 2, 20).cast("long") % 18 == 4
    refs = own.refs.filter(half).withColumns({"ref_kind": F.lit("Instantiate"), "to_symbol_id": F.lit(""), "resolution_state": F.lit("Unresolved")})
    facts = own.facts.filter(half).withColumn("confidence", F.lit("Low"))
    made = store.Index(own.files.join(files, "file_id", "left_semi"), own.symbols.filter(half), refs, facts, own.type_relations.limit(0))
    return own, W.refresh(own, W.empty(own), made, seed=seed, level=level)


_LOST = f"lost AS (SELECT symbol_id FROM symbols WHERE {_N} % 18 = 13)"


@register("m19_resolved_refs", f"""WITH {_LOST} SELECT from_symbol_id, to_symbol_id, 'Instantiate' AS ref_kind, file_id, loc_start, 'Resolved' AS resolution_state FROM refs WHERE {_N} % 18 = 4""")
def m19_resolved_refs(spark, d):
    """References that were read again without targets are bound to the baseline's symbols by name."""
    _, done = _refreshed(spark, d, level="Full")
    return done.refs.select("from_symbol_id", "to_symbol_id", "ref_kind", "file_id", "loc_start", "resolution_state")


@register("m11_merged_refs", f"""WITH {_LOST} SELECT from_symbol_id, to_symbol_id, ref_kind, file_id, loc_start FROM refs WHERE {_N} % 9 <> 4 AND from_symbol_id NOT IN (FROM lost) AND to_symbol_id NOT IN (FROM lost)
  UNION ALL SELECT from_symbol_id, to_symbol_id, 'Instantiate', file_id, loc_start FROM refs WHERE {_N} % 18 = 4 AND from_symbol_id NOT IN (FROM lost) AND to_symbol_id NOT IN (FROM lost)""")
def m11_merged_refs(spark, d):
    """The references in view after a whole refresh: none from or to symbols that were lost."""
    own, done = _refreshed(spark, d, level="Full")
    return W.merged(own, done).refs.select("from_symbol_id", "to_symbol_id", "ref_kind", "file_id", "loc_start")


@register("m11_merged_facts", f"""WITH {_LOST}, fresh AS (SELECT * FROM facts WHERE {_N} % 18 = 4), said AS (
  SELECT symbol_id, fact_kind, value, loc_start, confidence FROM facts WHERE {_N} % 9 <> 4 AND symbol_id NOT IN (SELECT symbol_id FROM fresh) UNION ALL SELECT symbol_id, fact_kind, value, loc_start, 'Low' FROM fresh)
  SELECT * FROM said WHERE symbol_id NOT IN (FROM lost)""")
def m11_merged_facts(spark, d):
    """The facts in view after a whole refresh."""
    own, done = _refreshed(spark, d)
    return W.merged(own, done).facts.select("symbol_id", "fact_kind", "value", "loc_start", "confidence")


@register("a10_fact_count", f"SELECT count(*) AS n FROM facts WHERE {_N} % 18 = 4")
def a10_fact_count(spark, d):
    return spark.range(1).select(F.lit(W.fact_count(_refreshed(spark, d)[1])).cast("long").alias("n"))


@register("m16_seeded_refresh", f"""SELECT symbol_id || '.Seed' AS symbol_id FROM symbols WHERE {_N} % 18 = 4""")
def m16_seeded_refresh(spark, d):
    """A workspace that starts from another's view: what that one had added to the files read again, and this one
    does not find there, is deleted; what it had deleted already is not deleted again."""
    own, other = _refreshed(spark, d)
    more = other.symbols.withColumns({"symbol_id": F.concat("symbol_id", F.lit(".Seed")), "stable_id": F.concat("stable_id", F.lit(".seed"))})
    seed = W.Overlay(other.files, other.symbols.unionByName(more), other.refs, other.facts, other.type_relations, other.deleted)
    return _refreshed(spark, d, seed=seed)[1].deleted.select("symbol_id").distinct()


@register("s7_contents", "SELECT path, sha256(content) AS hash FROM files WHERE content IS NOT NULL")
def s7_contents(spark, d):
    return P.contents(frame(spark, d, "files")).select("path", F.sha2("content", 256).alias("hash"))
