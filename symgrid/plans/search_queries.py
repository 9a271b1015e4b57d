"""Search, spans, references and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from symgrid.functions import text as X
from symgrid.operators import refs as R
from symgrid.operators import search as S
from symgrid.operators import spans as P
from symgrid.plans.bridge import frame
from symgrid.plans.queries import register
from symgrid.session import durable

# Camel parts without look-around: marks are put between, digit boundaries twice as matches overlap.
_CAMEL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g')"""
_BARE = r"regexp_replace(regexp_replace({0}, '^.:', ''), '[(`].*$', '')"
_FULL = _BARE.format("fqname")
_DISPLAY = f"list_extract(string_split({_FULL}, '.'), -1)"
_SAID = "list_filter(string_split_regex(coalesce(signature, '') || ' ' || coalesce(documentation, ''), '[^a-zA-Z0-9]+'), lambda x: length(x) > 1)"
_TOKENS = f"""
parts AS (SELECT symbol_id, {_DISPLAY} AS display, lower({_FULL}) AS full_name, namespace, {_SAID} AS said FROM symbols),
postings AS (
  SELECT symbol_id, lower(display) AS token FROM parts
  UNION SELECT symbol_id, full_name FROM parts
  UNION SELECT symbol_id, lower(t) FROM (SELECT symbol_id, unnest(string_split({_CAMEL.format("display")}, ' ')) AS t FROM parts) x WHERE length(t) > 1
  UNION SELECT symbol_id, lower(t) FROM (SELECT symbol_id, unnest(string_split(namespace, '.')) AS t FROM parts) x WHERE length(t) > 1
  UNION SELECT symbol_id, lower(t) FROM (SELECT symbol_id, unnest(said) AS t FROM parts) x
  UNION SELECT symbol_id, lower(t) FROM (SELECT symbol_id, unnest(string_split({_CAMEL.format("w")}, ' ')) AS t FROM (SELECT symbol_id, unnest(said) AS w FROM parts) y) x WHERE length(t) > 1)"""


def _index(spark, d):
    symbols = frame(spark, d, "symbols").join(frame(spark, d, "files").select("file_id", "path"), "file_id", "left")
    return symbols, S.postings(symbols)


@register("s9_postings", f"WITH {_TOKENS} SELECT token, symbol_id FROM postings WHERE token <> ''")
def s9_postings(spark, d):
    return _index(spark, d)[1]


def _hits(asked: str, where: str, limit: int, query: str) -> str:
    terms = asked.split()
    matched = " INTERSECT ".join(f"SELECT DISTINCT symbol_id FROM postings WHERE starts_with(token, '{t}')" for t in terms)
    covered = " + ".join(f"CASE WHEN starts_with(lower(display), '{t}') OR len(list_filter(string_split(lower({_CAMEL.format('display')}), ' '), lambda x: length(x) > 1 AND starts_with(x, '{t}'))) > 0 THEN 1 ELSE 0 END" for t in terms)
    return f"""WITH {_TOKENS},
    hit AS ({matched}),
    scored AS (
      SELECT s.symbol_id, s.kind, {_DISPLAY} AS display, lower({_FULL}) AS f, path, s.namespace, s.project_name
      FROM symbols s JOIN hit USING (symbol_id) LEFT JOIN files USING (file_id))
    SELECT symbol_id, kind,
           CAST(CASE WHEN lower(display) = '{query}' THEN 100 WHEN f = '{query}' OR ends_with(f, '.{query}') THEN 80 WHEN starts_with(lower(display), '{query}') THEN 40 ELSE 10 END
                + floor(20.0 * ({covered}) / {len(terms)}) + CASE WHEN length(display) < 30 THEN 5 ELSE 0 END AS INTEGER) AS score
    FROM scored WHERE {where} ORDER BY score DESC, symbol_id LIMIT {limit}"""


@register("q1_search", _hits("supplier order", "kind IN ('Method', 'Class')", 50, "supplier order"))
def q1_search(spark, d):
    return S.search(*_index(spark, d), "Supplier Order*", 50, kinds=["Method", "Class"]).select("symbol_id", "kind", "score")


@register("q1_search_filtered", _hits("ring", "starts_with(lower(namespace), 'parts.brand1') AND starts_with(lower(path), 'src') AND lower(project_name) = 'brand11'", 100, "ring"))
def q1_search_filtered(spark, d):
    return S.search(*_index(spark, d), "ring", 100, namespace="parts.Brand1", path="SRC", project="BRAND11").select("symbol_id", "kind", "score")


@register("q1_search_letter", f"""WITH {_TOKENS},
  few AS (SELECT DISTINCT token FROM postings WHERE starts_with(token, 'b') ORDER BY token LIMIT 50)
  SELECT DISTINCT symbol_id FROM postings JOIN few USING (token)""")
def q1_search_letter(spark, d):
    return S.matching(_index(spark, d)[1], "b")


@register("q2_browse", f"SELECT symbol_id, fqname, kind FROM symbols WHERE kind IN ('Interface', 'Class', 'Property') AND is_decompiled = 0 ORDER BY fqname, symbol_id LIMIT 60")
def q2_browse(spark, d):
    return S.search(*_index(spark, d), "", 60, kinds=["Interface", "Class", "Property"], decompiled=False).select("symbol_id", "fqname", "kind")


@register("f12_truncated", "SELECT symbol_id, truncated FROM (SELECT symbol_id, fqname, count(*) OVER () > 40 AS truncated FROM symbols WHERE kind = 'Method') x ORDER BY fqname, symbol_id LIMIT 40")
def f12_truncated(spark, d):
    return S.truncated(frame(spark, d, "symbols").filter("kind = 'Method'").select("symbol_id", "fqname"), [F.col("fqname"), F.col("symbol_id")], 40).select("symbol_id", "truncated")


_FACTS_OF = "SELECT symbol_id, string_agg(fact_kind || '=' || value, ';' ORDER BY fact_kind, value) AS facts FROM facts GROUP BY symbol_id"


def _flat(cards):
    said = F.array_join(F.transform("facts", lambda f: F.concat_ws("=", f["fact_kind"], f["value"])), ";")
    return cards.select("symbol_id", "stable_id", "fqname", "kind", "visibility", "confidence", said.alias("facts"))


@register("q3_cards", f"WITH f AS ({_FACTS_OF}) SELECT symbol_id, stable_id, fqname, kind, visibility, confidence, f.facts FROM symbols LEFT JOIN f USING (symbol_id)")
def q3_cards(spark, d):
    symbols = frame(spark, d, "symbols")
    return _flat(S.cards(symbols, frame(spark, d, "facts"), symbols))


@register("q4_by_stable_id", f"WITH f AS ({_FACTS_OF}) SELECT symbol_id, stable_id, fqname, kind, visibility, confidence, f.facts FROM symbols LEFT JOIN f USING (symbol_id) WHERE stable_id IS NOT NULL")
def q4_by_stable_id(spark, d):
    symbols = frame(spark, d, "symbols")
    return _flat(S.by_stable_id(symbols, frame(spark, d, "facts"), symbols.filter("stable_id is not null")))


@register("q31_resolve", f"""WITH asked AS (SELECT DISTINCT to_name AS name FROM refs UNION SELECT DISTINCT p_name FROM part UNION SELECT r_name FROM region UNION SELECT DISTINCT 'parts.' || lower(replace(p_brand, '#', '')) || '.' || replace(p_name, ' ', '') || CAST(p_partkey AS VARCHAR) FROM part),
  keyed AS (SELECT symbol_id, lower({_DISPLAY}) AS k FROM symbols UNION SELECT symbol_id, lower({_FULL}) FROM symbols),
  hit AS (SELECT DISTINCT name, symbol_id FROM asked JOIN keyed ON lower(name) = k)
  SELECT name, CASE WHEN count(symbol_id) = 0 THEN 'NOT_FOUND' WHEN count(symbol_id) = 1 THEN 'ok' ELSE 'AMBIGUOUS' END AS outcome, count(symbol_id) AS n, coalesce(min(symbol_id), '') AS first
  FROM asked LEFT JOIN hit USING (name) GROUP BY name""")
def q31_resolve(spark, d):
    part = frame(spark, d, "part")
    names = frame(spark, d, "refs").select(F.col("to_name").alias("name")).union(part.select("p_name")).union(frame(spark, d, "region").select("r_name"))
    names = names.union(part.select(F.concat(F.lit("parts."), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("."), F.replace("p_name", F.lit(" "), F.lit("")), F.col("p_partkey").cast("string"))))
    return S.resolve_names(frame(spark, d, "symbols"), names).select("name", "outcome", "n", F.coalesce(F.get("candidates", F.lit(0)), F.lit("")).alias("first"))


@register("q31_resolve_search", f"""WITH {_TOKENS}, hit AS (SELECT DISTINCT symbol_id FROM postings WHERE starts_with(token, 'nation')),
  ranked AS (SELECT symbol_id, CASE WHEN lower({_DISPLAY}) = 'nation' THEN 100 WHEN ends_with(lower({_FULL}), '.nation') THEN 80 WHEN starts_with(lower({_DISPLAY}), 'nation') THEN 40 ELSE 10 END + CASE WHEN starts_with(lower({_DISPLAY}), 'nation') THEN 20 ELSE 0 END + CASE WHEN length({_DISPLAY}) < 30 THEN 5 ELSE 0 END AS score FROM symbols JOIN hit USING (symbol_id) ORDER BY score DESC, symbol_id LIMIT 21)
  SELECT CASE WHEN count(*) = 0 THEN 'NOT_FOUND' WHEN count(*) = 1 THEN 'ok' ELSE 'AMBIGUOUS' END AS outcome, count(*) AS n, array_to_string(list(symbol_id ORDER BY score DESC, symbol_id)[1:5], ',') AS candidates FROM ranked
  UNION ALL SELECT 'ok', count(*), min(symbol_id) FROM symbols WHERE contains(lower(fqname), 'europ') UNION ALL SELECT 'ok', 1, 'T:Any.Id'""")
def q31_resolve_search(spark, d):
    """The start of many names and of one, through ranked search, and an explicit id."""
    symbols, index = _index(spark, d)
    many, one, told = S.resolve(symbols, index, "nation"), S.resolve(symbols, index, "europ"), S.resolve(symbols, index, "nation", explicit="T:Any.Id")
    return many.unionByName(one).unionByName(told).withColumn("candidates", F.array_join("candidates", ","))


@register("q1_search_published", _hits("supplier order", "kind IN ('Method', 'Class')", 50, "supplier order"))
def q1_search_published(spark, d):
    """The same search, from the postings of a snapshot published once per session, which its token prefixes prune."""
    from symgrid.plans.bridge import index as relations
    from symgrid.session import shared_folder
    from symgrid.sources import store

    key = (spark.sparkContext.applicationId, d)
    if key not in _PUBLISHED:
        own = relations(spark, d)
        root = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        typed = store.Index(own.files, own.symbols.withColumn("name_tokens", F.lit(None).cast("array<string>")), own.refs.limit(0), own.facts.limit(0), own.type_relations.limit(0))
        store.publish(typed, root, "repo", "sln", "a" * 40)
        _PUBLISHED[key] = store.at(spark, root, "repo", "sln", "a" * 40)
    back = _PUBLISHED[key]
    symbols = back.table("symbols").join(back.table("files").select("file_id", "path"), "file_id", "left")
    return S.search(symbols, back.table("postings"), "Supplier Order*", 50, kinds=["Method", "Class"]).select("symbol_id", "kind", "score")


_PUBLISHED: dict = {}


@register("q32_did_you_mean", """WITH asked AS (SELECT DISTINCT substr(n_name, 1, 7) || 'x' AS name FROM nation UNION SELECT lower(r_name) FROM region),
  known AS (SELECT n_name AS suggestion FROM nation UNION SELECT r_name FROM region),
  near AS (SELECT name, suggestion, CAST(levenshtein(name, suggestion) AS INTEGER) AS distance FROM asked, known WHERE levenshtein(name, suggestion) <= 3)
  SELECT name, suggestion, distance FROM near QUALIFY row_number() OVER (PARTITION BY name ORDER BY distance, suggestion) = 1""")
def q32_did_you_mean(spark, d):
    n, r = frame(spark, d, "nation"), frame(spark, d, "region")
    asked = n.select(F.concat(F.substring("n_name", 1, 7), F.lit("x")).alias("name")).union(r.select(F.lower("r_name"))).distinct()
    return S.did_you_mean(asked, n.select(F.col("n_name").alias("name")).union(r.select("r_name")))


@register("q33_candidates", _hits("nation", "true", 3, "nation"))
def q33_candidates(spark, d):
    return S.search(*_index(spark, d), "nation", 3).select("symbol_id", "kind", "score")


_SPAN = """lines AS (SELECT path, file_id, string_split(content, chr(10)) AS l FROM files),
  s AS (SELECT {key}, path, l, len(l) AS total, greatest(1, least({first}, len(l)) - {ctx}) AS start, least(len(l), greatest({last}, {first}) + {ctx}) AS full_stop FROM {src}),
  c AS (SELECT *, least(full_stop, start + {max} - 1) AS stop FROM s)
  SELECT {key}, path, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, substr(array_to_string(l[start:stop], chr(10)), 1, {chars}) AS code,
         stop < full_stop OR length(array_to_string(l[start:stop], chr(10))) > {chars} AS clamped FROM c"""


@register("q5_definitions", "WITH " + _SPAN.format(key="symbol_id", first="span_start", last="span_end", ctx=2, max=120, chars=40000, src="symbols JOIN lines USING (file_id) WHERE kind <> 'Property'"))
def q5_definitions(spark, d):
    return P.definitions(frame(spark, d, "symbols").filter("kind <> 'Property'"), frame(spark, d, "files")).select("symbol_id", "path", "start", "stop", "code", "clamped")


@register("q7_spans", "WITH " + _SPAN.format(key="first", first="first", last="first + 30", ctx=3, max=5, chars=200, src="(SELECT *, CAST(substr(file_id, 2) AS BIGINT) % 9 + 1 AS first FROM lines) z"))
def q7_spans(spark, d):
    files = frame(spark, d, "files")
    asked = files.select("path", (F.substring("file_id", 2, 20).cast("long") % 9 + 1).alias("first")).withColumn("last", F.col("first") + 30)
    return P.read_spans(asked, files, 3, 5, 200).select("first", "path", F.col("start").cast("int"), F.col("stop").cast("int"), "code", "clamped")


@register("q6_context", """WITH RECURSIVE lines AS (SELECT path, file_id, string_split(content, chr(10)) AS l FROM files),
  e AS (SELECT DISTINCT from_symbol_id AS a, to_symbol_id AS b FROM calls WHERE ref_kind = 'Call'),
  reach AS (SELECT symbol_id AS root, symbol_id AS node, 0 AS depth FROM symbols WHERE kind = 'Property' UNION SELECT root, b, depth + 1 FROM reach JOIN e ON a = node WHERE depth < 2),
  best AS (SELECT root, node, min(depth) AS depth FROM reach GROUP BY root, node),
  few AS (SELECT * FROM best WHERE depth = 0 UNION ALL SELECT * FROM (SELECT * FROM best WHERE depth > 0 QUALIFY row_number() OVER (PARTITION BY root ORDER BY depth, node) <= 10) x)
  SELECT root, CASE WHEN depth = 0 THEN 'self' ELSE 'callee' END AS role, CAST(depth AS INTEGER) AS depth, symbol_id, fqname, signature, path, array_to_string(l[least(span_start, len(l)):least(span_end, len(l))], chr(10)) AS code
  FROM few JOIN symbols ON node = symbol_id JOIN lines USING (file_id)""")
def q6_context(spark, d):
    symbols = frame(spark, d, "symbols")
    found = P.contexts(symbols.filter("kind = 'Property'"), frame(spark, d, "calls"), symbols, frame(spark, d, "files"), callee_depth=2)
    return found.select("root", "role", "depth", "symbol_id", "fqname", "signature", "path", "code")


@register("q8_search_text", """SELECT path, CAST(line AS INTEGER) AS line, CASE WHEN length(trim(t)) > 200 THEN substr(trim(t), 1, 197) || '...' ELSE trim(t) END AS excerpt
  FROM (SELECT path, unnest(string_split(content, chr(10))) AS t, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM files) x
  WHERE regexp_matches(t, 'licen[cs]ed? under|License') ORDER BY lower(path), path, line LIMIT 100""")
def q8_search_text(spark, d):
    return P.search_text(frame(spark, d, "files"), "licen[cs]ed? under|License", limit=500)


@register("q8_search_indexed", """SELECT path, CAST(line AS INTEGER) AS line, CASE WHEN length(trim(t)) > 200 THEN substr(trim(t), 1, 197) || '...' ELSE trim(t) END AS excerpt
  FROM (SELECT path, unnest(string_split(content, chr(10))) AS t, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM files) x
  WHERE regexp_matches(t, 'licen[cs]ed? under|License') ORDER BY lower(path), path, line LIMIT 100""")
def q8_search_indexed(spark, d):
    """The same search over the candidates of a trigram index of all texts."""
    from symgrid.operators import trigrams

    files = frame(spark, d, "files")
    return trigrams.search_indexed(files, trigrams.postings(files), "licen[cs]ed? under|License", limit=500)


@register("q8_search_text_glob", """SELECT path, CAST(line AS INTEGER) AS line, CASE WHEN length(trim(t)) > 200 THEN substr(trim(t), 1, 197) || '...' ELSE trim(t) END AS excerpt
  FROM (SELECT path, unnest(string_split(content, chr(10))) AS t, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM files) x
  WHERE regexp_matches(lower(path), '^src[^/]/en/.*[.]txt$') AND starts_with(lower(path), 'src') AND regexp_matches(lower(t), 'th[aeiou]+n') ORDER BY lower(path), path, line LIMIT 50""")
def q8_search_text_glob(spark, d):
    return P.search_text(frame(spark, d, "files"), "th[aeiou]+n", path_prefix="SRC", glob="src?/en/*.txt", ignore_case=True, limit=50)


@register("q8_chat_search", """SELECT CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS path, CAST(line AS INTEGER) AS line
  FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM conversations) x
  WHERE regexp_matches(t, '^[A-E][a-z]+ ') ORDER BY lower(path), path, line LIMIT 100""")
def q8_chat_search(spark, d):
    c = frame(spark, d, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), F.col("text").alias("content"))
    return P.search_text(c, "^[A-E][a-z]+ ").select("path", "line")


_FIND = """SELECT to_symbol_id, from_symbol_id, ref_kind, path, loc_start, loc_end, CAST(ord AS INTEGER) AS ord{extra} FROM (
  SELECT r.*, path, content, row_number() OVER (PARTITION BY to_symbol_id ORDER BY path, loc_start, loc_end, from_symbol_id, ref_kind) AS ord
  FROM refs r JOIN files USING (file_id) WHERE {where}) x WHERE ord <= {limit}"""


@register("q9_find_refs", _FIND.format(where="true", limit=50, extra=", CASE WHEN length(trim(t)) > 200 THEN substr(trim(t), 1, 197) || '...' ELSE trim(t) END AS excerpt").replace(") x WHERE", ") x, LATERAL (SELECT string_split(content, chr(10))[loc_start] AS t) y WHERE"))
def q9_find_refs(spark, d):
    anchors = frame(spark, d, "symbols").filter("startswith(symbol_id, 'M:Shop.Suppliers')")
    return R.find(anchors, frame(spark, d, "refs"), frame(spark, d, "files")).select("to_symbol_id", "from_symbol_id", "ref_kind", "path", "loc_start", "loc_end", "ord", "excerpt")


@register("q9_find_refs_filtered", _FIND.format(where="ref_kind = 'Write' AND resolution_state = 'Unresolved'", limit=500, extra=""))
def q9_find_refs_filtered(spark, d):
    anchors = frame(spark, d, "symbols").filter("startswith(symbol_id, 'M:Shop.Suppliers')")
    return R.find(anchors, frame(spark, d, "refs"), frame(spark, d, "files"), "Write", "Unresolved", 500, False).select("to_symbol_id", "from_symbol_id", "ref_kind", "path", "loc_start", "loc_end", "ord")


@register("g11_adjacency", "SELECT from_symbol_id, to_symbol_id, ref_kind, count(*) AS n FROM refs GROUP BY ALL")
def g11_adjacency(spark, d):
    anchors = frame(spark, d, "symbols").filter("kind = 'Method'")
    return R.outgoing(anchors, frame(spark, d, "refs")).groupBy("from_symbol_id", "to_symbol_id", "ref_kind").agg(F.count("*").alias("n"))


_OPEN = """(SELECT *, CASE loc_end % 5 WHEN 0 THEN 'this' WHEN 1 THEN 'SUPPLIERS' WHEN 2 THEN 'Nowhere' WHEN 3 THEN 'shop.vendors' ELSE 'SRC1/' END AS hint FROM refs)"""


@register("j15_resolve_refs", f"""WITH known AS (SELECT symbol_id, fqname, lower(path) AS p FROM symbols LEFT JOIN files USING (file_id)
    UNION ALL SELECT 'M:V' || CAST(s_suppkey AS VARCHAR), 'M:Shop.Vendors.Supplier' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || '()', (SELECT lower(path) FROM files WHERE file_id = 'd' || CAST(s_suppkey % 10 AS VARCHAR)) FROM supplier WHERE s_suppkey % 3 = 0),
  named AS (SELECT *, regexp_extract(split_part(fqname, '(', 1), '([^.:]*)$', 1) AS m FROM known),
  asked AS (SELECT DISTINCT to_name, hint FROM {_OPEN} r WHERE resolution_state = 'Unresolved'),
  hit AS (SELECT to_name, hint, symbol_id, hint NOT IN ('this', 'base') AND (contains(lower(fqname), lower(hint)) OR contains(p, lower(hint))) AS fit FROM asked JOIN named ON to_name = m),
  one AS (SELECT to_name, hint, CASE WHEN count(DISTINCT symbol_id) = 1 THEN min(symbol_id) WHEN count(DISTINCT symbol_id) FILTER (WHERE fit) = 1 THEN min(symbol_id) FILTER (WHERE fit) END AS bound FROM hit GROUP BY ALL)
  SELECT CASE WHEN resolution_state = 'Unresolved' AND bound IS NOT NULL THEN bound ELSE to_symbol_id END AS to_symbol_id,
         CASE WHEN resolution_state = 'Unresolved' AND bound IS NOT NULL THEN 'Resolved' ELSE resolution_state END AS resolution_state, r.hint, count(*) AS n
  FROM {_OPEN} r LEFT JOIN one ON r.to_name = one.to_name AND r.hint = one.hint GROUP BY ALL""")
def j15_resolve_refs(spark, d):
    """Every third supplier's name is borne by a vendor too; hints that miss, exclude or name a container or path.
    References alike in all that is asked of them are counted first, and bound as one."""
    k = F.col("loc_end") % 5
    hint = F.when(k == 0, "this").when(k == 1, "SUPPLIERS").when(k == 2, "Nowhere").when(k == 3, "shop.vendors").otherwise("SRC1/")
    refs = frame(spark, d, "refs").withColumn("to_container_hint", hint)
    key = F.col("s_suppkey").cast("string")
    vendors = frame(spark, d, "supplier").filter("s_suppkey % 3 = 0").select(F.concat(F.lit("M:V"), key).alias("symbol_id"), F.concat(F.lit("M:Shop.Vendors.Supplier"), F.lpad(key, 9, "0"), F.lit("()")).alias("fqname"), F.concat(F.lit("d"), (F.col("s_suppkey") % 10).cast("string")).alias("file_id"))
    known = frame(spark, d, "symbols").select("symbol_id", "fqname", "file_id").unionByName(vendors)
    alike = durable(refs.groupBy("to_symbol_id", "resolution_state", "to_name", "to_container_hint").agg(F.count("*").alias("n")))
    return R.resolve(alike, known, frame(spark, d, "files")).groupBy("to_symbol_id", "resolution_state", F.col("to_container_hint").alias("hint")).agg(F.sum("n").alias("n"))


@register("x_names", f"""SELECT symbol_id, {_DISPLAY} AS display, array_to_string(list_slice(string_split({_FULL}, '.'), -2, -1), '.') AS short,
  CASE WHEN contains({_FULL}, '.') THEN regexp_replace({_FULL}, '[.][^.]*$', '') ELSE '' END AS parent,
  'sym_' || substr(sha256(kind || chr(0) || fqname || chr(0) || project_name), 1, 16) AS fallback_id,
  lower({_CAMEL.format(_DISPLAY)}) AS camel, CAST(floor(length(signature) / 4) AS BIGINT) AS tokens FROM symbols""")
def x_names(spark, d):
    f = F.col("fqname")
    return frame(spark, d, "symbols").select(
        "symbol_id", X.display_name(f).alias("display"), X.short_name(f).alias("short"), X.parent_name(f).alias("parent"), X.stable_id(F.col("kind"), f, F.col("project_name")).alias("fallback_id"),
        F.lower(F.array_join(X.camel_parts(X.display_name(f)), " ")).alias("camel"), X.token_estimate(F.col("signature")).alias("tokens"),
    )


@register("x15_sql_tables", r"""SELECT doc_id, name FROM (
  SELECT DISTINCT doc_id, lower(regexp_replace(unnest(regexp_extract_all(regexp_replace(text, '\s+', ' ', 'g'), '(?i)\b(?:FROM|INTO|UPDATE|JOIN) (\[?\w+\]?\.?\[?\w+\]?)', 1)), '[\[\]]', '', 'g')) AS name FROM documents) x
  WHERE name NOT IN ('select','where','set','table','database','view','index','inner','outer','left','right','cross','full','on')
  AND split_part(name, '.', 1) NOT IN ('sys','information_schema','pg_catalog','mysql','performance_schema') AND NOT starts_with(name, 'sqlite_')""")
def x15_sql_tables(spark, d):
    return frame(spark, d, "documents").select("doc_id", F.explode(X.sql_tables(F.col("text"))).alias("name"))


@register("x14_routes", r"""SELECT page_id, href, CASE WHEN page_id % 3 = 0 THEN '/' || ltrim(href, '/') ELSE '/api/' || ltrim(href, '/') END AS route
  FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages) x""")
def x14_routes(spark, d):
    own = frame(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("href"))
    return own.select("page_id", "href", X.combine_route(F.when(F.col("page_id") % 3 != 0, F.lit("api/")), F.col("href")).alias("route"))


@register("x15_paths", """SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE source || '/b' END AS odd FROM documents""")
def x15_paths(spark, d):
    docs = frame(spark, d, "documents")
    messy = F.concat(F.lit("./"), F.col("source"), F.lit("\\x/..//./"), F.col("doc_id").cast("string"))
    odd = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("a/../../"), F.col("source"))).otherwise(F.concat(F.lit("a/.."), F.lit("/"), F.col("source"), F.lit("/b")))
    return docs.select("doc_id", X.canonical_path(messy).alias("path"), X.canonical_path(odd).alias("odd"))


@register("x18_savings", """SELECT ref_kind, greatest(0, count(*) * 750) AS search, greatest(0, sum(loc_end - loc_start) * 10)::BIGINT AS span, greatest(0, count(*) * 1500) AS context,
  greatest(0, count(DISTINCT file_id) * 200 - count(*) * 20) AS text, CAST(CAST(count(*) * 750 / 1000 * 0.003 AS DECIMAL(18, 9)) AS DOUBLE) AS cost FROM refs GROUP BY ref_kind""")
def x18_savings(spark, d):
    own = frame(spark, d, "refs").groupBy("ref_kind").agg(F.count("*").alias("n"), F.sum(F.col("loc_end") - F.col("loc_start")).alias("lines"), F.count_distinct("file_id").alias("f"))
    n = F.col("n")
    return own.select("ref_kind", X.saved_by_search(n).alias("search"), X.saved_by_span(F.col("lines"), F.lit(0)).alias("span"), X.saved_by_context(n).alias("context"), X.saved_by_text(F.col("f"), n).alias("text"), X.cost_avoided(X.saved_by_search(n), X.PRICES["claude_sonnet"]).cast("double").alias("cost"))
