"""The registered queries of the corpus operators, with DuckDB SQL where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgrid.llm import bytepairs, embeddings, interactions, katz, licenses, mixing, periodic, pieces, pii, quality, sharding, simhash, toxicity
from symgrid.llm.common import spread_table, table, words


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard(table(spark, sf_dir, "documents"), n_shards=24)
    text = F.coalesce("record.text", F.lit(""))
    return sharded.select(
        "record.doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scores(spread_table(spark, sf_dir, "documents", "doc_id", "text"))


#: A public SentencePiece model; a parameter of op6 and of the pipeline.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spread_table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(spread_table(spark, sf_dir, "documents", "doc_id", "source", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_pieces(spark: SparkSession, sf_dir: str, model: str = PIECE_MODEL) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents", "doc_id", "text")
    done = pieces.encode(docs, pieces.load(model), check="round_trip")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(spread_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(spread_table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), key=["doc_id"])


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def _looped(docs: DataFrame) -> DataFrame:
    """Every tenth document, by the checksum of its doc_id, with a part of its words repeated to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size("w").cast("long")
    a = g % F.greatest(n, F.lit(1))
    own = docs.withColumn("w", F.when(h % 10 == 0, words(F.col("text")))).withColumn("a", a.cast("int")).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    block = F.slice("w", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil((F.size("w") - F.col("a")) / F.col("p")).cast("int"))), 1, F.size("w") - F.col("a"))
    looped = F.array_join(F.concat(F.slice("w", 1, F.col("a")), tail), " ")
    return own.select("doc_id", F.coalesce(F.when(F.size("w") > 0, looped).otherwise(F.col("text")), F.lit("")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find(_looped(spread_table(spark, sf_dir, "documents", "doc_id", "text")))
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda top, r: F.when(r["length"] * top["period"] > top["length"] * r["period"], r).otherwise(top))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_byte_pairs(spark: SparkSession, sf_dir: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    import public_tokenizers

    own = bytepairs.load(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
    docs = spread_table(spark, sf_dir, "documents", "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    done = bytepairs.encode(docs, own, to=None, packed="ids", decoded="decoded")
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(spread_table(spark, sf_dir, "documents", "doc_id", "lang", "text"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_licenses": op2_licenses,
    "op3_quality": op3_quality,
    "op4_toxicity": op4_toxicity,
    "op5_katz": op5_katz,
    "op6_pieces": op6_pieces,
    "op7_simhash": op7_simhash,
    "op8_pii": op8_pii,
    "op9_mixing": op9_mixing,
    "op10_embeddings": op10_embeddings,
    "op11_runs": op11_runs,
    "op12_byte_pairs": op12_byte_pairs,
    "op13_interactions": op13_interactions,
}

_OP3 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row, source AS host, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
lines AS (
  SELECT doc_id, row, host, trim(unnest(string_split(regexp_replace(lower(text), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10))), ' ') AS line
  FROM d),
frequent AS (
  SELECT host, line FROM lines WHERE line <> '' GROUP BY host, line HAVING count(DISTINCT row) > 100),
removed AS (
  SELECT doc_id, sum(len(string_split(line, ' '))) AS n
  FROM lines JOIN frequent USING (host, line) GROUP BY doc_id),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
twice AS (SELECT doc_id, x FROM windows GROUP BY doc_id, x HAVING count(*) > 1),
starts AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM windows JOIN twice USING (doc_id, x)),
repeated AS (SELECT doc_id, sum(least(8, i - coalesce(p, i - 8))) AS n FROM starts GROUP BY doc_id),
f AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
         - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
         CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words, CAST(removed.n AS BIGINT) AS removed
  FROM d LEFT JOIN repeated USING (doc_id) LEFT JOIN removed USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
       AND (removed IS NULL OR (n_words - removed >= 20 AND n_words - removed >= 0.5 * n_words)) AS kept,
       n_words - coalesce(removed, 0) AS words_left
FROM f
"""

_TEMPLATES = ", ".join(f"({i}, '{name}', '{wording.replace(chr(39), chr(39) * 2)}')" for i, (name, wording) in enumerate(licenses.TEMPLATES))
_WORDS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_OP2 = f"""
WITH t AS (
  SELECT template, license, {_WORDS} AS w FROM (VALUES {_TEMPLATES}) v(template, license, text)),
tw AS (SELECT DISTINCT template, license, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM t)),
size AS (SELECT template, count(*) AS s, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS stride FROM tw GROUP BY template),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, i - 1 AS p, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM d)),
hit AS (
  SELECT doc_id, template, license, s, x, unnest([p // stride, p // stride - 1]) AS k
  FROM dw JOIN tw USING (x) JOIN size USING (template)),
share AS (
  SELECT doc_id, template, license, k, count(DISTINCT x) / any_value(s) AS c
  FROM hit WHERE k >= 0 GROUP BY doc_id, template, license, k)
SELECT doc_id, CAST(template AS INTEGER) AS template, license, max(c) AS containment
FROM share WHERE c >= 0.8 GROUP BY doc_id, template, license
"""

_OP10 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS n, vec_id AS m FROM embeddings UNION SELECT n, b FROM r JOIN l ON a = m),
c AS (SELECT n AS vec_id, min(m) AS component_id FROM r GROUP BY n)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""

_OP13 = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
known AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN known USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY part, fails),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letter a JOIN letter b ON b.f <> a.f JOIN letter c ON c.f NOT IN (a.f, b.f) JOIN letter d ON d.f NOT IN (a.f, b.f, c.f) JOIN letter e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS f, substr(filter_order, 1, step - 1) AS before FROM o, unnest(range(1, 6)) r(step)),
r AS (
  SELECT part, filter_order, step, f,
         CAST(coalesce(sum(n) FILTER (NOT contains(fails, f) AND translate(fails, before, '') = fails), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (contains(fails, f) AND translate(fails, before, '') = fails), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (contains(fails, f) AND translate(fails, before, '') <> fails), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (fails = f), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (contains(fails, f) AND translate(fails, before, '') = fails), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (contains(fails, f) AND translate(fails, before, '') = fails), 0) AS BIGINT) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""

ORACLE_SQL: dict[str, str] = {"op10_embeddings": _OP10, "op13_interactions": _OP13, "op2_licenses": _OP2, "op3_quality": _OP3}
