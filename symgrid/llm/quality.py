"""Quality rules: repetition and symbol counts of a text, and lines that many documents of a host
share. Frequent lines are removed, and documents of which too little remains are rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgrid.llm.common import BLANK, WORD, durable, quoted, words

#: A larger table of frequent lines is joined by a shuffle, not broadcast (about 16 bytes a row).
BROADCAST_LINES = 200_000
WINDOW = 8
#: Copies of a text at one host that may meet in a task; texts with more come by broadcast.
COPIES, BROADCAST_TEXTS = 10_000, 20_000


def _lines(text: Column) -> Column:
    """Lines with a word as (hash of the normalised line, its words)."""
    flat = F.regexp_replace(F.lower(text), "[\\x20\\x09\\x0B-\\x0D]+", " ")
    trimmed = F.transform(F.split(flat, "\n"), lambda x: F.trim(x))
    return F.transform(F.filter(trimmed, lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(F.split(x, " ")).alias("n")))


def features(df: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """keep, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)."""
    body = F.coalesce(text, F.lit(""))
    own = df.select(
        *keep,
        F.length(F.regexp_replace(body, BLANK, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.regexp_replace(body, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD)).alias("__lines"),
        F.transform(words(body), lambda w: F.xxhash64(w)).alias("__words"),
    )
    windows = F.when(
        F.size("__words") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size("__words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__words", i, WINDOW))),
    )
    own = own.select("*", windows.alias("__windows"))
    placed = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    own = own.select("*", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), placed).alias("__placed"))
    same = lambda s, k: ((k > 0) & (F.get("__placed", k - 1)["h"] == s["h"])) | (F.coalesce(F.get("__placed", k + 1)["h"] == s["h"], F.lit(False)))
    at = F.sort_array(F.transform(F.filter("__placed", same), lambda s: s["i"]))
    # Starts in order: each covers the words up to the next start, eight at most.
    covered = F.aggregate(
        at,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    return own.select(
        *[c for c in own.columns if not c.startswith("__")],
        F.size("__words").cast("long").alias("n_words"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("__placed").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
    )


def frequent_lines(df: DataFrame, host: str, text: str, max_docs: int) -> DataFrame:
    """host, line: lines in more than max_docs documents (rows) of a host. A document counts a line once,
    so that the numbers of documents add up before the shuffle."""
    own = F.array_distinct(F.transform(_lines(quoted(text)), lambda x: x["line"]))
    lines = df.select(quoted(host).alias("host"), F.explode(own).alias("line"))
    return lines.groupBy("host", "line").agg(F.count("*").alias("docs")).filter(F.col("docs") > max_docs).select("host", "line")


def rules(df: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", max_docs: int = 100, min_words: int = 20, min_left: float = 0.5, max_repeat: int = 30) -> DataFrame:
    """One row per row of df: key, the features, base_failed, words_left, kept.

    base_failed: fewer than min_words words, or over max_repeat percent of them in repeated
    windows. words_left: words outside the lines that more than max_docs documents of the same host
    hold. kept: not base_failed, and either nothing was removed or at least min_words words and
    min_left of all words are left. Every row is a document, copies and repeated rows too, so the lines
    of a text that a host serves more than max_docs times are removed from all its copies. Null texts
    have no words and fail; a null host is a host; equal rows get equal results; an empty table gives
    an empty result; other columns are ignored.
    """
    frequent = durable(frequent_lines(df, host, text, max_docs))
    n = frequent.count()
    lines = df.select(quoted(host).alias("host"), F.xxhash64(quoted(text)).alias("doc"), F.posexplode(_lines(quoted(text))).alias("pos", "x")).select("host", "doc", "pos", "x.line", "x.n")
    f = (F.broadcast(frequent) if n <= BROADCAST_LINES else frequent).select(F.col("host").alias("fhost"), F.col("line").alias("fline"))
    hit = lines.join(f, lines.host.eqNullSafe(f.fhost) & (lines.line == f.fline), "left_semi")
    # Copies hold the same lines at the same places, so these are looked at once for all of them.
    removed = hit.groupBy("host", "doc", "pos").agg(F.max("n").alias("n"), F.count("*").alias("copies"))
    removed = durable(removed.groupBy("host", "doc").agg(F.sum("n").alias("removed"), F.max("copies").alias("copies")))
    own = features(df, quoted(text), [quoted(key).alias("k"), quoted(host).alias("host"), F.xxhash64(quoted(text)).alias("doc")])
    r = removed.select(F.col("host").alias("rhost"), F.col("doc").alias("rdoc"), "removed", "copies")
    most = max(COPIES, -(-(removed.agg(F.sum("copies")).first()[0] or 0) // BROADCAST_TEXTS))
    often = r.filter(F.col("copies") > most).select("rhost", "rdoc", F.col("removed").alias("at_once"))
    known = F.lit(None).cast("long")
    if not often.isEmpty():
        # Their copies add up to the rows, so they are fewer than BROADCAST_TEXTS.
        own = own.join(F.broadcast(often), own.host.eqNullSafe(often.rhost) & (own.doc == often.rdoc), "left").drop("rhost", "rdoc")
        known = F.col("at_once")
    # Rows that need no partner (their text was looked up, or has no words) are dealt out.
    own = own.withColumn("known", known).withColumn("part", F.when(F.col("known").isNotNull() | (F.col("n_words") == 0), F.monotonically_increasing_id() + 1).otherwise(0))
    rare = r.filter(F.col("copies") <= most).withColumn("rpart", F.lit(0).cast("long")).drop("copies")
    out = own.join(rare, own.host.eqNullSafe(rare.rhost) & (own.doc == rare.rdoc) & (own.part == rare.rpart), "left").withColumn("removed", F.coalesce("known", "removed"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    ok = F.col("removed").isNull() | ((left >= min_words) & (left >= min_left * F.col("n_words")))
    return out.select(F.col("k").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), left.alias("words_left"), (~failed & ok).alias("kept"))


def cleaned(df: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", max_docs: int = 100, **limits) -> DataFrame:
    """The rows that `rules` keeps, with df's columns and without the lines that it counts as frequent.

    Only texts that hold such lines are changed; a row's fate follows from its own host and text,
    so equal rows share it, and all rows of a key stay if one does. Null and empty texts go, as they
    have too few words; a null host is a host; an empty table stays empty.
    """
    frequent = durable(frequent_lines(df, host, text, max_docs)).select(F.col("host").alias("fhost"), "line")
    named = df.withColumn("__host", quoted(host)).withColumn("__doc", F.xxhash64(quoted(text)))
    lines = named.select("__host", "__doc", F.explode(_lines(quoted(text))).alias("x")).select("__host", "__doc", "x.line").distinct()
    hit = lines.join(frequent, lines["__host"].eqNullSafe(frequent.fhost) & (lines.line == frequent.line), "left_semi")
    hit = hit.groupBy(F.col("__host").alias("h"), F.col("__doc").alias("d")).agg(F.collect_set("line").alias("__drop"))
    judged = rules(df, key, host, text, max_docs, **limits)
    good = judged.filter("kept").select(F.col(key).alias("k")).distinct()
    out = named.join(hit, named["__host"].eqNullSafe(hit.h) & (named["__doc"] == hit.d), "left").join(good, quoted(key).eqNullSafe(F.col("k")), "left_semi")
    flat = lambda x: F.trim(F.regexp_replace(F.lower(x), "[\\x20\\x09\\x0B-\\x0D]+", " "))
    left = F.array_join(F.filter(F.split(quoted(text), "\n"), lambda x: ~F.array_contains("__drop", F.xxhash64(flat(x)))), "\n")
    return out.withColumn(text, F.when(F.col("__drop").isNull(), quoted(text)).otherwise(left)).select(df.columns)
