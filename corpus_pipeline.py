"""From raw documents to token ids: reject toxic texts, keep one of each near-duplicate group,
redact personal data, mix the sources to their weights, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgrid.llm import mixing, pieces, pii, simhash, toxicity
from symgrid.llm.common import discard, quoted, stored, table
from symgrid.llm.queries import PIECE_MODEL


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below 0.7, unchanged. Null and empty texts, which give no evidence, stay;
    repeated rows share their fate; without labels, or without documents, nothing goes."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, to="__toxicity").filter("`__toxicity` < 0.7").select([quoted(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest doc_id, a null one last, and of
    repeated rows one. Null and empty texts are one group."""
    return simhash.keep_first(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and secrets in their texts replaced by their kind, n_chars counted
    anew (null for a null text)."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select([quoted(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them (0, 1 or 2 times). Those without words are never
    taken; a null source is a source; ties and repeated rows follow from a hash of the row."""
    return mixing.remix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids and their number: none for an empty text, null for a null one."""
    return pieces.encode(docs, pieces.load(PIECE_MODEL)).select("doc_id", "lang", "source", F.when(F.col("ids").isNotNull(), F.size("ids")).cast("long").alias("n_ids"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: A trained model, a covering hash and a tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over all documents. A stage's rows are deleted once the next stage's are
    written; those before the last stay, as the result is read from them."""
    docs, spent = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
            if spent is not None:
                discard(spent)
            spent = docs
    return docs
