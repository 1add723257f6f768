"""A corpus pipeline: language, near duplicates, contamination, mixture, token records.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept. All but the last return the columns of the documents. The near-duplicate
stage takes runs of five words and a similarity of 0.8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.llm import decontam, langid, mixing, queries, simhash, tokens
from docstrata.llm.common import materialise, new_path, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach, with the predicted one as ``lang``, which the mixture rakes by.

    Null texts, texts without a letter and texts in none of the languages go;
    null ids, repeated rows and other columns stay as they are. Without any
    label all texts with a letter stay.
    """
    return langid.with_language(docs, docs, "doc_id", "text", "lang")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group.

    A null text counts as empty, and so do texts of no word, which are equal to each
    other; of rows that share the smallest id the one with the smallest text
    hash stays, of equal rows one; a group whose ids are all null keeps one row.
    """
    return simhash.drop_near_duplicates(docs, "doc_id", "text", words=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts hold none and stay; repeated rows share their fate; an
    empty benchmark leaves all documents.
    """
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in the target proportions; sources and languages without a target, or null, keep their share.

    Null and empty texts have no tokens and are kept with the probability of their
    cell; whether a row is kept follows from its id alone, so rows of one id and
    one cell, and null ids, share their fate.
    """
    topic = mixing.rules_topic(F.coalesce("text", F.lit("")), queries.TOPICS, queries.OTHER_TOPIC)
    mixed = mixing.mix(docs, "doc_id", "text", "source", "lang", topic, queries.TARGETS, queries.KEEP_SHARE, rest=True)
    return mixed.where("kept").select("row.*")


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The index of the records that were written: (doc_id, start, n_tokens, ids_crc32).

    A null text has the end id only; null ids come first; rows of one id are in
    the order of a hash of their text; repeated rows are repeated.
    """
    out = new_path(spark, "records")
    tokens.write_records(docs, "doc_id", "text", queries.tokenizer_path(), queries.END_ID, out)
    return tokens.with_starts(tokens.read_index(spark, out)).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mixture", mixture), ("token_records", token_records)]
#: No stage of the first two has an SQL form; the tests hold the whole against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, each written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
