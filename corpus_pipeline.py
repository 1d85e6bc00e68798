"""A corpus pipeline: documents without toxic ones, repeated lines and near copies, mixed to weights and encoded.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. ORACLE_SQL is None: the first stage is a trained classifier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ambulo.llm.common import cut, table
from ambulo.llm.linededup import dedup_lines
from ambulo.llm.mixing import mix_documents
from ambulo.llm.neardup import keep_one_of_each
from ambulo.llm.sentencepieces import default_model, encode_documents
from ambulo.llm.toxicity import drop_toxic

ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, by a classifier of the labelled ones among them.

    Null and empty texts score the bias and stay, as do all documents if no label can be learnt from. Null doc_ids are
    scored but not learnt from; repeated rows score alike. Columns pass through; an empty table stays empty.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of later occurrences of three-line windows; n_chars follows the text.

    A document of which no line is left goes; one that was empty or null before stays. Of equal windows the one with the
    smallest (doc_id, text, position) stays, null doc_ids first; repeated rows are one document, two texts under one
    doc_id are two. Columns pass through; an empty table stays empty.
    """
    out = dedup_lines(docs).where("n_removed = 0 OR n_removed < n_lines")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the smallest doc_id.

    Null and empty texts and null doc_ids have no duplicates and stay; repeated rows of the document that stays are that
    document. Columns pass through; an empty table stays empty.
    """
    return keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents so many times as their source's budget has them; see mix_documents for nulls, ties and repeated rows."""
    return mix_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the n-best segmentations, for each row of the mix.

    Null and empty texts have one empty segmentation; repeated rows are encoded alike; an empty table stays empty.
    """
    return encode_documents(docs, default_model()).drop("text", "n_chars")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("sentencepiece", sentencepiece)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
