"""A corpus pipeline: language, near duplicates, personal data, packing.

STAGES holds (name, function); each function takes (spark, docs, sf_dir) and works on all rows of docs.  Every stage
but the last returns the columns of documents.  run() applies them one after the other and writes each stage's rows to
the shared folder, so a lost executor never costs more than the stage it ran.

All stages read texts whole, whatever their length, keep extra columns whatever their names (the last one returns its
own columns only), and give empty tables for empty tables.
"""

from __future__ import annotations

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageforge.llm import langid, ngramjoin, packing, pii
from pageforge.llm.common import cut, shared_dir, table
from pageforge.session import prepare


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier recognizes.  It learns from docs.

    Null and empty texts and texts without a letter go.  Other columns may be null; without labels to learn from every
    text with a letter stays.  Repeated rows stay or go together.
    """
    prepare(spark)
    return langid.recognized(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that are linked by similar shingle sets, the one with the smallest doc_id.

    Null and empty texts are in no group and stay.  Of rows with one id and one group one stays; rows without an id stay.
    """
    prepare(spark)
    return ngramjoin.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind, n_chars counted anew.

    Null texts stay null and keep their n_chars; spans that overlap are replaced together, by the kind of the first.
    """
    prepare(spark)
    out = pii.mask(docs)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the sequences.

    Null and empty texts are documents of one id, the end id; repeated rows are packed each.
    """
    prepare(spark)
    return packing.pack(packing.pieces(docs, path("word_bpe_49k.json")))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packed)]

#: SQL has no classifier, no conditional random field and no packing; the tests compare run() with plain Python, stage
#: by stage: labels from the classifier's own scores, groups by brute force, spans, ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, where = table(spark, sf_dir, "documents"), shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), where, name)
    return STAGES[-1][1](spark, docs, sf_dir)
