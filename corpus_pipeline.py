"""A corpus pipeline: language, exact copies, near copies, packing into token windows.

Each stage reads what the one before it kept, as Parquet under the shared folder, and all but the last
return the columns of documents. A text without any letter has no language and goes; so do all copies
but one, exact ones by text, near ones by 5-word shingles with a similarity of 0.8 or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeglass.llm import exact_dedup, langid, minhash, packing
from tradeglass.llm.queries import documents, tokenizer_path
from tradeglass.session import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; the model is fitted on labelled documents of this table.

    Without any such document, every text with a letter stays.
    """
    model = langid.fit(docs)
    if model is None:
        return docs.where(langid.has_letter(F.col("text").cast("string")))
    return docs.where(langid.predict(F.col("text").cast("string"), model).getField("lang_pred") != langid.UNKNOWN)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every text: that with the largest doc_id."""
    return exact_dedup.unique(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: that with the smallest doc_id."""
    return minhash.unique(docs, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows of the documents that are left."""
    return packing.pack(docs, tokenizer_path(), end_id=1)


STAGES = [("language ID", language), ("exact dedup", without_copies), ("MinHash near-dedup", without_near_copies), ("packing", packed)]

#: The kernel classifier, the components of similar texts and the packing have no plain SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
