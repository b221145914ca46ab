"""From raw documents to packed training sequences, a stage for each operator.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlens.llm import decontaminate, language_id, packing, pii, simhash
from seqlens.llm.common import checkpointed, table
from seqlens.llm.queries import PII_KEY, tokenizer_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones have. Null texts and texts without letters are in none and go; without any labelled text nothing else does."""
    return language_id.in_known_language(docs, language_id.fit_profiles(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: rows decide, also where ids are null or repeated."""
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no twentieth of benchmark text."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data, and their lengths anew."""
    found = pii.pseudonymise(docs, PII_KEY).select(*docs.columns)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences, with their token ids, in step groups over all partitions. A null or empty text is its end id alone; a row is
    a document, whatever its id; long texts are cut into pieces."""
    return packing.balanced_steps(checkpointed(packing.pack_documents(docs, tokenizer_path())))


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("pii", private),
    ("packing", packed),
]

#: SQL has neither the profiles nor the tokenizer; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
