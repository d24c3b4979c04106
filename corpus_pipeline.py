"""A training corpus from raw documents, in five stages.

Each stage takes the documents that the one before it kept, as a table in the
shared folder, and returns documents with the same columns; the last one
returns packed pieces. SQL can express neither the profiles, the fingerprints
nor the packing, so ``ORACLE_SQL`` is None and a brute-force run tests it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, mixing, packing, pii, simhash
from tidemark.llm.util import discard, passing, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no language; fill in null languages."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays: the one of the smallest id."""
    return simhash.near_dedup(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; ``n_chars`` follows the text."""
    clean = pii.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents towards the target weights of source, language and topic."""
    return mixing.keep_mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, with their ids and their place in a sequence."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), max_tokens=2048)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each but the last returns is stored and read again, and deleted when the next is stored."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with passing() as made:  # what a stage stores for itself goes with it
            docs = stored(stage(spark, docs, sf_dir), name)
            made.pop()
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
