"""A pipeline from raw documents to packed training sequences; each stage works on what the one before it kept.

Null and empty texts, and those without letters, go in the first stage, which needs a column `lang` to learn from; repeated rows are
one document for near duplicates (each row of a kept one stays) and stay rows of their own elsewhere. An empty table gives an empty result. Extra columns, whatever
their names, go through all stages but the last; n_chars follows the text where the table has such a column of numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from quadloom.llm import language, near_dup, packing, secrets, substring_dedup
from quadloom.llm.common import written
from quadloom.llm.queries import _tokenizer


def _counted(docs: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType for f in docs.schema}
    return docs.withColumn("n_chars", F.char_length("text").cast(kinds["n_chars"])) if isinstance(kinds.get("n_chars"), NumericType) else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or too far from every language learned, go."""
    return language.identified(docs, least=0.2)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 0.8 alike) the document with the least doc_id stays."""
    return near_dup.without_near_duplicates(docs, shingle_words=5, percent=80, bands=40)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 20 words or more that occur earlier go; so do documents that lose all their words."""
    return _counted(substring_dedup.without_repeats(docs, window=20).where("text <> ''"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind."""
    return _counted(secrets.redacted(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, with their sequences."""
    return packing.pack_documents(docs, _tokenizer("word_bpe_49k.json"), size=2048, end_id=0)


STAGES = [("language ID", language_id), ("near dedup", near_dedup), ("substring dedup", passages), ("secret scans", secret_scan), ("packing", packed)]

#: The language profiles and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
