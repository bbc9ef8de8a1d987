"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing, packing.

Each stage gets all rows its predecessor kept, as documents, and returns documents; the last returns packed pieces.
Stages are written as Parquet and read again in between, in the shared folder, so a lost executor costs one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm.exact_dedup import drop_copies
from sigspark.llm.mixing import sequence
from sigspark.llm.near_dedup import drop_near_copies
from sigspark.llm.packing import pack
from sigspark.llm.quality import clean
from sigspark.llm.queries import tokenizer_path
from sigspark.llm.workspace import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _sized(docs: DataFrame) -> DataFrame:
    """documents' columns, n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: rejected documents go, lines above the limits of their host go from the others."""
    return _sized(clean(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one of each group of equal texts stays."""
    return drop_copies(docs).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each component stays; five-word shingles, similarity of 0.8 or more."""
    return drop_near_copies(docs, percent=80).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents as often as the mix takes them, by training position; the last one of a source may be cut."""
    return _sized(sequence(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: pieces of documents in windows, run by run of the training order that the mix was written in."""
    return pack(docs, tokenizer_path(), ordered=True)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("source_mix", mix), ("packing", packed)]
#: Signatures, tokenizer ids and retrieval have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
