"""A corpus from raw documents to packed training windows, in five stages.

Every stage reads what its predecessor kept, stored as Parquet. All but the last return the columns of ``documents``:

1. quality rules: rejected documents go, common lines are taken out of the others;
2. near duplicates: of each group of documents linked at Jaccard 0.75 on five-word shingles the first stays;
3. benchmark decontamination: documents that hold a benchmark passage go;
4. secret scans: found secrets are replaced by a mark, all documents stay;
5. packing: all texts, tokenised, in windows of at most 4096 tokens.

Nulls, empty tables and repeated rows have the results that the operators' modules define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rulelens.llm import decontamination, jaccard_join, line_quality, packing, secret_ledger
from rulelens.llm.queries import END_ID, tokenizer
from rulelens.session import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_quality.clean(docs, chars_col="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_ledger.redact(docs, secret_ledger.new_ledger(spark), chars_col="n_chars")


def packed_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, tokenizer("word_bpe_49k.json"), END_ID)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("packing", packed_windows),
]

#: Retrieval by SVD and tokenising cannot be written in SQL; tests/llm holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
