"""Hashes of indexed files as a log: the last row of a file counts, and a null hash withdraws it.

Rows are only appended, so a broken writer can lose the rows it was about to add but never those that were there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.operators.numbering import latest_per_key

SCHEMA = "repo string, file_path string, content_hash string, entry bigint"
FILE = ["repo", "file_path"]


def _log(spark: SparkSession, path: str) -> DataFrame | None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(SCHEMA).parquet(path) if known else None


def read(spark: SparkSession, path: str) -> DataFrame:
    """(repo, file_path, content_hash) of all files that are named now."""
    log = _log(spark, path)
    if log is None:
        return spark.createDataFrame([], SCHEMA).drop("entry")
    return latest_per_key(log, FILE, ["entry"], ["content_hash"]).filter("content_hash is not null")


def append(hashes: DataFrame, path: str) -> None:
    """Add rows (repo, file_path, content_hash), one per file."""
    log = _log(hashes.sparkSession, path)
    last = 0 if log is None else log.agg(F.max("entry")).first()[0] or 0
    hashes.select(*FILE, F.col("content_hash").cast("string"), F.lit(last + 1).cast("bigint").alias("entry")).write.mode("append").parquet(path)
