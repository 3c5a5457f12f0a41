"""Rule files: reading ``{"rules": [...]}`` documents and writing exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER_DIGITS = 16
EXPORT = "user_id bigint, repository_full_name string, part bigint, body string"


def read_rule_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``(file, body)`` with the whole JSON text."""
    return spark.read.text(path, wholetext=True).select(
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("body")
    )


def write_exports(exports: DataFrame, path: str) -> None:
    """Exported lists as JSON lines, each with its user, repository and part beside the exported document.

    Folders are named by a hash of user and repository, so that no two lists share a folder by their spelling.
    """
    key = F.substring(F.md5(F.concat_ws("\x00", F.col("user_id").cast("string"), "repository_full_name")), 1, FOLDER_DIGITS)
    exports.select(key.alias("folder"), "user_id", "repository_full_name", "part", "body").write.mode("overwrite").partitionBy(
        "folder"
    ).json(path)


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """``(user_id, repository_full_name, part, body)`` of written exports."""
    return spark.read.schema(EXPORT).json(path).drop("folder")
