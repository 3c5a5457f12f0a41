"""Webhook payloads from a folder of JSON files, as a stream or a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAYLOAD = """
event string, received_at timestamp_ntz, action string,
installation struct<id:bigint, account:struct<login:string>>,
sender struct<login:string>,
repository struct<full_name:string, clone_url:string>,
pull_request struct<number:bigint, head:struct<sha:string, ref:string>, user:struct<login:string>>
"""


def read_payloads(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(PAYLOAD).json(path)


def pull_requests(payloads: DataFrame) -> DataFrame:
    return payloads.filter("event = 'pull_request'").select(
        F.coalesce("action", F.lit("")).alias("action"),
        F.col("installation.id").alias("installation_id"),
        F.col("repository.full_name").alias("repository_full_name"),
        F.col("pull_request.number").alias("pr_number"),
        F.col("pull_request.head.sha").alias("head_sha"),
        F.col("pull_request.head.ref").alias("head_ref"),
        F.col("pull_request.user.login").alias("author"),
        F.col("repository.clone_url").alias("clone_url"),
        F.col("received_at").alias("ts"),
    )


def installation_changes(payloads: DataFrame) -> DataFrame:
    return payloads.filter("event = 'installation'").select(
        F.coalesce("action", F.lit("")).alias("action"),
        F.col("installation.id").alias("installation_id"),
        F.col("installation.account.login").alias("account_login"),
        F.coalesce("sender.login", F.lit("")).alias("sender_login"),
        F.col("received_at").alias("ts"),
    )
