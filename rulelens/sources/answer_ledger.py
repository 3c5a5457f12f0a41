"""Answers as they come: raw answers by prompt digest and model, appended batch by batch.

A prompt that the ledger holds is never sent again, whichever task, run or repository asks; a run that
breaks off loses the batch in flight and nothing else. Evaluators that are unavailable leave no row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.operators.evaluation import Evaluator, ask
from rulelens.session import stored

SCHEMA = "prompt_digest string, raw string, model string"
BATCH = 10_000


def digest() -> Column:
    return F.sha2("prompt", 256)


def read(spark: SparkSession, path: str, model: str) -> DataFrame:
    """(prompt_digest, raw) of one model."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], SCHEMA).drop("model")
    # two runs at once may both have asked; one of the answers holds for all readers
    return spark.read.schema(SCHEMA).parquet(path).filter(F.col("model") == model).groupBy("prompt_digest").agg(F.min("raw").alias("raw"))


def ask_once(prompts: DataFrame, model: str, evaluate: Evaluator, path: str, keys: Sequence[str], batch: int = BATCH) -> DataFrame:
    """``keys``, prompt and raw answer of every prompt; only prompts that the ledger lacks reach the evaluator."""
    spark = prompts.sparkSession
    wanted = stored(prompts.select(*keys, "prompt", digest().alias("prompt_digest")), "wanted")
    lacking = wanted.join(read(spark, path, model).select("prompt_digest"), "prompt_digest", "left_anti")
    lacking = stored(lacking.groupBy("prompt_digest").agg(F.first("prompt").alias("prompt")), "lacking")
    batches = math.ceil(lacking.count() / batch)
    for n in range(batches):
        part = lacking.filter(F.pmod(F.xxhash64("prompt_digest"), F.lit(batches)) == n)
        answers = ask(part, evaluate, ["prompt_digest"]).filter("raw is not null").select("prompt_digest", "raw", F.lit(model).alias("model"))
        answers.write.mode("append").partitionBy("model").parquet(path)
    return wanted.join(read(spark, path, model), "prompt_digest", "left").select(*keys, "prompt", "raw")
