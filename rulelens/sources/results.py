"""Task results as JSON, outcome rows, and their sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulelens.operators.numbering import latest_per_key

FILE = (
    "file_path:string,relevance_score:double,file_content:string,language:string,"
    "matched_symbols:array<string>,truncated:boolean"
)
EVALUATION = "verdict:string,explanation:string,suggestions:array<string>,llm_provider:string,tokens_used:bigint"
CROSS_CHECK = (
    "primary_verdict:string,primary_model:string,primary_explanation:string,"
    "secondary_verdict:string,secondary_model:string,secondary_explanation:string,"
    "agreement:boolean,discriminator_used:boolean,discriminator_model:string,discriminator_reasoning:string"
)
VALIDATION = (
    f"rule:string,related_files:array<struct<{FILE}>>,evaluation:struct<{EVALUATION}>,cross_check:struct<{CROSS_CHECK}>"
)
RESULT = (
    f"struct<validations:array<struct<{VALIDATION}>>,embedding_model:string,chunking_strategy:string,"
    "llm_model:string,processing_time_seconds:double>"
)
PART_RULES = 1000


def nest(validations: DataFrame, part_rules: int = PART_RULES) -> DataFrame:
    """Validations ``(task_id, rule_idx, rule, evaluation, ...)`` as arrays in rule order.

    A result holds at most ``part_rules`` rules; longer ones come in numbered parts. Columns ``related_files`` and
    ``cross_check`` are nested where the input has them.
    """
    more = [c for c in ("related_files", "cross_check") if c in validations.columns]
    return (
        validations.withColumn("part", F.floor(F.col("rule_idx") / part_rules))
        .groupBy("task_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct("rule_idx", "rule", "evaluation", *more))).alias("validations"))
    )


def to_json(results: DataFrame) -> DataFrame:
    """Add ``result``: the JSON of the nested result."""
    named = F.struct(
        "validations",
        *[c for c in ("embedding_model", "chunking_strategy", "llm_model", "processing_time_seconds") if c in results.columns],
    )
    return results.withColumn("result", F.when(F.col("validations").isNotNull(), F.to_json(named)))


def parse(results: DataFrame, column: str = "result") -> DataFrame:
    """Add ``parsed``: a null or empty result stays null, missing lists become empty, missing texts ``''``."""
    raw = F.from_json(F.nullif(F.col(column), F.lit("")), RESULT)
    row = results.withColumn("_r", raw)
    empty_files = F.array().cast(f"array<struct<{FILE}>>")
    one = F.transform(
        F.coalesce("_r.validations", F.array().cast(f"array<struct<{VALIDATION}>>")),
        lambda v: F.struct(
            v["rule"].alias("rule"),
            F.coalesce(v["related_files"], empty_files).alias("related_files"),
            v["evaluation"].alias("evaluation"),
            v["cross_check"].alias("cross_check"),
        ),
    )
    text = [F.coalesce(F.col(f"_r.{c}"), F.lit("")).alias(c) for c in ("embedding_model", "chunking_strategy", "llm_model")]
    seconds = F.coalesce("_r.processing_time_seconds", F.lit(0.0)).alias("processing_time_seconds")
    full = F.struct(one.alias("validations"), *text, seconds)
    return row.withColumn("parsed", F.when(F.col("_r").isNotNull(), full)).drop("_r")


def outcomes(finished: DataFrame, finished_at) -> DataFrame:
    """Rows that set the state of finished runs ``(task_id, result, error)``, for each part of a result."""
    ok = F.col("error").isNull()
    part = F.col("part") if "part" in finished.columns else F.lit(0).cast("bigint")
    return finished.select(
        "task_id",
        part.alias("part"),
        F.when(ok, "completed").otherwise("failed").alias("status"),
        F.when(ok, 100).alias("progress"),
        F.when(ok, "Done").alias("progress_message"),
        "result",
        "error",
        finished_at.alias("completed_at"),
    )


def current_state(tasks: DataFrame, outcome_rows: DataFrame) -> DataFrame:
    """Tasks with their last outcome applied; a completed task loses its partial result.

    The first part of a result stands in the task's row; the others stay in the outcome rows, by part.
    """
    columns = ["status", "progress", "progress_message", "result", "error", "completed_at"]
    last = latest_per_key(outcome_rows.filter("part = 0"), ["task_id"], ["completed_at", "status"], columns).select(
        F.col("task_id").alias("id"), *[F.col(c).alias(f"_{c}") for c in columns]
    )
    joined = tasks.join(last, "id", "left")
    changes = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns if c in tasks.columns}
    if "partial_result" in tasks.columns:
        changes["partial_result"] = F.when(F.col("_status").eqNullSafe("completed"), None).otherwise(F.col("partial_result"))
    return joined.withColumns(changes).drop(*[f"_{c}" for c in columns])


def write_reports(reports: DataFrame, path: str) -> None:
    """Report rows ``(task_id, state, description, body)`` as JSON lines."""
    reports.write.mode("append").json(path)


def append_parquet(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: one folder per batch, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
