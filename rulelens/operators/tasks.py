"""Task listing, filtering, paging, access and queue views."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulelens.functions.text import add_seconds, literal_map, owner_of, round_half_up
from rulelens.operators.numbering import number_within

# Sortable columns, defaults of a repository without configuration, retry limits.
TASK_SORT = ("created_at", "status", "repository_full_name", "progress", "completed_at", "pr_number")
CONFIG_DEFAULTS = {
    "max_evaluations_per_pr": 3,
    "approval_threshold": 0.8,
    "enable_cross_check": True,
    "pr_evaluation_enabled": True,
    "max_chunks_per_rule": 5,
}
PAIR_MODELS = ("llm_primary_model", "llm_secondary_model")
MAX_RETRIES = 5
RETRY_SECONDS = 120
REQUEUE_MESSAGE = "Service temporarily unavailable. Evaluation will resume automatically."
FAILURE_MESSAGES = {
    "LLM_UNAVAILABLE": f"LLM service did not respond after {MAX_RETRIES} attempts. Please try again later.",
    "EMBEDDING_UNAVAILABLE": f"Vector search service did not respond after {MAX_RETRIES} attempts. Please try again later.",
    "UNEXPECTED_ERROR": "An unexpected error occurred during evaluation. Contact support if the issue persists.",
}
SUMMARY = (
    "id", "repository_full_name", "status", "progress", "progress_message",
    "created_at", "completed_at", "pr_number", "pr_author",
)
DETAIL = (
    "id", "repository_url", "repository_full_name", "rules", "status", "progress", "progress_message", "result",
    "error", "created_at", "started_at", "completed_at", "pr_number", "pr_head_ref", "pr_head_sha", "pr_author",
    "enable_cross_check", "retry_count",
)


def filter_tasks(tasks: DataFrame, user_id, repository: str = "", author: str = "", status: str = "") -> DataFrame:
    """Tasks of one user; an empty argument does not filter."""
    wanted = F.col("user_id") == user_id
    for column, value in (("repository_full_name", repository), ("pr_author", author), ("status", status)):
        if value:
            wanted = wanted & (F.col(column) == value)
    return tasks.filter(wanted)


def filter_for_requests(tasks: DataFrame, requests: DataFrame) -> DataFrame:
    """The same filter for many requests ``(request_id, user_id, repository, author, status)`` at once.

    Requests are split by the fields they set, and each kind is one equi-join on just these fields; a null or empty field does not filter.
    """
    fields = {"repository": "repository_full_name", "author": "pr_author", "status": "status"}
    found = []
    for chosen in (c for n in range(len(fields) + 1) for c in itertools.combinations(fields, n)):
        alike = requests
        for field in fields:
            given = F.coalesce(F.col(field), F.lit("")) != ""
            alike = alike.filter(given if field in chosen else ~given)
        wanted = alike.select("request_id", "user_id", *(F.col(f).alias(fields[f]) for f in chosen))
        found.append(tasks.join(wanted, ["user_id", *(fields[f] for f in chosen)]).select("request_id", *tasks.columns))
    return functools.reduce(DataFrame.unionByName, found)


def summary(tasks: DataFrame) -> DataFrame:
    return tasks.select(*SUMMARY)


def detail(tasks: DataFrame) -> DataFrame:
    """The detail columns; a table without one of them has it as null."""
    return tasks.select(*[F.col(c) if c in tasks.columns else F.lit(None).cast("string").alias(c) for c in DETAIL])


def is_terminal(status: Column) -> Column:
    return status.isin("completed", "failed")


def is_ready(as_of: Column) -> Column:
    due = F.col("retry_after").isNull() | (F.col("retry_after") <= as_of)
    return (F.col("status") == "pending") & due


def ready_first(tasks: DataFrame, as_of: Column, n: int) -> DataFrame:
    """The next ``n`` tasks to run, oldest first."""
    return tasks.filter(is_ready(as_of)).orderBy("created_at", "id").limit(n)


def sort_key(column: str, order: str, allowed: Sequence[str], default: str) -> Column:
    """Sort column from an allow-list; any order other than ``desc`` is ascending, nulls are the largest values."""
    c = F.col(column if column in allowed else default)
    return c.desc_nulls_first() if order.lower() == "desc" else c.asc_nulls_last()


def page(df: DataFrame, key: Column, number: int, size: int, tie: str = "id") -> DataFrame:
    return df.orderBy(key, tie).offset((number - 1) * size).limit(size)


def page_per_group(
    df: DataFrame, groups: Sequence[str], key: Column, number: int, size: int, tie: str = "id"
) -> DataFrame:
    """One page for every group; the rank bound lets Spark drop later rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(key, tie))
    return (
        df.withColumn("row_no", rank)
        .filter(F.col("row_no") <= number * size)
        .filter(F.col("row_no") > (number - 1) * size)
    )


def page_count(total: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / size)).cast("bigint")


def latest_tasks(tasks: DataFrame, n: int) -> DataFrame:
    """The latest ``n`` tasks of every user."""
    return page_per_group(tasks, ["user_id"], F.col("created_at").desc_nulls_first(), 1, n)


def count_by(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def dashboard(tasks: DataFrame, window: int = 50) -> DataFrame:
    """Per user: share of completed and number of open tasks among the latest, and the total of all."""
    recent = (
        latest_tasks(tasks, window)
        .groupBy("user_id")
        .agg(
            F.count("*").alias("shown"),
            F.count_if(F.col("status") == "completed").alias("completed"),
            F.count_if(F.col("status").isin("pending", "running")).alias("open_tasks"),
        )
        .withColumn("completed_pct", round_half_up(F.col("completed") / F.nullif("shown", F.lit(0)) * 100))
    )
    return recent.join(count_by(tasks, ["user_id"], "total"), "user_id")


def grants(tasks: DataFrame, viewers: DataFrame) -> DataFrame:
    """Owner rows and viewer rows, one below the other (duplicates stay)."""
    owners = tasks.filter(F.col("user_id").isNotNull()).select(F.col("id").alias("task_id"), "user_id")
    return owners.union(viewers.select("task_id", "user_id"))


def visible(requests: DataFrame, tasks: DataFrame, viewers: DataFrame) -> DataFrame:
    """Requests ``(task_id, user_id)`` whose user owns the task or was given access."""
    return requests.join(grants(tasks, viewers), ["task_id", "user_id"], "left_semi")


def with_config(
    df: DataFrame, configs: DataFrame, global_model: str, global_primary: str | None = None, global_secondary: str | None = None
) -> DataFrame:
    """Add the configuration in force: stored values, else the defaults, and for each of the three models the
    global one (where none is given, the global model stands for all)."""
    names = list(CONFIG_DEFAULTS)
    models = [F.col(c).alias(f"_{c}") if c in configs.columns else F.lit(None).cast("string").alias(f"_{c}") for c in PAIR_MODELS]
    stored = configs.select(
        "user_id", "repository_full_name", *[F.col(c).alias(f"_{c}") for c in names], F.col("llm_model").alias("_model"), *models
    )
    joined = df.drop(*names).join(stored, ["user_id", "repository_full_name"], "left")
    for name, default in CONFIG_DEFAULTS.items():
        joined = joined.withColumn(name, F.coalesce(F.col(f"_{name}"), F.lit(default)))
    model = F.coalesce(F.col("_model"), F.lit(global_model))
    pair = {
        "llm_primary_model": F.coalesce("_llm_primary_model", F.lit(global_primary or global_model)),
        "llm_secondary_model": F.coalesce("_llm_secondary_model", F.lit(global_secondary or global_model)),
    }
    return joined.withColumns({"llm_model": model, **pair}).drop("_model", *[f"_{c}" for c in (*names, *PAIR_MODELS)])


def with_installation(requests: DataFrame, installations: DataFrame) -> DataFrame:
    """Add the installation of the repository's owner account; the lowest id when there are several."""
    one = installations.groupBy("user_id", F.col("account_login").alias("owner")).agg(
        F.min("installation_id").alias("installation_id")
    )
    return requests.withColumn("owner", owner_of(F.col("repository_full_name"))).join(one, ["user_id", "owner"], "left")


def evaluation_numbers(tasks: DataFrame, cap: Column) -> DataFrame:
    """Number the evaluations of every pull request and keep those within its cap, whatever the cap is.

    Numbers come month by month, so that a pull request with very many tasks is not one task's window.
    """
    order = [F.col("created_at"), F.col("id")]
    keys = ["repository_full_name", "pr_number"]
    placed = number_within(tasks.filter(F.col("pr_number").isNotNull()), keys, order, F.trunc("created_at", "month"), "_n")
    return placed.withColumn("eval_no", F.col("_n") + 1).drop("_n").filter(F.col("eval_no") <= cap)


def requeue(failures: DataFrame) -> DataFrame:
    """What happens to failed runs ``(task_id, error_kind, retry_count, failed_at, technical)``.

    Unavailable services are retried after a pause up to the limit; everything else fails at once.
    """
    transient = F.col("error_kind").isin("LLM", "EMBEDDING")
    retry = transient & (F.col("retry_count") < MAX_RETRIES)
    code = F.when(transient, F.concat(F.col("error_kind"), F.lit("_UNAVAILABLE"))).otherwise("UNEXPECTED_ERROR")
    message = F.element_at(literal_map(FAILURE_MESSAGES), code)
    payload = F.to_json(F.struct(code.alias("code"), message.alias("message"), F.col("technical").alias("technical")))
    return failures.select(
        "task_id",
        F.when(retry, "pending").otherwise("failed").alias("status"),
        F.when(retry, F.col("retry_count") + 1).otherwise(F.col("retry_count")).alias("retry_count"),
        F.when(retry, add_seconds(F.col("failed_at"), F.lit(RETRY_SECONDS))).alias("retry_after"),
        F.when(retry, REQUEUE_MESSAGE).alias("progress_message"),
        F.when(~retry, payload).alias("error"),
    )
