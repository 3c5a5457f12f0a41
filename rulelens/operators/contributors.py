"""Contributor statistics: one aggregation pass each, no self-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _latest(*columns: str) -> Column:
    """The columns of the latest row; the id breaks ties."""
    return F.max_by(F.struct(*columns), F.struct("created_at", "id"))


def submissions(tasks: DataFrame) -> DataFrame:
    known = tasks.filter(F.col("pr_author").isNotNull())
    return known.groupBy("user_id", "repository_full_name", "pr_author").agg(F.count("*").alias("submissions"))


def repo_contributors(tasks: DataFrame) -> DataFrame:
    """Per repository and author: last task and number of submissions (an empty author counts)."""
    return (
        tasks.filter(F.col("pr_author").isNotNull())
        .groupBy("user_id", "repository_full_name", "pr_author")
        .agg(_latest("id", "status", "created_at").alias("last"), F.count("*").alias("submissions"))
        .select(
            "user_id",
            "repository_full_name",
            "pr_author",
            F.col("last.id").alias("last_task_id"),
            F.col("last.status").alias("last_status"),
            F.col("last.created_at").alias("last_submitted_at"),
            "submissions",
        )
    )


def all_contributors(tasks: DataFrame) -> DataFrame:
    """Per user and author over all repositories (an empty author does not count)."""
    return (
        tasks.filter(F.col("pr_author").isNotNull() & (F.col("pr_author") != ""))
        .groupBy("user_id", "pr_author")
        .agg(
            F.count("*").alias("total_submissions"),
            F.count_if(F.col("status") == "completed").alias("completed_submissions"),
            F.count_distinct("repository_full_name").alias("repo_count"),
            _latest("id", "status", "created_at").alias("last"),
        )
        .select(
            "user_id",
            "pr_author",
            "total_submissions",
            "completed_submissions",
            "repo_count",
            F.col("last.id").alias("last_task_id"),
            F.col("last.status").alias("last_status"),
            F.col("last.created_at").alias("last_submitted_at"),
        )
    )


def repo_stats(tasks: DataFrame) -> DataFrame:
    """Per author and repository: totals, and the latest completed task that has a result."""
    done = (F.col("status") == "completed") & F.col("has_result")
    order = F.when(done, F.struct("created_at", "id"))
    return (
        tasks.filter(F.col("pr_author").isNotNull())
        .groupBy("user_id", "pr_author", "repository_full_name")
        .agg(
            F.count("*").alias("total_submissions"),
            F.count_if(F.col("status") == "completed").alias("completed_submissions"),
            F.max("created_at").alias("last_submitted_at"),
            F.max_by(F.struct("id", "pr_number"), order).alias("best"),
        )
        .select(
            "user_id",
            "pr_author",
            "repository_full_name",
            "total_submissions",
            "completed_submissions",
            "last_submitted_at",
            F.col("best.id").alias("best_task_id"),
            F.col("best.pr_number").alias("best_pr_number"),
        )
    )


def with_verdicts(stats: DataFrame, verdict_counts: DataFrame) -> DataFrame:
    """Add the verdict counts of the best task; zero without one."""
    names = ["pass_count", "partial_count", "fail_count"]
    counts = verdict_counts.select(F.col("task_id").alias("best_task_id"), *names)
    joined = stats.join(counts, "best_task_id", "left")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in names})


def totals(stats: DataFrame) -> DataFrame:
    """Rows per repository plus one row per author with a null repository, from one roll-up."""
    return (
        stats.rollup("user_id", "pr_author", "repository_full_name")
        .agg(
            F.sum("total_submissions").alias("total_submissions"),
            F.sum("completed_submissions").alias("completed_submissions"),
            F.grouping_id().alias("level"),
        )
        .filter(F.col("level") <= 1)
    )


def verdict_share(counts: DataFrame) -> DataFrame:
    """Percent of pass, partial and fail; null when there is no verdict."""
    total = F.nullif(F.col("pass_count") + F.col("partial_count") + F.col("fail_count"), F.lit(0))
    share = {n.replace("count", "pct"): 100.0 * F.col(n) / total for n in ("pass_count", "partial_count", "fail_count")}
    return counts.withColumns(share)


def author_contains(df: DataFrame, text: str) -> DataFrame:
    return df.filter(F.contains(F.lower("pr_author"), F.lower(F.lit(text))))


def figures(contributors: DataFrame) -> DataFrame:
    return contributors.groupBy("user_id").agg(
        F.count("*").alias("contributors"),
        F.count_if(F.col("completed_submissions") > 0).alias("with_completed"),
    )


def by_last_submission(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("last_submitted_at").desc_nulls_first(), F.col("last_task_id").desc())
