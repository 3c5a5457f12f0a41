"""Running evaluators, parsing and reconciling their answers, and scoring tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulelens.functions.text import estimate_tokens
from rulelens.functions.verdicts import more_severe, parse_response, percent, points

Evaluator = Callable[[Sequence[str]], Sequence[str]]

APPROVAL_THRESHOLD = 0.8
UNAVAILABLE_CODE = "LLM_UNAVAILABLE"
UNAVAILABLE = "Discriminator unavailable: "
#: The prompt of the third evaluator; a field in braces is the column of that name.
ADJUDICATION = """Two reviewers checked the same rule and came to different verdicts. Decide which verdict holds.

RULE
{rule}

FIRST REVIEWER: {primary_verdict}
{primary_explanation}

SECOND REVIEWER: {secondary_verdict}
{secondary_explanation}

Answer with one JSON object and nothing else. Its "verdict" is "pass", "partial" or "fail", its "explanation" says why, and its
"suggestions" are a list of texts, which may be empty."""


def ask(prompts: DataFrame, evaluate: Evaluator, keys: Sequence[str]) -> DataFrame:
    """Send every prompt to the caller's evaluator, one Arrow batch at a time, and keep the raw answers.

    An evaluator that is unavailable returns None for the prompt; see ``unfinished``.

    The number of partitions bounds the calls in flight; repartition before, to respect a rate limit.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(raw=list(evaluate(batch["prompt"].tolist())))

    chosen = prompts.select(*keys, "prompt")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields)
    return chosen.mapInPandas(run, f"{schema}, raw string")


def parse_answers(answers: DataFrame, provider: str) -> DataFrame:
    """Add the evaluation of every raw answer; an evaluation error counts no tokens.

    A missing answer gives no verdict but the code ``LLM_UNAVAILABLE``.
    """
    tokens = F.when(
        F.col("_p.error_code").isin("EVALUATION_ERROR", UNAVAILABLE_CODE), F.lit(0)
    ).otherwise(estimate_tokens(F.concat("prompt", "raw")))
    missing = F.struct(
        F.lit(None).cast("string").alias("verdict"),
        F.lit("").alias("explanation"),
        F.array().cast("array<string>").alias("suggestions"),
        F.lit(UNAVAILABLE_CODE).alias("error_code"),
    )
    return (
        answers.withColumn("_p", F.when(F.col("raw").isNull(), missing).otherwise(parse_response(F.col("raw"))))
        .withColumn("tokens_used", tokens.cast("bigint"))
        .select(*[c for c in answers.columns if c not in ("prompt", "raw")], "_p.*", "tokens_used")
        .withColumn("llm_provider", F.lit(provider))
    )


def unfinished(evaluated: DataFrame) -> DataFrame:
    """Tasks with a missing answer: they are queued again and keep what was evaluated."""
    return (
        evaluated.filter(F.col("error_code") == UNAVAILABLE_CODE)
        .groupBy("task_id")
        .agg(F.count("*").alias("missing"))
        .withColumn("error_kind", F.lit("LLM"))
    )


def cross_check(primary: DataFrame, secondary: DataFrame, adjudicated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reconcile two evaluations per key; inputs hold ``verdict`` and ``explanation``."""

    def named(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(
            *keys, F.col("verdict").alias(f"{prefix}_verdict"), F.col("explanation").alias(f"{prefix}_explanation")
        )

    joined = named(primary, "primary").join(named(secondary, "secondary"), list(keys))
    return reconcile(joined.join(named(adjudicated, "adjudicated"), list(keys), "left"))


def reconcile(pairs: DataFrame) -> DataFrame:
    """Final verdict: the common one, else the adjudicated one, else the more severe one with a reason."""
    p, s, a = F.col("primary_verdict"), F.col("secondary_verdict"), F.col("adjudicated_verdict")
    agreement = p.eqNullSafe(s)
    used = ~agreement & a.isNotNull()
    return pairs.withColumns(
        {
            "agreement": agreement,
            "discriminator_used": used,
            "final_verdict": F.when(agreement, p).when(used, a).otherwise(more_severe(p, s)),
            "discriminator_reasoning": F.when(
                ~agreement, F.when(used, F.col("adjudicated_explanation")).otherwise(F.lit(UNAVAILABLE + "no answer"))
            )
            if "adjudicated_explanation" in pairs.columns
            else F.when(~agreement & ~used, F.lit(UNAVAILABLE + "no answer")),
        }
    )


def disagreements(pairs: DataFrame) -> DataFrame:
    """Only the pairs that differ, with the prompt for the third evaluator."""
    parts = re.split(r"\{(\w+)\}", ADJUDICATION)
    prompt = F.concat(*[F.col(part) if i % 2 else F.lit(part) for i, part in enumerate(parts)])
    return pairs.filter(~F.col("primary_verdict").eqNullSafe(F.col("secondary_verdict"))).withColumn("prompt", prompt)


def restore(rules: DataFrame, saved: DataFrame) -> DataFrame:
    """Rules of resumed tasks with the saved evaluation at their position, if the rule is still the same."""
    known = saved.select(
        "task_id",
        "rule_idx",
        "rule",
        F.coalesce("verdict", F.lit("fail")).alias("verdict"),
        F.coalesce("explanation", F.lit("")).alias("explanation"),
        F.lit(True).alias("restored"),
    )
    joined = rules.join(known, ["task_id", "rule_idx", "rule"], "left")
    return joined.withColumn("restored", F.coalesce("restored", F.lit(False)))


def remaining(rules: DataFrame, saved: DataFrame) -> DataFrame:
    """Rules that still need an evaluator."""
    return rules.join(saved.select("task_id", "rule_idx", "rule"), ["task_id", "rule_idx", "rule"], "left_anti")


def verdict_counts(evaluated: DataFrame, keys: Sequence[str], verdict: str = "verdict") -> DataFrame:
    """Pass, partial and all other verdicts (also missing ones) count as pass, partial and fail."""
    v = F.col(verdict)
    return evaluated.groupBy(*keys).agg(
        F.count_if(v == "pass").alias("pass_count"),
        F.count_if(v == "partial").alias("partial_count"),
        F.count_if(~F.coalesce(v.isin("pass", "partial"), F.lit(False))).alias("fail_count"),
    )


def shown_counts(evaluated: DataFrame, keys: Sequence[str], verdict: str = "verdict") -> DataFrame:
    """As the pages show them: a missing verdict is counted apart as unknown."""
    v = F.col(verdict)
    return evaluated.groupBy(*keys).agg(
        *[F.count_if(v == name).alias(f"{name}_count") for name in ("pass", "partial", "fail")],
        F.count_if(v.isNull()).alias("unknown_count"),
    )


def nested_counts(results: DataFrame) -> DataFrame:
    """Verdict counts from nested results, counted inside the rows before the parts of a task are added up."""

    def count(test) -> Column:
        return F.size(F.filter("validations", lambda v: F.coalesce(test(v["evaluation"]["verdict"]), F.lit(False))))

    rows = results.select(
        "task_id",
        count(lambda v: v == "pass").alias("_pass"),
        count(lambda v: v == "partial").alias("_partial"),
        F.size("validations").alias("_all"),
    )
    return rows.groupBy("task_id").agg(
        F.sum("_pass").alias("pass_count"),
        F.sum("_partial").alias("partial_count"),
        F.sum(F.col("_all") - F.col("_pass") - F.col("_partial")).alias("fail_count"),
    )


def scores(tasks: DataFrame, evaluated: DataFrame, verdict: str = "verdict") -> DataFrame:
    """Score per task; a task without rules has 0.0 in reports and null on pages."""
    per_task = evaluated.groupBy("task_id").agg(
        F.count("*").alias("rules"), F.sum(points(F.col(verdict))).alias("_points")
    )
    return (
        tasks.join(per_task, "task_id", "left")
        .withColumn("rules", F.coalesce("rules", F.lit(0)))
        .withColumn("ui_score", F.col("_points") / F.col("rules"))
        .withColumn("score", F.coalesce("ui_score", F.lit(0.0)))
        .drop("_points")
    )


def approve(scored: DataFrame) -> DataFrame:
    """Compare with ``approval_threshold`` and add the percent that reports print."""
    return scored.withColumn("approved", F.col("score") >= F.col("approval_threshold")).withColumn(
        "pct", percent(F.col("score"))
    )
