"""Answers of all prompts of a check: models per repository, second and third opinions where asked.

Prompts are grouped by the model in force and sent to its evaluator through the answer ledger. Rules of
repositories with cross-check go to a second model as well, and those on which both differ to the adjudicator.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulelens.operators import evaluation
from rulelens.operators.evaluation import Evaluator
from rulelens.session import stored
from rulelens.sources import answer_ledger

SETTINGS = ("llm_model", "llm_primary_model", "llm_secondary_model", "enable_cross_check")
EVALUATION = ("verdict", "explanation", "suggestions", "error_code", "tokens_used", "llm_provider")


class Models(NamedTuple):
    """Evaluators by model name, and the models in force where a repository names none."""

    evaluators: Mapping[str, Evaluator]
    primary: str
    secondary: str | None = None
    adjudicator: str | None = None


def in_force(prompts: DataFrame, models: Models, configs: DataFrame | None) -> DataFrame:
    """Add ``cross_check``, ``model`` and ``second_model`` from the configurations of ``repo``."""
    if configs is None:
        own = prompts
    else:
        own = prompts.join(configs.select("repo", *[c for c in SETTINGS if c in configs.columns]), "repo", "left")

    def setting(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in own.columns else default

    cross = setting("enable_cross_check", F.lit(False)) if models.secondary else F.lit(False)
    return own.withColumns(
        {
            "cross_check": cross,
            "model": F.when(cross, setting("llm_primary_model", F.lit(models.primary))).otherwise(setting("llm_model", F.lit(models.primary))),
            "second_model": setting("llm_secondary_model", F.lit(models.secondary).cast("string")),
        }
    ).drop(*SETTINGS)


def routed(prompts: DataFrame, column: str, models: Models, ledger: str | None, keys: Sequence[str]) -> DataFrame:
    """Evaluations of all prompts, each by the evaluator of the model in ``column``; without a ledger all are asked."""

    def answered(name: str, run: Evaluator) -> DataFrame:
        own = prompts.filter(F.col(column) == name)
        return answer_ledger.ask_once(own, name, run, ledger, keys) if ledger else evaluation.ask(own, run, keys)

    strange = prompts.filter(~F.coalesce(F.col(column).isin(*models.evaluators), F.lit(False))).select(column).first()
    if strange:
        raise ValueError(f"no evaluator for model {strange[0]}")
    return reduce(DataFrame.unionByName, [evaluation.parse_answers(answered(name, run), name) for name, run in models.evaluators.items()])


def _named(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, F.struct(*EVALUATION).alias(name))


def evaluate(prompts: DataFrame, models: Models, ledger: str | None, key: str = "query_id") -> DataFrame:
    """One evaluation per prompt ``(query_id, prompt, rule, cross_check, model, second_model)``: the columns of an
    evaluation and ``cross_check``, null where no second opinion was asked.

    A missing second answer leaves the rule without a verdict, as a missing first one does; a missing third one
    leaves the more severe of both.
    """
    keys = [key]
    prompts = stored(prompts, "routed")
    first = stored(routed(prompts, "model", models, ledger, keys), "first-answers")
    alone = first.join(prompts.filter("not cross_check").select(key), key, "left_semi").withColumn("cross_check", F.lit(None).cast(CROSS_CHECK))
    asked = prompts.filter("cross_check")
    if not models.secondary or asked.isEmpty():
        return alone
    second = stored(routed(asked, "second_model", models, ledger, keys), "second-answers")
    pairs = _named(first, "a", keys).join(_named(second, "b", keys), key).join(asked.select(key, "rule"), key)
    pairs = pairs.select(
        key, "rule", "a", "b",
        *[F.col(f"{side}.{c}").alias(f"{name}_{c}") for side, name in (("a", "primary"), ("b", "secondary")) for c in ("verdict", "explanation")],
    )
    complete = stored(pairs.filter("primary_verdict is not null and secondary_verdict is not null"), "pairs")
    open_ = pairs.filter("primary_verdict is null or secondary_verdict is null")
    if models.adjudicator:
        differ = evaluation.disagreements(complete).withColumn("_by", F.lit(models.adjudicator))
        third = stored(routed(differ, "_by", models, ledger, keys), "third-answers").filter("verdict is not null")
        judged = complete.join(_named(third, "c", keys), key, "left")
    else:
        judged = complete.withColumn("c", F.lit(None).cast(complete.schema["a"].dataType))
    final = evaluation.reconcile(judged.withColumns({"adjudicated_verdict": F.col("c.verdict"), "adjudicated_explanation": F.col("c.explanation")}))
    chosen = F.when(F.col("agreement"), F.col("a")).when(F.col("discriminator_used"), F.col("c")).when(
        F.col("final_verdict").eqNullSafe(F.col("primary_verdict")), F.col("a")
    ).otherwise(F.col("b"))
    audit = F.struct(
        "primary_verdict", F.col("a.llm_provider").alias("primary_model"), "primary_explanation",
        "secondary_verdict", F.col("b.llm_provider").alias("secondary_model"), "secondary_explanation",
        "agreement", "discriminator_used", F.when(F.col("discriminator_used"), F.col("c.llm_provider")).alias("discriminator_model"), "discriminator_reasoning",
    )
    done = final.select(key, chosen.alias("e"), audit.alias("cross_check")).select(key, "e.*", "cross_check")
    missing = F.when(F.col("primary_verdict").isNull(), F.col("a")).otherwise(F.col("b"))
    left = open_.select(key, missing.alias("e")).select(key, "e.*", F.lit(None).cast(CROSS_CHECK).alias("cross_check"))
    columns = [key, *EVALUATION, "cross_check"]
    return alone.select(*columns).unionByName(done.select(*columns)).unionByName(left.select(*columns))


CROSS_CHECK = (
    "struct<primary_verdict: string, primary_model: string, primary_explanation: string, secondary_verdict: string, secondary_model: string,"
    " secondary_explanation: string, agreement: boolean, discriminator_used: boolean, discriminator_model: string, discriminator_reasoning: string>"
)
