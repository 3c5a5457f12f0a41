"""The whole check: index files, search for every rule, build prompts, evaluate, score and report."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulelens.functions.text import collection_key
from rulelens.functions.vectors import Embedder
from rulelens.operators import contexts, evaluation, indexing, repomap, reports, search
from rulelens.operators.chunking import chunk_windows, limit_size
from rulelens.operators.declarations import symbols
from rulelens.plans import answers
from rulelens.plans.answers import Models
from rulelens.session import stored
from rulelens.sources import results


OFFLINE = "offline"
#: No repository may ask for more (see ``rules.config_checks``).
MAX_CHUNKS_PER_RULE = 20


RELATED = ("source", "relevance_score", "file_content", "language", "matched_symbols", "truncated")


class Check(NamedTuple):
    hits: DataFrame
    matches: DataFrame
    prompts: DataFrame
    evaluated: DataFrame
    scored: DataFrame


def default_chunker(files: DataFrame) -> DataFrame:
    return limit_size(chunk_windows(files))


def index_files(
    files: DataFrame, model: str, strategy: str, embed: Embedder | None = None,
    chunker: Callable[[DataFrame], DataFrame] = default_chunker,
) -> DataFrame:
    """Embedded chunks of a full index, as a stored table."""
    chunks = indexing.unique_chunks(indexing.to_chunks(files, chunker, model, strategy))
    return stored(search.embed_texts(chunks, "content", embed=embed), "index")


def rule_queries(rules: DataFrame, model: str, strategy: str, embed: Embedder | None = None) -> DataFrame:
    """Query vectors of rules ``(query_id, repo, rule_text)``."""
    keyed = rules.select(
        "query_id",
        *[c for c in ("pr_branch", "max_hits") if c in rules.columns],
        collection_key(F.col("repo"), F.lit(model), F.lit(strategy)).alias("collection_name"),
        "rule_text",
    )
    return stored(search.embed_texts(keyed, "rule_text", "query_vec", embed).drop("rule_text"), "queries")


def check_rules(
    files: DataFrame,
    chunks: DataFrame,
    rules: DataFrame,
    evaluate: evaluation.Evaluator | Models,
    model: str,
    strategy: str,
    embed: Embedder | None = None,
    k: int = search.TOP_K,
    threshold: float = search.THRESHOLD,
    approval: float = evaluation.APPROVAL_THRESHOLD,
    branch: str | None = None,
    saved: DataFrame | None = None,
    configs: DataFrame | None = None,
    ledger: str | None = None,
) -> Check:
    """Run all rules ``(query_id, task_id, rule_idx, repo, url, rule_text)`` against the index.

    A column ``pr_branch`` of the rules names the branch layer to search per rule. ``saved`` holds the
    evaluations of earlier, interrupted runs; those rules are not sent to the evaluator again. ``configs(repo,
    max_chunks_per_rule, approval_threshold, llm_model, llm_primary_model, llm_secondary_model, enable_cross_check)`` holds repositories' own limits,
    thresholds and models, any of them; ``k``, ``approval`` and the models of ``evaluate`` hold where it has none.

    ``ledger`` is the folder of all answers so far: prompts that it holds are not sent again, and answers are added as they come.
    """
    models = evaluate if isinstance(evaluate, Models) else Models({OFFLINE: evaluate}, OFFLINE)
    tasks_of = rules.select("task_id", "repo").distinct()
    if configs is not None and "max_chunks_per_rule" in configs.columns:
        own = configs.select("repo", F.col("max_chunks_per_rule").alias("max_hits"))
        rules = rules.join(own, "repo", "left").withColumn("max_hits", F.coalesce("max_hits", F.lit(k)))
        k = MAX_CHUNKS_PER_RULE
    every, named = rules, rules.withColumnRenamed("rule_text", "rule")
    if saved is not None:
        rules = evaluation.remaining(named, saved).withColumnRenamed("rule", "rule_text")
    queries = rule_queries(rules, model, strategy, embed)
    hits = stored(search.search(chunks, queries, k, threshold, branch=branch), "hits")
    texts = files.select(
        collection_key(F.col("repo"), F.lit(model), F.lit(strategy)).alias("collection_name"),
        F.col("file_path").alias("source"),
        F.col("content").alias("file_text"),
    )
    matched = contexts.file_matches(hits, texts, ["collection_name", "source"])
    listed = files.select("repo", "file_path", F.length("content").alias("length"))
    declared = stored(symbols(files.filter(repomap.in_walk(F.col("file_path")))), "symbols")
    lines = stored(repomap.map_lines(listed, declared), "map-lines")
    budget = int((contexts.MAX_CONTEXT_TOKENS - contexts.RESERVED_TOKENS) * contexts.MAP_SHARE) * 4
    maps = repomap.map_heads(lines, budget)
    prompts = stored(contexts.prompts(rules, maps, matched), "prompts")
    asked = answers.in_force(prompts, models, configs).withColumnRenamed("rule_text", "rule")
    found = stored(answers.evaluate(asked, models, ledger), "answers")
    evaluated = rules.select("query_id", "task_id", "rule_idx", F.col("rule_text").alias("rule")).join(found, "query_id")
    if saved is not None:
        kept = evaluation.restore(named.select("query_id", "task_id", "rule_idx", "rule"), saved).filter("restored")
        evaluated = evaluated.unionByName(kept.drop("restored"), allowMissingColumns=True)
    scores = evaluation.scores(every.select("task_id").distinct(), evaluated)
    if configs is None or "approval_threshold" not in configs.columns:
        scores = scores.withColumn("approval_threshold", F.lit(approval))
    else:
        own = tasks_of.join(configs.select("repo", "approval_threshold"), "repo").groupBy("task_id").agg(F.max("approval_threshold").alias("_own"))
        scores = scores.join(own, "task_id", "left").withColumn("approval_threshold", F.coalesce("_own", F.lit(approval))).drop("_own")
    scored = evaluation.approve(scores)
    return Check(hits, matched, prompts, evaluated, scored)


def evaluate_pairs(
    prompts: DataFrame,
    primary: evaluation.Evaluator,
    secondary: evaluation.Evaluator,
    adjudicator: evaluation.Evaluator,
    ledger: str | None = None,
) -> DataFrame:
    """Cross-check of all prompts ``(query_id, rule_text, prompt)``: two evaluators, a third one where they disagree."""
    models = Models({"primary": primary, "secondary": secondary, "adjudicator": adjudicator}, "primary", "secondary", "adjudicator")
    asked = prompts.select(
        "query_id", "prompt", F.col("rule_text").alias("rule"), F.lit(True).alias("cross_check"), F.lit(models.primary).alias("model"), F.lit(models.secondary).alias("second_model")
    )
    done = answers.evaluate(asked, models, ledger)
    return done.select("query_id", F.col("verdict").alias("final_verdict"), "explanation", "tokens_used", "cross_check.*")


def result_documents(check: Check, embedding_model: str, strategy: str) -> DataFrame:
    """The result of every task as JSON ``(task_id, part, result)``: rules with their files, evaluation and cross-check."""
    files = check.matches.groupBy("query_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("relevance_score")).alias("by"), F.col("source"), *[c for c in RELATED if c != "source"]))),
            lambda f: F.struct(f["source"].alias("file_path"), *[f[c].alias(c) for c in RELATED if c != "source"]),
        ).alias("related_files")
    )  # a query has at most MAX_CHUNKS_PER_RULE files
    evaluation_ = F.struct("verdict", "explanation", "suggestions", "llm_provider", "tokens_used").alias("evaluation")
    validations = check.evaluated.select("query_id", "task_id", "rule_idx", "rule", evaluation_, "cross_check").join(files, "query_id", "left")
    nested = results.nest(validations)
    return results.to_json(nested.withColumns({"embedding_model": F.lit(embedding_model), "chunking_strategy": F.lit(strategy)})).select("task_id", "part", "result")


def report(check: Check, numbers: DataFrame | None = None) -> DataFrame:
    """Report bodies and status lines of a check; ``numbers(task_id, eval_no)`` numbers the evaluations of a pull request."""
    lines = stored(reports.report_lines(check.evaluated.withColumnRenamed("verdict", "final_verdict")), "report-lines")
    if numbers is None:
        numbered = check.scored.withColumn("eval_no", F.lit(1))
    else:
        numbered = check.scored.join(numbers, "task_id", "left").withColumn("eval_no", F.coalesce("eval_no", F.lit(1)))
    bodies = reports.report_bodies(numbered, lines)
    return reports.status_lines(check.scored).join(bodies, "task_id")
