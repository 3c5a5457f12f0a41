"""Rules and repository configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulelens.functions.text import strip
from rulelens.operators.numbering import number_within

# Limits and the registry of evaluator models.
MAX_RULES = 10
MAX_RULE_CHARS = 500
RULE_PART = 1000
MODEL_COLUMNS = ("llm_model", "llm_primary_model", "llm_secondary_model")
RULE_SORT = ("position", "rule_text")
MODELS = (
    "gemini-2.5-flash",
    "gemini-3.1-flash-lite-preview",
    "azure/o4-mini",
    "azure/gpt-4o",
    "azure/gpt-4.1",
    "azure/gpt-5.1-chat",
    "azure/gpt-5.3-chat",
    "azure/gpt-5.4-nano",
)
EXPORT_PART = 1000


def is_enabled() -> Column:
    return F.coalesce(F.col("enabled"), F.lit(True))


def sort_key(column: str, order: str) -> Column:
    """Sort column of rule pages; here any order other than ``asc`` means descending."""
    c = F.col(column if column in RULE_SORT else RULE_SORT[0])
    return c.asc_nulls_last() if order.lower() == "asc" else c.desc_nulls_first()


def with_total(page: DataFrame, rules: DataFrame) -> DataFrame:
    """Add to each row of a page the number of all rules of its list."""
    totals = rules.groupBy("user_id", "repository_full_name").agg(F.count("*").alias("total"))
    return page.join(totals, ["user_id", "repository_full_name"])


def owner_of_repo(rules: DataFrame, users: DataFrame) -> DataFrame:
    """The known user with the earliest rule of each repository."""
    known = rules.join(users, "user_id")
    first = F.min_by(F.struct("user_id", "login"), F.struct("created_at", "id")).alias("owner")
    return known.groupBy("repository_full_name").agg(first).select("repository_full_name", "owner.*")


def append_rules(new: DataFrame, rules: DataFrame, order: list[str], bucket: Column) -> DataFrame:
    """Give new rules the positions after the last one of their list."""
    last = rules.groupBy("user_id", "repository_full_name").agg(F.max("position").alias("_last"))
    numbered = number_within(new, ["user_id", "repository_full_name"], [F.col(c) for c in order], bucket, "_n")
    return (
        numbered.join(last, ["user_id", "repository_full_name"], "left")
        .withColumn("position", F.coalesce(F.col("_last"), F.lit(-1)) + 1 + F.col("_n"))
        .drop("_last", "_n")
    )


def _numbered(rules: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``_n``, the 0-based place in the list."""
    order = [F.col("position"), F.col("id")]
    return number_within(rules, keys, order, F.floor(F.col("position") / RULE_PART), "_n")


def enabled_rules(rules: DataFrame) -> DataFrame:
    """The enabled rules of each repository, all of them, with ``rule_idx`` in list order from 0."""
    return _numbered(rules.filter(is_enabled()), ["repository_full_name"]).withColumnRenamed("_n", "rule_idx")


def rule_lists(rules: DataFrame, part_rules: int = RULE_PART) -> DataFrame:
    """Per list the enabled texts in order, in numbered parts of at most ``part_rules`` rules.

    A list without enabled rules has one empty part.
    """
    keys = ["user_id", "repository_full_name"]
    placed = _numbered(rules.filter(is_enabled()), keys).withColumn("part", F.floor(F.col("_n") / part_rules))
    parts = placed.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("_n", "rule_text"))).alias("_rules"))
    full = parts.select(*keys, "part", F.col("_rules.rule_text").alias("rules"))
    none = rules.groupBy(*keys).agg(F.bool_or(is_enabled()).alias("_any")).filter("not _any")
    empty = none.select(*keys, F.lit(0).cast("bigint").alias("part"), F.array().cast("array<string>").alias("rules"))
    return full.unionByName(empty)


def whole_lists(rules: DataFrame) -> DataFrame:
    """Per list all enabled texts in order, in one row; the parts of :func:`rule_lists` put together."""
    parts = F.array_sort(F.collect_list(F.struct("part", "rules")))
    return rule_lists(rules).groupBy("user_id", "repository_full_name").agg(F.flatten(parts["rules"]).alias("rules"))


def with_rules(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """New tasks with their rule list, a row for each part; a request without any rule gives no task."""
    return requests.join(rule_lists(rules), ["user_id", "repository_full_name"])


def patch(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Overwrite the fields that ``changes(id, user_id, rule_text, enabled)`` sets, for the owner only."""
    new = changes.select("id", "user_id", F.col("rule_text").alias("_text"), F.col("enabled").alias("_enabled"))
    return (
        rules.join(new, ["id", "user_id"], "left")
        .withColumn("rule_text", F.coalesce("_text", "rule_text"))
        .withColumn("enabled", F.coalesce("_enabled", "enabled"))
        .drop("_text", "_enabled")
    )


def delete(rules: DataFrame, keys: DataFrame) -> DataFrame:
    return rules.join(keys.select("id", "user_id"), ["id", "user_id"], "left_anti")


def within_slots(rules: DataFrame, limit: int = MAX_RULES) -> DataFrame:
    """The rules of each repository that fit its limit, in list order; ``slot`` starts at 1."""
    w = Window.partitionBy("repository_full_name").orderBy("position", "id")
    return rules.withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= limit)


def violations(checks: dict[str, Column]) -> Column:
    """Names of the checks a row fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items()]))


def config_checks() -> dict[str, Column]:
    return {
        "max_evaluations_per_pr": F.col("max_evaluations_per_pr").between(1, 20),
        "approval_threshold": F.col("approval_threshold").between(0.0, 1.0),
        "max_chunks_per_rule": F.col("max_chunks_per_rule").between(1, 20),
        **{c: F.col(c).isNull() | F.col(c).isin(*MODELS) for c in MODEL_COLUMNS},
    }


def rule_checks() -> dict[str, Column]:
    return {"rule_text": F.length("rule_text").between(1, MAX_RULE_CHARS)}


def import_rules(requests: DataFrame, limit: int = MAX_RULES) -> DataFrame:
    """Plan rule imports ``(request_id, existing, body)``, ``body`` being ``{"rules": [...]}``.

    Entries beyond the free slots are skipped first; blanks among the rest use up their slot.
    """
    incoming = F.from_json("body", "struct<rules:array<string>>")["rules"]
    planned = requests.withColumn("_incoming", incoming).withColumn(
        "_slots", F.greatest(F.lit(limit) - F.col("existing"), F.lit(0)).cast("int")
    )
    usable = F.coalesce(F.size("_incoming"), F.lit(0)) > 0
    taken = F.slice("_incoming", F.lit(1), F.col("_slots"))
    texts = F.transform(taken, lambda t: F.left(strip(F.coalesce(t, F.lit("null"))), F.lit(MAX_RULE_CHARS)))
    return (
        planned.withColumn("texts", F.filter(texts, lambda t: t != ""))
        .select(
            "request_id",
            F.when(~usable, "invalid").when(F.col("_slots") == 0, "full").otherwise("ok").alias("state"),
            F.when(usable & (F.col("_slots") > 0), F.size("texts")).otherwise(0).alias("added"),
            F.when(usable & (F.col("_slots") > 0), F.greatest(F.size("_incoming") - F.col("_slots"), F.lit(0)))
            .otherwise(0)
            .alias("skipped"),
            F.when(usable, F.col("texts")).otherwise(F.array().cast("array<string>")).alias("texts"),
        )
    )


def export_rules(rules: DataFrame, part: int = EXPORT_PART) -> DataFrame:
    """Rule lists as JSON in list order; lists longer than ``part`` come in several numbered bodies."""
    keys = ["user_id", "repository_full_name"]
    bucket = F.floor(F.col("position") / 1000)
    numbered = number_within(rules, keys, [F.col("position"), F.col("id")], bucket, "_n")
    return (
        numbered.withColumn("part", F.floor(F.col("_n") / part))
        .groupBy(*keys, "part")
        .agg(F.array_sort(F.collect_list(F.struct("_n", "rule_text"))).alias("_r"))
        .select(*keys, "part", F.to_json(F.struct(F.col("_r.rule_text").alias("rules"))).alias("body"))
    )
