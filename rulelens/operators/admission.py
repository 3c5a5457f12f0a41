"""Events of the code host and of running tasks: admission, state, routing, installations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulelens.functions.text import clone_url
from rulelens.operators.numbering import number_within
from rulelens.operators.rules import owner_of_repo, rule_lists
from rulelens.operators.tasks import with_config

# Handled actions, and the status that an event type implies.
HANDLED = ("opened", "synchronize", "reopened")
EVENT_STATUS = {
    "task_completed": "completed",
    "task_failed": "failed",
    "task_requeued": "pending",
    "task_progress": "running",
}
INSTALL, UNINSTALL = ("created", "unsuspend"), ("deleted", "suspend")
PULL_REQUEST = ["repository_full_name", "pr_number"]


def policies(rules: DataFrame, users: DataFrame, configs: DataFrame) -> DataFrame:
    """One row per repository with rules: owner, configuration in force, and whether the owner has rules for it."""
    owners = owner_of_repo(rules, users).select("repository_full_name", "user_id")
    configured = with_config(owners, configs, "")
    lists = rules.select("user_id", "repository_full_name").distinct().withColumn("has_rules", F.lit(True))
    return configured.join(lists, ["user_id", "repository_full_name"], "left")


def with_static_reason(events: DataFrame, rules: DataFrame, users: DataFrame, configs: DataFrame) -> DataFrame:
    """Join the policy of the repository, and name the first reason that does not depend on the count.

    ``reason`` is tested in order: action, owner, disabled. ``no_rules`` is kept apart, because the
    count of earlier evaluations is tested before it.
    """
    reason = (
        F.when(~F.col("action").isin(*HANDLED), "action not handled")
        .when(F.col("user_id").isNull(), "no owner")
        .when(~F.col("pr_evaluation_enabled"), "disabled")
    )
    return (
        events.join(policies(rules, users, configs), "repository_full_name", "left")
        .withColumn("reason", reason)
        .withColumn("no_rules", F.col("has_rules").isNull())
        .drop("has_rules")
    )


def admit(events: DataFrame, rules: DataFrame, users: DataFrame, configs: DataFrame, existing: DataFrame) -> DataFrame:
    """Decide every pull-request event ``(event_id, ts, ...)``, given ``existing(repository_full_name, pr_number, n)``.

    Events that pass the other tests are counted in time order, whatever the configured cap is; those
    beyond it are dropped with a reason. Numbers come day by day, so that a pull request with very
    many events is not one task.
    """
    marked = with_static_reason(events, rules, users, configs)
    open_ = marked.filter(F.col("reason").isNull() & ~F.col("no_rules"))
    order = [F.col("ts"), F.col("event_id")]
    first = number_within(open_.select("event_id", "ts", *PULL_REQUEST), PULL_REQUEST, order, F.to_date("ts"), "_n").select(
        "event_id", (F.col("_n") + 1).alias("_n")
    )
    numbered = marked.join(first, "event_id", "left").join(existing, PULL_REQUEST, "left")
    before = F.coalesce("n", F.lit(0))
    full = F.when(F.col("no_rules"), before >= F.col("max_evaluations_per_pr")).otherwise(
        F.coalesce(before + F.col("_n") > F.col("max_evaluations_per_pr"), F.lit(True))
    )
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(full, "max evaluations reached")
        .when(F.col("no_rules"), "no rules")
    )
    return (
        numbered.withColumn("reason", reason)
        .withColumn("admitted", F.col("reason").isNull())
        .withColumn("eval_no", F.when(F.col("admitted"), before + F.col("_n")))
        .drop("_n", "n", "no_rules")
    )


def new_tasks(decided: DataFrame, rules: DataFrame) -> DataFrame:
    """Task rows for the admitted events, one for each part of the owner's rule list."""
    listed = decided.filter("admitted").join(rule_lists(rules), ["user_id", "repository_full_name"])
    return listed.select(
        F.col("event_id").alias("id"),
        "user_id",
        clone_url(F.col("repository_full_name")).alias("repository_url"),
        "repository_full_name",
        "part",
        "rules",
        F.lit("pending").alias("status"),
        "enable_cross_check",
        F.col("installation_id").alias("github_installation_id"),
        "pr_number",
        F.col("head_sha").alias("pr_head_sha"),
        F.col("head_ref").alias("pr_head_ref"),
        F.col("author").alias("pr_author"),
        F.col("ts").alias("created_at"),
    )


def task_state(events: DataFrame) -> DataFrame:
    """State of every task after all its events: status of the last event, last known progress and message.

    Three ordered maxima with map-side combine; nulls do not overwrite.
    """
    at = F.struct("ts", "event_id")
    status = F.element_at(F.create_map(*[F.lit(x) for p in EVENT_STATUS.items() for x in p]), F.col("type"))
    known = events.withColumn("_status", status)

    def last(column: str):
        return F.max_by(column, F.when(F.col(column).isNotNull(), at))

    return known.groupBy("task_id").agg(
        last("_status").alias("status"),
        last("progress").alias("progress"),
        last("message").alias("message"),
        F.count("*").alias("events"),
    )


def route(events: DataFrame, connections: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Deliveries ``(event_id, connection_id)``: connections ``(connection_id, user_id)`` of the event's user.

    A connection gets the events of its subscribed tasks, or all events when it has no subscription.
    """
    open_ = connections.join(subscriptions.select("connection_id"), "connection_id", "left_anti")
    every = events.join(open_, "user_id").select("event_id", "connection_id")
    chosen = connections.join(subscriptions, "connection_id")
    some = events.join(chosen, ["user_id", "task_id"]).select("event_id", "connection_id")
    return every.unionByName(some)


def installations_after(events: DataFrame, users: DataFrame) -> DataFrame:
    """Installations that exist after all events ``(event_id, ts, installation_id, action, sender_login, account_login)``.

    Only installs by known users and removals count; the last one per installation decides. The user of
    the first install since the last removal stays the owner, as an update only changes the account.
    """
    known = users.select(F.col("login").alias("sender_login"), "user_id")
    acts = events.join(known, "sender_login", "left").filter(
        F.col("action").isin(*UNINSTALL) | (F.col("action").isin(*INSTALL) & F.col("user_id").isNotNull())
    )
    at = F.struct("ts", "event_id")
    install = F.col("action").isin(*INSTALL)
    last = acts.groupBy("installation_id").agg(
        F.max_by(F.struct(install.alias("present"), F.col("account_login")), at).alias("last"),
        F.max(F.when(~install, at)).alias("removed_at"),
    )
    present = last.filter("last.present")
    since = acts.filter(install).join(
        present.select("installation_id", "removed_at", F.col("last.account_login").alias("account")), "installation_id"
    )
    return (
        since.filter(F.col("removed_at").isNull() | (at > F.col("removed_at")))
        .groupBy("installation_id", "account")
        .agg(F.min_by("user_id", at).alias("user_id"))
        .select("installation_id", "user_id", F.col("account").alias("account_login"))
    )
