"""Every operator as one bulk query over the given tables: ``name -> function(spark, folder)``."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulelens.functions import text as x
from rulelens.functions import verdicts as v
from rulelens.functions import vectors
from rulelens.operators import (
    activity,
    admission,
    chunking,
    contexts,
    contributors,
    declarations,
    evaluation,
    indexing,
    numbering,
    repomap,
    reports,
    rules,
    search,
    tasks,
)
from rulelens.plans import index_commit, validate
from rulelens.plans.answers import Models
from rulelens.session import dropped, run_dir, stored
from rulelens.sources import files as file_source
from rulelens.sources import hash_log, results, vector_table, views, webhooks
from rulelens.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SEARCH_K = 20
GLOBAL_MODEL = "gemini-2.5-flash"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def nullable(df: DataFrame, *columns: str) -> DataFrame:
    """Whole numbers that may be null as doubles, the one type both engines hand over alike."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def as_of(text: str = views.AS_OF):
    return F.expr(text)


# ---------------------------------------------------------------- sources and sinks


@query
def s1_code_paths(spark, folder):
    """Which paths the code scan reads, with the rule as meant and as it is below the root only."""
    return _paths(spark, folder).select(
        "doc_id",
        "path",
        (file_source.is_code(F.col("path")) & ~file_source.is_excluded(F.col("path"))).alias("read"),
        (file_source.is_code(F.col("path")) & ~file_source.is_excluded(F.col("path"), True)).alias("read_below_root"),
    )


def _paths(spark, folder) -> DataFrame:
    return views.table(spark, folder, "documents").selectExpr(
        "doc_id",
        "concat(case doc_id % 7 when 0 then 'node_modules/' when 1 then 'a/node_modules/b/' when 2 then 'data/'"
        " when 3 then 'src/data/' when 4 then 'build/' when 5 then '' else 'src/.hidden/' end,"
        " case doc_id % 11 when 0 then 'Dockerfile' when 1 then 'x.PY' when 2 then 'package-lock.json'"
        " when 3 then 'logo.png' when 4 then '.env.example' when 5 then 'Makefile' when 6 then '.py'"
        " when 7 then concat(doc_id, '.cs') else concat(lang, '.py') end) as path",
    )


@query
def s2_map_paths(spark, folder):
    return _paths(spark, folder).select("doc_id", "path", repomap.in_map(F.col("path")).alias("listed"))


@query
def s3_rule_scan(spark, folder):
    return views.rules(spark, folder).select("id", "user_id", "repository_full_name", "rule_text", "position", "enabled")


@query
def s4_vector_table(spark, folder):
    """The chunk table written by partition and the main layer read back."""
    path = f"{run_dir(spark)}/chunks-{uuid.uuid4().hex}"
    vector_table.write_partitions(views.chunk_vectors(spark, folder), path)
    main = vector_table.read(spark, path, branches=[""])
    return main.select(
        "collection_name", "branch", "chunk_hash", "source", F.col("start_line").cast("bigint").alias("start_line"), "content"
    )


@query
def s5_rule_import(spark, folder):
    plan = rules.import_rules(_imports(spark, folder))
    return plan.select(
        "request_id", "state", F.col("added").cast("bigint"), F.col("skipped").cast("bigint"),
        F.array_join("texts", "|").alias("texts"),
    )


def _imports(spark, folder) -> DataFrame:
    """One import per document: its lines are the rules; the list has some rules already."""
    return views.table(spark, folder, "documents").select(
        F.col("doc_id").alias("request_id"),
        (F.col("doc_id") % 12).alias("existing"),
        F.to_json(F.struct(F.split("text", "\n").alias("rules"))).alias("body"),
    )


@query
def s6_rule_export(spark, folder):
    return rules.export_rules(views.rules(spark, folder), 40)


@query
def s7_webhook_payloads(spark, folder):
    """Pull-request events written as payload files and read with the payload schema."""
    path = f"{run_dir(spark)}/payloads-{uuid.uuid4().hex}"
    payloads(views.pr_events(spark, folder)).write.json(path)
    return webhooks.pull_requests(webhooks.read_payloads(spark, path))


def payloads(events: DataFrame) -> DataFrame:
    """Pull-request events in the nested form of the webhook."""
    return events.select(
        F.lit("pull_request").alias("event"),
        F.col("ts").alias("received_at"),
        "action",
        F.struct(F.col("installation_id").alias("id")).alias("installation"),
        F.struct(
            F.col("repository_full_name").alias("full_name"), x.clone_url(F.col("repository_full_name")).alias("clone_url")
        ).alias("repository"),
        F.struct(
            F.col("pr_number").alias("number"),
            F.struct(F.col("head_sha").alias("sha"), F.col("head_ref").alias("ref")).alias("head"),
            F.struct(F.col("author").alias("login")).alias("user"),
        ).alias("pull_request"),
    )


@query
def s8_results(spark, folder):
    """Results to JSON, back through the reader, one row per rule."""
    parsed = results.parse(results.to_json(_task_results(spark, folder)))
    return parsed.select("task_id", F.explode("parsed.validations").alias("_v")).select(
        "task_id", "_v.rule", "_v.evaluation.verdict", "_v.evaluation.tokens_used",
        F.size("_v.related_files").cast("bigint").alias("related_files"),
        F.col("_v.related_files")[0]["file_path"].alias("first_file"), "_v.cross_check.secondary_verdict", "_v.cross_check.agreement",
    )


def _task_results(spark, folder) -> DataFrame:
    """Nested results with the files and the cross-check of every rule."""
    path = F.concat(F.lit("f"), F.col("task_id").cast("string"))
    file = F.struct(path.alias("file_path"), F.lit(0.5).alias("relevance_score"))
    rows = views.validations(spark, folder).withColumns(
        {
            "evaluation": F.struct(F.col("primary_verdict").alias("verdict"), "explanation", "tokens_used"),
            "related_files": F.when(F.col("l_linestatus") == "F", F.array(file)).otherwise(F.array(file, file)),
            "cross_check": F.struct(
                "primary_verdict", "secondary_verdict", (F.col("primary_verdict") == F.col("secondary_verdict")).alias("agreement")
            ),
        }
    )
    return results.nest(rows)


def _with_results(t: DataFrame) -> DataFrame:
    return t.withColumn("result", F.when(F.col("has_result"), F.concat(F.lit("result "), F.col("id").cast("string"))))


@query
def s9_outcomes(spark, folder):
    """Outcome rows of open tasks, applied to the task table."""
    t = _with_results(views.tasks(spark, folder))
    finished = t.filter(~tasks.is_terminal(F.col("status"))).selectExpr(
        "id as task_id", "'{}' as result", "case when id % 5 = 0 then 'boom' end as error",
        "created_at + interval 60 seconds as at",
    )
    rows = results.outcomes(finished.withColumnRenamed("at", "completed_at"), F.col("completed_at"))
    state = results.current_state(t, rows)
    return state.select("id", "status", F.col("progress").cast("bigint"), "progress_message", "result", "error", "completed_at")


@query
def s10_report_rows(spark, folder):
    return reports.status_lines(_approved(spark, folder))


# ---------------------------------------------------------------- filters and projections


@query
def f1_task_filter(spark, folder):
    """Requests of all users: failed tasks, then those of one author."""
    requests = views.users(spark, folder).selectExpr(
        "user_id", "'' as repository", "explode(array('', 'dev7')) as author", "'failed' as status"
    ).selectExpr("user_id * 2 + case when author = '' then 0 else 1 end as request_id", "*")
    found = tasks.filter_for_requests(views.tasks(spark, folder), requests)
    return found.select("request_id", "id", "user_id", "pr_author", "status")


@query
def f2_enabled_rules(spark, folder):
    return views.rules(spark, folder).filter(rules.is_enabled()).select("id", "rule_text", "enabled")


@query
def f3_metadata_filter(spark, folder):
    chosen = search.filter_metadata(
        views.chunk_vectors(spark, folder),
        {"language": "python", "tree_sitter_type": "function_definition", "unknown": "x"},
    )
    return chosen.select("vec_id", "language", "node_type")


@query
def f4_threshold(spark, folder):
    hits = search.search(views.chunk_vectors(spark, folder), _queries(spark, folder), k=5, threshold=0.15)
    return hits.select("query_id", "chunk_hash", "similarity")


@query
def f5_ready_tasks(spark, folder):
    return views.tasks(spark, folder).filter(tasks.is_ready(as_of())).select("id", "status", "retry_after")


@query
def f6_author_contains(spark, folder):
    found = contributors.author_contains(contributors.all_contributors(views.tasks(spark, folder)), "DEV1")
    return found.select("user_id", "pr_author", "total_submissions")


@query
def f7_language(spark, folder):
    files = views.current_files(spark, folder).unionByName(views.code_files(spark, folder).drop("k"))
    return files.select("repo", "file_path", x.language_of(F.col("file_path")).alias("language"))


@query
def f8_task_summary(spark, folder):
    return nullable(tasks.summary(views.tasks(spark, folder)), "pr_number").withColumn(
        "progress", F.col("progress").cast("bigint")
    )


@query
def f8_task_detail(spark, folder):
    lists = rules.whole_lists(views.rules(spark, folder))
    listed = _with_results(views.tasks(spark, folder)).join(lists, ["user_id", "repository_full_name"], "left")
    return nullable(tasks.detail(listed), "pr_number").withColumns(
        {"progress": F.col("progress").cast("bigint"), "rules": F.nullif(F.array_join("rules", "|"), F.lit(""))}
    )


@query
def f9_verdicts(spark, folder):
    raw = views.table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "case l_linenumber when 1 then 'PASS' when 2 then 'Fail' when 3 then 'partial' when 4 then '' "
        "when 5 then null else l_returnflag end as raw"
    )
    return raw.select(v.normalise(F.col("raw")).alias("verdict"), "raw").groupBy("raw", "verdict").agg(F.count("*").alias("n"))


@query
def f10_terminal(spark, folder):
    t = views.tasks(spark, folder)
    return t.groupBy("status", tasks.is_terminal(F.col("status")).alias("terminal")).agg(F.count("*").alias("n"))


@query
def f11_config_violations(spark, folder):
    found = rules.violations(rules.config_checks())
    return views.config_requests(spark, folder).select("version", F.array_join(found, ",").alias("violations"))


@query
def f11_rule_violations(spark, folder):
    texts = views.table(spark, folder, "documents").selectExpr("doc_id", "text as rule_text")
    return texts.select("doc_id", F.array_join(rules.violations(rules.rule_checks()), ",").alias("violations"))


# ---------------------------------------------------------------- joins


@query
def j1_indexed_repositories(spark, folder):
    found = indexing.indexed_repos(
        views.repositories(spark, folder), views.indexed_repositories(spark, folder), views.MODEL, views.STRATEGY
    )
    return found.select("repository_id", "full_name", "collection_name")


@query
def j2_stored_hashes(spark, folder):
    return indexing.stored_hashes(
        _hash_rows(spark, folder),
        views.repositories(spark, folder),
        views.indexed_repositories(spark, folder),
        views.MODEL,
        views.STRATEGY,
    )


def _hash_rows(spark, folder) -> DataFrame:
    return indexing.file_hashes(views.stored_files(spark, folder)).selectExpr(
        "cast(substring(repo, 4) as bigint) * 2 as indexed_repository_id", "file_path", "content_hash"
    )


@query
def j3_repo_contributors(spark, folder):
    return contributors.repo_contributors(views.tasks(spark, folder))


@query
def j4_all_contributors(spark, folder):
    return contributors.all_contributors(views.tasks(spark, folder))


@query
def j5_contributor_results(spark, folder):
    counts = evaluation.verdict_counts(views.lines(spark, folder), ["task_id"], "primary_verdict")
    stats = contributors.repo_stats(views.tasks(spark, folder))
    return nullable(contributors.with_verdicts(stats, counts), "best_task_id", "best_pr_number")


@query
def j6_repo_owner(spark, folder):
    return rules.owner_of_repo(views.rules(spark, folder), views.users(spark, folder))


@query
def j7_visible_tasks(spark, folder):
    return tasks.visible(_requests(spark, folder), views.tasks(spark, folder), views.task_viewers(spark, folder))


def _requests(spark, folder) -> DataFrame:
    return views.table(spark, folder, "lineitem").selectExpr("l_orderkey as task_id", "l_partkey % 7 as user_id").distinct()


@query
def j8_config_in_force(spark, folder):
    repos = views.repositories(spark, folder).selectExpr("id div 4 as user_id", "full_name as repository_full_name")
    found = tasks.with_config(repos, views.repo_configs(spark, folder), GLOBAL_MODEL, "azure/gpt-4.1", "azure/gpt-4o")
    return found.withColumn("max_chunks_per_rule", F.col("max_chunks_per_rule").cast("bigint")).withColumn(
        "max_evaluations_per_pr", F.col("max_evaluations_per_pr").cast("bigint")
    )


def _changes(spark, folder) -> DataFrame:
    return indexing.diff(
        indexing.file_hashes(views.current_files(spark, folder)), indexing.file_hashes(views.stored_files(spark, folder))
    )


@query
def j9_snapshot_diff(spark, folder):
    return _changes(spark, folder)


@query
def j10_delete_sources(spark, folder):
    """Chunks of sources whose document was labelled toxic leave the main layer."""
    kept = indexing.delete_by_sources(views.chunk_vectors(spark, folder), _stale(spark, folder))
    return kept.select("collection_name", "branch", "source", "chunk_hash")


def _stale(spark, folder) -> DataFrame:
    toxic = views.table(spark, folder, "labels").filter("toxic = 1").selectExpr("concat('f', doc_id) as source")
    return views.chunk_vectors(spark, folder).select("collection_name", "source").distinct().join(toxic, "source", "left_semi")


@query
def j10_delete_branch(spark, folder):
    chunks = views.chunk_vectors(spark, folder)
    done = chunks.filter("language = 'python'").select("collection_name").distinct()
    kept = indexing.delete_branch(chunks, done, "pr-1")
    return kept.groupBy("collection_name", "branch").agg(F.count("*").alias("n"))


@query
def j10_delete_hashes(spark, folder):
    """Hash rows of deleted files go, through the index entry of their repository."""
    entries = indexing.indexed_repos(
        views.repositories(spark, folder), views.indexed_repositories(spark, folder), views.MODEL, views.STRATEGY
    )
    gone = (
        _changes(spark, folder)
        .filter("change = 'deleted'")
        .selectExpr("cast(substring(repo, 4) as bigint) as repository_id", "file_path")
        .join(entries.select("repository_id", "url"), "repository_id")
        .select("url", "file_path")
    )
    return indexing.delete_hashes(_hash_rows(spark, folder), entries, gone)


def _queries(spark, folder) -> DataFrame:
    """Query vectors: all enabled rules, each for one collection."""
    admitted = rules.enabled_rules(views.rules(spark, folder)).selectExpr(
        "id as query_id", "concat('c', repo_no % 10) as collection_name", "'' as branch", "rule_text"
    )
    embed = vectors.hash_embedder(views.EMBEDDING_DIMS)
    return stored(search.embed_texts(admitted, "rule_text", "query_vec", embed).drop("rule_text"), "queries")


@query
def j11_similarity_join(spark, folder):
    found = search.nearest(
        views.chunk_vectors(spark, folder).filter("branch = ''"), _queries(spark, folder), SEARCH_K
    )
    return found.select("query_id", "collection_name", "chunk_hash", "similarity")


@query
def j11_similarity_blocks(spark, folder):
    """The same search within every branch layer instead of the main one."""
    layers = views.chunk_vectors(spark, folder).filter("branch <> ''")
    asked = _queries(spark, folder).drop("branch").withColumn("branch", F.lit("pr-1"))
    found = search.nearest(layers, asked, SEARCH_K)
    return found.select("query_id", "collection_name", "chunk_hash", "similarity")


def _saved(spark, folder) -> DataFrame:
    return views.validations(spark, folder).filter("l_linestatus = 'F'").selectExpr(
        "task_id", "rule_idx", "case when l_tax > 0.07 then concat(rule, ' (old)') else rule end as rule",
        "primary_verdict as verdict", "explanation",
    )


@query
def j12_resume(spark, folder):
    todo = views.validations(spark, folder).select("task_id", "rule_idx", "rule")
    return evaluation.restore(todo, _saved(spark, folder))


@query
def j12_remaining(spark, folder):
    todo = views.validations(spark, folder).select("task_id", "rule_idx", "rule")
    return evaluation.remaining(todo, _saved(spark, folder))


def _hits(spark, folder) -> DataFrame:
    found = search.search(views.chunk_vectors(spark, folder), _queries(spark, folder), SEARCH_K, threshold=0.0)
    return stored(found, "hits")


@query
def j13_file_text(spark, folder):
    joined = contexts.with_file_text(contexts.group_hits(_hits(spark, folder)), views.context_files(spark, folder), ["source"])
    return joined.select("query_id", "source", "found", F.md5("file_text").alias("text_md5"))


@query
def j14_installation(spark, folder):
    requests = views.tasks(spark, folder).select("id", "user_id", "repository_full_name")
    return nullable(tasks.with_installation(requests, views.installations(spark, folder)), "installation_id")


@query
def j15_patch_rules(spark, folder):
    changes = views.rules(spark, folder).join(
        views.table(spark, folder, "part").select(F.col("p_partkey").alias("id"), "p_size"), "id"
    ).selectExpr(
        "id", "case when p_size % 5 = 0 then user_id + 1 else user_id end as user_id",
        "case when p_size % 3 = 0 then null else concat(rule_text, ' (new)') end as rule_text",
        "case when p_size % 4 = 1 then null else p_size % 2 = 0 end as enabled",
    )
    return rules.patch(views.rules(spark, folder), changes).select("id", "user_id", "rule_text", "enabled")


@query
def j15_delete_rules(spark, folder):
    gone = views.table(spark, folder, "part").filter("p_type = 'ECONOMY'").selectExpr(
        "p_partkey as id", "(p_partkey div 100) div 4 as user_id"
    )
    return rules.delete(views.rules(spark, folder), gone).select("id", "user_id")


# ---------------------------------------------------------------- aggregations


@query
def a1_tasks_per_filter(spark, folder):
    return tasks.count_by(views.tasks(spark, folder), ["user_id", "repository_full_name", "pr_author", "status"])


@query
def a1_rules_per_repo(spark, folder):
    return tasks.count_by(views.rules(spark, folder), ["user_id", "repository_full_name"])


@query
def a1_tasks_per_pr(spark, folder):
    return tasks.count_by(views.tasks(spark, folder).filter("pr_number is not null"), ["repository_full_name", "pr_number"])


@query
def a1_chunks_per_collection(spark, folder):
    return tasks.count_by(views.chunk_vectors(spark, folder), ["collection_name"])


@query
def a2_submissions(spark, folder):
    return contributors.submissions(views.tasks(spark, folder))


@query
def a3_author_counts(spark, folder):
    return contributors.all_contributors(views.tasks(spark, folder)).select(
        "user_id", "pr_author", "total_submissions", "completed_submissions", "repo_count"
    )


@query
def a4_repo_stats(spark, folder):
    return nullable(contributors.repo_stats(views.tasks(spark, folder)), "best_task_id", "best_pr_number")


@query
def a5_verdict_counts(spark, folder):
    return evaluation.verdict_counts(_reconciled(spark, folder), ["task_id"], "final_verdict")


@query
def a5_nested_counts(spark, folder):
    return evaluation.nested_counts(_task_results(spark, folder))


@query
def a6_shown_counts(spark, folder):
    return evaluation.shown_counts(views.lines(spark, folder), ["task_id"], "adjudicated_verdict")


def _scored(spark, folder) -> DataFrame:
    done = views.tasks(spark, folder).filter("status = 'completed'").selectExpr(
        "id as task_id", "user_id", "repository_full_name"
    )
    return evaluation.scores(done, _reconciled(spark, folder), "final_verdict")


def _reconciled(spark, folder) -> DataFrame:
    return evaluation.reconcile(views.lines(spark, folder))


def _approved(spark, folder) -> DataFrame:
    return evaluation.approve(
        tasks.with_config(_scored(spark, folder), views.repo_configs(spark, folder), GLOBAL_MODEL)
    )


@query
def a7_scores(spark, folder):
    return _scored(spark, folder).select("task_id", "rules", F.round("score", 6).alias("score"), F.round("ui_score", 6).alias("ui_score"))


@query
def a8_approval(spark, folder):
    return _approved(spark, folder).select("task_id", "approval_threshold", "approved", "pct")


@query
def a9_contributor_totals(spark, folder):
    found = contributors.totals(contributors.repo_stats(views.tasks(spark, folder)))
    return found.withColumn("level", F.col("level").cast("bigint"))


@query
def a10_verdict_share(spark, folder):
    counts = evaluation.verdict_counts(views.lines(spark, folder), ["task_id"], "primary_verdict")
    stats = contributors.with_verdicts(contributors.repo_stats(views.tasks(spark, folder)), counts)
    shares = contributors.verdict_share(stats)
    return shares.select(
        "user_id", "pr_author", "repository_full_name",
        *[F.round(c, 6).alias(c) for c in ("pass_pct", "partial_pct", "fail_pct")],
    )


@query
def a11_next_positions(spark, folder):
    placed = rules.append_rules(_new_rules(spark, folder), views.rules(spark, folder), ["conv_id", "turn"], F.col("conv_id"))
    return placed.select("user_id", "repository_full_name", "conv_id", "turn", "position")


def _new_rules(spark, folder) -> DataFrame:
    return views.table(spark, folder, "conversations").selectExpr(
        "conv_id", "turn", "text as rule_text", "(conv_id div 10) div 4 as user_id",
        "concat('org', (conv_id div 10) div 4, '/repo', conv_id div 10) as repository_full_name",
    )


@query
def a12_collections(spark, folder):
    return indexing.collection_state(views.chunk_vectors(spark, folder))


@query
def a13_hits_by_file(spark, folder):
    grouped = contexts.group_hits(_hits(spark, folder))
    return grouped.select(
        "query_id", "source", "relevance_score", "language", F.array_join("matched_symbols", ",").alias("symbols"),
        F.size("hits").cast("bigint").alias("hits"),
    )


def _activity(spark, folder, name: str) -> DataFrame:
    hours, unit = activity.RANGES[name]
    return activity.buckets(
        views.activity(spark, folder), ["repository_full_name"], as_of(views.ACTIVITY_AS_OF), hours, unit
    )


@query
def a14_activity_day(spark, folder):
    return _activity(spark, folder, "1d")


@query
def a14_activity_week(spark, folder):
    return _activity(spark, folder, "7d")


@query
def a14_activity_month(spark, folder):
    return _activity(spark, folder, "30d")


@query
def a15_dashboard(spark, folder):
    return tasks.dashboard(views.tasks(spark, folder))


@query
def a16_contributor_figures(spark, folder):
    return contributors.figures(contributors.all_contributors(views.tasks(spark, folder)))


def _sizes(spark, folder) -> DataFrame:
    files = views.current_files(spark, folder).unionByName(views.code_files(spark, folder).drop("k"))
    return files.select("repo", "file_path", F.length("content").cast("bigint").alias("length"))


@query
def a17_directories(spark, folder):
    return repomap.directories(_sizes(spark, folder))


@query
def a18_task_rules(spark, folder):
    """New tasks for all pending requests, with a digest of their rule lists."""
    requests = views.tasks(spark, folder).filter("status = 'pending'").select("id", "user_id", "repository_full_name")
    return rules.with_rules(requests, views.rules(spark, folder)).select(
        "id", "part", F.size("rules").cast("bigint").alias("n_rules"), F.md5(F.array_join("rules", "|")).alias("rules_md5")
    )


# ---------------------------------------------------------------- windows


@query
def w1_rules_with_total(spark, folder):
    all_rules = views.rules(spark, folder)
    key = rules.sort_key("position", "asc")
    page = tasks.page_per_group(all_rules, ["user_id", "repository_full_name"], key, 1, 5)
    return rules.with_total(page, all_rules).select("id", F.col("row_no").cast("bigint").alias("row_no"), "total")


@query
def w2_latest_per_author(spark, folder):
    known = views.tasks(spark, folder).filter("pr_author is not null")
    return numbering.latest_per_key(
        known, ["user_id", "pr_author"], ["created_at", "id"], ["id", "status", "created_at"]
    )


@query
def w2_latest_per_repo_author(spark, folder):
    known = views.tasks(spark, folder).filter("pr_author is not null")
    return numbering.latest_per_key(
        known, ["repository_full_name", "pr_author"], ["created_at", "id"], ["id", "status", "created_at"]
    )


@query
def w2_latest_completed(spark, folder):
    done = views.tasks(spark, folder).filter("status = 'completed' and has_result")
    latest = numbering.latest_per_key(done, ["repository_full_name"], ["created_at", "id"], ["id", "pr_number"])
    return nullable(latest, "pr_number")


@query
def w3_nearest_chunks(spark, folder):
    found = search.nearest(
        views.chunk_vectors(spark, folder).filter("branch = ''"), _queries(spark, folder), search.TOP_K
    )
    return found.select("query_id", F.col("hit_no").cast("bigint").alias("hit_no"), "chunk_hash", "similarity")


def _layers(spark, folder, merge: str) -> DataFrame:
    found = search.search(
        views.chunk_vectors(spark, folder), _queries(spark, folder), SEARCH_K, threshold=-1.0, branch="pr-1", merge=merge
    )
    return found.select("query_id", "source", "branch", "chunk_hash", "similarity")


@query
def w4_layers_last(spark, folder):
    return _layers(spark, folder, "last")


@query
def w4_layers_best(spark, folder):
    return _layers(spark, folder, "best")


@query
def w4_layers_masked(spark, folder):
    """Main layer without the sources that the branch changed."""
    chunks = views.chunk_vectors(spark, folder)
    changes = _stale(spark, folder).withColumn("change", F.lit("changed"))
    found = search.search(search.mask_changed(chunks, changes), _queries(spark, folder), SEARCH_K, -1.0, branch="pr-1")
    return found.select("query_id", "source", "branch", "chunk_hash", "similarity")


@query
def w5_upsert_configs(spark, folder):
    """All configuration requests on top of the first one per repository; the last write wins."""
    sent = views.config_requests(spark, folder).select(
        "user_id", "repository_full_name", "version", "approval_threshold", "llm_model"
    )
    keys = ["user_id", "repository_full_name"]
    first = sent.groupBy(*keys).agg(F.min_by(F.struct("version", "approval_threshold", "llm_model"), "version").alias("r"))
    return indexing.upsert(first.select(*keys, "r.*"), sent.filter("balance > 0") if "balance" in sent.columns else sent, keys, "version")


@query
def w5_upsert_hashes(spark, folder):
    old = indexing.file_hashes(views.stored_files(spark, folder))
    return indexing.upsert(old, indexing.file_hashes(views.current_files(spark, folder)), ["repo", "file_path"])


@query
def w5_upsert_known(spark, folder):
    """Repository names: a null name in the update keeps the stored one."""
    old = views.repositories(spark, folder).selectExpr("url", "case when id % 3 = 0 then null else full_name end as full_name")
    new = views.rules(spark, folder).selectExpr(
        "concat('https://github.com/', repository_full_name, '.git') as url",
        "repo_no",
        "repository_full_name",
    ).distinct().selectExpr("url", "case when repo_no % 2 = 0 then null else concat(repository_full_name, '!') end as full_name")
    return indexing.upsert_known(old, new, ["url"])


def _whole_files(spark, folder) -> DataFrame:
    grouped = contexts.with_file_text(contexts.group_hits(_hits(spark, folder)), views.context_files(spark, folder), ["source"])
    return contexts.rank_files(grouped.withColumn("file_content", F.col("file_text")))


@query
def w6_context_budget(spark, folder):
    fitted = contexts.fit_budget(_whole_files(spark, folder), F.lit(6000))
    return fitted.select(
        "query_id", F.col("file_no").cast("bigint").alias("file_no"), "source", "used", "fit",
        F.md5("shown").alias("shown_md5"),
    )


@query
def w7_line_ranges(spark, folder):
    grouped = contexts.with_file_text(contexts.group_hits(_hits(spark, folder)), views.context_files(spark, folder), ["source"])
    ranged = contexts.with_sections(grouped)
    return ranged.select("query_id", "source", F.explode("sections").alias("s")).select(
        "query_id", "source", F.col("s.start").cast("bigint").alias("start"), F.col("s.stop").cast("bigint").alias("stop")
    )


@query
def w8_rolling_calls(spark, folder):
    return activity.rolling_calls(views.call_log(spark, folder), 1)


@query
def w9_evaluation_numbers(spark, folder):
    configured = tasks.with_config(views.tasks(spark, folder), views.repo_configs(spark, folder), GLOBAL_MODEL)
    numbered = tasks.evaluation_numbers(configured, F.col("max_evaluations_per_pr"))
    return numbered.select("id", "repository_full_name", "pr_number", F.col("eval_no").cast("bigint").alias("eval_no"))


def _report_lines(spark, folder) -> DataFrame:
    return reports.report_lines(evaluation.reconcile(views.validations(spark, folder)))


@query
def w10_report_lines(spark, folder):
    return _report_lines(spark, folder).select(
        "task_id", "rule_idx", "line_no", F.col("section").cast("bigint").alias("section"), "remark"
    )


# ---------------------------------------------------------------- sort, limit, paging


@query
def t1_task_page(spark, folder):
    key = tasks.sort_key("completed_at", "desc", tasks.TASK_SORT, "created_at")
    page = tasks.page_per_group(views.tasks(spark, folder), ["user_id"], key, 2, 20)
    return page.select("user_id", "row_no", "id", "completed_at").withColumn("row_no", F.col("row_no").cast("bigint"))


@query
def t1_global_page(spark, folder):
    key = tasks.sort_key("no_such_column", "asc", tasks.TASK_SORT, "created_at")
    return tasks.page(views.tasks(spark, folder), key, 3, 25).select("id", "created_at")


@query
def t2_rule_page(spark, folder):
    key = rules.sort_key("rule_text", "desc")
    page = tasks.page_per_group(views.rules(spark, folder), ["user_id", "repository_full_name"], key, 1, 10)
    return page.select("id", "rule_text", F.col("row_no").cast("bigint").alias("row_no"))


@query
def t3_page_count(spark, folder):
    counted = tasks.count_by(views.tasks(spark, folder), ["user_id", "status"], "total")
    return counted.withColumn("pages", tasks.page_count(F.col("total"), 20))


@query
def t4_latest_tasks(spark, folder):
    found = tasks.latest_tasks(views.tasks(spark, folder), 50)
    return found.select("user_id", "id", "created_at", F.col("row_no").cast("bigint").alias("row_no"))


@query
def t5_ready_first(spark, folder):
    return tasks.ready_first(views.tasks(spark, folder), as_of(), 100).select("id", "created_at")


@query
def t6_by_last_submission(spark, folder):
    return contributors.by_last_submission(contributors.repo_contributors(views.tasks(spark, folder)))


@query
def t7_rule_slots(spark, folder):
    kept = rules.within_slots(views.rules(spark, folder))
    return kept.select("id", "repository_full_name", F.col("slot").cast("bigint").alias("slot"))


# ---------------------------------------------------------------- sets and scalars


@query
def u1_grants(spark, folder):
    return tasks.grants(views.tasks(spark, folder), views.task_viewers(spark, folder))


@query
def u2_path_sets(spark, folder):
    """Sizes of the path sets per repository, from one join."""
    return _changes(spark, folder).groupBy("repo").agg(
        *[F.count_if(F.col("change") == c).alias(c) for c in ("new", "deleted", "changed", "unchanged")]
    )


@query
def u3_layer_union(spark, folder):
    chunks = views.chunk_vectors(spark, folder)
    both = chunks.filter("branch = ''").unionByName(chunks.filter("branch = 'pr-1'"))
    return both.groupBy("collection_name", "branch").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@query
def u4_repository_names(spark, folder):
    configured = views.repositories(spark, folder).selectExpr("full_name as name", "id as pos")
    used = views.rules(spark, folder).selectExpr("repository_full_name as name", "id as pos").unionByName(
        views.activity(spark, folder).selectExpr("repository_full_name as name", "id + 1000000 as pos")
    )
    found = activity.repository_names(configured, used)
    return found.select("name", F.col("list_no").cast("bigint").alias("list_no"), "pos")


@query
def x1_content_hash(spark, folder):
    return views.table(spark, folder, "documents").select("doc_id", x.content_hash(F.col("text")).alias("content_hash"))


@query
def x2_keys(spark, folder):
    return views.stored_files(spark, folder).select(
        "file_path",
        x.chunk_key(F.col("file_path"), F.col("content")).alias("chunk_hash"),
        x.collection_key(F.col("repo"), F.lit(views.MODEL), F.lit(views.STRATEGY)).alias("collection_name"),
    )


@query
def x3_cosine(spark, folder):
    return views.table(spark, folder, "embeddings").select(
        "vec_id", vectors.cosine(F.col("embedding"), F.reverse("embedding")).alias("similarity")
    )


@query
def x4_line_span(spark, folder):
    part = F.substring(F.col("text"), (F.col("n_chars") / 2).cast("int"), F.lit(200))
    spans = views.table(spark, folder, "documents").withColumn("chunk", part)
    start = x.chunk_start(F.col("text"), F.col("chunk"))
    return spans.select(
        "doc_id",
        start.cast("bigint").alias("start_line"),
        (start + x.newlines(F.col("chunk"))).cast("bigint").alias("end_line"),
        x.stored_line(F.when(F.col("doc_id") % 2 == 0, start).otherwise(0)).cast("bigint").alias("stored_line"),
    )


@query
def x5_tokens(spark, folder):
    return views.table(spark, folder, "documents").select("doc_id", x.estimate_tokens(F.col("text")).alias("tokens"))


@query
def x6_truncate(spark, folder):
    budget = F.floor(F.col("n_chars") / 7).cast("int")
    return views.table(spark, folder, "documents").select(
        "doc_id", x.truncate_to_tokens(F.col("text"), budget).alias("cut")
    )


def digest_evaluator(salt: str = ""):
    """Stands in for a model: the verdict follows from a digest of the prompt."""

    def evaluate(texts):
        out = []
        for t in texts:
            digest = int(hashlib.md5((salt + t).encode()).hexdigest()[:8], 16)
            verdict = ("pass", "partial", "fail")[digest % 3]
            out.append('{"verdict": "%s", "explanation": "Digest %d. Offline.", "suggestions": []}' % (verdict, digest))
        return out

    return evaluate


offline_evaluator = digest_evaluator()
#: Models that differ from one another, by name.
MODELS = Models({name: digest_evaluator(name) for name in ("small", "large", "second", "judge")}, "small", "second", "judge")


def whole_check(spark, folder, models=offline_evaluator, configs=None, chunker=validate.default_chunker, ledger=None) -> validate.Check:
    """The full pipeline over the documents of every source, with all enabled rules of its repository."""
    files = views.current_files(spark, folder)
    chunks = validate.index_files(files, views.MODEL, views.STRATEGY, chunker=chunker)
    asked = rules.enabled_rules(views.rules(spark, folder)).selectExpr(
        "id as query_id", "repo_no as task_id", "rule_idx", "concat('src', repo_no) as repo",
        "concat('https://github.com/', repository_full_name, '.git') as url", "rule_text",
    )
    return validate.check_rules(
        files, chunks, asked, models, views.MODEL, views.STRATEGY, k=search.TOP_K, threshold=0.0, configs=configs, ledger=ledger
    )


def _model_configs(spark, folder) -> DataFrame:
    """Every third repository has a model of its own, every third one a second opinion."""
    return views.current_files(spark, folder).select("repo").distinct().selectExpr(
        "repo", "case when cast(substr(repo, 4) as int) % 3 = 0 then 'large' end as llm_model",
        "cast(substr(repo, 4) as int) % 3 = 1 as enable_cross_check",
        "case when cast(substr(repo, 4) as int) % 2 = 0 then 0.5d end as approval_threshold",
    )


@query
def x7_prompts(spark, folder):
    return whole_check(spark, folder).prompts.select(
        "query_id", F.length("prompt").cast("bigint").alias("chars"), F.md5("prompt").alias("prompt_md5")
    )


@query
def x8_parse_response(spark, folder):
    parsed = views.raw_responses(spark, folder).select("doc_id", v.parse_response(F.col("raw")).alias("p"))
    return parsed.select(
        "doc_id", "p.verdict", "p.explanation", F.size("p.suggestions").cast("bigint").alias("suggestions"), "p.error_code"
    )


@query
def x9_parse_error(spark, folder):
    return views.tasks(spark, folder).select("id", v.parse_error(F.col("error")).alias("p")).select("id", "p.*")


@query
def x10_file_header(spark, folder):
    """Headers of code files: the names of their declared symbols in order."""
    found = declarations.symbols(views.code_files(spark, folder))
    named = found.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("line", "name"))).alias("_s"))
    return named.select("file_path", x.file_header(F.col("file_path"), F.col("_s.name")).alias("header"))


@query
def x11_first_sentence(spark, folder):
    return views.table(spark, folder, "documents").select("doc_id", x.first_sentence(F.col("text")).alias("sentence"))


@query
def x12_report_bodies(spark, folder):
    lines = stored(_report_lines(spark, folder).select("task_id", "section", "line_no", "rule", "remark"), "report-lines", "zstd")
    numbered = reports.evaluation_totals(views.tasks(spark, folder)).selectExpr("id as task_id", "eval_no")
    return reports.report_bodies(_approved(spark, folder).join(numbered, "task_id"), lines)


@query
def x13_clips(spark, folder):
    return views.table(spark, folder, "documents").select(
        "doc_id",
        x.clip(F.col("text"), 140).alias("status_line"),
        x.preview(F.col("text")).alias("preview"),
        x.clip(F.col("text"), 500).alias("rule_text"),
    )


@query
def x14_durations(spark, folder):
    return views.tasks(spark, folder).select("id", x.duration_text(F.col("created_at"), F.col("completed_at")).alias("took"))


@query
def x15_percent_text(spark, folder):
    return _scored(spark, folder).select("task_id", x.percent_text(F.col("ui_score")).alias("shown"))


@query
def x16_owner_repo(spark, folder):
    url = F.concat(F.lit("https://user:tok"), F.col("id").cast("string"), F.lit("@example.org/"), F.col("full_name"))
    return views.repositories(spark, folder).select(
        "full_name",
        x.owner_of(F.col("full_name")).alias("owner"),
        x.repo_of(F.col("full_name")).alias("repo"),
        x.clone_url(F.col("full_name")).alias("clone_url"),
        x.strip_credentials(url).alias("safe_url"),
    )


@query
def x17_floors(spark, folder):
    return views.table(spark, folder, "events").select(
        "event_id",
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
    )


@query
def x18_backoff(spark, folder):
    return views.tasks(spark, folder).filter("status = 'failed'").select(
        "id",
        x.add_seconds(F.col("completed_at"), F.lit(tasks.RETRY_SECONDS)).alias("retry_after"),
        (F.col("retry_count") + 1).alias("retry_count"),
    )


@query
def x19_labels(spark, folder):
    t = views.tasks(spark, folder).groupBy("status").agg(F.count("*").alias("n"))
    shown = t.select(F.lit("task").alias("kind"), F.col("status").alias("value"), x.label_of("task", F.col("status")).alias("label"), "n")
    verdicts = views.lines(spark, folder).groupBy("adjudicated_verdict", "l_linestatus").agg(F.count("*").alias("n"))
    other = F.when(F.col("l_linestatus") == "F", F.col("adjudicated_verdict")).otherwise(F.lit("odd"))
    return shown.unionByName(
        verdicts.select(F.lit("verdict").alias("kind"), other.alias("value"), x.label_of("verdict", other).alias("label"), "n")
    )


# ---------------------------------------------------------------- text and retrieval jobs


@query
def d1_chunks(spark, folder):
    found = chunking.chunk_windows(views.current_files(spark, folder))
    return found.select(
        "repo", "file_path", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.md5("content").alias("content_md5"),
        F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"),
    )


@query
def d1_separator_chunks(spark, folder):
    found = chunking.chunk_separators(views.current_files(spark, folder))
    return found.select("repo", "file_path", "chunk_no", F.md5("content").alias("content_md5"), "start_line", "end_line")


@query
def d2_limited_chunks(spark, folder):
    whole = views.current_files(spark, folder).select(
        "repo", "file_path", "content", F.lit(1).alias("start_line"),
        (F.lit(1) + x.newlines(F.col("content"))).alias("end_line"), F.lit("file").alias("node_type"),
    )
    found = chunking.limit_size(whole)
    return found.select(
        "file_path", F.md5("content").alias("content_md5"), F.col("start_line").cast("bigint").alias("start_line"),
        F.col("end_line").cast("bigint").alias("end_line"), "node_type",
    )


@query
def d3_declarations(spark, folder):
    found = declarations.declaration_chunks(views.code_files(spark, folder))
    return found.select(
        "file_path", "node_type", "node_name", F.col("start_line").cast("bigint").alias("start_line"),
        F.col("end_line").cast("bigint").alias("end_line"),
    )


@query
def d4_symbols(spark, folder):
    found = declarations.symbols(views.code_files(spark, folder))
    return found.select(
        "repo", "file_path", F.col("line").cast("bigint").alias("line"), "kind", "name",
        F.col("depth").cast("bigint").alias("depth"), "signature",
    )


@query
def d5_repository_maps(spark, folder):
    code = views.code_files(spark, folder).drop("k")
    found = stored(declarations.symbols(code), "symbols")
    lines = repomap.map_lines(code.select("repo", "file_path", F.length("content").alias("length")), found)
    return repomap.map_parts(stored(lines, "map-lines"))


@query
def d6_embeddings(spark, folder):
    texts = views.rules(spark, folder).select("id", "rule_text")
    embedded = search.embed_texts(texts, "rule_text", embed=vectors.hash_embedder(views.EMBEDDING_DIMS))
    return embedded.select("id", F.posexplode("embedding").alias("slot", "value")).select(
        "id", F.col("slot").cast("bigint").alias("slot"), F.round(F.col("value").cast("double"), 5).alias("value")
    )


def _stored_index(files: DataFrame) -> DataFrame:
    """The index of the stored snapshot, as the table that an update starts from."""
    chunks = indexing.to_chunks(files, chunking.chunk_windows, views.MODEL, views.STRATEGY)
    return stored(indexing.unique_chunks(chunks), "index", "zstd")


@query
def d7_incremental_index(spark, folder):
    """Index of the stored snapshot, brought to the current one by chunking only what changed."""
    stored = views.stored_files(spark, folder)
    before = _stored_index(stored)
    update = indexing.update_index(
        views.current_files(spark, folder), indexing.file_hashes(stored), before, chunking.chunk_windows,
        views.MODEL, views.STRATEGY,
    )
    return update.chunks.select(
        "collection_name", "branch", "repo_name", "source", "chunk_hash",
        F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"),
    )


@query
def d7_branch_delta(spark, folder):
    """The same change as the layer of a branch: the main layer stays as it is."""
    stored = views.stored_files(spark, folder)
    before = _stored_index(stored)
    update = indexing.update_index(
        views.current_files(spark, folder), indexing.file_hashes(stored), before, chunking.chunk_windows,
        views.MODEL, views.STRATEGY, branch="pr-1",
    )
    return update.chunks.groupBy("repo_name", "branch").agg(F.count("*").alias("chunks"), F.count_distinct("source").alias("sources"))


def _vector_update(spark, folder, branch=None, runs=1) -> indexing.IndexUpdate:
    """The stored snapshot with vectors, brought to the current one ``runs`` times."""
    before = views.stored_files(spark, folder)
    embed = vectors.hash_embedder(views.EMBEDDING_DIMS)
    texts = _stored_index(before)
    chunks = stored(search.embed_texts(texts, "content", embed=embed), "index", "zstd")
    dropped(texts)
    hashes = indexing.file_hashes(before)
    for run in range(runs):
        update = indexing.update_index(
            views.current_files(spark, folder), hashes, chunks, chunking.chunk_windows, views.MODEL, views.STRATEGY, branch, embed
        )
        if run + 1 < runs:
            last = chunks, update.added
            chunks, hashes = stored(update.chunks, "index", "zstd"), stored(update.hashes, "hashes")
            for table in last:
                dropped(table)
    return update


@query
def d7_vector_index(spark, folder):
    """An index with vectors after an update: the unchanged chunks keep theirs, the new ones have their own."""
    rounded = F.transform("embedding", lambda v: F.round(v.cast("double"), 4))
    total = F.aggregate(rounded, F.lit(0.0), lambda s, v: s + v)
    return _vector_update(spark, folder).chunks.select(
        "collection_name", "branch", "source", "chunk_hash", F.size("embedding").cast("bigint").alias("dims"), F.round(total, 4).alias("vector_sum")
    )


@query
def d7_branch_twice(spark, folder):
    """A branch layer built twice is the layer built once."""
    found = _vector_update(spark, folder, "pr-1", 2).chunks
    return found.groupBy("repo_name", "branch").agg(
        F.count("*").alias("chunks"), F.count_distinct("source").alias("sources"), F.count("embedding").alias("vectors")
    )


@query
def d7_branch_removed(spark, folder):
    """The index table after the layer of a branch was written to it and removed again."""
    path = f"{run_dir(spark)}/index-{uuid.uuid4().hex}"
    before = _stored_index(views.stored_files(spark, folder))
    vector_table.write_partitions(before, path)
    update = indexing.update_index(
        views.current_files(spark, folder), indexing.file_hashes(views.stored_files(spark, folder)), before, chunking.chunk_windows,
        views.MODEL, views.STRATEGY, branch="pr-1",
    )
    vector_table.apply(spark, path, update.removed, update.added)
    repos = views.current_files(spark, folder).select("repo")
    gone = stored(indexing.remove_branch(vector_table.read(spark, path), repos, views.MODEL, views.STRATEGY, "pr-1"), "gone")
    vector_table.apply(spark, path, gone, update.added.limit(0))
    return vector_table.read(spark, path).groupBy("repo_name", "branch").agg(F.count("*").alias("chunks"), F.count_distinct("source").alias("sources"))


@query
def d8_semantic_search(spark, folder):
    found = search.search(
        views.chunk_vectors(spark, folder), _queries(spark, folder), 10, 0.1, {"language": "python"}, branch="pr-1"
    )
    return found.select("query_id", "source", "branch", "chunk_hash", "similarity")


@query
def d9_file_contexts(spark, folder):
    found = contexts.file_matches(_hits(spark, folder), views.context_files(spark, folder), max_chars=6000)
    return found.select(
        "query_id", "source", "relevance_score", "language", F.array_join("matched_symbols", ",").alias("symbols"),
        "found", "truncated", F.md5("file_content").alias("content_md5"),
    )


@query
def d10_evaluate(spark, folder):
    return whole_check(spark, folder).evaluated.select(
        "query_id", "task_id", F.col("rule_idx").cast("bigint").alias("rule_idx"), "verdict", "explanation", "tokens_used"
    )


@query
def d10_whole_check(spark, folder):
    """Index, search, prompt, evaluate, score and report in one job."""
    return validate.report(whole_check(spark, folder))


@query
def d10_configured_check(spark, folder):
    """The whole check with models, second opinions and thresholds of the repositories' own."""
    check = whole_check(spark, folder, MODELS, _model_configs(spark, folder), ledger=f"{run_dir(spark)}/answers-{uuid.uuid4().hex}")
    log = [F.col(f"cross_check.{c}").alias(c) for c in ("primary_verdict", "secondary_verdict", "agreement", "discriminator_used", "discriminator_model")]
    return check.evaluated.join(check.scored.select("task_id", "score", "approval_threshold", "approved"), "task_id").select(
        "query_id", "task_id", F.col("rule_idx").cast("bigint").alias("rule_idx"), "verdict", "explanation", "llm_provider", "tokens_used", *log,
        F.round("score", 6).alias("score"), "approval_threshold", "approved",
    )


@query
def d10_result_documents(spark, folder):
    """The results of the configured check, written as JSON documents and read again."""
    check = whole_check(spark, folder, MODELS, _model_configs(spark, folder))
    parsed = results.parse(validate.result_documents(check, views.MODEL, views.STRATEGY))
    rows = parsed.select("task_id", "part", F.posexplode("parsed.validations").alias("place", "v"))
    return rows.select(
        "task_id", "part", F.col("place").cast("bigint").alias("place"), F.md5("v.rule").alias("rule_md5"), "v.evaluation.verdict", "v.evaluation.tokens_used",
        F.coalesce("v.cross_check.agreement", F.lit(True)).alias("agreement"),
        F.size("v.related_files").cast("bigint").alias("files"),
        F.aggregate("v.related_files", F.lit(0).cast("bigint"), lambda n, f: n + F.length(f["file_content"])).alias("chars"),
    )


@query
def e3_second_chunker(spark, folder):
    """The whole check over windows of another size than the default."""
    check = whole_check(spark, folder, chunker=lambda files: chunking.chunk_windows(files, 2000, 200))
    return check.hits.groupBy("query_id", "source").agg(F.count("*").alias("hits"), F.round(F.max("similarity"), 4).alias("relevance_score"))


@query
def e4_index_commit(spark, folder):
    """Chunk table and hash log after a full index of the stored snapshot and an update to the current one, both with vectors."""
    root = f"{run_dir(spark)}/index-{uuid.uuid4().hex}"
    embed = vectors.hash_embedder(views.EMBEDDING_DIMS)
    first, now = views.stored_files(spark, folder), views.current_files(spark, folder)
    nothing = search.embed_texts(indexing.unique_chunks(indexing.to_chunks(first.limit(0), chunking.chunk_windows, views.MODEL, views.STRATEGY)), "content", embed=embed)
    index_commit.create(nothing, f"{root}/chunks")
    for files in (first, now):
        update = index_commit.commit(spark, files, f"{root}/chunks", f"{root}/hashes", views.MODEL, views.STRATEGY, chunking.chunk_windows, embed=embed)
        dropped(update.added)
    held = vector_table.read(spark, f"{root}/chunks").groupBy(F.col("repo_name").alias("repo"), F.col("source").alias("file_path")).agg(
        F.count("*").alias("chunks"), F.count("embedding").alias("vectors")
    )
    named = hash_log.read(spark, f"{root}/hashes").join(held, ["repo", "file_path"], "full_outer")
    return named.select("repo", "file_path", "content_hash", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("vectors", F.lit(0)).alias("vectors"))


@query
def d11_cross_check(spark, folder):
    return _reconciled(spark, folder).groupBy(
        "primary_verdict", "secondary_verdict", "adjudicated_verdict", "agreement", "discriminator_used", "final_verdict",
        "discriminator_reasoning",
    ).agg(F.count("*").alias("n"))


@query
def d11_joined_cross_check(spark, folder):
    """The same from three tables of evaluations, joined by task and position."""
    base = views.validations(spark, folder)
    keys = ["task_id", "rule_idx"]

    def side(verdict: str) -> DataFrame:
        return base.select(*keys, F.col(verdict).alias("verdict"), "explanation")

    adjudicated = side("adjudicated_verdict").filter("verdict is not null")
    done = evaluation.cross_check(side("primary_verdict"), side("secondary_verdict"), adjudicated, keys)
    return done.select(*keys, "agreement", "discriminator_used", "final_verdict")


@query
def d12_adjudication_prompts(spark, folder):
    pairs = views.validations(spark, folder).withColumns(
        {"primary_explanation": F.col("explanation"), "secondary_explanation": F.concat(F.lit("Other: "), "explanation")}
    )
    return evaluation.disagreements(pairs).select("task_id", "rule_idx", F.md5("prompt").alias("prompt_md5"))


# ---------------------------------------------------------------- events


def _existing(spark, folder) -> DataFrame:
    """Evaluations that exist already: one per pull request with a label among the reopened ones."""
    return views.pr_events(spark, folder).filter("action = 'closed'").groupBy("repository_full_name", "pr_number").agg(
        F.count("*").alias("n")
    )


@query
def r1_admission(spark, folder):
    decided = admission.admit(
        views.pr_events(spark, folder), views.rules(spark, folder), views.users(spark, folder),
        views.repo_configs(spark, folder), _existing(spark, folder),
    )
    return nullable(decided.select("event_id", "admitted", "reason", "eval_no"), "eval_no")


@query
def r2_task_state(spark, folder):
    return nullable(admission.task_state(views.task_events(spark, folder)), "progress")


@query
def r3_calls_per_minute(spark, folder):
    return activity.calls_per_minute(views.call_log(spark, folder), activity.LIMIT_VALIDATE)


@query
def r4_sliding_rate(spark, folder):
    """Calls per caller in every 60-second window that starts at a multiple of 10 seconds."""
    return jobs.sliding_rate(views.call_log(spark, folder), 1, "10 seconds")


@query
def r5_requeue(spark, folder):
    failures = views.tasks(spark, folder).filter("status = 'failed'").selectExpr(
        "id as task_id", "case id % 3 when 0 then 'LLM' when 1 then 'EMBEDDING' else 'OTHER' end as error_kind",
        "retry_count", "completed_at as failed_at", "coalesce(error, 'unknown') as technical",
    )
    return tasks.requeue(failures)


@query
def r6_hourly_activity(spark, folder):
    return jobs.hourly_activity(views.activity(spark, folder))


@query
def r7_routing(spark, folder):
    events = views.task_events(spark, folder).select("event_id", "user_id", "task_id")
    connections = events.select("user_id").distinct().selectExpr("user_id", "explode(array(user_id * 2, user_id * 2 + 1)) as connection_id")
    subscriptions = views.task_events(spark, folder).filter("type = 'task_requeued'").selectExpr(
        "user_id * 2 + 1 as connection_id", "task_id"
    ).distinct()
    return admission.route(events, connections, subscriptions)


@query
def r8_installations(spark, folder):
    return admission.installations_after(views.installation_events(spark, folder), views.users(spark, folder))
