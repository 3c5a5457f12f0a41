"""The data model over the given tables: each function reads one or two tables in whole.

Repositories, users and collections grow with the tables; constants only shape values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.operators.numbering import GROUP_ROWS, latest_per_key, number_within

AS_OF = "timestamp_ntz'2000-01-01 00:00:00'"
ACTIVITY_AS_OF = "timestamp_ntz'2024-01-31 00:00:00'"
EMBEDDING_DIMS = 64
MODEL = "hash-64"
STRATEGY = "windows-1000"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _full_name(repo_no: str) -> str:
    return f"concat('org', ({repo_no}) div 4, '/repo', {repo_no})"


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    base = table(spark, folder, "orders").selectExpr(
        "o_orderkey as id",
        "o_custkey as cust",
        "o_custkey div 75 as repo_no",
        "(o_custkey div 75) div 4 as user_id",
        f"{_full_name('o_custkey div 75')} as repository_full_name",
        "case when o_custkey % 11 = 0 then null when o_custkey % 13 = 0 then ''"
        " else concat('dev', o_custkey % 37) end as pr_author",
        "case when o_custkey % 11 = 0 then null else o_orderkey % 50 end as pr_number",
        "case o_orderstatus when 'F' then 'failed' when 'O' then 'completed'"
        " else case when o_orderkey % 2 = 0 then 'pending' else 'running' end end as status",
        "o_orderdate as created_at",
        "o_orderkey % 7 as retry_count",
    )
    return base.selectExpr(
        "id",
        "user_id",
        "repo_no",
        "concat('https://github.com/', repository_full_name, '.git') as repository_url",
        "repository_full_name",
        "pr_author",
        "pr_number",
        "concat('sha', id) as pr_head_sha",
        "concat('branch-', pr_number) as pr_head_ref",
        "status",
        "created_at",
        "retry_count",
        "case status when 'completed' then 100 when 'running' then id % 100 else 0 end as progress",
        "case status when 'completed' then 'Done' when 'running' then concat('step ', id % 100) else '' end"
        " as progress_message",
        "case when status = 'pending' and id % 4 = 0 then created_at + interval 120 seconds end as retry_after",
        "case when status <> 'pending' then created_at + interval 1 seconds end as started_at",
        "case when status in ('completed', 'failed')"
        " then created_at + make_dt_interval(0, 0, 0, id % 300) end as completed_at",
        "case when status <> 'failed' then null"
        " when id % 4 = 0 then concat('{\"code\":\"LLM_UNAVAILABLE\",\"message\":\"no answer for ', id,"
        " '\",\"technical\":\"timeout\"}')"
        " when id % 4 = 1 then '{\"detail\": 1}'"
        " when id % 4 = 2 then concat('{\"code\":\"OTHER\",\"message\":\"m', id, '\"}')"
        " else concat('plain failure ', id) end as error",
        "id % 3 <> 0 as enable_cross_check",
        "status = 'completed' and id % 10 <> 9 as has_result",
        "case when id % 2 = 0 then id % 9 end as github_installation_id",
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "customer")
        .selectExpr("(c_custkey div 75) div 4 as user_id")
        .distinct()
        .selectExpr("user_id", "concat('user', user_id) as login")
    )


def rules(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").selectExpr(
        "p_partkey as id",
        "(p_partkey div 100) div 4 + case when p_size % 10 = 0 then 1 else 0 end as user_id",
        "p_partkey div 100 as repo_no",
        f"{_full_name('p_partkey div 100')} as repository_full_name",
        "concat('Check ', p_name, ' of ', p_brand, ' ', p_type) as rule_text",
        "p_partkey % 100 as position",
        "case when p_size % 7 = 0 then null else p_size % 4 <> 0 end as enabled",
        "timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, p_partkey * 37 % 1000, 0, 0) as created_at",
    )


def config_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every configuration ever sent, in order of ``version``; some break the limits."""
    return table(spark, folder, "supplier").selectExpr(
        "s_suppkey as version",
        "(s_suppkey div 5) div 4 as user_id",
        "s_suppkey div 5 as repo_no",
        f"{_full_name('s_suppkey div 5')} as repository_full_name",
        "s_suppkey % 25 as max_evaluations_per_pr",
        "(s_suppkey % 13) / 10D as approval_threshold",
        "s_suppkey % 2 = 0 as enable_cross_check",
        "s_suppkey % 3 <> 0 as pr_evaluation_enabled",
        "s_suppkey % 23 as max_chunks_per_rule",
        "case s_suppkey % 4 when 0 then null when 1 then 'azure/gpt-4o' when 2 then 'gemini-2.5-flash'"
        " else 'unknown-model' end as llm_model",
        "case s_suppkey % 5 when 0 then null when 1 then 'azure/gpt-4.1' when 2 then 'no-such' else 'azure/o4-mini' end as llm_primary_model",
        "case s_suppkey % 6 when 0 then null when 1 then '' else 'azure/gpt-4o' end as llm_secondary_model",
        "s_acctbal as balance",
    )


def repo_configs(spark: SparkSession, folder: str) -> DataFrame:
    """The configuration in force per repository (last write wins); poor owners have none."""
    saved = config_requests(spark, folder).selectExpr(
        "version",
        "user_id",
        "repo_no",
        "repository_full_name",
        "1 + version % 4 as max_evaluations_per_pr",
        "0.5D + (repo_no % 5) / 10D as approval_threshold",
        "enable_cross_check",
        "repo_no % 3 <> 0 as pr_evaluation_enabled",
        "1 + repo_no % 20 as max_chunks_per_rule",
        "case when repo_no % 2 = 0 then null else 'azure/gpt-4o' end as llm_model",
        "case when repo_no % 3 = 0 then 'azure/gpt-4.1' end as llm_primary_model",
        "case when repo_no % 3 = 1 then 'azure/o4-mini' end as llm_secondary_model",
        "balance",
    )
    columns = [c for c in saved.columns if c not in ("user_id", "repository_full_name")]
    return latest_per_key(saved, ["user_id", "repository_full_name"], ["version"], columns).filter("balance >= 2000")


def task_viewers(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .filter("l_returnflag = 'R'")
        .selectExpr("l_orderkey as task_id", "l_suppkey % 5 as user_id")
        .distinct()
    )


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """One evaluated rule per line item, without its position."""
    return _with_texts(table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "task_id"))


def _with_texts(items: DataFrame, *more: str) -> DataFrame:
    return items.selectExpr(
        "task_id",
        "concat('Rule ', l_partkey) as rule",
        "case l_returnflag when 'N' then 'pass' when 'A' then 'partial' else 'fail' end as primary_verdict",
        "case when l_linestatus = 'F' then l_returnflag"
        " else case l_returnflag when 'N' then 'A' when 'A' then 'R' else 'N' end end as _second",
        "case when l_partkey % 3 = 0 then null else 'pass' end as adjudicated_verdict",
        "case when l_quantity < 5 then '' else concat('Line ', l_linenumber, ' of order ', task_id,"
        " '. Supplier ', l_suppkey, ' checked. End') end as explanation",
        "cast(l_quantity as bigint) * 10 as tokens_used",
        "l_linestatus",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_shipdate",
        "l_extendedprice",
        "l_tax",
        *more,
    ).selectExpr(
        "*",
        "case _second when 'N' then 'pass' when 'A' then 'partial' else 'fail' end as secondary_verdict",
    ).drop("_second")


def validations(spark: SparkSession, folder: str) -> DataFrame:
    """``lines`` with ``rule_idx``, the position of the rule in its task. The texts are made of the numbered rows, so they are not shuffled for it."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    numbered = number_within(
        table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "task_id"),
        ["task_id"],
        [F.col(c) for c in order],
        F.expr("struct(l_linenumber, l_partkey div 64)"),
        "rule_idx",
        split_above=GROUP_ROWS,
    )
    texts = _with_texts(numbered, "rule_idx").drop("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return texts.select(*[c for c in texts.columns if c != "rule_idx"], "rule_idx")


def repositories(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "customer")
        .selectExpr("c_custkey div 75 as id")
        .distinct()
        .selectExpr("id", f"concat('https://github.com/', {_full_name('id')}, '.git') as url", f"{_full_name('id')} as full_name")
    )


def indexed_repositories(spark: SparkSession, folder: str) -> DataFrame:
    """Index entries: one row per repository that has a configuration, and an older model for all."""
    repos = repositories(spark, folder).selectExpr("id as repository_id", "url")
    return repos.selectExpr(
        "repository_id",
        f"explode(array('{MODEL}', 'hash-32')) as embedding_model",
        "url",
    ).selectExpr(
        "repository_id * 2 + case when embedding_model = 'hash-32' then 1 else 0 end as id",
        "repository_id",
        "embedding_model",
        f"'{STRATEGY}' as chunking_strategy",
        f"md5(concat_ws('|', url, embedding_model, '{STRATEGY}')) as collection_name",
    )


def stored_files(spark: SparkSession, folder: str) -> DataFrame:
    """The stored snapshot: all documents and all pages."""
    docs = table(spark, folder, "documents").selectExpr(
        "source as repo", "concat('src/', lang, '/', doc_id, " + _ext() + ") as file_path", "text as content"
    )
    pages = table(spark, folder, "pages").selectExpr(
        "concat('src', page_id div 13) as repo", "concat('pages/', page_id, '.html') as file_path", "html as content"
    )
    return docs.unionByName(pages)


def current_files(spark: SparkSession, folder: str) -> DataFrame:
    """The current snapshot: pages are gone, benchmark files are new, documents labelled good were edited."""
    good = table(spark, folder, "labels").filter("quality = 1").select("doc_id").withColumn("edited", F.lit(True))
    docs = (
        table(spark, folder, "documents")
        .join(good, "doc_id", "left")
        .selectExpr(
            "source as repo",
            "concat('src/', lang, '/', doc_id, " + _ext() + ") as file_path",
            "case when edited then concat(text, '\\n# v2') else text end as content",
        )
    )
    new = table(spark, folder, "benchmark").selectExpr(
        "concat('src', item_id div 2) as repo", "concat('bench/', item_id, '.txt') as file_path", "text as content"
    )
    return docs.unionByName(new)


def _ext() -> str:
    return "case lang when 'en' then '.py' when 'fr' then '.js' when 'de' then '.go' else '.md' end"


def code_files(spark: SparkSession, folder: str) -> DataFrame:
    """One small source file per part, in three languages."""
    part = table(spark, folder, "part").selectExpr(
        "p_partkey as k", "replace(p_name, ' ', '_') as name", "p_size", "p_partkey div 100 as repo_no"
    )
    python = (
        "concat('import os\\n\\nclass C', k, ':\\n    def ', name, '(self, a):\\n        return ', p_size,"
        " '\\n\\n    def second(self):\\n        pass\\n\\ndef top_', name, '(x):\\n    return x\\n')"
    )
    go = (
        "concat('package main\\n\\ntype T', k, ' struct {\\n\\tn int\\n}\\n\\nfunc (t *T', k, ') ', name,"
        " '() int {\\n\\treturn ', p_size, '\\n}\\n\\nfunc top_', name, '() {\\n}\\n')"
    )
    java = (
        "concat('package app;\\n\\npublic class C', k, ' {\\n    public int ', name, '(int a) {\\n        return ',"
        " p_size, ';\\n    }\\n}\\n')"
    )
    return part.selectExpr(
        "concat('repo', repo_no) as repo",
        "concat('src/', name, '/f', k, case k % 3 when 0 then '.py' when 1 then '.go' else '.java' end) as file_path",
        f"case k % 3 when 0 then {python} when 1 then {go} else {java} end as content",
        "k",
    )


def chunk_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").selectExpr(
        "vec_id",
        "concat('c', label) as collection_name",
        "case when vec_id % 4 = 0 then 'pr-1' else '' end as branch",
        "concat('f', vec_id % 60) as source",
        "cast(vec_id % 100 as int) as start_line",
        "cast(vec_id % 100 + 20 as int) as end_line",
        "case vec_id % 3 when 0 then 'python' when 1 then 'javascript' end as language",
        "concat('repo', label) as repo_name",
        "case vec_id % 2 when 0 then 'function_definition' else 'fallback_text_split' end as node_type",
        "case when vec_id % 4 < 3 then concat('fn', vec_id % 7) end as node_name",
        "concat('chunk ', vec_id) as content",
        "md5(cast(vec_id as string)) as chunk_hash",
        "embedding",
    )


def context_files(spark: SparkSession, folder: str) -> DataFrame:
    """File texts for the sources of ``chunk_vectors``; labelled-toxic documents are missing."""
    toxic = table(spark, folder, "labels").filter("toxic = 1").select("doc_id")
    return (
        table(spark, folder, "documents")
        .join(toxic, "doc_id", "left_anti")
        .selectExpr("concat('f', doc_id) as source", "text as file_text")
    )


def raw_responses(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    body = F.to_json(F.struct(
        F.when(F.col("doc_id") % 5 == 0, "Pass").when(F.col("doc_id") % 5 == 1, "PARTIAL").otherwise("maybe").alias("verdict"),
        F.col("text").alias("explanation"),
        F.array(F.lit("fix it"), F.lit("test it")).alias("suggestions"),
    ))
    kind = F.col("doc_id") % 7
    raw = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == 1, body)
        .when(kind == 2, F.concat(F.lit('{"verdict": '), F.col("text")))
        .when(kind == 3, F.to_json(F.struct(F.col("text").alias("note"))))
        .when(kind == 4, F.lit('{"verdict": null, "explanation": "x"}'))
        .when(kind == 5, F.lit('["pass"]'))
        .otherwise(F.concat(F.lit("  "), body, F.lit("\n")))
    )
    return docs.select("doc_id", raw.alias("raw"))


def call_log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr("user_id as caller", "ts", "event_id")


def task_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "event_id",
        "event_id % 200 as task_id",
        "user_id",
        "case event_type when 'view' then 'task_progress' when 'click' then 'task_progress'"
        " when 'purchase' then 'task_completed' when 'error' then 'task_failed' else 'task_requeued' end as type",
        "case when event_type in ('view', 'click') then cast(floor(value) as int) end as progress",
        "case when event_type = 'click' then null else concat(event_type, ' ', event_id) end as message",
        "ts",
    )


def activity(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "event_id as id",
        "concat('repo', user_id % 20) as repository_full_name",
        "case event_type when 'purchase' then 'completed' when 'error' then 'failed' else 'running' end as status",
        "ts as created_at",
    )


def pr_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey as event_id",
        "case substring(o_orderpriority, 1, 1) when '1' then 'opened' when '2' then 'synchronize'"
        " when '3' then 'reopened' when '4' then 'closed' else 'labeled' end as action",
        "o_custkey % 9 as installation_id",
        f"{_full_name('o_custkey div 75')} as repository_full_name",
        "o_orderkey % 50 as pr_number",
        "concat('sha', o_orderkey) as head_sha",
        "concat('branch-', o_orderkey % 50) as head_ref",
        "concat('dev', o_custkey % 37) as author",
        "o_orderdate as ts",
    )


def installations(spark: SparkSession, folder: str) -> DataFrame:
    """Installation of each account, many per user; an account may be installed more than once."""
    return table(spark, folder, "supplier").selectExpr(
        "s_suppkey as installation_id",
        "(s_suppkey div 5) div 4 as user_id",
        "concat('org', (s_suppkey div 5) div 4 + s_nationkey % 2) as account_login",
    )


def installation_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "event_id",
        "ts",
        "user_id % 40 as installation_id",
        "case event_type when 'purchase' then 'created' when 'view' then 'unsuspend' when 'error' then 'deleted'"
        " when 'click' then 'suspend' else 'other' end as action",
        "concat('user', event_id % 9) as sender_login",
        "concat('org', user_id) as account_login",
    )
