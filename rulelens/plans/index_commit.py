"""An index update as one commit over the chunk table and the hash log.

A hash promises that the chunk table holds every chunk of exactly that text. The order keeps the promise whenever a run breaks off:

1. hashes of files that are about to change or go, and hashes that no main layer backs, are withdrawn;
2. the change is applied to the chunk table;
3. new hashes are named for the files whose chunks are found in the table, all of them.

A file without a hash is new to the next update, which does its work again with the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.functions.vectors import Embedder
from rulelens.operators import indexing
from rulelens.operators.indexing import CHUNK, FILE, IndexUpdate
from rulelens.plans.validate import default_chunker
from rulelens.session import stored
from rulelens.sources import hash_log, vector_table


def create(chunks: DataFrame, table: str) -> None:
    """An empty chunk table, or one with the given chunks."""
    vector_table.write_partitions(stored(chunks, "first-chunks"), table)


def withdrawn(known: DataFrame, present: DataFrame, update: IndexUpdate, branch: str | None) -> DataFrame:
    """The files whose hash must go before the table is touched."""
    unbacked = known.join(present, "repo", "left_anti").select(*FILE)
    if branch is not None:  # the main layer of indexed repositories stays as it is
        return unbacked
    return unbacked.union(update.changes.filter("change in ('changed', 'deleted')").select(*FILE)).distinct()


def confirmed(update: IndexUpdate, table: DataFrame, branch: str | None) -> DataFrame:
    """(repo, file_path, content_hash) of new and changed files whose chunks of the main layer are all in ``table``.

    Files without chunks hold nothing that could be missing.
    """
    main = update.added.filter("branch = ''")
    missing = main.join(table.select(*CHUNK), CHUNK, "left_anti").select(F.col("repo_name").alias("repo"), F.col("source").alias("file_path")).distinct()
    fresh = update.changes.filter("change in ('new', 'changed')").select(*FILE)
    if branch is not None:  # only repositories without a main layer were indexed as main
        fresh = fresh.join(main.select(F.col("repo_name").alias("repo")).distinct(), "repo", "left_semi")
    return update.hashes.join(fresh, FILE, "left_semi").join(missing, FILE, "left_anti")


def commit(
    spark: SparkSession,
    files: DataFrame,
    table: str,
    log: str,
    model: str,
    strategy: str,
    chunker: Callable[[DataFrame], DataFrame] = default_chunker,
    branch: str | None = None,
    embed: Embedder | None = None,
) -> IndexUpdate:
    """Bring chunk table and hash log to the state of ``files``, for the repositories that ``files`` names.

    Only the columns of the change are read and only its buckets are rewritten.
    """
    repos = files.select("repo").distinct()
    known = stored(hash_log.read(spark, log).join(repos, "repo", "left_semi"), "known-hashes")
    before = vector_table.read(spark, table).join(repos.withColumnRenamed("repo", "repo_name"), "repo_name", "left_semi")
    present = stored(before.filter("branch = ''").select(F.col("repo_name").alias("repo")).distinct(), "main-layers")
    update = indexing.update_index(files, known, before, chunker, model, strategy, branch, embed)
    # all of the change is stored before the table that it was derived from is rewritten
    update = update._replace(removed=stored(update.removed, "removed"), hashes=stored(update.hashes, "new-hashes"))
    gone = withdrawn(known, present, update, branch)
    hash_log.append(gone.withColumn("content_hash", F.lit(None).cast("string")), log)
    vector_table.apply(spark, table, update.removed, update.added)
    hash_log.append(stored(confirmed(update, vector_table.read(spark, table), branch), "confirmed"), log)
    return update


def end_branch(spark: SparkSession, files: DataFrame, table: str, model: str, strategy: str, branch: str) -> None:
    """Take the layer of a branch out of the chunk table, after its check."""
    chunks = vector_table.read(spark, table, branches=[branch])
    gone = stored(indexing.remove_branch(chunks, files.select("repo"), model, strategy, branch), "ended")
    vector_table.apply(spark, table, gone, chunks.limit(0))
