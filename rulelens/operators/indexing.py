"""Incremental indexing: hashes, snapshot differences, deletes, upserts and the index build."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulelens.functions.text import chunk_key, collection_key, content_hash
from rulelens.functions.vectors import Embedder
from rulelens.operators.numbering import latest_per_key
from rulelens.operators.search import embed_texts
from rulelens.session import stored

FILE = ["repo", "file_path"]
CHUNK = ["collection_name", "branch", "chunk_hash"]
PLACE = ["collection_name", "branch", "source", "chunk_hash"]


def file_hashes(files: DataFrame) -> DataFrame:
    return files.select(*FILE, content_hash(F.col("content")).alias("content_hash"))


def indexed_repos(repositories: DataFrame, indexed: DataFrame, model: str, strategy: str) -> DataFrame:
    """Index entries of all repositories for one model and strategy."""
    chosen = indexed.filter((F.col("embedding_model") == model) & (F.col("chunking_strategy") == strategy))
    repos = repositories.select(F.col("id").alias("repository_id"), F.col("url"), F.col("full_name"))
    return repos.join(chosen.drop("url"), "repository_id")


def stored_hashes(
    hashes: DataFrame, repositories: DataFrame, indexed: DataFrame, model: str, strategy: str
) -> DataFrame:
    """File hashes by repository URL for one model and strategy."""
    entries = indexed_repos(repositories, indexed, model, strategy).select(
        F.col("id").alias("indexed_repository_id"), "url"
    )
    return hashes.join(entries, "indexed_repository_id").select("url", "file_path", "content_hash")


def diff(current: DataFrame, stored: DataFrame, keys: Sequence[str] = FILE) -> DataFrame:
    """Classify every path as new, deleted, changed or unchanged. Only keys and hashes are shuffled."""
    c = current.select(*keys, F.col("content_hash").alias("_now"))
    s = stored.select(*keys, F.col("content_hash").alias("_then"))
    change = (
        F.when(F.col("_then").isNull(), "new")
        .when(F.col("_now").isNull(), "deleted")
        .when(F.col("_now") != F.col("_then"), "changed")
        .otherwise("unchanged")
    )
    return c.join(s, list(keys), "full_outer").select(*keys, change.alias("change"))


def delete_by_sources(chunks: DataFrame, removed: DataFrame, branch: str = "") -> DataFrame:
    """Drop the chunks of ``removed(collection_name, source)`` in one branch; other branches stay."""
    gone = removed.select("collection_name", "source").withColumn("branch", F.lit(branch))
    return chunks.join(gone, ["collection_name", "source", "branch"], "left_anti")


def delete_branch(chunks: DataFrame, collections: DataFrame, branch: str) -> DataFrame:
    gone = collections.select("collection_name").distinct().withColumn("branch", F.lit(branch))
    return chunks.join(gone, ["collection_name", "branch"], "left_anti")


def delete_collections(chunks: DataFrame, collections: DataFrame) -> DataFrame:
    return chunks.join(collections.select("collection_name"), "collection_name", "left_anti")


def delete_hashes(hashes: DataFrame, entries: DataFrame, removed: DataFrame) -> DataFrame:
    """Drop hash rows of ``removed(url, file_path)`` through the index ``entries(id, url)``."""
    gone = removed.join(entries.select(F.col("id").alias("indexed_repository_id"), "url"), "url")
    return hashes.join(gone, ["indexed_repository_id", "file_path"], "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str | None = None) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key.

    With ``version`` the highest version of a key wins inside ``new``. The old side only meets the
    new keys, so a small change does not shuffle a large table.
    """
    columns = [c for c in old.columns if c not in keys]
    if version:
        new = latest_per_key(new, list(keys), [version], columns)
    kept = old.join(new.select(*keys), list(keys), "left_anti")
    return kept.select(*keys, *columns).unionByName(new.select(*keys, *columns))


def upsert_known(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As ``upsert``, but a null in ``new`` keeps the old value."""
    columns = [c for c in old.columns if c not in keys]
    incoming = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = old.join(incoming, list(keys), "full_outer")
    return joined.select(*keys, *[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) for c in columns])


def collection_state(chunks: DataFrame) -> DataFrame:
    """Chunks per collection, and whether its main layer is indexed."""
    return chunks.groupBy("collection_name").agg(
        F.count("*").alias("chunks"), F.bool_or(F.col("branch") == "").alias("main_indexed")
    )


class IndexUpdate(NamedTuple):
    changes: DataFrame
    removed: DataFrame
    added: DataFrame
    chunks: DataFrame
    hashes: DataFrame


def to_chunks(
    files: DataFrame, chunker: Callable[[DataFrame], DataFrame], model: str, strategy: str, branch: str = ""
) -> DataFrame:
    """Chunk files and give them their collection, branch and key."""
    chunked = chunker(files)
    return chunked.select(
        collection_key(F.col("repo"), F.lit(model), F.lit(strategy)).alias("collection_name"),
        F.lit(branch).alias("branch"),
        F.col("file_path").alias("source"),
        "start_line",
        "end_line",
        "language",
        F.col("repo").alias("repo_name"),
        "node_type",
        "node_name",
        "content",
        chunk_key(F.col("file_path"), F.col("content")).alias("chunk_hash"),
    )


def unique_chunks(chunks: DataFrame) -> DataFrame:
    """One row per key. Equal texts of one file share a key, and with it the first line range."""
    keys = CHUNK
    rest = [c for c in chunks.columns if c not in keys]
    return chunks.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("start_line", "end_line")).alias("_row")).select(
        *keys, "_row.*"
    )


def outdated(chunks: DataFrame, removed: DataFrame | None, added: DataFrame) -> DataFrame:
    """The keys of the chunks that a change takes out, by which nulls are equal to nulls: those of ``removed(collection_name, branch, source)``, and
    those that ``added`` replaces. Only keys are shuffled."""
    keys = chunks.select(*PLACE)
    replaced = keys.join(added.select(*CHUNK), CHUNK, "left_semi").select(*PLACE)
    gone = replaced if removed is None else keys.join(removed, ["collection_name", "branch", "source"], "left_semi").select(*PLACE).union(replaced)
    return gone.distinct()


def remaining(chunks: DataFrame, removed: DataFrame | None, added: DataFrame) -> DataFrame:
    """The chunks that stay. Their texts are shuffled once, and not at all where the stored keys of the others are few."""
    return without(chunks, stored(outdated(chunks, removed, added), "outdated"))


def without(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """The chunks whose key is not in ``gone``."""
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PLACE])
    return chunks.join(gone.toDF(*[f"_{c}" for c in PLACE]), same, "left_anti")


def update_index(
    files: DataFrame,
    stored_hashes: DataFrame,
    stored_chunks: DataFrame,
    chunker: Callable[[DataFrame], DataFrame],
    model: str,
    strategy: str,
    branch: str | None = None,
    embed: Embedder | None = None,
) -> IndexUpdate:
    """Bring the index to the state of ``files``; only new and changed files are chunked and embedded.

    With ``branch`` the main layer stays and the changed files form the branch layer, which replaces an
    earlier one, except for repositories without a main layer, which are indexed as main. A repository whose
    hashes are known but whose main layer is missing is indexed again in full.

    ``removed(collection_name, branch, source)`` and ``added`` are the change; ``vector_table.apply`` writes it without touching
    other parts of the table. ``chunks`` is the whole index after it, with all columns of ``stored_chunks``. New chunks are
    embedded if ``embed`` is given or the index holds vectors. ``hashes`` are those that hold once the change is applied;
    ``plans.index_commit`` applies it and names only hashes whose chunks the table holds.
    """
    hashes = file_hashes(files)
    present = stored_chunks.filter(F.col("branch") == "").select(F.col("repo_name").alias("repo")).distinct()
    trusted = stored_hashes.join(present, "repo", "left_semi")
    changes = stored(diff(hashes, trusted), "changes")
    todo = files.join(changes.filter(F.col("change").isin("new", "changed")), FILE, "left_semi")
    if branch is None:
        main, delta = todo, None
    else:
        main, delta = todo.join(present, "repo", "left_anti"), todo.join(present, "repo", "left_semi")
    added = unique_chunks(to_chunks(main, chunker, model, strategy))
    if delta is not None:
        added = added.unionByName(unique_chunks(to_chunks(delta, chunker, model, strategy, branch)))
    if embed or "embedding" in stored_chunks.columns:
        added = embed_texts(added, "content", embed=embed)
    added = stored(added, "added", "zstd")
    key = collection_key(F.col("repo"), F.lit(model), F.lit(strategy)).alias("collection_name")
    if delta is None:
        gone = changes.filter(F.col("change").isin("changed", "deleted")).select(*FILE)
        # what a broken update left behind: chunks of files that no hash names
        main_layer = stored_chunks.filter(F.col("branch") == "").select(F.col("repo_name").alias("repo"), F.col("source").alias("file_path")).distinct()
        left = main_layer.join(files.select("repo").distinct(), "repo", "left_semi").join(changes.filter("change = 'unchanged'"), FILE, "left_anti")
        removed = gone.union(left).distinct().select(key, F.lit("").alias("branch"), F.col("file_path").alias("source"))
    else:
        of = files.select("repo").distinct().select(key)
        layer = stored_chunks.filter(F.col("branch") == branch).join(of, "collection_name", "left_semi")
        removed = layer.select("collection_name", "branch", "source").distinct()
    if delta is None:
        kept = remaining(stored_chunks, removed, added)
    else:  # of the other layers nothing is removed, so they need not be shuffled
        own = F.col("branch").eqNullSafe(F.lit(branch))
        mains = added.filter(~own)
        kept = remaining(stored_chunks.filter(~own), None, mains).unionByName(remaining(stored_chunks.filter(own), removed, added))
    if delta is None:
        new_hashes = hashes
    else:
        new_hashes = trusted.unionByName(hashes.join(present, "repo", "left_anti"))
    return IndexUpdate(changes, removed, added, kept.unionByName(added, allowMissingColumns=True), new_hashes)


def remove_branch(stored_chunks: DataFrame, repos: DataFrame, model: str, strategy: str, branch: str) -> DataFrame:
    """``removed(collection_name, branch, source)`` that ends the layer of a branch after its check."""
    key = collection_key(F.col("repo"), F.lit(model), F.lit(strategy)).alias("collection_name")
    layer = stored_chunks.filter(F.col("branch") == branch).join(repos.select(key).distinct(), "collection_name", "left_semi")
    return layer.select("collection_name", "branch", "source").distinct()
