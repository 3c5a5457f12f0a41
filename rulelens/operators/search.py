"""Embedding of texts and exact nearest-neighbour search of queries in their collections."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulelens.functions.vectors import SIMILARITY_DIGITS, Embedder, hash_embedder
from rulelens.session import stored

# Filterable columns, their alias, and the search defaults.
FILTERABLE = ("source", "language", "repo_name", "node_type", "node_name")
FILTER_ALIAS = {"tree_sitter_type": "node_type"}
THRESHOLD = 0.3
TOP_K = 5

BLOCK_VALUES = 8_000_000
QUERY_BLOCK = 16_384
QUERY_STEP = 256
#: Chunks whose largest similarity bounds the k-th one from below.
GROUP = 32
_KEY = ["collection_name", "branch"]
_FOUND = "query_id bigint, collection_name string, branch string, chunk_hash string, similarity double"


def embed_texts(
    df: DataFrame, text: str, out: str = "embedding", embed: Embedder | None = None, batch_size: int | None = None
) -> DataFrame:
    """Add the embedding of ``text``. The caller's function gets at most ``batch_size`` texts at a time.

    The default is a whole Arrow batch (``spark.sql.execution.arrow.maxRecordsPerBatch``). A failed call
    fails the task, which Spark runs again.
    """
    call = embed or hash_embedder()

    def run(texts: list[str]) -> np.ndarray:
        size = batch_size or max(1, len(texts))
        parts = [np.asarray(call(texts[i : i + size])) for i in range(0, len(texts), size)]
        return np.concatenate(parts) if parts else np.zeros((0, 0))

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            vectors = np.asarray(run([t or "" for t in batch.column(text).to_pylist()]), dtype=np.float32)
            width = vectors.shape[1] if vectors.ndim == 2 else 0
            offsets = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * width)
            values = pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(batches, f"{schema}, `{out}` array<float>")


def filter_metadata(chunks: DataFrame, wanted: Mapping[str, str]) -> DataFrame:
    """Equality filters on the allowed columns; unknown names are ignored."""
    for name, value in wanted.items():
        column = FILTER_ALIAS.get(name, name)
        if column in FILTERABLE:
            chunks = chunks.filter(F.col(column) == value)
    return chunks


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms == 0.0, np.nan, norms)


def _matrix(column: pa.ListArray) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(values.reshape(len(column), -1))


def _best(sims: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best ``k`` of one query, by similarity, then name. Only rows at or above the k-th value are sorted."""
    usable = ~np.isnan(sims)
    sims, names = sims[usable], names[usable]
    if len(sims) > k:
        bound = np.partition(sims, len(sims) - k)[len(sims) - k]
        near = sims >= bound
        sims, names = sims[near], names[near]
    order = np.lexsort((names, -sims))[:k]
    return sims[order], names[order]


def _candidates(sims: np.ndarray, k: int, slack: float, limit: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(row, column) of everything within ``slack`` of the k best of a row, and some more; None if there are more than ``limit``.

    At least k values reach the k-th largest of the maxima of groups, so it is a lower bound of the k-th value.
    """
    rows, n = sims.shape
    each = n // GROUP
    if each >= k:
        tops = sims[:, : each * GROUP].reshape(rows, GROUP, each).max(axis=1)
        low = np.partition(tops, each - k, axis=1)[:, each - k]
    elif n > k:
        low = np.partition(sims, n - k, axis=1)[:, n - k]
    else:
        low = np.full(rows, -np.inf, dtype=sims.dtype)
    near = sims >= (low - np.float32(slack))[:, None]
    return np.nonzero(near) if np.count_nonzero(near) <= limit else None


def _best_of_all(vectors: np.ndarray, wanted: np.ndarray, names: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, chunk, similarity) of the best ``k`` chunks of each query, by similarity, then name; all by their positions.

    Single precision finds the candidates, with room for its error; their similarities are made in double precision.
    """
    place = pc.array_sort_indices(names, null_placement="at_start").to_numpy()
    usable = place[~np.isnan(vectors[place]).any(axis=1)]
    vectors = vectors[usable]
    few = vectors.astype(np.float32)
    # both sides are unit vectors, so a product is off by at most its length times the unit roundoff; rounding to digits adds one unit of the last
    slack = 4 * (vectors.shape[1] + 8) * 2.0**-24 + 2 * 10.0**-SIMILARITY_DIGITS
    found = []
    asked = np.flatnonzero(~np.isnan(wanted).any(axis=1)) if len(usable) else np.zeros(0, dtype=np.int64)
    for start in range(0, len(asked), QUERY_STEP):
        own = asked[start : start + QUERY_STEP]
        near = _candidates(wanted[own].astype(np.float32) @ few.T, k, slack, BLOCK_VALUES // vectors.shape[1])
        if near is None:  # very many alike: one query after the other
            for q in own:
                best, at = _best(np.round(vectors @ wanted[q], SIMILARITY_DIGITS), np.arange(len(usable)), k)
                found.append((np.full(len(at), q), usable[at], best))
            continue
        row, column = near
        sims = np.round(np.einsum("ij,ij->i", vectors[column], wanted[own[row]]), SIMILARITY_DIGITS)
        order = np.lexsort((column, -sims, row))
        row, column, sims = row[order], column[order], sims[order]
        top = np.arange(len(row)) - np.searchsorted(row, row) < k
        found.append((own[row[top]], usable[column[top]], sims[top]))
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (none, none, np.zeros(0))


def _blocks(df: DataFrame, size: Column, limit: int, name: str) -> DataFrame:
    """Number of blocks for every collection and branch, so that ``size`` adds up to about ``limit`` in each."""
    return df.groupBy(*_KEY).agg(F.greatest(F.ceil(F.sum(size) / limit), F.lit(1)).cast("bigint").alias(name))


def _block_join(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Chunks and queries of a collection are cut into blocks of bounded size by a hash of their key, and
    every pair of blocks is one group, so a large collection is spread over many tasks.

    Only collections that are asked for take part. A group returns the best ``k`` per query, never the pairs, and
    holds at most ``QUERY_STEP`` rows of similarities at a time.
    """
    query_blocks = _blocks(queries, F.lit(1), QUERY_BLOCK, "_nq")
    chunk_blocks = _blocks(chunks, F.size("embedding"), BLOCK_VALUES, "_nc")
    sizes = chunk_blocks.join(query_blocks, _KEY)
    left = (
        chunks.select(*_KEY, "chunk_hash", "embedding")
        .join(sizes, _KEY)
        .withColumn("_c", F.pmod(F.xxhash64("chunk_hash"), F.col("_nc")))
        .withColumn("_q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_nq") - 1)))
        .drop("_nc", "_nq")
    )
    right = (
        queries.select(*_KEY, "query_id", "query_vec")
        .join(sizes, _KEY)
        .withColumn("_q", F.pmod(F.xxhash64("query_id"), F.col("_nq")))
        .withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_nc") - 1)))
        .drop("_nc", "_nq")
    )

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        columns = [pa.array([], kind) for kind in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64())]
        if a.num_rows and b.num_rows:
            a, b = a.combine_chunks(), b.combine_chunks()
            names = a.column("chunk_hash").combine_chunks()
            vectors = _matrix(a.column("embedding").combine_chunks())
            wanted = _matrix(b.column("query_vec").combine_chunks())
            query, chunk, sims = _best_of_all(vectors, wanted, names, k)
            key = [pa.repeat(a.column(c)[0], len(query)) for c in _KEY]
            columns = [b.column("query_id").combine_chunks().take(pa.array(query)), *key, names.take(pa.array(chunk)), pa.array(sims, pa.float64())]
        return pa.Table.from_arrays(columns, names=["query_id", *_KEY, "chunk_hash", "similarity"])

    group = [*_KEY, "_c", "_q"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(meet, _FOUND)


def nearest(chunks: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """Exact top ``k`` chunks for every query ``(query_id, collection_name, branch, query_vec)``.

    One plan for all sizes: blocks of chunks meet blocks of queries, each returns at most ``k`` rows
    per query, and the last step ranks those. Ties go to the smaller chunk key.
    """
    found = _block_join(chunks.filter(F.col("embedding").isNotNull()), queries, k)
    w = Window.partitionBy("query_id", "branch").orderBy(F.col("similarity").desc(), "chunk_hash")
    return found.withColumn("hit_no", F.row_number().over(w)).filter(F.col("hit_no") <= k)


def with_chunk(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Fetch the columns of the hit chunks (all but the vector)."""
    payload = [c for c in chunks.columns if c != "embedding"]
    return hits.join(chunks.select(*payload), [*_KEY, "chunk_hash"])


def merge_layers(hits: DataFrame, merge: str = "last") -> DataFrame:
    """One hit per query and source from the main and the branch layer; the branch wins.

    ``last`` keeps the lowest hit of the winning layer, as the reference does; ``best`` the highest.
    """
    sim = F.col("similarity")
    order = [(F.col("branch") != "").desc(), sim.asc() if merge == "last" else sim.desc()]
    tie = F.col("chunk_hash").desc() if merge == "last" else F.col("chunk_hash").asc()
    w = Window.partitionBy("query_id", "source").orderBy(*order, tie)
    return hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def mask_changed(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """Hide from the main layer the sources that a branch changed or deleted."""
    gone = (
        changes.filter(F.col("change").isin("changed", "deleted"))
        .select("collection_name", "source")
        .withColumn("branch", F.lit(""))
    )
    return chunks.join(gone, ["collection_name", "source", "branch"], "left_anti")


def search(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    threshold: float = THRESHOLD,
    wanted: Mapping[str, str] | None = None,
    branch: str | None = None,
    merge: str = "last",
) -> DataFrame:
    """Hits with their chunk columns: filter, top k, layer merge, and the threshold at the end.

    All queries search the main layer and ``branch``; a query column ``pr_branch`` names the branch per
    query instead, null for the main layer alone. A query column ``max_hits`` sets the limit per query, up to ``k``. The found keys are stored before their chunks are
    fetched: the planner then knows that they are few, and the chunk texts are scanned without a shuffle.
    """
    chosen = filter_metadata(chunks, wanted or {})
    own = "pr_branch" in queries.columns
    if not own:
        layers = [""] if branch is None else ["", branch]
        chosen = chosen.filter(F.col("branch").isin(*layers))
    layer = F.array_distinct(F.array(F.lit(""), F.coalesce(F.col("pr_branch") if own else F.lit(branch), F.lit(""))))
    asked = queries.drop("branch", "max_hits").withColumn("branch", F.explode(layer)).drop("pr_branch")
    best = nearest(chosen, asked, k)
    limited = "max_hits" in queries.columns
    limits = queries.select("query_id", F.coalesce("max_hits", F.lit(k)).alias("max_hits")) if limited else None
    if limited:
        best = best.join(limits, "query_id").filter("hit_no <= max_hits").drop("max_hits")
    found = stored(best.drop("hit_no"), "nearest")
    hits = with_chunk(found, chosen)
    if own or branch is not None:
        hits = merge_layers(hits, merge)
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "chunk_hash")
    ranked = hits.withColumn("hit_no", F.row_number().over(w)).filter(F.col("hit_no") <= k)
    if limited:
        ranked = ranked.join(limits, "query_id").filter("hit_no <= max_hits").drop("max_hits")
    return ranked.filter(F.col("similarity") >= threshold)
