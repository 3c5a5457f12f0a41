"""The prefix trie of conversations, encoded as balanced parentheses per shard.

A node stands for a sequence of first turns that one or more conversations share. Conversations are sorted by their sequences
of turn digests and cut into shards. Of each shard the trie is one string of parentheses: from one
conversation to the next, as many close as the last one has turns beyond their common prefix, and as many open as the new one has.

* :class:`Parens` keeps the least and greatest excess of blocks, and of pairs of blocks up to the root. ``find_close`` passes over the
  blocks whose range does not hold the excess it looks for; the match of a node's parenthesis delimits its subtree.
* A subtree's leaves are the pairs ``()`` inside, a difference of two ranks; its savings are a difference of a cumulative array.
* The nodes on the first and the last path of a shard, its spines, can go on in a neighbour. All measures are sums (or a minimum), so
  shards add up, after correcting what neighbours both count: the nodes of the common prefix of one's last and the other's first
  path, and a leaf that goes on.

How it runs: texts become digests and lengths before the first shuffle. One range shuffle sorts the sequences, ties by id, so that
thousands of equal conversations are spread over shards; a shard holds about ``TURNS`` turns, whatever the partition's size. Only
spines, one row per shard and depth, are merged. The ids that end in a merged node come as one piece per shard and are digested in order without
being held together. A conversation is one value (20 bytes a turn), as a text is elsewhere.

Defined results: null roles and texts are empty. Turns are ordered by number, null first, and equal numbers by digest, so
repeated rows are turns of their own. Rows without a conversation id belong to none. A conversation without turns ends in the
root. Texts of any length count whole. An empty table has no nodes, not even a root. Equal 128-bit digests of different turns would count
as one. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulelens.llm.common import only, partitions, ranges
from rulelens.session import stored

TURNS = 200_000
KEY = 16
BLOCK = 64
EMPTY = hashlib.sha256(b"").hexdigest()
NODES = "shard bigint, depth bigint, node binary, above binary, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string, piece string, first binary, chars array<int>, last binary"
_KINDS = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
SCHEMA = pa.schema([(name, _KINDS[kind]) for name, kind in (f.split(" ") for f in NODES.split(", "))])
MERGED = ("depth", "node", "above", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
SHARED = "depth bigint, node binary, above binary, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns) per conversation; a turn is (key, chars), its digest and its code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = only(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).filter("conv_id is not null")
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), key.alias("key"), F.length(text).alias("chars"))
    listed = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return listed.select("conv_id", F.transform("ts", lambda t: F.struct(t["key"].alias("key"), t["chars"].alias("chars"))).alias("turns"))


class Parens:
    """A balanced sequence of parentheses (1 opens, 0 closes) with range min-max excess blocks."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(np.where(bits == 1, 1, -1))
        blocks = -(-len(bits) // BLOCK)
        cuts = np.arange(blocks) * BLOCK
        self.levels = [(np.minimum.reduceat(self.excess, cuts), np.maximum.reduceat(self.excess, cuts))]
        while len(self.levels[-1][0]) > 1:
            least, most = self.levels[-1]
            pairs = np.arange(0, len(least), 2)
            self.levels.append((np.minimum.reduceat(least, pairs), np.maximum.reduceat(most, pairs)))

    def _holds(self, level: int, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        least, most = self.levels[level]
        inside = at < len(least)
        at = np.minimum(at, len(least) - 1)
        return inside & (least[at] <= value) & (value <= most[at])

    def _scan(self, start: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Where the excess first is ``value`` between ``start`` and the end of its block; -1 if nowhere."""
        found, end = np.full(len(start), -1, dtype=np.int64), np.minimum((start // BLOCK + 1) * BLOCK, len(self.bits))
        left, at = np.arange(len(start)), start.copy()
        while len(left):
            inside = at < end[left]
            left, at = left[inside], at[inside]
            hit = self.excess[at] == value[left]
            found[left[hit]] = at[hit]
            left, at = left[~hit], at[~hit] + 1
        return found

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """The positions of the parentheses that match those opened at ``opens``."""
        target = self.excess[opens] - 1
        found = np.full(len(opens), -1, dtype=np.int64)
        near = (opens + 1) % BLOCK != 0
        found[near] = self._scan(opens[near] + 1, target[near])
        left = np.flatnonzero(found < 0)
        at = opens[left] // BLOCK + 1
        level, stops = 0, [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] * len(self.levels)
        while len(left):  # upwards, over whole ranges that do not hold the value
            odd = at % 2 == 1 if level + 1 < len(self.levels) else np.ones(len(at), dtype=bool)
            hit = odd & self._holds(level, at, target[left])
            stops[level] = (left[hit], at[hit])
            left, at = left[~hit], (at[~hit] + 1) // 2
            level += 1
        nodes, at = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for level in range(len(self.levels) - 1, -1, -1):  # and down to the first block that does
            nodes, at = np.concatenate([nodes, stops[level][0]]), np.concatenate([at, stops[level][1]])
            if level:
                at = np.where(self._holds(level - 1, 2 * at, target[nodes]), 2 * at, 2 * at + 1)
        found[nodes] = self._scan(at * BLOCK, target[nodes])
        return found


def common_prefixes(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many first turns every sequence shares with the one before it; ``keys`` has a row per turn."""
    lengths = np.diff(starts)
    shared = np.minimum(lengths[:-1], lengths[1:])
    differ = np.flatnonzero((keys[ranges(starts[:-2], shared)] != keys[ranges(starts[1:-1], shared)]).any(axis=1))
    begins = np.cumsum(shared) - shared
    at = np.searchsorted(differ, begins)
    first = np.concatenate([differ, [np.iinfo(np.int64).max]])[at]
    return np.concatenate([[0], np.minimum(first - begins, shared)])


def prefix_digests(path: bytes) -> list[bytes]:
    """The digests of all prefixes of a path, from the empty one on."""
    running = xxhash.xxh3_128()
    out = [running.digest()]
    for at in range(0, len(path), KEY):
        running.update(path[at : at + KEY])
        out.append(running.digest())
    return out


def shard_nodes(shard: int, ids: np.ndarray, paths: list[bytes], chars: np.ndarray) -> pa.RecordBatch:
    """The nodes of a run of sorted conversations, and one row with its first and last path.

    Nodes off the spines are final; ``above`` is set where the parent lies on a spine.
    """
    keys = np.frombuffer(b"".join(paths), dtype=np.uint64).reshape(-1, 2)
    lengths = np.array([len(p) // KEY for p in paths], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    shared = common_prefixes(keys, starts)
    opened, closed = lengths - shared, np.concatenate([lengths[:-1] - shared[1:], [lengths[-1] + 1]])
    opened[0] += 1  # the root
    runs = np.stack([opened, closed], axis=1).ravel()
    parens = Parens(np.repeat(np.tile(np.array([1, 0], dtype=np.int8), len(ids)), runs))

    opens = np.flatnonzero(parens.bits)
    close = parens.find_close(opens)
    n = len(opens)
    node = np.arange(n)
    depth = parens.excess[opens] - 1
    after = node + (close - opens + 1) // 2  # the first node behind the subtree
    leaf = np.concatenate([[0], np.cumsum((parens.bits[:-1] == 1) & (parens.bits[1:] == 0))])
    end = np.cumsum(opened) - 1  # the node in which each conversation ends
    low, high = np.searchsorted(end, node), np.searchsorted(end, after)
    least = np.minimum.reduceat(np.append(ids, np.iinfo(np.int64).max), np.stack([low, high], axis=1).ravel())[::2]
    members = high - low
    own = np.concatenate([[0], chars[ranges(starts[:-1] + shared, lengths - shared)]]).astype(np.int64)
    saved = np.concatenate([[0], np.cumsum((members - 1) * own)])

    by_depth = np.sort(depth * (n + 1) + node)
    parent = np.where(depth > 0, by_depth[np.searchsorted(by_depth, (depth - 1) * (n + 1) + node) - 1] % (n + 1), -1)
    children = np.bincount(parent[1:], minlength=n)

    spine = np.full(n, None, dtype=object)
    right = np.flatnonzero((node <= end[-1]) & (end[-1] < after))
    spine[right] = prefix_digests(paths[-1])
    spine[: lengths[0] + 1] = prefix_digests(paths[0])
    above = np.where(parent >= 0, spine[parent], None)
    on_spine = np.not_equal(spine, None)

    ends, pieces = [None] * n, [None] * n
    first_of = np.flatnonzero(np.concatenate([[True], np.diff(end) > 0]))
    for a, b in zip(first_of.tolist(), [*first_of[1:].tolist(), len(end)], strict=True):
        at, text = int(end[a]), ",".join(map(str, ids[a:b].tolist()))
        if on_spine[at]:
            pieces[at] = text
        else:
            ends[at] = hashlib.sha256(text.encode()).hexdigest()
    columns = {
        "shard": np.full(n, shard), "depth": depth, "node": spine.tolist(), "above": above.tolist(), "conv_id": least,
        "parent_conv_id": pa.array(least[np.maximum(parent, 0)], mask=parent < 0), "n_convs": members, "n_children": children,
        "n_leaves": leaf[close] - leaf[opens], "saved_tokens": saved[after] - saved[node], "ends": ends, "piece": pieces,
    }
    rows = pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if f.name in columns else pa.nulls(n, f.type) for f in SCHEMA], schema=SCHEMA)
    edge = {"shard": shard, "first": paths[0], "chars": chars[: lengths[0]].tolist(), "last": paths[-1]}
    return pa.concat_batches([rows, pa.RecordBatch.from_pylist([edge], schema=SCHEMA)])


def _shards(limit: int):
    def run(batches):
        from pyspark import TaskContext

        shard, held, turns = TaskContext.get().partitionId() << 32, [], 0

        def nodes():
            table = pa.Table.from_batches(held).combine_chunks()
            chars = table["chars"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return shard_nodes(shard, table["conv_id"].to_numpy(), table["path"].to_pylist(), chars)

        for batch in batches:
            held.append(batch)
            turns += batch.num_rows + len(batch.column("chars").flatten())
            if turns >= limit:
                yield nodes()
                shard, held, turns = shard + 1, [], 0
        if turns:
            yield nodes()

    return run


def _corrections(batches):
    """What two neighbours both count: -1 child and the own characters for each shared node, -1 leaf where a leaf goes on."""
    for batch in batches:
        for row in batch.to_pylist():
            first, last = row["first"], row["before"]
            shared = 0
            while (shared + 1) * KEY <= min(len(first), len(last)) and first[shared * KEY : (shared + 1) * KEY] == last[shared * KEY : (shared + 1) * KEY]:
                shared += 1
            digests, goes_on = prefix_digests(first[: shared * KEY]), len(last) == shared * KEY
            left = sum(row["chars"][:shared])
            out = []
            for d, digest in enumerate(digests):
                left -= row["chars"][d - 2] if d > 1 else 0
                out.append((d, digest, digests[d - 1] if d else None, None, 0, -int(d < shared), -int(goes_on), left))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=SCHEMA.field(name).type) for name, c in zip(MERGED, zip(*out, strict=True), strict=True)], names=list(MERGED))


def _digests(batches):
    """SHA-256 of the pieces of each node, joined by commas, one after the other."""
    node, running = None, None
    for batch in batches:
        out = []
        for key, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if key != node:
                if node is not None:
                    out.append((node, running.hexdigest()))
                node, running = key, hashlib.sha256(piece.as_py().encode())
            else:
                running.update(b"," + piece.as_py().encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], type=kind) for i, kind in enumerate((pa.binary(), pa.string()))], names=["node", "ends"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([running.hexdigest()])], names=["node", "ends"])


def nodes(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of ``conversations`` (conv_id, turns), ids unique.

    Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), ""))
    rows = stored(conversations.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars")), "paths")
    found = rows.agg(F.count("*"), F.sum(F.size("chars"))).first()
    total = found[0] + (found[1] or 0)
    shards = max(1, math.ceil(total / TURNS), min(partitions(rows), found[0] // 500))
    dealt = rows.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    trie = stored(dealt.mapInArrow(_shards(TURNS), NODES), "trie-nodes")

    edges = trie.filter("last is not null")
    order = edges.select("shard", F.lag("shard").over(Window.orderBy("shard")).alias("earlier")).filter("earlier is not null")
    pairs = order.join(edges.select("shard", "first", "chars"), "shard").join(edges.select(F.col("shard").alias("earlier"), F.col("last").alias("before")), "earlier")
    partial = trie.filter("node is not null")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    every = partial.select(*MERGED).unionByName(pairs.select("first", "chars", "before").mapInArrow(_corrections, SHARED))
    merged = stored(every.groupBy("node").agg(F.first("depth").alias("depth"), F.first("above").alias("above"), F.min("conv_id").alias("conv_id"), *sums), "spines")
    pieces = partial.filter("piece is not null").repartition("node").sortWithinPartitions("node", "shard").select("node", "piece")
    ends = stored(pieces.mapInArrow(_digests, "node binary, ends string"), "spine-ends")

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256")]
    parents = merged.select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    spines = merged.join(ends, "node", "left").join(parents, "above", "left").select(*columns)
    inner = trie.filter("node is null and depth is not null")
    final = inner.filter("above is null").select(*columns)
    # children of spine nodes look their parent up shard by shard
    local = partial.select("shard", "node").join(merged.select("node", F.col("conv_id").alias("parent_conv_id")), "node").withColumnRenamed("node", "above")
    below = inner.filter("above is not null").drop("parent_conv_id").join(local, ["shard", "above"]).select(*columns)
    return final.unionByName(below).unionByName(spines)
