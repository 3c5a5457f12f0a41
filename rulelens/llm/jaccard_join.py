"""Size-aware heavy-light join of documents on their sets of word n-grams.

Two documents link when the Jaccard similarity of their sets reaches ``NUMERATOR / DENOMINATOR`` (0.75). Sets of at
most ``x`` shingles are light, larger ones heavy; ``x`` comes from measured costs (:func:`boundary`).

* Light with light: for sizes s <= m a link means at least ``o = ceil(3 (s + m) / 7)`` shared shingles, so each set lists
  its subsets of exactly ``o`` shingles under the key (s, m, subset). Sets that share a key are linked, without
  any further check.
* Heavy with any: inverted lists of the first ``s - ceil(0.75 s) + 1`` shingles of each set, in one order of all
  shingles that puts the most frequent ones last. Linked sets share a list, and so many lists in all that the shingles
  behind the prefixes cannot make up for fewer (:func:`_needed`). Lists are scanned in two rounds: first
  every member is held against the list's smallest document, its pivot, which finds groups of copies in time linear in
  their size; then lists with members of different components are scanned with counters (:func:`_count`): sets are dealt to blocks by size, every
  block is sent the lists of its sets, and adds up in memory how many lists two sets share. Pairs that reach the number
  they need are verified in the block, on the whole sets, which are sent only where they are in such a pair, and only links that join its sets leave it (:func:`_forest`). A pair that gets at least half of the lists it needs
  from those where one of the two is the pivot is a candidate of the first round; any other linked pair gets more than half
  from the lists where neither is. So the second round leaves out the pivots, and with them all lists of two sets.

Equal sets are one node. The result is exact up to equal 64-bit hashes of different shingles. The
list of frequent shingles (``FREQUENT`` at most, 2 MB) only orders the shingles: any order gives the same links.

How it runs: shingles are hashed block by block in Arrow batches, and only list entries are shuffled, packed by key
range; sets are built again from the texts of candidates only. Members of one document's candidates are
dealt to groups of at most ``GROUP``. No pairs within a group of copies are emitted.

Defined results: null and empty texts, and texts without words, have an empty set and are linked with nothing. Rows with
equal ids are one document with several texts for links, each keeping its row; null ids get component null and link nothing.
An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulelens.llm.common import Words, bloom_filters, bucket_of, chain, fresh, mix, only, pack, partitions, portions, ranges, unpack, within
from rulelens.llm.components import components
from rulelens.session import dropped, stored

WORDS = 5
NUMERATOR, DENOMINATOR = 3, 4
FREQUENT = 262_144
LARGEST_LIGHT = 16
ENTRIES_PER_RANGE = 250_000
#: Meetings of two members of a list, before any bound, that a block of counters may see.
MEETINGS_PER_BLOCK = 20_000_000
PORTION_MEETINGS = 250_000
PIECE = 5_000
GROUP = 1_000
SALTS = 16
#: Texts are taken apart, and their shingles ordered, in parts of about this size, since that takes some 20 times their memory.
PART_BYTES, PART_SHINGLES = 1 << 20, 200_000
SUBSET_BIT = np.uint64(1)
DIGESTS = "doc_id bigint, n_shingles bigint, signature binary, shingle bigint, found bigint"
PACKED = "bucket int, n bigint, keys binary, docs binary, sizes binary, places binary"
SETS = "pivot bigint, part bigint, doc_id bigint, grams binary"
PAIRS = "pivot bigint, doc_id bigint"
ROLES = "doc_id bigint, pivot bigint, part bigint"
ENTRY = ("docs", "sizes", "places", "roots", "own")
LISTS = "key bigint, pivot bigint, pivot_size bigint, pivot_place bigint, doc_id bigint, size bigint, place bigint, certain boolean, need bigint"


def shingle_sets(texts: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sorted distinct shingle hashes, one after the other, and where each text's begin. A text
    of fewer than ``n`` words has one shingle, the whole sequence."""
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    parts = [_shingle_sets(part.column(0), n) for part in portions(batch, 0, PART_BYTES)]
    grams = np.concatenate([np.zeros(0, np.uint64), *(g for g, _ in parts)])
    sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(b) for _, b in parts)])
    return grams, np.concatenate([[0], np.cumsum(sizes)])


def _shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    words = Words(texts)
    counts, starts = words.counts, words.starts[:-1]
    tokens = mix(words.hashes)[words.codes]
    total = len(tokens)
    after = np.repeat(words.starts[1:], counts) - np.arange(total)  # words left in the text, this one included
    grams = tokens.copy()
    for k in range(1, n):
        longer = np.zeros(total, dtype=np.uint64)
        if total > k:
            longer[:-k] = chain(grams[:-k], tokens[k:])
        grams = np.where(after > k, longer, grams)
    full = after >= n
    full[starts[(counts > 0) & (counts < n)]] = True
    owner = np.repeat(np.arange(len(counts)), counts)[full]
    grams = grams[full]
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    fresh = np.ones(len(grams), dtype=bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
    owner, grams = owner[fresh], grams[fresh]
    bounds = np.searchsorted(owner, np.arange(len(counts) + 1))
    return grams, bounds


def least_overlap(a, b):
    """Shared shingles that two sets of these sizes need."""
    top, part = NUMERATOR * (a + b), NUMERATOR + DENOMINATOR
    return (top + part - 1) // part


def prefix_length(size):
    return size - (NUMERATOR * size + DENOMINATOR - 1) // DENOMINATOR + 1


def subset_count(size: int) -> int:
    return sum(math.comb(size, o) for _, _, o in _forms(size))


def _forms(size: int) -> list[tuple[int, int, int]]:
    """(smaller size, larger size, subset size) of all links a set of this size can have."""
    smaller = [(s, size) for s in range(-(-NUMERATOR * size // DENOMINATOR), size + 1)]
    larger = [(size, m) for m in range(size + 1, DENOMINATOR * size // NUMERATOR + 1)]
    return [(s, m, least_overlap(s, m)) for s, m in smaller + larger if least_overlap(s, m) <= s]


def boundary(costs: dict[int, tuple[int, float]]) -> int:
    """The largest light size, from (sets, list entries a set would scan) by set size: the one with the least
    total of subsets listed below and entries scanned above."""
    best, least = 0, sum(n * scan for n, scan in costs.values())
    for x in range(1, LARGEST_LIGHT + 1):
        total = sum(n * (subset_count(s) if s <= x else scan) for s, (n, scan) in costs.items())
        if total < least:
            best, least = x, total
    return best


def _digests(n: int):
    """Size and signature per document; and the shingles frequent within the batch."""
    kinds = {"doc_id": pa.int64(), "n_shingles": pa.int64(), "signature": pa.binary(), "shingle": pa.int64(), "found": pa.int64()}

    def rows(**columns):
        length = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], type=k) if c in columns else pa.nulls(length, k) for c, k in kinds.items()], names=list(kinds))

    def run(batches):
        for batch in (part for whole in batches for part in portions(whole, 1)):
            grams, bounds = shingle_sets(batch.column(1), n)
            data = memoryview(grams.tobytes())
            signatures = [xxhash.xxh3_128_digest(data[8 * a : 8 * b]) if b > a else None for a, b in itertools.pairwise(bounds)]
            # copies of a set count once
            own, firsts = {}, np.zeros(batch.num_rows, dtype=bool)
            for t, signature in enumerate(signatures):
                firsts[own.setdefault(signature, t)] = True
            seen, found = np.unique(grams[np.repeat(firsts, np.diff(bounds))], return_counts=True)
            many = found >= 3
            # the mean list length of each document's shingles within the batch prices its scan
            lengths = np.concatenate([[0], np.cumsum(found[np.searchsorted(seen, grams)])])
            sizes = np.diff(bounds)
            scans = np.diff(lengths[bounds]) * prefix_length(sizes) // np.maximum(sizes, 1)
            yield rows(doc_id=batch.column(0), n_shingles=sizes, signature=signatures, found=scans)
            yield rows(shingle=seen[many].view(np.int64), found=found[many])

    return run


def _entries(grams, bounds, ids, light: int, frequent: np.ndarray, ranks: np.ndarray):
    """(keys, documents, sizes, places) of all list entries of a batch, sorted by key."""
    part = bounds[:-1] // PART_SHINGLES
    cuts = [0, *_changes(part).tolist(), len(ids)]
    parts = [_unsorted_entries(grams[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], ids[a:b], light, frequent, ranks) for a, b in itertools.pairwise(cuts)]
    keys, docs, sizes, places = (np.concatenate(columns) for columns in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    return keys[order], docs[order], sizes[order], places[order]


def _unsorted_entries(grams, bounds, ids, light: int, frequent: np.ndarray, ranks: np.ndarray):
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.minimum(np.searchsorted(frequent, grams), max(len(frequent) - 1, 0))
    last = np.where(frequent[at] == grams, ranks[at], 0) if len(frequent) else np.zeros(len(grams), dtype=np.int64)
    order = np.lexsort((grams, last, owner))
    place = np.arange(len(grams)) - np.repeat(bounds[:-1], sizes)
    scanned = sizes * DENOMINATOR // NUMERATOR > light
    prefix = (place < np.repeat(prefix_length(sizes), sizes)) & scanned[owner]
    keys, docs, places = [grams[order][prefix] & ~SUBSET_BIT], [owner[prefix]], [place[prefix]]
    for t in np.flatnonzero((sizes > 0) & (sizes <= light)):
        own = grams[bounds[t] : bounds[t + 1]]
        listed = []
        for s, m, o in _forms(len(own)):
            chosen = np.array(list(itertools.combinations(own.tolist(), o)), dtype=np.uint64)
            key = np.full(len(chosen), (s << 32) + (m << 16) + o, dtype=np.uint64)
            for c in range(o):
                key = chain(key, chosen[:, c])
            listed.append(key | SUBSET_BIT)
        listed = np.unique(np.concatenate(listed))
        keys.append(listed)
        docs.append(np.full(len(listed), t))
        places.append(np.zeros(len(listed), dtype=np.int64))
    docs = np.concatenate(docs)
    return np.concatenate(keys), ids[docs], sizes[docs], np.concatenate(places)


def _postings(n: int, light: int, frequent: np.ndarray, ranks: np.ndarray, buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), *((c, pa.binary()) for c in ("keys", "docs", "sizes", "places"))])

    def run(batches):
        for batch in (part for whole in batches for part in portions(whole, 1)):
            known = batch.filter(pa.array(batch.column(0).is_valid()))
            if not known.num_rows:
                continue
            ids = known.column(0).to_numpy()
            grams, bounds = shingle_sets(known.column(1), n)
            keep = _first_of_copies(grams, bounds, ids)
            sizes = np.where(keep, np.diff(bounds), 0)
            grams = grams[np.repeat(keep, np.diff(bounds))]
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            keys, docs, sizes, places = _entries(grams, bounds, ids, light, frequent, ranks)
            cuts = np.flatnonzero(np.diff(bucket_of(keys, buckets))) + 1
            out = [
                {"bucket": int(bucket_of(k[:1], buckets)[0]), "n": len(k), "keys": k.tobytes(), "docs": pack(d), "sizes": pack(s.astype(np.int32)), "places": pack(p.astype(np.int32))}
                for k, d, s, p in zip(*(np.split(x, cuts) for x in (keys, docs, sizes, places)), strict=True)
                if len(k)
            ]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _first_of_copies(grams, bounds, ids) -> np.ndarray:
    """Which sets of a batch are the one with the smallest id among their equals."""
    data, first = memoryview(grams.tobytes()), {}
    keep = np.zeros(len(ids), dtype=bool)
    for t, (a, b) in enumerate(itertools.pairwise(bounds)):
        if b > a:
            other = first.setdefault(xxhash.xxh3_128_digest(data[8 * a : 8 * b]), t)
            if ids[t] < ids[other]:
                first[xxhash.xxh3_128_digest(data[8 * a : 8 * b])] = t
    keep[list(first.values())] = True
    return keep


def _lists(table: pa.Table) -> pa.Table:
    """The lists of a key range that have more than one document: every entry but the smallest document's, beside that one.

    ``need``: the least number of lists that a link of this entry with another such one of its list takes; null without
    one of a possible size."""
    rows = table.to_pylist()
    keys = np.concatenate([np.frombuffer(r["keys"], dtype=np.uint64) for r in rows])
    docs = np.concatenate([unpack(r["docs"], np.int64, r["n"]) for r in rows])
    sizes = np.concatenate([unpack(r["sizes"], np.int32, r["n"]) for r in rows]).astype(np.int64)
    places = np.concatenate([unpack(r["places"], np.int32, r["n"]) for r in rows]).astype(np.int64)
    order = np.lexsort((docs, keys))
    keys, docs, sizes, places = keys[order], docs[order], sizes[order], places[order]
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    group = np.cumsum(first) - 1
    at = np.flatnonzero(first)
    keep = docs != docs[at][group]
    pivot = at[group][keep]
    need = _least_needed(group[keep], sizes[keep])
    columns = [keys[keep].view(np.int64), docs[pivot], sizes[pivot], places[pivot], docs[keep], sizes[keep], places[keep], (keys[keep] & SUBSET_BIT) == SUBSET_BIT, pa.array(need, mask=need == 0)]
    return pa.Table.from_arrays([pa.array(c) for c in columns], names=[f.split(" ")[0] for f in LISTS.split(", ")])


def _least_needed(group: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per entry a lower bound of :func:`needed_lists` with any other entry of its group; 0 if no other has a possible size.

    Without its rounding, the number falls the further the sizes are apart, so the two ends of the possible sizes decide."""
    order = np.lexsort((sizes, group))
    own = sizes[order]
    at = (group[order].astype(np.int64) << 32) + own
    low = np.searchsorted(at, at - own - (-NUMERATOR * own // DENOMINATOR))
    high = np.searchsorted(at, at - own + DENOMINATOR * own // NUMERATOR, side="right") - 1
    n, d = NUMERATOR, DENOMINATOR
    ends = [(d * n * (own + b) - (n + d) * (n * np.maximum(own, b) - 1)) for b in (own[low], own[high])]
    least = np.maximum(-(-np.minimum(*ends) // (d * (n + d))), 1)
    found = np.empty(len(own), dtype=np.int64)
    found[order] = np.where(high > low, least, 0)
    return found


def _possible(a: str, b: str) -> str:
    """SQL: sets with these size and place columns can still be linked through this key."""
    sa, pa_, sb, pb = f"{a}size", f"{a}place", f"{b}size", f"{b}place"
    need = f"({NUMERATOR} * ({sa} + {sb}) + {NUMERATOR + DENOMINATOR - 1}) div {NUMERATOR + DENOMINATOR}"
    return (
        f"{DENOMINATOR} * least({sa}, {sb}) >= {NUMERATOR} * greatest({sa}, {sb})"
        f" and least({pa_}, {pb}) + 1 + least({sa} - {pa_}, {sb} - {pb}) - 1 >= {need}"
    )


def _needed(a: str, b: str) -> str:
    """SQL: how many lists two linked sets share at least. All common shingles up to the end of the prefix that ends
    first are common lists; behind it that set has ``ceil(0.75 s) - 1`` shingles left."""
    sa, sb = f"{a}size", f"{b}size"
    least = f"({NUMERATOR} * ({sa} + {sb}) + {NUMERATOR + DENOMINATOR - 1}) div {NUMERATOR + DENOMINATOR}"
    rest = [f"({NUMERATOR} * {s} + {DENOMINATOR - 1}) div {DENOMINATOR} - 1" for s in (sa, sb)]
    return f"greatest({least} - greatest({rest[0]}, {rest[1]}), 1)"


def needed_lists(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for arrays of sizes."""
    rest = [(NUMERATOR * s + DENOMINATOR - 1) // DENOMINATOR - 1 for s in (a, b)]
    return np.maximum(least_overlap(a, b) - np.maximum(*rest), 1)


def _meetings(entries: dict, block: int, level: int):
    """(larger, smaller, their sizes) of the pairs of some lists that belong to a block and may still be linked, in portions.

    A pair belongs to the block of its larger set (the larger id of equal sizes). All lists are taken at once: sorted
    by list and size, the partners of an entry are a range.
    """
    order = np.lexsort((entries["docs"], entries["sizes"], entries["list"]))
    docs, sizes, places, roots, own, number = (entries[c][order] for c in (*ENTRY, "list"))
    key = (number << 32) + sizes
    mine = np.flatnonzero(own == block)
    mine = mine[_level(sizes[mine]) == level]
    low = np.searchsorted(key, (number[mine] << 32) + -(-NUMERATOR * sizes[mine] // DENOMINATOR))
    high = np.searchsorted(key, key[mine], side="right")
    portion = np.cumsum(high - low) // PORTION_MEETINGS
    for p in np.unique(portion):
        at = portion == p
        x, y = np.repeat(mine[at], (high - low)[at]), ranges(low[at], (high - low)[at])
        rest = np.minimum(places[x], places[y]) + np.minimum(sizes[x] - places[x], sizes[y] - places[y])
        good = (roots[x] != roots[y]) & ((sizes[y] < sizes[x]) | (docs[y] < docs[x])) & (rest >= least_overlap(sizes[x], sizes[y]))
        x, y = x[good], y[good]
        yield docs[x], docs[y], sizes[x], sizes[y]


def _level(sizes):
    """Size classes; sets more than one class apart are never linked."""
    return np.floor(np.log(sizes) / math.log(DENOMINATOR / NUMERATOR)).astype(np.int64)


class _Counters:
    """How many lists every pair of a block shares."""

    def __init__(self) -> None:
        self.held, self.waiting, self.n = None, [], 0

    def add(self, parts: tuple[np.ndarray, ...]) -> None:
        self.waiting.append(np.stack(parts))
        self.n += len(parts[0])
        if self.n > max(2 * PORTION_MEETINGS, 0 if self.held is None else self.held.shape[1]):
            self._fold()

    def _fold(self) -> None:
        """Pairs and their sizes once, with counts."""
        if not self.waiting and self.held is None:
            self.held = np.zeros((5, 0), dtype=np.int64)
        if self.waiting:
            new = np.concatenate(self.waiting, axis=1)
            rows = np.concatenate([new, np.ones((1, new.shape[1]), dtype=np.int64)])
            rows = rows if self.held is None else np.concatenate([self.held, rows], axis=1)
            rows = rows[:, np.lexsort((rows[1], rows[0]))]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)])[: rows.shape[1]])
            self.held = np.concatenate([rows[:4, first], np.add.reduceat(rows[4:], first, axis=1) if len(first) else rows[4:, first]])
        self.waiting, self.n = [], 0

    def linked(self, more_than_half: bool) -> pa.RecordBatch:
        self._fold()
        a, b, size_a, size_b, n = self.held
        least = needed_lists(size_a, size_b)
        enough = 2 * n > least if more_than_half else n >= least
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[enough]), pa.array(np.maximum(a, b)[enough])], names=["pivot", "doc_id"])


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins, in any of the columns, without the first run."""
    return np.flatnonzero(np.logical_or.reduce([np.diff(c) != 0 for c in columns])) + 1


def _whole_lists(batches):
    """(block, level, entries) of portions of whole lists of one block; a list's rows follow one another, also across batches."""
    held = None

    def parts(entries):
        cuts = [0, *_changes(entries["block"], entries["level"]).tolist(), len(entries["key"])]
        for a, b in itertools.pairwise(cuts):
            part = {c: v[a:b] for c, v in entries.items()}
            part["list"] = np.zeros(b - a, dtype=np.int64)
            part["list"][_changes(part["key"])] = 1
            part["list"] = np.cumsum(part["list"])
            yield int(part["block"][0]), int(part["level"][0]), part

    for batch in batches:
        lengths = batch.column("docs").value_lengths().to_numpy(zero_copy_only=False)
        entries = {c: batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ENTRY}
        entries |= {c: np.repeat(batch.column(c).to_numpy(zero_copy_only=False), lengths) for c in ("block", "level", "key")}
        if held:
            entries = {c: np.concatenate([held[c], v]) for c, v in entries.items()}
        begins = _changes(entries["block"], entries["level"], entries["key"])
        last = int(begins[-1]) if len(begins) else 0
        if last:
            yield from parts({c: v[:last] for c, v in entries.items()})
        held = {c: v[last:] for c, v in entries.items()}
    if held and len(held["key"]):
        yield from parts(held)


def _forest(pairs: pa.RecordBatch, sets: dict[int, list[np.ndarray]]) -> pa.RecordBatch:
    """Linked ones of a block's candidates, without those whose ends earlier ones join: fewer than there are documents."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    other, own = (pairs.column(c).to_numpy() for c in ("pivot", "doc_id"))
    order = np.argsort(own, kind="stable")
    other, own = other[order], own[order]
    kept = []
    for a, b in itertools.pairwise([0, *_changes(own).tolist(), len(own)] if len(own) else [0]):
        doc = int(own[a])
        for at in range(a, b, GROUP):
            partners = [y for y in other[at : min(at + GROUP, b)].tolist() if root(y) != root(doc)]
            held = [(y, grams) for y in partners for grams in sets.get(y, ()) if len(grams)]
            for one in sets.get(doc, ()) if held else ():
                lengths = np.array([len(grams) for _, grams in held])
                found = within(one, np.concatenate([grams for _, grams in held])) >= 0
                shared = np.add.reduceat(found.astype(np.int64), np.cumsum(lengths) - lengths)
                for i in np.flatnonzero((shared > 0) & (shared >= least_overlap(len(one), lengths))):
                    y = held[i][0]
                    if root(y) != root(doc):
                        parent[root(y)] = root(doc)
                        kept.append((y, doc))
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in kept], pa.int64()) for i in (0, 1)], names=["pivot", "doc_id"])


def _without_sets(batches, sets: dict):
    """The rows of lists; rows without a key, which come before a block's lists, are put into ``sets``."""
    for batch in batches:
        alone = batch.column("key").is_null()
        for r in batch.filter(alone).select(["block", "level", "docs", "grams"]).to_pylist():
            sets.setdefault((r["block"], r["level"]), {}).setdefault(r["docs"][0], []).append(np.frombuffer(r["grams"], dtype=np.uint64))
        rest = batch.filter(pc.invert(alone))
        if rest.num_rows:
            yield rest


def _blocks(batches, more_than_half: bool, sets: dict | None = None):
    """((block, level), candidates) of the blocks; with ``sets`` only of documents whose set the block was sent."""
    for block, lists in itertools.groupby(_whole_lists(batches), key=lambda x: x[:2]):
        counters = _Counters()
        held = None if sets is None else np.array(list(sets.get(block, ())), dtype=np.int64)
        for number, level, entries in lists:
            if held is not None:
                own = np.isin(entries["docs"], held)
                entries = {c: v[own] for c, v in entries.items()}
            for found in _meetings(entries, number, level):
                counters.add(found)
        pairs = counters.linked(more_than_half)
        del counters
        yield block, pairs


def _count(more_than_half: bool, verify: bool):
    """Candidates (pivot, doc_id) of the blocks; with ``verify`` the links that join them."""

    def run(batches):
        sets: dict[tuple[int, int], dict] | None = {} if verify else None
        for block, pairs in _blocks(_without_sets(batches, sets) if verify else batches, more_than_half, sets):
            yield _forest(pairs, sets.pop(block, {})) if verify else pairs

    return run


def _in_candidates(more_than_half: bool):
    """(doc_id, block as ``pivot``, level as ``part``) of the documents of every block that are in one of its candidates."""

    def run(batches):
        for (number, level), pairs in _blocks(batches, more_than_half):
            docs = np.unique(np.concatenate([pairs.column(c).to_numpy() for c in (0, 1)]))
            columns = [docs, np.full(len(docs), number), np.full(len(docs), level)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "pivot", "part"])

    return run


def _enough_lists(scanned: DataFrame) -> DataFrame:
    """Entries of documents with so many lists that the second round can link them.

    A pair that needs ``k`` lists has more than ``k / 2`` of them here, each of a ``need`` up to ``k``. So entries above the largest
    need that is met by half as many entries of the document are in no such pair.
    """
    least = Window.partitionBy("doc_id")
    upto = F.count("*").over(least.orderBy("need"))
    counted = scanned.filter("need is not null").withColumn("_most", F.when(2 * upto > F.col("need"), F.col("need")))
    return counted.withColumn("_most", F.max("_most").over(least)).filter("need <= _most").drop("_most")


def open_pairs(rest: DataFrame, more_than_half: bool = False, docs: DataFrame | None = None, n: int = WORDS) -> DataFrame:
    """Candidates (pivot, doc_id) of stored open lists ``rest`` (key, doc_id, size, place, root), by counters.

    They share as many lists as they need; with ``more_than_half``, for lists without their pivots, more than half as many.
    With ``docs`` (doc_id, text) every block is also sent the sets of its documents, and only links leave it, at most
    one for each document: what joins all linked ones, however many pairs a group of similar documents has. The blocks are counted
    twice then: first for the documents that are in a candidate of the block, as only their sets are sent there."""
    level = F.floor(F.log(F.col("size").cast("double")) / math.log(DENOMINATOR / NUMERATOR)).cast("bigint")
    leveled = rest.withColumn("level", level)
    counts = stored(leveled.groupBy("key", "level").agg(F.count("*").alias("n")), "list-sizes")
    smaller = counts.select("key", (F.col("level") + 1).alias("level"), F.col("n").alias("below"))
    meetings = counts.join(smaller, ["key", "level"], "left").groupBy("level").agg(F.sum(F.col("n") * (F.col("n") + F.coalesce("below", F.lit(0)))).alias("m"))
    blocks = stored(meetings.select("level", F.ceil(F.col("m") / MEETINGS_PER_BLOCK).alias("blocks")), "counter-blocks")
    dealt = leveled.join(blocks, "level").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    # a list is sent to the blocks of its sets in the level of their own and in the next one
    visits = stored(dealt.select("key", "level", F.col("own").alias("block")).distinct(), "visits")
    piece = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.ceil(F.col("n") / PIECE))
    entry = F.struct("doc_id", "size", "place", "root", "own")
    lists = dealt.join(counts, ["key", "level"]).groupBy("key", F.col("level").alias("from"), piece.alias("piece")).agg(F.collect_list(entry).alias("e"))
    packed = stored(lists.select("key", "from", *(F.col(f"e.{c}").alias(name) for c, name in zip(("doc_id", "size", "place", "root", "own"), ENTRY, strict=True))), "packed-lists")
    sent = packed.withColumn("level", F.explode(F.array(F.col("from"), F.col("from") + 1))).drop("from").join(visits, ["key", "level"]).select("key", "level", "block", *ENTRY)
    if docs is not None:
        meets = stored(_dealt(sent).mapInArrow(_in_candidates(more_than_half), ROLES), "in-candidates")
        found = _with_roles(docs, meets)
        sets = found.mapInArrow(_sets(n), SETS).select(F.col("part").alias("level"), F.col("pivot").alias("block"), F.array("doc_id").alias("docs"), "grams")
        with bloom_filters(docs.sparkSession):
            sets = stored(sets, "open-sets")
        asked = stored(meets.select(F.col("pivot").alias("block"), F.col("part").alias("level")).distinct(), "open-blocks")
        sent = sent.join(asked, ["block", "level"], "left_semi").unionByName(sets, allowMissingColumns=True)
    return _dealt(sent).mapInArrow(_count(more_than_half, docs is not None), PAIRS)


def _dealt(sent: DataFrame) -> DataFrame:
    """The rows of a block in one partition, one after the other, those without a key first."""
    return sent.repartition("block", "level").sortWithinPartitions("block", "level", F.col("key").asc_nulls_first())


def _with_roles(docs: DataFrame, roles: DataFrame) -> DataFrame:
    """(doc_id, text, roles) of the documents that have ``roles`` (doc_id, pivot, part). Texts of other documents
    are left out before the shuffle, by a Bloom filter of Spark's own where there are too many roles to be broadcast."""
    listed = stored(roles.groupBy("doc_id").agg(F.collect_list(F.struct("pivot", "part")).alias("roles")), "candidates")
    return docs.select("doc_id", "text").join(listed.filter(F.size("roles") > 0), "doc_id").select("doc_id", "text", "roles")


def _sets(n: int):
    """Per role of a document a row with its set, which is made once."""
    schema = pa.schema([("pivot", pa.int64()), ("part", pa.int64()), ("doc_id", pa.int64()), ("grams", pa.binary())])

    def run(batches):
        for batch in (part for whole in batches for part in portions(whole, 1, 1 << 20)):
            grams, bounds = shingle_sets(batch.column(1), n)
            data = grams.tobytes()
            for t, (doc, roles) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                own = data[8 * bounds[t] : 8 * bounds[t + 1]]
                rows_a_batch = max(1, (8 << 20) // max(len(own), 1))
                for at in range(0, len(roles), rows_a_batch):
                    some = roles[at : at + rows_a_batch]
                    columns = [[r["pivot"] for r in some], [r["part"] for r in some], [doc] * len(some), [own] * len(some)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _verify(group: pa.Table) -> pa.Table:
    """Members of a group against the sets of its pivot, the document whose id is the group's."""
    rows = list(zip(*(group.column(c).to_pylist() for c in ("pivot", "doc_id", "grams")), strict=True))
    own = [np.frombuffer(grams, dtype=np.uint64) for pivot, doc, grams in rows if doc == pivot]
    out = set()
    for pivot, doc, grams in rows:
        two = np.frombuffer(grams, dtype=np.uint64)
        if doc != pivot and any(_linked(one, two) for one in own):
            out.add((pivot, doc))
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})


def _linked(one: np.ndarray, two: np.ndarray) -> bool:
    shared = len(np.intersect1d(one, two, assume_unique=True))
    return shared > 0 and shared >= least_overlap(len(one), len(two))


def verified(docs: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """The linked ones of stored distinct pairs (pivot, doc_id), as edges a, b.

    Pairs are dealt to parts of about ``GROUP`` members of one pivot. Every candidate's text is looked up once, with the
    list of its roles (parts it is a member or the pivot of), and its set is sent to each of them, nowhere else.
    """
    parts = stored(pairs.groupBy("pivot").agg(F.ceil(F.count("*") / GROUP).alias("parts")), "pivots")
    member = pairs.join(parts, "pivot").select("doc_id", "pivot", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part"))
    pivot = parts.select(F.col("pivot").alias("doc_id"), "pivot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    sets = _with_roles(docs, member.unionByName(pivot)).mapInArrow(_sets(n), SETS)
    return sets.groupBy("pivot", "part").applyInArrow(_verify, "a bigint, b bigint")


def equal_sets(digests: DataFrame) -> DataFrame:
    """(a, b, spare): the smallest document ``a`` of equal sets and another one ``b``; ``spare`` if ``b`` has no row with another set."""
    rows = digests.filter("shingle is null and n_shingles > 0 and doc_id is not null").select("doc_id", "signature")
    firsts = rows.groupBy("signature").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    shared = firsts.filter("copies > 1").select("signature", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    found = salted.join(shared, ["signature", "_salt"], "left").withColumn("copy", F.coalesce(F.col("first") != F.col("doc_id"), F.lit(False)))
    spare = F.bool_and("copy").alias("spare")
    return found.groupBy("doc_id").agg(F.collect_set(F.when(F.col("copy"), F.col("first"))).alias("a"), spare).select(F.explode("a").alias("a"), F.col("doc_id").alias("b"), "spare")


def links(docs: DataFrame, n: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(digests of all documents, edges a, b whose components are those of all links, equal sets included).

    ``docs``: doc_id, text.
    """
    digests = stored(docs.mapInArrow(_digests(n), DIGESTS), "set-digests")
    counted = digests.filter("shingle is not null").groupBy("shingle").agg(F.sum("found").alias("n"))
    top = counted.orderBy(F.desc("n"), "shingle").limit(FREQUENT).select("shingle").toArrow()  # orders shingles only
    frequent = top.column(0).to_numpy().view(np.uint64)
    ranks = np.arange(len(frequent), 0, -1, dtype=np.int64)
    order = np.argsort(frequent)
    frequent, ranks = frequent[order], ranks[order]
    own = digests.filter("shingle is null and n_shingles > 0")
    small = own.filter(F.col("n_shingles") <= LARGEST_LIGHT).groupBy("n_shingles").agg(F.count("*").alias("n"), F.avg("found").alias("scan")).collect()
    light = boundary({r["n_shingles"]: (r["n"], r["scan"]) for r in small})
    entries = own.agg(F.sum(F.col("n_shingles") - F.ceil(F.col("n_shingles") * (NUMERATOR / DENOMINATOR)) + 1)).first()[0] or 0
    buckets = max(1, math.ceil(entries / ENTRIES_PER_RANGE), min(partitions(docs), math.ceil(entries / 50_000)))

    packed = docs.mapInArrow(_postings(n, light, frequent, ranks, buckets), PACKED)
    lists = stored(packed.groupBy("bucket").applyInArrow(_lists, LISTS), "lists")
    copies = stored(equal_sets(digests), "equal-sets")
    certain = lists.filter("certain").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    scanned = lists.filter("not certain")

    # most linked sets share half of the lists they need with the smallest member itself; the others are met below
    starred = scanned.filter(_possible("pivot_", "")).groupBy("pivot", "pivot_size", "doc_id", "size").agg(F.count("*").alias("n"))
    # a copy of an equal set has that one's links
    spare = stored(copies.filter("spare").select(F.col("b").alias("doc_id")).distinct(), "spare-copies")
    near = starred.filter(f"2 * n >= {_needed('pivot_', '')}").select("pivot", "doc_id")
    first = stored(near.join(spare, "doc_id", "left_anti").select("pivot", "doc_id"), "pairs")
    with bloom_filters(docs.sparkSession):
        edges = stored(verified(docs, first, n).unionByName(certain).unionByName(copies.select("a", "b")), "links")

    # members of one list that are still in different components
    roots = components(edges)
    node = _enough_lists(scanned.join(spare, "doc_id", "left_anti")).join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")).select("key", "doc_id", "size", "place", "root")
    apart = node.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    rest = stored(node.join(apart, "key", "left_semi"), "open-lists")
    dropped(lists)
    more = stored(open_pairs(rest, more_than_half=True, docs=docs, n=n).select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")), "links")
    return digests, edges.unionByName(more)


def join(docs: DataFrame, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable by links, itself included)."""
    source = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    digests, edges = links(source, n)
    rows = digests.filter("shingle is null").select("doc_id", "n_shingles")
    roots = components(edges)
    return rows.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of one row of each group of linked documents, the one with the smallest id; rows without an id
    are linked with nothing and stay."""
    firsts = join(docs, n, id_col, text_col).filter("doc_id = component_id").select("doc_id").distinct()
    key, rank = fresh(docs, "_id"), fresh(docs, "_rank")
    named = docs.withColumn(key, F.col(f"`{id_col}`").cast("bigint"))
    kept = named.join(stored(firsts, "first-ids").withColumnRenamed("doc_id", key), key, "left_semi")
    single = kept.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(F.col(f"`{text_col}`"))))).filter(F.col(rank) == 1)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return single.select(*columns).unionByName(named.filter(F.col(key).isNull()).select(*columns))
