"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time evaluation.

The index is a table of inverted lists, one row per segment and term, where a segment is a run of documents of about
``SEGMENT_BYTES`` of text. A query is evaluated segment by segment:

* term at a time: the short lists (at most one document in ``1 / SHORT``) are summed into accumulators, which from
  then on are one more list, sorted by document, with bounds like any other. Their k-th best sum is the first threshold, as further terms only add;
* document at a time: the long lists and the accumulators have a peak per window of ``WINDOW`` documents. Windows whose
  peaks together stay below the threshold are skipped. In the others the candidates come from the essential lists only,
  those without which the threshold cannot be reached; each candidate's score is completed from the remaining lists, highest peak
  first, and dropped as soon as what is left cannot lift it to the threshold.

The result is exact: all bounds are compared so that equal scores survive, and ties go to the smaller id.

Terms are the maximal runs of ASCII letters and digits and of characters beyond ASCII, with A-Z in lower case. For N
documents with terms, L terms in them, a document with n terms and a term in df documents::

    w = floor(1000 ln((2 N + 2) / (2 df + 1)))     m = 10 + 90 n N div L
    score = sum over the query's distinct terms of w * (10^9 tf div (1000 tf + 8 m))

How it runs: texts are read once, for the index; only lists of asked terms leave it. Queries are dealt to blocks of at
most ``BLOCK``; the group of a segment and a block holds one segment's asked lists and the block's queries, both of bounded size.
A segment gives at most k rows per query, and Spark keeps the best k of a query before and after the last shuffle.

Defined results: null texts, empty ones and those without a term have no list and are never found, and queries without a
term find nothing. Texts of any length are indexed whole. Rows with equal ids are documents of their own and may all
be ranked; rows with a null id come after all others of their score. Queries with equal id and text are one query; with equal
id and different text each is ranked. Equal 64-bit hashes of different terms would count them as one.
An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulelens.llm.common import Words, as_text, only, portions, ranges, within
from rulelens.operators.numbering import number_within
from rulelens.session import stored

SEGMENT_BYTES = 8 << 20
BLOCK = 256
SHORT = 1 / 16
WINDOW = 128
STRIDE = 64
TOP = 10
SALTS = 64
NULL_ID = np.iinfo(np.int64).max

INDEX = "segment bigint, term bigint, n int, docs binary, counts binary, ids binary, known binary, lengths binary, total bigint"
_KINDS = {"segment": pa.int64(), "term": pa.int64(), "n": pa.int32(), **dict.fromkeys(("docs", "counts", "ids", "known", "lengths"), pa.binary()), "total": pa.int64()}
TERMS = "item_id bigint, query bigint, terms array<bigint>"
RANKED = "item_id bigint, query bigint, doc_id bigint, score bigint"

#: Bytes that belong to no term become spaces, and A-Z lower case.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words_of(texts: pa.Array) -> Words:
    """The terms of a batch of texts. Bytes are replaced one for one, so the texts keep their places."""
    texts = as_text(texts)
    _, offsets, data = texts.buffers()
    folded = pa.py_buffer(data.to_pybytes().translate(_FOLD)) if data is not None else None
    return Words(pa.LargeStringArray.from_buffers(len(texts), offsets, folded), lower=False)


def _binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Slices of an integer array as one binary value each."""
    data = np.ascontiguousarray(values)
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * data.itemsize).astype(np.int32)), pa.py_buffer(data)])


def _rows(**columns) -> pa.RecordBatch:
    length = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[k], type=kind) if k in columns else pa.nulls(length, kind) for k, kind in _KINDS.items()], names=list(_KINDS))


def _index():
    def run(batches):
        from pyspark import TaskContext

        segment = TaskContext.get().partitionId() << 32
        for batch in (part for whole in batches for part in portions(whole, 1, SEGMENT_BYTES)):
            words = words_of(batch.column(1))
            lengths = words.counts
            held = np.flatnonzero(lengths)
            if not len(held):
                continue
            known = np.array(batch.column(0).is_valid())
            ids = np.where(known, batch.column(0).fill_null(0).to_numpy(), NULL_ID)
            order = held[np.lexsort((ids[held], ~known[held]))]  # documents of a segment by id, null ids last
            number = np.full(len(lengths), -1, dtype=np.int64)
            number[order] = np.arange(len(order))
            pairs = words.codes.astype(np.int64) * len(order) + np.repeat(number, lengths)
            pairs, counts = np.unique(pairs, return_counts=True)
            code, docs = np.divmod(pairs, len(order))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1, [len(code)]])
            terms = words.hashes[code[cuts[:-1]]].view(np.int64)
            ids, known, lengths = ids[order], known[order], lengths[order]
            yield _rows(segment=[segment], ids=[ids.tobytes()], known=[known.tobytes()], lengths=[lengths.astype(np.int64).tobytes()], n=[len(order)], total=[int(lengths.sum())])
            yield _rows(segment=np.full(len(terms), segment), term=terms, n=np.diff(cuts).astype(np.int32), docs=_binaries(docs.astype(np.int32), cuts), counts=_binaries(counts.astype(np.int32), cuts))
            segment += 1

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted lists of all documents, as a stored table; any number of searches can use it.

    A row with a term is a list; a row without one describes its segment.
    """
    source = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return stored(source.mapInArrow(_index(), INDEX), "lexical-index", "zstd")


def _query_terms(batches):
    for batch in batches:
        for part in portions(batch, 1):
            words = words_of(part.column(1))
            hashes = words.hashes[words.codes].view(np.int64)
            terms = [np.unique(hashes[a:b]) for a, b in zip(words.starts[:-1], words.starts[1:], strict=True)]
            numbers = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(numbers), pa.array(np.concatenate(terms) if terms else [], type=pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists], names=["item_id", "query", "terms"])


def query_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, query, block, terms) of all distinct queries; ``query`` is a digest of the text."""
    plain = only(items, item_id=id_col, text=text_col).filter("text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text", F.xxhash64("text").alias("query")).distinct()
    asked = stored(plain.mapInArrow(_query_terms, TERMS).filter(F.size("terms") > 0), "query-terms")
    blocks = max(1, -(-asked.count() // BLOCK))
    # a place in a sorted run, cut into blocks: a block never holds more than BLOCK queries
    return stored(_numbered(asked).withColumn("block", F.expr(f"number div {BLOCK}")).drop("number"), "query-blocks") if blocks > 1 else asked.withColumn("block", F.lit(0).cast("bigint"))


def _numbered(asked: DataFrame) -> DataFrame:
    part = F.pmod(F.xxhash64("item_id", "query"), F.lit(1024))
    return number_within(asked.withColumn("_all", F.lit(0)), ["_all"], [part, F.col("item_id"), F.col("query")], part, "number").drop("_all")


class _List:
    """A sorted list of documents with gains, its peak, and its peak per window."""

    def __init__(self, docs: np.ndarray, gains: np.ndarray, windows: int):
        self.docs, self.gains = docs, gains
        self.starts = np.searchsorted(docs, np.arange(windows + 1) * WINDOW)
        self.peaks = np.zeros(windows, dtype=np.int64)
        full = np.flatnonzero(np.diff(self.starts))
        if len(full):
            self.peaks[full] = np.maximum.reduceat(gains, self.starts[full])
        self.peak = int(self.peaks.max(initial=0))


def accumulated(lists: list[_List], windows: int) -> _List:
    """Term at a time: short lists summed into one."""
    docs, at = np.unique(np.concatenate([x.docs for x in lists]), return_inverse=True)
    sums = np.zeros(len(docs), dtype=np.int64)
    np.add.at(sums, at, np.concatenate([x.gains for x in lists]))
    return _List(docs, sums, windows)


def best(docs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((docs, -scores))[:k]
    return docs[order], scores[order]


def top_documents(lists: list[_List], n_docs: int, k: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the k best by score and then by place."""
    windows = -(-n_docs // WINDOW)
    short = [x for x in lists if len(x.docs) <= SHORT * n_docs]
    every = [x for x in lists if len(x.docs) > SHORT * n_docs]
    threshold = 1
    if short:
        sums = accumulated(short, windows)
        every.append(sums)
        if len(sums.gains) >= k:
            threshold = max(threshold, int(np.partition(sums.gains, -k)[-k]))
    every.sort(key=lambda x: x.peak)
    reach = np.cumsum([x.peak for x in every])
    bounds = np.sum([x.peaks for x in every], axis=0)
    found, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    open_ = np.flatnonzero(bounds >= threshold)
    for at in range(0, len(open_), STRIDE):
        here = open_[at : at + STRIDE]
        here = here[bounds[here] >= threshold]
        essential = np.searchsorted(reach, threshold)  # the lists before it cannot reach the threshold together
        docs = np.unique(np.concatenate([x.docs[ranges(x.starts[here], x.starts[here + 1] - x.starts[here])] for x in every[essential:]] or [found]))
        sums, left = np.zeros(len(docs), dtype=np.int64), int(reach[-1])
        for x in reversed(every):
            if not len(docs):
                break
            place = within(x.docs, docs)
            sums += np.where(place >= 0, x.gains[place], 0)
            left -= x.peak
            likely = sums + left >= threshold
            docs, sums = docs[likely], sums[likely]
        found, scores = best(np.concatenate([found, docs]), np.concatenate([scores, sums]), k)
        if len(found) == k:
            threshold = max(threshold, int(scores[-1]))
    return found, scores


def _evaluate(k: int, documents: int, all_terms: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at = {term: i for i, term in enumerate(left.column("term").to_pylist())}

        def column(name: str, term: int | None, kind) -> np.ndarray:
            return np.frombuffer(left.column(name)[at[term]].as_py(), dtype=kind)

        out, lists = [], {}
        if None in at:
            ids, known, lengths = column("ids", None, np.int64), column("known", None, bool), column("lengths", None, np.int64)
            slow = 8 * (10 + 90 * lengths * documents // all_terms)
            windows = -(-len(ids) // WINDOW)
        for query in (q for row in right.column("queries").to_pylist() for q in row):
            own = []
            for term, weight in zip(query["terms"], query["weights"], strict=True):
                if weight and term in at:
                    if term not in lists:
                        docs, counts = column("docs", term, np.int32).astype(np.int64), column("counts", term, np.int32).astype(np.int64)
                        lists[term] = _List(docs, weight * (1_000_000_000 * counts // (1000 * counts + slow[docs])), windows)
                    own.append(lists[term])
            if own:
                docs, scores = top_documents(own, len(ids), k)
                out += [(query["item_id"], query["query"], int(ids[d]) if known[d] else None, int(s)) for d, s in zip(docs, scores, strict=True)]
        return pa.table({name: pa.array([x[i] for x in out], pa.int64()) for i, name in enumerate(("item_id", "query", "doc_id", "score"))})

    return run


def search(index: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Per query its k best documents: item_id, rank, doc_id, score."""
    asked = query_terms(items, id_col, text_col)
    heads, lists = index.filter("term is null"), index.filter("term is not null")
    sizes = heads.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.coalesce(F.sum("total"), F.lit(0)).alias("all_terms")).first()
    wanted = stored(asked.select("block", F.explode("terms").alias("term")).distinct(), "asked-terms")
    found = lists.select("term", "n").join(wanted.select("term").distinct(), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(sizes["documents"]) + 2) / (2 * F.col("df") + 1)))
    weights = stored(found.select("term", weight.cast("bigint").alias("weight")), "term-weights")
    priced = asked.select("item_id", "query", "block", F.explode("terms").alias("term")).join(weights, "term")
    queries = priced.groupBy("block", "item_id", "query").agg(F.collect_list(F.struct("term", "weight")).alias("priced"))
    query = F.struct("item_id", "query", F.col("priced.term").alias("terms"), F.col("priced.weight").alias("weights"))
    blocks = stored(queries.groupBy("block").agg(F.collect_list(query).alias("queries")), "query-blocks")
    last = blocks.agg(F.max("block")).first()[0] or 0
    # every segment meets every block of queries; salts keep a block's segments apart
    pairs = heads.select("segment", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint"))).alias("block"), F.pmod(F.xxhash64("segment"), F.lit(SALTS)).alias("_salt"))
    salted = blocks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("_salt", F.col("_salt").cast("bigint"))
    right = pairs.join(salted, ["block", "_salt"]).select(F.col("segment").alias("at"), F.col("block").alias("of"), "queries")
    described = heads.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint")))).drop("total")
    left = lists.join(wanted, "term").select(*described.columns).unionByName(described)
    sums = (sizes["documents"], sizes["all_terms"])
    ranked = left.groupBy("segment", "block").cogroup(right.groupBy("at", "of")).applyInArrow(_evaluate(k, *sums), RANKED)
    best_first = Window.partitionBy("item_id", "query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return ranked.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
