"""Latent semantic retrieval of benchmark passages, also paraphrased ones, in documents.

Words are hashed to ``DIMS`` dimensions and weighted by inverse document frequency over all documents. A randomised SVD
of the passages of all documents together with the benchmark's gives ``RANK`` directions, or as many as a block of the benchmark has
passages. Each benchmark passage weighs as much as all documents' passages together, so their own directions come first and a copy keeps its
cosine however large the corpus is. Every passage (``WINDOW`` words, every
``STRIDE`` words) of every document is projected on them and compared with every benchmark passage; pairs of
sufficient cosine are candidates. A candidate counts if the longest common subsequence of its words covers
``SURE`` of the benchmark passage, or ``LIKELY`` of it and ``ANSWER`` of its answer (the last sentence).

How it runs: texts are taken apart once and stored as the dimensions of their words. Document frequencies are partial sums per
task over ``DIMS`` numbers. The SVD is that of a sketch: every passage of every document is added, with a sign, to one of ``ROWS``
rows, both drawn by hash, and the benchmark's passages are rows of their own. A task's sketch has a fixed size; the
sketches are added up in blocks of dimensions and stored, so what reaches the driver and is sent to the tasks has a fixed size; the driver
reads a few blocks at a time and keeps nothing of them, or of what it sent, while or after the search runs. The search reads
each text once and shuffles nothing. The benchmark is the stated query set; it is searched in blocks of
at most ``QUERIES`` passages, whatever its size, so the directions hold all passages of a block.

Defined results: null or empty texts on either side match nothing; repeated rows each match. Null ids are kept. An empty table gives
an empty result. Only the named columns are read; :func:`clean` returns all columns of its input.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulelens.llm.common import Words, fresh, mix, only, pack, portions, ranges, unpack, within
from rulelens.session import stored

DIMS, RANK, ROWS = 1 << 15, 128, 256
WINDOW, STRIDE, QUERIES = 64, 32, 256
COSINE, SURE, LIKELY, ANSWER = 0.22, 0.8, 0.6, 0.8
DIM_BLOCK = 64
#: Jobs that bring the sketch (32 MB) to the driver, one after the other.
READS = 8
PORTION_BYTES = 2 << 20
_MARKS = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~¡¿«»“”„‘’…–—"
PACKED = "n_texts bigint, n_words bigint, seeds binary, sizes binary, dims binary"
HITS = "doc_id bigint, place bigint, item_id bigint, cosine double, lcs int, item_words int, lcs_ratio double, answer_ratio double"


class Terms(Words):
    """Words in lower case without surrounding punctuation; what is left empty is no word."""

    def __init__(self, texts: pa.Array):
        super().__init__(texts, lower=False)
        bare = pc.utf8_lower(pc.utf8_trim(pa.array(self.words, pa.large_string()), characters=_MARKS))
        keep = pc.greater(pc.binary_length(bare), 0).to_numpy(zero_copy_only=False)
        if len(keep) and not keep.all():
            kept = keep[self.codes]
            seen = np.concatenate([[0], np.cumsum(kept)])
            self.codes, self.starts = self.codes[kept], seen[self.starts]
        self.words = bare.to_numpy(zero_copy_only=False).tolist()

    @functools.cached_property
    def dims(self) -> np.ndarray:
        return (mix(self.hashes) >> np.uint64(64 - (DIMS.bit_length() - 1))).astype(np.int32)

    @property
    def word_dims(self) -> np.ndarray:
        return self.dims[self.codes]


class PackedTerms:
    """The dimensions of the words of some texts, and a number to draw each text's signs from."""

    def __init__(self, row: dict):
        self.counts = unpack(row["sizes"], np.int32, row["n_texts"]).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.word_dims = unpack(row["dims"], np.uint16, row["n_words"])
        self.seeds = np.frombuffer(row["seeds"], dtype=np.uint64)


def _packed(batches):
    """PACKED: texts (doc_id, place, text) as the dimensions of their words, a row for a portion of texts."""
    schema = pa.schema([("n_texts", pa.int64()), ("n_words", pa.int64()), *((c, pa.binary()) for c in ("seeds", "sizes", "dims"))])
    for batch in (part for whole in batches for part in portions(whole, 2, PORTION_BYTES)):
        terms = Terms(batch.column(2))
        ids, places = (pc.fill_null(batch.column(c), 0).to_numpy(zero_copy_only=False).view(np.uint64) for c in (0, 1))
        row = {"n_texts": batch.num_rows, "n_words": len(terms.codes), "seeds": mix(mix(ids) + places).tobytes(), "sizes": pack(terms.counts.astype(np.int32)), "dims": pack(terms.word_dims.astype(np.uint16))}
        yield pa.RecordBatch.from_pylist([row], schema=schema)


def _frequencies(batches):
    """(dim, number of documents with it), the number of documents under dim -1 and that of passages under -2; one partial sum a task."""
    total, docs, passages = np.zeros(DIMS, dtype=np.int64), 0, 0
    for batch in batches:
        for row in batch.to_pylist():
            terms = PackedTerms(row)
            owner = np.repeat(np.arange(len(terms.counts), dtype=np.int64), terms.counts)
            total += np.bincount(np.unique(owner * DIMS + terms.word_dims) % DIMS, minlength=DIMS)
            docs += len(terms.counts)
            passages += int(_windows(_segments(terms)[0]).sum())
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(found, [-1, -2]).astype(np.int32)), pa.array(np.append(total[found], [docs, passages]))], names=["dim", "n"])


def _segments(terms: Terms | PackedTerms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of ``STRIDE`` words: their text, first word and end."""
    n = -(-terms.counts // STRIDE)
    text = np.repeat(np.arange(len(n)), n)
    start = terms.starts[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    return text, start, np.minimum(start + STRIDE, terms.starts[text + 1])


def _windows(text: np.ndarray) -> np.ndarray:
    """For each segment whether it opens a window with the next one: all but a text's last, unless it is the only one."""
    follows = np.zeros(len(text), dtype=bool)
    follows[:-1] = text[1:] == text[:-1]
    alone = ~follows
    alone[1:] &= text[1:] != text[:-1]
    return follows | alone


def _sums(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, start, axis=0) if len(start) else values[:0]


def _passages(terms: Terms | PackedTerms, idf: np.ndarray):
    """Every window's words as (dims, weights scaled to unit norm, bounds), and the text of each window."""
    text, start, end = _segments(terms)
    opens = _windows(text)
    last = np.append(end[1:], 0)
    stop = np.where(np.append(text[1:] == text[:-1], False), last, end)[opens] if len(text) else end
    begin = start[opens]
    lengths = stop - begin
    dims = terms.word_dims[ranges(begin, lengths)]
    weights = idf[dims]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    norms = np.sqrt(np.maximum(_sums(weights.astype(np.float64) ** 2, bounds[:-1]), 1e-12))
    return dims, (weights / np.repeat(norms, lengths)).astype(np.float32), bounds, text[opens]


def _sketched(idf: np.ndarray):
    """Partial sums of the sketch, in blocks of dimensions: a passage's row and sign follow from its text's seed and its place there."""

    def run(batches):
        total = np.zeros(DIMS * ROWS, dtype=np.float32)
        for batch in batches:
            for row in batch.to_pylist():
                terms = PackedTerms(row)
                dims, weights, bounds, text = _passages(terms, idf)
                nth = np.arange(len(text)) - np.searchsorted(text, text)
                drawn = mix(terms.seeds[text] + mix(nth.astype(np.uint64) + np.uint64(1)))
                place = (drawn >> np.uint64(1)) % np.uint64(ROWS)
                sign = np.where(drawn & np.uint64(1), np.float32(1), np.float32(-1))
                lengths = np.diff(bounds)
                np.add.at(total, dims.astype(np.int64) * ROWS + np.repeat(place.astype(np.int64), lengths), weights * np.repeat(sign, lengths))
        blocks = total.reshape(DIMS // DIM_BLOCK, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array([b.tobytes() for b in blocks], pa.binary())], names=["block", "sums"])

    return run


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, dtype=np.float32).astype(np.float64) for b in table.column("sums").to_pylist())
    return pa.table({"block": table.column("block")[:1], "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def sketch_sums(words: DataFrame, idf: np.ndarray) -> DataFrame:
    """Stored (block, sums): the passages of all texts of stored ``words`` (PACKED), each added with its sign to its row; a fixed size."""
    parts = words.mapInArrow(_sketched(idf), "block int, sums binary")
    return stored(parts.groupBy("block").applyInArrow(_add, "block int, sums binary"), "sketch")


def _gather(sums: DataFrame, rows: np.ndarray) -> np.ndarray:
    """The sketch, written into the first rows of ``rows``; some blocks at a time reach the driver."""
    for r in sums.coalesce(READS).toLocalIterator():
        rows[:ROWS, r["block"] * DIM_BLOCK : (r["block"] + 1) * DIM_BLOCK] = np.frombuffer(r["sums"], dtype=np.float32).reshape(DIM_BLOCK, ROWS).T
    return rows


def sketch(words: DataFrame, idf: np.ndarray) -> np.ndarray:
    """DIMS x ROWS: the sketch of stored ``words`` (PACKED)."""
    return _gather(sketch_sums(words, idf), np.zeros((ROWS, DIMS), dtype=np.float32)).T


def directions(sums: DataFrame, texts: list[str], weight: float, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Leading right singular vectors of the sketched passages and the benchmark passages ``texts``, each of which weighs ``weight``.

    The rows of both are held once, and only while no job runs but the one that reads the sketch."""
    rows = _gather(sums, np.zeros((ROWS + len(texts), DIMS), dtype=np.float32))
    dims, weights, bounds, owner = _passages(Terms(pa.array(texts, pa.string())), idf)
    np.add.at(rows, (ROWS + np.repeat(owner, np.diff(bounds)), dims), weights * np.float32(np.sqrt(weight)))
    values, left = np.linalg.eigh((rows @ rows.T).astype(np.float64))
    top = np.argsort(-values)[:rank]
    top = top[values[top] > 1e-6 * values[top[0]]]
    return rows.T @ (left[:, top] / np.sqrt(values[top])).astype(np.float32)


def lcs(one: np.ndarray, two: np.ndarray) -> int:
    """Length of the longest common subsequence, with a bit for each element of ``one``."""
    masks: dict[int, int] = {}
    for i, x in enumerate(one.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(one)) - 1
    rest = full
    for x in two.tolist():
        hit = rest & masks.get(x, 0)
        if hit:
            rest = (rest + hit | rest - hit) & full
    return len(one) - rest.bit_count()


def passages(items: list) -> list[dict]:
    """The benchmark's windows as items of their own (item_id, text, answer); the answer stands in an item's last window."""
    terms = Terms(pa.array([r["text"] or "" for r in items], pa.string()))
    out = []
    for t, row in enumerate(items):
        words = [terms.words[c] for c in terms.codes[terms.starts[t] : terms.starts[t + 1]]]
        firsts = range(0, max(1, len(words) - WINDOW + STRIDE), STRIDE)
        for first in firsts if words else []:
            out.append({"item_id": row["item_id"], "text": " ".join(words[first : first + WINDOW]), "answer": _answer(row["text"]) if first == firsts[-1] else ""})
    return out


class Queries:
    """Benchmark passages: words and answers, as places in their common vocabulary, and projections of unit length."""

    def __init__(self, items: list, idf: np.ndarray, basis: np.ndarray):
        self.ids, self.words, self.answers = [], [], []
        terms = Terms(pa.array([r["text"] or "" for r in items], pa.string()))
        ends = Terms(pa.array([r["answer"] if "answer" in r else _answer(r["text"] or "") for r in items], pa.string()))
        projected = []
        for t, row in enumerate(items):
            codes = terms.codes[terms.starts[t] : terms.starts[t + 1]]
            answer = ends.hashes[ends.codes[ends.starts[t] : ends.starts[t + 1]]]
            firsts = range(0, max(1, len(codes) - WINDOW + STRIDE), STRIDE)
            for first in firsts if len(codes) else []:
                own = codes[first : first + WINDOW]
                z = (idf[terms.dims[own]][:, None] * basis[terms.dims[own]]).sum(axis=0)
                self.ids.append(row["item_id"])
                self.words.append(terms.hashes[own])
                self.answers.append(answer if first == firsts[-1] else answer[:0])
                projected.append(z / max(np.linalg.norm(z), 1e-9))
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.words, *self.answers]))
        self.words, self.answers = ([within(self.vocabulary, own) for own in part] for part in (self.words, self.answers))
        self.matrix = np.array(projected, dtype=np.float32).reshape(len(self.ids), basis.shape[1])


def _answer(text: str) -> str:
    sentences = [s for s in re.split(r"[.!?\n]+", text) if s.strip()]
    return sentences[-1] if sentences else ""


def compare(query: np.ndarray, answer: np.ndarray, near: np.ndarray) -> tuple[int, float]:
    """(common subsequence, share of the answer found) of a benchmark passage in the words around a window."""
    common = lcs(query, near)
    return common, lcs(answer, near) / len(answer) if len(answer) and common >= LIKELY * len(query) else 0.0


def accepted(ratio: float, answer_ratio: float) -> bool:
    return ratio >= SURE or (ratio >= LIKELY and answer_ratio >= ANSWER)


def _search(shared, idf: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.int32()), ("item_words", pa.int32()), ("lcs_ratio", pa.float64()), ("answer_ratio", pa.float64())])

    def run(batches):
        basis, queries = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                rows = _hits(Terms(part.column(2)), idf, basis, queries)
                for r in rows:
                    r |= {"doc_id": part.column(0)[r["text"]].as_py(), "place": part.column(1)[r.pop("text")].as_py()}
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _hits(terms: Terms, idf: np.ndarray, basis: np.ndarray, queries: Queries) -> list[dict]:
    text, start, end = _segments(terms)
    if not len(text) or not queries.ids:
        return []
    dims = terms.dims[terms.codes]
    # words beyond a segment's end count as the row of noughts behind the table
    weighted = np.vstack([idf[:, None] * basis, np.zeros((1, basis.shape[1]), np.float32)])
    places = start[:, None] + np.arange(STRIDE)
    padded = np.where(places < end[:, None], dims[np.minimum(places, len(dims) - 1)], DIMS)
    projected = np.empty((len(text), basis.shape[1]), dtype=np.float32)
    for i in range(0, len(text), 256):
        projected[i : i + 256] = weighted[padded[i : i + 256]].sum(axis=1)
    squares = _sums(idf[dims].astype(np.float64) ** 2, start)
    opens = np.flatnonzero(_windows(text))
    paired = np.append(text[1:] == text[:-1], False)[opens]
    after = np.minimum(opens + 1, len(text) - 1)
    z = projected[opens] + np.where(paired[:, None], projected[after], 0)
    norms = np.sqrt(np.maximum(squares[opens] + np.where(paired, squares[after], 0), 1e-12))
    z /= norms[:, None].astype(np.float32)
    best: dict[tuple[int, int], dict] = {}
    # only words of some benchmark passage can be part of a common subsequence
    known = within(queries.vocabulary, terms.hashes)[terms.codes]
    present = np.zeros(len(queries.vocabulary), dtype=bool)
    for i in range(0, len(z), 8_192):
        scores = z[i : i + 8_192] @ queries.matrix.T
        for w, q in zip(*np.nonzero(scores >= COSINE), strict=True):
            s = opens[i + w]
            t = int(text[s])
            near = known[max(terms.starts[t], start[s] - WINDOW) : min(terms.starts[t + 1], start[s] + 2 * WINDOW)]
            near = near[near >= 0]
            query = queries.words[q]
            present[near] = True
            shared = np.count_nonzero(present[query])
            present[near] = False
            if shared < LIKELY * len(query):
                continue
            common, answer = compare(query, queries.answers[q], near)
            ratio = common / len(query)
            if accepted(ratio, answer):
                row = {"text": t, "item_id": queries.ids[q], "cosine": float(scores[w, q]), "lcs": common, "item_words": len(query), "lcs_ratio": ratio, "answer_ratio": answer}
                key = (t, int(q))
                if key not in best or (row["lcs"], row["cosine"]) > (best[key]["lcs"], best[key]["cosine"]):
                    best[key] = row
    return list(best.values())


def weights_of(words: DataFrame) -> tuple[np.ndarray, int]:
    """Inverse document frequency per dimension over all documents of stored ``words`` (PACKED), and the number of their passages."""
    found = {r["dim"]: r["n"] for r in words.mapInArrow(_frequencies, "dim int, n bigint").groupBy("dim").agg(F.sum("n").alias("n")).collect()}  # DIMS + 2 rows
    total, count = found.pop(-1, 0), found.pop(-2, 0)
    counts = np.zeros(DIMS)
    counts[list(found)] = list(found.values())
    return np.log((total + 2.0) / (counts + 1.0)).astype(np.float32), count


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """HITS: every (document, benchmark item) pair that counts as a leak; place is the hash of the text."""
    source = only(docs, doc_id=id_col, text=text_col).filter("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("place"), "text")
    items = only(benchmark, item_id=item_col, text=item_text_col).withColumn("item_id", F.col("item_id").cast("bigint")).filter("text is not null").orderBy("item_id", "text").collect()  # the query set
    spark = docs.sparkSession
    words = stored(source.mapInArrow(_packed, PACKED), "passage-words")
    idf, count = weights_of(words)
    sums = sketch_sums(words, idf)
    queries = passages(items)
    found = None
    for first in range(0, max(len(queries), 1), QUERIES):
        own = queries[first : first + QUERIES]
        basis = directions(sums, [r["text"] for r in own], float(max(count, 1)), idf, max(RANK, len(own)))
        shared = spark.sparkContext.broadcast((basis, Queries(own, idf, basis)))  # fixed size
        del basis
        hits = stored(source.mapInArrow(_search(shared, idf), HITS), "leaks")
        shared.destroy()  # the hits are written
        found = hits if found is None else found.unionByName(hits)
    best = F.max(F.struct("lcs_ratio", "answer_ratio", "cosine", "lcs", "item_words")).alias("b")
    return found.groupBy("doc_id", "place", "item_id").agg(best).select("doc_id", "place", "item_id", F.round("b.cosine", 4).alias("cosine"), "b.lcs", "b.item_words", "b.lcs_ratio", "b.answer_ratio")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows without leaks, with all their columns."""
    leaks = stored(search(docs, benchmark, id_col=id_col, text_col=text_col).select(F.col("place").alias("_place")).distinct(), "leaking-texts")
    place = fresh(docs, "_place")
    marked = docs.withColumn(place, F.xxhash64(F.col(f"`{text_col}`")))
    return marked.join(leaks.withColumnRenamed("_place", place), place, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
