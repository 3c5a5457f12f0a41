"""Deleted interpolation: n-gram estimates mixed by context frequency.

``p(w | h) = l[b][n] f_n + ... + l[b][1] f_1 + l[b][0] / (V + 1)``: the maximum-likelihood estimates of all
orders, mixed with weights that depend on the bucket ``b``: the longest context that was seen at all, and its
frequency. Estimates from longer contexts do not exist and have weight 0, so that the mixture sums to 1 over the V words
and one more for all others. The weights
are learned by expectation-maximisation on the development part of the training documents, with the
estimates that remain when that part is deleted from the counts; scores use the counts of all training documents.

How it runs: documents are cut into blocks of bounded size. A block asks for the counts of its distinct
n-grams, in rows of packed sorted keys per key range. Each range adds up what all blocks report and
answers every block. An n-gram comes once per block, however frequent it is, so no range is hot, and
its rows are bounded by ``KEYS_PER_RANGE``. A block and its answers then meet by block number. Nothing of the
size of the corpus reaches the driver: only the weights and two totals do.

Defined results: a null text is an empty one (one end token). A null id counts as a training document. Repeated
rows are separate documents. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulelens.llm.common import Words, bucket_of, chain, mix, only, pack, partitions, portions, unpack
from rulelens.session import stored

BLOCK_TOKENS = 1_000_000
#: Texts are taken apart in portions of about a block; a longer text is a portion of its own.
BLOCK_BYTES = 6 << 20
KEYS_PER_RANGE = 1_000_000
FOLDS, HELD_OUT, DEVELOPMENT_FOLDS = 5, 1, 20
ITERATIONS, TOLERANCE = 15, 1e-3
BUCKETS = 64
BEGIN, END = (mix(np.array([x], dtype=np.uint64))[0] for x in (0x626567696E, 0x656E64))
WORD_BIT = np.uint64(1)

BLOCKS = "block string, part int, ids array<bigint>, held binary, sizes binary, n_words bigint, n_codes bigint, codes binary, hashes binary, n_keys bigint"
REQUESTS = "block string, part int, bucket int, n bigint, keys binary, counts binary"
ANSWERS = "block string, part int, bucket int, n bigint, totals binary, deleted binary, types bigint, tokens bigint"
RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def fold(doc_id) -> tuple[bool, bool]:
    """(held out, development part of the training documents)."""
    if doc_id is None:
        return False, False
    crc = zlib.crc32(str(doc_id).encode())
    held = crc % FOLDS == HELD_OUT
    return held, not held and crc // FOLDS % DEVELOPMENT_FOLDS == 0


def _blocks(order: int):
    import uuid

    def cut(batches):
        for batch in (part for whole in batches for part in portions(whole, 1, BLOCK_BYTES)):
            ids = batch.column(0).to_pylist()
            words = Words(batch.column(1))
            folds = np.array([fold(i) for i in ids], dtype=bool).reshape(-1, 2)
            for part in (0, 1):
                docs = np.flatnonzero(folds[:, 1] == part)
                sizes = words.counts[docs]
                edge = np.cumsum(sizes + 1) // BLOCK_TOKENS
                for piece in np.unique(edge):
                    yield _block(words, ids, docs[edge == piece], folds, part, order, uuid.uuid4().hex)

    def run(batches):
        for row in cut(batches):
            yield pa.RecordBatch.from_pylist([row], schema=_schema(BLOCKS))

    return run


_TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (f.split(" ") for f in ddl.split(", "))])


def _block(words, ids, docs, folds, part, order, block):
    codes = np.concatenate([words.codes[words.starts[d] : words.starts[d + 1]] for d in docs] or [np.zeros(0, np.int32)])
    used, local = np.unique(codes, return_inverse=True)
    row = {
        "block": block,
        "part": part,
        "ids": [ids[d] for d in docs],
        "held": np.packbits(folds[docs, 0]).tobytes(),
        "sizes": pack(words.counts[docs].astype(np.int32)),
        "n_words": len(codes),
        "n_codes": len(used),
        "codes": pack(local.astype(np.int32)),
        "hashes": words.hashes[used].tobytes(),
    }
    return row | {"n_keys": len(_distinct(row, _keys(row, order)[0]))}


def _keys(row: dict, order: int):
    """Per order the keys at the tokens of the block (words and ends) and the begin key; the
    documents' first tokens; whether the document of a token is held out.

    The n-gram at a token reaches back to the begin of its document at most; where it does not fill its
    order it is the n-gram of the order below, and counted there only.
    """
    sizes = unpack(row["sizes"], np.int32, len(row["ids"])).astype(np.int64)
    hashes = mix(np.frombuffer(row["hashes"], dtype=np.uint64))
    first = np.cumsum(sizes + 1) - (sizes + 1)
    total = int((sizes + 1).sum())
    tokens = np.full(total, END, dtype=np.uint64)
    inside = np.ones(total, dtype=bool)
    inside[first + sizes] = False
    tokens[inside] = hashes[unpack(row["codes"], np.int32, row["n_words"])]
    keys = [tokens | WORD_BIT]
    previous, depth = tokens, np.arange(total) - np.repeat(first, sizes + 1)
    for k in range(2, order + 1):
        # what precedes: the (k-1)-gram one token back, or the begin mark alone
        before = np.empty(total, dtype=np.uint64)
        before[1:] = previous[:-1]
        before[first] = BEGIN
        longer = chain(before, tokens)
        previous = longer if k == 2 else np.where(depth >= k - 2, longer, previous)
        keys.append(previous & ~WORD_BIT)
    return keys, first, sizes


def _words_of(row: dict) -> np.ndarray:
    """The keys of the block's different words, in the order of their codes, and of the end."""
    return np.append(mix(np.frombuffer(row["hashes"], dtype=np.uint64)), END) | WORD_BIT


def _distinct(row: dict, keys: list[np.ndarray]) -> np.ndarray:
    """The block's distinct keys, sorted; words are not looked for in the texts again."""
    return np.unique(np.concatenate([_words_of(row), *keys[1:], _begin_key()]))


def _asked(row: dict, order: int):
    """The block's distinct keys, the place among them of the begin key and, per order, of the key at each
    token; the documents' first tokens and sizes. Longer n-grams are sorted once, so that keys are looked up in their own order."""
    keys, first, sizes = _keys(row, order)
    sorts = [np.argsort(k) for k in keys[1:]]
    runs = [k[by] for k, by in zip(keys[1:], sorts, strict=True)]
    begins = [np.concatenate([[True], r[1:] != r[:-1]]) for r in runs]
    asked = np.unique(np.concatenate([_words_of(row), *(r[b] for r, b in zip(runs, begins, strict=True)), _begin_key()]))
    words = np.searchsorted(asked, _words_of(row))
    places = [np.full(len(keys[0]), words[-1])]
    inside = np.ones(len(keys[0]), dtype=bool)
    inside[first + sizes] = False
    places[0][inside] = words[unpack(row["codes"], np.int32, row["n_words"])]
    for by, run, begin in zip(sorts, runs, begins, strict=True):
        at = np.empty(len(by), dtype=np.int64)
        at[by] = np.searchsorted(asked, run[begin])[np.cumsum(begin) - 1]
        places.append(at)
    return asked, int(np.searchsorted(asked, _begin_key())[0]), places, first, sizes


def _held(row: dict) -> np.ndarray:
    return np.unpackbits(np.frombuffer(row["held"], dtype=np.uint8), count=len(row["ids"])).astype(bool)


def _begin_key() -> np.ndarray:
    return np.array([BEGIN & ~WORD_BIT], dtype=np.uint64)


def _requests(order: int, buckets: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                asked, begin, places, first, sizes = _asked(row, order)
                held = _held(row)
                trained = np.repeat(~held, sizes + 1)
                depth = np.arange(len(trained)) - np.repeat(first, sizes + 1)
                counts = np.zeros(len(asked), dtype=np.int64)
                for k, at in enumerate(places, start=1):
                    counts += np.bincount(at[trained & (depth >= k - 2)], minlength=len(asked))
                counts[begin] += int((~held).sum())
                owner = bucket_of(asked, buckets)
                cuts = np.flatnonzero(np.diff(owner)) + 1
                out = [
                    {"block": row["block"], "part": row["part"], "bucket": int(bucket_of(k[:1], buckets)[0]), "n": len(k), "keys": k.tobytes(), "counts": pack(c.astype(np.int32))}
                    for k, c in zip(np.split(asked, cuts), np.split(counts, cuts), strict=True)
                ]
                yield pa.RecordBatch.from_pylist(out, schema=_schema(REQUESTS))

    return run


def _answer(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    keys = [np.frombuffer(r["keys"], dtype=np.uint64) for r in rows]
    counts = [unpack(r["counts"], np.int32, r["n"]).astype(np.int64) for r in rows]
    known = np.unique(np.concatenate(keys))
    total, development = np.zeros(len(known), dtype=np.int64), np.zeros(len(known), dtype=np.int64)
    places = []
    for row, own, n in zip(rows, keys, counts, strict=True):
        places.append(np.searchsorted(known, own))
        total[places[-1]] += n
        if row["part"]:
            development[places[-1]] += n
    words = (known & WORD_BIT) == WORD_BIT
    out = []
    for i, (row, at) in enumerate(zip(rows, places, strict=True)):
        out.append(
            {
                "block": row["block"],
                "part": row["part"],
                "bucket": row["bucket"],
                "n": row["n"],
                "totals": pack(total[at]),
                "deleted": pack(total[at] - development[at]) if row["part"] else None,
                "types": int(((total > 0) & words).sum()) if i == 0 else 0,
                "tokens": int(total[words].sum()) if i == 0 else 0,
            }
        )
    return pa.Table.from_pylist(out, schema=_schema(ANSWERS))


def _counted(block: pa.Table, answers: pa.Table, order: int, column: str):
    """The block's row, its keys' counts per order and token, and the counts of the contexts."""
    row = block.to_pylist()[0]
    parts = sorted(answers.to_pylist(), key=lambda r: r["bucket"])
    counts = np.concatenate([unpack(r[column], np.int64, r["n"]) for r in parts])
    _, at, places, first, sizes = _asked(row, order)
    begin = int(counts[at])
    grams = [counts[own] for own in places]
    contexts = []
    for k in range(1, order):
        back = np.empty_like(grams[k - 1])
        back[1:] = grams[k - 1][:-1]
        back[first] = begin
        contexts.append(back)
    return row, grams, contexts, first, sizes


def _estimates(grams, contexts, tokens: int, types: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimates per token from the uniform one to the highest order, and the token's bucket.

    Buckets ``m * BUCKETS`` and on belong to tokens whose longest seen context has ``m`` words.
    """
    parts = [np.full(len(grams[0]), 1.0 / (types + 1)), grams[0] / max(tokens, 1)]
    parts += [np.divide(g, c, out=np.zeros(len(g)), where=c > 0) for g, c in zip(grams[1:], contexts, strict=True)]
    bucket = np.zeros(len(grams[0]), dtype=np.int64)
    for m, c in enumerate(contexts, start=1):  # a context that was seen has seen shorter ones
        bucket = np.where(c > 0, m * BUCKETS + np.minimum(np.log2(c + 1.0).astype(np.int64), BUCKETS - 1), bucket)
    return np.stack(parts, axis=1), bucket


def _usable(order: int) -> np.ndarray:
    """Per bucket and part, whether the part's context was seen."""
    return np.arange(order + 1)[None, :] <= np.arange(order * BUCKETS)[:, None] // BUCKETS + 1


def _weights(development: DataFrame, order: int) -> np.ndarray:
    """Expectation-maximisation: every round is one pass over the stored development tokens."""
    usable = _usable(order)
    weights = usable / usable.sum(axis=1, keepdims=True)
    for _ in range(ITERATIONS):
        fixed = weights

        def expect(batches, fixed=fixed):
            for batch in batches:
                for row in batch.to_pylist():
                    f = np.frombuffer(row["estimates"], dtype=np.float32).reshape(-1, order + 1).astype(np.float64)
                    b = np.frombuffer(row["buckets"], dtype=np.uint16)
                    shares = fixed[b] * f
                    shares /= shares.sum(axis=1, keepdims=True)
                    sums = np.stack([np.bincount(b, shares[:, k], len(fixed)) for k in range(order + 1)], axis=1)
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.arange(len(fixed), dtype=np.int32)), "sums": pa.array(sums.tolist(), type=pa.list_(pa.float64()))})

        sums = development.mapInArrow(expect, "bucket int, sums array<double>").select("bucket", *(F.col("sums")[k].alias(f"s{k}") for k in range(order + 1)))
        gathered = np.zeros(weights.shape)
        for r in sums.groupBy("bucket").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(order + 1))).collect():  # BUCKETS rows per order
            gathered[r["bucket"]] = [r[f"s{k}"] for k in range(order + 1)]
        gathered += usable  # a token's worth for every part that can apply, so that no weight becomes nought
        updated = gathered / gathered.sum(axis=1, keepdims=True)
        change, weights = np.abs(updated - weights).max(), updated
        if change < TOLERANCE:
            break
    return weights


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """Score every text by the model learned from the training documents.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-half unigram), score (log10
    probability under the mixture of all orders up to ``order``).
    """
    source = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    blocks = stored(source.mapInArrow(_blocks(order), BLOCKS), "lm-blocks")
    keys = blocks.agg(F.sum("n_keys")).first()[0] or 0
    buckets = max(1, min(1 << 20, math.ceil(keys / KEYS_PER_RANGE)), min(partitions(docs), math.ceil(keys / 50_000)))
    requests = blocks.mapInArrow(_requests(order, buckets), REQUESTS)
    answers = stored(requests.groupBy("bucket").applyInArrow(_answer, ANSWERS), "lm-answers")
    totals = answers.agg(F.sum("types"), F.sum("tokens")).first()
    types, tokens = int(totals[0] or 0), int(totals[1] or 0)

    def estimates(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("buckets", pa.binary()), ("estimates", pa.binary())])
        if not left.num_rows:
            return schema.empty_table()
        row, grams, contexts, first, sizes = _counted(left, right, order, "deleted")
        f, b = _estimates(grams, contexts, tokens, types)
        return pa.Table.from_pylist([{"buckets": b.astype(np.uint16).tobytes(), "estimates": f.astype(np.float32).tobytes()}], schema=schema)

    def gathered(df: DataFrame) -> DataFrame:
        return df.drop("types", "tokens", "n_keys").groupBy("block")

    development = stored(
        gathered(blocks.filter("part = 1")).cogroup(gathered(answers.filter("part = 1"))).applyInArrow(estimates, "buckets binary, estimates binary"),
        "lm-development",
    )
    weights = _weights(development, order)

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = _schema(RESULT)
        if not left.num_rows:
            return schema.empty_table()
        row, grams, contexts, first, sizes = _counted(left, right, order, "totals")
        f, b = _estimates(grams, contexts, tokens, types)
        logs = np.log10((weights[b] * f).sum(axis=1))
        base = np.log10((grams[0] + 0.5) / (tokens + 0.5 * (types + 1)))
        return pa.Table.from_arrays(
            [
                pa.array(row["ids"], type=pa.int64()),
                pa.array(_held(row)),
                pa.array(sizes + 1),
                pa.array(np.add.reduceat((grams[0] > 0).astype(np.int64), first)),
                pa.array(np.full(len(sizes), tokens, dtype=np.int64)),
                pa.array(np.add.reduceat(base, first)),
                pa.array(np.add.reduceat(logs, first)),
            ],
            schema=schema,
        )

    return gathered(blocks).cogroup(gathered(answers.drop("deleted"))).applyInArrow(scored, RESULT)
