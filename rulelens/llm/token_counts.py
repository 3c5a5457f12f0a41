"""Token counts; huge documents are encoded in overlapping chunks that are resynchronised.

A huge text is cut into chunks; each also covers the first ``overlap`` characters of the next one. In that
zone both chunks are encoded, with offsets. They are spliced at the first place where both have a token
boundary and no match of the tokenizer's splitting pattern can reach across (see :mod:`encoding`), so that
what follows does not depend on what came before: the spliced counts are those of the whole text. Where a
zone holds no such place, the text's overlap is widened and its chunks are encoded again, up to the
whole text. Tokenizers without a provable cut (``whole``) are never cut.

How it runs: equal huge texts are encoded once; their chunks are dealt to all tasks, so a text of any length is
encoded by many; only boundary positions are returned, and neighbours meet in a join by (text, chunk).

Defined results: a null text is an empty one (no bytes, no tokens). Repeated rows and null ids are kept. An
empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulelens.llm.common import only, partitions, portions
from rulelens.llm.encoding import encoder
from rulelens.session import stored

CHUNK, OVERLAP, WIDEN = 16_384, 256, 4
CHUNKS = "sha string, no bigint, last boolean, start bigint, next bigint, piece string"
BOUNDS = "sha string, no bigint, last boolean, n bigint, left array<struct<p: bigint, i: bigint>>, right array<struct<p: bigint, i: bigint>>"
_ZONE = pa.list_(pa.struct([("p", pa.int64()), ("i", pa.int64())]))


def _cut(chunk: int, overlap: int):
    """Chunks of every text, and the characters of the next one that each covers."""

    def run(batches):
        for batch in batches:
            for sha, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                step = chunk if overlap < len(text) else len(text)
                count = max(1, -(-len(text) // max(step, 1)))
                for first in range(0, count, 64):
                    rows = [
                        {"sha": sha, "no": i, "last": i == count - 1, "start": i * step, "next": (i + 1) * step, "piece": text[i * step : (i + 1) * step + (overlap if i < count - 1 else 0)]}
                        for i in range(first, min(first + 64, count))
                    ]
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("sha", pa.string()), ("no", pa.int64()), ("last", pa.bool_()), ("start", pa.int64()), ("next", pa.int64()), ("piece", pa.string())]))

    return run


def _provable(kind: str, text: str, p: int) -> bool:
    """Whether no token can reach across position ``p`` of the text, whatever surrounds the chunk."""
    if kind == "whole" or p < 1 or p + 1 >= len(text):
        return False
    if kind == "dropped":
        return text[p - 1] in " \t\n\x0b\x0c\r" and not text[p].isspace()
    return text[p] in " \n" and not text[p - 1].isspace() and not text[p + 1].isspace()


def _zone(kind: str, text: str, starts: np.ndarray, low: int, high: int, base: int) -> list[dict]:
    """Provable token boundaries at ``low <= p < high``, as positions of the whole text, with the number
    of tokens before them."""
    found = []
    for i in range(int(np.searchsorted(starts, low)), len(starts)):
        p = int(starts[i])
        if p >= high:
            break
        if kind == "kept" and p and text[p - 1] in " \n" and not text[p].isspace():
            p -= 1  # offsets may leave the leading space out
        if (not found or found[-1]["p"] < p + base) and p >= low and _provable(kind, text, p):
            found.append({"p": p + base, "i": i})
    return found


def _encode(tokenizer: str, overlap: int):
    def run(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                rows = batch.slice(at, 32).to_pylist()
                out = []
                for row, e in zip(rows, encode.tokenizer.encode_batch([r["piece"] for r in rows], add_special_tokens=False), strict=True):
                    text, base = row["piece"], row["start"]
                    starts = np.array([o[0] for o in e.offsets], dtype=np.int64)
                    out.append(
                        {
                            "sha": row["sha"],
                            "no": row["no"],
                            "last": row["last"],
                            "n": len(starts),
                            "left": _zone(encode.kind, text, starts, 0, overlap, base) if row["no"] else [],
                            "right": [] if row["last"] else _zone(encode.kind, text, starts, row["next"] - base, len(text), base),
                        }
                    )
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("sha", pa.string()), ("no", pa.int64()), ("last", pa.bool_()), ("n", pa.int64()), ("left", _ZONE), ("right", _ZONE)]))

    return run


def spliced(texts: DataFrame, tokenizer: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(sha, n_tokens) of huge distinct texts (sha, text)."""
    pending, done = texts, []
    while True:
        dealt = pending.mapInArrow(_cut(chunk, overlap), CHUNKS).repartition(partitions(texts), "sha", "no")
        bounds = stored(dealt.mapInArrow(_encode(tokenizer, overlap), BOUNDS), "token-bounds")
        following = bounds.select("sha", (F.col("no") - 1).alias("no"), F.col("left").alias("heads"))
        joints = (
            bounds.filter("not last").join(following, ["sha", "no"])
            .withColumn("p", F.array_min(F.array_intersect(F.col("right.p"), F.col("heads.p"))))
            .select("sha", "p", F.expr("get(filter(right, x -> x.p = p), 0).i").alias("tail"), F.expr("get(filter(heads, x -> x.p = p), 0).i").alias("head"))
        )
        # all tokens before the joint in one chunk, all after it in the next
        inner = joints.groupBy("sha").agg(F.sum("tail").alias("tails"), F.sum("head").alias("heads"), F.sum(F.col("p").isNull().cast("int")).alias("open"))
        ends = bounds.groupBy("sha").agg(F.sum(F.when(F.col("last"), F.col("n"))).alias("n"))
        sums = stored(ends.join(inner, "sha", "left"), "token-sums")
        done.append(sums.filter("coalesce(open, 0) = 0").selectExpr("sha", "n + coalesce(tails, 0) - coalesce(heads, 0) as n_tokens"))
        unaligned = sums.filter("open > 0").select("sha")
        if unaligned.isEmpty():
            break
        pending, overlap = pending.join(unaligned, "sha", "left_semi"), overlap * WIDEN
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def count(docs: DataFrame, tokenizer: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit."""
    source = only(docs, doc_id=id_col, text=text_col).withColumns({"doc_id": F.col("doc_id").cast("bigint"), "text": F.coalesce("text", F.lit(""))})
    long = F.length("text") > chunk

    def small(batches):
        encode = encoder(tokenizer)
        for batch in (part for whole in batches for part in portions(whole, 2)):
            n = encode.counts(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    measured = source.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "text")
    short = measured.filter(~long).mapInArrow(small, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    hashed = measured.filter(long).withColumn("sha", F.sha2("text", 256))
    huge = stored(hashed.select("sha", "text").dropDuplicates(["sha"]), "huge-texts")
    counted = spliced(huge, tokenizer, chunk, overlap)
    spread = hashed.select("doc_id", "n_bytes", "sha").join(counted, "sha").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(spread).withColumn("over_limit", F.col("n_tokens") > limit)
