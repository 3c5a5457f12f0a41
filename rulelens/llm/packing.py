"""Minimum bin slack: fill fixed windows with document pieces as closely as the lengths allow.

Documents are cut into pieces of at most ``window`` tokens. Only the number of pieces of each length, at most
``window`` numbers, goes to the driver. There the largest remaining length opens a window, and a subset-sum
over bits (bit ``t``: some choice of the remaining pieces has ``t`` tokens) finds the multiset that fills
the rest best; walking back through the bit sets gives how often each length is used. A choice is used as
many times as the counts allow at once, which uses up at least one length, so the plan's size
depends on the window only. Pieces find their place by their number among the pieces of
their length; those numbers come from hashed buckets, so a length that a third of all pieces have is
not numbered in one task.

A window is padded to its full size unless its length is a power of two; where no choice fills a
window, one that reaches a power of two exactly is preferred.

Defined results: a null text is an empty one (its end id only). Rows with equal or null ids are separate documents. An
empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulelens.llm.common import only, portions
from rulelens.llm.encoding import encoder
from rulelens.session import stored

WINDOW = 4096
NUMBERED_TOGETHER = 50_000
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
PLACED = f"{PIECES}, sequence_id bigint, offset bigint"


def pieces(docs: DataFrame, tokenizer: str, end: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's ids and the end id, cut at multiples of ``window``."""

    def run(batches):
        encode = encoder(tokenizer)
        for batch in (part for whole in batches for part in portions(whole, 1)):
            ids, bounds = encode.encode(batch.column(1), end)
            data = ids.astype("<u4")
            totals = np.diff(bounds)
            n = -(-totals // window)
            doc = np.repeat(np.arange(len(totals)), n)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * window
            length = np.minimum(window, totals[doc] - start)
            first = bounds[doc] + start
            crc = np.fromiter((zlib.crc32(data[a : a + b]) for a, b in zip(first, length, strict=True)), dtype=np.int64, count=len(doc))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), *map(pa.array, (start.astype(np.int64), length.astype(np.int64), crc, totals[doc].astype(np.int64)))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    source = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return source.mapInArrow(run, PIECES)


def best_fill(counts: dict[int, int], room: int, goals: list[int]) -> dict[int, int]:
    """How often to use each length so that the sum is ``goals[0]``, else another goal, else as near
    to ``room`` as possible."""
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    wanted = 1 << goals[0]
    for length in sorted((k for k in counts if k <= room), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left > 0 and not reach & wanted:
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= (reach << (length * times)) & full
            left, times = left - times, times * 2
        if reach & wanted:
            break
    at = next((g for g in goals if reach >> g & 1), reach.bit_length() - 1)
    used: dict[int, int] = {}
    for length, times, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + times
            at -= length * times
    return used


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Choices (times each length is used) and how many windows each of them fills."""
    left, out = {k: v for k, v in histogram.items() if v}, []
    while left:
        largest = max(left)
        left[largest] -= 1
        room = window - largest
        powers = [p - largest for p in (1 << i for i in range(window.bit_length() - 1, -1, -1)) if largest <= p < window]
        choice = best_fill({k: v for k, v in left.items() if v}, room, [room, *powers]) if room else {}
        left[largest] += 1
        choice[largest] = choice.get(largest, 0) + 1
        times = min(left[k] // n for k, n in choice.items())
        for k, n in choice.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((dict(sorted(choice.items(), reverse=True)), times))
    return out


def _allotments(choices: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Per length, which of its numbered pieces go to which windows, sorted by (length, first number)."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for choice, times in choices:
        offset = 0
        for length, used in choice.items():
            first = taken.get(length, 0)
            rows.append((length, first, used, sequence, offset))
            taken[length] = first + used * times
            offset += length * used
        sequence += times
    rows.sort()
    names = ("length", "first", "used", "sequence", "offset")
    return {n: np.array([r[i] for r in rows], dtype=np.int64) for i, n in enumerate(names)}


def pack(cut: DataFrame, window: int = WINDOW, numbered_together: int = NUMBERED_TOGETHER) -> DataFrame:
    """Place pieces (a stored table): adds sequence_id and offset."""
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    allotted = _allotments(plan(histogram, window))
    spread = max(1, math.ceil(max(histogram.values(), default=0) / numbered_together))
    marked = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(spread)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        marked.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
        .select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    own = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32")
    numbered = marked.withColumn("_own", F.row_number().over(own) - 1).join(offsets, ["length", "_bucket"])
    numbered = numbered.select(*(f.split(" ")[0] for f in PIECES.split(", ")), (F.col("_own") + F.col("_before")).alias("_number"))

    def place(batches):
        scale = max(histogram.values(), default=0) + 1
        order = allotted["length"] * scale + allotted["first"]
        for batch in batches:
            length, number = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(order, length * scale + number, side="right") - 1
            rank, used = number - allotted["first"][at], allotted["used"][at]
            sequence = allotted["sequence"][at] + rank // used
            offset = allotted["offset"][at] + rank % used * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[f.split(" ")[0] for f in PLACED.split(", ")])

    return numbered.mapInArrow(place, PLACED)


def packed(docs: DataFrame, tokenizer: str, end: int, window: int = WINDOW, **columns: str) -> DataFrame:
    """Cut and place all texts."""
    return pack(stored(pieces(docs, tokenizer, end, window, **columns), "pieces"), window)
