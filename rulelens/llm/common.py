"""Words, hashes and packed arrays shared by the operators of this subpackage.

A word is a run of bytes other than space and ``\\x09``-``\\x0D``. Words and word sequences are
identified by 64-bit hashes inside the operators that count or compare them.
"""

from __future__ import annotations

import contextlib
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multipliers of the splitmix64 finaliser; any odd constants would do.
_M1, _M2, _GAP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)

WORD_BREAK = r"[\x20\x09-\x0D]+"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def chain(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hash of a sequence from the hash of all but its last element and of its last element."""
    return mix(before * _GAP + mix(last + _GAP))


def as_text(column: pa.Array) -> pa.Array:
    """Texts as an Arrow array without nulls.

    Slices are copied: string functions of Arrow misread arrays whose characters do not begin with the buffer.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.offset:
        column = column.take(pa.array(np.arange(len(column))))
    return pc.fill_null(column.cast(pa.large_string()), "")


class Words:
    """The words of a batch of texts: ``hashes[codes[i]]`` is the hash of word ``i``; the words of
    text ``t`` lie at ``starts[t]`` to ``starts[t + 1]``."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        texts = as_text(texts)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
        encoded = lists.flatten().dictionary_encode()
        codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        bounds = np.zeros(len(lists) + 1, dtype=np.int64)
        np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), out=bounds[1:])
        words = encoded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if "" in words:
            keep = codes != words.index("")
            seen = np.zeros(len(codes) + 1, dtype=np.int64)
            np.cumsum(keep, out=seen[1:])
            codes, bounds = codes[keep], seen[bounds]
        self.words, self.codes, self.starts = words, codes, bounds

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.words), dtype=np.uint64, count=len(self.words))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)


def pack(values: np.ndarray) -> bytes:
    """An integer array as compressed bytes, the bytes of equal weight side by side."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return pa.compress(np.ascontiguousarray(planes), codec="zstd", asbytes=True)


def unpack(data: bytes, dtype, length: int) -> np.ndarray:
    item = np.dtype(dtype).itemsize
    if length == 0:
        return np.zeros(0, dtype=dtype)
    raw = pa.decompress(data, decompressed_size=length * item, codec="zstd", asbytes=True)
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(item, length)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a 64-bit key; never decreases with the key, so sorted keys stay in order."""
    return ((keys >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)


def within(outer: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """For sorted ``outer``, where each of ``inner`` is found; -1 if it is not."""
    if not len(outer):
        return np.full(len(inner), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(outer, inner), len(outer) - 1)
    return np.where(outer[at] == inner, at, -1)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices ``starts[i] ... starts[i] + lengths[i] - 1`` of all ``i``, one after the other."""
    lengths = np.asarray(lengths, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(np.asarray(starts) - (ends - lengths), lengths)


def portions(batch: pa.RecordBatch, column: int, limit: int = 8 << 20):
    """Slices of a batch whose texts have about ``limit`` bytes at most, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    edge = (np.cumsum(sizes) - sizes) // limit
    cuts = np.flatnonzero(np.diff(edge)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


@contextlib.contextmanager
def bloom_filters(spark: SparkSession):
    """Jobs started inside may filter the large side of a shuffled join by a Bloom filter of the other side's keys, whatever their sizes.

    Spark does that by itself from 10 GB on, for up to 10 MB of keys. The filter has a fixed largest size (8 MB) and only spares rows the shuffle.
    """
    prefix = "spark.sql.optimizer.runtime.bloomFilter."
    wanted = {"applicationSideScanSizeThreshold": "0", "creationSideThreshold": "1g"}
    before = {name: spark.conf.get(prefix + name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(prefix + name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(prefix + name, value)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's own names and nothing else, so that further columns of
    the input, whatever they are called, cannot clash."""
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
