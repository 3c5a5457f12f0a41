"""Token ids as Arrow stream files of equal-length sequences.

Layout of a shard: an Arrow IPC *stream* whose record batches hold ``rows`` sequences each, ``ids:
fixed_size_list<uint16 or uint32>[length]`` and ``mask: fixed_size_list<bool>[length]`` (false: padding). All full batches have the
same number of bytes, so sequence ``i`` lies in the batch at ``header + (i // rows) * batch_bytes``: one read of
a mapped file gives it without copying (:class:`Shard`). Beside each shard lies an index stream with the
documents' ids, first positions and lengths. Documents follow each other in ascending id order, across
shards as well; only a shard's last sequence is padded.

How it runs: texts are dealt to shards by ranges of the id, and each task encodes its texts in order and
writes its own shard under a name of its own. The rows that a task returns, and that Spark commits,
name the files that count, so files of failed or repeated attempts are never read.

Defined results: a null text is an empty one (its end id only). Rows with equal or null ids are kept, nulls first, ties in
the order of their texts' hashes. An empty table gives no shard and an empty result. Only the named columns are read.
"""

from __future__ import annotations

import itertools
import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulelens.llm.common import only, portions
from rulelens.llm.encoding import encoder
from rulelens.session import run_dir, stored

SEQUENCE = 1024
ROWS = 256
TOKENS_PER_SHARD, BYTES_PER_TOKEN = 1 << 22, 4
MANIFEST = "shard int, file string, index string, documents bigint, tokens bigint, sequences bigint, header bigint, batch_bytes bigint"
READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def id_type(vocabulary: int, end: int) -> str:
    return "<u2" if max(vocabulary, end + 1) <= 1 << 16 else "<u4"


def filesystem(folder: str):
    """(file system, path) of a folder in any store pyarrow reads; plain paths are local or mounted."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else f"file:///{folder.removeprefix('file:').lstrip('/')}")


class Writer:
    """One shard and its index, filled document by document."""

    def __init__(self, folder: str, kind: str, length: int, rows: int):
        self.fs, base = filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        name = uuid.uuid4().hex
        self.file, self.index = f"{name}.arrows", f"{name}.index.arrows"
        self.kind, self.length, self.rows = np.dtype(kind), length, rows
        item = pa.from_numpy_dtype(self.kind)
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.fs.open_output_stream(f"{base}/{self.file}")
        self.stream = pa.ipc.new_stream(self.sink, self.schema)
        self.header, self.batch_bytes, self.sequences, self.tokens = self.schema.serialize().size, 0, 0, 0
        self.base, self.waiting, self.n_waiting, self.documents = base, [], 0, []

    def add(self, doc_id, ids: np.ndarray):
        self.documents.append((doc_id, self.tokens, len(ids)))
        self.tokens += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.length * self.rows:
            self._flush(False)

    def _flush(self, last: bool):
        ids = np.concatenate([*self.waiting, np.zeros(0, self.kind)]).astype(self.kind, copy=False)
        unit = self.length * self.rows
        done = len(ids) if last else len(ids) // unit * unit
        for i in range(0, done, unit):
            own = ids[i : min(i + unit, done)]
            mask = np.ones(-(-len(own) // self.length) * self.length, dtype=bool)
            mask[len(own) :] = False
            padded = np.concatenate([own, np.zeros(len(mask) - len(own), self.kind)])
            batch = pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, mask)], schema=self.schema)
            before = max(self.sink.tell(), self.header)
            self.stream.write_batch(batch)
            self.batch_bytes = max(self.batch_bytes, self.sink.tell() - before)
            self.sequences += len(batch)
        self.waiting, self.n_waiting = [ids[done:]], len(ids) - done

    def close(self) -> dict:
        self._flush(True)
        self.stream.close()
        self.sink.close()
        ids, starts, lengths = zip(*self.documents, strict=True)
        table = pa.table({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(lengths, pa.int64())})
        with self.fs.open_output_stream(f"{self.base}/{self.index}") as sink, pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        return {"file": self.file, "index": self.index, "documents": len(ids), "tokens": self.tokens, "sequences": self.sequences, "header": self.header, "batch_bytes": self.batch_bytes}


class Shard:
    """Random access to a shard's sequences; a local file is mapped, so nothing is copied."""

    def __init__(self, folder: str, file: str, header: int, batch_bytes: int, rows: int = ROWS):
        system, base = filesystem(folder)
        path = f"{base}/{file}"
        self.source = pa.memory_map(path) if system.type_name == "local" else system.open_input_file(path)
        self.schema = pa.ipc.open_stream(self.source).schema
        self.header, self.batch_bytes, self.rows = header, batch_bytes, rows

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of sequence ``i``."""
        self.source.seek(self.header + i // self.rows * self.batch_bytes)
        batch = pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)
        ids, mask = (batch.column(c)[i % self.rows].values for c in (0, 1))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)


def write(
    docs: DataFrame, folder: str, tokenizer: str, end: int, length: int = SEQUENCE, rows: int = ROWS,
    tokens_per_shard: int = TOKENS_PER_SHARD, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Write all texts, each followed by ``end``, as shards below ``folder``; returns the manifest, one row a shard.

    Range partitioning reads the texts twice; they are encoded once, in order, by the task that writes them.
    """
    source = only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(size / (tokens_per_shard * BYTES_PER_TOKEN)))
    dealt = source.repartitionByRange(shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(batches):
        from pyspark import TaskContext

        encode, writer = encoder(tokenizer), None
        kind = id_type(encode.tokenizer.get_vocab_size(with_added_tokens=True), end)
        for batch in (part for whole in batches for part in portions(whole, 1)):
            ids, bounds = encode.encode(batch.column(1), end)
            ids = ids.astype(kind)
            writer = writer or Writer(folder, kind, length, rows)
            for doc_id, (a, b) in zip(batch.column(0).to_pylist(), itertools.pairwise(bounds), strict=True):
                writer.add(doc_id, ids[a:b])
        if writer:
            row = {"shard": TaskContext.get().partitionId()} | writer.close()
            yield pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()}).cast(_manifest_schema())

    return stored(dealt.mapInArrow(run, MANIFEST), "shards")


def _manifest_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "string": pa.string(), "bigint": pa.int64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in MANIFEST.split(", "))])


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The running total over shards is one window over the manifest, which has one short row per shard.
    """
    based = manifest.withColumn("base", F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))

    def run(batches):
        system, root = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_stream(f"{root}/{row['index']}") as source:
                    index = pa.ipc.open_stream(source).read_all()
                starts, lengths = (index[c].to_numpy() for c in ("start", "n_tokens"))
                crcs = np.zeros(len(starts), dtype=np.int64)
                at, doc = 0, 0
                with system.open_input_stream(f"{root}/{row['file']}") as source:
                    for part in pa.ipc.open_stream(source):
                        ids, mask = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in (0, 1))
                        ids = ids[mask].astype("<u4")
                        while doc < len(starts) and starts[doc] < at + len(ids):
                            own = ids[max(0, starts[doc] - at) : starts[doc] + lengths[doc] - at]
                            crcs[doc] = zlib.crc32(own.tobytes(), int(crcs[doc]))
                            if starts[doc] + lengths[doc] > at + len(ids):
                                break
                            doc += 1
                        at += len(ids)
                yield pa.RecordBatch.from_arrays([index["doc_id"].combine_chunks(), pa.array(starts + row["base"]), pa.array(lengths), pa.array(crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = manifest.sparkSession.sparkContext.defaultParallelism
    spread = based.select("shard", "file", "index", "base").repartition(max(shards, 1), "shard")
    return spread.mapInArrow(run, READ)


def round_trip(docs: DataFrame, tokenizer: str, end: int, **columns: str) -> DataFrame:
    """Encode, write and read back all texts."""
    folder = f"{run_dir(docs.sparkSession)}/token-stream-{uuid.uuid4().hex}"
    return read(write(docs, folder, tokenizer, end, **columns), folder)
