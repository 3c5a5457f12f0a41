"""Shards by jump consistent hashing: a key and the number of shards decide, and nothing else.

A row's key is the 64-bit hash of its id. :func:`jump` walks from one shard count to the next at which the key
would move, and stops before the wanted count; no table of the ring is kept, and every machine gets the same
answer. With one more shard a key either stays or goes to the new shard, so that growing from n to n + 1 shards moves
one row in n + 1 (:func:`append_shards` copies only those).

How it runs: rows are dealt to parts of their shard, as many as the measured bytes ask for, and written as Parquet
below ``shard=N``; a row's slot is the rows of its shard's earlier files, from a manifest with one row per file,
plus its place in its own file. No shard is sorted, numbered or held in one task, and rows with one id are
spread over the parts of their shard.

Defined results: null ids are one more key; null texts count as empty for sizes and digests and stay null in the files;
texts of any length are moved as they are and never cut. Rows with equal ids share a shard, repeated rows have a slot each. Within a shard the order is free.
An empty table writes no rows and reads back empty. All columns are kept, whatever they are called.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulelens.llm.common import fresh, partitions
from rulelens.session import run_dir, stored

#: Fixed value: the multiplier of the published jump hash.
MULTIPLIER = np.uint64(2862933555777941757)
PART_BYTES = 64 << 20
ROW_BYTES = 64
LAW = "key"


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to ``shards - 1``, of every 64-bit key."""
    state = np.array(keys).view(np.uint64).copy()
    here, ahead = np.full(len(state), -1, dtype=np.int64), np.zeros(len(state), dtype=np.int64)
    open_ = np.arange(len(state))
    while len(open_):
        here[open_] = ahead[open_]
        state[open_] = state[open_] * MULTIPLIER + np.uint64(1)
        draw = ((state[open_] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[open_] = ((here[open_] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        open_ = open_[ahead[open_] < shards]
    return here


def shard_of(key: Column, shards: int) -> Column:
    """The shard of an id of any type."""
    if shards < 1:
        raise ValueError("shards must be positive")

    @F.arrow_udf("int")
    def place(hashes: pa.Array) -> pa.Array:
        return pa.array(jump(hashes.to_numpy(zero_copy_only=False), shards), type=pa.int32())

    return place(F.xxhash64(key))


def write_shards(docs: DataFrame, folder: str, shards: int, id_col: str = "doc_id", text_col: str = "text", mode: str = "errorifexists") -> str:
    """Write all rows below ``folder``, one sub-folder a shard; returns the name of the folder column."""
    name, part = fresh(docs, "shard"), fresh(docs, "_part")
    placed = docs.withColumn(name, shard_of(F.col(f"`{id_col}`"), shards))
    _write(placed, folder, name, part, shards, id_col, text_col, mode)
    return name


def _write(placed: DataFrame, folder: str, name: str, part: str, shards: int, id_col: str, text_col: str, mode: str) -> None:
    size = F.coalesce(F.octet_length(f"`{text_col}`"), F.lit(0)) + ROW_BYTES
    total = placed.agg(F.sum(size.cast("bigint"))).first()[0] or 0
    parts = max(math.ceil(total / shards / PART_BYTES), math.ceil(min(partitions(placed), total / (1 << 20)) / shards), 1)
    # the row's place in the scan spreads equal rows; it is the same in every attempt of a task
    salt = F.pmod(F.xxhash64(f"`{id_col}`", F.monotonically_increasing_id()), F.lit(parts)).cast("int")
    dealt = placed.withColumn(part, F.col(name) * parts + salt).repartitionById(shards * parts, part)
    dealt.drop(part).write.partitionBy(name).mode(mode).parquet(folder)


def read_shards(spark: SparkSession, folder: str, schema: T.StructType, shards: int, id_col: str = "doc_id", name: str = "shard") -> DataFrame:
    """The rows of ``folder`` and their shard, with ``shards`` shards in force.

    Rows that a later :func:`append_shards` copied away still lie in their old folder; the law tells them.
    """
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(name, T.IntegerType())])).parquet(folder)
    return rows.filter(F.col(name) == shard_of(F.col(f"`{id_col}`"), shards))


def moving(docs: DataFrame, shards: int, more: int, id_col: str = "doc_id") -> DataFrame:
    """The rows that another number of shards moves, with ``from_shard`` and ``to_shard``."""
    key = F.col(f"`{id_col}`")
    old, new = fresh(docs, "from_shard"), fresh(docs, "to_shard")
    return docs.withColumn(old, shard_of(key, shards)).withColumn(new, shard_of(key, more)).filter(F.col(old) != F.col(new))


def append_shards(spark: SparkSession, folder: str, schema: T.StructType, shards: int, more: int, id_col: str = "doc_id", text_col: str = "text", name: str = "shard") -> None:
    """Grow a written set from ``shards`` to ``more`` shards: only the rows that move are copied, all into the new folders.

    Readers that still ask for ``shards`` shards see what they saw before; only the new folders are overwritten, so
    a broken run can be repeated.
    """
    if more <= shards:
        raise ValueError("shards can only be appended")
    kept = read_shards(spark, folder, schema, shards, id_col, name)
    goes = kept.withColumn(fresh(kept, "_to"), shard_of(F.col(f"`{id_col}`"), more))
    to = goes.columns[-1]
    placed = goes.filter(F.col(to) >= shards).drop(name).withColumnRenamed(to, name)
    new = f"{run_dir(spark)}/appended-{uuid.uuid4().hex}"
    _write(placed, new, name, fresh(placed, "_part"), more, id_col, text_col, "errorifexists")
    copied = spark.read.schema(T.StructType([*schema.fields, T.StructField(name, T.IntegerType())])).parquet(new)
    copied.write.option("partitionOverwriteMode", "dynamic").partitionBy(name).mode("overwrite").parquet(folder)


def slots(spark: SparkSession, folder: str, schema: T.StructType, name: str = "shard") -> DataFrame:
    """The rows of a freshly written set with their shard and ``slot``, gapless from 0 in every shard."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(name, T.IntegerType())])).parquet(folder)
    slot, file, place = fresh(rows, "slot"), fresh(rows, "_file"), fresh(rows, "_place")
    hidden = rows.metadataColumn("_metadata")
    found = rows.select("*", hidden["file_path"].alias(file), hidden["row_index"].alias(place))
    files = found.groupBy(name, file).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(name).orderBy(file).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    manifest = stored(files.select(F.col(file).alias("_path"), (F.sum("_rows").over(before) - F.col("_rows")).alias("_before")), "manifest")
    return found.join(manifest, F.col(file) == F.col("_path")).withColumn(slot, F.col("_before") + F.col(place)).drop(file, place, "_path", "_before")


def digests(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of a written set: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    plain = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    folder = f"{run_dir(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(plain, folder, shards)
    text = F.coalesce("text", F.lit(""))
    return (
        slots(spark, folder, plain.schema)
        .select(
            "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
            F.lit(LAW).alias("law"), "shard", "slot",
        )
        .withColumn("grown_shard", shard_of(F.col("doc_id"), shards + 1))
    )
