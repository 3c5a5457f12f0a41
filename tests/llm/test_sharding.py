"""Jump consistent hashing against a plain loop."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulelens.llm import sharding
from rulelens.llm.queries import LLM_QUERIES, SHARDS

SCHEMA = "doc_id bigint, text string, shard string, slot int, _part int, _file string"


def plain_jump(key, n):
    key %= 2**64
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def frame(spark, rows, parts=3):
    """Documents with further columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, t, "x", 7, 8, "f") for i, t in rows], SCHEMA).repartition(parts)


def hashes(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "i bigint").select("i", F.xxhash64("i").alias("h"))
    return {r["i"]: r["h"] for r in df.collect()}


def test_jump_equals_the_plain_loop():
    rng = np.random.default_rng(1)
    keys = np.concatenate([rng.integers(-(2**63), 2**63 - 1, 2000), [0, 1, -1, 2**63 - 1, -(2**63)]])
    for n in (1, 2, 16, 17, 1000, 100_000):
        assert sharding.jump(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]


def test_growing_moves_the_necessary_share_into_the_new_shard_only():
    keys = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 200_000)
    for n in (1, 4, 16, 99):
        before, after = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        moved = before != after
        assert (after[moved] == n).all() and abs(moved.mean() - 1 / (n + 1)) < 0.005
        assert np.bincount(before, minlength=n).min() > 0.8 * len(keys) / n


def check(spark, rows, shards):
    got = sharding.digests(frame(spark, rows), shards).collect()
    keys = hashes(spark, {i for i, _ in rows})
    text = [(i, t or "") for i, t in rows]
    want = Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode()), "key", plain_jump(keys[i], shards), plain_jump(keys[i], shards + 1)) for i, t in text)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_rows(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = LLM_QUERIES["op11_jump_shards"](spark, data).collect()
    keys = hashes(spark, [i for i, _ in rows])
    assert sorted((r["doc_id"], r["shard"], r["text_crc32"]) for r in got) == sorted((i, plain_jump(keys[i], SHARDS), zlib.crc32(t.encode())) for i, t in rows)
    check(spark, rows, 5)


@pytest.mark.parametrize("shards", [1, 4])
def test_nulls_ties_long_and_repeated_rows(spark, shards, monkeypatch):
    monkeypatch.setattr(sharding, "PART_BYTES", 2000)
    rows = [(None, None)] * 40 + [(None, "ñ" * 5), (1, None), (2, ""), (3, "x" * 300_000), (-7, "é€😀\n\x00")] + [(4, "same")] * 200 + [(i, str(i)) for i in range(50)]
    check(spark, rows, shards)


def test_empty_table(spark):
    check(spark, [], 3)


def test_all_columns_are_kept(spark, tmp_path):
    docs = frame(spark, [(i, f"t{i}") for i in range(30)])
    name = sharding.write_shards(docs, str(tmp_path / "s"), 4)
    got = sharding.slots(spark, str(tmp_path / "s"), docs.schema, name)
    assert [*docs.columns, name] == got.columns[:-1] and got.columns[-1] not in docs.columns
    assert sorted(got.select(*docs.columns).collect()) == sorted(docs.collect())


def test_appended_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(400)], "doc_id bigint, text string")
    folder = str(tmp_path / "s")
    sharding.write_shards(docs, folder, 6)
    for _ in range(2):  # a repeated run changes nothing
        sharding.append_shards(spark, folder, docs.schema, 6, 8)
    keys = hashes(spark, range(400))
    for n in (6, 8):
        got = sharding.read_shards(spark, folder, docs.schema, n).collect()
        assert sorted((r["doc_id"], r["shard"]) for r in got) == sorted((i, plain_jump(k, n)) for i, k in keys.items())
    moved = sharding.moving(docs, 6, 8).collect()
    assert sorted(r["doc_id"] for r in moved) == sorted(i for i, k in keys.items() if plain_jump(k, 6) != plain_jump(k, 8))
    assert all(r["to_shard"] >= 6 for r in moved)
    copied = spark.read.parquet(folder).filter("shard >= 6").count()
    assert copied == len(moved)


def test_shrinking_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        sharding.append_shards(spark, str(tmp_path), spark.range(0).schema, 4, 4)
