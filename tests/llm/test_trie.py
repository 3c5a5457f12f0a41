"""The prefix trie against a plain one, and its parentheses against a stack."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from rulelens.llm import conversation_trie as trie
from rulelens.llm.queries import rebuilt

SCHEMA = "conv_id bigint, turn bigint, role string, text string, shard int, node string, turns int, path string"


def plain_sequences(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    return {c: [x[3:] for x in sorted(ts)] for c, ts in own.items()}


def plain_rebuilt(own):
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    return out


def plain_nodes(own):
    members = defaultdict(list)
    for c, ts in own.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = sum(saved[q] for q in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    ends = {p: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(own[c]) == len(p)).encode()).hexdigest() for p, m in members.items()}
    return sorted(
        ((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], ends[p]) for p, m in members.items()), key=repr
    )


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "n", 2, "p") for r in rows], SCHEMA).repartition(parts)


def found(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def random_turns(n, seed, words=3):
    rng = random.Random(seed)
    rows = [(c, k, rng.choice(["user", "assistant"]) if k > 1 else "user", "xyz"[rng.randrange(words)] * rng.randint(1, 2)) for c in range(n) for k in range(rng.randint(1, 9))]
    rng.shuffle(rows)
    return rows


def test_parentheses():
    for seed in range(30):
        rng = random.Random(seed)
        bits, open_ = [1], 1
        while open_ and len(bits) < 20_000:
            up = rng.random() < (0.5 + 0.4 * (len(bits) < 3000 * (seed % 3))) or open_ == 1 and len(bits) < 300
            bits.append(int(up))
            open_ += 1 if up else -1
        bits += [0] * open_
        stack, want = [], {}
        for at, b in enumerate(bits):
            if b:
                stack.append(at)
            else:
                want[stack.pop()] = at
        opens = np.array(sorted(want))
        assert trie.Parens(np.array(bits, dtype=np.int8)).find_close(opens).tolist() == [want[i] for i in opens.tolist()]


def test_common_prefixes():
    rng = random.Random(3)
    paths = sorted([rng.choice("ab") for _ in range(rng.randint(0, 6))] for _ in range(200))
    keys = np.array([[ord(x), 0] for p in paths for x in p], dtype=np.uint64).reshape(-1, 2)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in paths])])
    want = [0] + [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(paths, paths[1:])]
    assert trie.common_prefixes(keys, starts).tolist() == want


@pytest.mark.parametrize("turns,batch", [(200_000, 10_000), (40, 7), (1, 1)])
def test_equal_to_a_plain_trie(spark, monkeypatch, turns, batch):
    monkeypatch.setattr(trie, "TURNS", turns)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(batch))
    try:
        rows = random_turns(300, 5)
        assert found(trie.nodes(trie.sequences(frame(spark, rows)))) == plain_nodes(plain_sequences(rows))
        assert found(trie.nodes(rebuilt(frame(spark, rows)))) == plain_nodes(plain_rebuilt(plain_sequences(rows)))
    finally:
        spark.conf.set(key, before)


def test_copies_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(trie, "TURNS", 30)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10")
    try:
        rows = [(c, k, "user", f"turn {k}") for c in range(400) for k in range(3)]
        rows += [(c, k, "user", f"turn {k}") for c in range(400, 420) for k in range(5)] + [(c, 0, "user", "turn 0") for c in range(420, 500)]
        assert found(trie.nodes(trie.sequences(frame(spark, rows, 8)))) == plain_nodes(plain_sequences(rows))
    finally:
        spark.conf.set(key, before)


def test_nulls_ties_long_and_repeated_rows(spark):
    rows = [(1, None, None, "a"), (1, 0, "user", None), (1, 0, "user", None), (2, None, None, "a"), (2, 0, "user", ""), (2, 0, "user", "")]
    rows += [(None, 1, "user", "x"), (None, None, None, None), (3, 5, "u", "ser" * 100_000), (3, 5, "us", "er"), (3, 5, "use", "r"), (4, 1, "é", "😀😀")]
    rows += [(205, k, "user", "zz") for k in range(1500)] + [(206, k, "user", "zz") for k in range(1500)] + [(101, 0, "user", "dropped")]
    own = plain_sequences(rows)
    assert found(trie.nodes(trie.sequences(frame(spark, rows)))) == plain_nodes(own)
    assert found(trie.nodes(rebuilt(frame(spark, rows)))) == plain_nodes(plain_rebuilt(own))


def test_turnless_and_single_conversations(spark):
    # a conversation without a base keeps nothing of its first turns
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b")]
    assert found(trie.nodes(rebuilt(frame(spark, rows)))) == plain_nodes({c: []})
    assert found(trie.nodes(trie.sequences(frame(spark, rows)))) == plain_nodes(plain_sequences(rows))


def test_empty_table(spark):
    assert found(trie.nodes(trie.sequences(frame(spark, [])))) == [] == found(trie.nodes(rebuilt(frame(spark, []))))


def test_given_tables(spark, data):
    df = spark.read.parquet(f"{data}/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()]
    assert found(trie.nodes(rebuilt(df))) == plain_nodes(plain_rebuilt(plain_sequences(rows)))
