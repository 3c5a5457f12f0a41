"""Ranked search against a plain loop over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from rulelens.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, c.total()) for i, c in counted if c]
    n_docs, total = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, c, n in counted:
            m = 10 + (90 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, i is None, i, item))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, rank, i, -s) for rank, (s, _, i, _) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, parts=2, k=10):
    d = spark.createDataFrame([(i, t, 1, "b", 3) for i, t in docs], "doc_id bigint, text string, segment int, block string, n int").repartition(parts)
    q = spark.createDataFrame([(i, t, "x", 5) for i, t in items], "item_id bigint, text string, terms string, query int")
    got = lexical_search.search(lexical_search.build_index(d), q, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    docs = [(k, " ".join(rng.choices(words, weights, k=rng.randint(0, 120)))) for k in range(n)]
    items = [(k, " ".join(rng.choices(words, [w**0.3 for w in weights], k=rng.randint(1, 25)))) for k in range(30)]
    return docs, items


@pytest.mark.parametrize("segment,window,stride,short", [(8 << 20, 128, 64, 1 / 16), (20_000, 4, 2, 0.2), (20_000, 1, 1, 0), (3_000, 8, 3, 1)])
def test_equal_to_a_plain_loop(spark, monkeypatch, segment, window, stride, short):

    docs, items = corpus(700)
    monkeypatch.setattr(lexical_search, "SEGMENT_BYTES", segment)
    assert run(spark, docs, items) == plain(docs, items)


@pytest.mark.parametrize("seed", range(6))
def test_lists_against_all_scores(monkeypatch, seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 900))
    for name, value in (("WINDOW", int(rng.integers(1, 40))), ("STRIDE", int(rng.integers(1, 9))), ("SHORT", float(rng.random() / 2))):
        monkeypatch.setattr(lexical_search, name, value)
    windows = -(-n // lexical_search.WINDOW)
    scores, lists = np.zeros(n, dtype=np.int64), []
    for _ in range(int(rng.integers(1, 20))):
        docs = np.flatnonzero(rng.random(n) < rng.random() ** 3)
        gains = rng.integers(0, 6, len(docs))  # many ties, and gains of nothing
        scores[docs] += gains
        lists.append(lexical_search._List(docs, gains, windows))
    want = [d for d in np.lexsort((np.arange(n), -scores)) if scores[d] > 0][:10]
    got, values = lexical_search.top_documents(lists, n)
    assert got.tolist() == [int(d) for d in want] and values.tolist() == scores[want].tolist()


def test_windows_are_skipped(monkeypatch):
    read = []
    monkeypatch.setattr(lexical_search, "ranges", lambda starts, lengths: read.append(int(np.sum(lengths))) or np.zeros(0, dtype=np.int64))
    n = 128 * 1000
    rare = lexical_search._List(np.arange(500, 520), np.full(20, 100), 1000)
    common = lexical_search._List(np.arange(n), np.full(n, 1), 1000)
    lexical_search.top_documents([rare, common], n)
    assert sum(read) <= 20 + 2 * 128


def test_nulls_ties_repeats_long_texts_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK", 3)
    docs = [(k, "same words here") for k in range(40)] + [(7, "same words here"), (None, "same words here"), (None, None), (90, None), (91, ""), (92, " .,;\n")]
    docs += [(93, "Straße ÉTÉ été 42x " + "filler " * 60_000), (94, "ÉTÉ"), (95, "was\x00null words"), (-3, "words"), (-3, "words")]
    items = [(1, "same"), (2, "WORDS words, Words!"), (2, "here"), (2, "here"), (None, "été"), (3, None), (4, ""), (5, "?!"), (6, "unknown"), (7, "filler 42X"), (8, "null straße")]
    assert run(spark, docs, items, 3) == plain(docs, items)
    assert run(spark, docs, items, 1, 50) == plain(docs, items, 50)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == [] and run(spark, [(1, "a")], []) == [] and run(spark, [], []) == []
