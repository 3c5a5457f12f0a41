"""Jaccard join, decontamination and components against plain versions."""

import os
import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from rulelens.llm import components, decontamination, jaccard_join
from rulelens.llm.common import within
from rulelens.llm.queries import LLM_QUERIES
from rulelens.session import dropped, stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], "doc_id bigint, text string, key string, pivot int, size int")


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_join(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        for g in s if i is not None else ():
            by[g].append(k)
    for a, b in {(a, b) for own in by.values() for a in own for b in own if a < b}:
        (i, s), (j, t) = sets[a], sets[b]
        if 100 * len(s & t) >= 75 * len(s | t):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=repr)


def edited(text, rng, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def cases(spark, data):
    rng = random.Random(4)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    some = rows[11][1]
    rows += [(1000 + k, edited(some, rng, k % 12)) for k in range(120)]  # a large group of near copies
    vocabulary = [f"v{k}" for k in range(9)]
    rows += [(2000 + k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 14)))) for k in range(300)]  # short texts
    base = [f"u{k}" for k in range(40)]
    rows += [(3000 + k, " ".join(base[k : k + 24 + k % 5])) for k in range(14)]  # chains whose ends are not linked
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(4000 + k, passage + " " + " ".join(f"o{k}x{j}" for j in range(rng.randrange(2, 40)))) for k in range(60)]  # one passage in many
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, rows[3][1]), (3, rows[3][1]), (None, rows[3][1]), (5004, rows[3][1].upper()), (5005, "w " * 20000), (5006, "w " * 9)]
    return rows


@pytest.mark.parametrize("light", [None, 0, 9])
def test_join(spark, data, light, monkeypatch):
    if light is not None:
        monkeypatch.setattr(jaccard_join, "boundary", lambda costs: light)
    rows = cases(spark, data)
    got = sorted(map(tuple, jaccard_join.join(frame(spark, rows)).collect()), key=repr)
    assert got == plain_join(rows)


def test_join_of_nothing(spark):
    assert jaccard_join.join(frame(spark, [])).collect() == []


def test_small_groups_and_ranges(spark, data, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP", 7)
    monkeypatch.setattr(jaccard_join, "ENTRIES_PER_RANGE", 1000)
    rows = cases(spark, data)
    assert sorted(map(tuple, jaccard_join.join(frame(spark, rows)).collect()), key=repr) == plain_join(rows)


def test_keep_one(spark, data):
    rows = cases(spark, data)
    kept = jaccard_join.keep_one(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "key", "pivot", "size"]
    want = {c for _, _, c in plain_join(rows) if c is not None}
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted(want) and got.count(None) == 1


def test_boundary_follows_the_costs():
    assert jaccard_join.boundary({}) == 0
    assert jaccard_join.boundary({3: (10, 1000.0), 12: (10, 1.0)}) == 3
    assert jaccard_join.boundary({k: (5, 10.0**6) for k in range(1, 17)}) == jaccard_join.LARGEST_LIGHT


def test_components(spark):
    rng = random.Random(2)
    pairs = [(k, k + 1) for k in range(200) if k % 50] + [(1000, 2000 + k) for k in range(300)] + [(rng.randrange(3000, 3100), rng.randrange(3000, 3100)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {x: root(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


# ---------------------------------------------------------------- decontamination


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(0, 30)), rng.integers(0, 6, rng.integers(0, 60))
        assert decontamination.lcs(a, b) == plain_lcs(a.tolist(), b.tolist())


def brute_leaks(docs, items):
    """(doc, item) of every pair that the subsequence and answer checks accept in any window, without retrieval."""
    terms = decontamination.Terms(pa.array([t or "" for _, t in docs], pa.string()))

    class Row(dict):
        pass

    flat = np.ones(decontamination.DIMS, np.float32)
    queries = decontamination.Queries([Row(item_id=i, text=t) for i, t in items], flat, np.zeros((decontamination.DIMS, 2), np.float32))
    known = within(queries.vocabulary, terms.hashes)[terms.codes]
    texts = [known[a:b] for a, b in zip(terms.starts[:-1], terms.starts[1:], strict=True)]
    found = set()
    w, s = decontamination.WINDOW, decontamination.STRIDE
    for (d, _), own in zip(docs, texts, strict=True):
        for q, item in enumerate(queries.ids):
            query = queries.words[q]
            if np.isin(query, own).sum() < decontamination.LIKELY * len(query):
                continue
            for a in range(0, max(1, len(own) - s), s):
                near = own[max(0, a - w) : a + 2 * w]
                common, answer = decontamination.compare(query, queries.answers[q], near)
                if decontamination.accepted(common / len(query), answer):
                    found.add((d, item))
                    break
    return found


def test_leaks(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    rng = random.Random(9)
    planted = set()
    for k, (i, text) in enumerate(items):
        words = text.split()
        if k % 3 == 0:  # a paraphrase: some words replaced, some dropped
            words = [w for w in (f"x{rng.randrange(99)}" if rng.random() < 0.08 else w for w in words) if rng.random() > 0.05]
        host = docs[k][1].split()
        at = rng.randrange(len(host) + 1)
        docs.append((10_000 + k, " ".join(host[:at] + [w.upper() if k % 2 else w for w in words] + host[at:])))
        planted.add((10_000 + k, i))
    docs += [(20_000, None), (20_001, ""), (20_002, items[0][1]), (20_002, items[0][1]), (None, items[1][1]), (20_003, "filler " * 50_000)]
    bench = spark.createDataFrame([*items, (900, None), (901, ""), (902, " ".join(items[k][1] for k in range(8)))], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.search(frame(spark, docs), bench).collect()}
    want = brute_leaks(docs, [(r["item_id"], r["text"]) for r in bench.collect()])
    assert got <= want
    assert len(got & want) >= 0.95 * len(want)
    assert len({p for p in planted if p in got}) >= 0.95 * len(planted)
    assert {(20_002, 0), (None, 1)} <= got


def test_leaks_in_a_larger_corpus(spark):
    """More documents than the directions can hold, and a benchmark of several blocks."""
    rng = random.Random(4)
    folder = "/root/testdata/sf0.1"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id % 3 = 0").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    items += [(5_000 + k, " ".join(f"{rng.choice('abcdef')}{rng.randrange(3_000)}" for _ in range(40))) for k in range(200)]
    planted, changed = set(), set()
    for k, (i, text) in enumerate(items):
        host = docs[k][1].split()[:600]
        for first, share, into in ((100_000, 0.0, planted), (200_000, 0.15, changed)):
            words = [f"x{rng.randrange(99)}" if rng.random() < share else w for w in text.split()]
            at = rng.randrange(len(host) + 1)
            docs.append((first + k, " ".join(host[:at] + words + host[at:])))
            into.add((first + k, i))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.search(frame(spark, docs).repartition(8), bench).collect()}
    assert planted <= got
    want = brute_leaks([d for d in docs if d[0] >= 200_000], items) & changed
    assert len(want) > 200 and len(got & want) >= 0.98 * len(want)


def test_leaks_of_nothing(spark, data):
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    assert decontamination.search(frame(spark, []), bench).collect() == []
    assert decontamination.search(frame(spark, [(1, "a b c")]), bench.limit(0)).collect() == []


def test_clean_keeps_the_rest(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    leaks = {r["doc_id"] for r in LLM_QUERIES["op6_benchmark_leaks"](spark, data).collect()}
    kept = decontamination.clean(docs, bench)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - leaks


def test_large_groups_of_similar_documents_emit_few_rows(spark):
    """Blocks that verify send out fewer rows than there are documents, which join what all links join."""
    rng = random.Random(6)
    base = [f"b{k}" for k in range(60)]
    docs = [(k, " ".join([*base, *(f"r{rng.randrange(10**6)}" for _ in range(8 + 3 * (k % 4)))])) for k in range(120)]
    grams, bounds = jaccard_join.shingle_sets(pa.array([t for _, t in docs]))
    common = sorted(set.intersection(*(set(grams[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True))))[:20]
    sizes = np.diff(bounds).tolist()
    rest = spark.createDataFrame([(g >> 1, d, sizes[d], p, d) for p, g in enumerate(common) for d, _ in docs], "key bigint, doc_id bigint, size bigint, place bigint, root bigint")
    candidates = jaccard_join.open_pairs(rest, True).collect()
    out = [tuple(r) for r in jaccard_join.open_pairs(rest, True, frame(spark, docs).select("doc_id", "text")).collect()]
    assert len(candidates) > 1_000 and len(out) < len(docs)
    sets = [set(grams[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    linked = [(a, b) for a, b in map(tuple, candidates) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert set(out) <= set(linked) and len(linked) < len(candidates)

    def groups(edges):
        of = {d: d for d, _ in docs}
        for a, b in edges:
            of = {d: of[a] if r == of[b] else r for d, r in of.items()}
        return {frozenset(d for d in of if of[d] == r) for r in of.values()}

    assert groups(out) == groups(linked)


def test_sets_are_sent_only_where_they_have_candidates(spark, monkeypatch):
    """Many blocks, long lists: every block meets lists of nearly every document, but few documents have a candidate in it."""
    monkeypatch.setattr(jaccard_join, "MEETINGS_PER_BLOCK", 500)
    tables = {}
    monkeypatch.setattr(jaccard_join, "stored", lambda df, name, *a: tables.setdefault(name, stored(df, name, *a)))
    rng = random.Random(5)
    words = {i: [f"d{i}w{j}" for j in range(60)] for i in range(150)}
    docs = [(i, " ".join(w)) for i, w in words.items()] + [(1_000 + i, " ".join([*words[i][:56], "x", "y", "z", "u"])) for i in range(0, 20, 2)]
    size = {i: len(shingles(t)) for i, t in docs}
    rows = [(key, i, size[i], place, i) for i, _ in docs for place, key in enumerate(sorted(rng.sample(range(12), 2)))]
    rows += [(100 + 10 * i + n, d, size[i], 2 + n, d) for i in range(0, 20, 2) for n in range(8) for d in (i, 1_000 + i)]
    rest = stored(spark.createDataFrame(rows, "key bigint, doc_id bigint, size bigint, place bigint, root bigint"), "rows")
    want = {tuple(r) for r in jaccard_join.open_pairs(rest).collect()}
    got = {tuple(r) for r in jaccard_join.open_pairs(rest, False, frame(spark, docs).select("doc_id", "text")).collect()}
    assert got == {(i, 1_000 + i) for i in range(0, 20, 2)} <= want
    blocks = tables["visits"].select("block").distinct().count()
    asked = {d for pair in want for d in pair}
    assert blocks > 10 and tables["open-sets"].count() <= 2 * len(want) + len(asked) < len(docs)


def test_shuffle_files_go_with_the_write(spark):
    def files():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName() for f in (blocks.apply(i) for i in range(blocks.size())) if f.getName().startswith("shuffle_")}

    before = files()
    table = stored(spark.range(20_000).selectExpr("id % 5003 as k", "md5(cast(id as string)) as v").groupBy("k").agg(F.max("v").alias("v")), "grouped")
    assert not {f for f in files() - before if f.endswith(".data")} and table.count() == 5003
    dropped(table)
    assert not any(os.path.exists(f.removeprefix("file:")) for f in table.inputFiles())


def test_directions_come_from_all_documents(spark):
    """Every document's own word is in the sketch, however many documents there are, and the sketch depends on no partitioning."""
    docs = [(k, f"common words {k}a{k} of many") for k in range(9_000)]
    source = frame(spark, docs).selectExpr("doc_id", "xxhash64(text) as place", "text")
    sketches = []
    for parts in (1, 6):
        words = source.repartition(parts).mapInArrow(decontamination._packed, decontamination.PACKED)
        idf, count = decontamination.weights_of(words)
        sketches.append(decontamination.sketch(words, idf))
        assert count == len(docs)
    assert np.allclose(*sketches, atol=1e-3)
    own = decontamination.Terms(pa.array([f"{k}a{k}" for k, _ in docs]))
    alone = np.bincount(own.word_dims, minlength=decontamination.DIMS)[own.word_dims] == 1  # others may cancel out
    assert alone.sum() > 5_000 and np.abs(sketches[0][own.word_dims[alone]]).sum(axis=1).min() > 0.1


def traced(run):
    """The most memory that the driver's Python held at once while ``run`` ran, without what Arrow holds."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_the_driver_holds_the_sketch_once(spark, monkeypatch):
    """Next to the rows the directions come from there are only the directions, and what was sent to the tasks is given back."""
    sent, send = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(send(self, value)) or sent[-1])
    texts = [(k, " ".join(f"w{k * j % 997}" for j in range(1, 90))) for k in range(1, 60)]
    docs = frame(spark, texts)
    bench = spark.createDataFrame([(1, texts[4][1]), (2, texts[7][1])], "item_id bigint, text string")
    found = []
    most = traced(lambda: found.append(decontamination.search(docs, bench)))
    assert most < 2 * 4 * decontamination.DIMS * decontamination.ROWS
    assert sent and not any(os.path.exists(b._path) for b in sent)
    assert {(5, 1), (8, 2)} <= {(r["doc_id"], r["item_id"]) for r in found[0].collect()}


def test_frequent_shingles_reach_the_driver_as_numbers(spark):
    words = [f"w{k}" for k in range(60_000)]
    docs = frame(spark, [(d, " ".join([*words, f"end{d}"])) for d in range(4)]).coalesce(1)
    rows = []
    most = traced(lambda: rows.extend(jaccard_join.join(docs).collect()))
    assert {r["component_id"] for r in rows} == {0} and {r["n_shingles"] for r in rows} == {59_997}
    assert most < 12_000_000


@pytest.mark.parametrize("meetings,piece,batch", [(20_000_000, 5_000, 10_000), (500, 7, 3)])
def test_counters_equal_a_plain_self_join(spark, monkeypatch, meetings, piece, batch):
    monkeypatch.setattr(jaccard_join, "MEETINGS_PER_BLOCK", meetings)
    monkeypatch.setattr(jaccard_join, "PIECE", piece)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(batch))
    rng = random.Random(8)
    sizes = {d: rng.choice([3, 4, 17, 30, 31, 40, 53, 90]) for d in range(90)}
    roots = {d: rng.randrange(60) for d in sizes}
    rows = {(k, d): (k, d, sizes[d], rng.randrange(jaccard_join.prefix_length(sizes[d])), roots[d]) for k in range(40) for d in rng.sample(sorted(sizes), rng.randint(2, 60))}
    want, shared = set(), defaultdict(int)
    for k, d, s, p, r in rows.values():
        for e in range(d):
            if (k, e) in rows:
                _, _, t, q, o = rows[k, e]
                if r != o and 4 * min(s, t) >= 3 * max(s, t) and min(p, q) + min(s - p, t - q) >= jaccard_join.least_overlap(s, t):
                    shared[e, d] += 1
    for (e, d), n in shared.items():
        least = jaccard_join.least_overlap(sizes[e], sizes[d])
        if n >= max(1, least - max(-(-3 * sizes[e] // 4) - 1, -(-3 * sizes[d] // 4) - 1)):
            want.add((e, d))
    try:
        rest = spark.createDataFrame(list(rows.values()), "key bigint, doc_id bigint, size bigint, place bigint, root bigint").repartition(5)
        got = [tuple(r) for r in jaccard_join.open_pairs(rest).collect()]
    finally:
        spark.conf.set(key, before)
    assert len(got) == len(set(got)) and set(got) == want and want
