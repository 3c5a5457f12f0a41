"""LM scoring, token counts, packing and token streams against plain versions."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rulelens.llm import encoding, lm_scoring, packing, token_counts, token_stream
from rulelens.llm.queries import END_ID, LLM_QUERIES, tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"


def frame(spark, rows, ddl="doc_id bigint, text string, source string, start string, n int"):
    width = len(ddl.split(","))
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], ddl)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# ---------------------------------------------------------------- deleted interpolation


def plain_scores(rows, order):
    docs = [(i, WORD.findall(lower(t or "")) + ["</s>"]) for i, t in rows]
    folds = [lm_scoring.fold(i) for i, _ in docs]
    grams = lambda toks, k, at: tuple((["<s>"] * 0 + ["<s>", *toks])[max(0, at + 2 - k) : at + 2])

    def count(keep):
        c = Counter()
        for (_, toks), f in zip(docs, folds, strict=True):
            if keep(f):
                c[("<s>",)] += 1
                for at in range(len(toks)):
                    c.update({grams(toks, k, at) for k in range(1, order + 1)})
        return c

    full, rest = count(lambda f: not f[0]), count(lambda f: not f[0] and not f[1])
    words = [g for g in full if len(g) == 1 and g != ("<s>",)]
    types, tokens = len(words), sum(full[g] for g in words)

    def estimates(c, toks, at):
        f = [1 / (types + 1), c[grams(toks, 1, at)] / max(tokens, 1)]
        for k in range(2, order + 1):
            g = grams(toks, k, at)
            f.append(c[g] / c[g[:-1]] if c[g[:-1]] else 0.0)
        seen = [(k - 1, int(math.log2(c[grams(toks, k, at)[:-1]] + 1))) for k in range(2, order + 1) if c[grams(toks, k, at)[:-1]]]
        return f, seen[-1] if seen else (0, 0)

    seen = [estimates(rest, toks, at) for (_, toks), f in zip(docs, folds, strict=True) if f[1] for at in range(len(toks))]
    def even(b):  # parts of longer contexts than the longest seen one have no weight
        return [float(k <= b[0] + 1) for k in range(order + 1)]

    weights = {b: [x / sum(even(b)) for x in even(b)] for b in itertools.product(range(order), range(lm_scoring.BUCKETS))}
    for _ in range(lm_scoring.ITERATIONS):
        sums = {b: even(b) for b in weights}
        for f, b in seen:
            shares = [w * x for w, x in zip(weights[b], f, strict=True)]
            for k, s in enumerate(shares):
                sums[b][k] += s / sum(shares)
        new = {b: [x / sum(s) for x in s] for b, s in sums.items()}
        change = max(abs(x - y) for b in new for x, y in zip(new[b], weights[b], strict=True))
        weights = new
        if change < lm_scoring.TOLERANCE:
            break
    out = []
    for (i, toks), f in zip(docs, folds, strict=True):
        base = sum(math.log10((full[(w,)] + 0.5) / (tokens + 0.5 * (types + 1))) for w in toks)
        score = 0.0
        for at in range(len(toks)):
            e, b = estimates(full, toks, at)
            score += math.log10(sum(w * x for w, x in zip(weights[b], e, strict=True)))
        out.append((i, f[0], len(toks), sum(full[(w,)] > 0 for w in toks), tokens, base, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, data, order):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").limit(120).collect()]
    rows += [(1000, None), (1001, ""), (1002, " \t\n "), (1003, "THE The the"), (1003, "THE The the"), (1004, "unseen-word zzz"), (1005, "a " * 20000)]
    got = sorted(map(tuple, lm_scoring.score(frame(spark, rows), order=order).collect()))
    want = sorted(plain_scores(rows, order))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-4)


def test_mixture_sums_to_one():
    rng = np.random.default_rng(0)
    order, types = 3, 50
    usable = lm_scoring._usable(order)
    weights = rng.random(usable.shape) * usable
    weights /= weights.sum(axis=1, keepdims=True)
    single = np.append(rng.integers(1, 40, types), 0)  # the last word is any unknown one
    for seen in range(order):  # how long the longest seen context is
        grams, contexts = [single], []
        for k in range(1, order):
            after = np.append(rng.multinomial(30, np.ones(types) / types), 0) * (k <= seen)
            grams.append(after)
            contexts.append(np.full(types + 1, after.sum()))
        f, b = lm_scoring._estimates(grams, contexts, int(single.sum()), types)
        assert set(b // lm_scoring.BUCKETS) == {seen} and abs((weights[b] * f).sum() - 1) < 1e-12


def test_texts_are_taken_apart_in_portions(spark, data, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").limit(60).collect()]
    want = sorted(map(tuple, lm_scoring.score(frame(spark, rows)).collect()))
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 5000)
    got = sorted(map(tuple, lm_scoring.score(frame(spark, rows)).collect()))
    assert [g[:5] for g in got] == [w[:5] for w in want] and all(g[6] == pytest.approx(w[6], rel=1e-5) for g, w in zip(got, want, strict=True))


def test_scores_of_nothing(spark):
    assert lm_scoring.score(frame(spark, [])).collect() == []


def test_model_beats_the_base_on_held_out_documents(spark, data):
    rows = LLM_QUERIES["op1_lm_scores"](spark, data).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert rows["sum(score)"] > rows["sum(base_score)"]


# ---------------------------------------------------------------- tokenizers

ODD = [
    None, "", "  ", "\n", "a\n", "\n\nb", "foo <|endoftext|> bar", "<|STARTOFTEXT|>.", "it's. don't, we'LL.", "a \n b", "x  y", "a.　b",
    "\xc0\xc9. 漢字,か゛ 123,456. \xa1hola! İstanbul ΣΑΣ.", "tab\tsep\x0b\x1cq", "Á b́.", "no..., yes!., #a.", "\xe9́.", " lead", "trail ", "\x85 a",
    "a​b. ﻿", "a\r\nb c\rd", "…. “q”", "aé.́ b", "x" * 5000, "word " * 5000, "漢" * 3000,
]


@pytest.mark.parametrize("name", [BYTE, WORDS])
def test_pieces_give_the_ids_of_whole_texts(spark, data, name):
    texts = [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()] + ODD
    own = encoding.Encoder(tokenizer(name))
    ids, bounds = own.encode(pa.array(texts, pa.string()), END_ID)
    want = own.whole([t or "" for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [w + [END_ID] for w in want]
    assert own.counts(pa.array(texts, pa.string())).tolist() == [len(w) for w in want]


def test_few_kept_pieces(monkeypatch):
    monkeypatch.setattr(encoding, "MAX_KEPT_PIECES", 3)
    own = encoding.Encoder(tokenizer(BYTE))
    for text in ("a b c d e", "b c x", "y z"):
        assert own.encode(pa.array([text]))[0].tolist() == own.whole([text])[0]


@pytest.mark.parametrize("name", [BYTE, WORDS])
@pytest.mark.parametrize("chunk, overlap", [(64, 8), (200, 2), (1000, 64)])
def test_token_counts(spark, data, name, chunk, overlap):
    texts = [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").limit(60).collect()]
    texts += ODD + [texts[0], "no_space_" * 300, "a b" * 2000, "<|endoftext|>" * 100, "<|endoftext|> x " * 100]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (3, texts[3])]
    got = sorted(map(tuple, token_counts.count(frame(spark, rows), tokenizer(name), 30, chunk, overlap).collect()), key=repr)
    own = encoding.Encoder(tokenizer(name))
    n = [len(x) for x in own.whole([t or "" for _, t in rows])]
    assert got == sorted(((i, len((t or "").encode()), k, k > 30) for (i, t), k in zip(rows, n, strict=True)), key=repr)
    assert token_counts.count(frame(spark, []), tokenizer(name)).collect() == []


# ---------------------------------------------------------------- packing


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(3)
    for window in (16, 64, 256):
        histogram = dict(Counter(rng.integers(1, window + 1, 500).tolist()))
        used = Counter()
        for choice, times in packing.plan(histogram, window):
            assert sum(k * n for k, n in choice.items()) <= window
            used.update({k: n * times for k, n in choice.items()})
        assert used == Counter(histogram)


def test_best_fill_is_the_best():
    rng = np.random.default_rng(5)
    for _ in range(100):
        counts = dict(Counter(rng.integers(3, 20, 6).tolist()))
        room = int(rng.integers(10, 60))
        choice = packing.best_fill(counts, room, [room])
        assert all(n <= counts[k] for k, n in choice.items())
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * j for s in sums for j in range(n + 1) if s + k * j <= room}
        assert sum(k * n for k, n in choice.items()) == max(sums)


def check_packing(rows, docs, ids, window):
    pieces = defaultdict(list)
    places = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for (i, _), own in zip(docs, ids, strict=True):
        own = own + [END_ID]
        for a in range(0, len(own), window):
            want[i].append((a, len(own[a : a + window]), zlib.crc32(np.array(own[a : a + window], "<u4").tobytes()), len(own)))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
    assert sorted(places) == list(range(len(places)))
    return places


def test_packing(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    docs += [(5000, None), (5001, ""), (5002, "long " * 30000), (None, "no id"), (7, docs[7][1])]
    own = encoding.Encoder(tokenizer(WORDS))
    ids = own.whole([t or "" for _, t in docs])
    rows = packing.packed(frame(spark, docs), tokenizer(WORDS), END_ID).collect()
    places = check_packing(rows, docs, ids, 4096)
    total, lengths = sum(len(x) + 1 for x in ids), [sum(n for _, n in own) for own in places.values()]
    assert total / sum(n if n & (n - 1) == 0 else 4096 for n in lengths) > 0.97
    cut = packing.pieces(frame(spark, docs), tokenizer(WORDS), END_ID, 128).cache()
    check_packing(packing.pack(cut, 128, numbered_together=50).collect(), docs, ids, 128)
    assert packing.packed(frame(spark, []), tokenizer(WORDS), END_ID).collect() == []


# ---------------------------------------------------------------- token streams


def test_token_stream(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    docs += [(5000, None), (5001, ""), (5002, "long " * 30000)]
    own = encoding.Encoder(tokenizer(WORDS))
    want, at = [], 0
    for i, t in sorted(docs):
        ids = np.array(own.whole([t or ""])[0] + [END_ID], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_stream.round_trip(frame(spark, docs), tokenizer(WORDS), END_ID).collect())) == want
    assert token_stream.round_trip(frame(spark, []), tokenizer(WORDS), END_ID).collect() == []
    doubled = token_stream.round_trip(frame(spark, [(1, "a b"), (1, "a b"), (None, "c")]), tokenizer(WORDS), END_ID).collect()
    assert sorted((r["start"], r["n_tokens"]) for r in doubled) == [(0, 2), (2, 3), (5, 3)]


@pytest.mark.parametrize("length, rows, shard", [(16, 4, 1000), (64, 8, 1 << 20)])
def test_random_access(spark, data, tmp_path, length, rows, shard):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(50)
    manifest = token_stream.write(docs, str(tmp_path / "out"), tokenizer(WORDS), END_ID, length, rows, shard)
    texts = docs.orderBy("doc_id").collect()
    own = [x + [END_ID] for x in encoding.Encoder(tokenizer(WORDS)).whole([r["text"] for r in texts])]
    ids = np.array([x for y in own for x in y], dtype=np.uint16)
    wanted = {r["doc_id"]: len(y) for r, y in zip(texts, own, strict=True)}
    at = 0
    for m in manifest.orderBy("shard").collect():
        own = token_stream.Shard(str(tmp_path / "out"), m["file"], m["header"], m["batch_bytes"], rows)
        seen = []
        for i in np.random.default_rng(1).permutation(m["sequences"]).tolist():
            values, mask = own.sequence(i)
            assert len(values) == len(mask) == length
            part = ids[at + i * length : at + min((i + 1) * length, m["tokens"])]
            assert values[mask].tolist() == part.tolist() and mask.sum() == len(part)
            seen.append(i)
        assert sorted(seen) == list(range(m["sequences"]))
        at += m["tokens"]
    assert at == len(ids)
    read = {r["doc_id"]: r["n_tokens"] for r in token_stream.read(manifest, str(tmp_path / "out")).collect()}
    assert read == wanted


def test_slices_are_read_like_whole_batches(spark, data):
    from rulelens.llm.common import Words, portions
    from rulelens.llm.jaccard_join import shingle_sets

    texts = pa.array([r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()])
    grams, bounds = shingle_sets(texts)
    for at in range(0, len(texts), 37):
        part, own = shingle_sets(texts.slice(at, 37))
        n = len(own) - 1
        assert part.tolist() == grams[bounds[at] : bounds[at + n]].tolist()
        whole = pa.RecordBatch.from_arrays([texts], names=["t"])
        assert [t for p in portions(whole, 0, 5000) for t in p.column(0).to_pylist()] == texts.to_pylist()
        assert Words(texts.slice(at, 37)).counts.tolist() == Words(texts).counts[at : at + 37].tolist()
