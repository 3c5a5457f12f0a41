"""The pipeline's stages one after the other against plain versions of each."""

import numpy as np
import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from rulelens.llm import encoding, secret_ledger
from rulelens.llm.queries import LLM_ORACLES, LLM_QUERIES, tokenizer

from .test_counting import WORDS, check_packing
from .test_filters import normal, plain_quality, plain_spans
from .test_joins import brute_leaks, plain_join


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in LLM_QUERIES}
    assert set(LLM_QUERIES) <= set(entry_point.queries()) and "pipeline" in entry_point.queries()
    assert set(LLM_ORACLES) <= set(LLM_QUERIES)


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)

    def run(name, current):
        out = stages[name](spark, current, data)
        assert out.columns == docs.columns
        return out, sorted((r["doc_id"], r["text"]) for r in out.collect())

    one, got = run("quality_rules", docs)
    want, common = plain_quality(rows)
    cleaned = [(i, "\n".join(x for x in t.split("\n") if (s, normal(x)) not in common)) for (i, t, s), w in zip(rows, want, strict=True) if w[7]]
    assert got == sorted(cleaned)
    two, got = run("near_duplicates", one)
    firsts = {c for _, _, c in plain_join(cleaned)}
    single = [(i, t) for i, t in cleaned if i in firsts]
    assert got == sorted(single)
    three, got = run("benchmark_decontamination", two)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    leaks = {d for d, _ in brute_leaks(single, items)}
    left = [x for x in single if x[0] not in leaks]
    assert set(left) <= set(got) and len(got) <= len(left) + 0.05 * len(leaks)
    four, got_four = run("secret_scans", three)
    texts = dict(got)
    for i, t in got_four:
        assert (t == texts[i]) == (not plain_spans(texts[i]))
        assert not plain_spans(t, secret_ledger.BASE)
    assert [r["n_chars"] for r in four.orderBy("doc_id").collect()] == [len(t) for _, t in got_four]
    ids = encoding.Encoder(tokenizer(WORDS)).whole([t for _, t in got_four])
    check_packing(stages["packing"](spark, four, data).collect(), got_four, ids, 4096)


def test_run(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.count() > 0 and out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_of_nothing(spark, data, stage):
    empty = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[stage][1](spark, empty, data).collect() == []


def test_null_rows(spark, data):
    docs = spark.createDataFrame([(None, None, None, None, None, 1), (1, None, "en", "s", 0, 2), (2, "a " * 100, None, None, None, 3)], "doc_id bigint, text string, lang string, source string, n_chars bigint, more int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).columns == docs.columns
    assert np.all([r["length"] >= 1 for r in corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()])
