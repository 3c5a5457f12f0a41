"""The numbered operators as registered queries: ``name -> function(spark, folder)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.llm import (
    conversation_trie,
    decontamination,
    jaccard_join,
    lexical_search,
    line_quality,
    lm_scoring,
    packing,
    secret_ledger,
    sharding,
    surrogates,
    token_counts,
    token_stream,
    url_lists,
)
from rulelens.llm.oracles import ORACLES
from rulelens.session import stored

Query = Callable[[SparkSession, str], DataFrame]
LLM_QUERIES: dict[str, Query] = {}
LLM_ORACLES: dict[str, str] = dict(ORACLES)


def query(fn: Query) -> Query:
    LLM_QUERIES[fn.__name__] = fn
    return fn


END_ID = 2
#: Of the registered query only; real runs bring their own.
KEY = b"registered query"


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_lm_scores(spark, folder):
    """Deleted interpolation of unigrams and bigrams over all documents."""
    return lm_scoring.score(table(spark, folder, "documents"))


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """The pages with fetch dates over the year 2024, by page id."""
    return table(spark, folder, "pages").select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(page_id % 366 as int))").alias("fetched"))


@query
def op2_url_lists(spark, folder):
    """Temporal list join of all pages with entries about their hosts."""
    pages = captures(spark, folder)
    return url_lists.evaluate(pages, url_lists.entries_of(pages)).withColumn("fetched", F.col("fetched").cast("string"))


@query
def op3_line_quality(spark, folder):
    """Cross-document line frequency and rules over all documents."""
    return line_quality.judge(table(spark, folder, "documents"))


@query
def op4_token_counts(spark, folder):
    """Overlap resynchronisation over all documents."""
    return token_counts.count(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"))


@query
def op5_jaccard_join(spark, folder):
    """Size-aware heavy-light join of all documents."""
    return jaccard_join.join(table(spark, folder, "documents"))


@query
def op6_benchmark_leaks(spark, folder):
    """Latent semantic retrieval of all benchmark items in all documents."""
    return decontamination.search(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("place")


@query
def op7_surrogates(spark, folder):
    """Personal data of all documents replaced by surrogates."""
    return surrogates.replace(table(spark, folder, "documents"), KEY)


@query
def op8_secret_ledger(spark, folder):
    """All documents scanned through a fresh ledger."""
    return secret_ledger.report(table(spark, folder, "documents"), secret_ledger.new_ledger(spark))


@query
def op9_packed_windows(spark, folder):
    """Minimum bin slack over all documents."""
    return packing.packed(table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"), END_ID)


@query
def op10_token_stream(spark, folder):
    """All documents written as Arrow stream files and read back."""
    return token_stream.round_trip(table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"), END_ID)


SHARDS = 16


@query
def op11_jump_shards(spark, folder):
    """All documents written into shards by jump consistent hashing and read back."""
    return sharding.digests(table(spark, folder, "documents"), SHARDS)


@query
def op12_hybrid_search(spark, folder):
    """The ten best of all documents for each benchmark item."""
    return lexical_search.search(lexical_search.build_index(table(spark, folder, "documents")), table(spark, folder, "benchmark"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """All conversations with the first turns of their hundred's first conversation in place of their own."""
    own = stored(conversation_trie.sequences(turns), "sequences")
    heads = own.filter("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("head"))
    n = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).join(heads, "base", "left").withColumn("n", n)
    return joined.select("conv_id", F.expr("concat(slice(coalesce(head, array()), 1, n), slice(turns, n + 1, size(turns)))").alias("turns"))


@query
def op13_conversation_trie(spark, folder):
    """The prefix trie of all rebuilt conversations."""
    return conversation_trie.nodes(rebuilt(table(spark, folder, "conversations")))
