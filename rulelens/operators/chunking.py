"""Splitting texts into overlapping chunks with line ranges."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulelens.functions.text import language_of, newlines

# Sizes and the tag of plain text chunks.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 100
LIMIT_SIZE = 2048
LIMIT_OVERLAP = 256
TEXT_NODE = "fallback_text_split"
BLOCK_CHUNKS = 8
SEPARATORS = ("\n\n", "\n", " ", "")


def cut_windows(df: DataFrame, size: int, overlap: int, only: Column | None = None) -> DataFrame:
    """Cut ``content`` into chunks that cover it whole: one row per chunk, all other columns kept.

    Adds ``chunk_no`` and ``first``, the 0-based line on which the chunk starts. A last chunk that
    the one before it already holds is dropped; empty texts have none; rows that fail ``only`` stay
    whole. A position in UTF-8 text is found by walking from its start, so texts are first cut
    into blocks of some chunks by one pass of a regular expression, with a running count of
    lines, and chunks are cut from their block: the time grows with the length. No shuffle.
    """
    step = size - overlap
    if not 0 <= overlap <= step:
        raise ValueError("overlap must not exceed size - overlap")
    block = BLOCK_CHUNKS * step
    rest = [c for c in df.columns if c != "content"]
    cut = F.lit(True) if only is None else only
    count = F.greatest(F.lit(1), F.ceil((F.length("content") - overlap) / step)).cast("int")
    sized = df.filter(F.length("content") > 0).withColumn("_count", F.when(cut, count).otherwise(1))
    several = F.col("_count") > 1
    whole = F.when(several, F.regexp_extract_all("content", F.lit(f"(?s).{{1,{block}}}+"), F.lit(0))).otherwise(F.array("content"))
    lines = F.transform("_blocks", lambda b: newlines(b))
    running = F.aggregate(
        lines, F.array(F.lit(0)), lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n))
    )
    cut_blocks = sized.withColumn("_blocks", whole).withColumn("_lines", running).select(
        *rest, "_count", "_blocks", "_lines", F.posexplode("_blocks").alias("_block", "_body")
    )
    # a last block that only repeats the overlap has no chunk of its own
    pieces = cut_blocks.filter(F.col("_block") * BLOCK_CHUNKS < F.col("_count")).select(
        *rest,
        "_count",
        "_block",
        F.concat("_body", F.left(F.coalesce(F.get("_blocks", F.col("_block") + 1), F.lit("")), F.lit(overlap))).alias("_piece"),
        F.get("_lines", F.col("_block")).alias("_before"),
    )
    left = F.least(F.lit(BLOCK_CHUNKS), F.col("_count") - F.col("_block") * BLOCK_CHUNKS)
    chunks = pieces.select(
        *rest, "_count", "_block", "_piece", "_before", F.explode(F.sequence(F.lit(1), left)).alias("_no")
    )
    at = (F.col("_no") - 1) * step
    return chunks.select(
        *rest,
        (F.col("_block") * BLOCK_CHUNKS + F.col("_no") - 1).alias("chunk_no"),
        F.when(several, F.substring("_piece", at + 1, F.lit(size))).otherwise(F.col("_piece")).alias("content"),
        (F.col("_before") + newlines(F.left(F.col("_piece"), at))).alias("first"),
        several.alias("was_cut"),
    )


def chunk_windows(files: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Fixed-size chunks of ``files(repo, file_path, content)``, all in the JVM and without a shuffle."""
    language = language_of(F.col("file_path")).alias("language")
    cut = cut_windows(files.select("repo", "file_path", language, "content"), size, overlap)
    return cut.select(
        "repo",
        "file_path",
        "chunk_no",
        "content",
        (F.col("first") + 1).alias("start_line"),
        (F.col("first") + 1 + newlines(F.col("content"))).alias("end_line"),
        "language",
        F.lit(TEXT_NODE).alias("node_type"),
        F.lit(None).cast("string").alias("node_name"),
    )


def limit_size(chunks: DataFrame, size: int = LIMIT_SIZE, overlap: int = LIMIT_OVERLAP) -> DataFrame:
    """Split chunks over ``size`` again; parts keep the metadata and count lines from their parent."""
    rest = [c for c in chunks.columns if c not in ("content", "start_line", "end_line")]
    cut = cut_windows(chunks.drop("chunk_no"), size, overlap, only=F.length("content") > size)
    first = F.col("start_line") + F.col("first")
    return cut.select(
        *[c for c in rest if c != "chunk_no"],
        "content",
        first.alias("start_line"),
        F.when(F.col("was_cut"), first + newlines(F.col("content"))).otherwise(F.col("end_line")).alias("end_line"),
    )


def _pieces(text: str, start: int, end: int, separator: str) -> list[tuple[int, int]]:
    """Cut a range before every separator; without one, into single characters."""
    if not separator:
        return [(i, i + 1) for i in range(start, end)]
    cuts = [start]
    at = text.find(separator, start, end)
    while at != -1:
        cuts.append(at)
        at = text.find(separator, at + len(separator), end)
    return [(a, b) for a, b in zip(cuts, [*cuts[1:], end]) if a < b]


def _packed(pieces: list[tuple[int, int]], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Join neighbouring pieces up to ``size``; the next range starts with the last pieces that fit the overlap."""
    held: deque[tuple[int, int]] = deque()
    for a, b in pieces:
        if held and b - held[0][0] > size:
            yield held[0][0], held[-1][1]
            while held and (a - held[0][0] > overlap or b - held[0][0] > size):
                held.popleft()
        held.append((a, b))
    if held:
        yield held[0][0], held[-1][1]


def _ranges(text: str, start: int, end: int, level: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Chunk ranges by the first separator that occurs; pieces that are too long go to the next ones."""
    while SEPARATORS[level] and text.find(SEPARATORS[level], start, end) == -1:
        level += 1
    small: list[tuple[int, int]] = []
    for a, b in _pieces(text, start, end, SEPARATORS[level]):
        if b - a < size:
            small.append((a, b))
            continue
        yield from _packed(small, size, overlap)
        small = []
        if level + 1 < len(SEPARATORS):
            yield from _ranges(text, a, b, level + 1, size, overlap)
        else:
            yield a, b
    yield from _packed(small, size, overlap)


def split_at_separators(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """Chunks ``(offset, text)`` that break at paragraphs, else lines, else words, else anywhere.

    White space at the ends of a chunk is dropped, and with it chunks of white space alone.
    """
    found = []
    for a, b in _ranges(text, 0, len(text), 0, size, overlap):
        body = text[a:b].strip()
        if body:
            found.append((text.index(body[0], a), body))
    return found


def chunk_separators(files: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks that break at paragraphs, lines or words. Runs in Arrow batches, without a shuffle."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for repo, path, content in zip(batch["repo"], batch["file_path"], batch["content"]):
                line, seen = 1, 0
                for n, (offset, chunk) in enumerate(split_at_separators(content, size, overlap)):
                    line += content.count("\n", seen, offset) if offset >= seen else -content.count("\n", offset, seen)
                    seen = offset
                    rows.append((repo, path, n, chunk, line, line + chunk.count("\n")))
            yield pd.DataFrame(
                rows, columns=["repo", "file_path", "chunk_no", "content", "start_line", "end_line"]
            )

    schema = "repo string, file_path string, chunk_no int, content string, start_line int, end_line int"
    return (
        files.select("repo", "file_path", "content")
        .filter(F.col("content").isNotNull())
        .mapInPandas(split, schema)
        .withColumn("language", language_of(F.col("file_path")))
        .withColumn("node_type", F.lit(TEXT_NODE))
        .withColumn("node_name", F.lit(None).cast("string"))
    )
