"""Declarations of source files: chunks with names and line ranges, and the symbol table.

Files are at most 1 MB (see the file source), so one file is a unit of work; files are spread by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulelens.functions.text import language_of
from rulelens.operators.chunking import chunk_windows

_NAME = r"([A-Za-z_$][\w$]*)"
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|virtual|override|async|partial|synchronized)\s+)*"
_TYPE = r"[\w<>\[\],.?]+\s+"
_NOT_CALL = r"(?!return\b|new\b|else\b|throw\b|if\b|for\b|while\b|switch\b|catch\b|using\b|lock\b)"

# (kind, node type, pattern); the first group of a pattern is the name. First match wins.
_JS = (
    ("class", "class_declaration", rf"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_NAME}"),
    ("function", "function_declaration", rf"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_NAME}"),
    (
        "function",
        "arrow_function",
        rf"(?:export\s+)?(?:const|let|var)\s+{_NAME}\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>",
    ),
    (
        "method",
        "method_definition",
        rf"(?!if\b|for\b|while\b|switch\b|catch\b|function\b|return\b)(?:(?:static|async|get|set|public|private|protected|readonly)\s+)*{_NAME}\s*\([^)]*\)\s*(?::[^{{]+)?\{{",
    ),
)
PATTERNS = {
    "python": (
        ("class", "class_definition", rf"class\s+{_NAME}"),
        ("function", "function_definition", rf"(?:async\s+)?def\s+{_NAME}\s*(\([^)]*\))?"),
    ),
    "javascript": _JS,
    "typescript": _JS,
    "tsx": _JS,
    "java": (
        ("class", "class_declaration", rf"{_MODS}class\s+{_NAME}"),
        ("interface", "interface_declaration", rf"{_MODS}interface\s+{_NAME}"),
        ("method", "method_declaration", rf"{_NOT_CALL}{_MODS}{_NOT_CALL}{_TYPE}{_NAME}\s*\([^;]*\)\s*(?:throws\s+[\w,.\s]+)?\{{"),
        ("method", "constructor_declaration", rf"(?:public|private|protected)\s+{_NAME}\s*\([^;]*\)\s*\{{"),
    ),
    "go": (
        ("method", "method_declaration", rf"func\s+\([^)]*\)\s*{_NAME}"),
        ("function", "function_declaration", rf"func\s+{_NAME}"),
        ("type", "type_declaration", rf"type\s+{_NAME}"),
    ),
    "rust": (
        ("function", "function_item", rf"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+{_NAME}"),
        ("impl", "impl_item", rf"impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?{_NAME}"),
        ("struct", "struct_item", rf"(?:pub(?:\([^)]*\))?\s+)?struct\s+{_NAME}"),
        ("enum", "enum_item", rf"(?:pub(?:\([^)]*\))?\s+)?enum\s+{_NAME}"),
        ("trait", "trait_item", rf"(?:pub(?:\([^)]*\))?\s+)?trait\s+{_NAME}"),
    ),
    "csharp": (
        ("class", "class_declaration", rf"{_MODS}class\s+{_NAME}"),
        ("interface", "interface_declaration", rf"{_MODS}interface\s+{_NAME}"),
        ("struct", "struct_declaration", rf"{_MODS}struct\s+{_NAME}"),
        ("method", "method_declaration", rf"{_NOT_CALL}{_MODS}{_NOT_CALL}{_TYPE}{_NAME}\s*\([^;]*\)\s*\{{?$"),
        ("method", "constructor_declaration", rf"(?:public|private|protected|internal)\s+{_NAME}\s*\([^;]*\)\s*\{{?$"),
    ),
}
METHOD_HOLDERS = {"class", "interface", "struct", "impl", "trait"}
_COMPILED = {lang: [(k, t, re.compile(p)) for k, t, p in rows] for lang, rows in PATTERNS.items()}
SCHEMA = (
    "repo string, file_path string, language string, start_line int, end_line int, kind string, "
    "node_type string, name string, depth int, signature string, content string"
)


def scan_file(text: str, language: str) -> list[tuple]:
    """Declarations ``(start, end, kind, node type, name, depth, signature)`` with 1-based lines.

    A declaration lasts until the next line that is indented no deeper; a line that only closes or
    opens its braces still belongs to it. One pass with a stack of open declarations.
    """
    found: list[list] = []
    open_: list[tuple[int, int]] = []
    last = 0
    for no, line in enumerate(text.split("\n"), start=1):
        body = line.lstrip()
        if not body.strip():
            continue
        indent = len(line) - len(body)
        opens_here = body.startswith("{") and language != "python"
        closes = body[0] in "})" and language != "python"
        while open_ and indent <= open_[-1][0] and not opens_here:
            if closes and indent == open_[-1][0]:
                found[open_.pop()[1]][1] = no
                break
            found[open_.pop()[1]][1] = last
        last = no
        for kind, node, pattern in _COMPILED[language]:
            m = pattern.match(body)
            if m:
                holder = found[open_[-1][1]][2] if open_ else None
                if kind == "function" and holder in METHOD_HOLDERS:
                    kind = "method"
                signature = (m.group(2) or "()") if language == "python" and kind != "class" else ""
                found.append([no, no, kind, node, m.group(1), len(open_), signature])
                open_.append((indent, len(found) - 1))
                break
    for _, i in open_:
        found[i][1] = last
    return [tuple(f) for f in found]


def declarations(files: DataFrame) -> DataFrame:
    """Declarations of all files in a known language, with their text."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for repo, path, lang, content in batch.itertuples(index=False):
                text_lines = content.split("\n")
                for start, end, kind, node, name, depth, signature in scan_file(content, lang):
                    body = "\n".join(text_lines[start - 1 : end])
                    rows.append((repo, path, lang, start, end, kind, node, name, depth, signature, body))
            yield pd.DataFrame(rows, columns=names)

    known = files.withColumn("language", language_of(F.col("file_path"))).filter(
        F.col("language").isNotNull() & F.col("content").isNotNull()
    )
    return known.select("repo", "file_path", "language", "content").mapInPandas(scan, SCHEMA)


def declaration_chunks(files: DataFrame, methods: bool = True) -> DataFrame:
    """Chunks at declarations; files without any are split as plain text."""
    found = declarations(files)
    if not methods:
        found = found.filter(F.col("kind") != "method")
    own = found.select(
        "repo",
        "file_path",
        "content",
        "start_line",
        "end_line",
        "language",
        "node_type",
        F.col("name").alias("node_name"),
    )
    plain = files.join(found.select("repo", "file_path").distinct(), ["repo", "file_path"], "left_anti")
    return own.unionByName(chunk_windows(plain).drop("chunk_no"))


def symbols(files: DataFrame) -> DataFrame:
    """Symbol table: top-level declarations, and the methods directly inside types."""
    listed = F.col("depth") == 0
    member = (F.col("depth") == 1) & (F.col("kind") == "method")
    return declarations(files).filter(listed | member).select(
        "repo", "file_path", F.col("start_line").alias("line"), "kind", "name", "depth", "signature"
    )
