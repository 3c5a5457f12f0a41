"""Repository maps: the directory tree and the symbols of every repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulelens.operators.numbering import number_within, running_sum

# What a map lists.
MAP_SUFFIXES = (
    ".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".go", ".rs", ".cs", ".yml", ".yaml", ".json", ".toml",
    ".sql", ".sh", ".bash", ".css", ".html", ".h", ".cpp", ".ino",
)
MAP_NAMES = ("Dockerfile", "Makefile", "README.md")
SKIP_DIRS = (
    "node_modules", ".git", "__pycache__", ".venv", "venv", ".mypy_cache", ".pytest_cache", "dist", "build",
    ".eggs", ".egg-info",
)
SHOWN_DOT_NAME = ".env.example"
BRANCH, LAST_BRANCH, TRUNK, GAP = "├── ", "└── ", "│   ", "    "
PART_LINES = 1000


def in_map(path: Column) -> Column:
    """Files a map lists: known suffix or name, and no skipped or hidden part in the path."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    suffix = F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)
    hidden = F.exists(parts, lambda p: (F.startswith(p, F.lit(".")) & (p != SHOWN_DOT_NAME)) | p.isin(*SKIP_DIRS))
    return ~hidden & (suffix.isin(*MAP_SUFFIXES) | name.isin(*MAP_NAMES))


def in_walk(path: Column) -> Column:
    """Files whose symbols are listed: no skipped or hidden folder above them."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return ~F.exists(folders, lambda p: F.startswith(p, F.lit(".")) | p.isin(*SKIP_DIRS))


def directories(files: DataFrame) -> DataFrame:
    """Files and bytes below every directory that has a listed file; ``files(repo, file_path, length)``."""
    parts = F.split("file_path", "/")
    below = files.filter(in_map(F.col("file_path"))).withColumn("_parts", parts).filter(F.size("_parts") > 1)
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size("_parts") - 1), lambda i: F.array_join(F.slice("_parts", F.lit(1), i), "/")
    )
    return (
        below.select("repo", "length", F.explode(prefixes).alias("dir"))
        .groupBy("repo", "dir")
        .agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    )


def entries(files: DataFrame) -> DataFrame:
    """Every listed file and every directory above one, as ``path`` parts with ``is_dir``."""
    listed = files.filter(in_map(F.col("file_path"))).select("repo", F.split("file_path", "/").alias("_p"))
    nodes = F.transform(F.sequence(F.lit(1), F.size("_p")), lambda i: F.slice("_p", F.lit(1), i))
    return (
        listed.select("repo", "_p", F.explode(nodes).alias("path"))
        .select("repo", "path", (F.size("path") < F.size("_p")).alias("is_dir"))
        .distinct()
    )


def tree_lines(files: DataFrame) -> DataFrame:
    """Tree lines ``(repo, path, text)`` with connectors. Sorting by ``path`` gives the printed order.

    A node is the last of its directory when no name there is greater. Each node then looks up that
    flag for all nodes above it; a path has few parts, so those groups are small.
    """
    nodes = entries(files)
    parent = F.slice("path", F.lit(1), F.size("path") - 1)
    named = nodes.withColumn("parent", parent).withColumn("name", F.element_at("path", -1))
    last = named.groupBy("repo", "parent").agg(F.max("name").alias("last_name"))
    above = named.select(
        "repo",
        "path",
        "is_dir",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda i: F.slice("path", F.lit(1), i))).alias(
            "depth", "parent"
        ),
    )
    flagged = above.join(last, ["repo", "parent"]).withColumn(
        "is_last", F.element_at("path", F.col("depth") + 1) == F.col("last_name")
    )
    own = F.col("depth") == F.size("path") - 1
    mark = F.when(own, F.when(F.col("is_last"), LAST_BRANCH).otherwise(BRANCH)).otherwise(
        F.when(F.col("is_last"), GAP).otherwise(TRUNK)
    )
    return (
        flagged.withColumn("_mark", mark)
        .groupBy("repo", "path", "is_dir")
        .agg(F.array_sort(F.collect_list(F.struct("depth", "_mark"))).alias("_m"))
        .select(
            "repo",
            "path",
            F.concat(
                F.array_join("_m._mark", ""), F.element_at("path", -1), F.when(F.col("is_dir"), "/").otherwise("")
            ).alias("text"),
        )
    )


def symbol_lines(symbols: DataFrame) -> DataFrame:
    """Symbol lines ``(repo, path, line, text)``: a heading per file, its symbols, and an empty line.

    Files are ordered by the whole path as text, so ``path`` has one part here.
    """
    path = F.array("file_path")
    rows = symbols.select(
        "repo",
        path.alias("path"),
        F.col("line"),
        F.concat(
            F.repeat(F.lit("  "), F.col("depth")), F.lit("- "), "kind", F.lit(" **"), "name", F.lit("**"), "signature"
        ).alias("text"),
    )
    files = symbols.groupBy("repo", "file_path").agg(F.max("line").alias("_last"))
    heads = files.select("repo", path.alias("path"), F.lit(0).alias("line"), F.concat(F.lit("### "), "file_path").alias("text"))
    gaps = files.select("repo", path.alias("path"), (F.col("_last") + 1).alias("line"), F.lit("").alias("text"))
    return rows.unionByName(heads).unionByName(gaps)


def map_lines(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """All lines of all maps, in the order ``(block, path, line)`` inside a repository."""
    none = F.array().cast("array<string>")
    repos = files.select("repo").distinct()
    head = F.array(
        F.concat(F.lit("# Repository Map: "), "repo"), F.lit(""), F.lit("## Directory Structure"), F.lit("```text")
    )
    middle = F.array(F.lit("```"), F.lit(""), F.lit("## Code Symbols"), F.lit(""))

    def fixed(block: int, lines: Column) -> DataFrame:
        return repos.select(
            "repo", F.lit(block).alias("block"), none.alias("path"), F.posexplode(lines).alias("line", "text")
        )

    tree = tree_lines(files).select("repo", F.lit(1).alias("block"), "path", F.lit(0).alias("line"), "text")
    found = symbol_lines(symbols).select("repo", F.lit(3).alias("block"), "path", "line", "text")
    return fixed(0, head).unionByName(tree).unionByName(fixed(2, middle)).unionByName(found)


_ORDER = ("block", "path", "line")


def _bucket() -> Column:
    return F.struct("block", F.slice("path", F.lit(1), F.lit(3)))


def map_parts(lines: DataFrame, part_lines: int = PART_LINES) -> DataFrame:
    """Maps as texts of at most ``part_lines`` lines, numbered by ``part``."""
    numbered = number_within(lines, ["repo"], [F.col(c) for c in _ORDER], _bucket(), "_n")
    return (
        numbered.withColumn("part", F.floor(F.col("_n") / part_lines))
        .groupBy("repo", "part")
        .agg(F.array_sort(F.collect_list(F.struct("_n", "text"))).alias("_t"))
        .select("repo", "part", F.array_join("_t.text", "\n").alias("map_text"))
    )


def map_heads(lines: DataFrame, max_chars: int) -> DataFrame:
    """The first lines of every map that start within ``max_chars``: all a prompt can use."""
    size = (F.length("text") + 1).cast("bigint")
    placed = running_sum(lines, ["repo"], [F.col(c) for c in _ORDER], _bucket(), size, "_at")
    return (
        placed.filter(F.col("_at") <= max_chars)
        .groupBy("repo")
        .agg(F.array_sort(F.collect_list(F.struct("_at", "text"))).alias("_t"))
        .select("repo", F.array_join("_t.text", "\n").alias("map_text"))
    )
