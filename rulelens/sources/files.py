"""Scanning trees of source files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.functions.text import language_of
from rulelens.operators.repomap import SKIP_DIRS, in_map
from rulelens.session import stored

# What is read.
CODE_SUFFIXES = (
    ".py", ".js", ".ts", ".tsx", ".jsx", ".vue",
    ".sh", ".bash",
    ".yml", ".yaml", ".json", ".toml",
    ".sql",
    ".h", ".cpp", ".ino",
    ".css", ".html",
    ".md", ".txt",
    ".java", ".go", ".rb", ".php", ".rs", ".kt",
)
CODE_NAMES = ("Dockerfile",)
EXCLUDED_DIRS = ("node_modules", ".git", "__pycache__", "data")
EXCLUDED_NAMES = ("package-lock.json", "uv.lock")
EXCLUDED_SUFFIXES = (".pdf", ".png", ".jpg", ".svg", ".woff", ".tex")
MAX_BYTES = 1_000_000

LISTED_ROWS = 10_000
TASK_BYTES = 128 * 1024 * 1024
BATCH_BYTES = 16 * 1024 * 1024


def is_excluded(path: Column, below_root_only: bool = False) -> Column:
    """Excluded directories, names and suffixes at any depth.

    ``below_root_only`` keeps them when they lie directly in the root, as the reference does.
    """
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    if below_root_only:
        inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
        by_name = (F.size(parts) > 1) & (name.isin(*EXCLUDED_NAMES) | _has_suffix(name, EXCLUDED_SUFFIXES))
        return F.exists(inner, lambda p: p.isin(*EXCLUDED_DIRS)) | by_name
    return (
        F.exists(folders, lambda p: p.isin(*EXCLUDED_DIRS))
        | name.isin(*EXCLUDED_NAMES)
        | _has_suffix(name, EXCLUDED_SUFFIXES)
    )


def _has_suffix(name: Column, suffixes: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for s in suffixes:
        found = found | F.endswith(name, F.lit(s))
    return found


def is_code(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    suffix = F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)
    return suffix.isin(*CODE_SUFFIXES) | name.isin(*CODE_NAMES)


def repositories_below(spark: SparkSession, root: str) -> DataFrame:
    """Names of the folders directly below ``root``, one per repository."""
    system, base = FileSystem.from_uri(root) if "://" in root else (LocalFileSystem(), root)
    found = system.get_file_info(FileSelector(base))
    names = [(f.base_name,) for f in found if f.type == FileType.Directory]
    return spark.createDataFrame(names, "repo string")


def list_files(spark: SparkSession, root: str, repos: DataFrame | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """All files ``(repo, file_path, length)`` of the given repositories; folders named in ``skip`` are not entered.

    Spark's own file sources leave out every name that starts with a dot or an underscore, and with it
    files such as ``__init__.py``. So folders are listed inside tasks, one level of all trees after the
    other, and spread anew at each level: a large repository is listed by many tasks. A missing repository and a
    folder that cannot be listed are errors: Spark repeats the task, and then the scan fails, as a file that only
    seems to be gone would leave the index.
    """
    repos = repositories_below(spark, root) if repos is None else repos.select("repo")
    entry = "repo string, file_path string, length bigint, is_folder boolean"

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = FileSystem.from_uri(root) if "://" in root else (LocalFileSystem(), root)
        names = ["repo", "file_path", "length", "is_folder"]
        rows: list[tuple[str, str, int | None, bool]] = []
        for batch in batches:
            for repo, folder in zip(batch["repo"], batch["file_path"]):
                top = f"{base.rstrip('/')}/{repo}"
                for f in system.get_file_info(FileSelector(f"{top}/{folder}" if folder else top)):
                    if f.type == FileType.Directory and f.base_name not in skip:
                        rows.append((repo, f.path[len(top) + 1 :], 0, True))
                    elif f.type == FileType.File:
                        rows.append((repo, f.path[len(top) + 1 :], f.size, False))
                if len(rows) >= LISTED_ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        yield pd.DataFrame(rows, columns=names)

    folders = repos.distinct().select("repo", F.lit("").alias("file_path"))
    found = None
    while True:
        spread = folders.repartition(spark.sparkContext.defaultParallelism, "repo", "file_path")
        level = stored(spread.mapInPandas(walk, entry), "listing")
        files = level.filter("not is_folder").drop("is_folder")
        found = files if found is None else found.unionByName(files)
        folders = level.filter("is_folder").select("repo", "file_path")
        if folders.isEmpty():
            return found


def read_files(files: DataFrame, root: str) -> DataFrame:
    """Add ``content`` as text to listed files; bad UTF-8 bytes are replaced. A file that cannot be read fails the task.

    The listing is stored first. Files are then spread by a hash over tasks of about 128 MB, so one large
    repository is read by many tasks, and a task holds at most 16 MB of texts at a time.
    """
    listed = stored(files, "listing")
    spark = listed.sparkSession
    total = listed.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, total // TASK_BYTES + 1)
    names = [f.name for f in listed.schema.fields]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = FileSystem.from_uri(root) if "://" in root else (LocalFileSystem(), root)
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for row in batch[names].itertuples(index=False, name=None):
                values = dict(zip(names, row))
                with system.open_input_stream(f"{base.rstrip('/')}/{values['repo']}/{values['file_path']}") as f:
                    body = f.read()
                rows.append((*row, body))
                held += len(body)
                if held >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=[*names, "content"])
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=[*names, "content"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listed.schema.fields)
    spread = listed.repartition(int(tasks), "repo", "file_path")
    return spread.mapInPandas(read, f"{schema}, content binary").withColumn(
        "content", F.make_valid_utf8(F.col("content").cast("string"))
    )


def scan_code(
    spark: SparkSession, root: str, repos: DataFrame | None = None, below_root_only: bool = False
) -> DataFrame:
    """Source files ``(repo, file_path, length, content, language)`` below ``root``, one folder per repository.

    Names, folders and sizes are tested on the listing; only files that stay are read.
    """
    path = F.col("file_path")
    skip = () if below_root_only else EXCLUDED_DIRS
    kept = list_files(spark, root, repos, skip).filter(
        is_code(path) & ~is_excluded(path, below_root_only) & (F.col("length") <= MAX_BYTES)
    )
    return read_files(kept, root).withColumn("language", language_of(path))


def scan_tree(spark: SparkSession, root: str, repos: DataFrame | None = None) -> DataFrame:
    """Files that a repository map lists ``(repo, file_path, length)``."""
    return list_files(spark, root, repos, SKIP_DIRS).filter(in_map(F.col("file_path")))
