"""Text, path, duration and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts below are part of the result format.
CHARS_PER_TOKEN = 4
TRUNCATED_TOKENS = "\n... (content truncated due to token limit)"
TRUNCATED_FILE = "\n... (file truncated due to token limit)"
TRUNCATED = "\n... (truncated)"
OMITTED = "\n\n... (content omitted) ...\n\n"
NO_FILES = "(No relevant files found)"
SKIPPED_FILES = "\n\n--- Files skipped due to token limit ---\n"
NO_VALUE = "—"
STATUS_LABELS = {
    "pending": "Pendiente",
    "running": "Ejecutando",
    "completed": "Completado",
    "failed": "Fallido",
}
VERDICT_LABELS = {"pass": "Correcto", "partial": "Parcial", "fail": "Incorrecto"}
LANGUAGES = {
    "py": "python",
    "js": "javascript",
    "jsx": "javascript",
    "ts": "typescript",
    "tsx": "tsx",
    "java": "java",
    "go": "go",
    "rs": "rust",
    "cs": "csharp",
}


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def newlines(text: Column) -> Column:
    """Number of newlines; sizes in bytes are known without walking the text."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def last_newline(text: Column) -> Column:
    """0-based position of the last newline, -1 without one."""
    return F.length(text) - F.length(F.substring_index(text, "\n", -1)) - 1


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def chunk_key(path: Column, content: Column) -> Column:
    return F.md5(F.concat_ws("|", path, content))


def collection_key(url: Column, model: Column, strategy: Column) -> Column:
    return F.md5(F.concat_ws("|", url, model, strategy))


def language_of(path: Column) -> Column:
    """Language by suffix, case-sensitive, null when unknown."""
    return F.element_at(literal_map(LANGUAGES), F.regexp_extract(path, r"\.([^./]+)$", 1))


def chunk_start(content: Column, chunk: Column) -> Column:
    """1-based line of the first occurrence of ``chunk``; 0 when it does not occur."""
    at = F.instr(content, chunk)
    return F.when(at > 0, newlines(F.left(content, at - 1)) + 1).otherwise(F.lit(0))


def stored_line(line: Column) -> Column:
    """Unknown lines (0 or null) are served as -1."""
    return F.coalesce(F.nullif(line, F.lit(0)), F.lit(-1))


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / CHARS_PER_TOKEN)


def truncate_to_tokens(text: Column, max_tokens: Column) -> Column:
    """Cut to the budget, back to the last newline when that lies past half of it."""
    limit = (max_tokens * CHARS_PER_TOKEN).cast("int")
    head = F.left(text, limit)
    at = last_newline(head)
    cut = F.when(at > limit * 0.5, F.left(head, at)).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit(TRUNCATED_TOKENS)))


def cut_file(content: Column, remaining: Column) -> Column:
    """The part of a file that still fits, back to a newline past 30 % of the room."""
    head = F.left(content, remaining.cast("int"))
    at = last_newline(head)
    return F.concat(F.when(at > remaining * 0.3, F.left(head, at)).otherwise(head), F.lit(TRUNCATED_FILE))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_header(path: Column, symbols: Column) -> Column:
    label = F.when(F.size(symbols) == 1, "Funcion").otherwise("Funciones")
    names = F.concat(F.lit(" | "), label, F.lit(": "), F.array_join(symbols, ", "))
    return F.concat(
        F.lit("[Archivo: "), base_name(path), F.when(F.size(symbols) > 0, names).otherwise(""), F.lit("]")
    )


def first_sentence(text: Column) -> Column:
    return strip(F.substring_index(F.coalesce(text, F.lit("")), ". ", 1))


def clip(text: Column, size: int) -> Column:
    return F.left(text, F.lit(size))


def preview(text: Column, size: int = 120) -> Column:
    return F.when(F.length(text) > size, F.concat(clip(text, size), F.lit("…"))).otherwise(
        F.coalesce(text, F.lit(""))
    )


def millis_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", start, end)


def duration_text(start: Column, end: Column) -> Column:
    """``12ms``, ``3.4s`` or ``5m 6s``; tenths are rounded half up."""
    ms = millis_between(start, end)
    tenths = F.floor((ms + 50) / 100)
    seconds = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("s"))
    minutes = F.concat(
        F.floor(ms / 60000).cast("string"),
        F.lit("m "),
        F.floor((ms % 60000) / 1000).cast("string"),
        F.lit("s"),
    )
    return (
        F.when(start.isNull() | end.isNull(), F.lit(NO_VALUE))
        .when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60000, seconds)
        .otherwise(minutes)
    )


def round_half_up(value: Column) -> Column:
    return F.floor(value + 0.5).cast("bigint")


def percent_text(fraction: Column) -> Column:
    shown = F.concat(round_half_up(fraction * 100).cast("string"), F.lit("%"))
    return F.when(fraction.isNull() | F.isnan(fraction), F.lit(NO_VALUE)).otherwise(shown)


def owner_of(full_name: Column) -> Column:
    return F.split_part(full_name, F.lit("/"), F.lit(1))


def repo_of(full_name: Column) -> Column:
    return F.split_part(full_name, F.lit("/"), F.lit(2))


def clone_url(full_name: Column) -> Column:
    return F.concat(F.lit("https://github.com/"), full_name, F.lit(".git"))


def strip_credentials(url: Column) -> Column:
    return F.substring_index(url, "@", -1)


def add_seconds(ts: Column, seconds: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def label_of(kind: str, value: Column) -> Column:
    labels = {"task": STATUS_LABELS, "verdict": VERDICT_LABELS}[kind]
    return F.coalesce(F.element_at(literal_map(labels), value), value, F.lit(NO_VALUE))
