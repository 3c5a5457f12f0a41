"""Cross-document line frequency and rules per text, in DataFrame functions only.

Lines are normalised (A-Z lower-cased, digits as 0, white space runs as one space) and hashed together with their
host. A line that occurs in more distinct documents of its host than the limits allow is removed, and a
document that loses more than ``max_removed`` percent of its words that way is rejected. Copies must not
make their own lines look common: documents with the same normalised lines count as one, and so does a near copy with the document
it is one of. A near copy shares one of its ``KEYS`` smallest hashes of five-word shingles with another document of the host, and with the first
such document (by hash) a Jaccard similarity of ``NEAR``, estimated from their ``SKETCH`` smallest hashes.

How it runs: lines are normalised once and kept as hashes, one short row per line; all counts come from that table. Counts
are combined before each shuffle, so a line that most documents share is a few rows. Common lines are dealt
``SALTS`` times to the join, so one of them never fills one task. Texts are read once more for their sketches, and the documents
that hold a line of more than ``max_documents`` are each compared with at most ``KEYS`` others, dealt in the same way.

Defined results: a null text has no words and fails the base rules; a null host is a host of its own. Equal texts of a
host share their verdict, repeated rows and null ids are kept. An empty table gives an empty result. Only the named columns are
read; :func:`clean` returns all columns of its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulelens.llm.common import WORD_BREAK, only
from rulelens.session import stored

SALTS = 16
KEYS, SKETCH, NEAR = 8, 64, 0.75
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
LEAST_WORDS, MOST_REPEATED = 50, 50
MAX_DOCUMENTS, MAX_SHARE, MAX_REMOVED = 50, 0.01, 50
_UPPER_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_LOWER_NOUGHTS = "abcdefghijklmnopqrstuvwxyz0000000000"


def bound(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def without(text: Column, characters: str) -> Column:
    """``text`` without these characters, one quick search each; ``translate`` looks up every character of the text."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) != ""


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_BREAK, -1), "")


def repeated_words(own: Column) -> Column:
    """Words inside three-word windows that occur twice or more."""

    def windows(ws: Column) -> Column:
        heads = F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 2, F.lit(0)))
        return F.sort_array(F.transform(heads, lambda w, i: F.struct(F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("i"))))

    def places(sorted_windows: Column) -> Column:
        again = F.filter(sorted_windows, lambda x, k: (x["h"] == F.get(sorted_windows, k - 1)["h"]) | (x["h"] == F.get(sorted_windows, k + 1)["h"]))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate(
        bound(bound(own, windows), places),
        start,
        lambda done, p: F.struct((done["n"] + F.least(F.lit(3), p - done["last"])).alias("n"), p.alias("last")),
        lambda done: done["n"],
    )
    return covered


def measures(text: Column) -> dict[str, Column]:
    """The base measures of a text that is not null."""
    lines = F.filter(F.split(text, "\n", -1), _has_word)
    counted = bound(words(text), lambda ws: F.struct(F.size(ws).cast("bigint").alias("n"), repeated_words(ws).alias("repeated")))
    return {
        "counted": counted,
        "word_chars": F.char_length(without(text, BLANKS)).cast("bigint"),
        "n_symbols": (F.char_length(text) - F.char_length(without(text, SYMBOLS))).cast("bigint"),
        "n_dup_lines": bound(lines, lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint")),
    }


def normal_lines(text: Column) -> Column:
    """Normalised lines, one for each line of the text."""
    folded = F.regexp_replace(F.translate(text, _UPPER_DIGITS, _LOWER_NOUGHTS), "[\\x20\\x09\\x0B-\\x0D]+", " ")
    return F.transform(F.split(folded, "\n", -1), lambda line: F.trim(line))


def content(host: Column, text: Column) -> Column:
    """Identifies equal texts of a host."""
    return F.unhex(F.md5(F.concat(F.coalesce(host, F.lit("\x00")), F.lit("\x00\n"), text)))


def _lines(source: DataFrame) -> DataFrame:
    """A stored row per line with a word: content, host (hash), own (hash of the document's normalised lines with the host), line (hash with
    the host), n (its words)."""
    hosts = F.xxhash64(F.coalesce("host", F.lit("\x00")), F.col("host").isNull())
    listed = source.select(
        content(F.col("host"), F.col("text")).alias("content"),
        hosts.alias("host"),
        F.filter(normal_lines(F.col("text")), lambda line: line != "").alias("lines"),
    )
    single = listed.select("content", "host", F.xxhash64("host", "lines").alias("own"), F.explode("lines").alias("text"))
    counted = (F.char_length("text") - F.char_length(without(F.col("text"), " ")) + 1).alias("n")
    return stored(single.select("content", "host", "own", F.xxhash64("host", "text").alias("line"), counted), "document-lines", "zstd")


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt(column: str) -> Column:
    return F.pmod(F.hash(column), F.lit(SALTS)).alias("salt")


def _sketch(text: Column) -> Column:
    """The smallest hashes of a text's five-word shingles (words in lower case, digits kept), in order."""

    def hashes(ws: Column) -> Column:
        heads = F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 4, F.lit(1)))
        return F.transform(heads, lambda w, i: F.xxhash64(w, *(F.get(ws, i + k) for k in range(1, 5))))

    return F.slice(F.sort_array(F.array_distinct(bound(words(F.lower(text)), hashes))), 1, SKETCH)


def _near_copies(source: DataFrame, lines: DataFrame, members: DataFrame) -> DataFrame:
    """(own) of the documents among ``members`` (own) that are near copies of another one of their host."""
    holders = lines.withColumn("salt", _salt("content")).join(_salted(members.select("own").distinct()), ["own", "salt"])
    wanted = stored(holders.groupBy("content", "host", "own").agg(F.lit(1).alias("_")).drop("_"), "line-holder-texts")
    # sketches of all texts are shuffled, which are shorter than the texts themselves
    rows = source.select(content(F.col("host"), F.col("text")).alias("content"), _sketch(F.col("text")).alias("sketch"))
    rows = rows.withColumn("salt", F.pmod(F.hash("content", F.monotonically_increasing_id()), F.lit(SALTS)))
    sketches = rows.join(_salted(wanted), ["content", "salt"]).select("host", "own", "sketch")
    sketches = stored(sketches.groupBy("host", "own").agg(F.min("sketch").alias("sketch")), "line-sketches")
    keys = sketches.select("host", "own", F.explode(F.slice("sketch", 1, KEYS)).alias("key"), _salt("own"))
    firsts = keys.groupBy("host", "key").agg(F.min("own").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    links = keys.join(_salted(firsts), ["host", "key", "salt"]).filter("own > first").select("own", "first").distinct()
    links = links.join(sketches.select("own", "sketch"), "own").withColumn("salt", _salt("own"))
    others = sketches.select(F.col("own").alias("first"), F.col("sketch").alias("other")).join(firsts.select("first").distinct(), "first")
    pairs = links.join(_salted(others), ["first", "salt"])
    least = F.slice(F.sort_array(F.array_union("sketch", "other")), 1, SKETCH)
    shared = bound(least, lambda union: F.size(F.array_intersect(union, F.array_intersect("sketch", "other"))) / F.size(union))
    return pairs.filter(shared >= NEAR).select("own").distinct()


def common_lines(source: DataFrame, lines: DataFrame, max_documents: int = MAX_DOCUMENTS, max_share: float = MAX_SHARE) -> DataFrame:
    """(line) hashes in more than ``max_documents`` distinct documents and more than ``max_share`` of their host's. ``source``: host, text;
    ``lines``: its stored lines."""
    rows = lines.groupBy("host", "line", "own").agg(F.lit(1).alias("_"))
    often = stored(rows.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > max_documents).select("host", "line"), "frequent-lines")
    holders = lines.withColumn("salt", _salt("own")).join(_salted(often), ["host", "line", "salt"])
    members = stored(holders.groupBy("host", "line", "own").agg(F.lit(1).alias("_")).drop("_"), "line-holders")
    near = stored(_near_copies(source, lines, members), "near-copies")
    found = members.join(near, "own", "left_anti").groupBy("host", "line").agg(F.count("*").alias("documents"))
    frequent = found.filter(F.col("documents") > max_documents)
    sizes = lines.groupBy("host", "own").agg(F.lit(1).alias("_")).join(near, "own", "left_anti").groupBy("host").agg(F.count("*").alias("all"))
    return frequent.join(sizes, "host").filter(F.col("documents") > F.lit(max_share) * F.col("all")).select("line")


def _removals(source: DataFrame, **limits) -> DataFrame:
    """(content, line, n) of all common lines in all documents, a row for each occurrence."""
    lines = _lines(source)
    salted = _salted(stored(common_lines(source, lines, **limits), "common-lines"))
    rows = lines.select("content", "line", "n", F.pmod(F.hash("content"), F.lit(SALTS)).alias("salt"))
    return rows.join(salted, ["line", "salt"]).select("content", "line", "n")


def _dealt(rows: DataFrame) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_removed: int = MAX_REMOVED, **limits) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words."""
    source = only(docs, doc_id=id_col, text=text_col, host=host_col).withColumns(
        {"doc_id": F.col("doc_id").cast("bigint"), "text": F.coalesce("text", F.lit("")), "host": F.col("host").cast("string")}
    )
    measured = source.select("doc_id", content(F.col("host"), F.col("text")).alias("content"), *(c.alias(n) for n, c in measures(F.col("text")).items()))
    base = measured.select("doc_id", "content", F.col("counted.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("counted.repeated").alias("n_repeat_words"))
    base = base.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    # equal texts of a host come as often in both sums
    removed = _removals(source, **limits).groupBy("content").agg(F.sum("n").alias("removed"))
    copies = source.select(content(F.col("host"), F.col("text")).alias("content")).groupBy("content").agg(F.count("*").alias("copies"))
    lost = removed.join(copies, "content").select("content", (F.col("removed") / F.col("copies")).cast("bigint").alias("n_removed_words"))
    spread = lost.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = base.withColumn("salt", _dealt(base)).join(spread, ["content", "salt"], "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("bigint")))
    kept = ~F.col("base_failed") & (100 * F.col("n_removed_words") <= max_removed * F.col("n_words"))
    return rows.withColumn("kept", kept).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", chars_col: str | None = None, max_removed: int = MAX_REMOVED, **limits) -> DataFrame:
    """The rows that pass, with all their columns and without their common lines; ``chars_col`` is set to the new length."""
    names = docs.columns
    text = F.coalesce(F.col("_text"), F.lit(""))
    renamed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col(f"`{text_col}`").alias("_text"), F.col(f"`{host_col}`").cast("string").alias("_host"))
    source = renamed.select(text.alias("text"), F.col("_host").alias("host"))
    lines = _removals(source, **limits).groupBy("content").agg(F.collect_set("line").alias("_common"))
    measured = renamed.withColumn("content", content(F.col("_host"), text)).withColumn("_counted", measures(text)["counted"])
    passed = measured.filter((F.col("_counted.n") >= LEAST_WORDS) & (100 * F.col("_counted.repeated") <= MOST_REPEATED * F.col("_counted.n")))
    hosts = F.xxhash64(F.coalesce("_host", F.lit("\x00")), F.col("_host").isNull())
    spread = lines.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    marked = passed.withColumn("salt", F.pmod(F.xxhash64(F.col(f"_row.`{id_col}`")), F.lit(SALTS)).cast("int")).join(spread, ["content", "salt"], "left")
    keep = F.zip_with(
        F.split(text, "\n", -1),
        F.transform(normal_lines(text), lambda line: F.array_contains("_common", F.xxhash64(hosts, line)) & (line != "")),
        lambda line, common: F.when(~common, line),
    )
    left = F.array_join(F.filter(keep, lambda line: line.isNotNull()), "\n")
    edited = marked.withColumn("_left", F.when(F.col("_common").isNull(), F.col("_text")).otherwise(left))
    kept = edited.filter(F.col("_common").isNull() | (100 * F.size(words(F.col("_left"))) >= (100 - max_removed) * F.col("_counted.n")))
    new = {text_col: F.col("_left")} | ({chars_col: F.char_length("_left").cast("bigint")} if chars_col else {})
    return kept.select(*(new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in names))
