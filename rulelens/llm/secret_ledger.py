"""Incremental blob ledger for secret scans, in DataFrame functions only.

Every version of every file is known by the SHA-256 of its text (its blob). The ledger holds which blobs were
scanned by which rule versions, and what was found. A scan takes any set of file versions, scans only the pairs
of blob and rule version that the ledger lacks, adds them, and joins the findings back to all paths
that ever held the blob. Copies and reappearing versions are never scanned again; a new or changed
rule scans old blobs for that rule only.

Positions come from the texts between the matches: the pieces and matches of a text are numbered, and
a match begins where the lengths of all before it end. Offsets are code points, the end is exclusive.

How it runs: blob ids are shuffled, and once the texts of unseen blobs' first rows. Findings are written before the
list of scanned blobs, and read without repeats, so a scan that broke off is simply run again.
Findings are dealt ``SALTS`` times to the join with the paths, as one blob may lie at very many.
:func:`redact` shuffles the rows that may have findings, by a bit map of fixed size of the blobs found; all others
stay where they lie. Where other blobs share the bits of those found, their rows are shuffled too, and not changed.

Defined results: a null text is an empty blob without findings. Repeated rows and null paths are kept. An empty table
scans nothing. Only the named columns are read; :func:`redact` returns all columns of its input.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulelens.llm.common import only
from rulelens.session import run_dir

SALTS = 16
#: A bit map of blobs has ``2 ** MAP_BITS`` bits (2 MB), in words of 64.
MAP_BITS = 24


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` count if their group ``group`` has ``least`` characters; ``fast`` is the same pattern for Java."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1
    fast: str = ""

    @property
    def java(self) -> str:
        return self.fast or self.pattern

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)


def _private_key(own: str) -> str:
    """A whole private key: from its BEGIN line to its END line if nothing else with five dashes lies between, otherwise
    through the header and base64 lines that follow. Line ends may be written as \\n, lines may be quoted or
    indented. ``own`` is put behind each quantifier: ``+`` makes it possessive, which Java runs without recursion."""
    base = "[A-Za-z0-9+/]"
    gap = rf"""(?:"\x20?\+|[\x20\t\r\n>"',;|#*]|\\[nrt])+{own}"""
    text = rf"[^\r\n\\-]*{own}(?:-{{1,4}}{own}[^\r\n\\-]+{own})*{own}"
    named = rf"(?:[A-Za-z][A-Za-z0-9-]*{own}:\x20{text}(?:[\r\n]|\\[nr])(?:{gap})?{own})*{own}"
    line = rf"{base}{{16,}}{own}={{0,2}}{own}"
    lines = rf"{line}(?:{gap}{line})*{own}"
    short = rf"(?:{gap}(?:(?:{base}{{4}})*(?:{base}{{2}}==|{base}{{3}}=)|(?:{base}{{4}}){{1,3}}(?:[\r\n]|$)))?{own}(?:{gap}={base}{{4}})?{own}"
    mark = r"[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
    return rf"-----BEGIN {mark}(?:[^-]*{own}(?:-{{1,4}}{own}[^-]+{own})*{own}-----END {mark}|(?:{gap}{named}{lines}{short})?{own})"


RULES = (
    *BASE,
    Rule("pem", _private_key(""), version=2, fast=_private_key("+")),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
SCANNED = "blob binary, rules array<string>"
FINDINGS = "blob binary, rule string, kind string, start bigint, end bigint"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A part of the ledger; empty where it was never written."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def blob(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _found(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """FINDINGS of (blob, todo, text), one row per blob."""
    per_rule = [
        F.when(
            F.array_contains("todo", rule.key) & F.col("text").rlike(rule.java),
            F.struct(
                F.lit(rule.key).alias("rule"),
                F.lit(rule.kind).alias("kind"),
                F.lit(rule.least).alias("least"),
                F.arrays_zip(
                    F.split("text", rule.java, -1).alias("before"),
                    F.regexp_extract_all("text", F.lit(rule.java), F.lit(0)).alias("match"),
                    F.regexp_extract_all("text", F.lit(rule.java), F.lit(rule.group)).alias("secret"),
                ).alias("parts"),
            ),
        )
        for rule in rules
    ]
    by_rule = texts.select("blob", F.explode(F.array(*per_rule)).alias("r")).filter("r is not null")
    parts = by_rule.select("blob", "r.rule", "r.kind", "r.least", F.posexplode("r.parts").alias("i", "part"))
    sized = parts.select(
        "blob", "rule", "kind", "least", "i",
        F.char_length("part.before").alias("gap"),
        F.char_length("part.match").alias("size"),
        F.char_length("part.secret").alias("secret"),
    ).filter("size is not null")
    so_far = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ended = sized.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far).cast("bigint"))
    return ended.filter("secret >= least").select("blob", "rule", "kind", (F.col("end") - F.col("size")).cast("bigint").alias("start"), "end")


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Bring the ledger up to date with these file versions; returns the findings of exactly these rules for their
    blobs (FINDINGS). Only pairs of blob and rule version that the ledger lacks are scanned."""
    spark = versions.sparkSession
    wanted = [r.key for r in rules]
    keyed = only(versions, path=path_col, text=text_col).select(F.xxhash64(F.col("path").cast("string")).alias("place"), F.coalesce("text", F.lit("")).alias("text"))
    ids = keyed.select("place", blob(F.col("text")).alias("blob"))
    firsts = ids.groupBy("blob").agg(F.min("place").alias("place"))
    scanned = _read(spark, f"{ledger}/scanned", SCANNED).select("blob", F.explode("rules").alias("rule"))
    known = scanned.filter(F.col("rule").isin(wanted)).groupBy("blob").agg(F.collect_set("rule").alias("known"))
    open_ = (
        firsts.join(known, "blob", "left")
        .withColumn("todo", F.array_except(F.array(*map(F.lit, wanted)), F.coalesce("known", F.array().cast("array<string>"))))
        .filter(F.size("todo") > 0)
        .select("blob", "place", "todo")
    )
    texts = keyed.withColumn("blob", blob(F.col("text"))).join(open_, ["blob", "place"])
    once = texts.withColumn("n", F.row_number().over(Window.partitionBy("blob", "place").orderBy("place"))).filter("n = 1")
    _found(once.select("blob", "todo", "text"), rules).write.mode("append").parquet(f"{ledger}/findings")
    open_.select("blob", F.col("todo").alias("rules")).write.mode("append").parquet(f"{ledger}/scanned")
    return _read(spark, f"{ledger}/findings", FINDINGS).filter(F.col("rule").isin(wanted)).dropDuplicates()


def _order(rules: tuple[Rule, ...]) -> Column:
    return F.coalesce(*(F.when(F.col("kind") == r.kind, F.lit(i)) for i, r in enumerate(rules)))


def _by_blob(findings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, salt, found): all spans of a blob in order, for a join with rows that are dealt by salt."""
    found = findings.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", _order(rules).alias("o"), "end", "kind"))).alias("found"))
    return found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _may_be_among(blobs: DataFrame) -> Column:
    """Of a row with a blob: true if that is one of ``blobs``, and seldom otherwise."""
    place = F.shiftrightunsigned(F.xxhash64("blob"), 64 - MAP_BITS)
    word, bit = F.shiftright(place, 6).cast("int"), F.pmod(place, F.lit(64)).cast("int")
    marks = blobs.select(word.alias("word"), bit.alias("bit")).selectExpr("word", "shiftleft(1L, bit) as bits")
    blank = blobs.sparkSession.range(1 << (MAP_BITS - 6)).selectExpr("cast(id as int) as word", "0L as bits")
    words = marks.unionAll(blank).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    whole = words.agg(F.sort_array(F.collect_list(F.struct("word", "bits")))["bits"].alias("bits"))
    return F.bit_get(F.get(whole.scalar(), word), bit) == 1


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, counts and digest of the base kinds, spans of all kinds, n_spans."""
    findings = scan(docs, ledger, rules, path_col=id_col, text_col=text_col)
    rows = only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("bigint").alias("doc_id"), blob(F.coalesce("text", F.lit(""))).alias("blob"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(_by_blob(findings, rules), ["blob", "salt"], "left")
    spans = F.coalesce("found", F.array().cast("array<struct<start:bigint,o:int,end:bigint,kind:string>>"))
    base = F.filter(spans, lambda s: s["kind"].isin([r.kind for r in BASE]))

    def n(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")

    return joined.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"), F.size(spans).cast("bigint").alias("n_spans"),
    )


def redact(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text", chars_col: str | None = None, path_col: str = "doc_id", mark: str = "<secret>") -> DataFrame:
    """All rows and columns, every found span replaced by ``mark`` (overlapping or touching spans by one).

    ``docs`` is read several times and has to give the same rows each time, as a stored table does."""
    names = docs.columns
    findings = scan(docs, ledger, rules, path_col=path_col, text_col=text_col)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"))
    text = F.col(f"_row.`{text_col}`")
    keyed = rows.withColumn("blob", blob(F.coalesce(text, F.lit(""))))
    may = _may_be_among(findings)
    salted = keyed.filter(may).withColumn("salt", F.pmod(F.xxhash64(F.col(f"_row.`{path_col}`").cast("string")), F.lit(SALTS)).cast("int"))
    joined = salted.join(_by_blob(findings, rules), ["blob", "salt"], "left")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        apart = F.concat(done["out"], text.substr(done["at"].cast("int") + 1, (s["start"] - done["at"]).cast("int")), F.lit(mark))
        fresh = (s["start"] >= done["at"]) & ~((done["at"] == s["start"]) & (done["at"] > 0))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.when(fresh, apart).otherwise(done["out"]).alias("out"))

    edited = F.aggregate("found", start, step, lambda done: F.concat(done["out"], text.substr(done["at"].cast("int") + 1, F.char_length(text))))
    new = F.when(F.col("found").isNull(), text).otherwise(edited)
    replaced = joined.select("_row", new.alias("_new")).unionAll(keyed.filter(~may).select("_row", text.alias("_new")))
    values = {text_col: F.col("_new")} | ({chars_col: F.char_length("_new").cast("bigint")} if chars_col else {})
    return replaced.select(*(values.get(c, F.col(f"_row.`{c}`")).alias(c) for c in names))


def new_ledger(spark: SparkSession, name: str = "ledger") -> str:
    """A fresh ledger below this application's run folder."""
    import uuid

    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
