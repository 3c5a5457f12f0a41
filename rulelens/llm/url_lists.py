"""Temporal list join: which list entries were active when a page was fetched. DataFrame functions only.

Dated entries (list, allows, kind, value, action add or remove, dated) become validity intervals [added, removed).
Every capture asks for all domain suffixes of its host and all path prefixes of its address, and an as-of
join finds the entries that were active on its fetch date. Of all active entries the one with the
longest value decides; among equally long ones a blocking entry wins. A capture without any is kept.

How it runs: captures are reduced to distinct (address, date) before they are exploded. Intervals are cut at
month ends, so the join has the equal keys (value, month) and a host with a third of all captures is spread over
its months, and over ``SALTS`` shares besides. Entries of one value are reduced to one row a day before the window
over them, so that its size is bounded by the calendar. Nothing is broadcast by hint.

Defined results: a null address or date matches nothing and is kept. A value added and removed on one day is not active;
repeated additions change nothing. Entries with null values or dates are ignored. Repeated rows and null ids are kept. An empty list
keeps all. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulelens.llm.common import only

SALTS = 8
DOMAIN, PREFIX = "domain", "prefix"


def address(url: Column) -> Column:
    """host/path in lower-case host, without scheme, user, port, query, fragment and closing slashes."""
    rest = F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    plain = F.regexp_replace(rest, "[?#].*$", "")
    host = F.regexp_extract(plain, "^(?:[^/]*@)?([^/:]*)", 1)
    path = F.regexp_extract(plain, "^[^/]*(/.*)$", 1)
    return F.concat(F.lower(F.regexp_replace(host, "\\.+$", "")), F.regexp_replace(path, "/+$", ""))


def _candidates(where: Column) -> Column:
    """(kind, value) of every entry that could match an address."""
    parts = F.split(where, "/", -1)
    labels = F.split(parts[0], "\\.", -1)
    suffixes = F.transform(labels, lambda _, i: F.struct(F.lit(DOMAIN).alias("kind"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".").alias("value")))
    prefixes = F.transform(parts, lambda _, i: F.struct(F.lit(PREFIX).alias("kind"), F.array_join(F.slice(parts, F.lit(1), i + 1), "/").alias("value")))
    return F.array_distinct(F.concat(suffixes, prefixes))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, allows, kind, value, since, until): when each value was on each list; until is null while it is."""
    key = ["list", "allows", "kind", "value"]
    daily = (
        entries.filter("value is not null and dated is not null")
        .groupBy(*key, "dated")
        .agg(F.max((F.col("action") == "remove").cast("int")).alias("removed"))
    )
    order = Window.partitionBy(*key).orderBy("dated")
    changes = daily.withColumn("before", F.lag("removed").over(order)).filter("before is null or before <> removed")
    bounded = changes.withColumn("until", F.lead("dated").over(order))
    return bounded.filter("removed = 0").select(*key, F.col("dated").alias("since"), "until")


def _month(day: Column) -> Column:
    return (F.year(day) * 12 + F.month(day) - 1).cast("int")


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", date_col: str = "fetched") -> DataFrame:
    """Per capture: page_id, url, fetched, n_active (active entries), lists (their lists' names), decided_by (value), kept."""
    source = only(captures, page_id=id_col, url=url_col, fetched=date_col)
    asked = source.filter("url is not null and fetched is not null").groupBy("url", "fetched").agg(F.lit(1).alias("_")).withColumn("place", address(F.col("url")))
    single = asked.select("url", "fetched", F.inline(_candidates(F.col("place")))).withColumns(
        {"month": _month(F.col("fetched")), "salt": F.pmod(F.hash("url", "fetched"), F.lit(SALTS))}
    )
    low, high = (F.lit(day) for day in source.agg(F.min("fetched"), F.max("fetched")).first())  # open ends reach to the last capture
    first, last = F.greatest("since", low), F.least(F.coalesce("until", high), high)
    monthly = (
        intervals(entries).filter(first <= last)
        .withColumn("month", F.explode(F.sequence(_month(first), _month(last))))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    active = single.join(monthly, ["kind", "value", "month", "salt"]).filter("fetched >= since and (until is null or fetched < until)")
    best = F.max(F.struct(F.char_length("value").alias("n"), (~F.col("allows")).alias("blocks"), F.col("value").alias("value")))
    verdicts = active.groupBy("url", "fetched").agg(F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), best.alias("best"))
    spread = verdicts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = source.withColumn("salt", F.pmod(F.hash("page_id"), F.lit(SALTS)))
    return rows.join(spread, ["url", "fetched", "salt"], "left").select(
        "page_id", "url", "fetched",
        F.coalesce("n_active", F.lit(0)).cast("bigint").alias("n_active"),
        F.coalesce("lists", F.lit("")).alias("lists"),
        F.coalesce("best.value", F.lit("")).alias("decided_by"),
        (~F.coalesce("best.blocks", F.lit(False))).alias("kept"),
    )


#: Entries for the query, drawn from the hosts of the pages themselves by their MD5. The same text runs in Spark and, with
#: the macros of the oracle, in DuckDB.
ENTRY_RULES = (
    # list, allows, kind, value, chosen if, action, days after 2024-01-01
    ("spam", False, DOMAIN, "host", "n % 3 = 0", "add", "n % 200"),
    ("spam", False, DOMAIN, "host", "n % 6 = 0", "remove", "n % 200 + 20 + n % 90"),
    ("spam", False, DOMAIN, "host", "n % 12 = 0", "add", "n % 200 + 60 + n % 90"),
    ("adult", False, DOMAIN, "parent", "n % 97 = 0", "add", "n % 300"),
    ("adult", False, DOMAIN, "parent", "n % 194 = 0", "remove", "n % 300 + 10"),
    ("trusted", True, PREFIX, "section", "n % 4 = 0", "add", "n % 150"),
    ("trusted", True, PREFIX, "section", "n % 8 = 0", "remove", "n % 150 + 100"),
    ("broken", False, PREFIX, "section", "n % 7 = 0", "add", "n % 250"),
)


def entries_of(pages: DataFrame) -> DataFrame:
    """Dated list entries about the hosts of ``pages`` (page_id, url, fetched)."""
    parts = F.split("place", "/", -1)
    places = pages.filter("url is not null").select(address(F.col("url")).alias("place"))
    named = places.select(
        parts[0].alias("host"),
        F.regexp_replace(parts[0], "^[^.]*\\.", "").alias("parent"),
        F.array_join(F.slice(parts, 1, 2), "/").alias("section"),
    ).distinct()
    numbered = named.withColumn("n", F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("int"))
    rules = [
        F.when(F.expr(chosen), F.struct(F.lit(name).alias("list"), F.lit(allows).alias("allows"), F.lit(kind).alias("kind"), F.col(value).alias("value"), F.lit(action).alias("action"), F.expr(f"date_add(date'2024-01-01', {days})").alias("dated")))
        for name, allows, kind, value, chosen, action, days in ENTRY_RULES
    ]
    return numbered.select(F.explode(F.array(*rules)).alias("e")).filter("e is not null").select("e.*").distinct()
