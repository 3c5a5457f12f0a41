"""Activity buckets, call rates, and names of repositories for the charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Chart ranges as hours and bucket unit, and the call limits per minute.
RANGES = {"1d": (24, "hour"), "7d": (168, "day"), "14d": (336, "day"), "30d": (720, "day")}
LIMIT_VALIDATE = 10
LIMIT_DEFAULT = 100
MINUTE_US = 60_000_000


def buckets(tasks: DataFrame, keys: list[str], as_of: Column, hours: int, unit: str) -> DataFrame:
    """Total, completed and failed tasks per key and hour or day before ``as_of``, zeros included.

    A first day that the range only covers in part has no bucket.
    """
    step = F.expr("interval 1 hour" if unit == "hour" else "interval 1 day")
    count = hours if unit == "hour" else hours // 24
    end = F.date_trunc(unit, as_of).cast("timestamp_ntz")
    back = F.make_dt_interval(F.lit(0), F.lit(count - 1)) if unit == "hour" else F.make_dt_interval(F.lit(count - 1))
    cutoff = as_of - F.make_dt_interval(F.lit(0), F.lit(hours))
    counted = (
        tasks.filter((F.col("created_at") >= cutoff) & (F.col("created_at") < end + step))
        .withColumn("bucket", F.date_trunc(unit, F.col("created_at")).cast("timestamp_ntz"))
        .groupBy(*keys, "bucket")
        .agg(
            F.count("*").alias("total"),
            F.count_if(F.col("status") == "completed").alias("completed"),
            F.count_if(F.col("status") == "failed").alias("failed"),
        )
    )
    spine = tasks.select(*keys).distinct().withColumn("bucket", F.explode(F.sequence(end - back, end, step)))
    joined = spine.join(counted, [*keys, "bucket"], "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("total", "completed", "failed")})


def repository_names(configured: DataFrame, used: DataFrame) -> DataFrame:
    """Names of both lists without repeats: the configured list first, then the other.

    Inputs hold ``name`` and ``pos``, the position in their list.
    """
    both = configured.select("name", "pos", F.lit(0).alias("list_no")).union(
        used.select("name", "pos", F.lit(1).alias("list_no"))
    )
    first = F.min(F.struct("list_no", "pos")).alias("_first")
    return both.filter(F.coalesce("name", F.lit("")) != "").groupBy("name").agg(first).select("name", "_first.*")


def rolling_calls(calls: DataFrame, limit: int) -> DataFrame:
    """Calls ``(caller, ts)`` of the last 60 seconds at every call time, flagged above ``limit``.

    Calls at the same microsecond are counted together first. Each count is then sent to its own
    minute and, as history, to the next one, so a busy caller is spread over its minutes and no
    window reaches over more than two. A limit of zero or less means unlimited.
    """
    us = F.unix_micros(F.to_timestamp_ltz("ts")) if dict(calls.dtypes)["ts"] == "timestamp" else F.expr(
        "unix_micros(cast(ts as timestamp))"
    )
    counted = (
        calls.groupBy("caller", "ts")
        .agg(F.count("*").alias("calls"))
        .withColumn("_us", us)
        .withColumn("_minute", F.floor(F.col("_us") / MINUTE_US))
    )
    spread = counted.withColumn("_own", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "_slot", F.col("_minute") + F.col("_own")
    )
    w = Window.partitionBy("caller", "_slot").orderBy("_us").rangeBetween(-(MINUTE_US - 1), 0)
    rolled = spread.withColumn("last_minute", F.sum("calls").over(w)).filter("_own = 0")
    over = F.lit(False) if limit <= 0 else F.col("last_minute") > limit
    return rolled.select("caller", "ts", "calls", "last_minute", over.alias("over_limit"))


def calls_per_minute(calls: DataFrame, limit: int) -> DataFrame:
    """Calls per caller and whole minute, flagged above ``limit``."""
    return (
        calls.groupBy("caller", F.window("ts", "1 minute").alias("w"))
        .agg(F.count("*").alias("calls"))
        .select("caller", F.col("w.start").alias("minute"), "calls", (F.col("calls") > limit).alias("over_limit"))
    )
