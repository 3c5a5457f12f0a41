"""Ordered numbering and running sums inside groups, safe for very large groups.

A window over a group runs in one task. ``bucket`` is an expression that never decreases along ``order``:
rows are windowed per group and bucket, and the totals of the earlier buckets are added. Those totals
are combined before the shuffle, one short row per group and bucket, so a group of any size is spread over
as many tasks as it has buckets. Group and bucket are one key of window and join, so the rows are shuffled once.

Where groups are small as a rule, ``split_above`` leaves the buckets to those of more rows: the others are windowed by
their own keys, which the next step by the same keys need not shuffle again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulelens.session import stored

#: Rows of a group that one task may number.
GROUP_ROWS = 100_000


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, value: Column, name: str, split_above: int | None = None
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows before this one in its group.

    ``order`` must be total within a group. Null keys and buckets are groups and buckets of their own. With ``split_above``
    the groups are counted first, and those of at most as many rows are not cut into buckets.
    """
    if split_above is not None:
        counted = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > split_above)
        large = stored(counted.select(*[F.col(c).alias(f"_of_{c}") for c in keys]), "large-groups")
        if large.isEmpty():
            return _whole_groups(df, keys, order, value, name)
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys])
        rest = _whole_groups(df.join(large, same, "left_anti"), keys, order, value, name)
        return rest.unionByName(running_sum(df.join(large, same, "left_semi"), keys, order, bucket, value, name))
    # structs with null fields are equal if all their fields are
    marked = df.withColumn("_value", value).withColumn("_of", F.struct(*keys, bucket.alias("_bucket")))
    local = _whole_groups(marked, ["_of"], order, F.col("_value"), "_local")
    totals = marked.groupBy(F.col("_of").alias("_by")).agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*[f"_by.{c}" for c in keys]).orderBy("_by._bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_by", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    return (
        local.join(offsets, F.col("_of") == F.col("_by"))
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_value", "_of", "_by", "_local", "_offset")
    )


def _whole_groups(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, name: str) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))


def number_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    name: str,
    split_above: int | None = None,
) -> DataFrame:
    """Add ``name``: the 0-based position of the row in its group."""
    return running_sum(df, keys, order, bucket, F.lit(1).cast("bigint"), name, split_above)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key: the one with the highest ``order`` columns (last one breaks ties).

    A maximum with map-side combine, so the size of a group does not matter.
    """
    best = F.max_by(F.struct(*columns), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*")
