"""Positions in large ordered groups without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blocked_row_number(df: DataFrame, group, block, order, name: str = "position") -> DataFrame:
    """1-based position within ``group``, ordered by the ``block`` columns and then ``order``.

    Blocks are bounded sub-ranges of the group's order.  Rows are numbered inside
    their block; block sizes, one small row each, give the offset.
    """
    group, block = list(group), list(block)
    keys = [*group, *block]
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*group).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, keys)
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_before", "_inside")
    )


def blocked_carry(df: DataFrame, group, position: str, values: dict[str, Column], span: int = 65536) -> DataFrame:
    """For each row the last non-null value before it in its group, for several values.

    The group is cut into spans of ``position``; the last value of each earlier span
    is carried by a window over span summaries only.
    """
    group = list(group)
    named = df.withColumn("_span", F.floor(F.col(position) / span))
    for name, value in values.items():
        named = named.withColumn(name, value)
    keys = [*group, "_span"]
    summary = named.groupBy(*keys).agg(
        *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col(position))).alias(f"_last_{n}") for n in values]
    )
    earlier = Window.partitionBy(*group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *keys, *[F.last(f"_last_{n}", ignorenulls=True).over(earlier).alias(f"_carried_{n}") for n in values]
    )
    inside = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    with_local = named.select(
        *[c for c in named.columns if c not in values],
        *[F.last(n, ignorenulls=True).over(inside).alias(f"_local_{n}") for n in values],
    )
    joined = with_local.join(carried, keys)
    for name in values:
        joined = joined.withColumn(name, F.coalesce(F.col(f"_local_{name}"), F.col(f"_carried_{name}")))
    return joined.drop("_span", *[f"_local_{n}" for n in values], *[f"_carried_{n}" for n in values])


def blocked_running_sum(df: DataFrame, group, position: str, value: str, name: str, span: int = 65536) -> DataFrame:
    """Sum of ``value`` over the rows before each row of its group, span by span."""
    group = list(group)
    keys = [*group, "_span"]
    named = df.withColumn("_span", F.floor(F.col(position) / span))
    earlier = Window.partitionBy(*group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        named.groupBy(*keys)
        .agg(F.sum(value).alias("_total"))
        .select(*keys, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return (
        named.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(totals, keys)
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_span", "_before", "_inside")
    )
