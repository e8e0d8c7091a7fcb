"""Keyed dedupe and row numbers that do not put a hot key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest `order` per key.

    An aggregate, not a window: copies of a hot key collapse before the shuffle. Ties beyond
    `order` are settled by the remaining columns, so the survivor does not depend on row order.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    ranked = list(order) + [c for c in rest if c not in order]
    ranked = [c for c in ranked if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max(F.struct(*ranked)).alias("_last"))
        .select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in df.columns]))


def blocked_row_number(
    df: DataFrame,
    partition: Sequence[str],
    order: Sequence[str],
    block: Column,
    out: str,
) -> DataFrame:
    """`row_number` over (partition by `partition` order by `order`), counted block by block.

    `block` must not decrease along `order`. Only the block counts of a partition meet in one
    task; its rows are numbered inside their own block.
    """
    keys = list(partition)
    marked = df.withColumn("_block", block)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (
        marked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    return (
        marked.join(offsets, [*keys, "_block"])
        .withColumn(out, F.row_number().over(inside) + F.col("_offset"))
        .drop("_block", "_offset"))
