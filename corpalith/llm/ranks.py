"""Positions of rows in an order, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpalith.llm.common import hot_join, small, stored

#: ``monotonically_increasing_id`` has the partition above these bits and the row below them.
ROW_BITS = 33


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, from 0, in their group's order, and ``total``, the group's rows.

    ``rows`` must be a written table, as it is read twice; its column ``group`` has no nulls, and
    rows that are equal in group and order can't be told apart. Rows are dealt by ranges of group and
    order; a range knows its place among its own rows, and the ranges' counts, of which there are no
    more than ranges and groups together, give where each begins. A hot group is just many ranges.
    """
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    dealt = stored(dealt.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("at", ROW_BITS)
    starts = dealt.groupBy(part.alias("s_part"), F.col(group).alias("s_group")).agg(F.min("at").alias("low"), F.count("*").alias("n"))
    own = Window.partitionBy("s_group")
    offset = F.sum("n").over(own.orderBy("s_part")) - F.col("n") - F.col("low")
    starts = stored(starts.select("s_part", "s_group", offset.alias("offset"), F.sum("n").over(own).alias("total")))
    placed = hot_join(dealt.withColumn("part", part), small(starts, starts.count(), 128), [("part", "s_part"), (group, "s_group")])
    return placed.select(*rows.columns, (F.col("at") + F.col("offset")).alias("pos"), "total")


def one_by_one(rows: DataFrame, times: str, step: int = 4096) -> DataFrame:
    """``rows`` as often as ``times`` says, with a ``copy`` from 0; a row with very many copies is dealt out before it is written out."""
    last = F.col(times) - 1
    begun = rows.withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(step).cast("long"))))
    begun = begun.repartition(*(c for c in begun.columns))
    return begun.withColumn("copy", F.explode(F.sequence(F.col("begin"), F.least(F.col("begin") + step - 1, last)))).drop("begin")
