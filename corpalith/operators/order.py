"""Numbers and predecessors of rows within a group, however many rows the group has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpalith.sources.kept import small, written

#: ``monotonically_increasing_id`` has the partition above these bits and the row below them.
ROW_BITS = 33


def numbered(rows: DataFrame, group: str, order: list[str], before: str | None = None) -> DataFrame:
    """``rows`` with ``nth``, from 1, in their group's order, and with ``before``, if it names a column, the value of that column one row earlier.

    Rows are dealt by ranges of group and order. Numbers and predecessors come from a row's own range; where a
    range begins inside a group, its counts and last value are taken from the ranges before it. There are no
    more of these than ranges and groups together. Rows that are equal in group and order may come either way;
    a null group is one group.
    """
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    dealt = written(dealt.withColumn("__at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("__part", F.shiftrightunsigned("__at", ROW_BITS))
    last = F.max_by(F.struct(before), "__at") if before else F.lit(None)
    ranges = dealt.groupBy(F.col("__part").alias("__p"), F.col(group).alias("__g")).agg(F.min("__at").alias("__low"), F.count("*").alias("__n"), last.alias("__last"))
    line = Window.partitionBy("__g").orderBy("__p")
    offset = F.sum("__n").over(line) - F.col("__n") - F.col("__low")
    ranges = written(ranges.select("__p", "__g", "__low", offset.alias("__offset"), F.lag("__last").over(line).alias("__ago")))
    placed = dealt.join(small(ranges, ranges.count(), 256), (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g")))
    out = [*rows.columns, (F.col("__at") + F.col("__offset") + 1).alias("nth")]
    if before:
        own = F.lag(before).over(Window.partitionBy("__part", group).orderBy("__at"))
        out.append(F.when(F.col("__at") > F.col("__low"), own).otherwise(F.col("__ago")[before]).alias("before"))
    return placed.select(*out)
