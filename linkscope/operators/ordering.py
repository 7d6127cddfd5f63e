"""Numbers and order of all rows, with no task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkscope.operators.lineage import cut

#: Bits that a row's number within its partition takes in monotonically_increasing_id.
WITHIN = 33


def in_turn(rows: DataFrame, order: list[str | Column], into: str) -> DataFrame:
    """rows with a long that grows in the given order but leaves gaps.

    Rows go to ranges of the order and are sorted there; the numbers are written at once, as another
    run may draw other ranges.  Rows that tie get different numbers, in any order.
    """
    return cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(into, F.monotonically_increasing_id()))


def numbered(rows: DataFrame, order: list[str | Column], into: str) -> DataFrame:
    """rows with their place in the given order, from 0 and without gaps; nulls are least, as in orderBy.

    One row for each range, thus as many as there are partitions, is summed up and broadcast.
    """
    turns = in_turn(rows, order, into)
    part, before = "_part", "_before"
    while part in rows.columns or before in rows.columns:
        part, before = part + "_", before + "_"
    placed = turns.withColumn(part, F.shiftright(into, WITHIN))
    sums = placed.groupBy(part).agg(F.count("*").alias(before))
    # ranges in their order: what all ranges before hold
    sums = sums.select(part, (F.sum(before).over(Window.orderBy(part)) - F.col(before)).alias(before))
    within = F.col(into).bitwiseAND(F.lit((1 << WITHIN) - 1))
    return placed.join(F.broadcast(sums), part).withColumn(into, F.col(before) + within).drop(part, before)


def within(rows: DataFrame, keys: list[str], order: list[str | Column], into: str) -> DataFrame:
    """rows with their place, from 0, among those of equal keys; no task needs to hold a group, and keys may not be null."""
    least = into + "_"
    while least in rows.columns:
        least += "_"
    placed = cut(numbered(rows, [*keys, *order], into))
    starts = placed.groupBy(*keys).agg(F.min(into).alias(least))
    return placed.join(starts, keys).withColumn(into, F.col(into) - F.col(least)).drop(least)
