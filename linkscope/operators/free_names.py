"""Distinct names in turn: a name that is taken gets the least number, from 2, that makes it free.

Whoever bears `a_2` from the start is in the way of the second `a` only if it came before, and loses its name to that one
if it came after; it then becomes `a_2_2`.  So a name is contended only by those who bear it and by those who bear
it without its last number, and all is settled from names without such a bearer downwards.

For one name: those that need a number come in turn, and the number goes up only.  Of the numbers that others bear, in
order, one is passed over if its bearer came before the turn that reaches it.  With r of those in need before the bearer of k, and s
numbers passed over so far, that is s < k - 1 - r.

That is for groups of any size.  Most are small: their rows are sorted by Spark and a task gives out the names one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkscope.operators.lineage import cut
from linkscope.operators.ordering import numbered, within
from linkscope.operators.parts import gathered

#: Most rows of a group whose names one task gives out.
MOST = 1 << 16


def passed_over(bearers: DataFrame, name: list[str]) -> DataFrame:
    """(name, turn) of the numbers that are passed over, at the turn, from 0, of those in need that comes after; bearers: name, k, room (k - 1 - r)."""

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, s = None, 0
        for frame in frames:
            keep, turns = [], []
            for i, (*key, k, room) in enumerate(frame[[*name, "k", "room"]].itertuples(index=False, name=None)):
                if key != last:
                    last, s = key, 0
                if s < room:
                    s += 1
                    keep.append(i)
                    turns.append(k - s - 1)
            yield frame.iloc[keep][name].assign(turn=pd.Series(turns, dtype="int64").to_numpy())

    ordered = bearers.repartition(*name).sortWithinPartitions(*name, "k")
    return ordered.mapInPandas(walk, bearers.select(*name, F.lit(0).cast("long").alias("turn")).schema)


def numbers_of(need: DataFrame, bearers: DataFrame, name: list[str]) -> DataFrame:
    """need (name, at) with the number that each gets; bearers: name, k, at of the first that bears the name with _k behind it."""
    both = need.select(*name, "at", F.lit(None).cast("long").alias("k")).unionByName(bearers.select(*name, "at", "k"))
    came = within(both, name, ["at"], "n").where("k is not null")
    came = within(came, name, ["at"], "earlier").select(*name, "k", (F.col("k") - 1 - (F.col("n") - F.col("earlier"))).alias("room"))
    gaps = passed_over(came, name).select(*name, "turn", F.lit(0).alias("who"), F.lit(None).cast("long").alias("at"))
    turns = within(need, name, ["at"], "turn").select(*name, "turn", F.lit(1).alias("who"), "at")
    # a number is the place among those in need and the numbers passed over
    return within(gaps.unionByName(turns), name, ["turn", "who"], "number").where("who = 1").select(*name, "at", (F.col("number") + 2).alias("number"))


def by_contention(rows: DataFrame, group: str, stem: str, ending: str, order: list[str]) -> DataFrame:
    """free_names of groups of any size.

    Rows of a name that nobody bears with a number behind it need one pass; each further number behind a name takes a few jobs.
    A name's rows never meet in one task; of the numbers that others bear behind one name, two numbers each go through one.
    """
    name = [group, stem, ending]
    all_rows = cut(numbered(rows, [group, *order], "at"))
    first = cut(all_rows.groupBy(*name).agg(F.min("at").alias("first")))
    behind = F.regexp_extract(stem, r"(?s)^(.*)_([1-9][0-9]{0,17})$", 2)
    split = first.where(behind != "").withColumn("k", behind.cast("long")).where("k > 1").withColumn("parent", F.regexp_extract(stem, r"(?s)^(.*)_([1-9][0-9]{0,17})$", 1))
    # those whose name others may get: bearers of the same name without the number exist
    known = first.select(group, F.col(stem).alias("parent"), ending)
    born = cut(split.join(known, [group, "parent", ending], "left_semi"))
    here = first.join(born.select(*name), name, "left_anti").withColumn("lost", F.lit(False))
    out = None
    while True:
        mine = cut(all_rows.join(here, name).withColumn("keeps", (F.col("at") == F.col("first")) & ~F.col("lost")))
        below = cut(born.join(here.select(group, F.col(stem).alias("parent"), ending), [group, "parent", ending], "left_semi"))
        need, none_below = mine.where(~F.col("keeps")).select(*name, "at"), below.isEmpty()
        if none_below:
            numbers = within(need, name, ["at"], "number").select(*name, "at", (F.col("number") + 2).alias("number"))
        else:
            bearers = below.select(group, F.col("parent").alias(stem), ending, "k", F.col("first").alias("at"))
            numbers = cut(numbers_of(need, bearers, name))
        done = mine.where("keeps").select("at", F.lit(None).cast("long").alias("number")).unionByName(numbers.select("at", "number"))
        out = done if out is None else out.unionByName(done)
        if none_below:
            break
        got = numbers.select(group, F.col(stem).alias("parent"), ending, F.col("number").alias("k"), F.col("at").alias("got"))
        here = cut(below.join(got, [group, "parent", ending, "k"], "left").select(*name, "first", F.coalesce(F.col("got") < F.col("first"), F.lit(False)).alias("lost")))
    return all_rows.join(out, "at").drop("at")


def in_turn_of(rows: DataFrame, group: str, stem: str, ending: str, order: list[str]) -> DataFrame:
    """free_names of groups that a task can hold the names of."""
    names = rows.columns

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, taken, least = None, set(), {}
        for batch in batches:
            numbers, of = [], batch.column(names.index(group))
            begins = [True, *pc.not_equal(of[1:], of[:-1]).to_pylist()] if len(of) else []
            if begins and of[0].as_py() == last:
                begins[0] = False
            for new, s, e in zip(begins, *(batch.column(names.index(c)).to_pylist() for c in (stem, ending)), strict=True):
                if new:
                    taken, least = set(), {}
                name, number = s, None
                if (s, e) in taken:
                    # a name that is taken stays so, thus the number goes up only
                    number = least.get((s, e), 2)
                    while (name := f"{s}_{number}", e) in taken:
                        number += 1
                    least[s, e] = number + 1
                taken.add((name, e))
                numbers.append(number)
            last = of[-1].as_py() if begins else last
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=[*names, "number"])

    schema = T.StructType([*rows.schema.fields, T.StructField("number", T.LongType())])
    # by the hash first, as beginnings of names tell little apart
    return gathered(rows, group).sortWithinPartitions(F.xxhash64(group), group, *order).mapInArrow(walk, schema)


def free_names(rows: DataFrame, group: str, stem: str, ending: str, order: list[str]) -> DataFrame:
    """rows with one more column, number: null for those that keep stem and ending as their name, else what goes, as _number, between them.

    Names are distinct within a group; rows take theirs in the given order, ties in any.  Group, stem and ending may not be
    null.  Groups of more than MOST rows go the way of by_contention, so no task holds one.
    """
    # groups whose hashes are equal are counted as one, which is more than either has
    of = F.xxhash64(group).alias("_of")
    large = cut(rows.select(of).groupBy("_of").count().where(F.col("count") > MOST).select("_of"))
    if large.isEmpty():
        return in_turn_of(rows, group, stem, ending, order)
    there = F.xxhash64(rows[group]) == large["_of"]
    small = in_turn_of(rows.join(large, there, "left_anti"), group, stem, ending, order)
    return small.unionByName(by_contention(rows.join(large, there, "left_semi"), group, stem, ending, order))
