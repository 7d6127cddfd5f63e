"""Innermost interval around each point, by one sort and a running stack."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkscope.operators.lineage import small_batches

#: Points of one task, about, and sampled points for each border between tasks.
POINTS, SAMPLES = 1 << 20, 32


class Open:
    """Intervals that have begun, the innermost last; those that are over leave when they come up."""

    def __init__(self) -> None:
        self.stack: list[tuple] = []

    def begin(self, end, label) -> None:
        self.stack.append((end, label))

    def around(self, at):
        """Label of the innermost interval around a place that no earlier one follows, or None."""
        while self.stack and self.stack[-1][0] <= at:
            self.stack.pop()
        return self.stack[-1][1] if self.stack else None


def around_all(places: list[int], intervals: list[tuple]) -> Iterator:
    """For each of the places, which ascend, the label of the innermost interval (start, end, label)."""
    waiting, now = sorted(intervals, key=lambda x: (x[0], -x[1])), Open()
    i = 0
    for at in places:
        while i < len(waiting) and waiting[i][0] <= at:
            now.begin(waiting[i][1], waiting[i][2])
            i += 1
        yield now.around(at)


def innermost(points: DataFrame, intervals: DataFrame, group: str, at: str, points_per_task: int = POINTS) -> DataFrame:
    """points with the label of the innermost interval (group, start, end, label) around each, null where there is none.

    An interval holds start and not end, so an empty one holds nothing; the innermost is that of the greatest start, then
    the least end, then the least label; intervals may overlap in any way.  A null group, place, start or end matches nothing.
    A group of very many points is cut by place: its intervals go to each task whose places they reach.
    """
    spark = points.sparkSession
    small_batches(spark)
    where = lambda df, c: df.where(F.col(group).isNotNull() & F.col(c).isNotNull())
    n = points.count()
    parts = max(1, -(-n // points_per_task), min(spark.sparkContext.defaultParallelism, n // 4096))
    key = lambda c: [F.col(group).cast("string").alias("_group"), F.col(c).cast("long").alias("_at")]
    borders = []
    if parts > 1:
        drawn = F.shiftrightunsigned(F.xxhash64(F.col(group).cast("string"), F.col(at).cast("long")), 11) < int((1 << 53) * min(1.0, SAMPLES * parts / n))
        sample = sorted(tuple(r) for r in where(points, at).where(drawn).select(*key(at)).collect())
        borders = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    shared = spark.sparkContext.broadcast(borders)

    @F.pandas_udf("int")
    def part(groups: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(shared.value, x) for x in zip(groups, places, strict=True)], dtype="int32")

    label = intervals.schema["label"]
    columns = points.columns
    typed = {c.name: c.dataType.simpleString() for c in points.schema}
    placed = where(points, at).select(*columns, *key(at), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_end"), F.lit(None).cast(label.dataType).alias("_label")).withColumn("_part", part("_group", "_at"))
    spans = where(intervals, "start").where(F.col("end") > F.col("start")).select(*key("start"), F.lit(0).alias("_kind"), F.col("end").cast("long").alias("_end"), F.col("label").alias("_label"))
    spans = spans.withColumn("_part", F.explode(F.sequence(part("_group", "_at"), part("_group", F.col("_end") - 1))))
    spans = spans.select(*[F.lit(None).cast(typed[c]).alias(c) for c in columns], *placed.columns[len(columns) :])
    rows = spans.unionByName(placed).repartitionById(len(borders) + 1, "_part").sortWithinPartitions("_part", "_group", "_at", "_kind", F.desc("_end"), F.desc("_label"))

    def run(batches):
        last, now = None, Open()
        for batch in batches:
            take, labels = [], []
            of = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()  # noqa: B023, E731
            for i, (g, place, kind, end, name) in enumerate(zip(of("_group"), of("_at"), of("_kind"), of("_end"), of("_label"), strict=True)):
                if g != last:
                    last, now = g, Open()
                if kind:
                    take.append(i)
                    labels.append(now.around(place))
                else:
                    now.begin(end, name)
            if take:
                here = batch.take(pa.array(take))
                yield pa.RecordBatch.from_arrays([*here.columns[: len(columns)], pa.array(labels, batch.schema.field("_label").type)], names=[*columns, "label"])

    found = rows.mapInArrow(run, T.StructType([*points.schema.fields, T.StructField("label", label.dataType)]))
    rest = points.where(F.col(group).isNull() | F.col(at).isNull()).withColumn("label", F.lit(None).cast(label.dataType))
    return found.unionByName(rest)
