"""Greedy partners on a line: which old row of a group became which new one.

Four phases over each group's rows in order of line and args: equal line and args; equal args, nearest line; equal
line; nearest line.  Each old row in turn takes the nearest new one that is left, the earlier one of two as near.
Equal rows are interchangeable, so groups hold counts.  The first phase is a difference of counts; the second works
inside one (key, args), so a key with very many rows is dealt by its args first; what is left of a key meets for the last two.
Both go once through rows that Spark has sorted, in time in proportion to their number.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkscope.operators.parts import gathered

Row = tuple[int, str, int]


def nearest(olds: list[Row], news: list[Row]) -> Iterator[tuple[int, str, int, str, int]]:
    """(old line, old args, new line, new args, times); both sides are (line, args, times) in order.

    As old rows come in order, the new ones left of them form a stack and those right of them a queue, so the
    nearest one is at one of two ends.
    """
    queue: deque = deque()
    for line, args, n in news:
        if not queue or queue[-1][0] != line:
            queue.append((line, deque()))
        queue[-1][1].append([args, n])
    stack: list = []
    for line, args, n in olds:
        while n:
            while queue and queue[0][0] <= line:
                stack.append(queue.popleft())
            if not stack and not queue:
                return
            left = bool(stack) and (not queue or line - stack[-1][0] <= queue[0][0] - line)
            at, rows = stack[-1] if left else queue[0]
            k = min(n, rows[0][1])
            yield line, args, at, rows[0][0], k
            n, rows[0][1] = n - k, rows[0][1] - k
            if not rows[0][1]:
                rows.popleft()
            if not rows:
                stack.pop() if left else queue.popleft()


def side_by_side(olds: list[Row], news: list[Row]) -> Iterator[tuple[int, str, int, str, int]]:
    """Partners of equal line, in order of their args."""
    by_line: dict[int, deque] = {}
    for line, args, n in news:
        by_line.setdefault(line, deque()).append([args, n])
    for line, args, n in olds:
        rows = by_line.get(line)
        while n and rows:
            k = min(n, rows[0][1])
            yield line, args, line, rows[0][0], k
            n, rows[0][1] = n - k, rows[0][1] - k
            if not rows[0][1]:
                rows.popleft()


def without(rows: list[Row], taken: dict[tuple[int, str], int]) -> list[Row]:
    """The rows less what has found a partner."""
    return [(line, args, n - k) for line, args, n in rows if n > (k := taken.get((line, args), 0))]


def phase(olds: list[Row], news: list[Row], pairs: list) -> tuple[list[Row], list[Row]]:
    """Both sides less the pairs."""
    of: tuple[dict, dict] = {}, {}
    for line, args, at, other, k in pairs:
        of[0][line, args] = of[0].get((line, args), 0) + k
        of[1][at, other] = of[1].get((at, other), 0) + k
    return without(olds, of[0]), without(news, of[1])


def partners(rows: DataFrame, key: list[str], by_args: bool, phases: list) -> DataFrame:
    """rows with partners for those that are left, within equal keys, and equal args too if by_args.

    rows: key, old and new line and args (null on the side that a row is not of), status (left: no partner yet) and times.
    What has a partner goes through, spread evenly, as reading rows a second time would match all of it again.
    phases: functions of both sides with the status of what they pair; the last one pairs whatever it is given.
    """
    names = rows.columns
    args = F.coalesce("old_args", "new_args")
    by = [*key, args] if by_args else key
    to = F.when(F.col("status") == "left", F.xxhash64(*by)).otherwise(F.xxhash64(*names))

    def matched(out: list, own: tuple, olds: list[Row], news: list[Row]) -> None:
        if olds and news:
            for status, pair in phases:
                found = list(pair(olds, news)) if olds and news else []
                if found:
                    olds, news = phase(olds, news, found)
                out += [(*own, line, args, at, other, status, k) for line, args, at, other, k in found]
        out += [(*own, line, args, None, None, "left", n) for line, args, n in olds]
        out += [(*own, None, None, line, args, "left", n) for line, args, n in news]

    def at_once(batch: pa.RecordBatch, begins: np.ndarray) -> tuple[list[pa.RecordBatch], pa.Array]:
        """What becomes of groups of one side, and of one row on each side as often, and a mask of the other rows; the first and the last group may go on in other batches."""
        start = np.flatnonzero(begins)
        size = np.diff(np.append(start, len(begins)))
        is_old, times = batch.column("old_line").is_valid().to_numpy(zero_copy_only=False), batch.column("times").to_numpy()
        olds, inside = np.add.reduceat(is_old.astype("int64"), start), np.ones(len(start), bool)
        inside[[0, -1]] = False
        alone = inside & ((olds == 0) | (olds == size))
        two = inside & (size == 2) & (olds == 1)
        two[two] = times[start[two]] == times[start[two] + 1]
        s = start[two]
        old, new = pa.array(np.where(is_old[s], s, s + 1)), pa.array(np.where(is_old[s], s + 1, s))
        of = {**{c: batch.column(c).take(new if c in ("new_line", "new_args") else old) for c in (*key, "old_line", "old_args", "new_line", "new_args", "times")}, "status": pa.array([phases[-1][0]] * len(s), pa.string())}
        done = [batch.filter(pa.array(np.repeat(alone, size))), pa.RecordBatch.from_arrays([of[c] for c in names], schema=batch.schema)]
        return done, pa.array(np.repeat(~alone & ~two, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, own, last, sides, schema = [], None, None, ([], []), None
        for batch in batches:
            schema, left = batch.schema, pc.equal(batch.column("status"), "left")
            yield batch.filter(pc.invert(left))
            batch = batch.filter(left)
            if not batch.num_rows:
                continue
            line, args = (pc.coalesce(batch.column(f"old_{c}"), batch.column(f"new_{c}")) for c in ("line", "args"))
            group = [*(batch.column(k) for k in key), *([args] if by_args else [])]
            begins = np.append(True, reduce(pc.or_, (pc.not_equal(c[1:], c[:-1]) for c in group)).to_numpy(zero_copy_only=False))
            done, hard = at_once(batch, begins)
            yield from done
            begins[0] = tuple(c[0].as_py() for c in group) != last
            last = tuple(c[-1].as_py() for c in group)
            batch, line, args, begins = (x.filter(hard) for x in (batch, line, args, pa.array(begins)))
            owns = zip(*(batch.column(k).to_pylist() for k in key), strict=True)
            for new, now, *row, is_old in zip(begins.to_pylist(), owns, line.to_pylist(), args.to_pylist(), batch.column("times").to_pylist(), batch.column("old_line").is_valid().to_pylist(), strict=True):
                if new:
                    if own is not None:
                        matched(out, own, *sides)
                    own, sides = now, ([], [])
                    if len(out) > 4096:
                        yield made(out, schema)
                        out = []
                sides[not is_old].append(row)
        if own is not None:
            matched(out, own, *sides)
        if out:
            yield made(out, schema)

    def made(out, schema):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    there = gathered(rows.withColumn("_to", to), "_to").sortWithinPartitions("_to", *by, F.coalesce("old_line", "new_line"), args)
    return there.drop("_to").mapInArrow(run, rows.schema)


def pairs(counted: DataFrame, key: list[str]) -> DataFrame:
    """Pairs and rows without a partner of counted: key (strings, not null), args, line, and the old (o) and new (n) rows that are equal in these."""
    out = ["old_line", "old_args", "new_line", "new_args", "status"]
    here = [F.col("line").alias("old_line"), F.col("args").alias("old_args"), F.col("line").alias("new_line"), F.col("args").alias("new_args")]
    same = counted.where("least(o, n) > 0").select(*key, *here, F.lit("unchanged").alias("status"), F.least("o", "n").cast("long").alias("times"))
    one_side = [F.when(F.col("o") > F.col("n") if side == "old" else F.col("o") < F.col("n"), F.col(c)).alias(f"{side}_{c}") for side in ("old", "new") for c in ("line", "args")]
    rest = counted.where("o <> n").select(*key, *one_side, F.lit("left").alias("status"), F.abs(F.col("o") - F.col("n")).cast("long").alias("times"))
    moved = partners(rest, key, True, [("moved", nearest)])
    changed = partners(moved, key, False, [("changed", side_by_side), ("changed", nearest)])
    changed = changed.withColumn("status", F.when(F.col("status") != "left", F.col("status")).when(F.col("old_line").isNull(), "added").otherwise("removed"))
    return same.unionByName(changed).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(*key, *out)
