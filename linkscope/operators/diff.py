"""Snapshot differences in four layers: call sites, symbols, files and metrics.

The counts of the greedy matching inside a group have a closed form, so no group is ever
gathered: with o and n rows on the two sides, u pairs of equal (line, args) and a pairs of equal args,
u are unchanged, a - u moved, min(o, n) - a changed and the rest removed or added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkscope.operators import matching

KEY = ["file", "caller", "symbol"]
ORDER = {"added": 0, "removed": 1, "changed": 2, "moved": 3, "unchanged": 4}


def _sides(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.withColumn("o", F.lit(1)).withColumn("n", F.lit(0)).unionByName(new.withColumn("o", F.lit(0)).withColumn("n", F.lit(1)))


def call_sites(old: DataFrame, new: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Status and counts of every group of call sites; both sides have the key, line and args."""
    key_columns = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in key]
    both = _sides(old.select(*key_columns, "line", "args"), new.select(*key_columns, "line", "args"))
    line = both.groupBy(*key, "args", F.coalesce("line", F.lit(0)).alias("line")).agg(F.sum("o").alias("o"), F.sum("n").alias("n"))
    args = line.groupBy(*key, "args").agg(F.sum("o").alias("o"), F.sum("n").alias("n"), F.sum(F.least("o", "n")).alias("u"))
    group = args.groupBy(*key).agg(F.sum("o").alias("old_count"), F.sum("n").alias("new_count"), F.sum("u").alias("u"), F.sum(F.least("o", "n")).alias("a"))
    o, n, u, a = (F.col(c) for c in ("old_count", "new_count", "u", "a"))
    status = F.when(o == 0, "added").when(n == 0, "removed").when((u == o) & (u == n), "unchanged").when((a == o) & (a == n), "moved").otherwise("changed")
    return group.select(*key, status.alias("status"), "old_count", "new_count", u.alias("n_unchanged"), (a - u).alias("n_moved"), (F.least(o, n) - a).alias("n_changed"), F.greatest(o - n, F.lit(0)).alias("n_removed"), F.greatest(n - o, F.lit(0)).alias("n_added"))


def symbols(old: DataFrame, new: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Calls of each symbol on both sides, and its status."""
    key = [*(by or []), "symbol"]
    n = _sides(old.select(*key), new.select(*key)).groupBy(*key).agg(F.sum("o").alias("old_calls"), F.sum("n").alias("new_calls"))
    return n.withColumn("status", counted_status("old_calls", "new_calls"))


def counted_status(old: str, new: str):
    o, n = F.col(old), F.col(new)
    return F.when(o == 0, "added").when(n == 0, "removed").when(o == n, "unchanged").otherwise("changed")


def files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Calls of each file on both sides, the symbols it gained and lost, and its status."""
    pair = _sides(old.select("file", "symbol"), new.select("file", "symbol")).groupBy("file", "symbol").agg(F.sum("o").alias("o"), F.sum("n").alias("n"))
    n = pair.groupBy("file").agg(F.sum("o").alias("old_calls"), F.sum("n").alias("new_calls"), F.count_if(F.col("o") == 0).alias("n_added_symbols"), F.count_if(F.col("n") == 0).alias("n_removed_symbols"))
    moved = (F.col("n_added_symbols") > 0) | (F.col("n_removed_symbols") > 0)
    status = counted_status("old_calls", "new_calls")
    return n.withColumn("status", F.when((status == "unchanged") & moved, "changed").otherwise(status))


def metrics(old: DataFrame, new: DataFrame, by: list[str] | None = None, scanned: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Calls, files, symbols and categories of both sides, and the differences.

    by: a project column, where the same file of two projects counts twice; scanned: one number of each side, n_scanned,
    that is not counted from calls.
    """
    one = lambda d: d.agg(F.count("*").alias("calls"), F.countDistinct(*(by or []), "file").alias("files"), F.countDistinct("symbol").alias("symbols"))
    long = lambda d, v: d.unpivot([], d.columns, "metric", v)
    sides = [one(old), one(new)]
    if scanned is not None:
        sides = [side.crossJoin(n.select(F.col("n_scanned").alias("scanned"))) for side, n in zip(sides, scanned, strict=True)]
    return long(sides[0], "old_value").join(long(sides[1], "new_value"), "metric").withColumn("delta", F.col("new_value") - F.col("old_value"))


def pairs(old: DataFrame, new: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Which old call became which new one: equal (line, args) first, then equal args by the nearest line, equal line, nearest line.

    A null line counts as 0 and null args as empty.  Counts equal those of call_sites.
    """
    return pairs_of(_sides(old.select(*key, "line", "args"), new.select(*key, "line", "args")), key)


def pairs_of(sides: DataFrame, key: list[str] = KEY) -> DataFrame:
    """pairs() of rows of both sides, with o and n: 1 and 0 for an old row, 0 and 1 for a new one."""
    key_columns = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in key]
    rows = sides.select(*key_columns, F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("args", F.lit("")).alias("args"), "o", "n")
    return matching.pairs(rows.groupBy(*key, "args", "line").agg(F.sum("o").alias("o"), F.sum("n").alias("n")), key)


def _first(value: str, of_new: str = "n") -> Column:
    """Value of the first new row in order of line and args, of the first old one where none is new."""
    first = lambda c: F.min(F.when(F.col(c) > 0, F.struct("line", "args", value)))[value]
    return F.coalesce(first(of_new), first("o"), F.lit(""))


def call_site_details(old: DataFrame, new: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Lines on both sides, in order, and the category of every group of call sites; both sides have a category too."""
    key_columns = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in key]
    side = lambda d: d.select(*key_columns, F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("args", F.lit("")).alias("args"), "category")
    both = _sides(side(old), side(new))
    lines = lambda c: F.array_sort(F.collect_list(F.when(F.col(c) > 0, F.col("line"))))
    return both.groupBy(*key).agg(lines("o").alias("old_lines"), lines("n").alias("new_lines"), _first("category").alias("category"))


def symbol_categories(old: DataFrame, new: DataFrame) -> DataFrame:
    """symbols() with the category, the new side's before the old one's."""
    side = lambda d: d.select("symbol", F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("args", F.lit("")).alias("args"), "category")
    n = _sides(side(old), side(new)).groupBy("symbol").agg(F.sum("o").alias("old_calls"), F.sum("n").alias("new_calls"), _first("category").alias("category"))
    return n.withColumn("status", counted_status("old_calls", "new_calls"))


def file_symbols(old: DataFrame, new: DataFrame, by: list[str] | None = None) -> DataFrame:
    """files() with the number of symbols on both sides and the names that came and went, in order; by: a project column."""
    key = [*(by or []), "file"]
    pair = _sides(old.select(*key, "symbol"), new.select(*key, "symbol")).groupBy(*key, "symbol").agg(F.sum("o").alias("o"), F.sum("n").alias("n"))
    names = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) == 0, F.col("symbol"))))
    n = pair.groupBy(*key).agg(F.sum("o").alias("old_calls"), F.sum("n").alias("new_calls"), F.count_if(F.col("o") > 0).alias("old_symbols"), F.count_if(F.col("n") > 0).alias("new_symbols"), names("o").alias("added_symbols"), names("n").alias("removed_symbols"))
    moved = (F.size("added_symbols") > 0) | (F.size("removed_symbols") > 0)
    status = counted_status("old_calls", "new_calls")
    return n.withColumn("status", F.when((status == "unchanged") & moved, "changed").otherwise(status))


def category_metrics(old: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct symbols of each category on both sides, and the difference."""
    n = _sides(old.select("category", "symbol"), new.select("category", "symbol")).groupBy("category", "symbol").agg(F.max("o").alias("o"), F.max("n").alias("n"))
    return n.groupBy("category").agg(F.sum("o").alias("old_symbols"), F.sum("n").alias("new_symbols")).withColumn("delta", F.col("new_symbols") - F.col("old_symbols"))


def is_empty(*layers: DataFrame) -> bool:
    """Whether no layer has a row of another status than unchanged."""
    return all(layer.where("status <> 'unchanged'").isEmpty() for layer in layers)


def in_order(rows: DataFrame, *columns: str | Column) -> DataFrame:
    """Rows in order of status, then of the given columns."""
    place = F.element_at(F.create_map(*[F.lit(x) for pair in ORDER.items() for x in pair]), F.col("status"))
    return rows.orderBy(F.coalesce(place, F.lit(99)), *columns)
