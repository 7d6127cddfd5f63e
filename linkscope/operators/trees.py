"""Dependency trees of executables: which library pulls in which, how deep, and by what chain.

A tree's size is bounded by the libraries of one machine, so each root's own edges form one group.  What roots pull in
is mostly the same: the files that most roots need are held by every task, and what else is below a file is found once
for each file that any root needs directly, packed as one text, and joined to those roots.  A task sees a root's whole
tree, so what is asked of it is told on the spot and no tree is exchanged.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkscope.operators.lineage import counted, cut, small_batches
from linkscope.operators.summary import descendants

#: Levels that are followed.
DEPTH = 20
TREE = "root string, position int, name string, parent string, depth int, chain string, error string"
# Why a node of a tree has nothing below it.
CIRCULAR, TOO_DEEP, MISSING = "circular dependency", "max depth exceeded", "library not found"


def walk(root: str, follow: dict[str, list[str]], known: set[str], most: int = DEPTH, held: tuple = ({}, frozenset())):
    """Nodes in depth-first order: (name, parent, depth, chain, error); whatever was met before, on any path, is a leaf.

    held has what follow and known lack.
    """
    met: set[str] = set()
    waiting = [(root, None, 0, root)]
    more, there = held[:2]
    while waiting:
        name, parent, depth, chain = waiting.pop()
        error = CIRCULAR if name in met else TOO_DEEP if depth > most else MISSING if name not in known and name not in there else None
        yield name, parent, depth, chain, error
        if error is None:
            met.add(name)
            needs = follow.get(name) or more.get(name)
            if needs:
                waiting += [(child, name, depth + 1, f"{chain} -> {child}") for child in reversed(needs)]


#: Files that roots need directly in one task of walks, about; a walk takes time, not bytes, so its tasks are not joined to fewer.
STARTS = 1 << 16
#: Between a packed file's names, between files, before a file's marks, and what replaces any of these in a name; rows of a batch of trees.
NAME, FILE, MARKS, ESCAPE, ROWS = "\0", "\1", "\3", "\2", 1 << 14
#: Most files that every task holds and bytes of their packs, and files from which they are chosen; the choice moves bytes, not results.
HELD, HELD_BYTES, ASKED = 1 << 18, 16 << 20, 1 << 18
#: Names that a task remembers as told.
TOLD = 1 << 18


def packed(name: Column) -> Column:
    for mark, sign in ((ESCAPE, "c"), (NAME, "a"), (FILE, "b"), (MARKS, "d")):
        name = F.replace(name, F.lit(mark), F.lit(ESCAPE + sign))
    return name


def unpacked(name: str) -> str:
    for mark, sign in ((MARKS, "d"), (FILE, "b"), (NAME, "a"), (ESCAPE, "c")):
        name = name.replace(ESCAPE + sign, mark)
    return name


def needs_of(pack: Column) -> Column:
    """What a file's pack says that it needs, in order."""
    names = F.split(F.substring_index(pack, MARKS, 1), NAME)

    def plain(name: Column) -> Column:
        for mark, sign in ((MARKS, "d"), (FILE, "b"), (NAME, "a"), (ESCAPE, "c")):
            name = F.replace(name, F.lit(ESCAPE + sign), F.lit(mark))
        return name

    return F.transform(F.slice(names, F.lit(2), F.size(names)), plain)


def learn(pack: str, follow: dict[str, list[str]], known: set[str], marks: dict[str, list[str | None]] | None = None) -> None:
    """Adds a pack's files: a sign, + for one that exists, with the name, then the names of what it needs, in order, then its marks."""
    escaped = ESCAPE in pack
    for file in pack.split(FILE):
        file, _, said = file.partition(MARKS)
        names = file.split(NAME)
        if escaped:
            names = [unpacked(x) for x in names]
        name = names[0][1:]
        if name not in follow:
            follow[name] = names[1:]
            if names[0][0] == "+":
                known.add(name)
            if said and marks is not None:
                marks[name] = [(unpacked(x[1:]) if escaped else x[1:]) if x[0] == "+" else None for x in said.split(NAME)]


def trees(edges: DataFrame, roots: DataFrame, files: DataFrame, most: int = DEPTH) -> DataFrame:
    """Trees of all roots (node): edges (src, dst, position among those of src) as text; files (path) are those that exist."""
    return told(edges, roots, files, whole, TREE, most)


def packs_of(edges: DataFrame, roots: DataFrame, files: DataFrame, marks: DataFrame | None) -> DataFrame:
    """Each file and root with its pack, from one exchange: src, pack, is_root, and is_met for what any file needs."""
    text = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "position").where("src is not null and dst is not null")
    need = F.struct(F.col("position").isNull().alias("last"), "position", "dst")
    sides = [text.select("src", need.alias("need")), text.select(F.col("dst").alias("src"), F.lit(True).alias("is_met")), roots.select(F.col("node").cast("string").alias("src"), F.lit(True).alias("is_root"))]
    sides.append(files.select(F.col("path").cast("string").alias("src"), F.lit("+").alias("sign")).where("src is not null"))
    if marks is not None:
        sides.append(marks.select(F.col("name").cast("string").alias("src"), F.coalesce(F.concat(F.lit("+"), packed(F.col("mark").cast("string"))), F.lit("-")).alias("mark")).where("src is not null"))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides)
    g = rows.groupBy("src").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list("need")), lambda x: x["dst"])).alias("needs"), F.max("sign").alias("sign"), *[F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("is_met", "is_root")], *([] if marks is None else [F.array_sort(F.collect_set("mark")).alias("marks")]))
    pack = F.concat_ws(NAME, F.concat(F.coalesce("sign", F.lit("-")), packed(F.col("src"))), F.transform("needs", packed))
    if marks is not None:
        pack = F.when(F.size("marks") > 0, F.concat(pack, F.lit(MARKS), F.array_join("marks", NAME))).otherwise(pack)
    return g.select("src", F.when(F.col("src").isNotNull(), pack).alias("pack"), "is_root", "is_met")


def closed(packs: list[str]) -> list[str]:
    """Those of the packs of single files whose needs, and all below, are among them."""
    follow: dict[str, list[str]] = {}
    where = {}
    for pack in packs:
        n = len(follow)
        learn(pack, follow, set())
        if len(follow) > n:
            where[next(reversed(follow))] = pack
    above, lost = defaultdict(list), []
    for name, needs in follow.items():
        if any(x not in follow for x in needs):
            lost.append(name)
        for x in needs:
            above[x].append(name)
    while lost:
        name = lost.pop()
        if where.pop(name, None) is not None:
            lost += above[name]
    return list(where.values())


def told(edges: DataFrame, roots: DataFrame, files: DataFrame, tell: Callable, kind: str, most: int = DEPTH, marks: DataFrame | None = None) -> DataFrame:
    """What tell makes of each root's tree, as rows of this kind: tell(root, nodes in order, marks of a name, what the task remembers); marks: name, mark."""
    spark = edges.sparkSession
    own = cut(packs_of(edges, roots, files, marks))
    start = own.where("is_root").select(F.col("src").alias("root"), "pack")
    direct = start.select("root", F.explode(needs_of(F.col("pack"))).alias("top"))
    tops = cut(direct.groupBy("top").agg(F.count("*").alias("n")))
    n_tops, n_direct = tops.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_nodes = counted(start)
    # what is below a file that several roots need is found once, unless there are more such files than roots
    if shared := n_tops < n_nodes:
        nodes, n_nodes, inner = tops, n_tops, cut(own.where("is_met").select("src", "pack"))
    else:
        nodes, inner = start.select(F.col("root").alias("top"), F.lit(1).cast("long").alias("n")), own.where("(is_met or is_root) and src is not null").select("src", "pack")
    linked = inner.select("src", F.explode(needs_of(F.col("pack"))).alias("dst"))
    some = n_nodes > ASKED
    asked = cut(nodes.orderBy(F.desc("n"), "top").limit(ASKED)) if some else nodes
    below = descendants(linked, asked.select(F.col("top").alias("node")), most).select(F.col("root").alias("top"), F.col("node").alias("src"))
    # files that most roots need, as far as those asked for tell
    reach = below.join(asked, "top").groupBy("src").agg(F.sum("n").alias("n"))
    first = Window.orderBy(F.desc("n"), "src").rowsBetween(Window.unboundedPreceding, 0)
    chosen = reach.join(inner, "src").orderBy(F.desc("n"), "src").limit(HELD).withColumn("bytes", F.sum(F.octet_length("pack")).over(first)).where(F.col("bytes") <= HELD_BYTES)
    packs = [r.pack for r in cut(chosen.select("pack")).collect()]
    if some:
        # nothing below a held file is looked for again, so all of it has to be held
        packs = closed(packs)
    names: dict[str, list[str]] = {}
    for pack in packs:
        learn(pack, names, set())
    held = spark.createDataFrame(pa.table({"src": pa.array(list(names), pa.string())}))
    if some:
        below = descendants(linked.join(held, "src", "left_anti"), nodes.join(held.withColumnRenamed("src", "top"), "top", "left_anti").select(F.col("top").alias("node")), most).select(F.col("root").alias("top"), F.col("node").alias("src"))
    rest = below.join(held, "src", "left_anti").join(inner, "src").groupBy("top").agg(F.array_join(F.collect_list("pack"), FILE).alias("pack"))
    if shared:
        rows = direct.join(rest, "top").select("root", "pack").unionByName(start)
    else:
        rows = start.select("root").join(rest, F.col("root") == F.col("top"), "left").select("root", "pack")
    small_batches(spark)
    run = teller(tell, kind, most, spark.sparkContext.broadcast(FILE.join(packs)), uuid.uuid4().hex)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_direct // STARTS)
    return rows.repartition(parts, "root").sortWithinPartitions("root").mapInArrow(run, kind)


#: What this process holds for its tasks: the last frame's files, by a token of that frame.
_HELD: dict[str, tuple] = {}


def held_by(token: str, pack: str) -> tuple[dict[str, list[str]], set[str], dict[str, list[str | None]]]:
    if token not in _HELD:
        _HELD.clear()
        found: tuple = ({}, set(), {})
        if pack:
            learn(pack, *found)
        _HELD[token] = found
    return _HELD[token]


def teller(tell: Callable, kind: str, most: int, packs, token: str) -> Callable:
    """The task that walks the trees of its roots; rows: root, pack, sorted by root."""
    names = [c.split()[0] for c in kind.split(", ")]
    types = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        seen: set[str] = set()
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)
        for root, *own in gathered(batches):
            held = held_by(token, packs.value)
            for row in tell(root, walk(root, own[0], own[1], most, held), lambda name: own[2].get(name) or held[2].get(name), seen):  # noqa: B023
                rows.append(row)
                if len(rows) == ROWS:
                    yield batch()
                    rows = []
        if rows:
            yield batch()

    return run


def whole(root, nodes, marks, seen):
    for i, node in enumerate(nodes):
        yield root, i, *node


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, dict[str, list[str]], set[str], dict[str, list[str | None]]]]:
    """Roots, in order, with what their packs say; rows: root, pack, sorted by root."""
    last, found, begun = None, ({}, set(), {}), False
    for batch in batches:
        for root, pack in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if begun and root != last:
                yield last, *found
                found = ({}, set(), {})
            last, begun = root, True
            if pack:
                learn(pack, *found)
    if begun:
        yield last, *found


def first_places(tree: DataFrame) -> DataFrame:
    """All that a root pulls in, each name once with its first parent and depth."""
    found = tree.where(f"error is null or error <> '{CIRCULAR}'")
    return found.groupBy("root", "name").agg(F.min_by("parent", "position").alias("parent"), F.min_by("depth", "position").alias("depth"))


def symbols_by_depth(tree: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct symbols at each depth of each root, root at 0; what is met again does not count; symbols: name, symbol."""
    return tree.where(f"error is null or error <> '{CIRCULAR}'").join(symbols, "name").groupBy("root", "depth").agg(F.countDistinct("symbol").alias("n_symbols"))


def import_chains(tree: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct chains from a root to a file that uses a symbol: root, symbol, chain."""
    return tree.where(f"error is null or error <> '{CIRCULAR}'").join(symbols, "name").select("root", "symbol", "chain").distinct()


def has_library_below(tree: DataFrame, targets: DataFrame) -> DataFrame:
    """Nodes of each root under whose first place a library lies: root, name; targets: name."""
    inside = tree.where(f"error is null or error <> '{CIRCULAR}'")
    goal = inside.join(targets.select("name").distinct(), "name", "left_semi").select("root", F.split("chain", " -> ").alias("c"))
    above = goal.select("root", F.explode(F.slice("c", F.lit(1), F.size("c") - 1)).alias("name"))
    return above.distinct()


def collected(tree: DataFrame) -> DataFrame:
    """Files of all trees, each once."""
    return tree.where("error is null").select(F.col("name").alias("path")).distinct()


# The same of trees that are not kept: told where they are walked, so that no row of a tree is exchanged


def _place(root, nodes, marks, seen):
    met = set()
    for name, parent, depth, _, error in nodes:
        if error != CIRCULAR and name not in met:
            met.add(name)
            yield root, name, parent, depth


def first_places_of(edges: DataFrame, roots: DataFrame, files: DataFrame, most: int = DEPTH) -> DataFrame:
    """first_places of the trees of these."""
    return told(edges, roots, files, _place, "root string, name string, parent string, depth int", most)


def _depths(root, nodes, marks, seen):
    found = {}
    for name, _, depth, _, error in nodes:
        if error != CIRCULAR and (said := marks(name)):
            found.setdefault(depth, set()).update(said)
    for depth, symbols in found.items():
        yield root, depth, len(symbols - {None})


def symbols_by_depth_of(edges: DataFrame, roots: DataFrame, files: DataFrame, symbols: DataFrame, most: int = DEPTH) -> DataFrame:
    """symbols_by_depth of the trees of these."""
    return told(edges, roots, files, _depths, "root string, depth int, n_symbols long", most, symbols.select("name", F.col("symbol").alias("mark")))


def _has_below(root, nodes, marks, seen):
    found = set()
    for name, _, _, chain, error in nodes:
        if error != CIRCULAR and marks(name):
            found.update(chain.split(" -> ")[:-1])
    for name in found:
        yield root, name


def has_library_below_of(edges: DataFrame, roots: DataFrame, files: DataFrame, targets: DataFrame, most: int = DEPTH) -> DataFrame:
    """has_library_below of the trees of these."""
    return told(edges, roots, files, _has_below, "root string, name string", most, targets.select("name", F.lit(None).cast("string").alias("mark")))


def _chains(root, nodes, marks, seen):
    found = {(symbol, chain) for name, _, _, chain, error in nodes if error != CIRCULAR for symbol in marks(name) or ()}
    for symbol, chain in found:
        yield root, symbol, chain


def import_chains_of(edges: DataFrame, roots: DataFrame, files: DataFrame, symbols: DataFrame, most: int = DEPTH) -> DataFrame:
    """import_chains of the trees of these."""
    return told(edges, roots, files, _chains, "root string, symbol string, chain string", most, symbols.select("name", F.col("symbol").alias("mark")))


def _files(root, nodes, marks, seen):
    for name, _, _, _, error in nodes:
        if error is None and name not in seen:
            if len(seen) == TOLD:
                seen.clear()
            seen.add(name)
            yield (name,)


def collected_of(edges: DataFrame, roots: DataFrame, files: DataFrame, most: int = DEPTH) -> DataFrame:
    """collected of the trees of these; a task tells a name again only where it has told very many others since."""
    return told(edges, roots, files, _files, "path string", most).distinct()
