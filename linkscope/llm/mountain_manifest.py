"""Merkle manifest of a table: a mountain range of digests for each range of rows, merged to one root, with proofs.

Each row is a leaf, the digest of its columns; leaves of a group stand in order of their key and every FANOUT
neighbours have one parent, the last run of a level as many as there are.  The roots of the groups are the leaves
of one more tree of the same kind, whose root stands for the whole table.

Rows are cut into ranges of at most about ROWS leaves.  A task goes through its range with a stack that has one
unfinished run for each level: a run that fills up is folded into its parent and carried on to the next level, as
digits carry in a number of base FANOUT.  What no run inside the range can take up is a completed peak and
leaves the task; at the ends of a range these are fewer than FANOUT a level and side, so only they are shuffled.  They
are merged level by level to the runs that several ranges share, short last runs included: nothing is padded.
A second pass gives every range the shared runs above it and folds each leaf's way to the root.

Defined cases: a null in a column is `-`, any other value its length in bytes, a colon and the value; a null group
is a group of its own and the first; null keys come first in their group; rows of equal group and key stand in order of
their leaves, and equal rows are a leaf each; a group of one leaf has that leaf as its root; an empty table has
no nodes and no proofs; texts are hashed whole; columns of other names take no part.  Tampering: see proofs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkscope.llm.common import cut, small_batches

FANOUT, BITS = 8, 3
#: Columns of a document in the order in which they enter its leaf.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves of a range, about; a task holds some 200 bytes for each.
ROWS = 1 << 18
#: Bytes of a digest written in hexadecimal, as it enters a parent's digest.
WIDE = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hashed(*columns: Column) -> Column:
    """Digest of the columns: `-` for a null, else length in bytes, colon and value."""
    written = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return F.unhex(F.sha2(F.concat(*[written(c.cast("string")) for c in columns]), 256))


def parent(run: bytes) -> bytes:
    """Digest of a run of digests in hexadecimal, in hexadecimal."""
    return sha256(run).hexdigest().encode()


def count_at(total: int, level: int) -> int:
    """Nodes of a level over so many leaves."""
    return (total - 1 >> BITS * level) + 1


class Range:
    """The mountains of one group in one range of leaves: unfinished runs, one for each level.

    emit gets (level, place, digest, is_peak, is_root); a node that is a peak is emitted as such once more.
    """

    def __init__(self, start: int, emit) -> None:
        self.runs: list[tuple[int, list[bytes]]] = []
        self.next, self.emit = start, emit

    def add(self, digest: bytes) -> None:
        self._put(0, self.next, digest)
        self.next += 1

    def _put(self, level: int, place: int, digest: bytes) -> None:
        """A node joins the unfinished run of its level; the run's last place carries."""
        if level == len(self.runs):
            self.runs.append((place, []))
        if not self.runs[level][1]:
            self.runs[level] = (place, [])
        self.runs[level][1].append(digest)
        if place % FANOUT == FANOUT - 1:
            self._close(level)

    def _close(self, level: int) -> None:
        """The run of a level has its last node: fold it into the parent, or let its nodes go as peaks if its first ones lie in another range."""
        first, run = self.runs[level]
        self.runs[level] = (0, [])
        if first % FANOUT:
            self._peaks(level, first, run)
        else:
            made = parent(b"".join(run))
            self.emit(level + 1, first >> BITS, made, False, False)
            self._put(level + 1, first >> BITS, made)

    def _peaks(self, level: int, first: int, run: list[bytes]) -> None:
        for i, digest in enumerate(run):
            self.emit(level, first + i, digest, True, False)

    def end(self, total: int) -> None:
        """The range has no more leaves of the group, which has so many in all: short last runs close here, others go as peaks."""
        last, level = self.next == total, 0
        while level < len(self.runs):
            first, run = self.runs[level]
            if run and last and count_at(total, level) == 1:
                self.emit(level, 0, run[0], False, True)
            elif run and last:
                self._close(level)
            elif run:
                self._peaks(level, first, run)
            level += 1


@dataclass
class Spans:
    """By range: the place of its first leaf in that leaf's group, and the leaves of its first and its last group in all ranges."""

    start: list[int]
    first: list[int]
    last: list[int]

    @staticmethod
    def of(ends: list) -> Spans:
        """ends: (part, first (grp, n), last (grp, n)) of the ranges that hold rows."""
        parts = max((e.part for e in ends), default=-1) + 1
        start, first, last, total, run = [0] * parts, [0] * parts, [0] * parts, {}, None
        for e in sorted(ends, key=lambda e: e.part):
            start[e.part] = total[run] if run is not None and run == (e.first.grp,) else 0
            for g in {(e.first.grp,): e.first.n, (e.last.grp,): e.last.n}.items():
                total[g[0]] = total.get(g[0], 0) + g[1]
            run = (e.last.grp,)
        for e in ends:
            first[e.part], last[e.part] = total[(e.first.grp,)], total[(e.last.grp,)]
        return Spans(start, first, last)

    def of_group(self, part: int, is_first: bool, is_last: bool, n: int) -> tuple[int, int]:
        """Place of the first leaf and number of leaves of a group that has n leaves in the range."""
        return self.start[part] if is_first else 0, self.first[part] if is_first else self.last[part] if is_last else n


@dataclass
class Forest:
    """Trees over ordered leaves (part, grp, key, digest, other, salt): their nodes, shared runs and roots."""

    leaves: DataFrame
    parts: int
    spans: Spans
    nodes: DataFrame  # grp, level, place, digest of all nodes above the leaves
    shared: DataFrame  # grp, level, place, run, low, high: children of the runs that ranges low to high share
    roots: DataFrame  # grp, digest


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str | None, list[bytes], bool]]:
    """Runs of one group in a range's leaves: (part, group, digests in hexadecimal, whether the group's run ends here); long runs come in pieces."""
    held: list = []
    for batch in batches:
        parts, grps, digests = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("part", "grp", "digest"))
        for row in zip(parts, grps, digests, strict=True):
            if held and (row[1] != held[0][1] or len(held) == 4096):
                yield held[0][0], held[0][1], [d.hex().encode() for _, _, d in held], row[1] != held[0][1]
                held = []
            held.append(row)
    if held:
        yield held[0][0], held[0][1], [d.hex().encode() for _, _, d in held], True


NODE = "grp string, level int, place long, digest binary, is_peak boolean, is_root boolean, part int, total long"


def raised(leaves: DataFrame, spans: Spans) -> DataFrame:
    """The nodes that each range can complete by itself, its peaks and the roots of groups that lie in it."""
    shared = leaves.sparkSession.sparkContext.broadcast(spans)
    schema = pa.schema([("grp", pa.string()), ("level", pa.int32()), ("place", pa.int64()), ("digest", pa.binary()), ("is_peak", pa.bool_()), ("is_root", pa.bool_()), ("part", pa.int32()), ("total", pa.int64())])

    def run(batches):
        spans, out, mountains, n, seen = shared.value, [], None, 0, 0
        pieces = groups(batches)
        piece = next(pieces, None)
        while piece is not None:
            part, grp, digests, over = piece
            piece = next(pieces, None)
            if mountains is None:
                # a range's first group may have begun in an earlier one
                mountains, n, first = Range(spans.of_group(part, seen == 0, False, 0)[0], lambda *x: out.append(x)), 0, seen == 0
                seen += 1
            for d in digests:
                mountains.add(d)
            n += len(digests)
            # peaks before a group's end are at the left edge of the range, so of its first group
            total = spans.first[part] if first else 0
            if over:
                total = spans.of_group(part, first, piece is None, n)[1]
                mountains.end(total)
                mountains = None
            if over or len(out) > 4096:
                if out:
                    levels, places, made, peaks, roots = zip(*out, strict=True)
                    size = len(out)
                    yield pa.RecordBatch.from_arrays([pa.array([grp] * size, pa.string()), pa.array(levels, pa.int32()), pa.array(places, pa.int64()), pa.array([bytes.fromhex(d.decode()) for d in made], pa.binary()), pa.array(peaks), pa.array(roots), pa.array([part] * size, pa.int32()), pa.array([total] * size, pa.int64())], schema=schema)
                out.clear()

    return leaves.select("part", "grp", "digest").mapInArrow(run, NODE)


def forest(leaves: DataFrame, rows: int = ROWS) -> Forest:
    """The trees of leaves (grp, key, digest, other), which should be cut, as they are read several times.

    The driver holds a few numbers for each range, never leaves or nodes.
    """
    spark = leaves.sparkSession
    n = leaves.count()
    parts = max(-(-n // rows), min(spark.sparkContext.defaultParallelism, n // 1024), 1)
    order = ["grp", "key", "digest", "salt"]
    # equal rows are interchangeable; a number keeps a very often repeated one from filling a range
    numbered = leaves.withColumn("salt", F.monotonically_increasing_id())
    ordered = cut(numbered.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    counted = ordered.groupBy("part", "grp").agg(F.count("*").alias("n"))
    spans = Spans.of(counted.groupBy("part").agg(F.min(F.struct("grp", "n")).alias("first"), F.max(F.struct("grp", "n")).alias("last")).collect())
    own = cut(raised(ordered, spans))
    roots, nodes, levels = own.where("is_root").select("grp", "digest"), own.where("not is_peak and not is_root").select("grp", "level", "place", "digest"), []
    peaks = own.where("is_peak").select("grp", "level", "place", "digest", F.col("part").alias("low"), F.col("part").alias("high"), "total")
    # a group's leaves stand in the spans only, where its peaks have gone to several ranges
    top = max([0, *spans.first, *spans.last])
    carried = None
    for level in range(0, 64 // BITS + 1) if not peaks.isEmpty() else ():
        if count_at(top, level) == 1:
            break
        here = peaks.where(F.col("level") == level)
        here = here if carried is None else here.unionByName(carried)
        place, up = F.shiftright("place", BITS), F.lit(level + 1)
        run = F.sort_array(F.collect_list(F.struct("place", "digest")))
        met = here.groupBy("grp", place.alias("place")).agg(F.transform(run, lambda x: x["digest"]).alias("run"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("total").alias("total"))
        made = cut(met.withColumn("level", up).withColumn("digest", F.unhex(F.sha2(F.array_join(F.transform("run", lambda d: F.lower(F.hex(d))), ""), 256))))
        levels.append(made)
        last = F.shiftright(F.col("total") - 1, BITS * (level + 1)) == 0
        roots = roots.unionByName(made.where(last).select("grp", "digest"))
        carried = made.where(~last).select("grp", "level", "place", "digest", "low", "high", "total")
    shared = spark.createDataFrame([], "grp string, level int, place long, run array<binary>, low int, high int")
    for made in levels:
        shared = shared.unionByName(made.select("grp", F.col("level") - 1, "place", "run", "low", "high").toDF(*shared.columns))
        nodes = nodes.unionByName(made.select(*nodes.columns))
    # as many ranges as hold rows, whatever number was asked for
    return Forest(ordered, max(1, len(spans.start)), spans, nodes, shared, cut(roots))


class Ways:
    """The ways from the leaves of one group in one range to the root: for each level what stands left and right of the node in its run."""

    def __init__(self, start: int, leaves: list[bytes], total: int, shared: dict, upper: list[tuple[bytes, bytes]]) -> None:
        self.total, self.shared = total, shared
        self.above = (b"".join(a + b for a, b in upper), upper)
        self.levels = [(start, b"".join(leaves))]
        while count_at(total, level := len(self.levels) - 1) > 1:
            base, row = self.levels[level]
            end, r, made = base + len(row) // WIDE, -(-base // FANOUT), []
            first = r
            while r * FANOUT < end and (stop := min((r + 1) * FANOUT, count_at(total, level))) <= end:
                made.append(parent(row[(r * FANOUT - base) * WIDE : (stop - base) * WIDE]))
                r += 1
            self.levels.append((first, b"".join(made)))
        self.last: list = [(-1, None)] * len(self.levels)

    def step(self, level: int, place: int) -> tuple[bytes, bytes]:
        r = place >> BITS
        run = self.shared.get((level, r))
        if run is None:
            base, row = self.levels[level]
            run = row[(r * FANOUT - base) * WIDE : ((r + 1) * FANOUT - base) * WIDE]
        at = (place - r * FANOUT) * WIDE
        return run[:at], run[at + WIDE :]

    def way(self, level: int, place: int) -> tuple[bytes, list[tuple[bytes, bytes]]]:
        """All siblings in one, and (left, right) of each level; neighbours share what is above them."""
        if level == len(self.levels) - 1:
            return self.above
        known, found = self.last[level]
        if known != place:
            left, right = self.step(level, place)
            proof, steps = self.way(level + 1, place >> BITS)
            found = left + right + proof, [(left, right), *steps]
            self.last[level] = place, found
        return found


STEPS = "array<struct<left:binary,right:binary>>"
RESULT = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def walked(trees: Forest, above: DataFrame | None, fold: bool) -> DataFrame:
    """A row for each leaf: grp, key and its way (fold: the digests of RESULT instead).

    above: grp, subroot, root and steps of each group, which is small as it has a row for each group; none: no tree stands above.
    Each range's leaves meet the shared runs above them and the rows of above in one task, by the number of the range.
    """
    spark = trees.leaves.sparkSession
    small_batches(spark)
    empty = {"key": f"cast(null as {trees.leaves.schema['key'].dataType.simpleString()})", "salt": "cast(null as long)", "level": "cast(null as int)", "place": "cast(null as long)", "digest": "cast(null as binary)", "other": "cast(null as binary)", "run": "cast(null as array<binary>)", "subroot": "cast(null as binary)", "root": "cast(null as binary)", "steps": f"cast(null as {STEPS})"}
    full = lambda df, kind: df.select("part", F.lit(kind).alias("kind"), "grp", *[F.col(c) if c in df.columns else F.expr(e).alias(c) for c, e in empty.items()])
    rows = full(trees.shared.withColumn("part", F.explode(F.sequence("low", "high"))), 0)
    if above is not None:
        here = trees.leaves.select("part", "grp").distinct().withColumnRenamed("grp", "of")
        rows = rows.unionByName(full(here.join(above, F.col("of").eqNullSafe(F.col("grp"))).drop("of"), 1))
    rows = rows.unionByName(full(trees.leaves, 2))
    rows = rows.repartitionById(trees.parts, "part").sortWithinPartitions("part", "kind", "grp", "key", "digest", "salt")
    spans = spark.sparkContext.broadcast(trees.spans)
    key = trees.leaves.schema["key"]
    schema = f"grp string, key {key.dataType.simpleString()}, " + (RESULT if fold else f"steps {STEPS}")

    def run(batches):
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.Table.from_batches(tables)
        kinds, grps = (table.column(c).to_pylist() for c in ("kind", "grp"))
        part, n_shared = table.column("part")[0].as_py(), sum(k < 2 for k in kinds)
        shared, uppers = {}, {}
        for r in table.slice(0, n_shared).to_pylist():
            if r["kind"] == 0:
                shared.setdefault(r["grp"], {})[r["level"], r["place"]] = b"".join(d.hex().encode() for d in r["run"])
            else:
                uppers[r["grp"]] = (r["subroot"].hex(), r["root"].hex(), [(s["left"], s["right"]) for s in r["steps"]])
        at = n_shared
        while at < len(kinds):
            grp, end = grps[at], at
            while end < len(kinds) and grps[end] == grp:
                end += 1
            own = table.slice(at, end - at)
            subroot, root, upper = uppers.get(grp, (None, None, []))
            start, total = spans.value.of_group(part, at == n_shared, end == len(kinds), end - at)
            leaves = [d.hex().encode() for d in own.column("digest").to_pylist()]
            ways = Ways(start, leaves, total, shared.get(grp, {}), upper)
            for low in range(0, len(leaves), 1024):
                piece = own.slice(low, 1024)
                same = [pa.array([grp] * piece.num_rows, pa.string()), piece.column("key").combine_chunks()]
                found = [ways.way(0, start + low + i) for i in range(piece.num_rows)]
                if not fold:
                    made = [pa.array([[{"left": a, "right": b} for a, b in steps] for _, steps in found], pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())])))]
                    yield pa.RecordBatch.from_arrays([*same, *made], names=["grp", "key", "steps"])
                    continue
                folded = []
                for leaf, other, (_, steps) in zip(leaves[low : low + 1024], piece.column("other").to_pylist(), found, strict=True):
                    up = leaf if other is None else other.hex().encode()
                    for left, right in steps:
                        up = parent(left + up + right)
                    folded.append(up.decode())
                made = [[x.decode() for x in leaves[low : low + 1024]], [subroot] * len(folded), [root] * len(folded), [sha256(p).hexdigest() for p, _ in found], folded]
                yield pa.RecordBatch.from_arrays([*same, *[pa.array(m, pa.string()) for m in made], pa.array([f == root for f in folded])], names=["grp", "key", *[f.split()[0] for f in RESULT.split(", ")]])
            at = end

    return rows.mapInArrow(run, schema)


def leaves_of(docs: DataFrame, key: str, group: str, columns: list[str], text: str) -> DataFrame:
    """grp, key, digest, and other: the leaf of the tampered row where there is one."""
    low = F.translate(F.col(text), UPPER, LOWER)
    tampered = F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 0
    as_is = hashed(*[F.col(c) for c in columns])
    other = F.when(tampered, hashed(*[low if c == text else F.col(c) for c in columns]))
    return docs.select(F.col(group).cast("string").alias("grp"), F.col(key).alias("key"), as_is.alias("digest"), other.alias("other"))


def trees_of(docs: DataFrame, key: str, group: str, columns: list[str], text: str, rows: int) -> tuple[Forest, Forest]:
    """The trees of the groups, and the one over their roots."""
    own = forest(cut(leaves_of(docs, key, group, columns, text)), rows)
    tops = own.roots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), "digest", F.lit(None).cast("binary").alias("other"))
    return own, forest(tops, rows)


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", columns: tuple[str, ...] = COLUMNS, text: str = "text", rows: int = ROWS) -> DataFrame:
    """Every node above the leaves: tree (group or table), grp, level, place and digest; the table's tree has the groups' roots as leaves."""
    own, top = trees_of(docs, key, group, list(columns), text, rows)
    hexed = lambda f, tree, grp: f.nodes.select(F.lit(tree).alias("tree"), grp.alias("grp"), "level", "place", F.lower(F.hex("digest")).alias("digest"))
    return hexed(own, "group", F.col("grp")).unionByName(hexed(top, "table", F.lit(None).cast("string")))


def proofs(docs: DataFrame, key: str = "doc_id", group: str = "lang", columns: tuple[str, ...] = COLUMNS, text: str = "text", rows: int = ROWS) -> DataFrame:
    """A row for each row of docs: key, leaf, roots, the digest of its siblings, and whether its way still leads to the root after tampering.

    Rows whose key's crc32 is divisible by 3 are tampered with: the letters A-Z of their text become a-z.
    """
    own, top = trees_of(docs, key, group, list(columns), text, rows)
    root = top.roots.first()
    steps = walked(top, None, False).select(F.col("key").alias("grp"), "steps")
    # a row for each group
    above = own.roots.select(F.col("grp").alias("of"), F.col("digest").alias("subroot")).join(steps, F.col("of").eqNullSafe(F.col("grp"))).drop("of").withColumn("root", F.lit(root and bytes(root.digest)).cast("binary"))
    out = walked(own, cut(above), True)
    return out.select(F.col("key").alias(key), *[f.split()[0] for f in RESULT.split(", ")])
