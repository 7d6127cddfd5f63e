"""Prefix trie of conversations by an external mergesort that knows common prefixes.

A conversation is the sequence of the digests of its turns; equal sequences are collapsed first, with their number and
smallest id.  Tasks sort bounded runs of sequences, and each carries the number of turns that it shares
with the one before it in its run (its LCP); only what follows is exchanged.  Borders from a sample of the
sequences cut the order into ranges.  A range's runs are merged by a loser tree whose matches compare LCPs first and turns
only behind them, so turns known to be shared are not looked at again.  The merged stream has for each sequence its LCP with
the one before: nodes of the open path that are deeper are finished and leave the stack with their sums.

Nodes that can have members in several ranges are prefixes of a border.  Their sums of each range are added up and their
subtrees' then put together over the borders' prefixes, of which the driver has few: a border is the
shortest prefix that tells two neighbours of the sample apart.

Defined cases: turns of a conversation stand in order of their number, null first, equal ones in order of their digests;
a null role or text is empty; rows without conv_id belong to no conversation; repeated rows are turns of
their own; an empty table has no nodes, not even a root; texts are digested and counted whole; other columns take
no part.  A conversation is held by one task as its turns' digests and word counts, 20 bytes a turn.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkscope.llm.common import cut, hash_share, small_batches

#: Bytes of a turn's digest.
TURN = 16
#: Sequences and bytes of a sorted run; bytes of sequences in a range, about.
RUN, RUN_BYTES, RANGE_BYTES = 1 << 15, 16 << 20, 64 << 20
#: Sampled sequences for each border, and bytes of the whole sample, about.
SAMPLES, SAMPLE_BYTES = 32, 16 << 20
#: Conversations that share a start, and turns of it at most plus one.
SHARED, HEADS = 20, 4
EMPTY = sha256(b"").hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, seq (digests of the turns in order) and words (of each turn)."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TURN)
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("d"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("w"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", "d", "w"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """sequences() where the first turns of a conversation are those of the first one of its SHARED neighbours."""
    own = cut(sequences(conversations))
    base = own.select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % SHARED).join(base, "base", "left")
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    turns = both.select("conv_id", F.when(F.col("head").isNull(), rest).otherwise(F.concat(F.slice("head", F.lit(1), h), rest)).alias("turns"))
    return turns.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["d"]), "")).alias("seq"), F.transform("turns", lambda t: t["w"]).alias("words"))


def shared_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that two sequences begin with in common, of which so many are known."""
    n, most, step = known * TURN, min(len(a), len(b)), 64 * TURN
    while n < most and a[n : n + step] == b[n : n + step]:
        n = min(n + step, most)
    while n < most and a[n : n + TURN] == b[n : n + TURN]:
        n += TURN
    return n // TURN


class Merge:
    """Loser tree over sorted runs; gives (LCP with the one before, item), the items' first value being the sequence.

    runs: iterators of (LCP with the item before in the run, item).  An inner node holds the loser of its match and the
    loser's LCP with the winner.  The path of the last winner has only losers to it, so both
    sides of every new match know their LCP with the last output: the larger one wins, equal ones compare what follows.
    """

    def __init__(self, runs: list[Iterator], compared: Callable[[int], None] | None = None) -> None:
        self.runs, self.k = runs, max(1, len(runs))
        self.item: list = [None] * self.k
        self.lcp = [0] * self.k
        self.loser = [-1] * self.k
        self.compared = compared
        for i in range(len(runs)):
            self._pull(i)
            self.lcp[i] = 0
        self.winner = self._build(1) if self.k > 1 else 0

    def _pull(self, i: int) -> None:
        self.lcp[i], self.item[i] = next(self.runs[i], (-1, None))

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        return self._match(node, self._build(2 * node), self._build(2 * node + 1))

    def _match(self, node: int, a: int, b: int) -> int:
        """The smaller one goes on, the other stays at the node."""
        x, y = self.item[a], self.item[b]
        if y is None or x is not None and self.lcp[a] > self.lcp[b]:
            won, lost = a, b
        elif x is None or self.lcp[a] < self.lcp[b]:
            won, lost = b, a
        else:
            known = self.lcp[a]
            both = shared_turns(x[0], y[0], known)
            if self.compared:
                self.compared(both - known + 1)
            at = both * TURN
            won, lost = (a, b) if x[0][at : at + TURN] <= y[0][at : at + TURN] else (b, a)
            self.lcp[lost] = both
        self.loser[node] = lost
        return won

    def __iter__(self):
        while self.item[self.winner] is not None:
            w = self.winner
            yield self.lcp[w], self.item[w]
            self._pull(w)
            node = (w + self.k) // 2
            while node:
                w = self._match(node, w, self.loser[node])
                node //= 2
            self.winner = w


class Node:
    """A node of the open path; sums are over what has left its subtree."""

    __slots__ = ("children", "conv", "end", "leaves", "n", "rows", "saved", "sid", "words")

    def __init__(self, words: int, sid: int | None) -> None:
        self.words, self.sid, self.n, self.conv, self.children, self.leaves, self.saved, self.end, self.rows = words, sid, 0, None, 0, 0, 0, None, []

    def met(self, n: int, conv: int) -> None:
        self.n += n
        self.conv = conv if self.conv is None or conv < self.conv else self.conv


class OpenPath:
    """Stack of the nodes from the root to the last sequence; emits finished nodes.

    low and high are the borders of the range with the numbers of their prefixes, if any: a node that is such a prefix
    is shared with other ranges and leaves as a part, without its shared children's sums.
    emit gets (conv, depth, parent conv, n, children, leaves, saved, end, number of a shared node, that of a shared parent, words).
    """

    def __init__(self, borders: list[tuple[bytes, list[int]]], emit) -> None:
        self.borders, self.emit, self.path = borders, emit, []

    def _sids(self, seq: bytes, first: int) -> list:
        """Numbers of the nodes from a depth to the sequence's end, None where a node is no border's prefix."""
        out = [None] * (len(seq) // TURN + 1 - first)
        for border, numbers in self.borders:
            for d in range(first, shared_turns(border, seq) + 1):
                out[d - first] = numbers[d]
        return out

    def add(self, lcp: int, seq: bytes, words: list[int], n: int, conv: int) -> None:
        while len(self.path) > lcp + 1:
            self._pop()
        first = len(self.path)
        for d, sid in enumerate(self._sids(seq, first), first):
            self.path.append(Node(words[d - 1] if d else 0, sid))
        self.path[-1].met(n, conv)
        self.path[-1].end = sha256(seq).digest()[:TURN]

    def _pop(self) -> None:
        node, depth = self.path.pop(), len(self.path)
        above = self.path[-1] if self.path else None
        if above is not None:
            above.met(node.n, node.conv)
        if node.sid is None:
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * node.words
        for conv, *row in node.rows:
            self.emit((conv, depth + 1, node.conv if node.sid is None else None, *row, None, node.sid, 0))
        own = (node.conv, node.n, node.children, node.leaves, node.saved, node.end)
        if node.sid is not None:
            self.emit((node.conv, depth, None, *own[1:], node.sid, None, node.words))
        elif above is None:
            self.emit((node.conv, depth, None, *own[1:], None, None, 0))
        else:
            above.rows.append(own)
            above.children, above.leaves, above.saved = above.children + 1, above.leaves + node.leaves, above.saved + node.saved

    def close(self) -> None:
        while self.path:
            self._pop()


RUNS = "part int, run long, pos int, lcp int, rest binary, words array<int>, n long, conv long"
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end binary, sid int, above int, words long"
_ARROW = [pa.int64()] * 7 + [pa.binary(), pa.int32(), pa.int32(), pa.int64()]


def batch_of(rows: list, schema: str, kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in schema.split(", ")])


def sorted_runs(distinct: DataFrame, borders: list[bytes], run_rows: int) -> DataFrame:
    """Sorted runs of each task's rows, cut at the borders and front-coded: a row holds the turns after its LCP."""
    shared = distinct.sparkSession.sparkContext.broadcast(borders)
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64()]

    def coded(run, number):
        run.sort(key=lambda r: r[0])
        last, part = b"", -1
        for pos, (seq, words, n, conv) in enumerate(run):
            here = bisect.bisect_right(shared.value, seq)
            lcp = shared_turns(last, seq) if here == part else 0
            yield here, number, pos, lcp, seq[lcp * TURN :], words[lcp:], n, conv
            last, part = seq, here

    def rows(batches):
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("seq", "words", "n", "conv")), strict=True):
                held.append(row)
                size += len(row[0])
                if len(held) == run_rows or size > RUN_BYTES:
                    yield from coded(held, number)
                    number, held, size = number + 1, [], 0
        yield from coded(held, number)

    def run(batches):
        out, size = [], 0
        for row in rows(batches):
            out.append(row)
            size += len(row[4])
            if len(out) == 1024 or size > 4 << 20:
                yield batch_of(out, RUNS, kinds)
                out, size = [], 0
        if out:
            yield batch_of(out, RUNS, kinds)

    return distinct.select("seq", "words", "n", "conv").mapInArrow(run, RUNS)


def merged(runs: DataFrame, parts: int, borders: list[bytes], numbers: list[list[int]]) -> DataFrame:
    """The nodes of each range: finished ones, and parts of those that ranges share."""
    spark = runs.sparkSession
    shared = spark.sparkContext.broadcast((borders, numbers))

    def decoded(rows):
        seq, words = b"", []
        for lcp, rest, more, n, conv in rows:
            seq, words = seq[: lcp * TURN] + rest, words[:lcp] + more
            yield lcp, (seq, words, n, conv)

    def run(batches):
        by_run, part = {}, None
        for batch in batches:
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("part", "run", "lcp", "rest", "words", "n", "conv"))
            for part, number, *row in zip(*columns, strict=True):  # noqa: B007
                by_run.setdefault(number, []).append(row)
        if part is None:
            return
        out, (borders, numbers) = [], shared.value
        path = OpenPath([(borders[i], numbers[i]) for i in (part - 1, part) if 0 <= i < len(borders)], out.append)
        for lcp, (seq, words, n, conv) in Merge([decoded(by_run[r]) for r in sorted(by_run)]):
            path.add(lcp, seq, words, n, conv)
            if len(out) >= 4096:
                yield batch_of(out, NODES, _ARROW)
                out.clear()
        path.close()
        for i in range(0, len(out), 4096):
            yield batch_of(out[i : i + 4096], NODES, _ARROW)

    return runs.repartitionById(parts, "part").sortWithinPartitions("part", "run", "pos").mapInArrow(run, NODES)


def borders_of(distinct: DataFrame, range_bytes: int) -> list[bytes]:
    """Where ranges after the first begin: for each the shortest prefix that tells two neighbours of the sample apart."""
    n, size = distinct.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("seq") + 64), F.lit(0))).first()
    parts = max(-(-size // range_bytes), min(distinct.sparkSession.sparkContext.defaultParallelism, n // 256), 1)
    if parts == 1:
        return []
    sample = sorted(bytes(r.seq) for r in distinct.where(hash_share("seq") < min(1.0, SAMPLES * parts / n, SAMPLE_BYTES / size)).select("seq").collect())
    each, seen, found = sum(len(s) + 64 for s in sample) / parts, 0, []
    for a, b in zip(sample, sample[1:], strict=False):
        seen += len(a) + 64
        if seen >= each * (len(found) + 1) and len(found) < parts - 1:
            found.append(b[: (shared_turns(a, b) + 1) * TURN])
    return found


def numbered(borders: list[bytes]) -> list[list[int]]:
    """For each border the numbers of its prefixes, from the root: the first border that has the prefix."""
    out: list[list[int]] = []
    for i, b in enumerate(borders):
        both = shared_turns(borders[i - 1], b) if i else -1
        out.append([out[i - 1][d] if d <= both else i for d in range(len(b) // TURN + 1)])
    return out


def put_together(parts: DataFrame, numbers: list[list[int]]) -> DataFrame:
    """The shared nodes, from their parts in the ranges: NODES without words; above is the number of the parent."""
    spark = parts.sparkSession
    # prefixes of borders: few, and on the driver anyway
    under = {}
    for i, own in enumerate(numbers):
        for d in range(1, len(own)):
            if own[d] == i:
                under[own[d - 1], d - 1] = under.get((own[d - 1], d - 1), 0) + 1
    ways = spark.createDataFrame(list(enumerate(numbers)), "sid int, way array<int>")
    counts = spark.createDataFrame([(i, d, n) for (i, d), n in under.items()], "sid int, depth long, shared long")
    sums = parts.groupBy("sid", "depth").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("words").alias("words"), F.max("end").alias("end"))
    own = sums.join(F.broadcast(counts), ["sid", "depth"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("shared", F.lit(0)))
    own = own.withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaves"))).withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("words"))
    own = cut(own.join(F.broadcast(ways), "sid").drop("shared"))
    up = own.select("leaves", "saved", F.posexplode(F.slice("way", F.lit(1), F.col("depth").cast("int") + 1)).alias("depth", "sid"))
    whole = up.groupBy("sid", F.col("depth").cast("long").alias("depth")).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    above = F.when(F.col("depth") > 0, F.get("way", F.col("depth").cast("int") - 1))
    return own.join(whole, ["sid", "depth"]).select("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "end", "sid", above.alias("above"))


def ends_of(convs: DataFrame) -> DataFrame:
    """end, and the digest of the ids (of convs(end, conv_id)) in order; a group's ids pass its task as written pieces, one at a time."""
    names = ["end", "first", "piece"]

    def pieces(batches):
        out, end, ids, first = [], None, [], None
        for batch in batches:
            for e, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if e != end or len(ids) == 4096:
                    if ids:
                        out.append((end, first, ",".join(ids)))
                    end, ids, first = e, [], c
                ids.append(str(c))
            if len(out) > 256:
                yield batch_of(out, ", ".join(names), [pa.binary(), pa.int64(), pa.string()])
                out = []
        if ids:
            out.append((end, first, ",".join(ids)))
        if out:
            yield batch_of(out, ", ".join(names), [pa.binary(), pa.int64(), pa.string()])

    def digests(batches):
        end, held = None, None
        for batch in batches:
            out = []
            for e, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if e != end:
                    if held is not None:
                        out.append((end, held.hexdigest()))
                    end, held = e, sha256(piece.encode())
                else:
                    held.update(b"," + piece.encode())
            if out:
                yield batch_of(out, "end, ends_sha256", [pa.binary(), pa.string()])
        if held is not None:
            yield batch_of([(end, held.hexdigest())], "end, ends_sha256", [pa.binary(), pa.string()])

    small_batches(convs.sparkSession)
    ordered = convs.select("end", "conv_id").repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id")
    return ordered.mapInArrow(pieces, "end binary, first long, piece string").repartition("end").sortWithinPartitions("end", "first").mapInArrow(digests, "end binary, ends_sha256 string")


def tree(convs: DataFrame, range_bytes: int = RANGE_BYTES, run_rows: int = RUN) -> DataFrame:
    """The nodes of the trie of convs (conv_id, seq, words), which should be cut.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 (of
    the members that end there).
    """
    small_batches(convs.sparkSession)
    distinct = cut(convs.groupBy("seq").agg(F.min("conv_id").alias("conv"), F.count("*").alias("n"), F.first("words").alias("words")))
    borders = borders_of(distinct, range_bytes)
    numbers = numbered(borders)
    found = merged(sorted_runs(distinct, borders, run_rows), len(borders) + 1, borders, numbers)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    if borders:
        found = cut(found)
        shared = cut(put_together(found.where("sid is not null"), numbers))
        # no more rows than the borders have turns
        parents = F.broadcast(shared.select(F.col("sid").alias("above"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("shared_parent")))
        own = found.where("sid is null").select(*columns, "end", "above").unionByName(shared.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*columns, "end", "above"))
        found = own.join(parents, ["above", "depth"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "shared_parent"))
    found = found.select(*columns, "end")
    found = cut(found)
    ends = ends_of(convs.select(F.substring(F.unhex(F.sha2("seq", 256)), 1, TURN).alias("end"), "conv_id"))
    inner = found.where("end is null").select(*columns, F.lit(EMPTY).alias("ends_sha256"))
    return found.where("end is not null").join(ends, "end").select(*inner.columns).unionByName(inner)


def query(conversations: DataFrame, range_bytes: int = RANGE_BYTES, run_rows: int = RUN) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return tree(cut(rebuilt(conversations)), range_bytes, run_rows)
