"""Packing of tokenised documents by linear grouping and best fit.

Every document becomes its token ids and an end id; one longer than a sequence is cut into full pieces, the
first one shorter.  Lengths are whole numbers of at most the capacity, so the packing is planned on their
histogram, whose size does not grow with the data:

1. lengths over a small limit are sorted and dealt into groups of equal cardinality, and each is
   rounded up to the largest of its group;
2. for these few sizes configurations (multisets that fit a sequence) are optimised one after another: the
   fullest one with the largest size left, by dynamic programming, used as often as counts allow;
3. each slot of a configuration gets actual documents of its group, longest first, so the room lost by
   rounding comes back;
4. small lengths go, longest first, where they fit best, and into new sequences if nowhere.

The plan is a list of runs: documents of one length, by rank, into consecutive sequences at one offset.
Ranks come from counts by length and hash bucket, so no length, however common, is gathered in a task;
the plan (some thousands of rows, bounded by the capacity) is broadcast.

Defined cases: a null text is empty and becomes the end id alone; equal documents are packed each;
a null id passes through; an empty table gives no rows; special strings in a text become their
ids, which is the tokenizer's default; any length is cut, none dropped.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkscope.llm.common import annotate, cut, fresh

CAPACITY, END = 1024, 2
#: Lengths up to this are small; the number of groups of the others. The plan of fewest sequences is taken.
SMALL, GROUPS = (128, 256, 512), (128, 512, 1024)
#: Expected pieces of one length and bucket that a task ranks together at most.
BUCKET = 1 << 15

PIECES = T.ArrayType(T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]))
_PIECE = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


class Encoder:
    """Byte-level BPE ids, special strings included as the tokenizer file has them."""

    def __init__(self, ranks_path: str, tokenizer_path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.slow = Tokenizer.from_file(tokenizer_path)
        special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
        self.special = list(special)
        self.fast = tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        try:
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        except BaseException as e:
            # the fast library panics on runs of about a million blanks; its panic is no Exception, and nothing else is met here
            if type(e).__name__ != "PanicException":
                raise
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


_encoders: dict[tuple[str, str], Encoder] = {}


def pieces_of(ids: np.ndarray, capacity: int, end: int) -> list[dict]:
    raw = ids.tobytes() + int(end).to_bytes(4, "little")
    n = len(raw) // 4
    first = n % capacity or capacity
    cuts = [0, *range(first, n + 1, capacity)]
    return [{"piece": i, "start": a, "length": b - a, "ids_crc32": zlib.crc32(raw[4 * a : 4 * b])} for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def encode_batch(paths: tuple[str, str], capacity: int, end: int, texts: pa.Array) -> list:
    if paths not in _encoders:
        _encoders[paths] = Encoder(*paths)
    encode = _encoders[paths]
    return [pa.array([pieces_of(encode(t.as_py() or ""), capacity, end) for t in texts], pa.list_(_PIECE))]


def configuration(sizes: list[int], left: list[int], capacity: int) -> dict[int, int]:
    """The fullest multiset of sizes (in descending order) with the first that is left, by bounded knapsack."""
    first = next(i for i, n in enumerate(left) if n)
    room = capacity - sizes[first]
    reach = 1  # bit s: the sum s can be made
    trail = []
    for i in range(first, len(sizes)):
        n = left[i] - (i == first)
        before = reach
        for _ in range(min(n, room // sizes[i])):
            more = reach | (reach << sizes[i]) & ((1 << room + 1) - 1)
            if more == reach:
                break
            reach = more
        trail.append((i, before))
        if reach >> room & 1:
            break
    s, out = reach.bit_length() - 1, {first: 1}
    for i, before in reversed(trail):
        while not before >> s & 1:
            out[i] = out.get(i, 0) + 1
            s -= sizes[i]
    return out


def best_plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The plan of fewest sequences among those of all settings; each takes less than a second."""
    return min((plan(counts, capacity, small, groups) for small in SMALL for groups in GROUPS), key=lambda x: x[1])


def plan(counts: dict[int, int], capacity: int, small: int, groups: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, number, first sequence, offset), and the number of sequences."""
    runs: list[tuple[int, int, int, int, int]] = []
    used = dict.fromkeys(counts, 0)
    sequences = 0
    open_: dict[int, list[tuple[int, int]]] = {}  # room left: (first sequence, number)

    def place(length: int, number: int, sequence: int, offset: int) -> None:
        runs.append((length, used[length], number, sequence, offset))
        used[length] += number

    # groups of equal cardinality, as queues of [length, number]
    large = sorted((n for n in counts if n > small), reverse=True)
    share = max(1, -(-sum(counts[n] for n in large) // groups))
    queues, room = [], 0
    for n in large:
        number = counts[n]
        while number:
            if not room:
                queues.append([])
                room = share
            t = min(room, number)
            queues[-1].append([n, t])
            number, room = number - t, room - t
    sizes = [q[0][0] for q in queues]
    left = [sum(t for _, t in q) for q in queues]
    # several groups of one size are one class
    for i in range(len(queues) - 1, 0, -1):
        if sizes[i] == sizes[i - 1]:
            queues[i - 1] += queues[i]
            left[i - 1] += left[i]
            del queues[i], sizes[i], left[i]
    while any(left):
        pattern = configuration(sizes, left, capacity)
        times = min(left[i] // k for i, k in pattern.items())
        for i, k in pattern.items():
            left[i] -= k * times
        # each slot has a stretch of its group's queue of its own
        slots = []
        for i, k in pattern.items():
            for _ in range(k):
                need, own = times, []
                while need:
                    n, t = queues[i][0]
                    t = min(t, need)
                    own.append([n, t])
                    need -= t
                    queues[i][0][1] -= t
                    if not queues[i][0][1]:
                        queues[i].pop(0)
                slots.append(own)
        while slots[0]:
            t = min(s[0][1] for s in slots)
            offset = 0
            for s in slots:
                place(s[0][0], t, sequences, offset)
                offset += s[0][0]
                s[0][1] -= t
                if not s[0][1]:
                    s.pop(0)
            open_.setdefault(capacity - offset, []).append((sequences, t))
            sequences += t
    rooms = sorted(r for r in open_ if r)
    for n in sorted((n for n in counts if n <= small), reverse=True):
        number = counts[n]
        while number:
            at = bisect.bisect_left(rooms, n)
            if at == len(rooms):  # new sequences, as many as full ones of this length need
                new = max(1, number // (capacity // n))
                free = (sequences, new, capacity)
                sequences += new
            else:
                r = rooms[at]
                first, t = open_[r].pop()
                if not open_[r]:
                    del open_[r], rooms[at]
                free = (first, t, r)
            first, t, r = free
            if t > number:
                if r not in open_:
                    bisect.insort(rooms, r)
                open_.setdefault(r, []).append((first + number, t - number))
                t = number
            place(n, t, first, capacity - r)
            number -= t
            if r > n:
                if r - n not in open_:
                    bisect.insort(rooms, r - n)
                open_.setdefault(r - n, []).append((first, t))
    return runs, sequences


def join_runs(runs: Iterable[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Runs that go on where the one before ends, as one."""
    out: list[tuple[int, int, int, int, int]] = []
    for n, rank, t, sequence, offset in sorted(runs):
        if out and (m := out[-1])[0] == n and m[4] == offset and m[1] + m[2] == rank and m[3] + m[2] == sequence:
            out[-1] = (n, m[1], m[2] + t, m[3], offset)
        else:
            out.append((n, rank, t, sequence, offset))
    return out


def pack(docs: DataFrame, ranks_path: str, tokenizer_path: str, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    docs = docs.select(id, text)
    into = fresh("made", docs.columns)
    paths = (ranks_path, tokenizer_path)
    made = annotate(docs, text, lambda texts: encode_batch(paths, capacity, end, texts), [T.StructField("pieces", PIECES)], into)
    pieces = cut(made.select(id, F.explode(f"{into}.pieces").alias("p")).select(id, "p.*"))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs, _ = best_plan(counts, capacity)
    buckets = max(1, -(-max(counts.values(), default=0) // BUCKET))
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64(id, "piece", "ids_crc32"), F.lit(buckets)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    base = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    # the order inside a bucket has all columns, so a task that runs again deals the same ranks
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(id, "piece", "start", "ids_crc32")) - 1
    ranked = bucketed.withColumn("own", rank).join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("own"))
    table = docs.sparkSession.createDataFrame(join_runs(runs), "of long, first long, number long, sequence long, offset long")
    found = ranked.join(F.broadcast(table), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("number")))
    return found.select(id, "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
