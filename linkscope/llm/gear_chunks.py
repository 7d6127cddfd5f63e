"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text: h = (h << 1) + gear[byte], of which the last WINDOW bytes
count.  A chunk ends at each byte whose hash is the least of the REACH bytes before it and the
REACH bytes after it (of equal ones the first); a stretch of MOST bytes without an end is cut.  Hash and comparison
start anew at every text, so the chunks are a function of the text alone, and inside it of nearby bytes
alone: an insertion moves the chunks' places but not their contents (only where one short word repeats for hundreds
of bytes, and so no byte is the least, are chunks counted from the last end).

What is deduplicated by digest are runs of neighbouring chunks: from each chunk on the shortest run of RUN_WORDS
words.  A run that two or more documents hold is repeated, and the document of smallest id holds the
original.  So chunks that recur by chance in different documents never add up.  Overlapping repeated runs
make a span if one other document (the smallest id, for that itself the largest) holds them all; where
that document changes a new span begins, and the two may overlap.  Spans of MIN_WORDS words and more
are reported.  A passage loses at its edges what the texts around it decide (tens of bytes), so a repeat of more
than 50 words leaves more than half of it, while lines that documents have in common
by chance or as a notice leave none.  Where words are long, or not parted by blanks, WORD_BYTES bytes
count as one.  That the other document holds the runs of a span in the same order is not asked.

Digests are 96 bits of the xxh3 hash of a run's bytes, so equal ones stand for equal bytes: for 10**13 runs the chance
of any false repeat at all is below 10**-3.  Counts are combined map-side before the shuffle, and where
the repeated digests are joined back the rows of a hot one are dealt over many parts (common.joined), so a passage that a
third of all documents hold meets in no single task.

Defined cases: a null or empty text has no chunks; a document that repeats only itself has no
span; rows of one id are one document, whose different texts have spans of their own and whose equal ones share
them; rows with a null id take no part; an empty table gives no rows; other columns are not read; places
are bytes, and a span may begin or end inside a character of several bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkscope.llm.common import annotate, cut, fresh, joined
from linkscope.llm.text_kernel import blocks, mix, sliding

#: Bytes the gear hash remembers, bytes on either side that a chunk's end is the least of, and most bytes of a chunk.
WINDOW, REACH, MOST = 16, 14, 256
#: Words of a run that is looked up, words from which a span counts, and bytes that count as a word at most.
RUN_WORDS, MIN_WORDS, WORD_BYTES = 20, 25, 12

GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32) >> np.uint32(32 - WINDOW)

RUNS = [T.StructField(n, T.ArrayType(t)) for n, t in (("high", T.LongType()), ("low", T.IntegerType()), ("start", T.IntegerType()), ("length", T.IntegerType()), ("before", T.IntegerType()), ("words", T.IntegerType()))]


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a block of texts, the ends of the texts among them."""
    pad = max(WINDOW, REACH)
    # every text stands alone between stretches of padding, so neither hash nor comparison sees another text
    at = np.arange(len(data)) + np.repeat(np.arange(1, len(offsets)) * pad, np.diff(offsets))
    size = len(data) + len(offsets) * pad
    h = np.zeros(size, dtype=np.uint32)
    h[at] = GEAR[data]
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)  # the right side is made before it is added
        step *= 2
    value = np.full(size, 1 << WINDOW, dtype=np.uint32)
    value[at] = h[at] & np.uint32((1 << WINDOW) - 1)
    least = sliding(value, REACH, np.minimum)
    own = value[at]
    mark = np.zeros(len(data) + 1, dtype=bool)
    mark[1:] = (own < least[at - REACH]) & (own <= least[at + 1])
    mark[offsets[1:][np.diff(offsets) > 0]] = True
    ends = np.flatnonzero(mark)
    gaps = np.diff(np.r_[0, ends])
    long = np.flatnonzero(gaps > MOST)
    if len(long):
        more = [np.arange(e - g + MOST, e, MOST) for e, g in zip(ends[long].tolist(), gaps[long].tolist(), strict=True)]
        mark[np.concatenate(more)] = True
        ends = np.flatnonzero(mark)
    return ends


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of words that start before each byte of the block (and before its end)."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    first = np.ones(len(data) + 1, dtype=bool)
    first[1:-1] = blank[:-1]
    first[offsets] = True
    first = first[:-1] & ~blank
    return np.concatenate([[0], np.cumsum(first)])


def run_batch(texts: pa.Array, min_words: int) -> list:
    """Digest, place (bytes), words before and words of every run of each text; with 0 words of every chunk."""
    sizes, parts = [np.zeros(1, dtype=np.int64)], []
    for _, _, data, offsets in blocks(texts):
        if len(data) == 0:
            sizes.append(np.zeros(len(offsets) - 1, dtype=np.int64))
            continue
        ends = chunk_ends(data, offsets)
        starts = np.r_[0, ends[:-1]]
        words = word_starts(data, offsets)
        of = np.searchsorted(offsets, starts, "right") - 1
        # the first chunk at whose end there are words, or bytes, enough
        last = np.minimum(np.searchsorted(words[ends], words[starts] + min_words), np.searchsorted(ends, starts + min_words * WORD_BYTES))
        last = np.maximum(last, np.arange(len(starts)))
        keep = np.flatnonzero(last < len(ends))
        keep = keep[of[last[keep]] == of[keep]]
        first, stop, of = starts[keep], ends[last[keep]], of[keep]
        raw = memoryview(np.ascontiguousarray(data))
        digests = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(first.tolist(), stop.tolist(), strict=True)])
        pieces = np.frombuffer(digests, dtype=np.dtype([("high", "<i8"), ("low", "<i4"), ("rest", "<i4")]))
        sizes.append(np.bincount(of, minlength=len(offsets) - 1))
        parts.append((pieces["high"], pieces["low"], first - offsets[of], stop - first, words[first] - words[offsets[of]], words[stop] - words[first]))
    at = pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32))
    kinds = (np.int64, np.int32, np.int32, np.int32, np.int32, np.int32)
    return [pa.ListArray.from_arrays(at, pa.array(np.concatenate([p[i] for p in parts] or [np.zeros(0)]).astype(kind))) for i, kind in enumerate(kinds)]


def runs(docs: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = RUN_WORDS) -> DataFrame:
    """id, copy (a hash of the text), high and low (digest), start, length (bytes), before, words of every run; with 0 words of every chunk."""
    own, into = docs.select(id, text).where(F.col(id).isNotNull()), fresh("made", [id, text])
    made = annotate(own, text, lambda texts: run_batch(texts, min_words), RUNS, into)
    # a text is hashed once, below the explode
    once = made.select(F.col(id).alias("id"), F.hash(text).alias("copy"), F.arrays_zip(*[F.col(f"{into}.{f.name}") for f in RUNS]).alias("all"))
    return once.select("id", "copy", F.explode("all").alias("c")).select("id", "copy", "c.*")


def repeated_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """Spans of texts that another document holds too: id, start, end (bytes), n_words, first_doc_id, is_first.

    first_doc_id: the smallest id that holds the span's runs.
    """
    every = runs(docs, id, text, run_words)
    digest = ["high", "low"]
    repeated = cut(every.groupBy(*digest).agg(F.min("id").alias("first_doc_id"), F.max("id").alias("last"), F.count("*").alias("n")).where("first_doc_id <> last"))
    found = joined(every, repeated, digest, "n", ["id", "start"]).withColumn("last", F.when(F.col("first_doc_id") == F.col("id"), F.col("last")))
    key = ["id", "copy", "first_doc_id", "last"]
    along = Window.partitionBy(*key).orderBy("start")
    end = F.col("start") + F.col("length")
    found = found.select(*key, "start", end.alias("end"), "before", (F.col("before") + F.col("words")).alias("after"))
    opens = F.coalesce(F.col("start") > F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    island = found.withColumn("opens", opens.cast("int")).withColumn("island", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    spans = island.groupBy(*key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("after") - F.min("before")).cast("long").alias("n_words"))
    whole = (F.col("n_words") >= min_words) | (F.col("end") - F.col("start") >= min_words * WORD_BYTES)
    return spans.where(whole).select(F.col("id").alias(id), "start", "end", "n_words", "first_doc_id", (F.col("first_doc_id") == F.col("id")).alias("is_first"))
