"""Benchmark decontamination by winnowing.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lowered.  Every
text and every item is cut into k-grams of words; of each window of w consecutive
k-grams the smallest hash is kept as a fingerprint, and k + w - 1 is the length of the
benchmark window, so two texts that share such a window share a fingerprint.  Test
fingerprints are joined to training fingerprints, and every hit is extended over the
windows around it; a window counts only if its words equal the item's, byte for byte.
An item with fewer words than a window is one window by itself and is found by its
leading k-gram.

Benchmark items reach the executors in blocks of about BLOCK_BYTES of text, of which a pass over the texts holds
PASS_BLOCKS at most, so what a worker keeps is bounded whatever the size of the benchmark; the columns of several
passes are united in their row.

Defined cases: a null or empty text has no words, is not contaminated and carries no item;
null or wordless items match nothing; repeated items each count by their own id; repeated
documents give a row each; null ids pass through; an empty table gives no rows; further
columns are neither read nor returned unless asked for.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkscope.llm.common import annotate, fresh
from linkscope.llm.text_kernel import ALNUM_WORDS, blocks, coefficients, grams, mix, sliding, words

#: Words of a benchmark window, and of the k-grams that are fingerprinted.
WINDOW, K = 13, 5
#: Bytes of benchmark text that one broadcast holds, and the broadcasts of one pass.
BLOCK_BYTES, PASS_BLOCKS = 1 << 20, 8
_FILTER_BITS = 22

HITS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
]


class Sieve:
    """Membership of 64-bit hashes: a bit table first, then the sorted values."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.table = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.table[self._slot(self.values)] = True

    @staticmethod
    def _slot(x: np.ndarray) -> np.ndarray:
        return (x >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Positions of x whose value is a member."""
        at = np.flatnonzero(self.table[self._slot(x)])
        if len(at) == 0 or len(self.values) == 0:
            return at[:0]
        near = np.searchsorted(self.values, x[at])
        near[near == len(self.values)] = 0
        return at[self.values[near] == x[at]]


def winnow(gram: np.ndarray, window: int) -> np.ndarray:
    """Flags of the k-grams that are the smallest of some window; ties all count, on both sides alike."""
    if len(gram) < window:
        return np.zeros(len(gram), dtype=bool)
    least = sliding(gram, window, np.minimum)
    border = np.zeros(window - 1, dtype=np.uint64)
    return sliding(np.concatenate([border, least, border]), window, np.maximum) == gram


class Index:
    """Windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[str, str]], window: int, k: int):
        self.window, self.k = window, k
        self.items: dict[bytes, list[str]] = {}
        full, prints, short = [], [], {}
        for name, text in items:
            raw = np.frombuffer(text.encode(), dtype=np.uint8)
            found = words(raw, np.array([0, len(raw)]), ALNUM_WORDS)
            n = len(found.hashes)
            if n == 0:
                continue
            for s in range(max(1, n - window + 1)):
                owners = self.items.setdefault(joined(found, s, min(n, s + window)), [])
                if name not in owners[-1:]:
                    owners.append(name)
            if n >= window:
                full.append(grams(found.hashes, window))
                gram = grams(found.hashes, k)
                prints.append(gram[winnow(gram, window - k + 1)])
            else:
                short.setdefault(n, []).append(found.hashes)
        gather = lambda x: Sieve(np.concatenate(x) if x else np.zeros(0, np.uint64))
        self.full, self.prints = gather(full), gather(prints)
        #: by length: the leading gram's length, sieves of leading grams and of whole sequences
        self.short = {n: (min(n, k), gather([grams(h, min(n, k))[:1] for h in hs]), gather([grams(h, n) for h in hs])) for n, hs in short.items()}


def joined(found, start: int, end: int) -> bytes:
    return b" ".join([found.data[a:b].tobytes() for a, b in zip(found.starts[start:end].tolist(), found.ends[start:end].tolist(), strict=True)])


def run_hash(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """grams() at the given places only."""
    factor, total = coefficients(n), np.zeros(len(at), dtype=np.uint64)
    for j in range(n):
        total += hashes[at + j] * factor[j]
    return mix(total)


def matches(found, index: Index) -> list[tuple[int, int, list[str]]]:
    """(first word, end word, items) of every benchmark window in the block, in order of place."""
    h, out = found.hashes, []
    bound = np.repeat(found.of_text[1:], np.diff(found.of_text))  # end of each word's text
    by_length = {}

    def gram(n):
        if n not in by_length:
            by_length[n] = grams(h, n)
        return by_length[n]

    def keep(starts, n):
        starts = starts[starts + n <= len(h)]
        return starts[starts + n <= bound[starts]]

    if len(index.full.values):
        g = gram(index.k)
        selected = np.flatnonzero(winnow(g, index.window - index.k + 1))
        seeds = selected[index.prints(g[selected])]
        if len(seeds):
            around = np.unique((seeds[:, None] - np.arange(index.window - index.k + 1)).ravel())
            around = keep(around[around >= 0], index.window)
            out += [(s, index.window) for s in around[index.full(run_hash(h, around, index.window))].tolist()]
    for n, (lead, leading, whole) in index.short.items():
        at = keep(leading(gram(lead)), n)
        out += [(s, n) for s in at[whole(run_hash(h, at, n))].tolist()]
    found_items = []
    for s, n in sorted(out):
        if owners := index.items.get(joined(found, s, s + n)):
            found_items.append((s, s + n, owners))
    return found_items


_indexes: dict[int, Index] = {}


def index_of(block: Broadcast, window: int, k: int, keep: set[int]) -> Index:
    """The index of a block, made once in a worker; those of other passes are let go of."""
    token, items = block.value
    for old in _indexes.keys() - keep - {token}:
        del _indexes[old]
    if token not in _indexes:
        _indexes[token] = Index(items, window, k)
    return _indexes[token]


def merged(spans: list[tuple[int, int]]) -> list[dict]:
    """Spans in order, those that touch as one."""
    out: list[dict] = []
    for s, e in sorted(spans):
        if out and out[-1]["end"] >= s:
            out[-1]["end"] = max(e, out[-1]["end"])
        else:
            out.append({"start": s, "end": e})
    return out


def scan(parts: list[Broadcast], window: int, k: int, texts: pa.Array) -> list:
    """n_words, merged word spans that benchmark windows cover, and items with a window, of each text."""
    tokens = {b.value[0] for b in parts}
    n_words, hits, items = [], [], []
    for first, end, data, offsets in blocks(texts):
        found = words(data, offsets, ALNUM_WORDS)
        n_words += np.diff(found.of_text).tolist()
        spans = [[] for _ in range(end - first)]
        owners = [set() for _ in range(end - first)]
        for block in parts:
            places = matches(found, index_of(block, window, k, tokens))
            of = np.searchsorted(found.of_text, [s for s, _, _ in places], "right") - 1
            for (s, e, names), d in zip(places, of.tolist(), strict=True):
                owners[d].update(names)
                spans[d].append((s - int(found.of_text[d]), e - int(found.of_text[d])))
        hits += [merged(x) for x in spans]
        items += [sorted(x) for x in owners]
    return [pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string()))]


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K, into: str = "winnowed") -> DataFrame:
    """docs with a struct column: n_words, hits (word spans) and items (ids as strings, sorted)."""
    spark = docs.sparkSession
    known = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null")
    size = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // BLOCK_BYTES))
    parts = []
    for i in range(n):
        own = known if n == 1 else known.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i)
        items = sorted((r[0], r[1]) for r in own.collect())
        parts.append(spark.sparkContext.broadcast((hash((window, k, *items)), items)))
    # each pass adds a column to the rows as they come, so no row needs a number and none is moved
    names, found = [], docs
    for i in range(0, n, PASS_BLOCKS):
        names.append(into if n <= PASS_BLOCKS else fresh(f"{into}_{i}", found.columns))
        found = annotate(found, text, partial(scan, parts[i : i + PASS_BLOCKS], window, k), HITS, names[-1])
    if n <= PASS_BLOCKS:
        return found
    field = T.StructType(HITS)
    unite = F.udf(lambda each: (each[0]["n_words"], [(h["start"], h["end"]) for h in merged([(h["start"], h["end"]) for e in each for h in e["hits"]])], sorted({x for e in each for x in e["items"]})), field)
    return found.withColumn(into, unite(F.array(*names))).drop(*names)


def digest(found: DataFrame, into: str = "winnowed") -> DataFrame:
    """The counts and the verdict that find()'s struct column implies, as columns beside doc_id."""
    n_hit = F.expr(f"aggregate({into}.hits, 0L, (n, x) -> n + x.end - x.start)")
    return found.select(
        "doc_id",
        F.col(f"{into}.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(f"{into}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{into}.items", ","), 256).alias("items_sha256"),
        contaminated(into).alias("contaminated"),
    )


def contaminated(into: str = "winnowed"):
    """At least one word in twenty lies in a benchmark window."""
    n_hit = F.expr(f"aggregate({into}.hits, 0L, (n, x) -> n + x.end - x.start)")
    return (n_hit > 0) & (20 * n_hit >= F.col(f"{into}.n_words"))


def leaked(into: str = "winnowed", window: int = WINDOW):
    """A stretch of hit words as long as a whole benchmark window, however long the text is, or contaminated().

    So an item shorter than a window condemns a text only by its share of the words: a benchmark that holds the
    item `yes` does not empty a corpus.  Short items side by side count as one stretch.
    """
    return F.exists(f"{into}.hits", lambda h: h["end"] - h["start"] >= window) | contaminated(into)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without those that benchmark text has leaked into, columns unchanged; a null text stays."""
    into = fresh("winnowed", docs.columns)
    return find(docs, benchmark, window=window, into=into).where(~leaked(into, window)).drop(into)
