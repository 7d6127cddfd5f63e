"""Language identification by prediction by partial matching.

For each language a context tree over bytes (A-Z lowered) of variable order, up to ORDER, is counted from labelled
texts and then frozen.  In a context with total count t and q distinct followers, a byte
seen c times has probability c / (t + q); with the escape probability q / (t + q) the shorter
context decides among the bytes not seen here, down to a uniform share over all 256 bytes.
Every context's distribution sums to one, so the sums of -log2 are exact code lengths.  The
language that codes a text in the fewest bits is predicted.

With the bytes seen here excluded, a byte that a context has not seen costs the context's escape and what it costs in
the shorter context.  So a tree is kept as two tables for each order: the cost of every run of bytes that some language
has, and the escape of every context, each with a column for each language.  No context or byte is left out.

Training texts are a sample by hash: of each language about SAMPLE_DOCS texts and SAMPLE_BYTES bytes at most (expected
numbers; the one bound of this operator), each used whole.

Defined cases: a text that is null or has no letter (str.isalpha) is `und` with score 0;
with no labelled row at all every text is `und`; ties go to the language first in order; repeated
rows give a row each; a null id is not held out (nor is such a row learnt from); other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkscope.llm.common import annotate, fresh, hash_share
from linkscope.llm.text_kernel import LOWER, blocks

ORDER = 3
SAMPLE_DOCS, SAMPLE_BYTES = 400, 4 << 20

FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())]


def runs(stream: np.ndarray, n: int) -> np.ndarray:
    """Each byte with the n - 1 bytes before it as one number, from the n-th byte on."""
    out = np.zeros(max(0, len(stream) - n + 1), dtype=np.uint32)
    for j in range(n):
        out = (out << np.uint32(8)) | stream[j : j + len(out)]
    return out


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and whether they are there."""
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), dtype=bool)


class Model:
    """Frozen statistics of all languages.

    costs[k]: sorted runs of k + 1 bytes and the bits of their last byte after the others; escapes[k]: sorted contexts
    of k bytes and the bits of an escape from them.  Both have a column for each language.
    """

    def __init__(self, texts: dict[str, list[bytes]]):
        self.languages = sorted(texts)
        width = len(self.languages)
        border = np.zeros(ORDER, dtype=np.uint8)
        streams = {k: np.concatenate([x for t in texts[k] if t for x in (border, LOWER[np.frombuffer(t, np.uint8)])] or [border]) for k in self.languages}
        starts = {k: np.cumsum([0, *[len(t) + ORDER for t in texts[k] if t]]) for k in self.languages}
        self.costs, self.escapes = [], []
        for k in range(ORDER + 1):
            seen = []
            for name in self.languages:
                # runs that end at a byte of a text, not at a border
                ends = np.ones(len(streams[name]), dtype=bool)
                for i in range(ORDER):
                    ends[starts[name][starts[name] + i < len(ends)] + i] = False
                seen.append(np.unique(runs(streams[name], k + 1)[ends[k:]], return_counts=True))
            union = np.unique(np.concatenate([u for u, _ in seen])) if seen else np.zeros(0, np.uint32)
            contexts = np.unique(union >> np.uint32(8)) if k else np.zeros(1, np.uint32)
            bits, escape = np.zeros((len(union), width), np.float64), np.zeros((len(contexts), width), np.float64)
            for j, (codes, times) in enumerate(seen):
                at, (own, _) = find(union, codes)[0], find(contexts, codes >> np.uint32(8) if k else np.zeros(len(codes), np.uint32))
                shorter = self.costs[-1][1][find(self.costs[-1][0], union & np.uint32((1 << 8 * k) - 1))[0], j] if k else np.full(len(union), 8.0)
                t = np.bincount(own, weights=times, minlength=len(contexts))
                q = np.bincount(own, minlength=len(contexts))
                rest = 1 - np.bincount(own, weights=np.exp2(-shorter[at]), minlength=len(contexts))
                some = (rest > 1e-9) & (t > 0)
                total = t + np.where(some, q, 0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    escape[:, j] = np.where(some, np.log2(total / q) + np.log2(np.maximum(rest, 1e-300)), np.where(t > 0, 64.0, 0.0))
                # those not seen in this language escape from the context
                bits[:, j] = escape[find(contexts, union >> np.uint32(8) if k else np.zeros(len(union), np.uint32))[0], j] + shorter
                bits[at, j] = np.log2(total[own] / times)
            if k == 0:  # all bytes, seen or not
                full = np.tile(8.0 + escape[0], (256, 1))
                full[union] = bits
                union, bits = np.arange(256, dtype=np.uint32), full
            self.costs.append((union, bits))
            self.escapes.append((contexts, escape))

    def bits(self, code: np.ndarray) -> np.ndarray:
        """Bits of each byte, given with the ORDER bytes before it as one number, under each language."""
        out = np.zeros((len(code), len(self.languages)))
        left = np.arange(len(code))
        for k in range(ORDER, -1, -1):
            own = code[left] & np.uint32((1 << 8 * (k + 1)) - 1 if k < 3 else 0xFFFFFFFF)
            at, hit = find(self.costs[k][0], own)
            out[left[hit]] += self.costs[k][1][at[hit]]
            left, own = left[~hit], own[~hit]
            if len(left) == 0:
                break
            at, known = find(self.escapes[k][0], own >> np.uint32(8))
            out[left[known]] += self.escapes[k][1][at[known]]
        return out

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of each text of a block under each language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        full = np.flatnonzero(np.diff(offsets))
        if len(full) == 0:
            return out
        code = runs(np.concatenate([np.zeros(ORDER, np.uint8), LOWER[data]]), ORDER + 1)
        # at a text's start the context is a border, as in training
        for i in range(min(ORDER, len(data))):
            at = offsets[:-1][full] + i
            at = at[at < offsets[1:][full]]
            code[at] &= np.uint32((1 << 8 * (i + 1)) - 1)
        # equal runs are looked up once
        distinct, of = np.unique(code, return_inverse=True)
        out[full] = np.add.reduceat(self.bits(distinct)[of], offsets[:-1][full], axis=0)
        return out


def letterless(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Flags of the texts without a letter."""
    low = LOWER[data]
    plain = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
    none = plain[offsets[1:]] == plain[offsets[:-1]]
    for i in np.flatnonzero(none).tolist():
        none[i] = not any(c.isalpha() for c in bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace"))
    return none


def predict(model: Broadcast, texts: pa.Array) -> list:
    m = model.value
    names, scores, rates = [], [], []
    for _, _, data, offsets in blocks(texts):
        none = letterless(data, offsets)
        if not m.languages:
            none[:] = True
        else:
            bits = m.lengths(data, offsets)
            best = bits.argmin(1)
            low = bits.min(1)
            share = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(1)
        for i, blank in enumerate(none.tolist()):
            names.append("und" if blank else m.languages[best[i]])
            scores.append(0.0 if blank else float(share[i]))
            rates.append(None if blank else float(low[i] / (offsets[i + 1] - offsets[i])))
    return [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())]


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id") -> Model:
    """Context trees from the rows that have a text, a language and an id."""
    rows = labelled.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("id is not null and text is not null and lang is not null")
    n = {r["lang"]: (r["count"], r["bytes"]) for r in rows.groupBy("lang").agg(F.count("*").alias("count"), F.sum(F.octet_length("text")).alias("bytes")).collect()}
    if not n:
        return Model({})
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, SAMPLE_DOCS / v, SAMPLE_BYTES / max(1, size)))) for k, (v, size) in sorted(n.items())])
    texts: dict[str, list[bytes]] = {k: [] for k in n}
    for r in rows.where(hash_share("id") < share).select("lang", "text").collect():
        texts[r["lang"]].append(r["text"].encode())
    return Model(texts)


def identify(docs: DataFrame, model: Model, text: str = "text", into: str = "language") -> DataFrame:
    """docs with a struct column: lang_pred, score (share of the likeliest language), bits_per_byte."""
    block = docs.sparkSession.sparkContext.broadcast(model)
    return annotate(docs, text, lambda texts: predict(block, texts), FIELDS, into)


def held_out(id: str, parts: int, part: int):
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % parts == part, F.lit(False))


def query(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text", "lang")
    model = train(docs.where(~held_out("doc_id", 3, 1)))
    into = fresh("language", docs.columns)
    return identify(docs.select("doc_id", "text"), model, into=into).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), f"{into}.*")
