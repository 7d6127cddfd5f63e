"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes of BITS bits: signs after principal axes and learnt rotations that
bring the coordinates near the corners of a cube (several rotations, so that there may be more bits
than dimensions).  A code is split into substrings of 16 bits, and each substring of a shard of vectors
is an index, a table of row numbers by value.  Two codes within a radius r agree in some substring to within r / (number of
substrings), so looking up in every index the values that differ from the query's in so few bits (pigeonhole probing)
retrieves every code within r.  Probing starts at small radii and widens until k codes are found;
then the radius is the k-th nearest code's distance and SLACK more, learnt as what separates the codes of true
neighbours from the k nearest codes.  All codes within it are retrieved and ranked by the exact distances of their vectors.
Where the values to look up would be more than the codes of the shard, as happens for vectors that
have no near ones, the codes are compared one by one instead, which retrieves the same rows.

Axes, rotations and slack are fitted on a sample by hash of about SAMPLE vectors (expected number; the bound of
this operator).  Every vector is indexed.  Queries go to the shards in passes of at most QUERIES, for each of which a
shard's indexes are built once, and each shard returns its k nearest.

Defined cases: vectors that are null, zero, of other than the commonest dimension, or hold null or
non-finite components take no part, nor do null ids; equal distances go to the smaller id; a vector's own row is
no neighbour, another row of equal id neither; of several vectors of one id the least (as an array) is the query, and as
neighbours they count once, with the smallest distance; an empty table gives no rows; fewer than k others give all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkscope.llm.common import hash_share, small_batches

BITS, SUBSTRING = 256, 16
SAMPLE, QUANTILE = 4096, 0.99
QUERIES, SHARD, ROWS = 1 << 15, 1 << 16, 1024
#: All values of a substring in order of their bits, and how many have at most so many bits.
MASKS = np.array(sorted(range(1 << SUBSTRING), key=lambda v: v.bit_count()), dtype=np.uint16)
UP_TO = np.cumsum(np.bincount(np.bitwise_count(MASKS), minlength=SUBSTRING + 1))


class Coder:
    """Mean, and the axes whose signs are the bits."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, k: int = 10):
        d = sample.shape[1]
        self.mean = sample.mean(0) if len(sample) else np.zeros(d)
        x = sample - self.mean
        _, axes = np.linalg.eigh(x.T @ x + 1e-9 * np.eye(d))
        axes = axes[:, ::-1]
        rng = np.random.default_rng(7)
        parts = []
        for _ in range(-(-bits // d)):
            r = np.linalg.qr(rng.standard_normal((d, d)))[0]
            v = x @ axes
            for _ in range(20 if len(x) else 0):  # alternate corners and the rotation towards them
                u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
                r = (u @ w).T
            parts.append(axes @ r)
        self.axes = np.concatenate(parts, axis=1)[:, :bits]
        self.slack = self._slack(sample, k)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Codes, one row of 16-bit substrings for each vector."""
        return np.packbits((x - self.mean) @ self.axes >= 0, axis=1).view(np.uint16)

    def _slack(self, sample: np.ndarray, k: int) -> int:
        """Bits by which the codes of nearly all of the sample's neighbours are farther than the k-th nearest code."""
        if len(sample) < k + 2:
            return self.axes.shape[1]
        codes, out = self(sample), []
        for i in np.linspace(0, len(sample) - 1, min(512, len(sample))).astype(int).tolist():
            d = ((sample - sample[i]) ** 2).sum(1)
            d[i] = np.inf
            bits = hamming(codes, codes[i])
            bits[i] = 2 * self.axes.shape[1]
            out.append(bits[np.argpartition(d, k - 1)[:k]] - np.partition(bits, k - 1)[k - 1])
        return max(0, int(np.quantile(np.concatenate(out), QUANTILE)))


def hamming(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(1, dtype=np.int64)


def kth_distance(bits: np.ndarray, ids: np.ndarray, k: int) -> int | None:
    """The least distance within which k different ids lie, None where there are fewer."""
    n = k
    while n < len(bits):
        n = min(4 * n, len(bits))
        near = np.argpartition(bits, n - 1)[:n]
        near = near[np.argsort(bits[near], kind="stable")]
        _, first = np.unique(ids[near], return_index=True)
        if len(first) >= k:
            return int(bits[near[np.sort(first)[k - 1]]])
    return None


class Shard:
    """Substring indexes over a bounded number of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, coder: Coder):
        self.ids, self.vectors, self.codes, self.slack = ids, vectors, coder(vectors), coder.slack
        self.tables = []
        for j in range(self.codes.shape[1]):
            column = self.codes[:, j]
            starts = np.concatenate([[0], np.cumsum(np.bincount(column, minlength=1 << SUBSTRING))]).astype(np.int32)
            self.tables.append((starts, np.argsort(column, kind="stable").astype(np.int32)))
        #: Codes that were looked at, over all searches.
        self.seen = 0

    def within(self, code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of every code within the radius, and their distances."""
        m = len(self.tables)
        # the first radius % m + 1 substrings at the larger share of the radius, the others one below
        shares = [min(SUBSTRING, radius // m - (j > radius % m)) for j in range(m)]
        if sum(UP_TO[s] for s in shares if s >= 0) > len(self.ids):
            rows = np.arange(len(self.ids))
        else:
            found = []
            for (starts, order), part, share in zip(self.tables, code, shares, strict=True):
                if share >= 0:
                    values = (part ^ MASKS[: UP_TO[share]]).astype(np.int64)
                    size = starts[values + 1] - starts[values]
                    some = size > 0
                    size, first = size[some], starts[values[some]]
                    found.append(order[np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())] if len(size) else order[:0])
            rows = np.unique(np.concatenate(found))
        self.seen += len(rows)
        bits = hamming(self.codes[rows], code)
        return rows[bits <= radius], bits[bits <= radius]

    def nearest(self, query_id: int, query: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest that are found."""
        m, most = len(self.tables), len(self.tables) * SUBSTRING
        for share in range(SUBSTRING + 1):
            # past the radii worth probing all codes are at hand at once
            radius = m * (share + 1) - 1 if m * UP_TO[share] <= len(self.ids) else most
            rows, bits = self.within(code, radius)
            other = self.ids[rows] != query_id
            rows, bits = rows[other], bits[other]
            if (reach := kth_distance(bits, self.ids[rows], k)) is not None or radius >= most:
                break
        if reach is not None:
            reach = min(reach + self.slack, most)
            if reach > radius:
                rows, _ = self.within(code, reach)
                rows = rows[self.ids[rows] != query_id]
            else:
                rows = rows[bits <= reach]
        score = np.sqrt(((self.vectors[rows] - query) ** 2).sum(1))
        order = np.lexsort((self.ids[rows], score))
        _, first = np.unique(self.ids[rows][order], return_index=True)
        order = order[np.sort(first)][:k]
        return self.ids[rows[order]], score[order]


def usable(vectors: DataFrame, id: str, embedding: str) -> DataFrame:
    """id and vector (array of double) of the rows that take part."""
    v = F.col(embedding).cast("array<double>")
    good = vectors.select(F.col(id).alias("id"), v.alias("v")).where("id is not null and v is not null")
    good = good.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return good.where(F.size("v") == (sizes[0]["d"] if sizes else 0))


def search(vectors: DataFrame, is_query, id: str = "vec_id", embedding: str = "embedding", k: int = 10, bits: int = BITS) -> DataFrame:
    """The k nearest of each query row: query_id, rank, vec_id, score. is_query: a condition on the column id."""
    spark = vectors.sparkSession
    small_batches(spark)
    good = usable(vectors, id, embedding)
    total = good.count()
    sample = good.where(hash_share("id", "v") < min(1.0, SAMPLE / max(1, total))).orderBy("id", "v").collect()
    empty = "query_id long, vec_id long, score double"
    if not sample:
        sample = good.orderBy("id", "v").limit(1).collect()
    found = spark.createDataFrame([], empty)
    if sample:
        coder = spark.sparkContext.broadcast(Coder(np.array([r["v"] for r in sample]), bits, k))
        asked = good.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
        passes = -(-asked.count() // QUERIES)
        for b in range(passes):
            part = asked.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == b).orderBy("id").toArrow()
            ids = part["id"].to_numpy()
            block = spark.sparkContext.broadcast((ids, np.array(part["v"].combine_chunks().flatten()).reshape(len(ids), -1)))

            def run(frames: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
                ids, queries = block.value
                codes = coder.value(queries)
                for own, x in shards(frames):
                    shard = Shard(own, x, coder.value)
                    for i in range(0, len(ids), ROWS):
                        out = [shard.nearest(int(ids[j]), queries[j], codes[j], k) for j in range(i, min(i + ROWS, len(ids)))]
                        yield pd.DataFrame({"query_id": np.repeat(ids[i : i + ROWS], [len(o[0]) for o in out]), "vec_id": np.concatenate([o[0] for o in out]), "score": np.concatenate([o[1] for o in out])})

            found = found.unionByName(good.mapInPandas(run, empty))
    # a repeated id may be in two shards
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def shards(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, rows, n = [], [], 0
    for frame in frames:
        if len(frame):
            ids.append(frame["id"].to_numpy(np.int64))
            rows.append(np.stack(frame["v"].to_numpy()).astype(np.float64))
            n += len(frame)
        if n >= SHARD:
            yield np.concatenate(ids), np.concatenate(rows)
            ids, rows, n = [], [], 0
    if n:
        yield np.concatenate(ids), np.concatenate(rows)
