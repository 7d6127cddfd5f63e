"""Exact n-gram Jaccard join in the metric space of shingle sets.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lowered; a document's set is its distinct
runs of five words (a shorter text is one run, a wordless one is empty).  Jaccard distance is a
metric, and two documents link at a distance of at most r = 1/5.

1. Equal sets collapse to one representative, whatever their number.
2. Nearly all pairs of documents are at distance 1, where no sampled document could be a pivot that tells them apart.
   So on the first level every shingle is a pivot, a set of one member.  A document is as near as can be to its own
   shingles and at distance 1 from all others.  Under one total order of shingles (rare in a
   bounded sample first, then by hash; any order gives the same links) two sets within r share
   l shingles among their first n - ceil(4n/5) + l, so a document is replicated to the regions of just those.
   l is a small part of n (SHARED); who shares fewer in all with others is linked with none.  Regions
   whose smallest document is the same form one cell, with that document as its pivot.  A document leaves
   cells in which it has fewer than l shingles altogether, the last ones in one order of all cells, so that linked ones still meet.
3. A cell of at most CELL documents and CELL_BYTES of text is joined in one task: distances to the pivot come first.
   Documents within r of the pivot link to it, and need no comparison with each other; one farther away is compared
   only with those whose distances to the pivot lie within r of its own (triangle inequality).
4. A larger cell is split recursively.  A few of its documents, drawn by hash, become pivots; all
   others are dealt out in bounded groups and learn their distances to them.  Links to pivots are
   complete then.  Pivots that links connect, and the documents linked to them, form clusters; the largest
   cluster of the cell needs no comparison inside.  Every other document is open: it must meet all that may link to it.
   Its nearest pivot's Voronoi region is its home, and any document y is replicated to the regions of all pivots q with
   d(y, q) <= d(y, nearest) + 2r, which brings together whatever links.  Each region with open documents is
   a cell of the next level, where again only distances to its pivot within r of each other are compared.
   When a cell has few open documents all of these are pivots, and it is done.  After LEVELS
   levels the open ones are dealt into blocks that serve as pivots side by side, so it ends.
5. Components of the links give the classes.

Shingles are 64-bit hashes and sets are compared by them; set keys have 128 bits.

Regions of shingles that are common in the sample are counted map-side and broadcast (there are at most SAMPLE_BYTES / 12 /
HOT_COUNT of them), so no shuffle brings all documents with such a shingle together; all other joins
by a key that many rows may have go through common.joined.

Prefixes are most of the data.  They are made from the texts twice, so that none is stored: one exchange brings them to their
regions, packed as entries of two numbers.  What is exchanged of texts is sieved by a bitmap first (common.sieve).
Labels, shingles and sizes of entries are cut short, which may bring more sets together but keeps no two apart.

Defined cases: a null text counts as empty; empty sets link with nothing; equal texts link
whatever their ids, null ones too; repeated rows give a row each; a row whose id is null has a null component
unless a text linked to it has an id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkscope.llm.common import annotate, cut, fresh, hash_share, joined, releasing, sieve, small_batches
from linkscope.llm.components import components
from linkscope.llm.text_kernel import SPACE_WORDS, blocks, mix, shingle_sets, words

#: Words of a shingle, and the similarity of a link in hundredths.
SHINGLE, PERCENT = 5, 80
#: Shingles that linked sets must share in their prefixes, for each hundred of the smaller one.
SHARED = 3
#: Expected documents and bytes of the sample that orders shingles; the count there from which one is common, and hot.
SAMPLE, SAMPLE_BYTES, COMMON, HOT_COUNT = 8192, 32 << 20, 3, 16
#: Most documents and bytes of text of a cell that one task joins by itself, and of a group of a larger cell.
CELL, CELL_BYTES = 1024, 8 << 20
#: Expected pivots of a split (at most MOST_PIVOTS), open documents and bytes that may all be pivots at once, and levels of splits.
PIVOTS, MOST_PIVOTS, OPEN, OPEN_BYTES, LEVELS = 8, 12, 64, 4 << 20, 2

SETS = [
    T.StructField("n_shingles", T.LongType()),
    T.StructField("key", T.StringType()),
    T.StructField("n_cold", T.IntegerType()),
    T.StructField("hot", T.ArrayType(T.LongType())),
]

#: An entry: the label of a set, of LABEL_DIGITS hexadecimal digits, its size in SIZE_BITS bits (larger ones as the largest) and, in the last, whether the shingle is of the shorter prefix; the first SHINGLE_BITS bits of the shingle; rows of a batch of entries.
LABEL_DIGITS, SIZE_BITS, SHINGLE_BITS, ENTRY_ROWS = 10, 23, 48, 1 << 16
ENTRY = "entry long, shingle long"


def sets_of(texts: pa.Array, n: int) -> list[np.ndarray]:
    out = []
    for _, _, data, offsets in blocks(texts):
        out += shingle_sets(words(data, offsets, SPACE_WORDS), n)
    return out


def set_key(x: np.ndarray) -> str | None:
    """128 bits that depend on the set's size and members; None for the empty set."""
    if len(x) == 0:
        return None
    return f"{int(mix(x).sum(dtype=np.uint64)):016x}{int(mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)):016x}"


def shared(n: int) -> int:
    return max(1, -(-n * SHARED // 100))


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - -(-n * percent // 100) + shared(n))


def short_length(n: int, percent: int) -> int:
    """Of two linked sets the smaller shares as many of its first n - ceil(2pn/(100+p)) + l."""
    return n - -(-2 * percent * n // (100 + percent)) + shared(n)


def prefix(common: tuple[np.ndarray, np.ndarray], percent: int, hot_count: int, x: np.ndarray) -> tuple[np.ndarray, int]:
    """The prefix of a set, and how many of it, at its start, are not hot."""
    known, count = common
    first = n_cold = prefix_length(len(x), percent) if len(x) else 0
    if len(known) and len(x):
        at = np.searchsorted(known, x)
        at[at == len(known)] = 0
        seen = np.where(known[at] == x, count[at], 0)
        rare = x[seen == 0]
        if len(rare) < first:
            order = np.lexsort((x, seen))
            n_cold = int((seen[order[:first]] < hot_count).sum())
            rare = x[order]
        x = rare
    return x[:first], n_cold


def summarise(common: tuple[np.ndarray, np.ndarray], n: int, percent: int, hot_count: int, texts: pa.Array) -> list:
    """n_shingles and key of every text, how many of its prefix are not hot, and the others."""
    sets = sets_of(texts, n)
    made = [prefix(common, percent, hot_count, x) for x in sets]
    hot = [p[n_cold:].view(np.int64) for p, n_cold in made]
    flat = np.concatenate(hot) if hot else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in hot])]).astype(np.int32)
    return [pa.array([len(x) for x in sets], pa.int64()), pa.array([set_key(x) for x in sets], pa.string()), pa.array([n_cold for _, n_cold in made], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]


def entries(common: tuple[np.ndarray, np.ndarray], n: int, percent: int, hot_count: int, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Entry and shingle of all in the texts' prefixes that is not hot; of equal sets one is taken."""
    seen: set[str | None] = {None}
    owners, shingles = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for x in sets_of(texts, n):
        if (key := set_key(x)) not in seen:
            seen.add(key)
            first, n_cold = prefix(common, percent, hot_count, x)
            own = int(key[:LABEL_DIGITS], 16) << SIZE_BITS + 1 | min(len(x), (1 << SIZE_BITS) - 1) << 1
            owners.append(np.uint64(own) | (np.arange(n_cold) < short_length(len(x), percent)).astype(np.uint64))
            shingles.append(first[:n_cold] >> np.uint64(64 - SHINGLE_BITS))
    return np.concatenate(owners).view(np.int64), np.concatenate(shingles).view(np.int64)


def common_shingles(docs: DataFrame, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a bounded sample share, and in how many; only the order depends on them."""
    total = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("size")).first()
    share = min(1.0, SAMPLE / max(1, total["n"]), SAMPLE_BYTES / max(1, total["size"]))
    field = T.StructField("s", T.ArrayType(T.LongType()))
    made = annotate(docs.select(text).where(F.octet_length(text) < 1 << 20).where(hash_share(text) < share), text, lambda texts: [pa.array([x.view(np.int64) for x in sets_of(texts, n)], pa.list_(pa.int64()))], [field], "made")
    with releasing(docs.sparkSession):
        rows = made.select(text, "made.s").dropDuplicates([text]).select(F.explode("s").alias("s")).groupBy("s").count().where(F.col("count") >= COMMON).toArrow()
    hot = rows["s"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hot)
    return hot[order], rows["count"].to_numpy()[order]


def distances(sets: list[np.ndarray], pivot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the intersections and of the unions of many sets with one."""
    size = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    at = np.searchsorted(pivot, flat)
    at[at == len(pivot)] = 0
    both = np.add.reduceat((pivot[at] == flat).astype(np.int64), np.r_[0, np.cumsum(size)[:-1]])
    return both, size + len(pivot) - both


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a bounded number of sets."""
    size = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    owner = np.repeat(np.arange(len(sets)), size)[order]
    value = flat[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = value[1:] != value[:-1]
    ends = np.append(np.flatnonzero(new), len(value))
    times = np.diff(ends)
    out = np.diag(size).astype(np.int64)
    # shingles held by just two sets by counting; those of more by a 0/1 matrix, some columns at a time
    twice = ends[:-1][times == 2]
    np.add.at(out, (owner[twice], owner[twice + 1]), 1)
    np.add.at(out, (owner[twice + 1], owner[twice]), 1)
    many = np.flatnonzero(times > 2)
    for i in range(0, len(many), 8192):
        part = many[i : i + 8192]
        column = np.repeat(np.arange(len(part)), times[part])
        rows = np.concatenate([owner[ends[j] : ends[j + 1]] for j in part.tolist()])
        matrix = np.zeros((len(sets), len(part)), dtype=np.float32)
        matrix[rows, column] = 1
        both = np.rint(matrix @ matrix.T).astype(np.int64)
        np.fill_diagonal(both, 0)
        out += both
    return out


def distinct_sets(n: int, keys: list[str], texts: pd.Series) -> tuple[list[str], list[np.ndarray]]:
    """Keys and sets, each once, in order of keys; a text that does not have its row's key is another's of equal hash."""
    found = {}
    for k, x in zip(keys, sets_of(pa.array(texts, pa.large_string()), n), strict=True):
        if k not in found and set_key(x) == k:
            found[k] = x
    return sorted(found), [found[k] for k in sorted(found)]


LINKS = "a string, b string"


def join_cell(n: int, percent: int, frame: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links between the members (key, text) of one cell."""
    keys, sets = distinct_sets(n, frame["key"].tolist(), frame["text"])
    ties: list[tuple[str, str]] = []
    if len(keys) > 1:
        both, union = distances(sets, sets[0])
        d, inner = 1 - both / union, 100 * both >= percent * union
        ties = [(keys[0], keys[i]) for i in np.flatnonzero(inner).tolist() if i]
        outer = np.flatnonzero(~inner)
        if len(outer):
            # who has an outer one in its window
            sorted_d, reach = np.sort(d[outer]), 1 - percent / 100 + 1e-9
            near = np.flatnonzero(np.searchsorted(sorted_d, d + reach, "right") > np.searchsorted(sorted_d, d - reach, "left"))
            ties += forest([keys[i] for i in near.tolist()], [sets[i] for i in near.tolist()], d[near], inner[near], percent)
    return pd.DataFrame(ties, columns=["a", "b"], dtype=str)


def forest(keys: list[str], sets: list[np.ndarray], d: np.ndarray, inner: np.ndarray, percent: int) -> list[tuple[str, str]]:
    """Ties for all links within the windows of d, but for those between two inner ones."""
    both = overlaps(sets)
    size = np.diag(both)
    union = size[:, None] + size[None, :] - both
    window = np.abs(d[:, None] - d[None, :]) <= 1 - percent / 100 + 1e-9
    linked = np.triu(window & ~(inner[:, None] & inner[None, :]) & (100 * both >= percent * union), 1)
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ties = []
    for i, j in np.argwhere(linked).tolist():
        a, b = find(i), find(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            ties.append((keys[i], keys[j]))
    return ties


MEASURED = "cell long, key string, size long, open boolean, final boolean, used boolean, mask long, linked array<string>, near array<struct<pivot:string,d:double>>"


def measure(n: int, percent: int, frame: pd.DataFrame) -> pd.DataFrame:
    """Members of one group of a cell against all pivots of the cell.

    frame: cell, key, text, size, open, d (to the pivot whose region the cell is), pivot (whether the row is one),
    final (whether nothing follows).  For each member: its links, their bits, and the pivots whose regions it goes to.
    """
    p, m = frame[frame["pivot"]], frame[~frame["pivot"]].drop_duplicates("key")
    pivots, pivot_sets = distinct_sets(n, p["key"].tolist(), p["text"])
    final = bool(frame["final"].iloc[0])
    if not final:
        pivots, pivot_sets = pivots[:MOST_PIVOTS], pivot_sets[:MOST_PIVOTS]
    sets = sets_of(pa.array(m["text"], pa.large_string()), n)
    right = np.array([set_key(x) == k for x, k in zip(sets, m["key"], strict=True)], dtype=bool)
    m, sets = m[right], [x for x, ok in zip(sets, right.tolist(), strict=True) if ok]
    keys, reach = m["key"].to_numpy(), 1 - percent / 100 + 1e-9
    d = np.full((len(m), len(pivots)), np.inf)
    linked: list[list[str]] = [[] for _ in range(len(m))]
    mask = np.zeros(len(m), dtype=np.int64)
    before = m["d"].to_numpy(dtype=float)
    of_pivot = dict(zip(p["key"], p["d"], strict=True))
    for j, (name, x) in enumerate(zip(pivots, pivot_sets, strict=True)):
        # links can only be where the distances to the region's pivot are close; regions need all distances
        rows = np.flatnonzero(np.abs(before - of_pivot[name]) <= reach) if final else np.arange(len(m))
        if len(rows) == 0:
            continue
        both, union = distances([sets[i] for i in rows.tolist()], x)
        d[rows, j] = 1 - both / union
        for i in rows[100 * both >= percent * union].tolist():
            mask[i] |= 1 << min(j, 62)
            if keys[i] != name:
                linked[i].append(name)
    near: list[list[dict]] = [[] for _ in range(len(m))]
    if not final and len(pivots):
        home = d.argmin(1)
        for i, j in np.argwhere(d <= d.min(1)[:, None] + 2 * reach).tolist():
            one = {"pivot": pivots[j], "d": float(d[i, j])}
            near[i] = [one, *near[i]] if j == home[i] else [*near[i], one]
    lists = {"linked": pd.Series(linked, index=m.index, dtype=object), "near": pd.Series(near, index=m.index, dtype=object)}
    return m[["cell", "key", "size", "open", "final"]].assign(used=m["key"].isin(pivots), mask=mask, **lists)


def largest_cluster(frame: pd.DataFrame) -> pd.DataFrame:
    """Of the masks (mask, waiting, n, bytes) of one cell: the bits of the cluster that most members are linked to, and what stays open outside it."""
    groups: list[list[int]] = []  # bits, members
    for mask, n in zip(frame["mask"].tolist(), frame["n"].tolist(), strict=True):
        if mask:
            hit = [g for g in groups if g[0] & mask]
            groups = [g for g in groups if not g[0] & mask] + [[mask, n]]
            for bits, more in hit:
                groups[-1][0] |= bits
                groups[-1][1] += more
    main = max(groups, key=lambda g: (g[1], -g[0]), default=[0, 0])[0]
    left = frame[frame["waiting"] & ((frame["mask"] & main) == 0)]
    return pd.DataFrame({"cell": [frame["cell"].iloc[0]], "main": [main], "total": [int(frame["n"].sum())], "n_open": [int(left["n"].sum())], "open_bytes": [int(left["bytes"].sum())]})


def split(cells: DataFrame, texts: DataFrame, n: int, percent: int) -> list[DataFrame]:
    """Links of cells (cell, key, size, open, d) too large for one task, level by level; texts: key, text."""
    out = []
    for level in range(LEVELS + 1):
        sized = cut(cells.groupBy("cell").agg(F.count("*").alias("m"), F.sum("size").alias("bytes"), F.count_if("open").alias("n_open"), F.sum(F.when(F.col("open"), F.col("size")).otherwise(0)).alias("open_bytes")).where("m > 1 and n_open > 0"))
        if sized.isEmpty():
            break
        few = (F.col("n_open") <= OPEN) & (F.col("open_bytes") <= OPEN_BYTES)
        rows = joined(cells, sized, ["cell"], "m", ["key"])
        if level == LEVELS:
            # no more splits: blocks of open ones side by side, every member against each
            b = F.greatest(F.ceil(F.col("n_open") / (OPEN // 2)), F.ceil(F.col("open_bytes") / (OPEN_BYTES // 2))).cast("int")
            rows = rows.withColumn("b", F.when(few, F.lit(1)).otherwise(b)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
            own = F.pmod(F.xxhash64("key"), F.col("b")) == F.col("block")
            rows = rows.withColumn("open", F.col("open") & own).withColumn("cell", F.xxhash64("cell", "block")).withColumn("final", F.lit(True))
        else:
            rows = rows.withColumn("final", few)
        share = F.least(PIVOTS / F.col("n_open"), F.lit(float(OPEN_BYTES)) / F.col("open_bytes"))
        asked = F.col("open") & (F.col("final") | (hash_share("key", F.lit(level)) < share))
        chunks = F.greatest(F.ceil(F.col("m") / CELL), F.ceil(F.col("bytes") / CELL_BYTES)).cast("int")
        rows = rows.withColumn("chunks", chunks).withColumn("asked", asked)
        member = F.array(F.struct(F.lit(False).alias("pivot"), F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int").alias("chunk")))
        places = F.when(F.col("asked"), F.concat(member, F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: F.struct(F.lit(True).alias("pivot"), i.alias("chunk"))))).otherwise(member)
        dealt = rows.join(texts, "key").withColumn("place", F.explode(places)).select("cell", "key", "text", "size", "open", "d", "final", "place.pivot", "place.chunk")
        got = cut(dealt.groupBy("cell", "chunk").applyInPandas(lambda frame: measure(n, percent, frame), MEASURED))
        out.append(got.select(F.col("key").alias("a"), F.explode("linked").alias("b")))
        if level == LEVELS:
            break
        waiting = F.col("open") & ~F.col("used")
        going = got.where("not final").withColumn("waiting", waiting)
        masks = going.groupBy("cell", "mask", "waiting").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
        main = cut(masks.groupBy("cell").applyInPandas(largest_cluster, "cell long, main long, total long, n_open long, open_bytes long"))
        onward = joined(going.drop("open"), main, ["cell"], "total", ["key"]).where("n_open > 0").withColumn("open", F.col("waiting") & (F.col("mask").bitwiseAND(F.col("main")) == 0))
        # few open ones, or none drawn as a pivot: the cell stays as it is; else its regions are cells
        stays = few | (F.size("near") == 0)
        alone = F.array(F.struct(F.lit(None).cast("string").alias("pivot"), F.lit(0.0).alias("d")))
        placed = onward.withColumn("stays", stays).select("cell", "key", "size", "open", "stays", F.posexplode(F.when(F.col("stays"), alone).otherwise(F.col("near"))).alias("at", "q"))
        cells = cut(placed.select(F.when(F.col("stays"), F.col("cell")).otherwise(F.xxhash64("cell", "q.pivot")).alias("cell"), "key", "size", (F.col("open") & (F.col("at") == 0)).alias("open"), F.col("q.d").alias("d")))
    return out


def links(docs: DataFrame, summary: DataFrame, block: Broadcast, id: str, text: str, n: int, percent: int) -> DataFrame:
    """Links (a, b) between set keys that connect the same sets as all links within the radius do.

    summary has the id, th (a hash of the text), size (bytes) and columns SETS of every row of docs; block has the common shingles.
    """
    hot_count = HOT_COUNT
    # one row stands for each set; rep is a short label, and what equal labels of different sets bring together is told apart by key
    rep = cut(summary.where("key is not null").groupBy("key").agg(F.min(F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), "th", "size")).alias("r")).select("key", "r.id", "r.th", "r.size", F.expr(f"cast(conv(substring(key, 1, {LABEL_DIGITS}), 16, 10) as bigint)").alias("rep")))
    few = lambda n: f"greatest(1, cast(ceil({SHARED} * ({n}) / 100.0) as bigint))"
    short = F.expr(f"n_shingles - cast(ceil({2 * percent} * n_shingles / {100 + percent}.0) as bigint) + {few('n_shingles')}")

    def regions(spread: DataFrame) -> DataFrame:
        return spread.groupBy("shingle").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last"), F.min(F.when(F.col("index"), F.col("n"))).alias("ilo"), F.max(F.when(F.col("index"), F.col("n"))).alias("ihi")).where("pivot < last and ilo is not null").drop("last")

    def spread_out(batches):
        for batch in batches:
            made = pa.RecordBatch.from_arrays([pa.array(x) for x in entries(block.value, n, percent, hot_count, batch.column(0))], names=["entry", "shingle"])
            for i in range(0, made.num_rows, ENTRY_ROWS):
                yield made.slice(i, ENTRY_ROWS)
        pa.default_memory_pool().release_unused()

    # shingles that are not hot: one exchange serves the regions' sums and the rows that join them; a few more copies may pass the sieve, which changes no region
    small_batches(docs.sparkSession)
    kept = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    packed = sieve(kept, rep.select("id", "th"), ["id", "th"], "stands").where("stands").select("text").mapInArrow(spread_out, ENTRY).repartition("shingle")
    cold = packed.select("shingle", F.shiftrightunsigned("entry", SIZE_BITS + 1).alias("rep"), F.shiftright("entry", 1).bitwiseAND((1 << SIZE_BITS) - 1).cast("int").alias("n"), (F.col("entry").bitwiseAND(1) == 1).alias("index"))
    both = cold.join(regions(cold).hint("merge"), "shingle")
    own = summary.where("size(hot) > 0").select(F.col(id).alias("id_"), F.col("th").alias("th_"), F.col("key").alias("key_"), F.least(F.col("n_shingles"), F.lit((1 << SIZE_BITS) - 1)).cast("int").alias("n"), short.alias("short"), "n_cold", "hot")
    if not own.isEmpty():
        of_rep = (F.col("key") == F.col("key_")) & F.col("id").eqNullSafe(F.col("id_")) & (F.col("th") == F.col("th_"))
        warm = rep.join(own, of_rep).select("rep", "n", "short", "n_cold", F.posexplode("hot").alias("at", "shingle"))
        hot = cut(warm.select("shingle", "rep", "n", (F.col("at") + F.col("n_cold") < F.col("short")).alias("index")))
        both = both.unionByName(hot.join(F.broadcast(regions(hot)), "shingle"))
    fits = F.col("index") | ((F.col("ilo") <= F.col("n")) & (100 * F.col("ihi") >= percent * F.col("n")))
    found = cut(both.where(fits).groupBy("pivot", "rep", "n").count())
    least = F.expr(few(f"ceil({percent} * n / 100.0)"))
    # linked sets share at least so many; under one order of all pivots neither drops the first that both have, if each drops the
    # last of its pivots with fewer in all (so who has fewer in all drops out). Those in whose regions sets have small shares, which chance brings together, come last.
    shares = cut(found.groupBy("pivot").agg(F.count("*").alias("m"), F.avg(F.col("count") / F.col("n")).alias("share")))
    later = Window.partitionBy("rep", "n").orderBy("share", "pivot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    meets = joined(found, shares, ["pivot"], "m", ["rep"]).withColumn("after", F.sum("count").over(later)).where(F.col("after") >= least)
    cells = cut(meets.select("pivot", "rep").distinct().join(rep, "rep"))
    # a cell of one member has nothing to join
    sized = cut(cells.groupBy("pivot").agg(F.count("*").alias("m"), F.sum("size").alias("bytes")).where("m > 1"))
    small = (F.col("m") <= CELL) & (F.col("bytes") <= CELL_BYTES)
    member = cut(joined(cells, sized, ["pivot"], "m", ["key"]).select("pivot", "key", "id", "th", "size", small.alias("small")))
    # the texts that any cell needs are fetched once, each once
    needed = cut(member.select("key", "id", "th").distinct())
    of_text = F.col("id").eqNullSafe(F.col("id_")) & (F.col("th") == F.col("th_"))
    asked = sieve(kept, needed, ["id", "th"], "asked").where("asked").select(F.col("id").alias("id_"), F.col("th").alias("th_"), "text")
    texts = cut(needed.join(asked, of_text).select("key", "text"))
    found = member.where("small").select("pivot", "key").join(texts, "key").groupBy("pivot").applyInPandas(lambda frame: join_cell(n, percent, frame), LINKS)
    large = member.where("not small").select(F.col("pivot").alias("cell"), "key", "size", F.lit(True).alias("open"), F.lit(0.0).alias("d"))
    if not large.isEmpty():
        for more in split(large, texts, n, percent):
            found = found.unionByName(more)
    return found.distinct()


def labelled(docs: DataFrame, id: str, text: str, also: tuple[str, ...], n: int, percent: int) -> DataFrame:
    """id, columns of also, th (a hash of the text), n_shingles, key, root (of the class) and component of every row."""
    docs = docs.select(id, text, *also)
    common = common_shingles(docs, text, n)
    into = fresh("made", docs.columns)
    block = docs.sparkSession.sparkContext.broadcast(common)
    hot_count = HOT_COUNT
    made = annotate(docs, text, lambda texts: summarise(block.value, n, percent, hot_count, texts), SETS, into)
    summary = cut(made.select(id, *also, F.xxhash64(text).alias("th"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size"), f"{into}.*"))
    labels = components(links(docs, summary, block, id, text, n, percent))
    least = summary.where("key is not null").groupBy("key").agg(F.min(id).alias("low"), F.count("*").alias("n"))
    rooted = least.join(labels.select(F.col("node").alias("key"), "root"), "key", "left").select("key", "low", "n", F.coalesce("root", "key").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component"))
    found = cut(rooted.join(lowest, "root").select("key", "root", "component", "n"))
    columns = [id, *also, "th", "n_shingles", "key"]
    linked = joined(summary.where("key is not null").select(*columns), found, ["key"], "n", [id, "th"]).select(*columns, "root", "component")
    alone = summary.where("key is null").select(*columns, F.lit(None).cast("string").alias("root"), F.col(id).alias("component"))
    return linked.unionByName(alone)


def classes(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: id, n_shingles, root (of the class) and component_id, its smallest id."""
    return labelled(docs, id, text, (), n, percent).select(id, "n_shingles", "root", F.col("component").alias("component_id"))


def deduplicate(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class, that of the smallest id (a null id last); wordless texts stay.

    Rows are known by id, text and a hash of the other columns, so nothing depends on their order or files; rows
    that are equal in all of these are one document.
    """
    others = [c for c in docs.columns if c not in (id, text)]
    rest, gone = fresh("rest", [*docs.columns, "th"]), fresh("gone", docs.columns)
    marked = docs.withColumn(rest, F.xxhash64(*others) if others else F.lit(0).cast("long"))
    found = cut(labelled(marked, id, text, (rest,), SHINGLE, PERCENT).where("root is not null").groupBy("root", id, "th", rest).agg(F.count("*").alias("times")))
    order = F.struct(F.col(id).isNull(), F.col(id), F.col("th"), F.col(rest))
    sized = cut(found.groupBy("root").agg(F.min(order).alias("kept"), F.count("*").alias("n")))
    judged = joined(found, sized, ["root"], "n", [id, "th"]).select(id, "th", rest, "times", (~order.eqNullSafe(F.col("kept"))).alias(gone))
    # what to drop, and of what to keep one row only
    taken = [*marked.columns, gone]
    of_id, of_th, of_rest, th, met = (fresh(n, taken) for n in ("id_", "th_", "rest_", "th", "met"))
    judged = cut(judged.where(F.col(gone) | (F.col("times") > 1)).select(F.col(id).alias(of_id), F.col("th").alias(of_th), F.col(rest).alias(of_rest), gone))
    same = F.col(id).eqNullSafe(F.col(of_id)) & (F.xxhash64(text) == F.col(of_th)) & (F.col(rest) == F.col(of_rest))
    # only rows that may be judged are exchanged
    sifted = sieve(marked.withColumn(th, F.xxhash64(text)), judged.select(F.col(of_id).alias(id), F.col(of_th).alias(th), F.col(of_rest).alias(rest)), [id, th, rest], met).drop(th)
    maybe = sifted.where(met).drop(met)
    out = sifted.where(~F.col(met)).drop(met).unionByName(maybe.join(judged, same, "left_anti"))
    if not (repeated := judged.where(~F.col(gone))).isEmpty():
        out = out.unionByName(maybe.join(repeated, same, "left_semi").dropDuplicates([id, text, rest]))
    return out.drop(rest)
