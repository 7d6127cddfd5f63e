"""What joins leave on disk: no shuffle files of steps that have ended, and no rows exchanged that cannot matter."""

import time

import numpy as np
from pyspark.sql import functions as F

from linkscope.llm import common, jaccard_join, text_kernel
from tests.llm.helpers import prose


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [found.apply(i) for i in range(found.length())]
    return {f.getPath(): f.length() for f in files if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}


def left_by(spark, work):
    """Bytes of the shuffle files that are left some seconds after work(), as they are deleted in the background."""
    before = shuffle_files(spark)
    kept = work()
    for _ in range(20):
        left = sum(size for path, size in shuffle_files(spark).items() if path not in before)
        if not left:
            break
        time.sleep(0.2)
    return left, kept


def test_cut_deletes_its_shuffle_files(spark):
    rows = spark.range(20000).withColumn("k", F.col("id") % 1000).repartition("k")
    was = spark.conf.get(common.CLEANUP)
    left, made = left_by(spark, lambda: common.cut(rows.join(rows.groupBy("k").count().hint("merge"), "k")))
    assert left == 0 and made.count() == 20000 and made.where("count = 20").count() == 20000 and spark.conf.get(common.CLEANUP) == was


def test_jaccard_join_leaves_few_shuffle_files(spark):
    rows = [(i, prose(i // 2, 600)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left, found = left_by(spark, lambda: jaccard_join.classes(docs))
    assert left < 0.1 * sum(len(t) for _, t in rows)
    assert {(r.doc_id, r.component_id) for r in found.collect()} == {(i, i // 2 * 2) for i, _ in rows}


def test_sieve_loses_no_row(spark):
    rows = spark.range(20000).select(F.when(F.col("id") > 0, F.col("id")).alias("id"), F.xxhash64("id").alias("th"), F.lit("x").alias("at"))
    keys = common.cut(rows.where("id is null or id % 50 = 0").select("id", "th"))
    out = common.sieve(rows, keys, ["id", "th"], "met")
    assert out.columns == ["id", "th", "at", "met"] and out.count() == 20000
    met = {r.id for r in out.where("met").collect()}
    assert met >= {None, *range(50, 20000, 50)} and len(met) < 4000
    none = common.cut(keys.where("false"))
    assert common.sieve(rows, none, ["id", "th"], "met").where("met").count() == 0


def test_entries_hold_each_prefix_once():
    import pyarrow as pa

    texts = [prose(1, 300), prose(1, 300), "one two three", None, prose(2, 40)]
    no = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    entry, shingle = jaccard_join.entries(no, 5, 80, 16, pa.array(texts))
    expected = []
    for t in (texts[0], texts[2], texts[4]):
        (x,) = text_kernel.shingle_sets(text_kernel.words(*next(text_kernel.blocks(pa.array([t])))[2:], text_kernel.SPACE_WORDS), 5)
        label = int(jaccard_join.set_key(x)[: jaccard_join.LABEL_DIGITS], 16)
        for i, s in enumerate(x[: jaccard_join.prefix_length(len(x), 80)].tolist()):
            expected.append((label, len(x), i < jaccard_join.short_length(len(x), 80), s >> 64 - jaccard_join.SHINGLE_BITS))
    bits = jaccard_join.SIZE_BITS
    got = [(e >> bits + 1, e >> 1 & (1 << bits) - 1, bool(e & 1), s) for e, s in zip(entry.view(np.uint64).tolist(), shingle.tolist(), strict=True)]
    assert got == expected


def test_deduplicate_exchanges_only_what_it_may_drop(spark):
    rows = [(i, prose(i, 600)) for i in range(200)] + [(500, prose(7, 600)), (9, prose(9, 600)), (None, prose(11, 600))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left, kept = left_by(spark, lambda: jaccard_join.deduplicate(docs).collect())
    assert left < 0.1 * sum(len(t) for _, t in rows)
    assert sorted(tuple(r) for r in kept) == rows[:200]
