"""Merkle manifest against plain trees, over ranges that cut runs anywhere."""

import hashlib
import random
import zlib

import pytest

from linkscope.llm import mountain_manifest as mm
from tests.llm.helpers import DOC_SCHEMA, docs_of, odd_docs, prose


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return h(*map(enc, (r.doc_id, r.source, r.lang, r.n_chars, text)))


def levels_of(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def way(levels, i):
    for level in levels[:-1]:
        run, at = level[i // 8 * 8 : i // 8 * 8 + 8], i % 8
        yield "".join(run[:at]), "".join(run[at + 1 :])
        i //= 8


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    names = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels_of([x[2] for x in sorted(by[g], key=lambda x: x[:3])]) for g in names}
    top = levels_of([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(by[g], key=lambda x: x[:3])):
            steps = [*way(trees[g], i), *way(top, k)]
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text) if r.text is not None else None
            up = leaf(r, low) if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 else own
            for a, b in steps:
                up = h(a, up, b)
            out.append((r.doc_id, own, trees[g][-1][0], top[-1][0], h(*[a + b for a, b in steps]), up, up == top[-1][0]))
    nodes = {("group", g, k, i, d) for g in names for k, level in enumerate(trees[g]) if k for i, d in enumerate(level)} | {("table", None, k, i, d) for k, level in enumerate(top) if k for i, d in enumerate(level)}
    return sorted(map(str, out)), nodes


def rows_of(n, seed):
    r = random.Random(seed)
    docs = docs_of([prose(i, r.randrange(5)).upper() if i % 9 else None for i in range(n)], first=-20)
    return [(d, t, r.choice([None, "de", "en", "en", "en", "zz", "Été"]), s, c) for d, t, _, s, c in docs]


@pytest.mark.parametrize("n,per_range", [(1, 10), (8, 3), (65, 7), (700, 23), (1300, 100)])
def test_proofs_and_nodes_equal_plain_trees(spark, n, per_range):
    docs = spark.createDataFrame(rows_of(n, n), DOC_SCHEMA).repartition(3)
    expected, nodes = plain(docs.collect())
    got = mm.proofs(docs, rows=per_range).collect()
    assert sorted(str(tuple(r)) for r in got) == expected
    assert {tuple(r) for r in mm.manifest(docs, rows=per_range).collect()} == nodes


def test_one_group_over_many_ranges(spark):
    docs = spark.createDataFrame([(i, f"T{i}", "en", "s", 2) for i in range(600)], DOC_SCHEMA)
    got = mm.proofs(docs, rows=9)
    assert sorted(str(tuple(r)) for r in got.collect()) == plain(docs.collect())[0]
    assert got.where("not verified").count() == sum(zlib.crc32(str(i).encode()) % 3 == 0 for i in range(600))


def test_odd_and_repeated_rows(spark):
    docs = odd_docs(spark, clash=("grp", "key", "digest", "other", "salt", "part", "level", "place", "run", "Steps"))
    docs = docs.unionByName(docs.where("doc_id = 5")).unionByName(spark.createDataFrame([(70, "a" * (5 << 20), "en", "s", 1)] * 20, DOC_SCHEMA), allowMissingColumns=True)
    expected, _ = plain(docs.collect())
    for size in (4, 1000):
        assert sorted(str(tuple(r)) for r in mm.proofs(docs, rows=size).collect()) == expected
    empty = docs.limit(0)
    assert mm.proofs(empty).collect() == [] and mm.manifest(empty).collect() == []
    assert mm.proofs(empty).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_ranges_hand_over_few_peaks():
    for start, n in ((0, 4096), (5, 4096), (4095, 9000)):
        out = []
        r = mm.Range(start, lambda *x: out.append(x))
        for i in range(n):
            r.add(h(str(i)).encode())
        r.end(start + n + 1)
        assert sum(x[3] for x in out) <= 14 * 5 and not any(x[4] for x in out)
