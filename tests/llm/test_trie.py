"""Prefix trie against a plain one, over many ranges and runs."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from linkscope.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuild(rows):
    digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()[:32]
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by[c].append((turn is not None, turn or 0, digest(role, text), (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in by.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    base = lambda c: c - (c % 20 if c >= 0 else -(-c % 20))
    return {c: own.get(base(c), [])[: h[c]] + own[c][h[c] :] for c in own}


def plain(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
    out = [(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children.get(k, 0), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()) for k, m in members.items()]
    return sorted(map(str, out))


def got(df):
    return sorted(str(tuple(r)) for r in df.collect())


def talks(seed, n, words, turns=6):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant"]), " ".join(r.choice("ab") for _ in range(r.randrange(words)))) for c in range(-25, n) if r.random() < 0.9 for t in range(r.randrange(1, turns))]


@pytest.mark.parametrize("seed,n,words,turns,range_bytes,run_rows", [(1, 5, 2, 3, 1 << 20, 100), (2, 400, 2, 9, 700, 7), (3, 600, 5, 5, 5000, 50), (4, 300, 1, 60, 900, 3), (5, 900, 3, 8, 1 << 20, 1000)])
def test_trie_equals_plain_one(spark, seed, n, words, turns, range_bytes, run_rows):
    rows = talks(seed, n, words, turns)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(pt.query(df, range_bytes, run_rows)) == plain(rebuild(rows))


def test_hot_conversations_nulls_and_ties(spark):
    rows = [(c, t, "user", f"hello {t}") for c in range(0, 300) for t in range(4)] + talks(8, 40, 3)
    rows += [(None, 1, "user", "x"), (7000, None, None, None), (7000, 1, "user", "b"), (7000, 1, "user", "a"), (7000, 1, "user", "a"), (7001, 5, "u", "漢 字 x\x0by"), (7021, 0, "r", "long " * 400000), (9001, 0, None, "only")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{SCHEMA}, seq string, depth int")
    for size in (300, 1 << 20):
        assert got(pt.query(df, size, 11)) == plain(rebuild(rows))
    assert pt.query(df.limit(0)).collect() == []


def test_borders_are_shared_prefixes(spark):
    """Ranges cut inside a long common start: shared nodes are as deep as that."""
    rows = [(c, t, "user", "same" if t < 30 else f"{c} {t}") for c in range(0, 900, 20) for t in range(33)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(pt.query(df, 3000, 5)) == plain(rebuild(rows))


def test_merge_does_not_compare_shared_turns_again():
    r, seqs = random.Random(4), set()
    while len(seqs) < 2000:
        seqs.add(b"".join(bytes([0 if d < 40 else r.randrange(3)] * pt.TURN) for d in range(40 + r.randrange(1, 10))))
    seqs, runs = list(seqs), []
    for i in range(0, 2000, 130):
        run, last, coded = sorted(seqs[i : i + 130]), b"", []
        for s in run:
            coded.append((pt.shared_turns(last, s), (s,)))
            last = s
        runs.append(iter(coded))
    looked = []
    out = list(pt.Merge(runs, looked.append))
    assert [s for _, (s,) in out] == sorted(seqs)
    assert [n for n, _ in out[1:]] == [pt.shared_turns(a, b) for a, b in zip(sorted(seqs), sorted(seqs)[1:], strict=False)]
    # a comparison from the start would look at over 40 turns in each of some 8,000 matches
    assert sum(looked) < 40000
    assert list(pt.Merge([])) == [] and [x for _, (x,) in pt.Merge([iter([(0, (b"",))])])] == [b""]
