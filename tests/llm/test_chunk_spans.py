"""Chunks and spans of op10 against plain forms of both and against the texts themselves."""

import random

import numpy as np
import pyarrow as pa
import xxhash

from linkscope.llm import common, gear_chunks
from tests.llm.helpers import prose

SCHEMA = "doc_id long, text string"


def plain_ends(raw):
    """Ends of the chunks of one text, byte by byte."""
    h, hashes = 0, []
    for b in raw:
        h = ((h << 1) + int(gear_chunks.GEAR[b])) % (1 << gear_chunks.WINDOW)
        hashes.append(h)
    ends, last, r = [], 0, gear_chunks.REACH
    for i, x in enumerate(hashes):
        natural = all(x < y for y in hashes[max(0, i - r) : i]) and all(x <= y for y in hashes[i + 1 : i + 1 + r])
        if natural or i + 1 == len(raw) or i + 1 - last == gear_chunks.MOST:
            ends.append(i + 1)
            last = i + 1
    return ends


def plain_runs(raw, least):
    """(digest, start, end, words before, words up to the end) of the shortest run of so many words from each chunk on."""
    ends = plain_ends(raw)
    words = lambda n: sum(c not in b" \t\n\v\f\r" and (i == 0 or raw[i - 1] in b" \t\n\v\f\r") for i, c in enumerate(raw[:n]))
    count = {e: words(e) for e in [0, *ends]}
    out = []
    for i, start in enumerate([0, *ends[:-1]]):
        for end in ends[i:]:
            if count[end] - count[start] >= least or end - start >= least * gear_chunks.WORD_BYTES:
                out.append((xxhash.xxh3_128_digest(raw[start:end]), start, end, count[start], count[end]))
                break
    return out


def plain_spans(docs):
    """Spans of all documents (id, text) with dictionaries."""
    holders, every = {}, {}
    for d, text in docs:
        every[d] = plain_runs(text.encode(), gear_chunks.RUN_WORDS)
        for digest, *_ in every[d]:
            holders.setdefault(digest, set()).add(d)
    out = set()
    for d, found in every.items():
        by_holder = {}
        for digest, start, end, before, after in found:
            if len(holders[digest]) > 1:
                low = min(holders[digest])
                spans = by_holder.setdefault((low, max(holders[digest]) if low == d else None), [])
                if spans and start <= spans[-1][1]:
                    spans[-1][1:] = [max(end, spans[-1][1]), spans[-1][2], max(after, spans[-1][3])]
                else:
                    spans.append([start, end, before, after])
        for (low, _), spans in by_holder.items():
            out |= {(d, a, b, y - x, low, low == d) for a, b, x, y in spans if y - x >= gear_chunks.MIN_WORDS or b - a >= gear_chunks.MIN_WORDS * gear_chunks.WORD_BYTES}
    return out


def rows_of(spark, docs):
    return sorted(tuple(r) for r in gear_chunks.repeated_spans(spark.createDataFrame(docs, SCHEMA)).collect())


def shared_texts(n, seed=4):
    r, passages = random.Random(seed), [prose(9000 + i, r_n, 10**6) for i, r_n in enumerate([51, 60, 24, 90, 51, 12])]
    texts = []
    for i in range(n):
        parts = [prose(i * 7 + k, r.randrange(0, 50), 10**6) for k in range(3)]
        for p in r.sample(passages, r.randrange(0, 3)):
            parts.insert(r.randrange(len(parts) + 1), p)
        texts.append(r.choice([" ", "\n", " é "]).join(parts))
    return [*texts, texts[0], "z" * 3000, "ab " * 900, "漢字かな" * 90, "x 漢字かな" * 60]


def test_chunks_are_those_of_the_plain_hash():
    texts = [None, "", *shared_texts(12), "a", "\n"]
    for block in (texts, texts[::-1], texts[3:9]):
        found = gear_chunks.run_batch(pa.array(block), 0)
        for i, t in enumerate(block):
            raw = (t or "").encode()
            own = [(a, a + n) for a, n in zip(found[2][i].as_py(), found[3][i].as_py(), strict=True)]
            ends = plain_ends(raw)
            assert own == list(zip([0, *ends][:-1], ends, strict=True))


def test_chunks_are_a_function_of_the_text(monkeypatch):
    texts = shared_texts(40)
    alone = [[c[0].as_py() for c in gear_chunks.run_batch(pa.array([t]), gear_chunks.RUN_WORDS)] for t in texts]
    behind = gear_chunks.run_batch(pa.array([x for t in texts for x in ("before it", t)]), gear_chunks.RUN_WORDS)
    backwards = gear_chunks.run_batch(pa.array(texts[::-1]), gear_chunks.RUN_WORDS)
    monkeypatch.setattr("linkscope.llm.text_kernel.blocks.__defaults__", (500,))
    small = gear_chunks.run_batch(pa.array(texts), gear_chunks.RUN_WORDS)
    for i, own in enumerate(alone):
        assert own == [c[2 * i + 1].as_py() for c in behind] == [c[len(texts) - 1 - i].as_py() for c in backwards] == [c[i].as_py() for c in small]


def test_spans_against_plain_form(spark):
    docs = list(enumerate(shared_texts(50)))
    expected = sorted(plain_spans(docs))
    assert len({r[0] for r in expected}) > 20
    assert rows_of(spark, docs) == rows_of(spark, docs[::-1]) == expected


def test_hot_runs_are_dealt_over_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 10**6)  # so every repeated digest counts as hot
    docs = list(enumerate(shared_texts(30)))
    assert rows_of(spark, docs) == sorted(plain_spans(docs))


def test_texts_over_a_block(spark):
    passage = prose(5, 80, 10**6)
    docs = [(1, f"{prose(1, 130000, 10**7)} {passage} {prose(2, 20000, 10**7)}"), (2, f"{prose(3, 9, 10**6)} {passage}"), (3, prose(4, 150000, 10**8))]
    assert len(docs[0][1]) > 1 << 20
    out = rows_of(spark, docs)
    assert [(r[0], r[4]) for r in out] == [(1, 1), (2, 1)] and all(r[3] > 50 for r in out)


def test_ids_of_text_and_equal_ids(spark):
    p = prose(7, 60, 10**6)
    rows = [("a", p), ("b", f"{prose(8, 30, 10**6)} {p}"), ("a", p), ("a", f"{prose(9, 40, 10**6)} {p}"), (None, p), ("c", f"{p} {prose(11, 5)}")]
    out = gear_chunks.repeated_spans(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {(r.doc_id, r.first_doc_id, r.is_first) for r in out} == {("a", "a", True), ("b", "a", False), ("c", "a", False)}
    assert len([r for r in out if r.doc_id == "a"]) == 2  # one for each different text of that id


def test_chunks_that_recur_apart_make_no_span(spark):
    """The neighbouring chunks of the first text recur each in another document, so no other document holds 20 words of it."""
    text = prose(1, 120, 10**6)
    raw, ends = text.encode(), plain_ends(text.encode())
    parts = [raw[a:b].decode(errors="ignore") for a, b in zip(ends, ends[2:], strict=False)]
    docs = [(0, text)] + [(i, f"{prose(100 + i, 60, 10**6)} {p} {prose(5000 + i, 60, 10**6)}") for i, p in enumerate(parts, 1)]
    assert rows_of(spark, docs) == []


def test_first_document_holds_the_span(spark):
    a, b, c = (prose(i, 60, 10**6) for i in (11, 12, 13))
    docs = [(1, f"{prose(21, 30, 10**6)} {a} {prose(22, 30, 10**6)}"), (2, f"{prose(23, 30, 10**6)} {a} {b} {c}"), (3, f"{prose(24, 30, 10**6)} {b} {c}"), (4, f"{a} {b} {c}")]
    texts = {i: t.encode() for i, t in docs}
    out = gear_chunks.repeated_spans(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {r.doc_id for r in out} == {1, 2, 3, 4}
    for r in out:
        part = texts[r.doc_id][r.start : r.end]
        assert part in texts[r.first_doc_id] and any(part in t for i, t in texts.items() if i != r.doc_id)
        assert r.is_first == (r.doc_id == r.first_doc_id)
    for i in texts:  # the passages are covered but for chunks at their edges
        covered = {x for r in out if r.doc_id == i for x in range(r.start, r.end)}
        for p in (a, b, c):
            at = texts[i].find(p.encode())
            assert at < 0 or sum(x in covered for x in range(at, at + len(p))) > len(p) - 200


def test_chunks_cover_texts_and_resist_shifts():
    text = prose(3, 900)
    other = "inserted " + text[:2000] + "more" + text[2000:]
    out = gear_chunks.run_batch(pa.array([text, other, "z" * 2000]), 0)
    lengths = [np.array(out[3][i].as_py()) for i in range(3)]
    for i, t in enumerate((text, other)):
        assert out[2][i].as_py() == np.r_[0, np.cumsum(lengths[i])[:-1]].tolist() and lengths[i].sum() == len(t.encode())
    a, b = (set(zip(out[0][i].as_py(), out[1][i].as_py(), strict=True)) for i in (0, 1))
    assert len(a & b) >= len(a) - 8 and lengths[2].max() <= gear_chunks.MOST
