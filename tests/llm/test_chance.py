"""Documents that share passages by chance, none enough for a link, are not brought together in many cells."""

import random

import pytest

from linkscope.llm import jaccard_join


def corpus(n):
    dice = random.Random(3)
    passages = [" ".join(f"p{i}x{k}" for k in range(5)) for i in range(4000)]
    texts = []
    for i in range(n):
        texts.append(" ".join(f"own{i}w{k} " + (dice.choice(passages) if k % 2 == 0 else "") for k in range(300)))
    # and some near copies
    return texts + [t.replace(f"own{i}w7 ", f"other{i} ") for i, t in enumerate(texts[:20])]


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.mark.parametrize("n", [150])
def test_texts_go_to_few_cells(spark, monkeypatch, n):
    texts, made, was = corpus(n), [], jaccard_join.cut

    def cut(df):
        out = was(df)
        if "small" in df.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "cut", cut)
    # as where the sample is a small part of all texts, no passage is known to be common
    monkeypatch.setattr(jaccard_join, "SAMPLE", 0)
    got = {r.doc_id: r.component_id for r in jaccard_join.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [shingles(t) for t in texts]
    linked = {(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(linked) == 20 and got == {i: min([b for a, b in linked if a == i], default=i) for i in range(len(texts))}
    assert made[0] < 2 * len(texts)
