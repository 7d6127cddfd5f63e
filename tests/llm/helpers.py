"""Fixtures and plain reference computations for the tests of this folder."""

import random
import re
from collections import defaultdict

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "Été", "naïve", "x1"]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}{r.choice(WORDS)}" for _ in range(n))


def docs_of(texts, first=1):
    """Rows of documents; some have columns that are null."""
    return [(first + i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, len(t) if t is not None and i % 7 else None) for i, t in enumerate(texts)]


def odd_texts():
    long = prose(99, 4000)
    return [None, "", " \n\t ", "a", "!!!", "one two three", long, long, long + " tail", "x" * 70000, "漢字かな交じり文 " * 40, "same text here now again", "same text here now again", "Same TEXT here now again", "\x00\x01 nul"]


def odd_docs(spark, clash=("n_words", "score", "piece", "made", "secrets", "winnowed", "row_number", "component_id")):
    """Odd texts with null and repeated ids, repeated rows, and columns named as operators name theirs."""
    rows = docs_of(odd_texts())
    rows += [(None, "no id at all", None, None, None), (None, None, None, None, None), rows[5], rows[5], (3, "another row of id three", "fr", "s", 1)]
    extra = ", ".join(f"{c} string" for c in clash)
    return spark.createDataFrame([(*r, *("old" for _ in clash)) for r in rows], f"{DOC_SCHEMA}, {extra}")


def shingle_set(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def component_ids(rows, percent=80):
    """Smallest linked id of each row (id, text), by comparing all sets that share a shingle."""
    sets = [shingle_set(t) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    pairs = {(a, b) for h in holders.values() for i, b in enumerate(h) for a in h[:i]}
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        k = len(sets[a] & sets[b])
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            parent[find(b)] = find(a)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(rows))], [len(s) for s in sets]
