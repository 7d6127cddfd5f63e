"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words is the product of their weights on all letter triples that occur in order, gaps allowed:
a triple weighs DECAY to the power of the stretch it spans, at most SPAN letters.  An insult with letters left
out or put between keeps most of its triples, so it stays near its landmark.  Landmarks are
words of the training texts; a word is represented by its kernel values with them, whitened by
the inverse root of the landmarks' own kernel matrix (Nyström), and a linear support vector
machine separates these.  A text's words are its sentence's instances: the sentence scores
by its two worst words, and training moves between picking each toxic text's worst word and
fitting the machine (multiple-instance training).  Because the kernel has an explicit map, the machine
folds into one weight per triple, so a word costs its triples, not its landmarks.

A unit is a run of non-blanks in lower case, punctuation inside kept as a gap; units over LONGEST letters are cut
into overlapping ones, and single letters with blanks between are also read as one unit.

Letters of all scripts take part: Latin ones with and without accents, and full-width and other shapes of them, as
themselves, those of other scripts in OTHERS classes by code.

Fitted on a sample by hash of about SAMPLE labelled texts and SAMPLE_BYTES bytes at most (expected numbers; the one
bound of this operator), each used whole; scores cover every unit of every text.

Defined cases: a null, empty or letterless text scores 0; with labels of one class alone the
score is 0 or 1 throughout, without labels 0; contradictory labels of a document count as their maximum; ties do not
matter; repeated rows give a row each; a null id is not held out; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkscope.llm.common import annotate, fresh, hash_share, small_batches

DECAY, SPAN, LONGEST = 0.7, 7, 24
LANDMARKS, SAMPLE, SAMPLE_BYTES = 192, 5000, 32 << 20
THRESHOLD = 0.3
#: Words of each kind that stand against the toxic ones in a round, rounds, cost of a toxic text's error,
#: and toxic words whose misspellings are learnt too.
HARD, ROUNDS, COST, VARIED = 1500, 5, 10.0, 40
#: Margins below this count as this in the logistic.
LOWEST = 0.0
KEPT, BATCH_CHARS = 200_000, 1 << 20
#: Letters: 26 plain, ACCENTED with their accents, all others in OTHERS classes by their code, and a word's two borders; 0 is a gap.
ACCENTED, OTHERS = "àáâãäåçèéêëìíîïñòóôõöøùúûüßœæ", 37
ALPHABET = 27 + len(ACCENTED) + OTHERS + 2

FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType())]
MODEL = "weight binary, bias double, logistic array<double>"
_SPELLED = re.compile(r"(?<!\S)(?:\w[^\w\s]*\s+){3,}\w[^\w\s]*(?!\S)")


def _letter_table() -> np.ndarray:
    """Code point to letter; letters with accents not listed, and other shapes of plain ones, count as their base."""
    table = np.zeros(1 << 16, dtype=np.int64)
    for c in range(len(table)):
        low = chr(c).lower()[:1]
        if not low.isalpha():
            continue
        base = unicodedata.normalize("NFKD", low)[:1].lower()
        if low in ACCENTED:
            table[c] = 27 + ACCENTED.index(low)
        elif "a" <= base <= "z":
            table[c] = ord(base) - 96
        else:
            table[c] = 27 + len(ACCENTED) + ord(low) % OTHERS
    return table


_LETTER = _letter_table()


def letters(points: np.ndarray) -> np.ndarray:
    """Letter of each code point; past the first plane the ideographs count."""
    out = _LETTER[np.where(points < len(_LETTER), points, 0)]
    far = points >= 0x20000
    if far.any():
        out[far] = 27 + len(ACCENTED) + points[far] % OTHERS
    return out


def letter_runs(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all units as numbers in one array, and each unit's start and length there, outer non-letters left out."""
    size = np.array([len(u) for u in units], dtype=np.int64)
    points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = letters(points)
    inner = np.flatnonzero(out)
    ends = np.cumsum(size)
    first = np.searchsorted(inner, ends - size)
    last = np.searchsorted(inner, ends) - 1
    some = last >= first
    start = np.where(some, inner[np.minimum(first, len(inner) - 1)] if len(inner) else 0, 0)
    stop = np.where(some, inner[np.maximum(last, 0)] + 1 if len(inner) else 0, 0)
    return out, start, stop - start


def _triples(n: int) -> np.ndarray:
    return np.array([(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + SPAN + 1))], dtype=np.int64).reshape(-1, 3)


PLACES = {n: _triples(n) for n in range(LONGEST + 3)}


def triples(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Triple codes of words of one length (rows) and their weights, of squares that sum to one; a triple with a gap weighs 0."""
    at = PLACES[words.shape[1]]
    code = (words[:, at[:, 0]] * ALPHABET + words[:, at[:, 1]]) * ALPHABET + words[:, at[:, 2]]
    weight = np.broadcast_to(DECAY ** (at[:, 2] - at[:, 0] - 2), code.shape)
    if not words.all():
        weight = np.where((words[:, at] > 0).all(2), weight, 0.0)
    norm = np.sqrt((weight**2).sum(1, keepdims=True))
    return code, weight / np.where(norm > 0, norm, 1)


def by_length(units: list[str]):
    """(indexes, matrix of letters) of the units of each length; one over LONGEST gives overlapping stretches."""
    if not units:
        return
    out, start, length = letter_runs(units)
    index = np.arange(len(units))
    for i in np.flatnonzero(length > LONGEST).tolist():
        more = np.arange(0, length[i] - LONGEST // 2, LONGEST // 2)
        index = np.append(index, np.full(len(more), i))
        start = np.append(start, start[i] + more)
        length = np.append(length, np.minimum(LONGEST, length[i] - more))
        length[i] = 0
    for n in np.unique(length[length > 0]).tolist():  # a unit without a letter is none
        at = np.flatnonzero(length == n)
        for i in range(0, len(at), 2048):
            part = at[i : i + 2048]
            words = np.zeros((len(part), n + 2), dtype=np.int64)
            words[:, 0], words[:, -1] = ALPHABET - 2, ALPHABET - 1
            words[:, 1:-1] = out[start[part, None] + np.arange(n)]
            yield index[part], words


def dense(units: list[str]) -> np.ndarray:
    out = np.zeros((len(units), ALPHABET**3), dtype=np.float32)
    for at, words in by_length(units):
        code, weight = triples(words)
        np.add.at(out, (at[:, None], code), weight)
    return out


def units_of(text: str) -> list[str]:
    low = text.lower()
    out = low.split()
    if spelled := _SPELLED.findall(low):
        out += ["".join(re.findall(r"\w", s)) for s in spelled]
    return out


class Model:
    """A folded machine: a weight for each triple and a bias; and the logistic of a text's two highest margins."""

    def __init__(self, weight: np.ndarray, bias: float, logistic: np.ndarray):
        self.weight, self.bias, self.logistic = weight, bias, logistic

    def margins(self, units: list[str]) -> np.ndarray:
        out = np.full(len(units), self.bias)
        low = np.full(len(units), -np.inf)
        for at, words in by_length(units):
            code, weight = triples(words)
            np.maximum.at(low, at, (self.weight[code] * weight).sum(1))
        return out + low

    def score(self, top: np.ndarray) -> np.ndarray:
        """Scores of texts from their two highest margins (rows)."""
        some = np.isfinite(top[:, 0])
        raw = np.clip(np.where(np.isfinite(top), top, LOWEST), LOWEST, None) @ self.logistic[:2] + self.logistic[2]
        return np.where(some, 1 / (1 + np.exp(-np.clip(raw, -60, 60))), 0.0)


def top_two(values: list[float]) -> tuple[float, float]:
    if not values:
        return -np.inf, -np.inf
    first = max(values)
    values.remove(first)
    return first, max(values, default=-np.inf)


def constant(value: float) -> Model:
    return Model(np.zeros(ALPHABET**3, dtype=np.float32), 0.0, np.array([0.0, 0.0, 60.0 if value else -60.0]))


def squared_hinge(x: np.ndarray, y: np.ndarray, c: np.ndarray, start: np.ndarray | None = None, ridge: float = 1.0) -> np.ndarray:
    """Weights (the last is the bias) of the machine, by Newton steps on the squared hinge loss."""
    x = np.concatenate([x, np.ones((len(x), 1), dtype=x.dtype)], axis=1)
    w = np.zeros(x.shape[1]) if start is None else start
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-3
    for _ in range(30):
        active = y * (x @ w) < 1
        xa = x[active] * c[active, None]
        new = np.linalg.solve(penalty + xa.T @ x[active], xa.T @ y[active])
        if np.abs(new - w).max() < 1e-6:
            return new
        w = new
    return w


def logistic(top: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the two highest margins and the shift, fitted to the labels; targets kept off 0 and 1."""
    n1, n0 = int(y.sum()), int((1 - y).sum())
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.concatenate([np.clip(top, LOWEST, None), np.ones((len(top), 1))], axis=1)
    w = np.array([1.0, 0.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve(x.T @ (x * v[:, None]) + np.diag([0.1, 0.1, 1e-3]), x.T @ (p - target) + np.array([0.1, 0.1, 0]) * w)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return np.r_[np.maximum(w[:2], 0), w[2]]


def fit(texts: list[str], labels: list[int]) -> Model:
    """Landmarks, machine and logistic from a bounded number of labelled texts."""
    y = np.array([1 if v else 0 for v in labels], dtype=np.int64)
    if len(y) == 0 or y.min() == y.max():
        return constant(float(len(y) and y[0]))
    seen: dict[str, int] = {}
    of_text = [np.array(sorted({seen.setdefault(u, len(seen)) for u in units_of(t)}), dtype=np.int64) for t in texts]
    words = list(seen)
    count = np.zeros((2, len(words)))
    for own, v in zip(of_text, y.tolist(), strict=True):
        count[v, own] += 1
    share = (count + 0.1) / np.array([[(1 - y).sum()], [y.sum()]])
    odds = np.log(share[1] / share[0])
    spread = np.array([hash_of(u) for u in words], dtype=np.uint64)
    usable = letter_runs(words)[2] > 1 if words else np.zeros(0, bool)
    # landmarks: the words most typical of toxic texts, the commonest words, and others by hash
    order = [np.lexsort((spread, -odds * count[1])), np.lexsort((spread, -count.sum(0))), np.argsort(spread)]
    chosen = list(dict.fromkeys(i for o, n in zip(order, (LANDMARKS // 2, LANDMARKS // 4, LANDMARKS // 4), strict=True) for i in o[usable[o]][:n].tolist()))
    if not chosen:
        return constant(0.0)
    # of all triples only those that landmarks have count: they get a row each, the others share one of zeros
    named = [words[i] for i in chosen]
    codes = np.unique(np.concatenate([triples(m)[0].ravel() for _, m in by_length(named)]))
    row = np.full(ALPHABET**3, len(codes), dtype=np.int32)
    row[codes] = np.arange(len(codes))
    marks = np.zeros((len(named), len(codes) + 1))
    for at, matrix in by_length(named):
        code, weight = triples(matrix)
        np.add.at(marks, (at[:, None], row[code]), weight)
    values, vectors = np.linalg.eigh(marks @ marks.T)
    good = values > 1e-6 * values.max()
    fold = (marks.T @ (vectors[:, good] / np.sqrt(values[good]))).astype(np.float32)  # triples to Nyström coordinates
    toxic = [o for o, v in zip(of_text, y, strict=True) if v and len(o)]
    clean = np.flatnonzero(count[0] > 0)
    # words that are toxic by their company, and misspellings of them
    strong = np.flatnonzero(usable & (count[1] >= 3) & (odds > np.log(20)))
    top = strong[np.lexsort((spread[strong], -count[1, strong]))][:VARIED]
    varied = sorted({v for i in top.tolist() for v in misspelt(words[i])} - seen.keys())
    of_varied = np.arange(len(words), len(words) + len(varied))
    words += varied
    count = np.concatenate([count, np.zeros((2, len(varied)))], axis=1)
    pool = set(clean[np.argsort(-count[0, clean], kind="stable")[:HARD]].tolist()) | set(clean[np.argsort(spread[clean])[:HARD]].tolist())
    pool -= set(strong.tolist())
    value = np.where(usable, odds, -np.inf)
    place: dict[int, int] = {}
    z = np.zeros((0, fold.shape[1]), dtype=np.float32)
    w = None
    for _ in range(ROUNDS):
        # a toxic text shows its worst word, the clean ones their commonest and their worst
        worst = [int(o[np.argmax(value[o])]) for o in toxic]
        pool |= set(clean[np.argsort(-value[clean], kind="stable")[:HARD]].tolist()) - set(strong.tolist())
        new = [i for i in dict.fromkeys([*worst, *strong.tolist(), *of_varied.tolist(), *sorted(pool)]) if i not in place]
        place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
        more = np.zeros((len(new), fold.shape[1]), dtype=np.float32)
        for at, matrix in by_length([words[i] for i in new]):
            code, weight = triples(matrix)
            for i in range(0, len(at), 128):
                np.add.at(more, at[i : i + 128], np.einsum("nt,ntd->nd", weight[i : i + 128].astype(np.float32), fold[row[code[i : i + 128]]], optimize=True))
        z = np.concatenate([z, more])
        against = np.array(sorted(pool), dtype=np.int64)
        rows = [*worst, *strong.tolist(), *of_varied.tolist(), *against.tolist()]
        side = np.r_[np.ones(len(rows) - len(against)), -np.ones(len(against))]
        cost = np.r_[np.full(len(worst), COST), COST * np.sqrt(count[1, strong]), np.full(len(varied), COST / 5), 1 + count[0, against]]
        w = squared_hinge(z[[place[i] for i in rows]].astype(np.float64), side, cost, w)
        folded = np.zeros(ALPHABET**3, dtype=np.float32)
        folded[codes] = (fold @ w[:-1])[:-1]
        model = Model(folded, float(w[-1]), np.array([1.0, 0.0, 0.0]))
        value = np.concatenate([model.margins(words[i : i + 8192]) for i in range(0, len(words), 8192)])
    full = [i for i, o in enumerate(of_text) if len(o)]
    model.logistic = logistic(np.array([top_two(value[of_text[i]].tolist()) for i in full]), y[full])
    return model


def misspelt(word: str) -> list[str]:
    """A word with a letter doubled, with one put between, and with gaps; places and letters follow from the word."""
    core = "".join(re.findall(r"\w", word))
    if len(core) < 4:
        return []
    h = hash_of(core)
    i, j = 1 + h % (len(core) - 1), 1 + (h >> 20) % (len(core) - 1)
    return [core[:i] + core[i - 1] + core[i:], core[:j] + chr(97 + (h >> 40) % 26) + core[j:], ".".join(core), core[:i] + "*" + core[i:], core[:j] + "-" + core[j:]]


def hash_of(word: str) -> int:
    return int.from_bytes(word.encode("utf-8")[-8:], "little") * 0x9E3779B97F4A7C15 % (1 << 64)


_known: dict[int, dict[str, float]] = {}


def forget() -> None:
    _known.clear()


def score_batch(block: Broadcast, texts: pa.Array) -> list:
    token, model = block.value
    if token not in _known:
        _known.clear()
        _known[token] = {}
    known = _known[token]
    top: list[tuple[float, float]] = []

    def flush(part):
        lists = [set(units_of(t)) for t in part]
        missing = list(set().union(*lists) - known.keys())
        for i in range(0, len(missing), 8192):
            few = missing[i : i + 8192]
            known.update(zip(few, model.margins(few).tolist(), strict=True))
        top.extend(top_two(list(map(known.__getitem__, x))) for x in lists)
        if len(known) > KEPT:
            known.clear()

    part, size = [], 0
    for t in texts:
        part.append(t.as_py() or "")
        size += len(part[-1])
        if size >= BATCH_CHARS:
            flush(part)
            part, size = [], 0
    flush(part)
    margins = np.array(top)
    some = np.isfinite(margins[:, 0])
    return [pa.array(model.score(margins)), pa.array(np.where(some, margins[:, 0], 0.0), mask=~some)]


def fit_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows (id, text, label), as one row."""
    rows = [(r["id"], r["text"], r["label"]) for batch in batches for r in batch.to_pylist()]
    if rows:
        rows.sort(key=lambda r: r[:2])
        model = fit([r[1] for r in rows], [r[2] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([model.weight.astype(np.float32).tobytes()]), pa.array([model.bias]), pa.array([model.logistic.tolist()])], names=["weight", "bias", "logistic"])


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """The model from a bounded sample of the labelled documents; one task fits it, so the driver holds neither texts nor matrices."""
    known = labels.select(F.col(id).alias("id"), F.col(label).alias("label")).where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    own = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    size = own.select("id", F.octet_length("text").alias("size")).join(known, "id").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    few = known.where(hash_share("id") < min(1.0, SAMPLE / max(1, size["n"]), SAMPLE_BYTES / max(1, size["bytes"])))
    sample = own.join(F.broadcast(few), "id").select("id", "text", "label").distinct()
    small_batches(docs.sparkSession)
    made = sample.repartition(1).mapInArrow(fit_sample, MODEL).first()
    return constant(0.0) if made is None else Model(np.frombuffer(made["weight"], dtype=np.float32), made["bias"], np.array(made["logistic"]))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "toxicity") -> DataFrame:
    """docs with a struct column: score (0 to 1) and margin (null without a unit)."""
    block = docs.sparkSession.sparkContext.broadcast((hash(model.weight.tobytes()), model))
    return annotate(docs, text, lambda texts: score_batch(block, texts), FIELDS, into, forget)


def held_out(id: str, parts: int, part: int):
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % parts == part, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of production: labels of the held-out quarter are not looked at."""
    return train(docs.select("doc_id", "text"), labels.where(~held_out("doc_id", 4, 2)))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    into = fresh("toxicity", docs.columns)
    found = score(docs, trained(docs, labels), into=into)
    p = F.col(f"{into}.score")
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), p.alias("score"), (p >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the toxic ones, columns unchanged."""
    into = fresh("toxicity", docs.columns)
    return score(docs, trained(docs, labels), into=into).where(F.col(f"{into}.score") < THRESHOLD).drop(into)
