"""Token counts by rank-synchronous array merging.

Texts are cut where no merge of the vocabulary can reach across: before every run of the
space mark, and around characters that occur in no longer piece.  The distinct pre-tokens of a batch are
held as one ragged array of symbols.  In each round every sequence looks up the ranks of its adjacent
pairs and merges its lowest-ranked pair, wherever it occurs, at once in all sequences.
If a merge makes a pair of better rank than its own, later occurrences could have been merged
otherwise; such a sequence takes back the round and merges its leftmost occurrence only, which is
the order the library keeps.  When no sequence has a pair left, the surviving symbols
are counted; a character that is no piece counts its UTF-8 bytes.

Defined cases: a null text is empty and has 0 bytes and tokens; special strings in a text are
plain text; an empty table gives no rows; repeated rows give a row each; null ids pass through; texts of
any length are counted whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkscope.llm.common import annotate, fresh

MARK = "▁"
#: Most texts' characters that are split at once, and pre-tokens whose counts a worker keeps.
BATCH_CHARS, KEPT = 1 << 21, 800_000
LIMIT = 4096

FIELDS = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
_NO_RANK = np.int64(1) << 60


class Merger:
    """Merge ranks of a piece vocabulary; smaller ranks merge first."""

    def __init__(self, pieces: list[tuple[str, float]]):
        """pieces: mergeable strings with their scores, the highest score merging first."""
        order = sorted({p for p, _ in pieces})
        score = dict(pieces)
        self.id = {p: i for i, p in enumerate(order)}
        self.known = len(order)
        rank = {p: r for r, p in enumerate(sorted(order, key=lambda p: (-score[p], p)))}
        by_score = {}
        for p in order:
            by_score.setdefault(score[p], rank[p])
        keys, made = [], []
        for p in order:
            for cut in range(1, len(p)):
                a, b = self.id.get(p[:cut]), self.id.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(self.id[p])
        self.rank = np.array([by_score[score[p]] for p in order] + [_NO_RANK], dtype=np.int64)  # the last for no pair
        self.of_char = np.full(0x110000, -1, dtype=np.int64)
        for p, i in self.id.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.keys, self.made = np.uint64(64 - bits), np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int64)
        self.probes = 1
        for k, m in zip(keys, made, strict=True):
            slot, n = (k * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - bits), 1
            while self.keys[slot] != -1:
                slot, n = (slot + 1) % (1 << bits), n + 1
            self.keys[slot], self.made[slot] = k, m
            self.probes = max(self.probes, n)
        longer = {c for p in order if len(p) > 1 for c in p}
        #: these never merge with a neighbour
        self.alone = sorted({"\n", "\t", "\r"} - longer)
        lone = "".join(map(re.escape, self.alone))
        self.split = re.compile(f"{MARK}*[^{MARK}{lone}]+|{MARK}+|[{lone}]" if lone else f"{MARK}*[^{MARK}]+|{MARK}+").findall

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id of the piece that each pair makes, -1 for none."""
        key = a << 32 | b
        slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        out = np.full(len(key), -1, dtype=np.int64)
        open_, mask = np.arange(len(key)), len(self.keys) - 1
        for _ in range(self.probes):
            there = self.keys[slot]
            hit = there == key[open_]
            out[open_[hit]] = self.made[slot[hit]]
            more = ~hit & (there != -1)
            if not more.any():
                break
            open_, slot = open_[more], slot[more] + 1 & mask
        return out

    def counts(self, tokens: list[str]) -> np.ndarray:
        """Number of symbols that survive in each of the strings."""
        points = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        symbol = self.of_char[points]
        unknown = np.flatnonzero(symbol < 0)
        weight = np.ones(len(symbol), dtype=np.int64)
        if len(unknown):  # ids beyond the pieces, and the bytes as weight
            code = points[unknown].astype(np.int64)
            symbol[unknown] = self.known + code
            weight[unknown] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        size = np.array([len(t) for t in tokens], dtype=np.int64)
        owner = np.repeat(np.arange(len(tokens)), size)
        total = np.zeros(len(tokens), dtype=np.int64)
        pair = np.full(len(symbol), -1, dtype=np.int64)
        same = np.flatnonzero(owner[1:] == owner[:-1])
        pair[same] = self.merged(symbol[same], symbol[same + 1])
        rank = self.rank[pair]
        while len(symbol):
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            length = np.diff(np.r_[start, len(symbol)])
            best = np.minimum.reduceat(rank, start)
            done = best == _NO_RANK
            if done.any():  # finished sequences leave
                total[owner[start[done]]] = np.add.reduceat(weight, start)[done]
                stay = np.repeat(~done, length)
                symbol, weight, owner, pair, rank = symbol[stay], weight[stay], owner[stay], pair[stay], rank[stay]
                best, length = best[~done], length[~done]
                if len(symbol) == 0:
                    break
            low = np.repeat(best, length)
            at = self._apart(np.flatnonzero(rank == low))
            state = self._apply(symbol, weight, owner, pair, rank, low, at)
            if state[-1] is not None:  # leftmost merges only in the sequences that another order could change
                seq = owner[at]
                at = at[np.r_[True, seq[1:] != seq[:-1]] | ~np.isin(seq, state[-1])]
                state = self._apply(symbol, weight, owner, pair, rank, low, at)
            symbol, weight, owner, pair, rank = state[:5]
        return total

    @staticmethod
    def _apart(at: np.ndarray) -> np.ndarray:
        """From runs of neighbouring places every second one, the first included."""
        run = np.r_[True, at[1:] != at[:-1] + 1]
        first = np.maximum.accumulate(np.where(run, at, 0))
        return at[(at - first) % 2 == 0]

    def _apply(self, symbol, weight, owner, pair, rank, low, at):
        """The arrays after the merges at the given places, and the sequences with several merges of which
        one has made a pair that ranks better than they do."""
        keep = np.ones(len(symbol), dtype=bool)
        keep[at + 1] = False
        new = symbol.copy()
        new[at] = pair[at]
        place = at - np.arange(len(at))  # one symbol is gone for each merge before
        new, weight, who, pair, rank = new[keep], weight[keep], owner[keep], pair[keep], rank[keep]
        redo = np.concatenate([place, place[place > 0] - 1])
        last = redo == len(new) - 1
        ahead = np.where(last, redo, redo + 1)
        apart = last | (who[redo] != who[ahead])
        made = self.merged(new[redo], new[ahead])
        made[apart] = -1
        pair[redo] = made
        rank[redo] = self.rank[made]
        clash = None
        seq = owner[at]
        if (seq[1:] == seq[:-1]).any():
            better = who[redo[self.rank[made] < low[keep][redo]]]
            several = seq[1:][seq[1:] == seq[:-1]]
            clash = np.intersect1d(better, several)
            clash = clash if len(clash) else None
        return new, weight, who, pair, rank, clash


_mergers: dict[str, tuple[Merger, dict[str, int]]] = {}


def merger_of(path: str) -> tuple[Merger, dict[str, int]]:
    """The merger of a piece model file and this worker's counts of pre-tokens."""
    if path not in _mergers:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        pieces = [(model.id_to_piece(i), model.get_score(i)) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        _mergers[path] = Merger(pieces), {}
    return _mergers[path]


def forget() -> None:
    for _, known in _mergers.values():
        known.clear()


def count_texts(path: str, texts: Iterable[str]) -> list[int]:
    merger, known = merger_of(path)
    lists = [merger.split(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
    missing = list(set().union(*lists) - known.keys())
    for i in range(0, len(missing), 1 << 13):
        part = missing[i : i + (1 << 13)]
        known.update(zip(part, merger.counts(part).tolist(), strict=True))
    out = [sum(map(known.__getitem__, x)) for x in lists]
    if len(known) > KEPT:
        known.clear()
    return out


def count_batch(path: str, texts: pa.Array) -> list:
    rows = texts.to_pylist()
    n_tokens, part, size = [], [], 0
    for t in rows:
        part.append(t or "")
        size += len(part[-1])
        if size >= BATCH_CHARS:
            n_tokens += count_texts(path, part)
            part, size = [], 0
    n_tokens += count_texts(path, part)
    import pyarrow.compute as pc

    return [pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), pa.array(n_tokens, pa.int64())]


def count(docs: DataFrame, path: str, text: str = "text", into: str = "tokens") -> DataFrame:
    """docs with a struct column of n_bytes and n_tokens; path: a piece model file that every executor has."""
    return annotate(docs, text, lambda texts: count_batch(path, texts), FIELDS, into, forget)


def query(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    docs = docs.select("doc_id", "text")
    into = fresh("tokens", docs.columns)
    return count(docs, path, into=into).select("doc_id", f"{into}.n_bytes", f"{into}.n_tokens", (F.col(f"{into}.n_tokens") > limit).alias("over_limit"))
