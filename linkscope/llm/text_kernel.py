"""Vectorised text kernels over Arrow string buffers.

One pass of numpy finds the words of a block of texts and hashes each of them,
so that no Python string is made for a word.  Blocks are cut to a bounded
number of bytes, and a text larger than that is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one block holds, unless a single text is longer.
BLOCK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _lower_table()


def word_class(gaps: list[tuple[int, int]]) -> np.ndarray:
    """Flags of the bytes that belong to words; gaps are inclusive byte ranges."""
    flags = np.ones(256, dtype=bool)
    for first, last in gaps:
        flags[first : last + 1] = False
    return flags


#: Words of op3: everything but ASCII that is neither digit nor letter.
ALNUM_WORDS = word_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: Words of op4: everything but ASCII white space.
SPACE_WORDS = word_class([(0x20, 0x20), (0x09, 0x0D)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX_B
    return x ^ (x >> np.uint64(31))


def coefficients(n: int) -> np.ndarray:
    """n odd 64-bit factors, one for each place in a run of words."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(21, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        steps = np.full(size, _BASE, dtype=np.uint64)
        back = np.full(size, _BASE_INVERSE, dtype=np.uint64)
        steps[0] = back[0] = 1
        _powers[size] = (np.multiply.accumulate(steps), np.multiply.accumulate(back))
    return _powers[size]


@dataclass
class Words:
    """Words of a block: hash, first byte and end byte of each, and each text's range of words."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    of_text: np.ndarray  # len(texts) + 1 word offsets
    data: np.ndarray  # lower-cased bytes of the block


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive blocks; a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # an empty or multi-chunk result
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if len(column) == 0:
        return
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1, offset=column.offset * 8)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(column))
        low, high = offsets[row], offsets[end]
        yield row, end, data[low:high], offsets[row : end + 1] - low
        row = end


def words(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> Words:
    """Lower-case A-Z, find the words of every text and hash each with a polynomial modulo 2**64."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64), data)
    low = LOWER[data]
    inside = in_word[low]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    ahead, back = _power_tables(n)
    value = low.astype(np.uint64)
    value += np.uint64(1)
    value *= ahead[:n]
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(value, out=total[1:])
    hashes = mix((total[ends] - total[starts]) * back[starts])
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets), low)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive words of the block, text borders not minded."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    factor = coefficients(n)
    total = hashes[:size] * factor[0]
    for j in range(1, n):
        total += hashes[j : j + size] * factor[j]
    return mix(total)


def sequence_hash(hashes: np.ndarray) -> int:
    """Hash of a whole sequence of words; equals grams() of that length."""
    return int(grams(hashes, len(hashes))[0])


def shingle_sets(found: Words, n: int) -> list[np.ndarray]:
    """Distinct n-word shingles of each text, sorted; a shorter text is one shingle, an empty one none."""
    every = grams(found.hashes, n)
    out = []
    for a, b in zip(found.of_text[:-1].tolist(), found.of_text[1:].tolist(), strict=True):
        if b - a >= n:
            own = np.sort(every[a : b - n + 1])
            keep = np.empty(len(own), dtype=bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif b > a:
            out.append(np.array([sequence_hash(found.hashes[a:b])], dtype=np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sliding(x: np.ndarray, window: int, of) -> np.ndarray:
    """of() over every window, by doubling."""
    size, done = 1, x
    while size * 2 <= window:
        done, size = of(done[:-size], done[size:]), size * 2
    return of(done[: len(x) - window + 1], done[window - size :]) if size < window else done
