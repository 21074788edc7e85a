"""Words of many texts at once, as spans of one UTF-8 buffer, and their hashes.

Tasks get texts as Arrow batches. Working on the batch's own buffer keeps the
cost of a word at a few array operations instead of a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes looked at in one go. Bounds a task's memory whatever the batch.
SLICE_BYTES = 2 << 20
WINDOW = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WORD_MULTIPLIERS = np.array([pow(int(0xD6E8FEB86659FD93), k, 1 << 64) for k in range(1, 33)], dtype=np.uint64)

WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if n > len(_powers):
        size = max(n, WINDOW + 1)
        for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            globals()[name] = np.multiply.accumulate(table)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most limit bytes of text each, one row at least."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    total, start = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            total, start = 0, i
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each row starts and ends; null counts as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[ends[0]:ends[-1]], ends - ends[0]


def spans(data: np.ndarray, rows: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes marked inside that lie in one row: starts, ends, and the first run of each row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(rows), np.int64)
    first = np.zeros(n + 1, dtype=bool)
    first[rows] = True  # a run ends with its row
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, rows)


def words(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words are what ASCII white space (0x20, 0x09 to 0x0D) separates."""
    return spans(data, rows, ~WHITE[data])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes; spans are in order and do not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + WINDOW, "right")))
        part = data[low:ends[j - 1]]
        _grow(len(part) + 1)
        running = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _powers[:len(part)], out=running[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (running[e] - running[s]) * _inverses[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words in each row, and where each row's begin.

    first has one entry per row and the number of words at the end. A row of
    one to n - 1 words has one shingle, all its words; a row of none has none.
    """
    counts = np.diff(first)
    short = (counts > 0) & (counts < n)
    made = np.where(short, 1, np.maximum(counts - n + 1, 0))
    begins = np.concatenate(([0], np.cumsum(made)))
    out = np.zeros(begins[-1], dtype=np.uint64)
    row = np.repeat(np.arange(len(counts)), made)
    at = first[:-1][row] + (np.arange(len(out)) - begins[:-1][row])
    left = np.minimum(counts[row], n)
    for k in range(n):
        there = left > k
        out[there] += hashes[at[there] + k] * _WORD_MULTIPLIERS[k]
    return mix(out + left.astype(np.uint64)), begins


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending within it, and where each text's begin."""
    data, rows = buffer_of(column)
    starts, ends, first = words(data, rows)
    made, begins = shingles(span_hashes(data, starts, ends), first, n)
    row = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    order = np.lexsort((made, row))
    made, row = made[order], row[order]
    new = np.ones(len(made), dtype=bool)
    new[1:] = (made[1:] != made[:-1]) | (row[1:] != row[:-1])
    return made[new], np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=len(begins) - 1))))
