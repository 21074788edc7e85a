"""Packing documents into windows of tokens by the sum-of-squares rule.

A document's full windows are cut off first; its rest is placed online. An
array holds how many windows are open at each fill level. The rest goes to the
level that makes the sum of the squared counts of partially filled windows
least, which is a lookup over the levels. A task holds a bounded number of
open windows. At the bound no window is opened, and a rest that fits in none
is cut at the end of the one at the most frequent level. When a task ends, the
pieces of its emptiest windows are placed in its others by the same rule, so
that it leaves one window with padding.

Each task packs the rows of its own partition as a stream; nothing is
shuffled, and a repeated task makes the same sequences.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from hangarlog.llm.frames import record
from hangarlog.llm.textbytes import WHITE, buffer_of, slices, span_hashes

END = 1
#: Windows open at a time in a task: 4 bytes an id, so 16 MB at the most.
MOST_OPEN = 2048
#: Pieces of text remembered by a task with their ids, and the bytes of the longest one.
CACHE_PIECES, CACHE_BYTES = 1 << 21, 48
_LETTER, _MARK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[[c for c in range(128) if chr(c).isalpha()]] = True
_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "|"]] = True  # not inside <|endoftext|>

PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                   ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))])


class PieceEncoder:
    """Token ids of texts, each distinct piece between spaces encoded once.

    The tokenizer splits a text before a space that is followed by a character
    that is not white space, and between a letter and a mark, so texts can be
    cut there without any change of ids. A cut is made only where the bytes
    beside it prove it.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.starts = np.zeros(0, dtype=np.int64)
        self.sizes = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a text column, and where each row's begin and end."""
        data, rows = buffer_of(column)
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(rows), np.int64)
        cut = np.zeros(n, dtype=bool)
        before, after = data[:-2], data[2:]
        cut[1:-1] = (data[1:-1] == 32) & np.where(after < 128, ~WHITE[after], (before < 128) & ~WHITE[before])
        # A mark after a letter begins a token, and so does a letter after a single line feed.
        cut[1:] |= _LETTER[data[:-1]] & _MARK[data[1:]]
        cut[2:] |= (data[:-2] < 128) & ~WHITE[data[:-2]] & (data[1:-1] == 10) & _LETTER[data[2:]]
        inner = rows[:-1][np.diff(rows) > 0]
        # A row's last byte saw the next row: a space there is no cut.
        last = rows[1:][np.diff(rows) > 0] - 1
        cut[last[data[last] == 32]] = False
        cut[inner] = True
        starts = np.flatnonzero(cut)
        ends = np.concatenate((starts[1:], [n]))
        hashes = span_hashes(data, starts, ends)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at, size, pool = self._lookup(data, starts[first], ends[first], hashes[first])
        sizes = size[which]
        stops = np.cumsum(sizes)
        out = pool[np.repeat(at[which] - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)]
        bounds = np.concatenate(([0], stops))
        return out, bounds[np.searchsorted(starts, rows)]

    def _lookup(self, data, starts, ends, hashes):
        """Where the ids of each distinct piece are, how many, and the pool they are in; hashes ascend."""
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), dtype=bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        place, size = np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        place[known], size[known] = self.starts[at[known]], self.sizes[at[known]]
        new = np.flatnonzero(~known)
        raw = data.tobytes()
        texts = [raw[s:e].decode("utf-8") for s, e in zip(starts[new].tolist(), ends[new].tolist())]
        made = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        fresh = np.fromiter(itertools.chain.from_iterable(made), dtype=np.uint32)
        size[new] = [len(ids) for ids in made]
        place[new] = len(self.ids) + np.cumsum(size[new]) - size[new]
        pool = np.concatenate((self.ids, fresh))
        if len(self.hashes) + len(new) > CACHE_PIECES:
            self.hashes, self.starts, self.sizes, self.ids = self.hashes[:0], self.starts[:0], self.sizes[:0], self.ids[:0]
        else:
            short = new[(ends - starts)[new] <= CACHE_BYTES]
            self.ids = pool
            spots = np.searchsorted(self.hashes, hashes[short])
            self.hashes = np.insert(self.hashes, spots, hashes[short])
            self.starts = np.insert(self.starts, spots, place[short])
            self.sizes = np.insert(self.sizes, spots, size[short])
        return place, size, pool


class Packer:
    """Windows of `window` tokens with a level array; pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int, most_open: int = MOST_OPEN):
        self.window, self.most_open = window, most_open
        self.counts = np.zeros(window + 1, dtype=np.int64)  # open windows at each level; 0 and full stay 0
        self.open: list[list[list[tuple]]] = [[] for _ in range(window)]
        self.opened = 0

    def best_level(self, size: int) -> int:
        """The level (0: a new window) whose use makes the sum of squared counts least; ties to the fullest.

        While windows may be opened, a piece goes only where it fits. Else it
        goes to an open window, and is cut at its end if it fits in none.
        """
        may_open = self.opened < self.most_open or not self.opened
        to = self.counts[size:self.window + 1]
        usable = self.counts[:len(to)] > 0
        usable[0] = may_open
        if not usable.any():
            return int(self.window - 1 - np.argmax(self.counts[self.window - 1::-1]))  # filled: the most frequent level
        cost = 2 * to - 2 * self.counts[:len(to)] + 2
        cost[0] = 2 * self.counts[size] + 1 if size < self.window else 0
        if len(to) > 1:
            cost[-1] = 1 - 2 * self.counts[self.window - size]  # a filled window counts no more
        cost = np.where(usable, cost, np.iinfo(np.int64).max)
        return int(len(cost) - 1 - np.argmin(cost[::-1]))

    def place(self, piece: tuple) -> Iterator[list[tuple]]:
        """Put a piece by the rule; yields the windows that it fills."""
        doc_id, start, ids, total = piece
        while len(ids):
            level = self.best_level(len(ids))
            pieces = self._take(level) if level else []
            part, ids = ids[:self.window - level], ids[self.window - level:]
            pieces.append((doc_id, start, part, total))
            start += len(part)
            if level + len(part) == self.window:
                yield pieces
            else:
                self.open[level + len(part)].append(pieces)
                self.counts[level + len(part)] += 1
                self.opened += 1

    def _take(self, level: int) -> list[tuple]:
        self.counts[level] -= 1
        self.opened -= 1
        return self.open[level].pop()

    def add(self, doc_id, ids: np.ndarray) -> Iterator[list[tuple]]:
        """Place a document; yields the windows that are full."""
        total, start = len(ids), 0
        while total - start >= self.window:
            yield [(doc_id, start, ids[start:start + self.window], total)]
            start += self.window
        yield from self.place((doc_id, start, ids[start:].copy(), total))  # a view would hold the whole document

    def close(self) -> Iterator[list[tuple]]:
        """Open no more: the emptiest windows' pieces are placed in the others until one is left, which is padded."""
        self.most_open = 0
        for level in range(1, self.window):
            while self.counts[level] and self.opened > 1:
                for piece in self._take(level):
                    yield from self.place(piece)
        yield from (pieces for level in self.open for pieces in level)


def _pack(path: str, window: int, with_ids: bool):
    schema = PIECE if with_ids else pa.schema(list(PIECE)[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = PieceEncoder(path), Packer(window)
        sequence, out = TaskContext.get().partitionId() << 36, []

        def emit(windows: Iterator[list[tuple]]) -> None:
            nonlocal sequence
            for pieces in windows:
                offset = 0
                for doc_id, start, ids, total in pieces:
                    row = (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset)
                    out.append((*row, ids.astype(np.int32)) if with_ids else row)
                    offset += len(ids)
                sequence += 1

        for whole in batches:
            for batch in slices(whole, "text"):
                ids, bounds = encoder.encode(batch.column("text"))
                for doc_id, low, high in zip(batch.column("doc_id").to_pylist(), bounds, bounds[1:]):
                    emit(packer.add(doc_id, np.append(ids[low:high], np.uint32(END))))
                if len(out) > 4000:
                    yield record(schema, list(zip(*out)))
                    out.clear()
        emit(packer.close())
        if out:
            yield record(schema, list(zip(*out)))
    return run


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, text: str = "text", id_col: str = "doc_id",
                   with_ids: bool = True) -> DataFrame:
    """One row for each piece of a document in a sequence of at most `window` tokens.

    A document's ids are the tokenizer's, then END. Every id is in exactly one
    piece. Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset and, if wanted, ids. A null text counts as an empty one (END only);
    repeated rows are packed each by itself; texts of any length are packed
    whole; an empty table gives no rows. Further columns are not read, so their
    names cannot clash.
    `tokenizer` is a file that every executor has.
    """
    fields = ("doc_id start length ids_crc32 doc_tokens sequence_id offset").split()
    schema = T.StructType([T.StructField(f, T.LongType()) for f in fields])
    if with_ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _pack(tokenizer, window, with_ids), schema)
