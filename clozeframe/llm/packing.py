"""Sum-of-squares packing of tokenised documents into windows of a fixed length.

Spark's input partitions are packed independently and in one pass, so nothing is shuffled.  In a partition an array
holds, for every fill level, how many open windows stand there.  A document goes to the level that leaves the sum
of squared counts smallest (a new window counts as level 0, a filled window leaves the array).  Documents
longer than a window are cut into full windows first and only the rest is placed.

Open windows keep the ids of their pieces (two bytes each, at most those of one input partition).  At the end of a partition they are
joined by cutting, which fills all but the last; what is left is cut into sequences whose lengths are powers of two, which need
no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clozeframe.llm.common import giving_back, slices
from clozeframe.llm.tokens import lower_words

END_ID = 1
CAPACITY = 2048

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)


class Packer:
    """Windows of one partition; ``done`` collects finished pieces as rows of ``SCHEMA``."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY):
        self.capacity = capacity
        # Windows that a piece has filled exactly.
        self.filled = 0
        self.next_sequence = first_sequence
        self.counts = np.zeros(capacity + 1, dtype=np.int64)
        self.windows: dict[int, list[list]] = {}  # fill level -> open windows, each a list of pieces
        self.done: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.capacity:
            self.close([(doc_id, start, ids[start : start + self.capacity], total)])
            start += self.capacity
        if start < total:
            self.place((doc_id, start, ids[start:], total))

    def best_level(self, size: int) -> int:
        """Level (0: a new window) at which this size leaves the smallest sum of squares."""
        counts, capacity = self.counts, self.capacity
        levels = np.flatnonzero(counts[: capacity - size + 1])
        after = levels + size
        change = 2 * (np.where(after < capacity, counts[after] + 1, 0) - counts[levels])
        new = 2 * (counts[size] + 1) if size < capacity else 0
        if not len(levels) or new < change.min():
            return 0
        # Of equal levels the fullest.
        return int(levels[np.flatnonzero(change == change.min())[-1]])

    def place(self, piece: tuple) -> None:
        size = len(piece[2])
        level = self.best_level(size)
        if level:
            window = self.windows[level].pop()
            self.counts[level] -= 1
        else:
            window = []
        window.append(piece)
        if level + size == self.capacity:
            self.filled += 1
            self.close(window)
            return
        self.windows.setdefault(level + size, []).append(window)
        self.counts[level + size] += 1

    def close(self, window: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in window:
            crc = zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
            self.done.append((doc_id, start, len(ids), crc, total, self.next_sequence, offset))
            offset += len(ids)
        self.next_sequence += 1

    def join_open(self) -> list[tuple]:
        """Empty the array: cut the open windows' pieces into full windows; what is left is returned."""
        pieces = [p for level in sorted(self.windows, reverse=True) for w in self.windows[level] for p in w]
        self.windows.clear()
        self.counts[:] = 0
        return self.cut(pieces, [self.capacity] * (sum(len(p[2]) for p in pieces) // self.capacity))

    def cut(self, pieces: list[tuple], lengths: list[int]) -> list[tuple]:
        """Close windows of these lengths from the pieces in turn; the pieces left over."""
        pieces = pieces[::-1]
        for length in lengths:
            window = []
            while length:
                doc_id, start, ids, total = pieces.pop()
                if len(ids) > length:
                    pieces.append((doc_id, start + length, ids[length:], total))
                    ids = ids[:length]
                window.append((doc_id, start, ids, total))
                length -= len(ids)
            self.close(window)
        return pieces[::-1]

    def finish(self) -> None:
        rest = self.join_open()
        left = sum(len(p[2]) for p in rest)
        self.cut(rest, [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1])

    def take(self) -> pa.RecordBatch | None:
        if not self.done:
            return None
        columns = list(zip(*self.done, strict=True))
        self.done = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in SCHEMA.split(", ")])


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    NULL and empty texts are the end id alone.  NULL ids stay NULL; repeated rows are packed once each.
    Other columns are ignored.  An empty table gives no pieces.  A partition gives the same rows when it is run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        encoder = lower_words(path)
        packer = Packer(TaskContext.get().partitionId() << 40, capacity)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, ends = encoder.encode(part.column("text"))
                # Every document ends with the end id; the ids of this vocabulary have two bytes.
                ids = np.insert(ids, ends[1:], END_ID).astype(np.uint16)
                ends = ends + np.arange(len(ends))
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), ends[:-1], ends[1:], strict=True):
                    packer.add(doc_id, ids[a:b].copy())
                if (out := packer.take()) is not None:
                    yield out
        packer.finish()
        if (out := packer.take()) is not None:
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(giving_back(run), SCHEMA)
