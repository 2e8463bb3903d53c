"""Best-fit packing planned on the histogram of lengths.

Only documents longer than a window are cut: into full windows behind one shorter first piece.  All pieces are counted by length, and best-fit
decreasing runs over the counts: windows with the same room left are one class, and a whole class takes its share of a
length in one step.  So the plan has a number of steps that depends on the capacity alone.  Each step is a run of ranks within a length and
the slots they take; a piece gets its rank from the number of pieces of its length in earlier input partitions
and its place in its own, and finds its slot by that rank.  Nothing but ids and numbers is shuffled.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clozeframe.llm.common import attach, giving_back, kept, ragged, slices
from clozeframe.llm.tokens import spaced_text

CAPACITY = 1024
END_ID = 2
# Bytes of text a Python task tokenises at a time.
SLICE_BYTES = 4 << 20

PIECES = "task bigint, rank bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut(tokens: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For documents of so many tokens: the document, number, start and length of each piece."""
    n = -(-tokens // capacity)
    first = tokens - (n - 1) * capacity
    doc = np.repeat(np.arange(len(tokens)), n)
    number = ragged(np.zeros(len(n), np.int64), n)
    start = np.where(number > 0, first[doc] + (number - 1) * capacity, 0)
    return doc, number, start, np.where(number > 0, capacity, first[doc])


class Ranks:
    """Numbers pieces within their length, from batch to batch of one partition."""

    def __init__(self, capacity: int):
        self.seen = np.zeros(capacity + 1, np.int64)

    def take(self, lengths: np.ndarray) -> np.ndarray:
        order = np.argsort(lengths, kind="stable")
        counts = np.bincount(lengths, minlength=len(self.seen))
        ranks = np.empty(len(lengths), np.int64)
        ranks[order] = ragged(self.seen[counts > 0], counts[counts > 0])
        self.seen += counts
        return ranks


def tokenised(docs: DataFrame, tokenizer_path: str | None, capacity: int, end_id: int) -> DataFrame:
    """Pieces of all documents, with the input partition and the rank among its pieces of the same length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        encoder, ranks, task = spaced_text(path), Ranks(capacity), TaskContext.get().partitionId()
        names = [f.split()[0] for f in PIECES.split(", ")]
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids, offsets = encoder.encode(part.column("text"))
                # Every document ends with the end id.
                ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
                offsets = offsets + np.arange(len(offsets))
                doc, number, start, length = cut(np.diff(offsets), capacity)
                at, data = 4 * (offsets[doc] + start), memoryview(ids).cast("B")
                crc = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                columns = [
                    pa.array(np.full(len(doc), task)), pa.array(ranks.take(length)), part.column("doc_id").take(pa.array(doc)),
                    pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(giving_back(run), PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Steps (length, first rank, pieces per window, first window, offset) of best fit, longest length first.

    From its first rank on, and up to the next step of the length, a step puts so many pieces of the length side by side into each of
    successive windows.  ``classes`` holds the open windows by the room they have left, as runs (first window, number).
    """
    classes: dict[int, list[tuple[int, int]]] = defaultdict(list)
    steps, windows = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        # The fullest windows that still have room come first.
        for room in sorted(r for r in classes if r >= length):
            each = room // length
            while left and classes[room]:
                first, number = classes[room].pop()
                whole, rest = min(number, left // each), 0
                if whole < number:
                    rest = left - whole * each
                taken = whole + (rest > 0)
                steps.append((length, rank, each, first, capacity - room))
                if whole:
                    classes[room - each * length].append((first, whole))
                if rest:
                    classes[room - rest * length].append((first + whole, 1))
                if taken < number:
                    classes[room].append((first + taken, number - taken))
                rank, left = rank + whole * each + rest, left - whole * each - rest
            if not left:
                break
        if left:
            each = capacity // length
            whole, rest = divmod(left, each)
            steps.append((length, rank, each, windows, 0))
            if whole:
                classes[capacity - each * length].append((windows, whole))
            if rest:
                classes[capacity - rest * length].append((windows + whole, 1))
            windows += whole + (rest > 0)
    return steps


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    NULL and empty texts are the end id alone.  NULL ids stay NULL; repeated rows are packed once each.  Pieces of the same length take
    their slots in the order of input partitions and rows.  Other columns are ignored; an empty table gives no pieces.
    """
    spark = docs.sparkSession
    pieces = kept(tokenised(docs, tokenizer_path, capacity, end_id))
    per_task = kept(pieces.groupBy("task", "length").agg(F.count("*").alias("n")))
    # One row per length, at most ``capacity`` of them.
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = kept(per_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before")))
    ranked = attach(pieces, before, ["task", "length"]).withColumn("_rank", F.col("_before") + F.col("rank"))
    step = "length bigint, _first bigint, _each bigint, _window bigint, _offset bigint"
    steps = spark.createDataFrame(plan(counts, capacity), step)
    # A step ends where the next of its length starts; their number depends on the capacity alone.
    runs = steps.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("_first", "_each", "_window", "_offset"))).alias("_runs"))
    placed = ranked.join(F.broadcast(runs), "length")
    run = F.element_at("_runs", F.size(F.filter("_runs", lambda r: r["_first"] <= F.col("_rank"))))
    placed = placed.withColumn("_run", run).withColumn("_nth", F.col("_rank") - F.col("_run._first"))
    nth_window = F.expr("_nth div _run._each")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_run._window") + nth_window).alias("sequence_id"),
        (F.col("_run._offset") + F.col("_nth") % F.col("_run._each") * F.col("length")).alias("offset"),
    )
