"""Helpers shared by the operators: table reading, words, materialisation, bounded lookups, Arrow slices."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
from collections.abc import Callable, Iterator
from functools import reduce, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
# Group tables of at most this many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 50_000
# Bytes of text a Python task works on at a time.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text; NULL text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, also inside higher-order functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; make one only for a local master without it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local[") or context.master == "local":
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def kept(df: DataFrame) -> DataFrame:
    """The rows, computed once and written to the shared checkpoint folder; later plans start there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def same_key(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], bound: int = BROADCAST_ROWS) -> DataFrame:
    """Add the columns of a kept group table (one row per key) to the rows; NULL keys match each other.

    The group table is counted: up to ``bound`` rows it is broadcast, beyond that both sides are
    shuffled, where adaptive execution may split a hot key because neither side is aggregated there.
    """
    right = groups.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    if groups.limit(bound + 1).count() <= bound:
        right = F.broadcast(right)
    on = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(right[f"_right_{k}"]) for k in keys])
    return rows.join(right, on).drop(*[f"_right_{k}" for k in keys])


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether the row is kept from learning: crc32 of the id as text leaves this remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def hash_sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows in the order of a hash of the key (distinct); all if there are no more.

    The hashes below a threshold that the number of rows gives are a little more than enough, and only these are sorted.
    """
    rows = kept(rows)
    n = rows.count()
    if n <= limit:
        return rows
    share = min(1.0, (limit + 6 * limit**0.5 + 50) / n)
    # xxhash64 is spread evenly over all longs.
    bound = round(-(2.0**63) + share * 2.0**64)
    hashed = F.xxhash64(key)
    return rows.where(hashed <= F.lit(min(bound, 2**63 - 1))).orderBy(hashed, key).limit(limit)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for ``mapInArrow`` that returns freed memory to the system when its task ends.

    Python workers go on to later stages, where memory held by their allocators would count on top.
    """

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)(0)

    return wrapped


def flat_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a slice of texts in one array, and the offsets of each text's words."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    values, offsets = split.flatten(), split.offsets.to_numpy()
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(values), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return values.filter(full), before[offsets]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of several runs, one after another."""
    ends = np.cumsum(lengths)
    kind = np.int32 if len(ends) and max(int(ends[-1]), int(starts.max())) < 1 << 31 else np.int64
    positions = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    positions += np.arange(len(positions), dtype=kind)
    return positions
