"""Fill-in-middle transformation over units of text (lines), with a Fenwick tree over fixed blocks of the text.

The bytes of a text are cut into blocks of fixed size.  A Fenwick tree stores for each block how many units end in it and how many code
points start in it.  A cut after so many units is found by descending the tree in halving steps (binary lifting), which gives the block
and the code points before it, and then by looking into that one block.  Trees of all texts of a slice are built at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clozeframe.llm.common import giving_back, ragged, slices

BLOCK = 512
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
# Of 100 texts, how many are transformed, and how many of these start with the suffix.
RATE, SUFFIX_FIRST = 100, 50
LINE_FEED = 10

OUTPUT = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


class Forest:
    """Fenwick trees of all texts of a slice, one after another: ends of units and starts of code points per block."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, block: int = BLOCK):
        self.data, self.offsets, self.block = data, offsets, block
        sizes = np.diff(offsets)
        self.blocks = -(-sizes // block)
        self.first = np.concatenate([[0], np.cumsum(self.blocks)])
        starts = np.repeat(offsets[:-1], self.blocks) + block * ragged(np.zeros(len(sizes), np.int64), self.blocks)
        self.units = self._tree(data == LINE_FEED, starts)
        self.points = self._tree((data & 0xC0) != 0x80, starts)
        # Units of each text: its last one may lack the line feed.
        self.n = np.zeros(len(sizes), np.int64)
        for i in np.flatnonzero(sizes):
            self.n[i] = self.total(self.units, i) + (data[offsets[i + 1] - 1] != LINE_FEED)

    def _tree(self, marks: np.ndarray, starts: np.ndarray) -> np.ndarray:
        counts = np.add.reduceat(marks, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
        sums = np.concatenate([[0], np.cumsum(counts)])
        node = ragged(np.ones(len(self.blocks), np.int64), self.blocks)
        at = np.arange(1, len(counts) + 1)
        # A node covers as many blocks as its lowest set bit says.
        return sums[at] - sums[at - (node & -node)]

    def total(self, tree: np.ndarray, i: int) -> int:
        """Sum over all blocks of text ``i``."""
        out, node = 0, int(self.blocks[i])
        while node:
            out += int(tree[self.first[i] + node - 1])
            node &= node - 1
        return out

    def cut(self, i: int, units: int) -> tuple[int, int]:
        """Bytes and code points of text ``i`` in its first ``units`` units."""
        if units == 0:
            return 0, 0
        n, base = int(self.blocks[i]), int(self.first[i]) - 1
        if units == self.n[i]:
            return int(self.offsets[i + 1] - self.offsets[i]), self.total(self.points, i)
        node, left, points, step = 0, units, 0, 1 << n.bit_length() >> 1
        while step:
            # Step over whole runs of blocks that hold fewer unit ends than are left.
            if node + step <= n and self.units[base + node + step] < left:
                node += step
                left -= int(self.units[base + node])
                points += int(self.points[base + node])
            step >>= 1
        start = int(self.offsets[i]) + node * self.block
        inside = self.data[start : min(start + self.block, int(self.offsets[i + 1]))]
        end = int(np.flatnonzero(inside == LINE_FEED)[left - 1]) + 1
        return node * self.block + end, points + int(np.count_nonzero((inside[:end] & 0xC0) != 0x80))


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers for a document: the first groups of eight hex digits of a hash of seed and decimal id (nothing for NULL)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def transform(
    docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, block: int = BLOCK
) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars, output of every document.

    Empty and NULL texts and texts that hold a marker are plain: the output is the text (empty for NULL) and the lengths are
    NULL.  A NULL id draws as an empty string.  Repeated rows are treated alike; other columns are ignored; an empty table gives
    an empty result.
    """
    names = [f.split()[0] for f in OUTPUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
        for batch in batches:
            for part in slices(batch, "text"):
                texts = pa.concat_arrays([pc.fill_null(part.column("text"), "").cast(pa.large_binary())])
                _, ends, data = texts.buffers()
                offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
                flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
                forest = Forest(flat, offsets - offsets[0], block)
                rows = []
                for i, (doc_id, text) in enumerate(zip(part.column("doc_id").to_pylist(), texts.to_pylist(), strict=True)):
                    n = int(forest.n[i])
                    h1, h2, h3, h4 = draws(doc_id, seed)
                    if not text or h3 % 100 >= rate or any(m in text for m in marked):
                        rows.append((doc_id, n, "plain", None, None, text))
                        continue
                    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                    (a, before), (b, until) = forest.cut(i, low), forest.cut(i, high)
                    p, s, m = marked[0] + text[:a], marked[1] + text[b:], marked[2] + text[a:b]
                    form, output = ("spm", s + p + m) if h4 % 100 < suffix_first else ("psm", p + s + m)
                    rows.append((doc_id, n, form, before, until - before, output))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(columns[5], pa.binary()).cast(pa.string())], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(giving_back(run), OUTPUT)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from; transformed texts hold no marker of their own."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    first, second, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


SQL = r"""
with texts as (
    select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents
), units as (
    select *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as u from texts
), drawn as (
    select *, len(u) as n,
        cast('0x' || h[1:8] as ubigint) as h1, cast('0x' || h[9:16] as ubigint) as h2,
        cast('0x' || h[17:24] as ubigint) as h3, cast('0x' || h[25:32] as ubigint) as h4
    from units
), placed as (
    select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
        case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain'
            when h4 % 100 < 50 then 'spm' else 'psm' end as form
    from drawn
), parts as (
    select *, coalesce(array_to_string(u[1:a], ''), '') as p, coalesce(array_to_string(u[a + 1:b], ''), '') as m,
        coalesce(array_to_string(u[b + 1:], ''), '') as s
    from placed
)
select doc_id, cast(n as bigint) as n, form,
    case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
    sha256(case form when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
        when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else text end) as output_sha256,
    sha256(text) as restored_sha256
from parts
"""
