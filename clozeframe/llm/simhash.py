"""SimHash near-duplicates: pigeonhole blocks, verified by Hamming distance.

A 64-bit fingerprint has a bit set if most of a text's word shingles have it set in their hash.  Fingerprints that differ in
at most ``DISTANCE`` bits agree in at least ``len(BLOCKS) - DISTANCE`` of the blocks they are cut into, so they meet under at
least one choice of that many blocks.  Texts are dealt with once per *distinct* fingerprint, so copies never meet.

A block key under which very many distinct fingerprints meet is not compared pair by pair.  Its fingerprints
are dealt out once more, under every fingerprint that differs in at most one bit: two of them differ in
at most two bits exactly if they share such a neighbour, so linking each to the least one there gives the same
components with a fixed number of rows per fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clozeframe.llm.common import attach, flat_words, giving_back, kept, slices
from clozeframe.llm.graph import components

SEED = 42
# Words of a shingle, and bits in which linked fingerprints differ at most.
WIDTH, DISTANCE = 3, 2
# Four blocks of 16 bits; two differing bits leave two of them equal.
BLOCKS = [0xFFFF << s for s in (0, 16, 32, 48)]
# Distinct fingerprints under one block key that are compared pair by pair.
PAIRWISE = 64
# Keys that are broadcast at most.
BOUND = 200_000


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a slice of texts, and the offsets of each text's."""
    import xxhash

    words, offsets = flat_words(pc.ascii_lower(pc.fill_null(texts, "")))
    n = np.diff(offsets)
    counts = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    ends = np.concatenate([[0], np.cumsum(counts)])
    hashes = np.zeros(ends[-1], dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    full = len(words) - width + 1
    if full > 0:
        joined = pc.binary_join_element_wise(*[words.slice(i, full) for i in range(width)], " ")
        # A shingle may start where its last word is still of the same text.
        start = np.repeat(offsets[1:] - width, n)[:full]
        joined = joined.filter(pa.array(np.arange(full) <= start))
        long = np.repeat(n >= width, counts)
        hashes[long] = np.fromiter((digest(s, SEED) for s in joined.to_numpy(zero_copy_only=False)), np.uint64, len(joined))
    for i in np.flatnonzero((n > 0) & (n < width)):
        hashes[ends[i]] = digest(" ".join(words.slice(offsets[i], n[i]).to_pylist()), SEED)
    return hashes, ends


def majority(hashes: np.ndarray, ends: np.ndarray, chunk: int = 1 << 18) -> np.ndarray:
    """Fingerprint of each text; zero without shingles."""
    counts = np.diff(ends)
    ones = np.zeros((len(counts), 64), dtype=np.int64)
    for at in range(0, len(hashes), chunk):
        stop = min(at + chunk, len(hashes))
        bits = np.unpackbits(hashes[at:stop].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        texts = np.flatnonzero((ends[:-1] < stop) & (ends[1:] > at) & (counts > 0))
        starts = np.maximum(ends[:-1][texts], at) - at
        ones[texts] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > counts[:, None], axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """All columns but ``text``, and the fingerprint as a signed long, of every row; NULL and wordless texts have fingerprint 0."""
    names = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                prints = majority(*shingles(part.column("text"), width))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(prints)], [*names, "fingerprint"])

    return docs.mapInArrow(giving_back(run), f"{schema}, fingerprint bigint")


def links(prints: DataFrame, pairwise: int = PAIRWISE) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fingerprint``) whose components are those of all close pairs."""
    masks = [sum(c) for c in combinations(BLOCKS, len(BLOCKS) - DISTANCE)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("block")) for i, m in enumerate(signed)])
    dealt = prints.select("fingerprint", F.explode(keys).alias("k")).select("fingerprint", "k.*")
    sizes = kept(dealt.groupBy("choice", "block").count().where("count > 1"))
    few = dealt.join(sizes.where(F.col("count") <= pairwise).drop("count"), ["choice", "block"])
    left, right = few.withColumnRenamed("fingerprint", "a"), few.withColumnRenamed("fingerprint", "b")
    close = left.join(right, ["choice", "block"]).where(
        (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    )
    close = close.select("a", "b")
    crowded = sizes.where(F.col("count") > pairwise).drop("count")
    if crowded.isEmpty():
        return close
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    many = dealt.join(crowded, ["choice", "block"]).select("fingerprint").distinct()
    near = kept(many.select(F.col("fingerprint").alias("b"), F.explode(flips).alias("flip")).select("b", F.col("b").bitwiseXOR(F.col("flip")).alias("at")))
    least = kept(near.groupBy("at").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return close.unionByName(near.join(least, "at").where("a <> b").select("a", "b"))


def _roots(prints: DataFrame, pairwise: int) -> DataFrame:
    """fingerprint, root (a fingerprint of its component) of every distinct fingerprint."""
    distinct = kept(prints.select("fingerprint").distinct())
    roots = kept(components(links(distinct, pairwise)))
    return distinct.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, pairwise: int = PAIRWISE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    component_id is the smallest doc_id whose fingerprint can be reached by links, NULL if all of them are NULL.  NULL, empty and
    wordless texts share fingerprint 0.  Repeated rows come back as often as given; other columns are ignored; an
    empty table gives an empty result.
    """
    prints = kept(fingerprints(docs.select(F.col("doc_id").cast("long"), "text"), width))
    first = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    placed = first.join(_roots(prints, pairwise), "fingerprint")
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = kept(placed.join(least, "root").select("fingerprint", "component_id"))
    return prints.join(groups, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, width: int = WIDTH, pairwise: int = PAIRWISE) -> DataFrame:
    """The rows of ``docs`` with one document of each component left, with all their columns.

    The smallest doc_id stays (of equal ones the one with the smallest text hash; a NULL id only if the group has no other), and of
    rows with equal id and text one stays.  NULL, empty and wordless texts are one group.  Only ids and hashes are shuffled.
    An empty table gives an empty result.
    """
    key = ["doc_key", "text_key"]
    slim = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_key"), F.xxhash64("text").alias("text_key"), F.col("doc_id").cast("long"), "text")
    prints = kept(fingerprints(slim, width))
    grouped = kept(attach(prints, kept(_roots(prints, pairwise)), ["fingerprint"]))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("doc_key"), F.col("text_key"))
    first = kept(grouped.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    members = kept(attach(grouped, first, ["root"], BOUND).withColumn("stays", (F.col("doc_key") == F.col("first.doc_key")) & (F.col("text_key") == F.col("first.text_key"))))
    # How often the rows of a key stay: not at all, or once of several equal ones.
    decided = kept(members.groupBy(*key, "stays").agg(F.count("*").alias("n")).where("not stays or n > 1").select(*key, F.col("stays").cast("int").alias("times")))
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_copy_row"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_copy_doc"), F.xxhash64("text").alias("_copy_text"),
    )
    right = decided.select(F.col("doc_key").alias("_right_doc"), F.col("text_key").alias("_right_text"), F.col("times").alias("_copy_times"))
    if decided.limit(BOUND + 1).count() <= BOUND:
        right = F.broadcast(right)
    marked = marked.join(right, (F.col("_copy_doc") == F.col("_right_doc")) & (F.col("_copy_text") == F.col("_right_text")), "left")
    columns = [F.col(f"_copy_row.`{c}`").alias(c) for c in docs.columns]
    result = marked.where("_copy_times is null").select(*columns)
    if decided.where("times = 1").isEmpty():
        return result
    repeated = marked.where("_copy_times = 1").dropDuplicates(["_copy_doc", "_copy_text"])
    return result.unionByName(repeated.select(*columns))
