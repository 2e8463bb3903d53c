"""Source divergence audit: term frequencies of each source against the other sources and the whole of its language.

The first pass counts, for each language and term, the documents that have it, and keeps the terms of enough documents exactly.  The kept
terms are dealt by hash to shards of bounded size, and each shard becomes a minimal perfect hash: levels of bits in which a term
sets the bit of its hash if no other term does, and goes on to the next level otherwise; the slot of a term is the number of bits set before
its own.  A shard stores its terms in the order of the slots.  The second pass broadcasts the shards, looks terms up, compares
each with the term stored in its slot (so a term that was not kept is never counted), and increments dense arrays of slots, one
per language and source.  Shards whose stored terms exceed ``BROADCAST_BYTES`` are broadcast in several waves, with one pass each.

Frequencies are compared in blocks of slots: a task holds a block for all sources of a language and sums the pairs of sources
there, so no row per term and pair is made.  Counts of occurrences stay sparse until then.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clozeframe.llm.common import attach, flat_words, giving_back, kept, slices

MIN_DOCS = 10
TOP = 10
SCALE_DIGITS = 9
# Terms of a shard on average, and bytes of stored terms that are broadcast at a time.
SHARD_TERMS = 8_192
BROADCAST_BYTES = 64 << 20
# Bytes of dense slots a task holds before it hands on its counts.
SLOT_BYTES = 64 << 20
# Sources times slots of a block.
CELLS = 1 << 18
# Levels of a perfect hash; terms that no level parts (equal 64-bit hashes) are kept by name.
LEVELS = 32
SLICE_BYTES = 4 << 20

# What a byte of a text becomes: ASCII letters in lower case, other ASCII a blank, the rest as it is.
LETTERS = np.array([b | 0x20 if chr(b).isalpha() else 0x20 for b in range(0x80)] + list(range(0x80, 0x100)), dtype=np.uint8)


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of ASCII letters and characters beyond ASCII, A-Z lower-cased, and the offsets of each text's."""
    texts = pc.fill_null(texts, "")
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    flat = LETTERS[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return flat_words(pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(flat)))


def named(docs: DataFrame) -> DataFrame:
    """lang, source, text; NULL is the empty string."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def document_counts(docs: DataFrame) -> DataFrame:
    """lang, term, n: partial counts of the documents of ``named`` that have the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                words, offsets = terms(part.column("text"))
                coded, lang = words.dictionary_encode(), part.column("lang").dictionary_encode()
                n = max(len(coded.dictionary), 1)
                doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                once = np.unique(doc * n + coded.indices.to_numpy())
                pairs, counts = np.unique(lang.indices.to_numpy()[once // n].astype(np.int64) * n + once % n, return_counts=True)
                columns = [lang.dictionary.take(pa.array(pairs // n)), coded.dictionary.take(pa.array(pairs % n)), pa.array(counts)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "term", "n"])

    return docs.select("lang", "text").mapInArrow(giving_back(run), "lang string, term string, n bigint")


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term of terms in at least ``min_docs`` documents of the language."""
    return document_counts(docs).groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("lang", "term")


def hashed(names: list[str]) -> np.ndarray:
    """64 bits of each term; the same as Spark's ``xxhash64``."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in names), np.uint64, len(names))


def mixed(hashes: np.ndarray, level: int) -> np.ndarray:
    """32 bits that are as good as independent from level to level (a finaliser of multiplications and shifts)."""
    x = hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(32)


class Shard:
    """Minimal perfect hash of some terms: ``words`` of 64 bits for all levels, ``sizes`` (words per level), terms by slot."""

    def __init__(self, names: list[str]):
        names = np.array(sorted(names), dtype=object)
        hashes, left = hashed(names.tolist()), np.arange(len(names))
        words, self.sizes, order = [], [], []
        while len(left) and len(self.sizes) < LEVELS:
            # Two bits per term: over half of the terms find one of their own in each level.
            size = 2 * len(left) // 64 + 1
            at = (mixed(hashes[left], len(self.sizes)) * np.uint64(64 * size) >> np.uint64(32)).astype(np.int64)
            hits = np.bincount(at, minlength=64 * size)
            own = hits[at] == 1
            order.append(left[own][np.argsort(at[own])])
            words.append(np.packbits(hits == 1, bitorder="little").view("<u8"))
            self.sizes.append(size)
            left = left[~own]
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        # Terms without a bit come last, by name.
        self.unparted = len(left)
        self.names = names[np.concatenate([*order, left])].tolist() if len(names) else []


class Lookup:
    """Slots of the terms of one language: the shards of a wave side by side."""

    def __init__(self, n_shards: int, shards: list[tuple[int, int, bytes, list[int], str, int]]):
        """Shards as (number, first slot, words, sizes, terms by slot, terms without a bit)."""
        self.n_shards = n_shards
        depth = max((len(s[3]) for s in shards), default=0)
        # Where a level of a shard starts, and its words; the last row is for shards that are not here.
        self.starts, self.sizes = np.zeros((n_shards, depth), np.int64), np.zeros((n_shards, depth), np.int64)
        words, counts, first, names, self.unparted, at = [], [], [], [], {}, 0
        for number, slot, bits, sizes, stored, unparted in shards:
            own = np.frombuffer(bits, "<u8")
            self.sizes[number, : len(sizes)] = sizes
            self.starts[number, : len(sizes)] = at + np.cumsum(sizes) - sizes
            ones = np.bitwise_count(own).astype(np.int64)
            words.append(own)
            counts.append(slot + np.cumsum(ones) - ones)
            at += len(own)
            by_slot = stored.split(" ")
            self.unparted |= {t: slot + len(by_slot) - unparted + i for i, t in enumerate(by_slot[len(by_slot) - unparted :])}
            first.append(slot)
            names.append(by_slot)
        self.words = np.concatenate([np.zeros(0, np.uint64), *words])
        # The slot of the first bit of each word.
        self.before = np.concatenate([np.zeros(0, np.int64), *counts])
        self.base = first[0] if first else 0
        self.names = pa.array([t for by_slot in names for t in by_slot], pa.string())

    def slots(self, asked: pa.Array) -> np.ndarray:
        """The slot of each term, or -1."""
        names = asked.to_numpy(zero_copy_only=False).tolist()
        hashes = hashed(names)
        shard = (hashes % np.uint64(self.n_shards)).astype(np.int64)
        out, left = np.full(len(names), -1), np.arange(len(names))
        for level in range(self.starts.shape[1]):
            size = self.sizes[shard[left], level]
            left, size = left[size > 0], size[size > 0]
            at = (mixed(hashes[left], level) * (64 * size).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            word, bit = self.starts[shard[left], level] + (at >> 6), (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.before[word] + below)[hit]
            left = left[~hit]
        found = np.flatnonzero(out >= 0)
        stored = self.names.take(pa.array(out[found] - self.base))
        out[found[~pc.equal(stored, asked.take(pa.array(found))).to_numpy(zero_copy_only=False)]] = -1
        if self.unparted:
            for i in np.flatnonzero(out < 0):
                out[i] = self.unparted.get(names[i], -1)
        return out


def shards(names: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """lang, n_shards, shard, first (slot), n, words, sizes, terms (by slot, joined by blanks), unparted, of (lang, term) rows."""
    totals = names.groupBy("lang").agg(F.ceil(F.count("*") / shard_terms).alias("n_shards"))
    # The hash is read as unsigned.
    shard = F.expr("cast(pmod(cast(xxhash64(term) as decimal(20, 0)) + if(xxhash64(term) < 0, 18446744073709551616, 0), n_shards) as bigint)")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        made = Shard(pdf["term"].tolist())
        row = [pdf["lang"].iloc[0], pdf["n_shards"].iloc[0], pdf["shard"].iloc[0], len(made.names), made.words.tobytes(), made.sizes]
        return pd.DataFrame([[*row, " ".join(made.names), made.unparted]], columns=columns)

    out = "lang string, n_shards bigint, shard bigint, n bigint, words binary, sizes array<bigint>, terms string, unparted bigint"
    columns = [f.split()[0] for f in out.split(", ")]
    dealt = attach(names, kept(totals), ["lang"]).withColumn("shard", shard)
    made = dealt.groupBy("lang", "shard").applyInPandas(build, out)
    return kept(made)


def numbered(made: DataFrame) -> DataFrame:
    """Shards with ``first``, their first slot in the language, and ``wave``, the broadcast they belong to."""
    by = Window.orderBy("lang", "shard").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("lang").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # One row per thousands of terms, without the terms.
    slim = made.select("lang", "shard", "n", F.octet_length("terms").alias("bytes"))
    placed = slim.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return placed.withColumn("wave", F.floor(F.coalesce(F.sum("bytes").over(by), F.lit(0)) / BROADCAST_BYTES)).select("lang", "shard", "first", "wave")


@lru_cache(maxsize=1)
def lookups(number: int, wave: Broadcast) -> dict[str, Lookup]:
    """The lookups of a broadcast wave, made once per Python worker."""
    by_lang: dict[str, tuple[int, list]] = {}
    for lang, n_shards, *shard in wave.value:
        by_lang.setdefault(lang, (n_shards, []))[1].append(tuple(shard))
    return {lang: Lookup(n, sorted(rows)) for lang, (n, rows) in by_lang.items()}


class Tally:
    """Dense counts of slots per group; handed on when they exceed ``limit`` bytes."""

    def __init__(self, limit: int = SLOT_BYTES):
        self.limit, self.held, self.counts = limit, 0, {}

    def add(self, group: tuple[str, str], lookup: Lookup, slots: np.ndarray, n: np.ndarray) -> None:
        if group not in self.counts:
            self.counts[group] = (lookup.base, np.zeros(len(lookup.names), np.int64))
            self.held += 8 * len(lookup.names)
        # Slots of different terms differ, so a plain addition counts all.
        self.counts[group][1][slots - lookup.base] += n

    def take(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), (base, counts) in self.counts.items():
            slots = np.flatnonzero(counts)
            names = [pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(slots), np.int32)), pa.array([x])).cast(pa.string()) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*names, pa.array(slots + base), pa.array(counts[slots])], ["lang", "source", "slot", "n"])
        self.counts, self.held = {}, 0


def recount(docs: DataFrame, wave: Broadcast, number: int) -> DataFrame:
    """lang, source, slot, n: partial counts of occurrences of the terms of a wave in ``named`` documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, tally = lookups(number, wave), Tally()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                words, offsets = terms(part.column("text"))
                coded = words.dictionary_encode()
                lang, source = part.column("lang").dictionary_encode(), part.column("source").dictionary_encode()
                n, n_sources = max(len(coded.dictionary), 1), max(len(source.dictionary), 1)
                group = lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy()
                cells, counts = np.unique(np.repeat(group, np.diff(offsets)) * n + coded.indices.to_numpy(), return_counts=True)
                langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
                slots: dict[str, np.ndarray] = {}
                starts = np.flatnonzero(np.diff(cells // n, prepend=-1))
                for a, b in zip(starts, [*starts[1:], len(cells)], strict=True):
                    which = int(cells[a] // n)
                    name = langs[which // n_sources]
                    if name not in found:
                        continue
                    if name not in slots:
                        slots[name] = found[name].slots(coded.dictionary)
                    own = slots[name][cells[a:b] % n]
                    hit = own >= 0
                    if hit.any():
                        tally.add((name, sources[which % n_sources]), found[name], own[hit], counts[a:b][hit])
                    if tally.held > tally.limit:
                        yield from tally.take()
        yield from tally.take()

    return docs.mapInArrow(giving_back(run), "lang string, source string, slot bigint, n bigint")


def counted(docs: DataFrame, made: DataFrame, places: DataFrame) -> DataFrame:
    """lang, source, slot, n of all occurring terms of ``named`` documents."""
    spark = docs.sparkSession
    last = places.agg(F.max("wave")).first()[0]
    out = spark.createDataFrame([], "lang string, source string, slot bigint, n bigint")
    columns = ["lang", "n_shards", "shard", "first", "words", "sizes", "terms", "unparted"]
    for number in range(0 if last is None else int(last) + 1):
        rows = made.join(places.where(F.col("wave") == number), ["lang", "shard"]).select(*columns).collect()
        # At most BROADCAST_BYTES of terms and one shard, with about half a byte of bits a term.
        wave = spark.sparkContext.broadcast([(r[0], r[1], r[2], r[3], bytes(r[4]), list(r[5]), r[6], r[7]) for r in rows])
        out = out.unionByName(recount(docs, wave, number))
    return out.groupBy("lang", "source", "slot").agg(F.sum("n").alias("n"))


def scaled(counts: np.ndarray, total: int, n_terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), digit group by digit group so that nothing overflows."""
    whole = total + 2 * n_terms
    digits, rest = np.zeros(counts.shape, np.int64), counts + 2
    for _ in range(SCALE_DIGITS // 3):
        rest = rest * 1000
        digits, rest = digits * 1000 + rest // whole, rest % whole
    return digits + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def compared(pdf: pd.DataFrame, top: int = TOP) -> pd.DataFrame:
    """Sums over one block of slots of a language for all pairs of sources, and the leading terms of each source in it.

    Rows of kind 0 name the sources (n: their total), of kind 1 the terms (n unused), of kind 2 the counts.
    """
    lang, n_terms = pdf["lang"].iloc[0], int(pdf["n_terms"].iloc[0])
    sources = pdf[pdf["kind"] == 0].sort_values("name")
    names, totals = sources["name"].tolist(), [int(n) for n in sources["n"]]
    words, cells = pdf[pdf["kind"] == 1].sort_values("slot"), pdf[pdf["kind"] == 2]
    base = int(words["slot"].iloc[0]) if len(words) else 0
    counts = np.zeros((len(names), len(words)), np.int64)
    row = {s: i for i, s in enumerate(names)}
    counts[[row[s] for s in cells["name"]], cells["slot"].to_numpy(np.int64) - base] = cells["n"].to_numpy(np.int64)
    p = np.zeros_like(counts)
    for i, total in enumerate(totals):
        p[i] = scaled(counts[i], total, n_terms)
    q = scaled(counts.sum(axis=0), sum(totals), n_terms)
    stored, out = words["name"].tolist(), []
    for i, name in enumerate(names):
        sums = divergence(p[i + 1 :], p[i]).sum(axis=1)
        for other, value in zip(names[i + 1 :], sums.tolist(), strict=True):
            out += [(lang, name, "pair", other, value), (lang, other, "pair", name, value)]
        above = np.flatnonzero((counts[i] > 0) & (p[i] > q))
        values = divergence(p[i][above], q[above])
        if len(above) > top:
            # All that tie with the last place stay until the terms are compared.
            least = np.partition(values, len(values) - top)[len(values) - top]
            above, values = above[values >= least], values[values >= least]
        ranked = sorted(zip((-values).tolist(), (stored[k] for k in above), strict=True), key=lambda x: (x[0], x[1].encode()))
        out += [(lang, name, "term", term, -value) for value, term in ranked[:top]]
    return pd.DataFrame(out, columns=["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, shard_terms: int = SHARD_TERMS, cells: int = CELLS) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank: how far each source of a language is from the others, and by which terms.

    NULL text, lang and source are the empty string, and rows are documents whether or not their ids repeat.  A group without terms has
    its pairs, a language without kept terms has pairs of value 0, and a language of one source has no pairs.  Ties are
    ranked by the UTF-8 bytes of the item.  Other columns are ignored; an empty table gives an empty result.
    """
    docs = named(docs)
    made = shards(kept(kept_terms(docs, min_docs)), shard_terms)
    places = kept(numbered(made))
    counts = kept(counted(docs, made, places))
    groups = kept(docs.select("lang", "source").distinct().join(counts.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").fillna(0, ["n"]))
    langs = kept(
        groups.groupBy("lang").agg(F.count("*").alias("n_sources"))
        .join(made.groupBy("lang").agg(F.sum("n").alias("n_terms")), "lang", "left").fillna(0, ["n_terms"])
        .withColumn("width", F.greatest(F.lit(1), F.floor(F.lit(cells) / F.col("n_sources"))).cast("long"))
    )
    block = F.expr("slot div width")
    last = F.greatest(F.lit(0), F.expr("(n_terms - 1) div width"))
    per_lang = ["lang", "n_terms", "width"]
    named_sources = attach(groups, langs, ["lang"]).select(*per_lang, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"), F.lit(0).alias("kind"), F.col("source").alias("name"), F.lit(0).cast("long").alias("slot"), "n")
    stored = made.join(places, ["lang", "shard"]).select("lang", "first", F.posexplode(F.split("terms", " ")).alias("at", "name"))
    stored = attach(stored.select("lang", "name", (F.col("first") + F.col("at")).alias("slot")), langs, ["lang"])
    stored = stored.select(*per_lang, block.alias("block"), F.lit(1).alias("kind"), "name", "slot", F.lit(0).cast("long").alias("n"))
    cell_rows = attach(counts, langs, ["lang"]).select(*per_lang, block.alias("block"), F.lit(2).alias("kind"), F.col("source").alias("name"), "slot", "n")
    rows = named_sources.unionByName(stored).unionByName(cell_rows)
    out = "lang string, source string, part string, item string, value bigint"
    found = kept(rows.groupBy("lang", "block").applyInPandas(lambda pdf: compared(pdf, top), out))
    sums = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    pairs = sums.withColumn("rank", F.row_number().over(order))
    leading = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(leading)


SQL = r"""
with docs as (
    select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as t
    from documents
), words as (
    select r, lang, source, unnest(t) as term from docs
), kept as (
    select lang, term from words group by lang, term having count(distinct r) >= 10
), sizes as (
    select lang, count(*) as v from kept group by lang
), groups as (
    select distinct lang, source from docs
), found as (
    select w.lang, w.source, w.term, count(*) as n from words w join kept k on w.lang = k.lang and w.term = k.term group by all
), totals as (
    select g.lang, g.source, coalesce(sum(f.n), 0) as total
    from groups g left join found f on g.lang = f.lang and g.source = f.source group by all
), dense as (
    select t.lang, t.source, k.term, coalesce(f.n, 0) as n,
        cast(1 + cast(1000000000 as hugeint) * (coalesce(f.n, 0) + 2) // (t.total + 2 * s.v) as bigint) as p
    from totals t join kept k on t.lang = k.lang join sizes s on t.lang = s.lang
    left join found f on f.lang = t.lang and f.source = t.source and f.term = k.term
), overall as (
    select lang, term, sum(n) as n from found group by all
), whole as (
    select o.lang, o.term, cast(1 + cast(1000000000 as hugeint) * (o.n + 2) // (x.total + 2 * s.v) as bigint) as q
    from overall o join sizes s on o.lang = s.lang join (select lang, sum(n) as total from overall group by lang) x on x.lang = o.lang
), summed as (
    select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
    from dense a join dense b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), pairs as (
    select g.lang, g.source, 'pair' as part, o.source as item, cast(coalesce(s.value, 0) as bigint) as value
    from groups g join groups o on g.lang = o.lang and g.source <> o.source
    left join summed s on s.lang = g.lang and s.source = g.source and s.item = o.source
), terms as (
    select d.lang, d.source, 'term' as part, d.term as item, cast((p - q) * (p - q) // (p + q) as bigint) as value
    from dense d join whole w on d.lang = w.lang and d.term = w.term where d.n > 0 and p > q
), ranked as (
    select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank
    from (select * from pairs union all select * from terms)
)
select * from ranked where part = 'pair' or rank <= 10
"""
