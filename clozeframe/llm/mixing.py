"""Mixing sources to target weights by weighted fair queueing.

Every document of a source is put in a shuffled order (by a hash of its id).  Its *virtual finish time*
is the number of its source's words up to and including it, divided by the source's target: the
share of the target used up when it has been sent.  Each pass over a source goes on where the last ended.
All (document, pass) items are put in the order of finish time and cut where the budget is used up.

Nothing is gathered per source: words up to a document are a sum over hash ranges of about
``RANGE_ROWS`` documents plus a running sum inside the range.  The global cut is found on a histogram of
finish times; only the one histogram cell that holds it is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clozeframe.llm.common import attach, kept, words

RANGE_ROWS = 4096


def targets(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, passes: int = 2) -> DataFrame:
    """One row per source: source_size, n_docs, place (from 0), weight, target.

    Sources in code-point order, NULL last, take the weights in turn.  Targets share ``share`` times all words by
    weight; a target stops at ``passes`` times its source, and the excess is shared again.  With the
    sources in order of (limit / weight), the source k is at its limit if the level shared by k and all
    later ones is not below its own ratio, so running sums answer it without a loop.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = F.array(*[F.lit(w).cast("long") for w in weights])
    sources = sources.withColumn("place", place).withColumn("weight", F.get(table, F.col("place") % len(weights)))
    limit = passes * F.col("source_size")
    order = Window.orderBy(limit / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(order), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(order), F.lit(0))
    )
    full = limit <= F.col("level") * F.col("weight")
    shared = F.max(F.when(~full, F.col("level"))).over(everything)
    return (
        sources.withColumn("level", level)
        .withColumn("full", full)
        .withColumn("shared", shared)
        .withColumn("target", F.when(F.col("full"), limit.cast("double")).otherwise(F.col("weight") * F.col("shared")))
        .drop("level", "full", "shared")
    )


def _finish(done: Column) -> Column:
    return F.try_divide(done, F.col("target"))


def schedule(row: DataFrame, weights: tuple[int, ...], share: float, passes: int):
    """Rows with the finish time of each pass, and the cut (finish, place, pass, words that still fit), if any."""
    row = kept(row)
    per_source = kept(targets(row, weights, share, passes))
    row = attach(row, per_source, ["source"])
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / RANGE_ROWS)).cast("long")
    head = F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("long")
    row = row.withColumn("range", F.shiftrightunsigned(head * ranges, 32))

    key = Window.partitionBy("place").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        row.groupBy("place", "range").agg(F.sum("size").alias("in_range"))
        .select("place", "range", F.coalesce(F.sum("in_range").over(key), F.lit(0)).alias("before"))
    )
    inside = Window.partitionBy("place", "range").orderBy("shuffle", "doc_id", "size")
    running = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    done = F.col("before") + F.col("running")
    placed = row.withColumn("running", running).join(before, ["place", "range"])
    for p in range(passes):
        placed = placed.withColumn(f"finish_{p}", _finish(p * F.col("source_size") + done))
    placed = kept(placed.drop("running", "before", "range", "n_docs", "weight"))

    total = per_source.agg(F.sum("source_size"), F.sum("n_docs")).first()
    if not total[0]:
        return placed, None
    budget = share * total[0]
    cells = max(64, total[1] // RANGE_ROWS)
    items = placed.where("size > 0").select(
        "place", "size", F.posexplode(F.array(*[f"finish_{p}" for p in range(passes)])).alias("pass", "finish")
    )
    items = items.withColumn("cell", F.floor(F.col("finish") * cells))
    per_cell = items.groupBy("cell").agg(F.sum("size").alias("in_cell"))
    upto = F.sum("in_cell").over(Window.orderBy("cell"))
    hit = per_cell.withColumn("upto", upto).where(F.col("upto") >= budget).orderBy("cell").first()
    if hit is None:
        return placed, None
    order = Window.partitionBy("cell").orderBy("finish", "place", "pass")
    upto = hit["upto"] - hit["in_cell"] + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    cut = (
        items.where(F.col("cell") == hit["cell"])
        .withColumn("upto", upto)
        .where(F.col("upto") >= budget)
        .orderBy("upto")
        .first()
    )
    return placed, (cut["finish"], cut["place"], cut["pass"], int(budget - (cut["upto"] - cut["size"])))


def _sent(finish: Column, number: int, cut) -> Column:
    if cut is None:
        return F.when(finish.isNotNull(), F.col("size")).otherwise(F.lit(-1).cast("long"))
    at, place, which, left = cut
    item, last = F.struct(finish, F.col("place"), F.lit(number)), F.struct(F.lit(at), F.lit(place), F.lit(which))
    return (
        F.when(finish.isNull() | (item > last), F.lit(-1).cast("long"))
        .when((item == last) & (F.col("size") > 0), F.lit(left).cast("long"))
        .otherwise(F.col("size"))
    )


def _slim(docs: DataFrame) -> DataFrame:
    """What the schedule needs of each document: no text is shuffled."""
    return docs.select(
        F.col("doc_id").cast("long"), "source", F.size(words(F.col("text"))).cast("long").alias("size"), _shuffled("doc_id").alias("shuffle")
    )


def _shuffled(doc_id: str) -> Column:
    return F.md5(F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("")).cast("binary"))


def taken_words(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, passes: int = 2) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words sent in all passes).

    NULL text has size 0.  NULL sources are one source, last in order; NULL ids share one shuffle position and are
    put in order by size.  Repeated rows are separate documents.  A source without words has target 0 and
    sends nothing.  The item on the cut sends the words that still fit.  Other columns are ignored.  An empty
    table gives an empty result.
    """
    placed, cut = schedule(_slim(docs), weights, share, passes)
    zero = F.lit(0).cast("long")
    taken = sum([F.greatest(_sent(F.col(f"finish_{p}"), p, cut), zero) for p in range(passes)], zero)
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def resample(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, passes: int = 2) -> DataFrame:
    """The documents the mix sends, whole and once per pass that sends them, with the columns of ``docs``.

    The schedule is one of ids and sizes.  What a pass sends of a source is a head of its shuffled order, so its last
    item, one row per source, decides about every document where it lies.  Documents with equal ids are
    sent together; the document on the cut is sent whole; a source without words is sent once.
    """
    placed, cut = schedule(_slim(docs), weights, share, passes)
    position = F.struct(F.col("_mix_shuffle").alias("shuffle"), F.col("_mix_id").alias("doc_id"))
    last = [
        F.max(F.when((_sent(F.col(f"finish_{p}"), p, cut) >= 0) | ((F.col("source_size") == 0) & F.lit(p == 0)), F.struct("shuffle", "doc_id"))).alias(f"_mix_last_{p}")
        for p in range(passes)
    ]
    heads = kept(placed.groupBy(F.col("source").alias("_mix_source")).agg(*last))
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_mix_row"), F.col("source").alias("_mix_source"),
        _shuffled("doc_id").alias("_mix_shuffle"), F.col("doc_id").cast("long").alias("_mix_id"),
    )
    marked = attach(marked, heads, ["_mix_source"])
    times = sum([F.coalesce(position <= F.col(f"_mix_last_{p}"), F.lit(False)).cast("int") for p in range(passes)], F.lit(0))
    sent = marked.select("_mix_row", F.explode(F.array_repeat(F.lit(0), times)))
    return sent.select(*[F.col(f"_mix_row.`{c}`").alias(c) for c in docs.columns])


SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5(coalesce(doc_id::varchar, '')) as shuffle from documents
), sources as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place
  from sized group by source
), weighted as (
  select *, case place % 3 when 0 then 3 when 1 then 1 else 2 end as weight, 2 * source_size as cap from sources
), levels as (
  select *, (1.5::double * (sum(source_size) over ())::double - coalesce(sum(cap) over before, 0)::double)
         / ((sum(weight) over ()) - coalesce(sum(weight) over before, 0))::double as level
  from weighted
  window before as (order by cap::double / weight, place rows between unbounded preceding and 1 preceding)
), shared as (
  select *, cap::double <= level * weight as is_full, max(level) filter (cap::double > level * weight) over () as lam from levels
), target as (
  select source, place, source_size, case when is_full then cap::double else weight * lam end as target from shared
), items as (
  select s.doc_id, s.size, s.shuffle, t.place, t.source_size, t.target, e.pass,
         e.pass * t.source_size + sum(s.size) over (partition by t.place, e.pass order by s.shuffle, s.doc_id, s.size
           rows between unbounded preceding and current row) as done
  from sized s join target t on s.source is not distinct from t.source, (select unnest([0, 1]) as pass) e
), queue as (
  select *, sum(size) over (order by done::double / target, place, pass, shuffle, doc_id
           rows between unbounded preceding and current row) as upto,
         1.5::double * (select sum(size) from sized)::double as budget
  from items
)
select doc_id, size, source_size, target,
       sum(greatest(0, least(size, floor(budget - (upto - size)))))::bigint as taken
from queue group by doc_id, size, source_size, target
"""
