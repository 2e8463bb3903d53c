"""Line deduplication with a log-template tree.

Words with a digit are variable fields.  The tree has a fixed depth: a line goes to the node of its number of words and its first
three words (variable ones as a wildcard).  Below it a line has the template of all its words and ``PARTS`` templates in which one
part of its words, a fifth of them, is a variable field (the first part covers leading words, so that template hangs on the wildcard
child).  So lines that differ inside one part meet in a template, whatever else is in their node.

A template is recurring if it is in enough *families* of texts: two for long lines, ``MIN_DOCS`` for short ones.  Equal texts are one
text.  Texts that are near copies share the rest of their words too: three-word shingles are dealt to ``SKETCHES`` classes by their hash,
a text has the least hash of each class over its other lines, and texts with the same least hash are one family.  Their number, averaged over
the classes, must be enough, and over half as large as that of the texts (by a margin for the chance in few texts).  So a group of near
copies of any size keeps its lines for near-duplicate removal, while a line that different texts share goes.

Lines are shuffled as hashes, never as text.  All counts combine before the shuffle; a table of texts with recurring lines is broadcast
only when its measured size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clozeframe.llm.common import attach, bind, kept

# Families that make a template recurring, for lines of under and of at least LONG words.
MIN_DOCS, MIN_LONG, LONG = 6, 2, 20
# Shorter lines are headings, list items and the like, and recur by chance.
MIN_WORDS, MIN_CHARS = 3, 15
LEADING = 3
# Parts of a line, one of which may be variable.
PARTS = 5
SKETCHES = 8
# Further families per further text up to which the texts of a template are copies, and what one text adds to that bound.
SHARE, MARGIN = 0.5, 0.4
BOUND = 200_000

SPACES = r"[\x20\x09-\x0D]+"
KEY = ["text_key", "text_size"]


def _masked(line: Column) -> Column:
    """The line with single spaces and a wildcard for every word that has a digit."""
    spaced = F.regexp_replace(F.trim(line), SPACES, " ")
    wild = F.regexp_replace(spaced, "[^ ]*[0-9][^ ]*", "<*>")
    # Most lines have neither digits nor other white space than single spaces.
    return F.when(line.rlike(r"[0-9\x09-\x0D]|\x20\x20"), wild).otherwise(F.trim(line))


def _text_key(text: str = "text") -> list[Column]:
    return [F.xxhash64(text).alias("text_key"), F.octet_length(text).alias("text_size")]


def _templates(masked: Column, n_words: Column) -> Column:
    """Hashes of the line itself and, from ``PARTS`` words on, of its templates with one variable part: what is before and behind it."""
    edge = lambda i: F.floor(n_words * i / PARTS).cast("int")
    head = lambda k: F.call_function("substring_index", masked, F.lit(" "), edge(k))
    rest = lambda k: F.call_function("substring_index", masked, F.lit(" "), edge(k + 1) - n_words)
    without = [F.xxhash64(n_words, F.lit(k), head(k), rest(k)) for k in range(PARTS)]
    return F.when(n_words >= PARTS, F.array(F.xxhash64(masked), *without)).otherwise(F.array(F.xxhash64(masked)))


def _lines(docs: DataFrame) -> DataFrame:
    """Long enough lines as hashes: id, key of the text, at (position), n_words, templates (the line's own hash first)."""
    lines = docs.select(*_text_key(), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.where(F.length(F.trim("line")) >= MIN_CHARS).select(*KEY, "at", _masked(F.col("line")).alias("masked"))
    lines = lines.withColumn("n_words", F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit(""))) + 1)
    return lines.select(F.monotonically_increasing_id().alias("id"), *KEY, "at", "n_words", _templates(F.col("masked"), F.col("n_words")).alias("templates"))


def _sketches(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, sketches) of the texts with these keys: for each class of shingles the two least (hash, position of the line), of different lines."""
    texts = attach(docs.select(*_text_key(), "text"), keys, KEY, BOUND)
    lines = texts.select(*KEY, F.posexplode(F.split("text", "\n")).alias("at", "line"))
    shingles = lambda w: F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    classes = F.sequence(F.lit(0), F.lit(SKETCHES - 1))
    least = lambda hs: F.transform(classes, lambda j: F.array_min(F.filter(hs, lambda h: F.pmod(h, F.lit(SKETCHES)) == j)))
    lines = lines.select(*KEY, F.struct("at", bind(bind(F.split(F.trim("line"), " "), shingles), least).alias("least")).alias("_line"))
    whole = lines.groupBy(*KEY).agg(F.collect_set("_line").alias("_lines"))
    of_class = lambda j: F.transform("_lines", lambda x: F.struct(F.get(x["least"], j).alias("hash"), x["at"].alias("at")))
    two = lambda j: F.slice(F.array_sort(F.filter(of_class(j), lambda s: s["hash"].isNotNull())), 1, 2)
    return whole.select(*KEY, F.transform(classes, two).alias("sketches"))


def _shared(lines: DataFrame) -> DataFrame:
    """Rows (template, k, id, key, at, n_words) of templates that are in at least two different texts; k is 0 for a line's own hash.

    Until it is known which templates these are, rows are a template and a number.
    """
    each = lines.select("id", "text_key", F.posexplode("templates").alias("k", "template"))
    shared = each.groupBy("template").agg(F.min("text_key").alias("_a"), F.max("text_key").alias("_b")).where("_a <> _b").select("template")
    rows = each.drop("text_key").join(shared, "template")
    return kept(rows.join(lines.drop("templates"), "id"))


def _judged(rows: DataFrame, sketches: DataFrame, min_docs: int) -> DataFrame:
    """(template, recurring, copies) of the templates of rows (template, key, at, n_words): in enough families of texts, or in copies."""
    rows = rows.groupBy("template", *KEY).agg(F.min("at").alias("at"), F.max("n_words").alias("n_words"))
    each = rows.join(sketches, KEY)
    # A line says nothing about the rest of its text; a text without any other is a family of its own.
    other = lambda two: F.get(F.filter(two, lambda s: s["at"] != F.col("at")), F.lit(0))["hash"]
    family = lambda two: F.coalesce(other(two), F.col("text_key"))
    placed = each.select("template", "n_words", F.posexplode(F.transform("sketches", family)).alias("j", "family"))
    families = placed.groupBy("template", "j", "family").agg(F.count("*").alias("texts"), F.max("n_words").alias("n_words"))
    counted = families.groupBy("template", "j").agg(F.count("*").alias("families"), F.sum("texts").alias("texts"), F.max("n_words").alias("n_words"))
    counted = counted.groupBy("template").agg(F.avg("families").alias("families"), F.max("texts").alias("texts"), F.max("n_words").alias("n_words"))
    least = F.when(F.col("n_words") >= LONG, MIN_LONG).otherwise(min_docs)
    apart = F.col("families") - 1 > (F.col("texts") - 1) * (SHARE + MARGIN / F.col("texts"))
    # Half a family is left to chance.
    return kept(counted.select("template", (apart & (F.col("families") >= least - 0.5)).alias("recurring"), (~apart).alias("copies")))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, drop: positions of recurring lines) of every distinct text that has one."""
    # The word limit is applied to the kept rows: pushed below, it would mask every line once more.
    rows = _shared(kept(_lines(docs)).where(F.col("n_words") >= MIN_WORDS))
    sketches = kept(_sketches(docs, kept(rows.select(*KEY).distinct())))
    whole = kept(rows.where("k = 0").join(_judged(rows.where("k = 0"), sketches, min_docs), "template"))
    # Lines that recur as they are, and lines of copies, are settled; the others are looked at by their templates.
    others = kept(rows.where("k > 0").join(whole.where("recurring or copies").select("id"), "id", "left_anti"))
    alike = others.join(_judged(others, sketches, min_docs), "template")
    found = whole.where("recurring").select(*KEY, "at").unionByName(alike.where("recurring").select(*KEY, "at"))
    return found.groupBy(*KEY).agg(F.collect_set("at").alias("drop"))


def without_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``, and a last column ``_line_drops`` (how many).

    NULL and empty texts and texts without a recurring line stay as they are, to the character.  Equal texts are one text for
    counting and are treated alike, whatever their ids.  An empty table gives an empty result.
    """
    drops = kept(recurring_lines(docs, min_docs))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_line_row"), F.col("text").alias("_line_text"),
        *[c.alias(f"_line_{name}") for c, name in zip(_text_key(), KEY, strict=True)],
    )
    right = drops.select(*[F.col(k).alias(f"_right_{k}") for k in KEY], F.col("drop").alias("_line_drop"))
    if drops.limit(BOUND + 1).count() <= BOUND:
        right = F.broadcast(right)
    on = [F.col(f"_line_{k}") == F.col(f"_right_{k}") for k in KEY]
    rows = rows.join(right, on[0] & on[1], "left")
    left = F.filter(F.split("_line_text", "\n"), lambda x, i: ~F.array_contains("_line_drop", i))
    text = F.when(F.col("_line_drop").isNotNull(), F.array_join(left, "\n")).otherwise(F.col("_line_text"))
    out = [(text if c == "text" else F.col(f"_line_row.`{c}`")).alias(c) for c in docs.columns]
    return rows.select(*out, F.coalesce(F.size("_line_drop"), F.lit(0)).cast("long").alias("_line_drops"))


def cleaned(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (before), n_dropped, text (after) of every document."""
    counted = docs.select("doc_id", "text", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
    rows = without_recurring_lines(counted)
    return rows.select("doc_id", "n_lines", F.col("_line_drops").alias("n_dropped"), "text")
