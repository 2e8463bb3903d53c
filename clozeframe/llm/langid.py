"""Language identification by nearest centroid.

A text is a TF-IDF vector of hashed byte n-grams (of 1 to 3 bytes inside words), with logarithmic term frequency, normalised to length one.
Every language has several centroids, found by spherical k-means on a bounded sample; a text gets the language of the centroid
with the largest cosine.  The score combines the margin over the next language with rejection by distance: a text
farther from its centroid than nearly all texts of that language in the sample is marked as rejected and its score is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clozeframe.llm.common import attach, giving_back, held_out, kept, slices

UNKNOWN = "und"
# At most so many documents are learnt from, an equal number per language in the order of a hash of their ids, and at least LEAST of a language.
SAMPLE, LEAST = 4_000, 20
BUCKETS = 1 << 12
CENTROIDS = 3
ROUNDS = 8
# Share of the sample of a language that lies within its rejection distance.
WITHIN = 0.995
SHARPNESS = 25.0
PIECE = 1 << 16


def _codes(data: np.ndarray) -> np.ndarray:
    """Bucket of the 1-, 2- and 3-grams that end at each byte (three rows)."""
    a = data.astype(np.uint32)
    grams = np.zeros((3, len(a)), dtype=np.uint32)
    grams[0] = a
    grams[1, 1:] = (a[:-1] << 8) | a[1:] | (1 << 24)
    grams[2, 2:] = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:] | (2 << 24)
    return ((grams * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)


def vectors(texts: pa.Array, idf: np.ndarray | None = None) -> np.ndarray:
    """One unit row per text (zero for an empty one); without ``idf`` the plain counts."""
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    # White space, digits and punctuation part words; of their runs one space remains.
    lower = pc.replace_substring_regex(lower, r"[^\p{L}\p{M}]+", " ")
    out = np.zeros((len(lower), BUCKETS), dtype=np.float32)
    for i, text in enumerate(lower.to_numpy(zero_copy_only=False)):
        data = np.frombuffer(b" " + text.encode() + b" ", dtype=np.uint8)
        for at in range(0, len(data), PIECE):
            codes = _codes(data[max(0, at - 2) : at + PIECE])[:, min(at, 2) :]
            out[i] += np.bincount(codes.ravel(), minlength=BUCKETS)
    if idf is None:
        return out
    np.log1p(out, out=out)
    out *= idf
    norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norms > 0, norms, 1)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    nearest: np.ndarray  # least cosine per centroid at which a text is accepted

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the text is rejected."""
        given = np.array([has_letter(t) for t in texts.to_numpy(zero_copy_only=False)], dtype=bool)
        if not self.languages:
            return [UNKNOWN] * len(given), np.zeros(len(given)), np.ones(len(given), dtype=bool)
        cosine = vectors(texts, self.idf) @ self.centroids.T
        per = np.stack([cosine[:, self.owner == k].max(axis=1) for k in range(len(self.languages))], axis=1)
        best = per.argmax(axis=1)
        chance = np.exp(SHARPNESS * (per - per.max(axis=1, keepdims=True)))
        score = 1 / chance.sum(axis=1)
        at = np.where(self.owner[None, :] == best[:, None], cosine, -1).argmax(axis=1)
        value = cosine[np.arange(len(at)), at]
        rejected = (value < self.nearest[at]) | ~given
        score = np.where(rejected, score * np.clip(value / np.maximum(self.nearest[at], 1e-6), 0, 1), score)
        names = [self.languages[b] if g else UNKNOWN for b, g in zip(best.tolist(), given.tolist(), strict=True)]
        return names, np.where(given, score, 0.0).astype(float), rejected


def fit(names: list[str], counts: np.ndarray, seed: int = 3) -> Model:
    """Fit on the languages and n-gram counts of texts that have a letter; languages in code-point order."""
    languages = sorted(set(names))
    if not languages:
        return Model([], np.zeros(BUCKETS), np.zeros((0, BUCKETS)), np.zeros(0), np.zeros(0))
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    counts = np.log1p(counts, dtype=np.float32)
    counts *= idf
    x = counts / np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    centroids, owner, nearest = [], [], []
    for k, language in enumerate(languages):
        rows = x[np.array(names) == language]
        c = rows[np.random.default_rng(seed).permutation(len(rows))[: min(CENTROIDS, len(rows))]]
        for _ in range(ROUNDS):
            member = (rows @ c.T).argmax(axis=1)
            sums = np.stack([rows[member == j].sum(axis=0) if (member == j).any() else c[j] for j in range(len(c))])
            c = sums / np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        similarity = rows @ c.T
        member = similarity.argmax(axis=1)
        for j in range(len(c)):
            own = similarity[member == j, j]
            nearest.append(np.quantile(own, 1 - WITHIN) if len(own) else 0.0)
        centroids.append(c)
        owner += [k] * len(c)
    return Model(languages, idf, np.concatenate(centroids), np.array(owner), np.array(nearest))


def sampled(known: DataFrame, sample: int, least: int) -> DataFrame:
    """(id, lang) of an equal number of documents per language, in the order of a hash of their ids.

    From the size of a language follows a hash threshold below which there are a little more than enough, and only those are ranked.
    """
    ids = kept(known.select(F.col("doc_id").alias("id"), "lang").distinct())
    sizes = kept(ids.groupBy("lang").agg(F.count("*").alias("n")))
    each = max(least, sample // max(1, sizes.count()))
    share = (each + 6 * each**0.5 + 50) / F.col("n")
    hashed = F.xxhash64("id")
    near = attach(ids, sizes, ["lang"]).where((share >= 1) | (hashed <= (share * 2.0**64 - 2.0**63)))
    order = Window.partitionBy("lang").orderBy(hashed, "id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each).select("id", "lang")


def counted(texts: DataFrame) -> DataFrame:
    """lang, buckets, counts: the n-gram counts of texts that have a letter; at most ``BUCKETS`` of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                given = pa.array([has_letter(t) for t in part.column("text").to_pylist()], pa.bool_())
                part = part.filter(given)
                for at in range(0, part.num_rows, 1024):
                    rows = part.slice(at, 1024)
                    dense = vectors(rows.column("text"))
                    found = [np.flatnonzero(v) for v in dense]
                    columns = [rows.column("lang"), pa.array([f.astype(np.int32) for f in found], pa.list_(pa.int32()))]
                    columns.append(pa.array([v[f] for v, f in zip(dense, found, strict=True)], pa.list_(pa.float32())))
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "buckets", "counts"])

    return texts.select("lang", "text").mapInArrow(giving_back(run), "lang string, buckets array<int>, counts array<float>")


def learn(docs: DataFrame, sample: int = SAMPLE, least: int = LEAST) -> Model:
    """Learn from at most ``sample`` documents whose crc32 does not leave 1 modulo 3, or ``least`` of each language if these are more.

    Texts are reduced to at most ``BUCKETS`` counts in the tasks, so what comes to the driver is bounded in bytes.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), 3, 1))
    chosen = kept(sampled(known, sample, least).select(F.col("id").alias("doc_id"), F.col("lang").alias("_lang")))
    # Ids are bounded by the sample.
    texts = known.join(F.broadcast(chosen), (known["doc_id"].eqNullSafe(chosen["doc_id"])) & (known["lang"] == chosen["_lang"])).select("lang", "text")
    rows = counted(texts).orderBy("lang", F.xxhash64("buckets", "counts")).collect()
    dense = np.zeros((len(rows), BUCKETS), dtype=np.float32)
    for i, r in enumerate(rows):
        dense[i, r["buckets"]] = r["counts"]
    return fit([r["lang"] for r in rows], dense)


def predicted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document.

    NULL texts and texts without a letter are ``und`` with score 0.  Without a learnt language everything is.  Repeated rows
    are predicted alike, other columns are ignored, an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text", "lang")
    model = docs.sparkSession.sparkContext.broadcast(model or learn(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                for at in range(0, part.num_rows, 1024):
                    rows = part.slice(at, 1024)
                    names, score, rejected = model.value.predict(rows.column("text"))
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)],
                        ["doc_id", "lang_pred", "score", "rejected"],
                    )

    found = docs.select("doc_id", "text").mapInArrow(giving_back(run), "doc_id bigint, lang_pred string, score double, rejected boolean")
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score", "rejected")
