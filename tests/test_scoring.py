"""Scoring runs against direct computation."""

import math
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clozeframe.functions import text
from clozeframe.operators import cloze, corpus, scoring, stimuli
from clozeframe.plans.catalog_text import LengthScorer
from clozeframe.operators.scoring import ScoreStore
from clozeframe.plans.experiment import (
    finished_cells,
    run_constraint,
    run_entropy,
    run_experiments,
    run_legacy,
    run_priming,
    run_priming_cloze,
)
from clozeframe.session import CLEANUP, computed_once
from clozeframe.sources.schemas import CONSTRAINT_RESULT, ENTROPY_RESULT, LEGACY_PRIMING_RESULT, PRIMING_RESULT

STIMULI = [
    ("cat", "dog", "pen", "category", "[CLS] the [MASK] sat . [SEP]"),
    ("cat", "dog", "pen", "category", "[CLS] the [MASK] sat . [SEP]"),
    ("house", "home", "a", "synonym", "[CLS] [MASK] and garden . [SEP]"),
    ("x", "yy", "zzz", None, "[CLS] it was [MASK] [SEP]"),
]


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(STIMULI, "target string, related string, unrelated string, relation string, context string")


def direct(context, mask, word):
    scorer = LengthScorer()
    s = scorer([context], np.array([mask]))[0]
    p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
    at = scorer.index_of([word])[0]
    return p[at], int((p > p[at]).sum()) + 1, f"w{p.argmax()}", p.max(), -(p * np.log2(p)).sum()


@pytest.mark.parametrize("batch_size, dedupe", [(30, True), (1, False), (2, True)])
def test_score(spark, frame, batch_size, dedupe):
    long = stimuli.conditions_long(stimuli.build_stimuli(frame), ["target", "related"])
    out = scoring.score(long, LengthScorer, ["target"], batch_size=batch_size, dedupe=dedupe).collect()
    assert len(out) == 12
    for r in out:
        got = (r.target_probability, r.target_rank, r.argmax, r.maxprob, r.entropy)
        want = direct(r.cloze, r.mask_index, r.target)
        assert got[1:3] == want[1:3] and (got[0], got[3], got[4]) == pytest.approx((want[0], want[3], want[4]))


def test_priming_run_keeps_copies(spark, frame):
    out = run_priming(frame, LengthScorer, "sentence")
    assert out.columns == PRIMING_RESULT.fieldNames()
    rows = out.collect()
    assert Counter(r.target for r in rows) == {"cat": 2, "house": 1, "x": 1}
    r = next(r for r in rows if r.target == "house")
    assert r.related_context == "[CLS] the next word is home. [MASK] and garden . [SEP]"
    assert r.related_probability == pytest.approx(direct(r.related_context, 7, "house")[0])
    assert r.rp_isolated_probability == pytest.approx(direct(r.context, 1, "home")[0])


def test_double_softmax_is_bounded(spark, frame):
    long = stimuli.conditions_long(stimuli.build_stimuli(frame), ["target"])
    p = [r.target_probability for r in scoring.score(long, LengthScorer, ["target"], renormalised=True).collect()]
    assert all(1 / 16 / math.e <= x <= math.e / 16 for x in p)


def test_constraint_run(spark, frame):
    out = run_constraint(frame, LengthScorer)
    assert out.columns == CONSTRAINT_RESULT.fieldNames() and out.count() == 4
    r = out.where("target = 'house'").first()
    assert (r.constraint, r.entropy) == pytest.approx(direct(r.context, 1, "house")[3:])


def test_experiments_are_partitioned(spark, frame, tmp_path):
    path = str(tmp_path / "runs")
    run_experiments(frame, {"a": LengthScorer, "b": LengthScorer}, ["word", "sentence"], path)
    back = spark.read.parquet(path)
    assert back.groupBy("model", "scenario").count().count() == 4 and back.count() == 16


def counting(folder, fail_on=None):
    """Loads a scorer that notes every context it is asked for in a folder."""
    folder = str(folder)

    def load():
        import os
        import uuid

        # Defined here, so that workers get the class itself.
        class Counting(LengthScorer):
            def __call__(self, contexts, positions):
                with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                    f.write("\n".join(contexts))
                if fail_on and any(fail_on in c for c in contexts):
                    raise RuntimeError("stopped")
                return super().__call__(contexts, positions)

        return Counting()

    return load


def asked_contexts(folder):
    return [line for path in sorted(folder.iterdir()) for line in path.read_text().split("\n")]


def test_a_stopped_run_goes_on_where_it_was(spark, frame, tmp_path):
    path, one, two = str(tmp_path / "runs"), tmp_path / "one", tmp_path / "two"
    one.mkdir(), two.mkdir()
    stopped = {"a": LengthScorer, "b": counting(one, "next word")}
    with pytest.raises(Exception, match="stopped"):
        run_experiments(frame, stopped, ["word", "sentence"], path)
    assert finished_cells(spark, path) == {("a", "word"), ("a", "sentence"), ("b", "word")}
    # A cell that was written but not entered as finished is replaced, not added to.
    spark.read.parquet(path).where("model = 'b'").withColumn("scenario", F.lit("sentence")).write.mode("append").partitionBy("model", "scenario").parquet(path)
    run_experiments(frame, {"a": counting(two), "b": counting(two)}, ["word", "sentence"], path)
    back = spark.read.parquet(path)
    whole = str(tmp_path / "whole")
    run_experiments(frame, {"a": LengthScorer, "b": LengthScorer}, ["word", "sentence"], whole)
    rows = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    assert rows(back) == rows(spark.read.parquet(whole)) and back.count() == 16
    # Only the unfinished cell was scored.
    assert set(asked_contexts(two)) >= {"[CLS] it was [MASK] [SEP]"} and not any(c.startswith("[CLS] dog.") for c in asked_contexts(two))


def test_a_second_mode_scores_no_isolated_context(spark, frame, tmp_path):
    first, second = tmp_path / "first", tmp_path / "second"
    first.mkdir(), second.mkdir()
    store = ScoreStore(str(tmp_path / "scores"))
    plain = {mode: run_priming(frame, LengthScorer, mode) for mode in ("word", "sentence")}
    got = {"word": run_priming(frame, counting(first), "word", store=store, model="m").collect()}
    got["sentence"] = run_priming(frame, counting(second), "sentence", store=store, model="m").collect()
    isolated = {r.context for r in frame.collect()}
    assert isolated <= set(asked_contexts(first)) and not isolated & set(asked_contexts(second)) and asked_contexts(second)
    for mode, rows in got.items():
        assert sorted(map(repr, rows)) == sorted(map(repr, plain[mode].collect()))
    # All is known now; another model is not.
    before = len(list(second.iterdir()))
    run_priming(frame, counting(second), "word", store=store, model="m").collect()
    assert len(list(second.iterdir())) == before
    run_priming(frame, counting(second), "word", store=store, model="other").collect()
    assert len(list(second.iterdir())) > before


CORPUS = ["the cat sat .", "the cat ran .", "the dog sat .", "a cat sat .", "the cat sat ."]


def brute(prev, nxt, word, k):
    spots = []
    for line in CORPUS:
        t = ["[CLS]", *line.split(), "[SEP]"]
        spots += [(t[i - 1], t[i + 1], t[i]) for i in range(1, len(t) - 1)]
    for level, fits in ((3, lambda s: s[:2] == (prev, nxt)), (2, lambda s: s[0] == prev), (1, lambda s: True)):
        counts = Counter(s[2] for s in spots if fits(s))
        if counts:
            break
    mass = sum(counts.values()) + k * (len(counts) + 1)
    p = {w: (n + k) / mass for w, n in counts.items()} | {None: k / mass}
    own = p.get(word, p[None])
    top = min(counts, key=lambda w: (-counts[w], w))
    return level, own, 1 + sum(q > own for q in p.values()), top, p[top], -sum(q * math.log2(q) for q in p.values())


@pytest.mark.parametrize("saved", [False, True])
def test_cloze_brute_force(spark, tmp_path, saved):
    sents = corpus.tokenize(spark.createDataFrame([(s,) for s in CORPUS], "sentence string"))
    model = cloze.fit_cloze(sents, 0.5)
    if saved:
        model.save(str(tmp_path / "model"))
        model = cloze.load_cloze(spark, str(tmp_path / "model"), 0.5)
    asked = [("the", "sat", "cat"), ("the", "sat", "zebra"), ("the", "slept", "dog"), ("zebra", "sat", "cat"), ("[CLS]", "cat", "a"), ("sat", "[SEP]", ".")]
    df = spark.createDataFrame(asked * 3, "prev string, next string, target string")
    rows = cloze.score_cloze(df, model).collect()
    assert len(rows) == 18
    for r in rows:
        want = brute(r.prev, r.next, r.target, 0.5)
        got = (r.level, r.target_probability, r.target_rank, r.argmax, r.maxprob, r.entropy)
        assert (got[0], got[2], got[3]) == (want[0], want[2], want[3])
        assert (got[1], got[4], got[5]) == pytest.approx((want[1], want[4], want[5]))


def test_cloze_run(spark, frame):
    sents = corpus.tokenize(spark.createDataFrame([(s,) for s in CORPUS], "sentence string"))
    out = run_priming_cloze(frame, cloze.fit_cloze(sents, 0.5))
    assert out.columns == PRIMING_RESULT.fieldNames() and out.count() == 4
    r = out.where("target = 'cat'").first()
    assert r.isolated_probability == pytest.approx(brute("the", "sat", "cat", 0.5)[1])
    assert r.rp_related_rank == brute("the", "sat", "dog", 0.5)[2]


def test_neighbours_of_the_first_mask(spark):
    pieces = ["[MASK]", "[CLS]", "[SEP]", " ", "word", "it's", ".", "[", "]", "[AB]", "[ab]", "\u00a0", "\u00e9\u0301", "\t", "\U0001f600", "AB]", "MASK]"]
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(pieces, rng.integers(0, 9)).tolist()) for _ in range(3000)] + [None, "", "[MASK]", "a[MASK] [MASK] b"]
    df = spark.createDataFrame([(t,) for t in texts], "cloze string").withColumn("mask_index", text.mask_index("cloze"))
    want = cloze.mask_neighbours(df).select("cloze", "prev", "next").collect()
    assert cloze.mask_neighbours(df, mask_index=None).select("cloze", "prev", "next").collect() == want


def test_cloze_counts_only_what_is_asked(spark):
    """The corpus is not written out as counts: the second level is counted for the contexts that the upper one lacks."""
    sents = corpus.tokenize(spark.createDataFrame([(s,) for s in CORPUS], "sentence string"))
    model = cloze.fit_cloze(sents, 0.5)
    keys = spark.createDataFrame([("the", "sat"), ("the", "zebra"), (None, "sat")], "prev string, next string")
    got = {(r.prev, r.next, r.token): r.n for r in model.among(3, keys).collect()}
    all_counts = {(r.prev, r.next, r.token): r.n for r in model.counts[3].collect()}
    assert got == {k: n for k, n in all_counts.items() if k[:2] == ("the", "sat")} and got


@pytest.mark.parametrize("lacking", [False, True])
def test_words_are_counted_only_for_contexts_that_lack_neighbours(spark, lacking):
    sents = corpus.tokenize(spark.createDataFrame([(s,) for s in CORPUS], "sentence string"))
    model = cloze.fit_cloze(sents, 0.5)
    asked = [("the", "sat", "cat"), ("the", "slept", "dog")] + [("zebra", "sat", "cat")] * lacking
    rows = cloze.score_cloze(spark.createDataFrame(asked, "prev string, next string, target string"), model).collect()
    assert {(r.prev, r.next, r.target): (r.level, r.target_rank, r.argmax) for r in rows} == {
        a: (w[0], w[2], w[3]) for a in asked for w in [brute(*a, 0.5)]
    }
    assert ("words" in vars(model)) == lacking


def shuffle_files(spark):
    """Names and bytes of the shuffle data that lies on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    found = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in found if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}


def test_texts_move_once_in_a_cloze_run(spark):
    rng = np.random.default_rng(3)
    texts = ["[CLS] " + rng.bytes(3000).hex() + " the [MASK] sat . [SEP]" for _ in range(400)]
    rows = [("cat", "dog", "pen", None, t) for t in texts] + [("cat", "dog", "pen", None, texts[0])] * 2
    frame = spark.createDataFrame(rows, "target string, related string, unrelated string, relation string, context string")
    model = cloze.fit_cloze(corpus.tokenize(spark.createDataFrame([(s,) for s in CORPUS], "sentence string")), 0.5)
    before = shuffle_files(spark)
    out = run_priming_cloze(frame, model).select("context", "related_context", "isolated_probability").collect()
    moved = sum(n for name, n in shuffle_files(spark).items() if name not in before)
    assert moved < 1.5 * sum(map(len, texts))
    assert sorted(r.context for r in out) == sorted(r[4] for r in rows)
    assert [r.isolated_probability for r in out] == pytest.approx([brute("the", "sat", "cat", 0.5)[1]] * len(rows))
    assert all(r.related_context == r.context.replace("[CLS]", "[CLS] dog.") for r in out)


def test_spots_of_other_contexts_do_not_move(spark):
    sents = spark.createDataFrame([([f"a{i}", f"b{i}", f"c{i}"],) for i in range(5000)], "tokens array<string>")
    keys = spark.createDataFrame([("a7", "c7"), ("[CLS]", "b9")], "prev string, next string")
    got = {(r.prev, r.next, r.token) for r in cloze.fit_cloze(sents).near(3, keys).collect()}
    assert {("a7", "c7", "b7"), ("[CLS]", "b9", "a9")} <= got and len(got) < 100


def test_shuffle_files_go_with_a_checkpoint(spark):
    rows = spark.range(20_000).groupBy("id").count()
    before = shuffle_files(spark)
    kept = computed_once(rows, release=True)
    for _ in range(100):
        if not (left := set(shuffle_files(spark)) - set(before)):
            break
        time.sleep(0.2)
    assert not left and kept.count() == 20_000
    assert spark.conf.get(CLEANUP) == "false"


def test_cloze_of_odd_tokens(spark):
    """Neighbours with breaks and signs of escapes are kept apart, a missing token is a word of its context, a missing word is unseen."""
    parts = ["\n", "\\", "\\n", "a", "a\n", "", None]
    sents = [[p, w, q] for p in parts for q in parts for w in ["x", "x\ny", None][: 1 + (parts.index(p) + parts.index(q)) % 3]]
    model = cloze.fit_cloze(spark.createDataFrame([(s,) for s in sents], "tokens array<string>"), 0.5)
    near = lambda p, mark: mark if p is None else p
    asked = [(near(p, "[CLS]"), near(q, "[SEP]"), w) for p in parts for q in parts for w in ("x", "x\ny", None)]
    asked += [(None, "a", "x"), ("a", None, "x"), (None, None, None)]
    rows = cloze.score_cloze(spark.createDataFrame(asked, "prev string, next string, target string"), model).collect()
    assert len(rows) == len(asked)
    counts = Counter((near(s[0], "[CLS]"), near(s[2], "[SEP]"), s[1]) for s in sents)
    for r in rows:
        here = {t: n for (p, q, t), n in counts.items() if (p, q) == (r.prev, r.next)}
        assert (r.level == 3) == bool(here)
        if here and r.prev != "[CLS]" and r.next != "[SEP]":
            n = here.get(r.target, 0) if r.target is not None else 0
            assert r.target_probability == pytest.approx((n + 0.5) / (sum(here.values()) + 0.5 * (len(here) + 1)))
            assert r.target_rank == (1 + sum(m > n for m in here.values()) if n else len(here) + 1)


def test_sparse_metrics_with_huge_scores_and_ties(spark):
    df = spark.createDataFrame(
        [("a", t, s) for t, s in (("w3", 900.0), ("w1", 900.0), ("w2", 0.0))] + [("b", "w9", 1.0)], "k string, t string, s double"
    )
    out = {r.k: r for r in scoring.dist_metrics_long(df, ["k"], "t", "s", F.lit("w2")).collect()}
    assert (out["a"].argmax, out["a"].maxprob, out["a"].rank) == ("w1", 0.5, 3) and out["a"].entropy == pytest.approx(1.0)
    assert out["b"].rank is None and out["b"].maxprob == 1.0


def test_entropy_run(spark):
    contexts = spark.createDataFrame([("[CLS] a [MASK] b [SEP]", 0.5)] * 2 + [("[CLS] [MASK] [SEP]", None)], "context string, constraint double")
    out = run_entropy(contexts, LengthScorer)
    assert out.columns == ENTROPY_RESULT.fieldNames()
    got = {r.context: (r.constraint, r.entropy) for r in out.collect()}
    for context, mask, constraint in (("[CLS] a [MASK] b [SEP]", 2, 0.5), ("[CLS] [MASK] [SEP]", 1, None)):
        assert got[context] == (constraint, pytest.approx(direct(context, mask, "x")[4]))


def test_legacy_run(spark):
    row = (1, 0.5, "cat", "dog", "pen", "[CLS] the [MASK] . [SEP]", "[CLS] dog. the [MASK] . [SEP]", "[CLS] pen. the [MASK] . [SEP]")
    schema = "category int, constraint double, target string, related string, unrelated string, isolated_context string, related_context string, unrelated_context string"
    out = run_legacy(spark.createDataFrame([row, row], schema), LengthScorer)
    assert out.columns == LEGACY_PRIMING_RESULT.fieldNames()
    rows = out.collect()
    assert len(rows) == 2 and rows[0] == rows[1]
    for name, context, mask in (("isolated", row[5], 2), ("related", row[6], 4), ("unrelated", row[7], 4)):
        p, rank, *_ = direct(context, mask, "cat")
        assert (rows[0][f"{name}_probability"], rows[0][f"{name}_rank"]) == (pytest.approx(p), rank)


def test_many_words_of_one_context(spark):
    """A context with 10,000 words: memory follows from the vocabulary, not from the words."""
    import resource

    # Defined here, so that workers get the class itself.
    class WideScorer(LengthScorer):
        size = 30_000

        def index_of(self, words):
            return np.array([int(w[1:]) for w in words])

    rows = spark.range(10_000).select(
        F.lit("[CLS] a [MASK] b [SEP]").alias("cloze"), F.lit(2).alias("mask_index"), F.concat(F.lit("w"), "id").alias("target")
    )

    def peak(frames):
        import pandas as pd

        for f in frames:
            yield pd.DataFrame({"mb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024] * len(f), "rank": f["target_rank"]})

    scored = scoring.score(rows, WideScorer, ["target"])
    got = scored.select("target_rank").mapInPandas(peak, "mb double, rank int").agg(F.max("mb"), F.count("rank")).first()
    s = WideScorer()(["[CLS] a [MASK] b [SEP]"], np.array([2]))[0]
    some = scored.where("target = 'w77'").first()
    assert got[1] == 10_000 and got[0] < 900
    assert some.target_rank == (s > s[77]).sum() + 1


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contexts_move_once_to_be_scored(spark):
    rows = [("t", "r", "u", None, "[CLS] a [MASK] . [SEP]")] * 3 + [("t", "r", "u", "x", "[CLS] a [MASK] . [SEP]")]
    df = spark.createDataFrame(rows, "target string, related string, unrelated string, relation string, context string")
    result = run_priming(df, LengthScorer)
    # Copies are counted, rows of a context gathered, conditions put side by side.
    assert "Join" not in _plan(result) and _plan(result).count("Exchange hashpartitioning") == 3
    assert Counter((r.relation, r.related_context) for r in result.collect()) == {(None, "[CLS] r. a [MASK] . [SEP]"): 3, ("x", "[CLS] r. a [MASK] . [SEP]"): 1}
    legacy = df.selectExpr(
        "1 as category", "0.5D as constraint", "target", "related", "unrelated", "context as isolated_context",
        "concat(context, ' r') as related_context", "if(relation is null, null, context) as unrelated_context",
    ).where("unrelated_context is not null")
    result = run_legacy(legacy, LengthScorer)
    assert "Join" not in _plan(result) and _plan(result).count("Exchange hashpartitioning") == 3
    assert [(r.isolated_context, r.related_context) for r in result.collect()] == [("[CLS] a [MASK] . [SEP]", "[CLS] a [MASK] . [SEP] r")]
    long = df.select("target", F.col("context").alias("cloze"), F.lit(2).alias("mask_index"), F.lit(1).alias("rest"))
    scored = scoring.score(long, LengthScorer, ["target"])
    joins = [line for line in _plan(scored).splitlines() if "Join" in line]
    assert len(joins) == 1 and "_id" in joins[0] and "cloze" not in joins[0]
    assert scored.count() == 4
