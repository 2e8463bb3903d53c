"""Null, sign, rounding and text rules on hand-made rows."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from clozeframe.functions import distribution as dist
from clozeframe.functions import labels, measures, text
from clozeframe.operators import corpus, joins, lexicon, reshape, summaries, windows


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def lit(x):
    return F.lit(x)


def test_facilitation_sign_and_guards(spark):
    assert one(spark, measures.facilitation(lit(0.5), lit(0.25)))[0] == 1.0
    assert one(spark, measures.facilitation(lit(0.0), lit(0.25)))[0] is None
    assert one(spark, measures.facilitation(lit(float("nan")), lit(0.25)))[0] is None
    assert one(spark, measures.facilitation(lit(0.5), lit(0.25), "difference"))[0] == 0.25
    assert one(spark, measures.rel_facilitation(lit(0.5), lit(0.25)))[0] == 1.0
    assert one(spark, measures.surprisal(lit(0.25)))[0] == 2.0
    with pytest.raises(ValueError):
        measures.facilitation(kind="other")


def test_means_skip_null_unless_strict(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    loose, strict, se = df.agg(
        measures.mean("x"), measures.mean("x", strict=True), measures.std_error("x")
    ).first()
    assert (loose, strict, se) == (2.0, None, pytest.approx(1.0))


def test_nan_is_not_positive(spark):
    df = spark.createDataFrame([(0.5, 0.25), (float("nan"), 0.25)], "related_probability double, unrelated_probability double")
    row = summaries.facilitation_summary(df.withColumn("g", lit(1)), ("g",)).first()
    assert (row.facilitation, row.facilitated) == (1.0, 1.0)
    strict = summaries.facilitation_summary(df.withColumn("g", lit(1)), ("g",), strict=True).first()
    assert (strict.facilitation, strict.facilitated) == (None, None)


def test_single_row_group_has_no_deviation(spark):
    df = spark.createDataFrame([("a", 0.5, 0.25)], "g string, related_probability double, unrelated_probability double")
    row = summaries.facilitation_summary(df, ("g",)).first()
    assert row.facilitation == 1.0 and row.se_f is None and row.high_f is None


def test_exclude_keeps_null_keys(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "target string")
    keys = spark.createDataFrame([("a",), (None,)], "target string")
    for salts in (1, 4):
        kept = joins.exclude(df, keys, salts=salts).collect()
        assert sorted(str(r.target) for r in kept) == ["None", "b"]


def test_unclassified_and_null_relations_drop(spark):
    df = spark.createDataFrame([("x",), ("unclassified",), (None,)], "relation string")
    assert [r.relation for r in lexicon.classified(df).collect()] == ["x"]


def test_relation_spelling(spark):
    rows = spark.createDataFrame([("UNCL",), ("Antonyms",), ("FPA",), (None,), ("Script",)], "r string")
    five = [r[0] for r in rows.select(labels.normalise_relation("r")).collect()]
    three = [r[0] for r in rows.select(labels.normalise_relation("r", "three")).collect()]
    assert five == ["unclassified", "antonym", "forward phrasal associate", None, "script"]
    assert three == ["unclassified", "antonym", "fpa", None, "script"]


def test_distinct_before_lower_case(spark):
    df = spark.createDataFrame([("A", "p", "u", "r"), ("a", "p", "u", "r"), ("a", "p", "u", "r")], "target string, prime string, unrelated string, relation string")
    assert lexicon.clean_lexicon(df).count() == 2


def test_extract_gives_null(spark):
    assert one(spark, text.extract(lit("nothing"), "results/(.*)_p"))[0] is None
    assert one(spark, text.extract(lit("results/a_p_b_p.csv"), "results/(.*)_p"))[0] == "a_p_b"


def test_half_even_text(spark):
    assert one(spark, labels.fmt_number(lit(0.125)), labels.fmt_number(lit(4.0)), labels.fmt_number(lit(6.9))) == ("0.12", "4", "6.9")
    assert one(spark, labels.fmt_strip_count(lit("a (1) b (2)")))[0] == "a  b (2)"
    assert one(spark, labels.fmt_percent(lit(0.945)))[0] == "94.500%"


@pytest.mark.parametrize(
    "sentence, word, masked",
    [
        ("the cat sat .", "cat", "the [MASK] sat ."),
        ("the cat", "cat", "the cat"),
        ("cat cat cat.", "cat", "[MASK] [MASK] [MASK]."),
        ("a tom-cat and a cat/dog, cat!", "cat", "a tom-cat and a cat/dog, [MASK]!"),
        ("cats catalog cat's", "cat", "cats catalog [MASK]'s"),
        ("un été chaud", "été", "un [MASK] chaud"),
        ("un réété chaud", "été", "un réété chaud"),
        ("a.b axb a.b.", "a.b", "[MASK] axb [MASK]."),
        ("x a\\Eb y", "a\\Eb", "x [MASK] y"),
    ],
)
def test_mask_word(spark, sentence, word, masked):
    assert one(spark, text.mask_word(lit(sentence), lit(word)))[0] == f"[CLS] {masked} [SEP]"


def test_mask_word_as_pattern(spark):
    assert one(spark, text.mask_word(lit("a.b axb a.b."), lit("a.b"), literal=False))[0] == "[CLS] [MASK] [MASK] [MASK]. [SEP]"


def test_prime_and_mask_index(spark):
    context = lit("[CLS] the [MASK] sat . [SEP]")
    word, sentence = one(spark, text.prime(context, lit("dog")), text.prime(context, lit("dog"), "sentence"))
    assert word == "[CLS] dog. the [MASK] sat . [SEP]"
    assert sentence == "[CLS] the next word is dog. the [MASK] sat . [SEP]"
    assert one(spark, text.mask_index(context), text.mask_index(lit(word)), text.mask_index(lit(sentence))) == (2, 4, 8)
    assert one(spark, text.mask_index(lit("[CLS] [MASK] and [MASK]")))[0] == 1


def test_singletons(spark):
    df = spark.createDataFrame([(["b", "a", "b", "c"],), ([],), (["x", "x"],), (["z"],)], "t array<string>")
    assert [r[0] for r in df.select(text.singletons("t")).collect()] == [["a", "c"], [], [], ["z"]]


def test_carriers(spark):
    sents = spark.createDataFrame([(1, "I am a cat"), (2, "cat and cat"), (3, "a cat")], "id int, sentence string")
    lex = spark.createDataFrame([("cat",), ("cat",), ("am",), ("dog",)], "target string")
    toks = corpus.tokenize(sents)
    repeated = corpus.select_carriers(toks, lex)
    assert sorted((r.target, r.id) for r in repeated.collect()) == [("cat", 1), ("cat", 1), ("cat", 3), ("cat", 3)]
    assert corpus.select_carriers(toks, lex, dedupe=True).count() == 2
    assert tuple(corpus.carrier_stats(repeated).first()) == (4.0, 4)


def test_sample_is_stable_and_bounded(spark):
    df = spark.range(1000).withColumn("k", F.when(F.col("id") < 990, "hot").otherwise("cold"))
    pick = lambda d: sorted((r.k, r.id) for r in corpus.sample_per_key(d, "k", ["id"]).collect())
    first = pick(df)
    assert first == pick(df.repartition(5)) and len(first) == 20
    assert len({i for _, i in first}) == 20
    assert first != sorted((r.k, r.id) for r in corpus.sample_per_key(df, "k", ["id"], seed=5).collect())


def test_top_n_keeps_ties(spark):
    df = spark.createDataFrame([(i, max(0, i - 2)) for i in range(12)] + [(99, 0)], "k int, n int")
    kept = reshape.top_n_ties(df, 10, "n")
    assert kept.count() == 13 and reshape.top_n_ties(df, 2, "n").count() == 2
    assert reshape.top_n_ties(spark.createDataFrame([(1, 5)], "k int, n int"), 10, "n").count() == 1


def test_buckets_need_eleven_rows(spark):
    rows = [("a", i) for i in range(11)] + [("b", i) for i in range(10, -1, -1)]
    df = spark.createDataFrame(rows, "item string, ordinal int")
    out = {(r.item, r.ordinal): r.bucket for r in windows.assign_bucket(df, ["item"], "ordinal").collect()}
    assert [out["a", i] for i in range(11)] == [*range(1, 11), 0] and out["b", 10] == 0
    for n in (10, 12, 5000):
        short = spark.range(n).select(lit("a").alias("item"), F.col("id").alias("ordinal"))
        with pytest.raises(PySparkException, match="without exactly 11 rows"):
            windows.assign_bucket(short, ["item"], "ordinal").collect()


def test_trend_is_minus_one_for_rising_values(spark):
    df = spark.range(11).select(lit("a").alias("item"), "id", (F.col("id") * 2.0).alias("f"))
    assert {round(r.corr, 12) for r in windows.bucket_trend_corr(df, ["item"], "id", "f").collect()} == {-1.0}


def test_ranked_kinds(spark):
    rows = [("a", 5), ("a", 5), ("a", 4), ("a", 3), ("a", 3), ("b", 1), (None, 2), (None, 2)]
    df = spark.createDataFrame(rows, "g string, x int")
    pick = lambda kind, n: sorted((str(r.g), r.x, r.rank) for r in windows.ranked(df, ["g"], ["-x"], n, kind).collect())
    rest = [("None", 2, 1), ("None", 2, 1), ("a", 5, 1), ("a", 5, 1)]
    assert pick("rank", 2) == [*rest, ("b", 1, 1)]
    assert pick("rank", 3) == sorted([*rest, ("a", 4, 3), ("b", 1, 1)])
    assert pick("dense_rank", 2) == sorted([*rest, ("a", 4, 2), ("b", 1, 1)])
    assert [r for r in pick("row_number", 2) if r[0] == "a"] == [("a", 5, 1), ("a", 5, 2)]


def test_wide_rejects_repeated_cells(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0)], "id int, k string, v double")
    assert tuple(reshape.to_wide(df, ["id"], "k", "v", ["a", "b"]).first()) == (1, 2.0, 3.0)
    with pytest.raises(PySparkException, match="several rows"):
        reshape.to_wide(df.union(df), ["id"], "k", "v", ["a", "b"]).collect()


def test_null_groups_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, x double")
    out = {r.x: r.x_standardized for r in windows.zscore(df, ["g"], "x", scale=False).collect()}
    assert out == {1.0: -1.0, 3.0: 1.0, 5.0: 0.0}
    assert [r.x for r in windows.extreme_rows(df, ["g"], "x", "min").where("g is null").collect()] == [1.0]


def test_salted_join_equals_plain_join(spark):
    facts = spark.range(500).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), lit(1).alias("v"))
    lookup = spark.createDataFrame([("hot", 1), ("hot", 2), ("7", 3)], "k string, w int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = joins.lookup_join(facts, lookup, ["k"], how)
        salted = joins.lookup_join(facts, lookup, ["k"], how, salts=7)
        assert plain.exceptAll(salted).isEmpty() and salted.exceptAll(plain).isEmpty()


def test_split_join_repeats_hot_keys_only(spark):
    facts = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 != 1, F.col("id").cast("string")).alias("k"), (F.col("id") % 7).alias("v")
    )
    lookup = spark.range(60_000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("w")).unionByName(
        spark.createDataFrame([("hot", -1), ("hot", -2), (None, -3)], "k string, w bigint")
    )
    assert len(joins.hot_keys(facts, ["k"])) == 1 and joins.hot_keys(lookup, ["k"]) == []
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain, split = joins.lookup_join(facts, lookup, ["k"], how), joins.split_join(facts, lookup, ["k"], how)
        assert plain.columns == split.columns and plain.exceptAll(split).isEmpty() and split.exceptAll(plain).isEmpty()
    plan = joins.split_join(facts.hint("merge"), lookup, ["k"])
    shuffled = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" in shuffled
    # The hot key spreads over sub-keys, and its lookup rows alone are repeated.
    repeated = lookup.withColumn("hot", F.xxhash64("k").isin(joins.hot_keys(facts, ["k"])))
    assert repeated.where("hot").count() == 2


def test_ordinals_of_many_levels(spark):
    n = 200_000
    df = spark.range(n).select(F.format_string("level%06d", F.col("id")).alias("name"), (F.col("id") * 7919 % 1000).alias("size"))
    out = reshape.with_levels(df, "name", "size")
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.toPandas().sort_values("name_ord")
    want = sorted(((-(i * 7919 % 1000), f"level{i:06d}") for i in range(n)))
    assert got.name_ord.tolist() == list(range(1, n + 1)) and got.name.tolist() == [name for _, name in want]


def test_softmax_extremes_and_ties(spark):
    df = spark.createDataFrame([([1000.0, 0.0, 1000.0, -1000.0],)], "s array<double>").withColumn("p", dist.softmax("s"))
    p, rank0, rank1, best, h, outside = df.select(
        "p", dist.rank_at("p", lit(0)), dist.rank_at("p", lit(1)), dist.argmax_index("p"), dist.entropy_bits("p"), dist.prob_at("p", lit(9))
    ).first()
    assert p == [0.5, 0.0, 0.5, 0.0] and (rank0, rank1, best, outside) == (1, 3, 0, None) and h == 1.0


def test_neutral_and_bins(spark):
    neutral = measures.neutral_constraint(lit("x the last word of this sentence is [MASK]"), lit(0.4))
    assert one(spark, neutral, measures.neutral_constraint(lit("x"), lit(0.4))) == (0.0, 0.4)
    df = spark.createDataFrame([(0.0,), (0.1,), (0.11,), (1.0,), (None,)], "constraint double")
    assert [r[0] for r in df.select(measures.bin_constraint()).collect()] == [1, 1, 2, 10, None]


def test_null_keys_match_in_natural_joins(spark):
    keys = "target string, related string, unrelated string, relation string, context string"
    rows = [("a", "b", "c", None, "x"), ("a", "b", "c", "r", "x")]
    results = spark.createDataFrame(rows, keys)
    scores = spark.createDataFrame([(*r, float(i)) for i, r in enumerate(rows)], keys + ", constraint double")
    got = joins.join_constraint(results, scores).select("relation", "constraint").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 0.0), ("r", 1.0)], key=str)


def test_null_keys_match_in_summaries(spark):
    keys = "target string, related string, unrelated string"
    results = spark.createDataFrame(
        [("a", None, "c", 0.2, 0.1), ("a", "b", None, 0.1, 0.4), ("a", "b", "c", 0.3, 0.3)], keys + ", related_probability double, unrelated_probability double"
    ).withColumns({"bucket": lit(1), "context_type": lit("word"), "model": lit("m"), "dataset": lit("word"), "constraint": lit(0.5)})
    lex = spark.createDataFrame([("a", None, "c", "r"), ("a", "b", None, "r"), ("x", "b", "c", "r")], keys + ", relation string")
    top = spark.createDataFrame([("r", 3)], "relation string, n int")
    assert reshape.instance_table(results, lex, top, ["target", "related", "unrelated"]).count() == 2
    assert summaries.relation_summary(results, lex, top).first().facilitated == 0.5
    assert summaries.fix_summary_by_relation(results, lex, top).first().primed == 0.5


def test_levels_keep_null(spark):
    df = spark.createDataFrame([("a", 1), (None, 3), ("b", 2)], "name string, n int")
    assert {r["name"]: r["name_ord"] for r in reshape.with_levels(df, "name", "n").collect()} == {None: 1, "b": 2, "a": 3}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_salted_lookup_is_not_broadcast(spark):
    # The repeats are not in Spark's size estimate, so a repeated lookup looks small enough to collect.
    facts, lookup = spark.range(1000).withColumnRenamed("id", "k"), spark.range(100).withColumnRenamed("id", "k")
    for how in ("inner", "left_anti"):
        plan = _plan(joins.lookup_join(facts, lookup, ["k"], how, salts=8))
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_sample_cuts_frequent_keys_before_sorting(spark):
    rows = [(k, i) for k, n in (("a", 4000), ("b", 60), ("c", 10), ("d", 3), (None, 500)) for i in range(n)] + [("a", 7)] * 30
    df = spark.createDataFrame(rows, "k string, id int").repartition(5)
    early = corpus._early_rows(df, "k", ["id"], 10, corpus.SEED)
    kept = {r.k: r["count"] for r in early.groupBy("k").count().collect()}
    assert kept["c"] == 10 and kept["d"] == 3
    assert 10 <= kept["a"] < 100 and 10 <= kept["b"] < 60 and 10 <= kept[None] < 100
    order = F.md5(F.concat_ws("|", lit(str(corpus.SEED)), "k", F.col("id").cast("string")).cast("binary"))
    hashed = [(str(r.k), r.h, r.id) for r in df.select("k", "id", order.alias("h")).collect()]
    want = sorted(x for k in {h[0] for h in hashed} for x in sorted(h for h in hashed if h[0] == k)[:10])
    got = corpus.sample_per_key(df, "k", ["id"]).select("k", "id", order.alias("h")).collect()
    assert sorted((str(r.k), r.h, r.id) for r in got) == want


def test_sampled_carriers_are_a_sample_of_the_carriers(spark, monkeypatch):
    sents = spark.createDataFrame([(i, 0, ["the", f"w{i % 7}", f"u{i}"] + ["x"] * (i % 3)) for i in range(300)], "doc_id int, line int, tokens array<string>")
    lex = spark.createDataFrame([("the",), ("the",), ("w1",), ("u5",), ("u5",), ("x",)], "target string")
    carriers = corpus.select_carriers(sents, lex)
    rows = lambda d: sorted((r.target, r.doc_id, r.tokens) for r in d.collect())
    want = rows(corpus.sample_per_key(carriers, "target", ["doc_id", "line"]))
    for limit in (corpus.BROADCAST_BYTES, 0):
        monkeypatch.setattr(corpus, "BROADCAST_BYTES", limit)
        assert rows(corpus.sample_carriers(sents, lex, ["doc_id", "line"])) == want
    monkeypatch.setattr(corpus, "CUT_KEYS", 1)
    assert rows(corpus.sample_carriers(sents, lex, ["doc_id", "line"])) == want


def test_items_of_a_short_file_are_spread(spark, tmp_path):
    from clozeframe.plans.views import Views

    part = spark.range(50).selectExpr("id as p_partkey", "id * 1.5D as p_retailprice", "cast(id % 9 as int) as p_size")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    eleven = Views(spark, str(tmp_path)).eleven
    assert eleven.rdd.getNumPartitions() >= 8
    assert windows.assign_bucket(eleven, ["item"], "ordinal").count() == 550
