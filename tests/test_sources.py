"""Files: fixed schemas, NA markers, provenance by file name, round trips."""

import pytest
from pyspark.sql import functions as F

from clozeframe import sources
from clozeframe.sources import schemas


def write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_stimuli(spark, tmp_path):
    path = write(
        tmp_path, "s.csv", 'target,related,unrelated,relation,context\ncat,dog,pen,category,"[CLS] a ""big"", [MASK] . [SEP]"\n'
    )
    row = sources.read_stimuli(spark, path).first()
    assert (row.target, row.context) == ("cat", '[CLS] a "big", [MASK] . [SEP]')


def test_lexicon_missing_norms(spark, tmp_path):
    head = ",".join(schemas.LEXICON.fieldNames())
    path = write(tmp_path, "l.csv", f"{head}\nNA,dog,pen,category,w,NA,1.5\ncat,dog,pen,,w,NaN,\n")
    rows = sources.read_lexicon(spark, path).orderBy(F.col("target").asc_nulls_first()).collect()
    assert [(r.target, r.relation, r.delta_200ms, r.delta_1200ms) for r in rows] == [
        (None, "category", None, 1.5),
        ("cat", None, None, None),
    ]


def test_stimuli_keep_the_word_na(spark, tmp_path):
    path = write(tmp_path, "s.csv", "target,related,unrelated,relation,context\nNA,dog,pen,category,c\n")
    assert sources.read_stimuli(spark, path).first().target == "NA"


def test_unreadable_numbers_are_errors(spark, tmp_path):
    head = ",".join(schemas.LEXICON.fieldNames())
    path = write(tmp_path, "l.csv", f"{head}\ncat,dog,pen,category,w,high,1.5\n")
    with pytest.raises(Exception, match="no number in column delta_200ms: high"):
        sources.read_lexicon(spark, path).collect()


def test_columns_by_header(spark, tmp_path):
    names = schemas.LEXICON.fieldNames()[::-1]
    path = write(tmp_path, "l.csv", ",".join(names) + "\n1.5,2.5,w,category,pen,dog,cat\n")
    row = sources.read_lexicon(spark, path).first()
    assert (row.target, row.delta_200ms, row.delta_1200ms) == ("cat", 2.5, 1.5)
    short = write(tmp_path, "short.csv", "target,prime\ncat,dog\n")
    with pytest.raises(Exception, match="unrelated"):
        sources.read_lexicon(spark, short).collect()


def test_files_with_different_headers_are_errors(spark, tmp_path):
    names = schemas.LEGACY_PRIMING_RESULT.fieldNames()
    write(tmp_path, "results/m-uncased_word_10.csv", ",".join(names) + "\n" + result_line(1, "a"))
    swapped = [*names[:2], names[3], names[2], *names[4:]]
    write(tmp_path, "results/n-uncased_word_10.csv", ",".join(swapped) + "\n" + result_line(1, "a"))
    with pytest.raises(Exception, match="header|HEADER"):
        sources.read_results(spark, str(tmp_path / "results")).collect()


def test_fix_results_keep_the_constraint_word(spark, tmp_path):
    head = ",".join(schemas.FIX_RESULT.fieldNames()) + "\n"
    lines = "".join(result_line(1, t).replace(",0.5,", f",{c},") for t, c in (("a", "high"), ("b", "low"), ("c", "NA")))
    write(tmp_path, "fix/m-uncased_prior_fix.csv", head + lines)
    rows = sources.read_fix_results(spark, str(tmp_path / "fix")).orderBy("target").collect()
    assert [r.constraint for r in rows] == ["high", "low", None]


def test_line_breaks_in_quotes(spark, tmp_path):
    path = write(tmp_path, "s.csv", 'target,related,unrelated,relation,context\ncat,dog,pen,category,"a\nb"\n')
    rows = sources.read_csv(spark, path, schemas.STIMULI, multi_line=True).collect()
    assert [r.context for r in rows] == ["a\nb"]


def result_line(category, target):
    return f"{category},0.5,{target},r,u,c,rc,uc,0.1,3,0.2,2,NaN,1\n"


def test_results_in_one_scan(spark, tmp_path):
    head = ",".join(schemas.LEGACY_PRIMING_RESULT.fieldNames()) + "\n"
    for model in ("bert-base-uncased", "bert-large-uncased"):
        for mode in ("word", "sentence"):
            write(tmp_path, f"results/{model}_{mode}_10.csv", head + result_line(1, "a") + result_line(0, "b"))
    write(tmp_path, "results/bert-base-uncased_polysemy_free.csv", head + result_line(2, "c"))
    df = sources.read_results(spark, str(tmp_path / "results"))
    assert df.count() == 8 and df.where("unrelated_probability is null").count() == 8
    got = sources.parse_provenance(df).select("model", "context_type", "dataset").distinct().collect()
    assert {tuple(r) for r in got} == {
        (m, t, t) for m in ("bert-base-uncased", "bert-large-uncased") for t in ("word", "sentence")
    }
    everything = sources.parse_provenance(sources.read_results(spark, str(tmp_path / "results"), glob=None), "fix")
    fixed = everything.where(F.col("dataset") == "After Fix").first()
    assert (fixed.model, fixed.dataset_ord, everything.where("dataset_ord = 0").count()) == ("bert-base-uncased", 1, 8)


def test_unknown_variant(spark):
    with pytest.raises(ValueError):
        sources.parse_provenance(spark.range(1).withColumn("file", F.lit("x")), "other")


def test_constraint_file_names(spark):
    df = spark.createDataFrame([("data/constraints_m1.csv",), ("data/other.csv",)], "file string")
    assert [r.model for r in sources.parse_provenance(df, "constraint").collect()] == ["m1", None]


def test_contexts_rename(spark, tmp_path):
    path = write(tmp_path, "u.csv", "isolated_context,constraint,category\nabc,0.25,3\n")
    row = sources.read_contexts(spark, path).first()
    assert (row.context, row.constraint, row.category) == ("abc", 0.25, 3)


def test_sentences(spark, tmp_path):
    path = write(tmp_path, "stories.txt", "One line .\n\nAnother line .\n")
    rows = sources.read_sentences(spark, path).collect()
    assert sorted(r.sentence for r in rows) == ["Another line .", "One line ."]
    assert len({r.sent_id for r in rows}) == 2


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([("a", 'x "y", z', 1.5), ("b", "q", None)], "model string, t string, v double")
    path = str(tmp_path / fmt)
    sources.write_table(df, path, fmt, ("model",))
    reader = spark.read.option("header", True).option("escape", '"').option("inferSchema", True)
    back = (reader.csv(path) if fmt == "csv" else spark.read.parquet(path)).select("model", "t", "v")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_union_fills_missing_columns(spark):
    one = spark.range(1).toDF("id")
    out = sources.union_files([one, one.withColumn("x", F.lit(2))])
    assert sorted(str(r.x) for r in out.collect()) == ["2", "None"]
