"""Queries on cleaned lexicons, joined results, summaries and reshapes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from clozeframe import sources
from clozeframe.functions import labels, measures, text
from clozeframe.operators import joins, lexicon, ordered, reshape, summaries, windows
from clozeframe.plans.registry import query
from clozeframe.plans.reports import neutral_report
from clozeframe.plans.views import NORMS
from clozeframe.session import shared_folder
from clozeframe.sources.readers import union_files
from clozeframe.sources.schemas import LEGACY_PRIMING_RESULT, STIMULI
from clozeframe.sources.writers import write_table

KEYS3 = ["target", "related", "unrelated"]

# --- lexicon --------------------------------------------------------------------------------------


@query("select target, related, unrelated, relation, delta_200ms, delta_1200ms from lex", "delta_200ms")
def clean_lexicon(v):
    return v.lex


@query(
    """select lower(target) as target, lower(prime) as related, lower(unrelated) as unrelated,
              case when lower(relation) like '%uncl%' then 'unclassified'
                   when lower(relation) like '%anton%' then 'antonym' else lower(relation) end as relation,
              delta_200ms, delta_1200ms
       from (select distinct target, prime, unrelated, relation, delta_200ms, delta_1200ms from raw_lex)""",
    "delta_200ms",
)
def clean_lexicon_lower_primes(v):
    return lexicon.clean_lexicon(v.raw_lex, "three", lower_primes=True)


@query("select target from same")
def same_targets(v):
    return lexicon.same_targets(v.lex)


_PROBLEM = "select distinct target from lex where delta_200ms is null or delta_1200ms is null"


@query(_PROBLEM)
def problematic_targets(v):
    return lexicon.problematic_targets(v.lex, NORMS)


@query("select model, bucket, target, related, unrelated, unrelated_rank from kept")
def results_without_same_targets(v):
    return v.kept.select("model", "bucket", "target", "related", "unrelated", "unrelated_rank")


@query(f"""
    select model, bucket, target, unrelated_rank from scored
    where target not in ({_PROBLEM}) and target not in ('t1', 't2')""")
def results_without_problematic_targets(v):
    kept = lexicon.exclude_targets(v.scored, v.lex, NORMS, ["t1", "t2"])
    return kept.select("model", "bucket", "target", "unrelated_rank")


# --- rows -----------------------------------------------------------------------------------------


@query(
    """select model, bucket, target, "constraint", unrelated_rank from scored
       where bucket <> 0 and "constraint" > 0.3 and "constraint" < 0.7 and model in ('A', 'N') and unrelated_rank <> 1""",
    "constraint",
)
def filtered_results(v):
    c = F.col
    return v.scored.where(
        (c("bucket") != 0)
        & (c("constraint") > 0.3)
        & (c("constraint") < 0.7)
        & c("model").isin("A", "N")
        & (c("unrelated_rank") != 1)
    ).select("model", "bucket", "target", "constraint", "unrelated_rank")


@query(
    """select model, target, log2(related_probability) - log2(unrelated_probability) as bits,
              ln(related_probability) - ln(unrelated_probability) as nats,
              related_probability - unrelated_probability as difference from scored""",
    "bits nats difference",
)
def facilitation_columns(v):
    return v.scored.select(
        "model", "target", *[measures.facilitation(kind=k).alias(k) for k in ("bits", "nats", "difference")]
    )


@query(
    """select model, target, -log2(isolated_probability) as surprisal,
              log2(related_probability) - log2(isolated_probability) as rf,
              related_probability - isolated_probability as distraction from scored""",
    "surprisal rf distraction",
)
def surprisal_columns(v):
    return v.scored.select(
        "model",
        "target",
        measures.surprisal("isolated_probability").alias("surprisal"),
        measures.rel_facilitation().alias("rf"),
        measures.distraction().alias("distraction"),
    )


@query(
    """select doc_id, line, context,
              case when contains(context, 'the last word of this sentence') then 0.0::double
                   else length(context) / 1000.0::double end as "constraint"
       from (select doc_id, line, case when line % 5 = 0 then replace(context, '[CLS]', '[CLS] the last word of this sentence is')
                                       else context end as context from stimuli)""",
    "constraint",
)
def neutral_contexts(v):
    neutral = F.replace("context", F.lit("[CLS]"), F.lit("[CLS] the last word of this sentence is"))
    rows = v.stimuli.withColumn("context", F.when(F.col("line") % 5 == 0, neutral).otherwise(F.col("context")))
    scores = F.length("context") / F.lit(1000.0)
    return rows.select("doc_id", "line", "context", measures.neutral_constraint("context", scores).alias("constraint"))


@query(
    """select target, bucket, bucket / 10.0::double as unit_bucket,
              cast(greatest(1, least(10, ceil("constraint" * 10.0::double))) as integer) as bin from scored""",
    "unit_bucket",
)
def constraint_bins(v):
    return v.scored.select(
        "target", "bucket", measures.unit_bucket().alias("unit_bucket"), measures.bin_constraint().alias("bin")
    )


_TITLE = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


@query(f"""
    select relation, n, relation || ' (' || n || ')' as label, relation || '(' || n || ')' as tight_label,
           {_TITLE.format("relation")} as title from pair_counts""")
def report_labels(v):
    counts = lexicon.relation_counts(v.lex, v.kept)
    label = labels.fmt_count("relation", "n")
    return counts.select(
        "relation",
        "n",
        label.alias("label"),
        labels.fmt_count("relation", "n", space=False).alias("tight_label"),
        labels.fmt_title(labels.fmt_strip_count(label)).alias("title"),
    )


# --- joins ----------------------------------------------------------------------------------------


@query("select model, bucket, target, related, unrelated, unrelated_rank, relation from related_results")
def results_with_relation(v):
    return v.related_results.select("model", "bucket", "target", "related", "unrelated", "unrelated_rank", "relation")


@query("select model, bucket, target, related, unrelated, unrelated_rank, relation from related_results")
def results_with_relation_salted(v):
    out = joins.join_lexicon(v.kept, v.lex, salts=8)
    return out.select("model", "bucket", "target", "related", "unrelated", "unrelated_rank", "relation")


@query("select model, bucket, target, related, unrelated, unrelated_rank, relation from related_results")
def results_with_relation_split(v):
    out = joins.split_join(v.kept, v.lex.select(*KEYS3, "relation"), KEYS3)
    return out.select("model", "bucket", "target", "related", "unrelated", "unrelated_rank", "relation")


_NORMS_SQL = """
    select model, bucket, kept.target, unrelated_rank, f, task, delta
    from kept join (select target, related, unrelated, 'delta_200ms' as task, delta_200ms as delta from lex
                    union all select target, related, unrelated, 'delta_1200ms', delta_1200ms from lex) n
      using (target, related, unrelated)"""


@query(_NORMS_SQL, "f delta")
def results_with_norms(v):
    rows = v.kept.withColumn("f", measures.facilitation())
    rows = rows.select("model", "bucket", *KEYS3, "unrelated_rank", "f")
    joined = joins.join_norms(rows, v.lex, NORMS)
    return joined.select("model", "bucket", "target", "unrelated_rank", "f", "task", "delta")


@query("select model, bucket, target, unrelated_rank, relation, n from related_results join top using (relation)")
def results_with_counts(v):
    rows = v.related_results.select("model", "bucket", "target", "unrelated_rank", "relation")
    return joins.attach_counts(rows, v.top)


@query("select model, bucket, target, unrelated_rank, relation from related_results where relation in (select relation from top)")
def top_relation_members(v):
    rows = v.related_results.select("model", "bucket", "target", "unrelated_rank", "relation")
    return joins.keep_members(rows, v.top)


_MEAN_SCORES = """
    select target, related, unrelated, relation, context, avg("constraint") as "constraint", avg(entropy) as entropy
    from stimulus_scores group by target, related, unrelated, relation, context"""


@query(_MEAN_SCORES, "constraint entropy")
def mean_scores(v):
    return summaries.mean_scores(v.stimulus_scores)


@query(
    f"""select r.model, r.target, r.relation, r.isolated_context as context, r.unrelated_rank, m."constraint"
        from related_results r join ({_MEAN_SCORES}) m
          on r.target = m.target and r.related = m.related and r.unrelated = m.unrelated
             and r.relation is not distinct from m.relation and r.isolated_context = m.context""",
    "constraint",
)
def results_with_constraint(v):
    rows = v.related_results.drop("constraint").withColumnRenamed("isolated_context", "context")
    scores = summaries.mean_scores(v.stimulus_scores)
    return joins.join_constraint(rows, scores).select(
        "model", "target", "relation", "context", "unrelated_rank", "constraint"
    )


@query(
    'select model, target, isolated_context, "constraint", entropy from kept join context_entropy using (isolated_context)',
    "constraint entropy",
)
def results_with_entropy(v):
    out = joins.join_entropy(v.kept, v.context_entropy, constraint=None)
    return out.select("model", "target", "isolated_context", "constraint", "entropy")


@query(
    """select k.model, k.target, k.isolated_context, k."constraint", c.entropy
       from kept k join (select distinct isolated_context, "constraint", entropy
                         from scored join context_entropy using (isolated_context)) c
         on k.isolated_context = c.isolated_context and round(k."constraint", 12) = round(c."constraint", 12)""",
    "constraint entropy",
)
def results_with_context_entropy(v):
    contexts = joins.join_entropy(v.scored, v.context_entropy, constraint=None)
    contexts = reshape.distinct_on(contexts, ["isolated_context", "constraint", "entropy"])
    out = joins.join_entropy(v.kept, contexts)
    return out.select("model", "target", "isolated_context", "constraint", "entropy")


# --- summaries ------------------------------------------------------------------------------------

_F_COLUMNS = """avg(f) as facilitation, 1.96::double * stddev_samp(f) / sqrt(count(f)) as se_f,
    avg(cast(f > 0 as double)) as facilitated"""
_F_SUMMARY = f"""
    select *, facilitation + se_f as high_f, facilitation - se_f as low_f
    from (select {{by}}, {_F_COLUMNS} from kept group by {{by}})"""
_F_DOUBLES = "facilitation se_f facilitated high_f low_f"


@query(_F_SUMMARY.format(by="model, bucket, context_type, dataset"), _F_DOUBLES)
def facilitation_summary(v):
    return summaries.facilitation_summary(v.kept)


@query(f"select * from ({_F_SUMMARY.format(by='model, bucket, context_type, dataset')}) where bucket = 0", _F_DOUBLES)
def facilitation_summary_neutral(v):
    return summaries.split_neutral(summaries.facilitation_summary(v.kept))[0]


@query(f"select * from ({_F_SUMMARY.format(by='model, bucket, context_type, dataset')}) where bucket <> 0", _F_DOUBLES)
def facilitation_summary_binned(v):
    return summaries.split_neutral(summaries.facilitation_summary(v.kept))[1]


_R_SUMMARY = """
    select *, f + se as high, f - se as low, relation || ' (' || n || ')' as label
    from (select {by}, relation, n, avg(f) as f, 1.96::double * stddev_samp(f) / sqrt(count(f)) as se,
                 avg(cast(f > 0 as double)) as facilitated
          from related_results join top using (relation) group by {by}, relation, n)"""
_R_DOUBLES = "f se facilitated high low"


@query(_R_SUMMARY.format(by="bucket, context_type"), _R_DOUBLES)
def relation_summary(v):
    return summaries.relation_summary(v.kept, v.lex, v.top)


@query(_R_SUMMARY.format(by="bucket, context_type, model"), _R_DOUBLES)
def relation_summary_by_model(v):
    return summaries.relation_summary(v.kept, v.lex, v.top, ("bucket", "context_type", "model"))


def _shares_sql(shares: dict[str, tuple[str, str]], by: str = "bucket, model, dataset") -> str:
    return " union all ".join(
        f"select {by}, '{metric}' as metric, avg(cast({cond} as double)) as proportion, '{label}' as label "
        f"from kept group by {by}"
        for metric, (cond, label) in shares.items()
    )


@query(
    _shares_sql(
        {
            "facilitated": ("f > 0", "P(T | R) > P(T | U)"),
            "worse": ("isolated_probability > related_probability", "P(T | R) < P(T)"),
        }
    ),
    "proportion",
)
def distraction_shares(v):
    return summaries.distraction_shares(v.kept)


_CRITERIA = {
    "pre": ("f > 0", "F > 0"),
    "post": ("f > 0 and related_probability > isolated_probability", "F > 0 and P(T | R, C) > P(T | C)"),
}


@query(_shares_sql(_CRITERIA), "proportion")
def criterion_shares(v):
    return summaries.criterion_shares(v.kept)


@query(
    _shares_sql(_CRITERIA | {"post2": ("f > 0 and rf > 0", "F > 0 and RF > 0")}, "category, context_type, model"),
    "proportion",
)
def criterion_shares_relative(v):
    return summaries.criterion_shares(v.kept, ("category", "context_type", "model"), with_rf=True)


@query(
    """select model, context_type, bucket,
              avg(cast(isolated_argmax = related_argmax and related_argmax = unrelated_argmax as double)) as prediction_unchanged,
              avg(cast(related = related_argmax as double)) as prime_predicted,
              avg(cast(related = related_argmax and f < 0 as double)) as related_target_demotion,
              avg(cast(target = isolated_argmax and isolated_probability > related_probability as double)) as target_predicted,
              avg(cast(target = unrelated_argmax and unrelated_probability > related_probability as double)) as target_unrelated
       from kept group by model, context_type, bucket""",
    "prediction_unchanged prime_predicted related_target_demotion target_predicted target_unrelated",
)
def argmax_shares(v):
    return summaries.argmax_shares(v.kept, ("model", "context_type", "bucket"))


@query(
    """select category, avg("constraint") as "constraint"
       from (select distinct category, "constraint", target, related, unrelated from kept) group by category""",
    "constraint",
)
def mean_constraint_by_bin(v):
    return summaries.mean_constraint_by_bin(v.kept)


_RAW = """
    select distinct target, related, unrelated, category, "constraint", model, context_type, entropy, f as facilitation
    from kept join context_entropy using (isolated_context)"""


@query(_RAW, "constraint entropy facilitation")
def raw_results(v):
    return summaries.raw_results(joins.join_entropy(v.kept, v.context_entropy, constraint=None))


@query(f"select model, category, avg(entropy) as entropy from ({_RAW}) group by model, category", "entropy")
def mean_entropy_by_bin(v):
    raw = summaries.raw_results(joins.join_entropy(v.kept, v.context_entropy, constraint=None))
    return summaries.mean_entropy_by_bin(raw)


_FIX = """count(*) as n, avg(diff) as facilitation,
    avg(ln(related_probability) - ln(unrelated_probability)) as facilitation_surprisal,
    avg(cast(diff > 0 as double)) as primed, avg(cast(diff >= 0 as double)) as primed_or_equal"""


@query(
    f"select model, dataset, bucket, {_FIX} from kept group by model, dataset, bucket",
    "facilitation facilitation_surprisal primed primed_or_equal",
)
def fix_summary(v):
    return summaries.fix_summary(v.kept, ("model", "dataset", "bucket"))


@query(
    f"select model, bucket, {_FIX} from kept where dataset = 'word' group by model, bucket",
    "facilitation facilitation_surprisal primed primed_or_equal",
)
def fix_summary_one_dataset(v):
    return summaries.fix_summary(v.kept.where(F.col("dataset") == "word"), ("model", "bucket"))


@query(
    """select model, dataset, bucket, relation, n, avg(cast(diff > 0 as double)) as primed, avg(diff) as facilitation,
              relation || '(' || n || ')' as label
       from related_results join top using (relation) group by model, dataset, bucket, relation, n""",
    "primed facilitation",
)
def fix_summary_by_relation(v):
    return summaries.fix_summary_by_relation(v.kept, v.lex, v.top, ("model", "dataset", "bucket"))


@query(
    """select model, bucket, avg(f) as facilitation, stddev_samp(f) as sd, avg(cast(f > 0 as double)) as primed
       from kept group by model, bucket""",
    "facilitation sd primed",
)
def mean_sd_share(v):
    return summaries.mean_sd_share(v.kept, ("model", "bucket"))


@query(
    """select model, bucket, count(*) as n, avg(f) as f, avg(f) + stddev_samp(f) as high, avg(f) - stddev_samp(f) as low
       from kept group by model, bucket""",
    "f high low",
)
def mean_bounds_deviation(v):
    return summaries.mean_bounds(v.kept, ("model", "bucket"), "sd")


@query(
    """select model, bucket, relation, count(*) as n, avg(f) as f,
              avg(f) + 1.96::double * stddev_samp(f) / sqrt(count(f)) as high,
              avg(f) - 1.96::double * stddev_samp(f) / sqrt(count(f)) as low
       from related_results where relation in (select relation from top) group by model, bucket, relation""",
    "f high low",
)
def mean_bounds_error_by_relation(v):
    rows = joins.keep_members(v.related_results, v.top)
    return summaries.mean_bounds(rows, ("model", "bucket", "relation"), "se")


@query("select relation, n from pair_counts")
def relation_pair_counts(v):
    return lexicon.relation_counts(v.lex, v.kept)


@query("""
    select relation, count(*) as n from lex
    where relation is not null and relation <> 'unclassified' group by relation""")
def relation_row_counts(v):
    return lexicon.relation_counts(v.lex)


@query(
    """select b.*, (select min(f) from kept k where k.model = b.model and k.bucket = b.bucket and k.f >= q1 - 1.5::double * (q3 - q1)) as whisker_low,
              (select max(f) from kept k where k.model = b.model and k.bucket = b.bucket and k.f <= q3 + 1.5::double * (q3 - q1)) as whisker_high
       from (select model, bucket, count(f) as n, min(f) as min, quantile_cont(f, 0.25) as q1, quantile_cont(f, 0.5) as median,
                    quantile_cont(f, 0.75) as q3, max(f) as max from kept group by model, bucket) b""",
    "min q1 median q3 max whisker_low whisker_high",
)
def box_plot_data(v):
    return ordered.box_stats(v.kept, ["model", "bucket"], measures.facilitation())


_GRID = 64


@query(
    f"""with d as (select 'delta_200ms' as task, delta_200ms as x from lex where delta_200ms is not null
                   union all select 'delta_1200ms', delta_1200ms from lex where delta_1200ms is not null),
            g as (select task, count(*) as n, min(x) as lo, max(x) as hi,
                         0.9::double * least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34::double)
                         * power(count(*), -0.2::double) as bw from d group by task),
            s as (select *, lo - 3.0::double * bw as start,
                         (hi + 3.0::double * bw - (lo - 3.0::double * bw)) / {_GRID - 1} as step from g),
            w as (select d.task, floor((x - start) / step) as cell, (x - start) / step - floor((x - start) / step) as part
                  from d join s using (task)),
            c as (select task, cell + side as cell, sum(case side when 0 then 1.0::double - part else part end) as weight
                  from w cross join (values (0), (1)) as t(side) group by all)
       select s.task, s.bw, cast(i as integer) as point, start + i * step as x,
              sum(weight * exp(-0.5::double * power((i - cell) * step / s.bw, 2))) / (s.n * s.bw * sqrt(2 * pi())) as density
       from s join c using (task) cross join (select unnest(range({_GRID})) as i) group by s.task, s.bw, s.n, i, start, step""",
    "bw x density",
)
def norm_density(v):
    long = reshape.to_long(v.lex.select("target", *NORMS), NORMS, "task", "delta")
    return ordered.density(long, ["task"], "delta", grid=_GRID)


# --- group values on rows -------------------------------------------------------------------------


@query(
    """select model, bucket, target, diff as facilitation, unrelated_rank
       from (select *, max(diff) over (partition by model, bucket) as best from kept) where diff = best""",
    "facilitation",
)
def most_facilitated_rows(v):
    rows = v.kept.withColumn("facilitation", measures.facilitation(kind="difference"))
    out = windows.extreme_rows(rows, ["model", "bucket"], "facilitation")
    return out.select("model", "bucket", "target", "facilitation", "unrelated_rank")


@query(
    """select model, bucket, target, diff as facilitation, unrelated_rank
       from (select *, min(diff) over (partition by model, bucket) as best from kept) where diff = best""",
    "facilitation",
)
def least_facilitated_rows(v):
    rows = v.kept.withColumn("facilitation", measures.facilitation(kind="difference"))
    out = windows.extreme_rows(rows, ["model", "bucket"], "facilitation", "min")
    return out.select("model", "bucket", "target", "facilitation", "unrelated_rank")


_LONG_NORMS = """
    select target, related, unrelated, relation, 'delta_200ms' as task, delta_200ms as delta from lex
    union all select target, related, unrelated, relation, 'delta_1200ms', delta_1200ms from lex"""


@query(_LONG_NORMS, "delta")
def long_norms(v):
    return reshape.to_long(v.lex, NORMS, "task", "delta")


@query(
    f"""select *, (delta - avg(delta) over (partition by task)) / stddev_samp(delta) over (partition by task) as delta_standardized
        from ({_LONG_NORMS}) where target not in ({_PROBLEM})""",
    "delta delta_standardized",
)
def standardised_norms(v):
    kept = lexicon.exclude_targets(v.lex, v.lex, NORMS, [])
    return windows.zscore(reshape.to_long(kept, NORMS, "task", "delta"), ["task"], "delta")


@query(
    """select model, context_type, target, "constraint" - avg("constraint") over (partition by model, context_type) as centred
       from kept""",
    "centred",
)
def centred_constraint(v):
    rows = v.kept.select("model", "context_type", "target", "constraint")
    return windows.zscore(rows, ["model", "context_type"], "constraint", "centred", scale=False).drop("constraint")


@query(
    """select model, target, diff as facilitation, count(*) over () as n,
              avg(ln(related_probability) - ln(unrelated_probability)) over () as facilitation_surprisal,
              avg(cast(diff >= 0 as double)) over () as primed
       from kept where dataset = 'word'""",
    "facilitation facilitation_surprisal primed",
)
def global_means_on_rows(v):
    rows = v.kept.where(F.col("dataset") == "word").select(
        "model",
        "target",
        measures.facilitation(kind="difference").alias("facilitation"),
        measures.facilitation(kind="nats").alias("_nats"),
    )
    means = {
        "n": F.count(F.lit(1)),
        "facilitation_surprisal": F.avg("_nats"),
        "primed": measures.share(F.col("facilitation") >= 0),
    }
    return windows.attach_global_mean(rows, means).drop("_nats")


@query("""
    select target, isolated_context, unrelated_rank, rank from (
        select target, isolated_context, unrelated_rank,
               cast(rank() over (partition by target order by unrelated_rank desc) as integer) as rank
        from kept) where rank <= 3""")
def ranked_contexts(v):
    rows = v.kept.select("target", "isolated_context", "unrelated_rank")
    return windows.ranked(rows, ["target"], ["-unrelated_rank"], 3, "rank")


# --- sort, top-k, reshape -------------------------------------------------------------------------


@query("select bucket, model, context_type, target, unrelated_rank from kept order by bucket, context_type desc, model")
def ordered_results(v):
    rows = v.kept.select("bucket", "model", "context_type", "target", "unrelated_rank")
    return reshape.order_by(rows, "bucket", "-context_type", "model")


@query("""
    select target, n from (select *, rank() over (order by n desc) as r
                           from (select target, count(*) as n from kept group by target)) where r <= 10""")
def top_targets_with_ties(v):
    counts = v.kept.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    return reshape.top_n_ties(counts, 10, "n")


@query("select relation, n, cast(row_number() over (order by n desc, relation) as integer) as relation_ord from pair_counts")
def relation_levels(v):
    return reshape.with_levels(lexicon.relation_counts(v.lex, v.kept), "relation", "n")


@query("""
    select relation, n, cast(row_number() over (order by n desc, relation nulls first) as integer) as relation_ord
    from (select relation, count(*) as n from lex group by relation)""")
def relation_levels_with_missing(v):
    return reshape.with_levels(v.lex.groupBy("relation").agg(F.count(F.lit(1)).alias("n")), "relation", "n")


@query("""
    select target, related, cast(null as integer) as unrelated_rank from lex
    union all select target, related, unrelated_rank from kept""")
def union_of_tables(v):
    return union_files([v.lex.select("target", "related"), v.kept.select("target", "related", "unrelated_rank")])


@query("select distinct target, related, model from kept")
def distinct_pairs(v):
    return reshape.distinct_on(v.kept, ["target", "related", "model"])


_ITEM_F = "log2(related_probability) - log2(unrelated_probability)"


def _item_facilitation(v):
    return v.items.withColumn("f", measures.facilitation()).drop("related_probability", "unrelated_probability")


@query(
    f"""select model, bucket, target, max({_ITEM_F}) filter (where context_type = 'sentence') as facilitation_sentence,
               max({_ITEM_F}) filter (where context_type = 'word') as facilitation_word
        from items group by model, bucket, target""",
    "facilitation_sentence facilitation_word",
)
def wide_by_context(v):
    return reshape.to_wide(
        _item_facilitation(v), ["model", "bucket", "target"], "context_type", "f", ["sentence", "word"], "facilitation_"
    )


@query(
    """select model, bucket,
              max(facilitation) filter (where context_type = 'sentence') as facilitation_sentence,
              max(facilitation) filter (where context_type = 'word') as facilitation_word,
              max(se_f) filter (where context_type = 'sentence') as se_f_sentence,
              max(se_f) filter (where context_type = 'word') as se_f_word
       from ("""
    + _F_SUMMARY.format(by="model, bucket, context_type, dataset")
    + ") group by model, bucket",
    "facilitation_sentence facilitation_word se_f_sentence se_f_word",
)
def wide_summary(v):
    summary = summaries.facilitation_summary(v.kept)
    return reshape.to_wide_multi(
        summary, ["model", "bucket"], "context_type", ["facilitation", "se_f"], ["sentence", "word"]
    )


EXAMPLE_TARGETS = [f"t{i}" for i in range(60)]
EXAMPLE_PRIMES = ["cold rod", "hot plate", "hot ring", "large bolt", "large rod", "old rod", "red plate", "small widget"]


def _quoted(values: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in values)


@query(
    f"""select model, dataset as scenario, category as bucket, "constraint", target, related, unrelated, relation,
              isolated_context as unprimed_context, replace('[CLS] ' || isolated_context, '[CLS]', '[CLS] ' || related || '.') as related_context,
              replace('[CLS] ' || isolated_context, '[CLS]', '[CLS] ' || unrelated || '.') as unrelated_context, f as facilitation
       from related_results where target in ({_quoted(EXAMPLE_TARGETS)}) and related in ({_quoted(EXAMPLE_PRIMES)})""",
    "constraint facilitation",
)
def example_extract(v):
    context = F.concat(F.lit("[CLS] "), F.col("isolated_context"))
    rows = v.kept.withColumns(
        {
            "related_context": text.prime(context, "related"),
            "unrelated_context": text.prime(context, "unrelated"),
        }
    )
    return reshape.example_extract(rows, v.lex, EXAMPLE_TARGETS, EXAMPLE_PRIMES)


_MISPRIMED = """
    select category as "constraint", context_type as scenario, target, related, unrelated, isolated_context, model, f, rf, relation
    from related_results where category > 4 and f < 0"""


@query(_MISPRIMED, "f rf")
def mispriming_list(v):
    return reshape.mispriming_list(v.kept, v.lex, min_bin=4)


@query("select model, context_type, bucket, target, unrelated_rank, f as facilitation from kept where f < 0", "facilitation")
def negative_facilitation(v):
    return reshape.negative_facilitation(v.kept).select(
        "model", "context_type", "bucket", "target", "unrelated_rank", "facilitation"
    )


@query("select distinct target from kept where category > 4 and dataset = 'word' and unrelated_rank <> 1")
def special_targets(v):
    return reshape.special_targets(v.kept.where(F.col("dataset") == "word"), min_bin=4)


@query(
    """select "constraint", target, related, unrelated, isolated_context, related_probability - isolated_probability as distraction
       from kept where "constraint" > 0.4 and model = 'R' and dataset = 'word'""",
    "constraint distraction",
)
def distraction_list(v):
    c = F.col
    rows = v.kept.where((c("constraint") > 0.4) & (c("model") == "R") & (c("dataset") == "word"))
    return rows.select("constraint", *KEYS3, "isolated_context", measures.distraction().alias("distraction"))


_INSTANCES = """
    select model, "constraint", context_type, target, related, unrelated, relation, n, {f} as facilitation
    from related_results join top using (relation)"""
_INSTANCE_COLUMNS = ["model", "constraint", "context_type", *KEYS3]


# Pairs with a missing prime on both sides: missing keys match missing ones.
_MISSING = """
    select k.*, l.relation, n
    from (select * replace (case when right(target, 1) = '3' then null else related end as related) from kept) k
    join (select * replace (case when right(target, 1) = '3' then null else related end as related) from lex) l
      on k.target is not distinct from l.target and k.related is not distinct from l.related
         and k.unrelated is not distinct from l.unrelated
    join top using (relation)"""


def _without_some_primes(df):
    return df.withColumn("related", F.when(F.substring("target", -1, 1) != "3", F.col("related")))


@query(f"""
    select *, f + se as high, f - se as low, relation || ' (' || n || ')' as label
    from (select bucket, context_type, relation, n, avg(f) as f, 1.96::double * stddev_samp(f) / sqrt(count(f)) as se,
                 avg(cast(f > 0 as double)) as facilitated from ({_MISSING}) r group by bucket, context_type, relation, n)""", _R_DOUBLES)
def relation_summary_missing_keys(v):
    return summaries.relation_summary(_without_some_primes(v.kept), _without_some_primes(v.lex), v.top)


@query(f"""
    select model, dataset, bucket, relation, n, avg(cast(diff > 0 as double)) as primed, avg(diff) as facilitation,
           relation || '(' || n || ')' as label from ({_MISSING}) r group by model, dataset, bucket, relation, n""", "primed facilitation")
def fix_summary_missing_keys(v):
    return summaries.fix_summary_by_relation(_without_some_primes(v.kept), _without_some_primes(v.lex), v.top, ("model", "dataset", "bucket"))


@query(f"""select model, "constraint", context_type, target, related, unrelated, relation, n, f as facilitation from ({_MISSING}) r""", "constraint facilitation")
def instance_table_missing_keys(v):
    return reshape.instance_table(_without_some_primes(v.kept), _without_some_primes(v.lex), v.top, _INSTANCE_COLUMNS)


@query(_INSTANCES.format(f="f"), "constraint facilitation")
def instance_table(v):
    return reshape.instance_table(v.kept, v.lex, v.top, _INSTANCE_COLUMNS)


@query(_INSTANCES.format(f="diff"), "constraint facilitation")
def instance_table_difference(v):
    return reshape.instance_table(v.kept, v.lex, v.top, _INSTANCE_COLUMNS, "difference")


_SHORT = "regexp_replace(cast(round_even({0}, 2) as varchar), '\\.0$', '')"
_NEUTRAL_TEXT = f"""
    select relation, n, context_type, {_SHORT.format("f")} || '$\\pm$' || {_SHORT.format("se")} as f,
           printf('%.3f%%', round_even(facilitated, 4) * 100.0::double) as facilitated
    from ({_R_SUMMARY.format(by="bucket, context_type")}) where bucket = 0"""


@query(f"""
    select {_TITLE.format("relation")} as relation, n,
           max(f) filter (where context_type = 'sentence') as f_sentence,
           max(f) filter (where context_type = 'word') as f_word,
           max(facilitated) filter (where context_type = 'sentence') as facilitated_sentence,
           max(facilitated) filter (where context_type = 'word') as facilitated_word
    from ({_NEUTRAL_TEXT}) group by 1, 2""")
def neutral_report_text(v):
    return neutral_report(summaries.relation_summary(v.kept, v.lex, v.top), ["sentence", "word"])


# --- files ----------------------------------------------------------------------------------------


def _written(v, df, *partition_by: str) -> str:
    """A new CSV folder with the rows, beside the session's checkpoints."""
    folder = f"{shared_folder(v.spark)}/csv-{uuid.uuid4().hex}"
    write_table(df, folder, "csv", partition_by)
    return folder


@query("select * from raw_lex", "delta_200ms delta_1200ms")
def lexicon_csv_round_trip(v):
    return sources.read_lexicon(v.spark, _written(v, v.raw_lex))


@query("select target, related, unrelated, relation, context from stimuli")
def stimuli_csv_round_trip(v):
    return sources.read_stimuli(v.spark, _written(v, v.stimuli.select(*STIMULI.fieldNames())))


@query(
    """select category, "constraint", target, related, unrelated, isolated_context, related as related_context, unrelated as unrelated_context,
              isolated_probability, unrelated_rank as isolated_rank, related_probability, unrelated_rank as related_rank,
              unrelated_probability, unrelated_rank from kept""",
    "constraint isolated_probability related_probability unrelated_probability",
)
def results_csv_round_trip(v):
    """One folder per model, read in one scan of many files."""
    ranks = {f"{c}_rank": F.col("unrelated_rank") for c in ("isolated", "related")}
    contexts = {f"{c}_context": F.col(c) for c in ("related", "unrelated")}
    rows = v.kept.withColumns(ranks | contexts).select(*LEGACY_PRIMING_RESULT.fieldNames(), "model")
    folder = _written(v, rows, "model")
    return sources.read_results(v.spark, f"{folder}/*", glob="*.csv").drop("file")
