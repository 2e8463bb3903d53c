"""Queries on text, stimuli, score vectors and the cloze model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from clozeframe.functions import distribution as dist
from clozeframe.functions import text
from clozeframe.operators import cloze, corpus, lexicon, reshape, scoring, stimuli, windows
from clozeframe.plans.experiment import run_constraint, run_entropy, run_legacy, run_priming, run_priming_cloze
from clozeframe.plans.registry import query
from clozeframe.plans.views import PIECE_COUNT, sql_context_tokens
from clozeframe.session import computed_once
from clozeframe.sources.provenance import parse_provenance

SMOOTHING = 0.5
MODES = ["sentence", "word"]
MODELS = ["base", "large"]

# --- provenance -----------------------------------------------------------------------------------


@query("""
    select c_custkey, nullif(regexp_replace(nullif(regexp_extract(bucket_file, 'results/(.*)\\.csv', 1), ''),
                             '^(.*?)_(sentence|word)_10', '\\1'), '') as model,
           case when bucket_file like '%results/%sentence%' then 'sentence' else 'word' end as context_type,
           nullif(regexp_extract(bucket_file, 'uncased_(.*)_10', 1), '') as dataset
    from result_files""")
def file_provenance_bucket(v):
    return parse_provenance(v.result_files, "bucket", "bucket_file").select(
        "c_custkey", "model", "context_type", "dataset"
    )


@query("""
    select c_custkey, nullif(regexp_extract(fix_file, 'results/(.*)_p', 1), '') as model,
           case when nullif(regexp_extract(fix_file, 'uncased_(.*)\\.csv', 1), '') = 'polysemy_free'
                then 'After Fix' else 'Before Fix' end as dataset,
           case when nullif(regexp_extract(fix_file, 'uncased_(.*)\\.csv', 1), '') = 'polysemy_free'
                then 1 else 0 end as dataset_ord
    from result_files""")
def file_provenance_fix(v):
    return parse_provenance(v.result_files, "fix", "fix_file").select("c_custkey", "model", "dataset", "dataset_ord")


@query("""
    select c_custkey, string_split(name, '_')[1] as model, string_split(name, '_')[2] as scenario
    from (select c_custkey, nullif(regexp_extract(priming_file, 'results/priming_(.*)\\.csv', 1), '') as name
          from result_files)""")
def file_provenance_priming(v):
    return parse_provenance(v.result_files, "priming", "priming_file").select("c_custkey", "model", "scenario")


# --- corpus ---------------------------------------------------------------------------------------


@query("select doc_id, line, sentence, cast(len(tokens) as integer) as n_tokens from sents")
def sentence_tokens(v):
    return v.sents.select("doc_id", "line", "sentence", F.size("tokens").alias("n_tokens"))


@query("select token, n from vocab")
def vocabulary_counts(v):
    return v.vocab


@query("select doc_id, line, target from carriers")
def carrier_sentences(v):
    return corpus.select_carriers(v.sents, v.word_lex).select("doc_id", "line", "target")


@query("select distinct doc_id, line, target from carriers")
def carrier_sentences_distinct(v):
    return corpus.select_carriers(v.sents, v.word_lex, dedupe=True).select("doc_id", "line", "target")


@query("select target as word, count(*) as n from carriers group by target")
def carrier_counts(v):
    return corpus.carrier_counts(corpus.select_carriers(v.sents.select("tokens"), v.word_lex))


@query(
    """select avg(n) as mean_sentences, min(n) as min_sentences
       from (select target, count(*) as n from carriers group by target)""",
    "mean_sentences",
)
def carrier_stats(v):
    return corpus.carrier_stats(corpus.select_carriers(v.sents.select("tokens"), v.word_lex))


def _sample(v):
    sents = v.sents.select("doc_id", "line", "tokens", text.join_tokens("tokens").alias("sentence"))
    return corpus.sample_carriers(sents, v.word_lex, ["doc_id", "line"])


@query("select target, least(10, count(*)) as n from carriers group by target")
def carrier_sample_sizes(v):
    return _sample(v).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
    select target, array_to_string(tokens, ' ') as sentence
    from (select *, row_number() over (partition by target order by md5(concat_ws('|', '{corpus.SEED}', target, doc_id, line)), doc_id, line) as r
          from carriers) join sents using (doc_id, line) where r <= {corpus.SAMPLE_SIZE}""")
def carrier_sample(v):
    return _sample(v).select("target", "sentence")


@query(f"""
    with counted as materialized (select token, n from vocab),
    repeated as (select token as target, cast(unnest(range(1, case when n >= 20 then 3 else 2 end)) as integer) as sense from counted)
    select target, sense from repeated where target in (select token from counted where n >= {PIECE_COUNT})""")
def single_piece_targets(v):
    return lexicon.single_piece(v.word_lex, v.pieces)


@query("select doc_id, line, array_to_string(tokens, ' ') as text from sents")
def joined_tokens(v):
    return v.sents.select("doc_id", "line", text.join_tokens("tokens").alias("text"))


# --- stimuli --------------------------------------------------------------------------------------

# The checking engine has no look-around.  It marks every run of word characters, slashes and hyphens,
# unmarks a run that ends the text, and replaces marked runs that are the word.
_RUNS = r"regexp_replace(sentence, '([\p{L}\p{N}\p{M}_/-]+)', chr(1) || '\1' || chr(2), 'g')"
_INNER_RUNS = f"regexp_replace({_RUNS}, chr(1) || '([^' || chr(1) || chr(2) || ']*)' || chr(2) || '$', '\\1')"


@query(
    f"""select doc_id, line, target, '[CLS] ' || replace(replace(replace(runs, chr(1) || target || chr(2), '[MASK]'),
               chr(1), ''), chr(2), '') || ' [SEP]' as context
        from (select doc_id, line, {_INNER_RUNS} as runs,
                     list_filter(tokens, lambda t: regexp_full_match(t, '[\\p{{L}}\\p{{N}}]+'))[1] as target from sents)"""
)
def masked_sentences(v):
    """The first plain word of every sentence masked; a sentence without one has no context."""
    word = F.get(F.filter("tokens", lambda t: t.rlike(r"^[\p{L}\p{N}]+$")), F.lit(0))
    rows = v.sents.select("doc_id", "line", "sentence", word.alias("target"))
    return rows.select("doc_id", "line", "target", text.mask_word("sentence", "target").alias("context"))


@query("""
    select doc_id, line, replace(context, '[CLS]', '[CLS] ' || related || '.') as word_context,
           replace(context, '[CLS]', '[CLS] the next word is ' || related || '.') as sentence_context
    from stimuli""")
def primed_contexts(v):
    return v.stimuli.select(
        "doc_id",
        "line",
        text.prime("context", "related", "word").alias("word_context"),
        text.prime("context", "related", "sentence").alias("sentence_context"),
    )


_CONDITIONS_SQL = (
    """
    select *, cast(len("""
    + sql_context_tokens("string_split(cloze, '[MASK]')[1]")
    + """) as integer) as mask_index
    from (select doc_id, line, target, related, 'isolated' as condition, context as cloze from stimuli
          union all select doc_id, line, target, related, 'related', replace(context, '[CLS]', '[CLS] ' || related || '.') from stimuli
          union all select doc_id, line, target, related, 'unrelated', replace(context, '[CLS]', '[CLS] ' || unrelated || '.') from stimuli)"""
)


@query(f"select doc_id, line, condition, cloze, mask_index from ({_CONDITIONS_SQL})")
def stimulus_contexts(v):
    return stimuli.conditions_long(stimuli.build_stimuli(v.stimuli), ["doc_id", "line"])


@query(
    "select doc_id, line, cast(len("
    + sql_context_tokens("string_split(context, '[MASK]')[1]")
    + ") as integer) as mask_index from stimuli"
)
def mask_positions(v):
    return v.stimuli.select("doc_id", "line", text.mask_index("context").alias("mask_index"))


@query('select distinct isolated_context, "constraint", category from kept', "constraint")
def unique_contexts(v):
    return reshape.unique_contexts(v.kept)


@query("""
    select target, related, relation, model, mode,
           replace('[CLS] a [MASK] .', '[CLS]',
                   case mode when 'sentence' then '[CLS] the next word is ' || related || '.'
                             else '[CLS] ' || related || '.' end) as related_context
    from lex cross join (values ('base'), ('large')) as m(model)
             cross join (values ('sentence'), ('word')) as s(mode)""")
def run_matrix(v):
    runs = stimuli.run_matrix(v.lex, model=MODELS, mode=MODES)
    built = stimuli.build_stimuli(runs.withColumn("context", F.lit("[CLS] a [MASK] .")), F.col("mode"))
    return built.select("target", "related", "relation", "model", "mode", "related_context")


# --- score vectors --------------------------------------------------------------------------------


@query("select vec_id, pos, p from probs_long", "p")
def softmax(v):
    return v.vectors.select("vec_id", F.posexplode(dist.softmax("embedding")).alias("pos", "p"))


_VECTOR_METRICS = """
    select vec_id, max(p) filter (where pos = label) as probability,
           cast(count(*) filter (where p > tp) + 1 as integer) as rank,
           cast(arg_max(pos, (p, -pos)) as integer) as argmax, max(p) as maxprob, sum(-p * log2(p)) as entropy
    from (select *, max(p) filter (where pos = label) over (partition by vec_id) as tp from {source})
    group by vec_id"""


@query(_VECTOR_METRICS.format(source="probs_long"), "probability maxprob entropy")
def vector_metrics(v):
    p = v.vectors.withColumn("p", dist.softmax("embedding"))
    return p.select(
        "vec_id",
        dist.prob_at("p", "label").alias("probability"),
        dist.rank_at("p", "label").alias("rank"),
        dist.argmax_index("p").alias("argmax"),
        dist.constraint_score("p").alias("maxprob"),
        dist.entropy_bits("p").alias("entropy"),
    )


@query(
    _VECTOR_METRICS.format(
        source="(select vec_id, label, pos, exp(p) / sum(exp(p)) over (partition by vec_id) as p from probs_long)"
    ),
    "probability maxprob entropy",
)
def vector_metrics_renormalised(v):
    p = v.vectors.withColumn("p", dist.softmax("embedding", renormalised=True))
    return p.select(
        "vec_id",
        dist.prob_at("p", "label").alias("probability"),
        dist.rank_at("p", "label").alias("rank"),
        dist.argmax_index("p").alias("argmax"),
        dist.maxprob("p").alias("maxprob"),
        dist.entropy_bits("p").alias("entropy"),
    )


@query("""
    select vec_id, concat('w', cast(arg_max(pos, (p, -pos)) as varchar)) as argmax from probs_long group by vec_id""")
def vector_top_word(v):
    words = F.array(*[F.lit(f"w{i}") for i in range(64)])
    return v.vectors.select("vec_id", dist.argmax_token(dist.softmax("embedding"), words).alias("argmax"))


@query(
    """select vec_id, max(p) filter (where pos = prime) as rp_probability,
              cast(count(*) filter (where p > tp) + 1 as integer) as rp_rank
       from (select *, max(p) filter (where pos = prime) over (partition by vec_id) as tp from probs_long)
       group by vec_id""",
    "rp_probability",
)
def vector_prime_metrics(v):
    p = v.vectors.withColumn("p", dist.softmax("embedding"))
    return p.select(
        "vec_id", dist.prob_at("p", "prime").alias("rp_probability"), dist.rank_at("p", "prime").alias("rp_rank")
    )


@query(_VECTOR_METRICS.format(source="probs_long"), "probability maxprob entropy")
def sparse_score_metrics(v):
    long = v.vectors.select("vec_id", "label", F.posexplode("embedding").alias("pos", "score"))
    return scoring.dist_metrics_long(long, ["vec_id"], "pos", "score", "label")


# --- batch scoring --------------------------------------------------------------------------------


class LengthScorer:
    """A stand-in model whose scores follow from text length and mask position alone."""

    size = 16

    def __call__(self, contexts, mask_positions):
        seed = np.array([len(c) for c in contexts]) * 31 + np.asarray(mask_positions) * 7
        j = np.arange(self.size)
        return ((seed[:, None] + j * j * 13) % 97) / 10.0

    def index_of(self, words):
        return np.array([len(w) % self.size for w in words])

    def word_at(self, indices):
        return [f"w{i}" for i in indices]


_LENGTH_SCORES = f"""
    select *, max(p) filter (where j = length(target) % 16) over w as tp,
           max(p) filter (where j = length(related) % 16) over w as rp
    from (select *, exp(s) / sum(exp(s)) over (partition by doc_id, line, condition) as p
          from (select *, ((length(cloze) * 31 + mask_index * 7 + j * j * 13) % 97) / 10.0::double as s
                from ({_CONDITIONS_SQL}) cross join (select unnest(range(16)) as j)))
    window w as (partition by doc_id, line, condition)"""


@query(
    f"""select doc_id, line, condition, max(tp) as target_probability,
               cast(count(*) filter (where p > tp) + 1 as integer) as target_rank, max(rp) as related_probability,
               cast(count(*) filter (where p > rp) + 1 as integer) as related_rank,
               concat('w', cast(arg_max(j, (p, -j)) as varchar)) as argmax, max(p) as maxprob,
               sum(-p * log2(p)) as entropy
        from ({_LENGTH_SCORES}) group by doc_id, line, condition""",
    "target_probability related_probability maxprob entropy",
)
def batch_scoring(v):
    built = stimuli.build_stimuli(v.stimuli)
    long = stimuli.conditions_long(built, ["doc_id", "line", "target", "related"])
    return scoring.prime_metrics(long, LengthScorer).drop("cloze", "mask_index", "target", "related")


_CONTEXT_SCORES = f"""
    select *, exp(s) / sum(exp(s)) over (partition by cloze) as p
    from (select cloze, j, ((length(cloze) * 31 + cast(len({sql_context_tokens("string_split(cloze, '[MASK]')[1]")}) as integer) * 7
                             + j * j * 13) % 97) / 10.0::double as s
          from asked cross join (select unnest(range(16)) as j))"""


@query(
    f"""with asked as (select distinct context as cloze from stimuli),
             entropies as (select cloze, sum(-p * log2(p)) as entropy from ({_CONTEXT_SCORES}) group by cloze)
        select distinct context, length(target) / 10.0::double as "constraint", entropy
        from stimuli join entropies on context = cloze""",
    "constraint entropy",
)
def entropy_results_batch(v):
    contexts = v.stimuli.select("context", (F.length("target") / 10.0).alias("constraint"))
    return run_entropy(contexts, LengthScorer)


@query(
    f"""with asked as (select distinct context as cloze from stimuli),
             answers as (select cloze, max(p) as "constraint", sum(-p * log2(p)) as entropy from ({_CONTEXT_SCORES}) group by cloze)
        select target, related, unrelated, relation, context, "constraint", entropy from stimuli join answers on context = cloze""",
    "constraint entropy",
)
def constraint_results_batch(v):
    return run_constraint(v.stimuli, LengthScorer)


def _priming_batch_sql() -> str:
    before = text.PRIME_TEMPLATES["sentence"].split("{}")[0]
    cells = [
        f"max({source}) filter (where condition = '{c}') as {c}_{name}"
        for c in ("isolated", "related", "unrelated")
        for name, source in (("probability", "tp"), ("rank", "target_rank"), ("argmax", "argmax"), ("maxprob", "maxprob"))
    ]
    cells += [
        f"max({source}) filter (where condition = '{c}') as rp_{c}_{name}"
        for c in ("isolated", "related")
        for name, source in (("probability", "rp"), ("rank", "related_rank"))
    ]
    return f"""with placed as (
            select target, related, unrelated, relation, context, replace(context, '[CLS]', '{before}' || related || '.') as related_context,
                   replace(context, '[CLS]', '{before}' || unrelated || '.') as unrelated_context, row_number() over () as id from stimuli),
        long as (select id, target, related, unnest(['isolated', 'related', 'unrelated']) as condition,
                        unnest([context, related_context, unrelated_context]) as cloze from placed),
        asked as (select distinct cloze from long),
        scores as materialized ({_CONTEXT_SCORES}),
        own as (select id, condition, j, p, max(p) filter (where j = length(target) % 16) over w as tp,
                       max(p) filter (where j = length(related) % 16) over w as rp
                from long join scores using (cloze) window w as (partition by id, condition)),
        answers as (select id, condition, max(tp) as tp, cast(count(*) filter (where p > tp) + 1 as integer) as target_rank,
                           max(rp) as rp, cast(count(*) filter (where p > rp) + 1 as integer) as related_rank,
                           concat('w', cast(arg_max(j, (p, -j)) as varchar)) as argmax, max(p) as maxprob
                    from own group by id, condition),
        wide as (select id, {", ".join(cells)} from answers group by id)
        select placed.* exclude (id), wide.* exclude (id) from placed join wide using (id)"""


@query(
    _priming_batch_sql(),
    "isolated_probability isolated_maxprob related_probability related_maxprob unrelated_probability "
    "unrelated_maxprob rp_isolated_probability rp_related_probability",
)
def priming_results_batch(v):
    return run_priming(v.stimuli, LengthScorer, "sentence")


_LEGACY_STIMULI_SQL = """
    select cast(length(related) as integer) as category, length(target) / 10.0::double as "constraint", target, related, unrelated,
           context as isolated_context, replace(context, '[CLS]', '[CLS] ' || related || '.') as related_context,
           replace(context, '[CLS]', '[CLS] ' || unrelated || '.') as unrelated_context from stimuli"""


def _legacy_sql() -> str:
    conditions = ("isolated", "related", "unrelated")
    cells = ", ".join(
        f"max({m}) filter (where condition = '{c}') as {c}_{m}" for c in conditions for m in ("probability", "rank")
    )
    return f"""with legacy as (select *, row_number() over () as id from ({_LEGACY_STIMULI_SQL})),
        placed as (select id, target, unnest(['isolated', 'related', 'unrelated']) as condition,
                          unnest([isolated_context, related_context, unrelated_context]) as cloze from legacy),
        asked as (select distinct cloze from placed),
        scores as materialized ({_CONTEXT_SCORES}),
        own as (select id, condition, p, max(p) filter (where j = length(target) % 16) over (partition by id, condition) as tp
                from placed join scores using (cloze)),
        answers as (select id, condition, max(tp) as probability, cast(count(*) filter (where p > tp) + 1 as integer) as rank
                    from own group by id, condition),
        wide as (select id, {cells} from answers group by id)
        select legacy.* exclude (id), wide.* exclude (id) from legacy join wide using (id)"""


@query(_legacy_sql(), "constraint isolated_probability related_probability unrelated_probability")
def legacy_results_batch(v):
    rows = v.stimuli.select(
        F.length("related").alias("category"),
        (F.length("target") / 10.0).alias("constraint"),
        "target",
        "related",
        "unrelated",
        F.col("context").alias("isolated_context"),
        text.prime("context", "related").alias("related_context"),
        text.prime("context", "unrelated").alias("unrelated_context"),
    )
    return run_legacy(rows, LengthScorer)


# --- cloze model ----------------------------------------------------------------------------------

_CLOZE_SQL = f"""
    with spots as (
        select token, coalesce(lag(token) over w, '[CLS]') as prev, coalesce(lead(token) over w, '[SEP]') as next
        from (select doc_id, line, unnest(range(len(tokens))) as i, unnest(tokens) as token from sents)
        window w as (partition by doc_id, line order by i)),
    c3 as (select prev, next, token, count(*) as n from spots group by all),
    c2 as (select prev, token, sum(n) as n from c3 group by all),
    c1 as (select token, sum(n) as n from c2 group by all),
    w3 as (select *, rank() over (partition by prev, next order by n desc) as r from c3),
    w2 as (select *, rank() over (partition by prev order by n desc) as r from c2),
    w1 as (select *, rank() over (order by n desc) as r from c1),
    x3 as (select prev, next, sum(n) as total, count(*) as types, max(n) as max_n,
                  arg_min(token, (-n, token)) as top,
                  sum((n + {SMOOTHING}::double) * log2(n + {SMOOTHING}::double)) as logs from c3 group by all),
    x2 as (select prev, sum(n) as total, count(*) as types, max(n) as max_n, arg_min(token, (-n, token)) as top,
                  sum((n + {SMOOTHING}::double) * log2(n + {SMOOTHING}::double)) as logs from c2 group by all),
    x1 as (select sum(n) as total, count(*) as types, max(n) as max_n, arg_min(token, (-n, token)) as top,
                  sum((n + {SMOOTHING}::double) * log2(n + {SMOOTHING}::double)) as logs from c1),
    asked as (
        select *, coalesce(toks[mask_index], '[CLS]') as prev, coalesce(toks[mask_index + 2], '[SEP]') as next
        from (select *, {sql_context_tokens("cloze")} as toks from ({_CONDITIONS_SQL}))),
    leveled as (
        select asked.*, case when x3.total is not null then 3 when x2.total is not null then 2 else 1 end as level,
               coalesce(x3.total, x2.total, x1.total) as total, coalesce(x3.types, x2.types, x1.types) as types,
               coalesce(x3.max_n, x2.max_n, x1.max_n) as max_n, coalesce(x3.top, x2.top, x1.top) as argmax,
               coalesce(x3.logs, x2.logs, x1.logs) as logs
        from asked left join x3 using (prev, next) left join x2 using (prev) cross join x1),
    answered as (
        select l.*, total + {SMOOTHING}::double * (types + 1) as mass,
               case level when 3 then w3.n when 2 then w2.n else w1.n end as n,
               case level when 3 then w3.r when 2 then w2.r else w1.r end as r,
               case level when 3 then v3.n when 2 then v2.n else v1.n end as rn,
               case level when 3 then v3.r when 2 then v2.r else v1.r end as rr
        from leveled l
        left join w3 on w3.prev = l.prev and w3.next = l.next and w3.token = l.target
        left join w2 on w2.prev = l.prev and w2.token = l.target left join w1 on w1.token = l.target
        left join w3 v3 on v3.prev = l.prev and v3.next = l.next and v3.token = l.related
        left join w2 v2 on v2.prev = l.prev and v2.token = l.related left join w1 v1 on v1.token = l.related)
    select doc_id, line, condition, level, (coalesce(n, 0) + {SMOOTHING}::double) / mass as target_probability,
           cast(coalesce(r, types + 1) as integer) as target_rank,
           (coalesce(rn, 0) + {SMOOTHING}::double) / mass as related_probability,
           cast(coalesce(rr, types + 1) as integer) as related_rank, argmax,
           (max_n + {SMOOTHING}::double) / mass as maxprob,
           log2(mass) - (logs + {SMOOTHING}::double * log2({SMOOTHING}::double)) / mass as entropy
    from answered"""


def _cloze_model(v):
    return cloze.fit_cloze(v.sents.select("tokens"), SMOOTHING)


@query(
    _CLOZE_SQL.strip(),
    "target_probability related_probability maxprob entropy",
)
def cloze_scores(v):
    built = stimuli.build_stimuli(v.stimuli)
    long = stimuli.conditions_long(built, ["doc_id", "line", "target", "related"])
    # Without the texts the rows are small: read from the text once, for what is asked and for the answers.
    asked = computed_once(cloze.mask_neighbours(long, mask_index=None).drop("cloze", "mask_index"))
    scored = cloze.score_cloze(asked, _cloze_model(v), ("target", "related"))
    return scored.drop("target", "related", "prev", "next")


def _assembled_sql() -> str:
    columns = []
    for c in ("isolated", "related", "unrelated"):
        columns += [
            f"max({source}) filter (where condition = '{c}') as {c}_{name}"
            for name, source in (
                ("probability", "target_probability"),
                ("rank", "target_rank"),
                ("argmax", "argmax"),
                ("maxprob", "maxprob"),
            )
        ]
    for c in ("isolated", "related"):
        columns += [f"max(related_{n}) filter (where condition = '{c}') as rp_{c}_{n}" for n in ("probability", "rank")]
    body = _CLOZE_SQL.strip()
    cut = body.rindex("select doc_id")
    return (
        body[:cut].rstrip()
        + ",\n scored_long as ("
        + body[cut:]
        + "),\n wide as (select doc_id, line, "
        + ", ".join(columns)
        + """ from scored_long group by doc_id, line)
        select target, related, unrelated, relation, context,
               replace(context, '[CLS]', '[CLS] ' || related || '.') as related_context,
               replace(context, '[CLS]', '[CLS] ' || unrelated || '.') as unrelated_context,
               wide.* exclude (doc_id, line)
        from stimuli join wide using (doc_id, line)"""
    )


@query(
    _assembled_sql(),
    "isolated_probability isolated_maxprob related_probability related_maxprob unrelated_probability "
    "unrelated_maxprob rp_isolated_probability rp_related_probability",
)
def priming_results_cloze(v):
    return run_priming_cloze(v.stimuli, _cloze_model(v))


# --- positions ------------------------------------------------------------------------------------


@query(
    """select item, ordinal, f, size,
              cast(row_number() over (partition by item order by ordinal) % 11 as integer) as bucket
       from eleven""",
    "f",
)
def bucket_assignment(v):
    return windows.assign_bucket(v.eleven, ["item"], "ordinal")


@query(
    """select item, ordinal, f, size, corr(size, 11 - rn) over (partition by item) as corr
       from (select *, row_number() over (partition by item order by ordinal) as rn from eleven)""",
    "f corr",
)
def bucket_trend_correlation(v):
    return windows.bucket_trend_corr(v.eleven, ["item"], "ordinal", "size")
