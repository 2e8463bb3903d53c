"""The given tables in the shapes of the experiments, once for Spark and once as SQL.

``Views`` holds the Spark frames; ``SQL_VIEWS`` holds the same definitions for the checking engine,
and ``compose`` puts the ones a statement names in front of it.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clozeframe.functions import text
from clozeframe.operators.corpus import tokenize, word_counts
from clozeframe.operators.joins import exclude, join_lexicon, small_table
from clozeframe.operators.lexicon import clean_lexicon, relation_counts, same_targets
from clozeframe.operators.reshape import top_n_ties
from clozeframe.sources.readers import sentences_from_text, spread

TOP_RELATIONS = 10
# Occurrences that make a word an entry of the stand-in model vocabulary.
PIECE_COUNT = 50
NORMS = ["delta_200ms", "delta_1200ms"]


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def scored(self) -> DataFrame:
        """Priming results: one row per line item, bucket 0 is the neutral one.

        The constraint divisor is a prime, so that means do not end on a half of the last compared digit.
        """
        c, lit, cat = F.col, F.lit, F.concat
        part = self.table("part").select("p_partkey", "p_name", "p_brand", "p_size")
        rows = self.table("lineitem").join(part, c("l_partkey") == c("p_partkey"))
        scenario = F.when(c("l_linestatus") == "O", "sentence").otherwise("word")
        guess = cat(lit("w"), (c("l_orderkey") % 2).cast("string"))
        target = cat(lit("t"), c("l_partkey").cast("string"))
        return rows.select(
            c("l_returnflag").alias("model"),
            scenario.alias("context_type"),
            scenario.alias("dataset"),
            (c("l_linenumber") - 1).alias("bucket"),
            (c("l_linenumber") - 1).alias("category"),
            target.alias("target"),
            c("p_name").alias("related"),
            F.when(c("p_size") % 10 == 0, c("p_name")).otherwise(c("p_brand")).alias("unrelated"),
            cat(lit("ctx "), c("l_suppkey").cast("string")).alias("isolated_context"),
            F.when(c("l_linenumber") == 1, 0.0)
            .otherwise(F.least(lit(1.0), c("l_extendedprice") / 149993.0))
            .alias("constraint"),
            ((c("l_tax") * 100 + 1) / 10.0).alias("isolated_probability"),
            (c("l_quantity") / 51.0).alias("related_probability"),
            ((c("l_discount") * 100 + 1) / 12.0).alias("unrelated_probability"),
            (c("l_suppkey") % 50 + 1).cast("int").alias("unrelated_rank"),
            F.when(c("l_orderkey") % 3 == 0, target).otherwise(guess).alias("isolated_argmax"),
            F.when(c("l_suppkey") % 4 == 0, c("p_name")).otherwise(guess).alias("related_argmax"),
            F.when(c("l_suppkey") % 5 == 0, target).otherwise(guess).alias("unrelated_argmax"),
        )

    @cached_property
    def raw_lex(self) -> DataFrame:
        """Lexicon as it comes: mixed case, spelling variants, missing relations and norms."""
        c = F.col
        relation = (
            F.when(c("p_type") == "PROMO", "Uncl")
            .when(c("p_type") == "SMALL", "Antonyms")
            .when(c("p_type") == "LARGE", "FPA")
            .when(c("p_type") == "MEDIUM", "BPA")
            .when(c("p_type") == "ECONOMY", F.lit(None).cast("string"))
            .otherwise(F.concat(c("p_type"), F.lit(" "), (c("p_size") % 9).cast("string")))
        )
        return self.table("part").select(
            F.concat(F.lit("T"), c("p_partkey").cast("string")).alias("target"),
            c("p_name").alias("prime"),
            F.when(c("p_size") % 10 == 0, c("p_name")).otherwise(c("p_brand")).alias("unrelated"),
            relation.alias("relation"),
            c("p_brand").alias("context_word"),
            F.when(c("p_size") != 7, c("p_retailprice") - 950.0).alias("delta_200ms"),
            c("p_size").cast("double").alias("delta_1200ms"),
        )

    @cached_property
    def lex(self) -> DataFrame:
        return clean_lexicon(self.raw_lex)

    @cached_property
    def kept(self) -> DataFrame:
        """Results without the targets whose two primes are the same word."""
        return exclude(self.scored, same_targets(self.lex))

    @cached_property
    def top(self) -> DataFrame:
        """The most frequent relations among the kept results, ties included."""
        return small_table(top_n_ties(relation_counts(self.lex, self.kept), TOP_RELATIONS, "n"))

    @cached_property
    def related_results(self) -> DataFrame:
        return join_lexicon(self.kept, self.lex)

    @cached_property
    def items(self) -> DataFrame:
        """Results averaged to one row per model, scenario, bucket and target."""
        keys = ["model", "context_type", "bucket", "target"]
        return self.kept.groupBy(*keys).agg(
            F.avg("related_probability").alias("related_probability"),
            F.avg("unrelated_probability").alias("unrelated_probability"),
        )

    @cached_property
    def stimulus_scores(self) -> DataFrame:
        """Constraint and entropy per stimulus and model."""
        return self.scored.join(self.lex.select("target", "related", "unrelated", "relation"), ["target", "related", "unrelated"]).select(
            "model",
            "target",
            "related",
            "unrelated",
            "relation",
            F.col("isolated_context").alias("context"),
            "constraint",
            (F.lit(5.0) - F.col("isolated_probability") * 4.0).alias("entropy"),
        )

    @cached_property
    def context_entropy(self) -> DataFrame:
        """One entropy per isolated context."""
        return self.table("supplier").select(
            F.concat(F.lit("ctx "), F.col("s_suppkey").cast("string")).alias("isolated_context"),
            (F.col("s_acctbal") / 2000.0).alias("entropy"),
        )

    @cached_property
    def eleven(self) -> DataFrame:
        """Items with eleven ordered contexts, made of every part.

        A row becomes eleven that are sorted by item, and a short file of parts is one partition, so parts are spread first.
        """
        c = F.col
        cores, parts = self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        part = spread(self.table("part").select("p_partkey", "p_retailprice", "p_size"), "p_partkey", tasks=max(cores, parts))
        part = part.select(
            c("p_partkey").alias("item"), "p_retailprice", "p_size", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("ordinal")
        )
        varied = (c("item") * 7 + c("ordinal") * c("ordinal") * 5) % 23
        return part.select(
            "item", "ordinal", (c("p_retailprice") / 1000.0 + varied).alias("f"), (c("p_size") + varied).alias("size")
        )

    @cached_property
    def result_files(self) -> DataFrame:
        """File names of experiment outputs, one per customer."""
        c, lit = F.col, F.lit
        mode = F.when(c("c_nationkey") % 2 == 0, "word").otherwise("sentence")
        name = F.lower("c_mktsegment")
        fix = F.when(c("c_nationkey") % 3 == 0, "polysemy_free").otherwise("prior_fix")
        return self.table("customer").select(
            "c_custkey",
            F.when(c("c_nationkey") == 7, F.concat(lit("other/"), name))
            .otherwise(F.concat(lit("data/results/"), name, lit("-uncased_"), mode, lit("_10.csv")))
            .alias("bucket_file"),
            F.concat(lit("data/results/"), name, lit("-uncased_"), fix, lit(".csv")).alias("fix_file"),
            F.concat(lit("data/priming_results/priming_"), name, lit("_"), mode, lit(".csv")).alias("priming_file"),
        )

    @cached_property
    def sents(self) -> DataFrame:
        documents = spread(self.table("documents").select("doc_id", "text"), "doc_id")
        lines = sentences_from_text(documents, "text", "doc_id")
        return tokenize(lines)

    @cached_property
    def vocab(self) -> DataFrame:
        return word_counts(self.sents)

    @cached_property
    def word_lex(self) -> DataFrame:
        """Lexicon over all corpus words, frequent ones twice."""
        words = self.vocab
        repeats = F.when(F.col("n") >= 20, 2).otherwise(1)
        return words.select(
            F.col("token").alias("target"), F.explode(F.sequence(F.lit(1), repeats)).alias("sense")
        )

    @cached_property
    def pieces(self) -> DataFrame:
        """Words that are one entry of the stand-in model vocabulary."""
        return self.vocab.where(F.col("n") >= PIECE_COUNT)

    @cached_property
    def stimuli(self) -> DataFrame:
        """Cloze stimuli: the middle token of every sentence masked, its neighbours as primes.

        At the ends the first or last token stands in for a missing neighbour.  Only a sentence of white
        space has no token to mask.
        """
        t, n = F.col("tokens"), F.size("tokens")
        middle = F.floor(n / 2).cast("int")
        masked = F.concat(F.slice(t, F.lit(1), middle), F.array(F.lit(text.MASK)), F.slice(t, middle + 2, n - middle - 1))
        return self.sents.where(F.col("sentence").rlike(text.TOKEN_PATTERN)).select(
            "doc_id",
            "line",
            F.get(t, middle).alias("target"),
            F.coalesce(F.get(t, middle + 1), F.get(t, F.lit(0))).alias("related"),
            F.coalesce(F.get(t, middle - 1), F.get(t, n - 1)).alias("unrelated"),
            F.lit("next").alias("relation"),
            F.concat(F.lit("[CLS] "), F.array_join(masked, " "), F.lit(" [SEP]")).alias("context"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        """Score vectors with target and prime index."""
        return self.table("embeddings").select(
            "vec_id", "embedding", F.col("label"), ((F.col("label") + 1) % 10).alias("prime")
        )


# Token patterns of the library in the checking engine's dialect.
_TOKEN = r"[\p{L}\p{N}'']+|[^\s\p{L}\p{N}'']"
_CONTEXT_TOKEN = r"\[[A-Z]+\]|" + _TOKEN


def sql_tokens(expr: str) -> str:
    return f"regexp_extract_all({expr}, '{_TOKEN}')"


def sql_context_tokens(expr: str) -> str:
    return f"regexp_extract_all({expr}, '{_CONTEXT_TOKEN}')"


SQL_VIEWS: dict[str, str] = {
    "scored": """
        select l_returnflag as model,
               case l_linestatus when 'O' then 'sentence' else 'word' end as context_type,
               case l_linestatus when 'O' then 'sentence' else 'word' end as dataset,
               l_linenumber - 1 as bucket, l_linenumber - 1 as category,
               concat('t', l_partkey) as target, p_name as related,
               case when p_size % 10 = 0 then p_name else p_brand end as unrelated,
               concat('ctx ', l_suppkey) as isolated_context,
               case when l_linenumber = 1 then 0.0::double
                    else least(1.0::double, l_extendedprice / 149993.0::double) end as "constraint",
               (l_tax * 100 + 1) / 10.0::double as isolated_probability,
               l_quantity / 51.0::double as related_probability,
               (l_discount * 100 + 1) / 12.0::double as unrelated_probability,
               cast(l_suppkey % 50 + 1 as integer) as unrelated_rank,
               case when l_orderkey % 3 = 0 then concat('t', l_partkey) else concat('w', l_orderkey % 2) end as isolated_argmax,
               case when l_suppkey % 4 = 0 then p_name else concat('w', l_orderkey % 2) end as related_argmax,
               case when l_suppkey % 5 = 0 then concat('t', l_partkey) else concat('w', l_orderkey % 2) end as unrelated_argmax
        from lineitem join part on l_partkey = p_partkey""",
    "raw_lex": """
        select concat('T', p_partkey) as target, p_name as prime,
               case when p_size % 10 = 0 then p_name else p_brand end as unrelated,
               case p_type when 'PROMO' then 'Uncl' when 'SMALL' then 'Antonyms' when 'LARGE' then 'FPA'
                           when 'MEDIUM' then 'BPA' when 'ECONOMY' then null
                           else concat(p_type, ' ', p_size % 9) end as relation,
               p_brand as context_word,
               case when p_size <> 7 then p_retailprice - 950.0::double end as delta_200ms,
               cast(p_size as double) as delta_1200ms
        from part""",
    "lex": """
        select lower(target) as target, prime as related, unrelated,
               case when lower(relation) like '%uncl%' then 'unclassified'
                    when lower(relation) like '%anton%' then 'antonym'
                    when lower(relation) = 'fpa' then 'forward phrasal associate'
                    when lower(relation) = 'bpa' then 'backward phrasal associate'
                    else lower(relation) end as relation,
               delta_200ms, delta_1200ms
        from (select distinct target, prime, unrelated, relation, delta_200ms, delta_1200ms from raw_lex)""",
    "same": "select distinct target from lex where related = unrelated",
    "kept": """
        select s.*, log2(related_probability) - log2(unrelated_probability) as f,
               log2(related_probability) - log2(isolated_probability) as rf,
               related_probability - unrelated_probability as diff
        from scored s where not exists (select 1 from same where same.target = s.target)""",
    "pair_counts": """
        select relation, count(*) as n
        from (select distinct kept.target, kept.related, kept.unrelated, lex.relation
              from kept join lex using (target, related, unrelated))
        where relation is not null and relation <> 'unclassified' group by relation""",
    "top": f"""
        select relation, n from (select *, rank() over (order by n desc) as r from pair_counts)
        where r <= {TOP_RELATIONS}""",
    "related_results": """
        select kept.*, lex.relation from kept join lex using (target, related, unrelated)""",
    "items": """
        select model, context_type, bucket, target, avg(related_probability) as related_probability,
               avg(unrelated_probability) as unrelated_probability
        from kept group by all""",
    "stimulus_scores": """
        select model, scored.target, scored.related, scored.unrelated, relation,
               isolated_context as context, "constraint", 5.0::double - isolated_probability * 4.0::double as entropy
        from scored join lex using (target, related, unrelated)""",
    "context_entropy": """
        select concat('ctx ', s_suppkey) as isolated_context, s_acctbal / 2000.0::double as entropy from supplier""",
    "eleven": """
        select p_partkey as item, ordinal, p_retailprice / 1000.0::double + (p_partkey * 7 + ordinal * ordinal * 5) % 23 as f,
               p_size + (p_partkey * 7 + ordinal * ordinal * 5) % 23 as size
        from part cross join (select cast(unnest(range(11)) as integer) as ordinal)""",
    "result_files": """
        select c_custkey,
               case when c_nationkey = 7 then concat('other/', lower(c_mktsegment))
                    else concat('data/results/', lower(c_mktsegment), '-uncased_',
                                case when c_nationkey % 2 = 0 then 'word' else 'sentence' end, '_10.csv') end as bucket_file,
               concat('data/results/', lower(c_mktsegment), '-uncased_',
                      case when c_nationkey % 3 = 0 then 'polysemy_free' else 'prior_fix' end, '.csv') as fix_file,
               concat('data/priming_results/priming_', lower(c_mktsegment), '_',
                      case when c_nationkey % 2 = 0 then 'word' else 'sentence' end, '.csv') as priming_file
        from customer""",
    "sents": f"""
        select *, {sql_tokens("sentence")} as tokens from (
            select doc_id, cast(unnest(range(len(ls))) as integer) as line, unnest(ls) as sentence
            from (select doc_id, string_split(text, chr(10)) as ls from documents))
        where length(sentence) > 0""",
    "words": "select doc_id, line, unnest(tokens) as token from sents",
    "vocab": "select token, count(*) as n from words group by token",
    "word_lex": """
        select token as target, cast(unnest(range(1, case when n >= 20 then 3 else 2 end)) as integer) as sense
        from vocab""",
    "pieces": f"select token as target from vocab where n >= {PIECE_COUNT}",
    "once": "select doc_id, line, token as target from words group by all having count(*) = 1",
    "carriers": "select doc_id, line, target from once join word_lex using (target) where target <> 'am'",
    "stimuli": """
        select doc_id, line, tokens[m + 1] as target, coalesce(tokens[m + 2], tokens[1]) as related,
               coalesce(case when m > 0 then tokens[m] end, tokens[len(tokens)]) as unrelated, 'next' as relation,
               '[CLS] ' || array_to_string(list_concat(list_concat(case when m > 0 then tokens[1:m] else [] end, ['[MASK]']),
                                                       tokens[m + 2:]), ' ') || ' [SEP]' as context
        from (select *, len(tokens) // 2 as m from sents) where len(tokens) >= 1""",
    "vectors": "select vec_id, embedding, label, (label + 1) % 10 as prime from embeddings",
    "scores_long": """
        select vec_id, label, prime, cast(unnest(range(len(embedding))) as integer) as pos,
               cast(unnest(embedding) as double) as s from vectors""",
    "probs_long": """
        select *, exp(s - mx) / sum(exp(s - mx)) over (partition by vec_id) as p
        from (select *, max(s) over (partition by vec_id) as mx from scores_long)""",
}


def compose(sql: str) -> str:
    """Put the views a statement uses, and the views those use, in front of it."""
    needed: list[str] = []

    def visit(body: str) -> None:
        for name, definition in SQL_VIEWS.items():
            if name not in needed and re.search(rf"\b(?:from|join|,)\s+{name}\b", body):
                visit(definition)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{name} as ({SQL_VIEWS[name]})" for name in needed)
    body = sql.lstrip()
    return f"with {ctes}" + (",\n" + body[5:] if body.startswith("with ") else "\n" + body)
