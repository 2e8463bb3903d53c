"""Metrics of one score vector (array column): softmax, probability, rank, top word, entropy.

Everything stays inside the row, so a batch of contexts needs no shuffle.  For vocabulary-sized
vectors prefer ``operators.scoring.score``, which reduces to the same metrics before the vectors
leave the Python task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clozeframe.functions.measures import ColumnLike, as_column, bind


def softmax(scores: ColumnLike, renormalised: bool = False) -> Column:
    """Probabilities of a score vector; ``renormalised`` applies the softmax a second time."""
    exps = bind(
        F.transform(as_column(scores), lambda x: x.cast("double")),
        lambda s: bind(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top))),
    )
    p = bind(
        exps,
        lambda e: bind(
            F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x), lambda total: F.transform(e, lambda x: x / total)
        ),
    )
    return softmax(p) if renormalised else p


def prob_at(p: ColumnLike, index: ColumnLike) -> Column:
    """Probability at a 0-based index, NULL outside the vector."""
    return F.get(as_column(p), as_column(index).cast("int"))


def rank_at(p: ColumnLike, index: ColumnLike) -> Column:
    """1 + number of strictly better entries."""
    return bind(
        as_column(p),
        lambda q: bind(prob_at(q, index), lambda at: F.when(at.isNotNull(), F.size(F.filter(q, lambda x: x > at)) + 1)),
    )


def maxprob(p: ColumnLike) -> Column:
    return F.array_max(as_column(p))


constraint_score = maxprob


def argmax_index(p: ColumnLike) -> Column:
    """0-based index of the largest entry, lowest index on ties."""
    return bind(as_column(p), lambda q: (F.array_position(q, F.array_max(q)) - 1).cast("int"))


def argmax_token(p: ColumnLike, vocabulary: ColumnLike) -> Column:
    """Word at the largest entry; the vocabulary is an array column or literal array."""
    return F.get(as_column(vocabulary), argmax_index(p))


def entropy_bits(p: ColumnLike) -> Column:
    """Entropy in bits, with 0 log 0 = 0."""
    return F.aggregate(
        as_column(p),
        F.lit(0.0),
        lambda acc, x: acc + F.when(x > 0.0, -x * F.log2(x)).otherwise(F.lit(0.0)),
    )
