"""Measures on target probabilities, and the null rules every mean in this library follows.

Sign convention: facilitation is Surprisal(target | unrelated) - Surprisal(target | related), so a
positive value means the related prime helped.  Zero and NaN probabilities give NULL, and NULL rows
stay out of means.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

Z95 = 1.96


def as_column(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row.

    An array expression named inside a higher-order function would be computed again for every
    element; a lambda variable holds the finished value.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def finite(c: ColumnLike) -> Column:
    """NaN becomes NULL: Spark orders NaN above every number, so ``NaN > 0`` would count as true."""
    c = as_column(c).cast("double")
    return F.when(~F.isnan(c), c)


def ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b as double, NULL where b is 0 (ANSI division would raise)."""
    b = as_column(b).cast("double")
    return as_column(a).cast("double") / F.when(b != 0.0, b)


def surprisal(p: ColumnLike) -> Column:
    return -F.log2(finite(p))


def facilitation(
    related: ColumnLike = "related_probability",
    unrelated: ColumnLike = "unrelated_probability",
    kind: str = "bits",
) -> Column:
    """Advantage of the related over the unrelated prime: ``bits``, ``nats`` or plain ``difference``."""
    r, u = finite(related), finite(unrelated)
    if kind == "bits":
        return F.log2(r) - F.log2(u)
    if kind == "nats":
        return F.ln(r) - F.ln(u)
    if kind == "difference":
        return r - u
    raise ValueError(f"unknown facilitation kind: {kind!r}")


def rel_facilitation(
    related: ColumnLike = "related_probability", isolated: ColumnLike = "isolated_probability"
) -> Column:
    """Bits gained by the related prime over no prime at all; negate it for the opposite sign."""
    return F.log2(finite(related)) - F.log2(finite(isolated))


def distraction(
    related: ColumnLike = "related_probability", isolated: ColumnLike = "isolated_probability"
) -> Column:
    """Probability change by the related prime against no prime."""
    return finite(related) - finite(isolated)


def mean(c: ColumnLike, strict: bool = False) -> Column:
    """Mean over non-null rows; with ``strict`` one NULL makes the whole mean NULL."""
    c = as_column(c)
    avg = F.avg(c)
    return F.when(F.count(F.lit(1)) == F.count(c), avg) if strict else avg


def share(condition: Column, strict: bool = False) -> Column:
    """Proportion of rows where the condition holds (double, not decimal, so no digits are lost)."""
    return mean(condition.cast("double"), strict)


def std_error(c: ColumnLike) -> Column:
    """Standard error of the mean over non-null rows."""
    c = as_column(c)
    return F.stddev_samp(c) / F.sqrt(F.nullif(F.count(c), F.lit(0)).cast("double"))


def unit_bucket(bucket: ColumnLike = "bucket") -> Column:
    """Bucket number on the 0..1 axis."""
    return as_column(bucket).cast("double") / F.lit(10.0)


def bin_constraint(constraint: ColumnLike = "constraint", n: int = 10) -> Column:
    """Equal-width bin 1..n of a constraint score in [0, 1]."""
    c = finite(constraint)
    return F.greatest(F.lit(1), F.least(F.lit(n), F.ceil(c * F.lit(float(n))))).cast("int") + F.when(
        c.isNotNull(), F.lit(0)
    )


# Fixed value: the phrase that marks a synthetic neutral context.
NEUTRAL_PHRASE = "the last word of this sentence"


def neutral_constraint(context: ColumnLike = "context", constraint: ColumnLike = "constraint") -> Column:
    """Neutral contexts get constraint 0."""
    return F.when(F.contains(as_column(context), F.lit(NEUTRAL_PHRASE)), F.lit(0.0)).otherwise(
        as_column(constraint).cast("double")
    )
