"""Row-local text functions: tokens, masking, priming, mask position, file-name parts.

None of them shuffles; each works on one sentence, context or path at a time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clozeframe.functions.measures import ColumnLike, as_column, bind

# Special tokens of a cloze context and the two priming templates.
CLS, MASK, SEP = "[CLS]", "[MASK]", "[SEP]"
PRIME_TEMPLATES = {
    "sentence": "[CLS] the next word is {}.",
    "word": "[CLS] {}.",
}

# A word (letters, digits, apostrophe) or one other visible character.
TOKEN_PATTERN = r"[\p{L}\p{N}']+|[^\s\p{L}\p{N}']"
# The same, with a bracketed special token counted as one token.
CONTEXT_TOKEN_PATTERN = r"\[[A-Z]+\]|" + TOKEN_PATTERN


def tokens(text: ColumnLike) -> Column:
    """Array of word and punctuation tokens."""
    return F.regexp_extract_all(as_column(text), F.lit(TOKEN_PATTERN), F.lit(0))


def context_tokens(context: ColumnLike) -> Column:
    """Tokens of a cloze context; ``[CLS]``-like markers count as one token each."""
    return F.regexp_extract_all(as_column(context), F.lit(CONTEXT_TOKEN_PATTERN), F.lit(0))


def join_tokens(tokens_col: ColumnLike) -> Column:
    return F.array_join(as_column(tokens_col), " ")


def singletons(tokens_col: ColumnLike) -> Column:
    """Tokens that occur exactly once in the array.

    Sorting puts equal tokens side by side, so each element is compared with two neighbours only.
    """
    ordered = F.sort_array(F.filter(as_column(tokens_col), lambda t: t.isNotNull()))
    return bind(
        ordered,
        lambda o: F.filter(
            o, lambda t, i: ~t.eqNullSafe(F.get(o, i - 1)) & ~t.eqNullSafe(F.get(o, i + 1))
        ),
    )


def neighbours(tokens_col: ColumnLike) -> Column:
    """Array of (prev, token, next) structs; NULL beyond the ends of the sentence."""
    return bind(
        as_column(tokens_col),
        lambda toks: F.transform(
            toks,
            lambda t, i: F.struct(
                F.get(toks, i - 1).alias("prev"), t.alias("token"), F.get(toks, i + 1).alias("next")
            ),
        ),
    )


def mask_word(sentence: ColumnLike, word: ColumnLike, literal: bool = True) -> Column:
    r"""``[CLS] … [SEP]`` with every free-standing occurrence of the word replaced by ``[MASK]``.

    Free-standing: no word character, slash or hyphen before it, and some other character after it,
    so a word that ends the text stays.  ``literal=False`` reads the word as a pattern.
    """
    word = as_column(word)
    if literal:
        # \E inside the word would end the quoting; re-open it there.
        word = F.concat(F.lit(r"\Q"), F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pattern = F.concat(F.lit(r"(?U)(?<![\w/-])(?:"), word, F.lit(r")(?=[^\w/-])"))
    masked = F.regexp_replace(as_column(sentence), pattern, F.lit(MASK))
    return F.concat(F.lit(CLS + " "), masked, F.lit(" " + SEP))


def prime(context: ColumnLike, prime_word: ColumnLike, mode: str = "word") -> Column:
    """Put the prime in front of the context, as a bare word or inside a carrier sentence."""
    before, after = PRIME_TEMPLATES[mode].split("{}")
    return F.replace(
        as_column(context), F.lit(CLS), F.concat(F.lit(before), as_column(prime_word), F.lit(after))
    )


def mask_index(context: ColumnLike) -> Column:
    """Number of tokens before the first ``[MASK]``."""
    return F.size(context_tokens(F.split_part(as_column(context), F.lit(MASK), F.lit(1))))


def token_before_mask(context: ColumnLike) -> Column:
    """The last token before the first ``[MASK]``; NULL if there is none.  Without a ``[MASK]`` the last token.

    Read backwards, so that the other tokens are not made.
    """
    backwards = F.reverse(F.substring_index(as_column(context), MASK, 1))
    return F.reverse(extract(backwards, r"\A\s*(\][A-Z]+\[|" + TOKEN_PATTERN + ")"))


def token_after_mask(context: ColumnLike) -> Column:
    """The first token after the first ``[MASK]``; NULL if there is none."""
    return extract(context, r"\[MASK\]\s*(" + CONTEXT_TOKEN_PATTERN + ")")


def extract(text: ColumnLike, pattern: str, group: int = 1) -> Column:
    """Regex group, NULL (not an empty string) where the pattern does not match."""
    return F.nullif(F.regexp_extract(as_column(text), pattern, group), F.lit(""))
