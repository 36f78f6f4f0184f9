"""Text features (FEA*), tokenisers and n-grams (NGR1-3), and the
topic-cleaning steps (TXT1-5, TXT7), all as built-in Column expressions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinio import resources as R


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _regex_class_escape(chars: str) -> str:
    return "".join("\\" + ch if ch in "\\[]^-&" else ch for ch in chars)


PUNCT_CLASS = "[" + _regex_class_escape(R.PUNCTUATION) + "]"
WORD_TOKEN = r"[\p{L}\p{N}_]{2,}"       # runs of >= 2 word characters
ANY_WORD_TOKEN = r"[\p{L}\p{N}_]+"


# ---- FEA ----------------------------------------------------------------

def char_count(c) -> Column:
    """Number of characters (code points)."""
    return F.length(_c(c))


def word_count(c) -> Column:
    """Number of whitespace-separated words."""
    return F.regexp_count(_c(c), F.lit(r"(?U)\S+"))


def word_density(chars: Column, words: Column) -> Column:
    return chars.cast("double") / (words.cast("double") + F.lit(1.0))


def punctuation_count(c) -> Column:
    x = _c(c)
    return F.length(x) - F.length(F.translate(x, R.PUNCTUATION, ""))


def short_model_name(c, n: int = R.SHORT_MODEL_CHARS) -> Column:
    return F.substring(_c(c), 1, n)


def emoticon_run_count(c) -> Column:
    cls = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in R.EMOTICON_RANGES)
    return F.regexp_count(_c(c), F.lit(f"[{cls}]+"))


# ---- tokens and n-grams (NGR1-3) -----------------------------------------

def word_tokens(c, min_len: int = 2) -> Column:
    """Lower-cased runs of word characters of length >= min_len."""
    pat = WORD_TOKEN if min_len == 2 else (r"[\p{L}\p{N}_]{%d,}" % min_len)
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(pat), 0)


def without_words(tokens: Column, words: list[str], lower_first: bool = False) -> Column:
    """Drop tokens that are in ``words`` (order kept)."""
    if not words:
        return tokens
    # isin over literals is planned as a hash set, not a scan of the list per token
    return F.filter(tokens, lambda t: ~(F.lower(t) if lower_first else t).isin(*words))


def ngrams(tokens: Column, n: int) -> Column:
    """Contiguous n-grams joined by a blank; empty when fewer than n tokens."""
    if n == 1:
        return tokens
    return F.when(F.size(tokens) >= n,
                  F.transform(F.sequence(F.lit(0), F.size(tokens) - n),
                              lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))
                  ).otherwise(F.array().cast("array<string>"))


# ---- topic-cleaning steps (TXT1-5, TXT7) ---------------------------------

def remove_punctuation(c) -> Column:
    return F.translate(_c(c), R.PUNCTUATION, "")


def remove_mentions(c) -> Column:
    return F.regexp_replace(_c(c), R.MENTION_PATTERN, "")


def remove_urls(c) -> Column:
    return F.regexp_replace(_c(c), R.URL_PATTERN, "")


@lru_cache(maxsize=1)
def digit_chars() -> str:
    return R.all_digit_chars()


def remove_numbers(c) -> Column:
    """Delete every character that counts as a digit (decimal digits of all
    scripts plus superscript/subscript/circled forms): one ``translate``,
    a per-character set lookup."""
    return F.translate(_c(c), digit_chars(), "")


def split_words(c) -> Column:
    """Whitespace split with empty strings dropped (like ``str.split()``)."""
    return F.filter(F.split(_c(c), r"(?U)\s+"), lambda w: w != F.lit(""))


def remove_stop_words(c, stop_words: list[str]) -> Column:
    """Split on whitespace, drop words whose lower case is a stop word,
    re-join with one blank."""
    return F.array_join(words_but(c, stop_words), " ")


def words_but(c, stop_words: list[str]) -> Column:
    """The whitespace words whose lower case is no stop word."""
    return without_words(split_words(c), [w.lower() for w in stop_words], lower_first=True)


def collapse_spaces(c) -> Column:
    return F.array_join(split_words(c), " ")


def clean_steps(c, stop_words: list[str], order: str = "reference") -> Column:
    """TXT8 before the dictionary step: punctuation, mentions, URLs,
    numbers, stop words.  In the reference order the mention
    and URL steps follow the punctuation step and so never match;
    ``order='urls_first'`` runs them first."""
    return F.array_join(clean_words(c, stop_words, order), " ")


def clean_words(c, stop_words: list[str], order: str = "reference") -> Column:
    """The words that ``clean_steps`` joins."""
    x = _c(c)
    if order == "urls_first":
        x = remove_punctuation(remove_mentions(remove_urls(x)))
    else:
        x = remove_urls(remove_mentions(remove_punctuation(x)))
    return words_but(remove_numbers(x), stop_words)
