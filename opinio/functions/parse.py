"""Parsing of the raw review strings into numbers (CLN5-CLN9)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinio import resources as R

# A plain decimal number, as a strict numeric parser accepts it.  Spark's
# cast also takes forms like "1d" or "NaN"; they must become null instead.
NUMBER_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Whitespace strip on both ends (not only blanks, unlike ``trim``)."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def overall_rating_text(c) -> Column:
    return strip_ws(F.replace(_c(c), F.lit(R.OVERALL_RATING_SUFFIX), F.lit("")))


def rating_count_text(c, strip_commas: bool = True) -> Column:
    x = strip_ws(F.replace(_c(c), F.lit(R.RATING_COUNT_SUFFIX), F.lit("")))
    return strip_ws(F.replace(x, F.lit(","), F.lit(""))) if strip_commas else x


def review_rating_text(c) -> Column:
    return strip_ws(F.replace(_c(c), F.lit(R.REVIEW_RATING_SUFFIX), F.lit("")))


def helpful_votes_text(c, strip_commas: bool = False) -> Column:
    x = strip_ws(F.replace(_c(c), F.lit(R.HELPFUL_SUFFIX), F.lit("")))
    x = F.when(x == F.lit(R.HELPFUL_ONE), F.lit("1")).otherwise(x)
    return strip_ws(F.replace(x, F.lit(","), F.lit(""))) if strip_commas else x


def to_number(c) -> Column:
    """Text to double, or null when the text is not a plain number."""
    x = _c(c)
    return F.when(x.rlike(NUMBER_RE), x.try_cast("double"))


def parsed_numbers(strip_commas_in_votes: bool = False) -> dict[str, Column]:
    """The four numeric columns, parsed (name -> expression)."""
    return {
        "Overall_product_rating": to_number(overall_rating_text("Overall_product_rating")),
        "Overall_product_rating_count": to_number(rating_count_text("Overall_product_rating_count")),
        "Review_Rating": to_number(review_rating_text("Review_Rating")),
        "Review_helpful_rating": to_number(
            helpful_votes_text("Review_helpful_rating", strip_commas_in_votes)),
    }
