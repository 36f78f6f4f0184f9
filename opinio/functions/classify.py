"""Keyword classifier (CLS1-CLS2) as one Column expression.

Keyword hits are *distinct keywords contained as substrings* of the text,
so ``ram`` hits ``program`` and nested keywords (``delivery`` inside
``delivery boy``) both count.  Counts compare the lower-cased keyword with
the lower-cased text; the two tie-break rules compare the keyword as
written, so a keyword with capitals can never hit there (the text is
already lower-cased).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinio import resources as R
from opinio.functions.text import word_count


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keyword_hits(text: Column, keywords: list[str], fold_case: bool = True) -> Column:
    """Number of list entries that occur as a substring of ``text`` (each
    entry counts once however often it occurs).  ``fold_case`` lower-cases
    both sides; otherwise the entry is matched as written."""
    if not keywords:
        return F.lit(0)
    t = F.lower(text) if fold_case else text
    hits = [F.when(F.contains(t, F.lit(k.lower() if fold_case else k)), F.lit(1)).otherwise(F.lit(0))
            for k in keywords]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return total


def classify(text_lower, product_keywords: list[str] = R.PRODUCT_KEYWORDS,
             service_keywords: list[str] = R.SERVICE_KEYWORDS,
             short_words: int = R.SHORT_REVIEW_WORDS) -> Column:
    """Decision list over the lower-cased review text:

    1. more product hits than service hits  -> product
    2. more service hits than product hits  -> service
    3. fewer than ``short_words`` words and any service keyword (as written) -> service
    4. at least ``short_words`` words and two or more such keywords -> service
    5. otherwise -> product
    """
    t = _c(text_lower)

    def label(x: Column) -> Column:
        prod = keyword_hits(x["low"], [k.lower() for k in product_keywords], fold_case=False)
        svc = keyword_hits(x["low"], [k.lower() for k in service_keywords], fold_case=False)
        svc_raw = keyword_hits(x["t"], service_keywords, fold_case=False)
        words = word_count(x["t"])
        return (F.when(prod > svc, F.lit(R.PRODUCT_LABEL))
                .when(svc > prod, F.lit(R.SERVICE_LABEL))
                .when((words < short_words) & (svc_raw > 0), F.lit(R.SERVICE_LABEL))
                .when((words >= short_words) & (svc_raw >= 2), F.lit(R.SERVICE_LABEL))
                .otherwise(F.lit(R.PRODUCT_LABEL)))
    # the text is bound once: in a filter on the label, Spark would make it again for every keyword
    return F.transform(F.array(F.struct(t.alias("t"), F.lower(t).alias("low"))), label)[0]
