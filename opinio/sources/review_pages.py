"""Review pages written from raw review rows: the layouts that ``opinio.sources.markup`` reads, for tests and round trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio import resources as R


def _escaped(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("é", "&eacute;"), ("ü", "&#252;"), ("è", "&#xE8;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def _element(open_tags: str, value: str, close_tags: str) -> Column:
    """The element, or nothing for a null."""
    return F.coalesce(F.concat(F.lit(open_tags), _escaped(F.col(value)), F.lit(close_tags)), F.lit(""))


def _block(foreign: bool) -> Column:
    section = '<div class="a-section review aok-relative">'
    votes = F.when(F.col("Review_helpful_rating") == R.DEFAULT_VOTES, F.lit("")).otherwise(
        _element('<span class="a-size-base a-color-tertiary cr-vote-text">', "Review_helpful_rating", "</span>"))
    body = _element('<span class="a-size-base review-text review-text-content"><span>', "Review", "</span></span>")
    if foreign:
        head = [F.lit(f'{section}<div id="customer_review_foreign-1">'),
                _element('<div class="a-profile"><span class="a-profile-name">', "Reviewer_name", "</span></div>"),
                _element('<i data-hook="cmps-review-star-rating"><span class="a-icon-alt">', "Review_Rating", "</span></i>"),
                _element('<span data-hook="review-title"><span>', "Review_title", "</span><span>x</span></span>")]
        return F.concat(*head, body, votes, F.lit("</div></div>"))
    link = '<a class="a-size-base a-link-normal review-title a-color-base review-title-content a-text-bold"><i><span class="a-icon-alt">'
    # left open: the icon's element, as pages do; its end is implied by the link's
    head = [F.lit(f"{section}<!-- <p> -->"),
            _element('<a class="a-profile"><span class="a-profile-name">', "Reviewer_name", "</span></a>"),
            _element(link, "Review_Rating", "</span></i><span>|</span>"),
            _element("<span>", "Review_title", "</span>"), F.lit("</a>")]
    return F.concat(*head, body, votes, F.lit("</div>"))


def review_pages(reviews: DataFrame, page: list[str]) -> DataFrame:
    """``page_id, html``: one page for each value of the columns ``page`` (which must keep pages small), every second one in the foreign
    layout if it holds more than one review."""
    foreign = (F.pmod(F.xxhash64("_page"), F.lit(2)) == 0) & (F.size("blocks") > 1)
    each = (reviews.withColumn("_page", F.struct(*page))
            .groupBy("_page", "Model", "Company", "Overall_product_rating", "Overall_product_rating_count")
            .agg(F.collect_list(F.struct(_block(True).alias("foreign"), _block(False).alias("local"))).alias("blocks")))
    head = F.concat(
        F.lit('<!DOCTYPE html><html><head><script>var a = "</div><p>";</script><style>p{}</style></head><body>'),
        _element('<ul><li><span class="a-list-item"><a class="a-link-normal">', "Model", "</a></span></ul>"),
        _element('<span id="cr-arp-byline"><a class="a-size-base a-link-normal">', "Company", "</a></span>"),
        _element('<div><span data-hook="rating-out-of-text">', "Overall_product_rating", "</span></i></div>"),
        _element('<div data-hook="total-review-count"><span class="a-size-base a-color-secondary">', "Overall_product_rating_count", "</span></div>"))
    blocks = F.array_join(F.transform("blocks", lambda b: F.when(foreign, b["foreign"]).otherwise(b["local"])), "<br>\n")
    return each.select(F.md5(F.to_json(F.struct("_page", "Model", "Company"))).alias("page_id"), F.concat(head, blocks).alias("html"))
