"""Review extraction from stored pages (SRC3-SRC10).

The collector drove a browser over live pages.  Here the pages are already
stored (``pages(page_id, url, html)``) and extraction is a set of column
expressions over the ``html`` column -- ``regexp_extract_all`` per field and
``posexplode`` into one row per review block -- so it runs in the scan
stage with no shuffle.  The stored HTML is not well-formed XML, so XPath
functions are not usable; patterns avoid look-around so that the same
patterns run in other regex dialects.

Mapping of the stored page layout onto the review fields:
product key = host + path (without query/fragment), page number = the
``page`` query parameter (default 1), product name = ``<h1>`` (or
``<title>``), seller = host, review blocks = ``<p>`` paragraphs of the
``<article>`` with all their text (a paragraph ends at its end tag, at the next
paragraph or with the article; inner tags are dropped, line breaks kept and
entities decoded), helpful votes = the
``found this helpful`` phrase (default "0").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinio import resources as R
from opinio.session import cut_lineage

# ---------------------------------------------------------------------------
# FIXED VALUES: markers of the stored page layout.
TITLE_RE = r"<title>(.*?)</title>"
H1_RE = r"<h1>(.*?)</h1>"
ARTICLE_RE = r"(?s)<article>(.*?)</article>"
PARAGRAPH_START = r"(?i)<p(?:\s[^>]*)?>"
PARAGRAPH_END = "</p>"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"),
            ("&middot;", "\u00b7"), ("&copy;", "\u00a9"), ("&amp;", "&")]      # &amp; last
LINK_HREF_RE = r"<a href=\"([^\"]*)\">"
LINK_TEXT_RE = r"<a href=\"[^\"]*\">([^<]*)</a>"
LIST_ITEM_RE = r"<li>"
VOTES_RE = r"([0-9,]+|One) (?:people|person) found this helpful"
NEXT_PAGE_TEXT = "Next page"
FOREIGN_BLOCK_MARKER = "customer_review_foreign"
PRODUCT_KEY_RE = r"^[a-z]+://([^/?#]+)(/[^?#]*)"


def _rx(c: Column, pattern: str, idx: int = 1) -> Column:
    return F.regexp_extract(c, pattern, idx)


def _rx_all(c: Column, pattern: str, idx: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), idx)


def element_texts(html: Column) -> Column:
    """The texts of an array of elements: line breaks for ``<br>``, no tags, decoded entities, trimmed.  The steps are
    transforms of the array, so that each text is made once and texts without tags or entities skip them."""
    def plain(x: Column) -> Column:
        return F.when(x.contains("<"), F.regexp_replace(F.regexp_replace(x, r"(?i)<br\s*/?>", "\n"), r"<[^>]*>", "")).otherwise(x)

    def decoded(x: Column) -> Column:
        y = x
        for name, char in ENTITIES:
            y = F.replace(y, F.lit(name), F.lit(char))
        return F.trim(F.when(x.contains("&"), y).otherwise(x), F.lit(" \t\r\n"))
    return F.transform(F.transform(html, plain), decoded)


def articles(html: Column) -> Column:
    """Inner HTML of all ``<article>`` elements."""
    return _rx_all(html, ARTICLE_RE)


def paragraphs(article: Column) -> Column:
    """Inner HTML of the paragraphs of all articles, in order."""
    def of(a):
        parts = F.split(a, PARAGRAPH_START)
        return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
                           lambda p: F.substring_index(p, PARAGRAPH_END, 1))
    return F.flatten(F.transform(article, of))


def product_key(url: Column) -> Column:
    return F.concat(_rx(url, PRODUCT_KEY_RE, 1), F.regexp_replace(_rx(url, PRODUCT_KEY_RE, 2), "/$", ""))


def page_number(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit("page")).try_cast("int"), F.lit(1))


def page_fields(pages: DataFrame) -> DataFrame:
    """Page-level attributes (SRC4 dispatch, SRC5 attributes, SRC7 paging
    columns) without exploding anything."""
    html, url = F.col("html"), F.col("url")
    foreign = F.regexp_count(html, F.lit(FOREIGN_BLOCK_MARKER)) > 1
    return pages.select(
        "page_id", "url",
        product_key(url).alias("product_key"),
        page_number(url).alias("page_no"),
        F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1).alias("Company"),
        # SRC4: the layout decides which element names the product
        F.when(foreign, _rx(html, TITLE_RE)).otherwise(_rx(html, H1_RE)).alias("Model"),
        _rx(html, TITLE_RE).alias("page_title"),
        html.contains(NEXT_PAGE_TEXT).alias("has_next"),
        articles(html).alias("articles"),
    )


def review_blocks(pages: DataFrame) -> DataFrame:
    """SRC3/SRC5/SRC6: one row per review block (article paragraph), page
    attributes repeated on every block (lateral explode)."""
    return blocks_of(page_fields(pages))


def blocks_of(pf: DataFrame) -> DataFrame:
    blocks = pf.select("page_id", "product_key", "page_no", "Company", "Model",
                       F.posexplode(element_texts(paragraphs(F.col("articles")))).alias("block_no", "block"))
    return blocks.select(
        "page_id", "product_key", "page_no", "Company", "Model", "block_no",
        F.col("block").alias("Review"),
        F.coalesce(F.nullif(_rx(F.col("block"), VOTES_RE, 0), F.lit("")),
                   F.lit(R.DEFAULT_VOTES)).alias("Review_helpful_rating"))


def pages_until_last(pages: DataFrame, *columns: Column) -> DataFrame:
    """SRC7: per product, keep pages up to the first page that has no
    "Next page" link.  The per-product limit is a partial-aggregated
    group-by joined back (AQE splits a skewed product), not a window that
    would put all pages of a hot product in one task."""
    pf = page_fields(pages)
    if columns:                                               # only what the caller needs goes through the join
        pf = pf.select("page_id", "product_key", "page_no", "has_next", *columns)
    last = (pf.where(~F.col("has_next")).groupBy("product_key")
            .agg(F.min("page_no").alias("last_page")))
    return (pf.join(last, "product_key", "left")
            .where(F.col("last_page").isNull() | (F.col("page_no") <= F.col("last_page"))))


def collected_per_product(pages: DataFrame) -> DataFrame:
    """SRC8: reviews collected per product (none: 0) and the running total in
    product order (the order of the product's first page).  Blocks are counted
    before the join that ends a product's pages, so no article text is
    shuffled; the running total is summed within range partitions of the
    product order, plus the totals of the partitions before."""
    counted = pages_until_last(pages, F.size(paragraphs(F.col("articles"))).alias("n"))
    per = (counted.groupBy("product_key").agg(F.sum("n").cast("long").alias("reviews"),
                                              F.min("page_id").alias("first_page")))
    return running_total(per, ["first_page", "product_key"], "reviews", "cumulative_reviews")


def running_total(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Running sum of ``value`` in ``order`` without a one-task window: the rows are
    range-partitioned (and written, which fixes the partitions); only the totals
    per partition are summed up in one place."""
    part = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = part.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = totals.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    within = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return (part.withColumn("_within", within).join(before, "_part")
            .withColumn(out, F.col("_before") + F.col("_within")).drop("_part", "_within", "_before"))


def zip_shortest(*arrays: Column) -> Column:
    """SRC9: positional zip cut to the shortest array (a missing field
    shortens the result instead of shifting later rows)."""
    n = F.least(*[F.size(a) for a in arrays])
    return F.arrays_zip(*[F.slice(a, 1, n) for a in arrays])


def page_links(pages: DataFrame) -> DataFrame:
    html = F.col("html")
    z = zip_shortest(_rx_all(html, LINK_TEXT_RE), _rx_all(html, LINK_HREF_RE))
    return pages.select("page_id", F.inline(z)).toDF("page_id", "link_text", "href")


def field_counts(pages: DataFrame) -> DataFrame:
    """SRC10: number of values collected per field, in one aggregation."""
    html = F.col("html")
    return pages.agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum(F.length(_rx(html, TITLE_RE))).cast("long").alias("title_chars"),
        F.sum(F.size(_rx_all(html, LINK_HREF_RE))).cast("long").alias("links"),
        F.sum(F.regexp_count(html, F.lit(LIST_ITEM_RE))).cast("long").alias("list_items"),
        F.sum(F.size(paragraphs(articles(html)))).cast("long").alias("paragraphs"),
        F.count_if(F.length(F.trim(_rx(html, ARTICLE_RE))) == 0).alias("empty_articles"))
