from pyspark.sql import functions as F

from opinio.schemas import RAW_COLUMNS
from opinio.sources import markup as M
from opinio.sources.review_pages import review_pages


def read(html, layouts=None, marker=""):
    return M.Reader(layouts or {"x": M.Layout("div[class=b]", {"t": "span", "u": "a > i:2"}, {"h": "h1"})}, marker).read(html)


def fields(html, **more):
    got = read(html, **more)
    return [{k: M._text(v) for k, v in b.items()} for b in got.blocks["x"]], {k: M._text(v) for k, v in got.page["x"].items()}


def test_selectors():
    s = M.selector("div[class=a b] > a[id*=x]:2 span")
    assert s == (M.Step("div", (("class", "a b"),)), M.Step("a", (), (("id", "x"),), 2, True), M.Step("span"))


def test_nested_and_broken_markup():
    blocks, page = fields('<h1>T &amp; U</h1><div class="b"><span>one<br>two <b>three</b></span><div><span>later</span></div>'
                          '<a><i>1</i><i>2</i></a></div><div class="b"><a><b><i>no child</i></b><i>first</i></a></div>')
    assert page == {"h": "T & U"}
    assert blocks == [{"t": "one\ntwo three", "u": "2"}, {}]
    # unclosed elements, stray end tags, tags in scripts, comments and attributes
    blocks, _ = fields('</span><div class="b" title="</div>"><span>a<script>"</span>"</script><!-- </span> -->b</em></div>'
                       '<div class="b"><span>open', )
    assert blocks == [{"t": "ab"}, {"t": "open"}]
    assert fields("")[0] == [] and fields("<")[0] == []


def test_implied_ends():
    layout = {"x": M.Layout("article p", {"t": "p"})}
    blocks, _ = fields("<p>out</p><article><p>one<b>bold<br><p>two<div>no</div>not</p><ul><li>x<li>y</ul><p>three</article><p>out", layouts=layout)
    assert blocks == [{"t": "one" + "bold"}, {"t": "two"}, {"t": "three"}]


def test_character_references():
    blocks, _ = fields('<div class="b"><span>&eacute;&#233;&#xE9;&lt;&nbsp;&hellip;&unknown; AT&T</span></div>')
    assert blocks == [{"t": "ééé< …&unknown; AT&T"}]


ROWS = [("M <1>", "C&C", "4.1 out of 5", "9 global ratings", "Title é", "Ann", "5.0 out of 5 stars", "Body\nwith <tags> & ü", "One person found this helpful"),
        ("M <1>", "C&C", "4.1 out of 5", "9 global ratings", None, "Bob", "1.0 out of 5 stars", "", "0"),
        ("M <1>", "C&C", "4.1 out of 5", "9 global ratings", "x", None, "2.0 out of 5 stars", None, "0")]


def test_both_layouts_round_trip(spark):
    schema = ", ".join(f"{c} string" for c in RAW_COLUMNS) + ", page int"
    df = spark.createDataFrame([(*r, page) for page in range(8) for r in ROWS] + [(*ROWS[0], 99)], schema)
    pages = review_pages(df, ["page"])
    out = M.raw_reviews(pages, RAW_COLUMNS).cache()
    assert {r.layout for r in out.select("layout").distinct().collect()} == {"foreign", "local"}
    got = sorted((tuple(r[c] for c in RAW_COLUMNS) for r in out.collect()), key=str)
    assert got == sorted(ROWS * 8 + ROWS[:1], key=str)
    assert out.where(F.col("layout") == "foreign").groupBy("page_id").count().agg(F.min("count")).first()[0] > 1


def test_empty_and_null_pages(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<p>no block</p>")], "page_id long, html string")
    assert M.raw_reviews(df, RAW_COLUMNS).count() == 0
    assert M.raw_reviews(df.where("1 = 0"), RAW_COLUMNS).count() == 0
