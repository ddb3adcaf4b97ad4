"""Selectors over broken pages, by hand."""
from siftkit.sources import pages
from siftkit.sources.markup import Selector, Step, select

LISTING = """<!DOCTYPE html><UL class='nav list-style-none x'><li id=ad><h3><a href="/ad">ad</a></h3>
<li><div><h3 class="t"><a target=_blank href='/1?a=1&amp;b=2'>one</a></h3></div><li><h3><b><a href="/deep">no child of h3</a></b></h3>
<li><h3><a href="/2">two</a><a name="x">no link</a><ul><li><h3><a href="/inner">inner</a></h3></ul></h3></li></UL>
<ul class="other"><li><h3><a href="/3">three</a></h3></li></ul><!-- <ul class="list-style-none"><li><h3><a href="/c">comment</a></h3></li></ul> -->
<script>var s = '<ul class="list-style-none"><li><h3><a href="/s">script</a></h3></li></ul>';</script>
<ul class="list-style-none"><li><p>text<p>more<h3><a href=/4>four</a>"""

DETAIL = """<html><head><meta content='2020-01-02' property="article:published_time"><meta property=og:title content="A &quot;title&quot; > all">
<meta name="section" content="first"/><META NAME="x" CONTENT="y"><meta name="section" content="second"></head>
<body><div class="article-body"><p>One <b>bold <i>deep</b> after</i><br>line<p>Two &amp; <a href="#">link</a></p>
between<div><p>not a child</p></div><script>if (a < b) "</p>"</script><p></p><p>Three<!-- note -->four</div><p>outside</p>
<div class="article-body wide"><p>other class</p></div>
<div class='article-hash-tag'><span class="hash-tag"><a href="/a">#k1</a></span><span class="hash-tag"><a>#k<b>2</b></a></span><span class="x"><a>no</a></span>"""


def test_listing_links():
    assert select(LISTING, [pages.NEWS_LINKS]) == [["/1?a=1&b=2", "/2", "/inner", "/4"]]


def test_detail_fields():
    got = dict(zip(pages.NEWS_ARTICLE, select(DETAIL, list(pages.NEWS_ARTICLE.values()))))
    assert got["published_time"] == ["2020-01-02"] and got["title"] == ['A "title" > all'] and got["category"] == ["first", "second"]
    assert [t for t in got["content"] if t.strip()] == ["One ", "bold ", "deep", " after", "line", "Two & ", "link", "Three", "four"]
    assert got["keywords"] == ["#k1", "#k"]


def test_odd_pages():
    p = Selector((Step("p", deep=True),))
    for html, want in (("", []), ("no tags", []), ("<", []), ("<p", []), ("<p>", []), ("</p>x", []), ("<p>a", ["a"]), ("<p>a</b>b</p>c", ["a", "b"]),
                       ("<p>a<p>b", ["a", "b"]), ("<p>1 < 2</p>", ["1 < 2"]), ("<P CLASS=x>é&#39;&copy;</P>", ["é'©"]), ("<p>a<!-- x", ["a"]),
                       ("<p><table><tr><td>x<td>y</table>z", []), ("<p title='a>b'>c", ["c"]), ("<p>a<br/>b<img src=x>c</p>", ["a", "b", "c"])):
        assert select(html, [p]) == [want], html
    cells = Selector((Step("tr", deep=True), Step("td")))
    assert select("<table><tr><td>a<td>b<table><tr><td>c</table>d<tr><td>e", [cells]) == [["a", "b", "c", "d", "e"]]
    assert select("<div>" * 5000 + "<p>x" + "</div>" * 6000, [p]) == [["x"]]
    assert len(select("<p a='" + "x" * 200_000, [p])[0]) == 0


def test_tables_of_pages(spark):
    rows = [(1, "https://a.b/c?d", LISTING), (2, None, None), (3, "x", ""), (3, "http://h/", DETAIL)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    links = pages.extract_links(df, links=pages.NEWS_LINKS, template=pages.NEWS_TEMPLATE).collect()
    assert sorted((r.page_id, r.link_idx, r.link) for r in links)[:2] == [
        (1, 0, "https://www.chinatimes.com/1?a=1&b=2?chdtv"), (1, 1, "https://www.chinatimes.com/2?chdtv")]
    got = {(r.page_id, r.url): r for r in pages.extract_article(df, selectors=pages.NEWS_ARTICLE).collect()}
    assert len(got) == 4 and got[3, "http://h/"].title == 'A "title" > all' and got[2, None].content == [] and got[3, "x"].title is None
    assert pages.extract_article(df.limit(0)).count() == 0
