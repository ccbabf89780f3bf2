"""Main text of pages."""

import time

from tidemark.llm import pages

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header class="site-header"><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></ul></nav><div class="wrap sidebar-left"><article class="post"><header><h1>T &eacute; &#65;</h1></header>
<p>One  <a href='x>y'>two</a>
three<p>Four &lt;b&gt; five<ul><li>a<li>b</ul><div class="ad-box">Buy</div><script>if(a<b){"</p>"}</script><table><tr><td>x</td><td>y</td></tr></table>
<form>f<input></form><p><b>bold<br><p>after</article></div><aside>side</aside><section class="comments"><article class="comment"><p>hi</p></article></section>
<div id="cookie-notice">ok</div><footer>f</footer></body></html>"""


def text_of(html):
    return pages.read_page(html, lambda h: False)


def test_the_article_is_read():
    assert text_of(PAGE) == "T é A\nOne two three\nFour <b> five\na\nb\nx\ny\nbold\nafter"


def test_odd_markup():
    assert text_of("") == "" and text_of("just text &amp; more") == "just text & more"
    assert text_of("<p>a<p>b</div></p></b>c") == "a\nb\nc"
    assert text_of("<script>never closed <p>x") == "" and text_of("a < b <c") == "a < b <c"
    assert text_of('<p title="a>b">x</p><!-- <p>no</p> --><p class=ad>no</p>') == "x"
    assert text_of("<div>" * 3000 + "deep" + "</div>" * 10) == "deep"


def test_site_templates_go(spark):
    def page(i, note):
        return f"<body><div class=box>Follow us <b>now</b></div><div><p>Text {i} of a page</p><p>{note}</p></div><div>Bye</div></body>"

    rows = [(i, "http://a.example/x%d" % i, page(i, "n%d" % i), 1) for i in range(6)]
    rows += [(10, "http://a.example/y", rows[0][2], 1)]  # a copy counts once
    rows += [(20 + i, "http://b.example/%d" % i, "<article><h1>H</h1><p>The same quotation</p><div>Share it</div><p>own %d</p></article>" % i, 1) for i in range(5)]
    rows += [(30, "http://c.example/", page(1, "n"), 1), (31, None, page(1, "n"), 1), (32, "http://a.example/z", None, 1), (None, "no host", "<p>x", 1), (30, "http://c.example/", page(1, "n"), 1)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, host int").repartition(3)
    out = pages.main_text(table).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    text = {r.page_id: r.text for r in out}
    assert text[0] == text[10] == "Text 0 of a page\nn0"
    assert text[20] == "H\nThe same quotation\nown 0"  # paragraphs of an article stay
    assert text[30] == text[31] == "Follow us now\nText 1 of a page\nn\nBye"  # one page has no templates
    assert text[32] == "" and text[None] == "x"
    assert pages.main_text(table.filter("false")).count() == 0


def test_a_republished_article_keeps_its_text(spark):
    """Near copies (another notice, date, ad or comment) don't make a body a template, on small hosts and on large ones."""
    def page(host, i, body):
        html = f"<article><div class=content>{body}</div><div>Share it</div><div>Printed on day {i}</div></article><div class=ad>Ad {i}</div>"
        return (f"http://{host}/{i}", html)

    paragraphs, bare = "<h2>Head</h2><p class=lead>The lead of it</p><p>The body of it</p>", "The whole body of it<br>in one element, without paragraphs"
    rows = [page("small.example", i, paragraphs) for i in range(12)] + [page("bare.example", i, bare) for i in range(12)]
    loose = "<div class=box>Follow us</div><div class=content><p>Loose body</p></div><div class=ad>Ad {0}</div><div class=comments>Comment {0}</div>"
    rows += [(f"http://loose.example/{i}", loose.format(i)) for i in range(12)]
    # 12 pages of 100 are no share that tells a template
    rows += [(f"http://large.example/{i}", f"<div class=content>{'Again' if i < 12 else i}</div><div class=box>Follow us</div><div>Date {i}</div>") for i in range(100)]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    text = {r.url: r.text for r in pages.main_text(table).collect()}
    for i in range(12):
        assert text[f"http://small.example/{i}"] == f"Head\nThe lead of it\nThe body of it\nPrinted on day {i}"
        assert text[f"http://bare.example/{i}"] == f"The whole body of it in one element, without paragraphs\nPrinted on day {i}"
        assert text[f"http://loose.example/{i}"] == "Follow us\nLoose body"
        assert text[f"http://large.example/{i}"] == f"Again\nDate {i}"
    assert text["http://large.example/50"] == "50\nDate 50"


def test_odd_pages_of_a_megabyte_are_read_in_linear_time():
    """Each of these took a time that grew with the square of the page, or stopped the task."""
    odd = [
        "<div>" * 100_000 + "</p>" * 125_000, "<!-- x " * 145_000, "<a " * 330_000, "<a " * 330_000 + ">", '<a ">" ' * 140_000 + "'",
        "<a '>\" <a \">' " * 70_000, "<div>x" * 90_000 + "</div>" * 90_000, "<article>" + "<div>x" * 90_000 + "</div>" * 90_000,
        "<span>" * 90_000 + "</div>" * 90_000, "<ul>" + "<li><b>" * 120_000, "<![CDATA[" * 110_000 + ">",
        "<article>x</article><div class=ad>" * 28_000, "&#" + "9" * 1_000_000 + ";",
    ]
    for html in odd:
        begin = time.process_time()
        pages.read_page(html, lambda h: True, lambda h: None)
        assert time.process_time() - begin < 10, html[:20]  # one to two seconds; the square took ten minutes and more
    assert text_of("&#" + "9" * 5000 + "; &#x41;&#0000000000065;") == "� AA"


def test_nested_templates_in_an_article():
    """Inner templates go first, and what an outer one still holds is counted without them."""
    html = "<article><p>The text of the article stays</p><div id=a>aa<div id=b>bbb<div id=c>c</div></div></div></article>"
    seen = []
    pages.read_page(html, lambda h: False, seen.append)
    c, b, a = seen
    assert pages.read_page(html, {a, b, c}.__contains__) == "The text of the article stays"
    assert pages.read_page(html, {b, c}.__contains__) == "The text of the article stays\naa"
    assert pages.read_page(html, {a}.__contains__) == "The text of the article stays"
    assert pages.read_page(html, {c}.__contains__) == "The text of the article stays\naa\nbbb"
