import html
import re

from facetframe.llm import html_extraction as h

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var a="</p><article>no</article>";</script></head>
<body><!-- <article>no</article> --><nav><ul><li><a href="/">Home page link</a></li></ul></nav><div class="cookie-notice">We use cookies here</div>
<div class="ad-12">Buy now for less</div><div class="{name}"><h1>Title</h1><p>First <b>pa</b>ra&eacute;&nbsp;graph
 with   text.</p><div class="par">Second one, with more text in it.<br>After a break</div><form><input><label>Name</label></form>
<aside>Side</aside><ul><li>one</li><li>two</li></ul><div id="comments"><p>I disagree with all of this very long text.</p></div></div>
<div class="sidebar"><p>Other things to read</p></div><footer>&copy; us</footer></body></html>"""
TEXT = "Title First paraé graph with text. Second one, with more text in it. After a break one two"


def test_boilerplate_goes_and_the_article_stays():
    for name in ("post-7 content", "story", "x"):
        text, path = h.extract(PAGE.format(name=name))
        assert text == TEXT
    assert path == ">body>div.x"


def test_odd_input():
    assert h.extract("") == ("", "")
    assert h.extract("plain &lt;text&gt; & more")[0] == "plain <text> & more"
    assert h.extract("<p>a<p>b<b>c</b>")[0] == "a bc"
    assert h.extract("<script>x")[0] == ""
    assert h.extract("a < b and <c")[0] == "a < b and <c"
    assert h.extract("<div hidden>x</div><div style='display: none'>y</div><div>z</div>")[0] == "z"
    assert h.extract("<article><header><h1>T</h1></header>long text</article><header>site</header>")[0] == "T long text"
    assert len(h.extract("<article>" + "word " * 200_000 + "</article>")[0]) == 5 * 200_000 - 1


def test_hosts_agree_on_paths(spark):
    # Three pages vote for a list that is somewhat longer than the article; the host's other pages outvote them.
    article = "<div class='main-{k}'><p>" + "the real article " * 40 + "</p></div>"
    usual = [(f"http://h.org/{k}", "<body>" + article.format(k=k) + "<div class='x'>little</div></body>") for k in range(40)]
    odd = "<body>" + article.format(k=99) + "<div class='x'><p>" + "other things to read " * 45 + "</p></div></body>"
    # A second template with a quarter of the pages, whose article stands elsewhere beside an intro on the first one's path.
    second = "<body><div class='main-1'><p>short intro</p></div><section class='longread'><p>" + "much longer text " * 30 + "</p></section></body>"
    rows = [*usual, ("http://H.org/odd", odd), *[(f"http://h.org/long/{k}", second) for k in range(12)], ("http://other.org", odd)]
    rows += [(None, "<p>x</p>"), (None, second), ("no host", odd), ("http://h.org/", None), ("http://h.org/", ""), ("http://h.org/", "")]
    pages = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "page_id long, url string, html string")
    pages = pages.selectExpr("*", "'t' text", "1 _host", "2 path", "3 _paths")
    got = [r for r in h.extract_pages(pages).orderBy("page_id").collect()]
    assert [r["page_id"] for r in got] == list(range(len(rows)))
    assert all(r["text"] == ("the real article " * 40).strip() for r in got[:41])
    assert all(r["text"] == ("much longer text " * 30).strip() for r in got[41:53])
    assert got[53]["text"].startswith("other things")
    assert got[54]["text"] == "x" and got[55]["text"].startswith("much longer") and got[56]["text"].startswith("other things")
    assert [r["text"] for r in got[57:]] == ["", "", ""]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert h.extract_pages(pages.limit(0)).count() == 0


def test_ties_and_refusals():
    page = "<body><div class='a'>one two three</div><div class='b'>six five four</div></body>"
    assert h.extract(page, [">body>div.b", ">body>div.a"]) == ("six five four", ">body>div.b")
    assert h.extract(page, [">body>div.a", ">body>div.b"]) == ("one two three", ">body>div.a")
    page = "<body><div class='a'>one</div><div class='b'>" + "six five four " * 9 + "</div></body>"
    assert h.extract(page, [">body>div.a"])[1] == ">body>div.b"
    assert h.extract("", [">body"]) == ("", "") and h.extract("x", [">body"]) == ("x", "")


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    got = h.extract_pages(pages).collect()
    assert len(got) == len(source)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S)[1]
        article = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article))
        assert r["text"] == " ".join(html.unescape(article).split())


def test_teasers_and_sections():
    long = "word " * 60
    page = f"<body><main><article><p>{long}</p></article><article><p>read more of this</p></article></main></body>"
    assert h.extract(page, [">body>main>article"])[0] == long.strip()
    page = f"<body><div><section><p>{long}</p></section><section><p>the end</p></section></div></body>"
    assert h.extract(page, [">body>div>section"])[0] == long + "the end"


def test_layout_flags_drop_no_article():
    text = ("the real article " * 20).strip()
    for start in ("main class='content has-sidebar'", "div class='entry-content no-sidebar'", "article class='post comments-open'",
                  "div id='page' class='with-banner'", "article class='sponsored'", "div class='post comments'", "div class='banner-box'"):
        page = f"<body><{start}><p>{text}</p><div class='sidebar'>Other</div></{start.split()[0]}><div>left over</div></body>"
        assert h.extract(page)[0] == text, start
    page = f"<body><div class='story'>short</div><div class='comments'>{text}</div><div class='ad'>buy</div></body>"
    assert h.extract(page)[0] == "short"
