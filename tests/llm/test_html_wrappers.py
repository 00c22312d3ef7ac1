import json

from timeloom.llm import html_wrappers as H
from timeloom.llm import queries


def text_of(page, *others):
    host = H.expression(H.parse(page))
    for other in others:
        host = H.align(host, H.expression(H.parse(other)))
    return H.Wrapper(json.loads(json.dumps(host))).text(H.parse(page))


def test_article_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p><p>no</p>";</script></head>
    <body><header><h2>Site</h2></header><nav><ul><li><a href=/a>menu</a><li><a>more</a></ul></nav><!-- <p>hidden</p> -->
    <div class="cookie-notice">We use cookies</div><article class=post><header><h1>Head &amp; line</h1></header>
    <p>One <b>bold<br>text</b>&nbsp;here.<p>Two &lt;b&gt; <a href="x">link</a>.<ul><li>first<li>second</ul>
    <div class="ad">buy</div><aside>side</aside><form><label>mail</label><input name=q></form><span class="ads">x</span>
    <p style="display: none">gone</p><p>T&#104;ree &eacute;.</article><section id="comments"><p>nice</p></section>
    <div class="sidebar"><p>side</p></div><footer>&copy; foot</footer>"""
    want = "Head & line\nOne bold text here.\nTwo <b> link.\nfirst\nsecond\nThree é."
    assert text_of(page) == want


def test_without_marked_articles_menus_of_links_go():
    def page(words):
        return (
            "<body><div><a>one menu</a> <a>entry</a></div><div><p>" + words + " text of this page</p><table><tr><td>cell "
            + words + "<td>b</table></div><div class=related>other</div></body>"
        )

    assert text_of(page("A"), page("B"), page("C")) == "A text of this page\ncell A\nb"


def test_fixed_text_is_template_where_other_text_varies():
    def page(words, extra=""):
        return f"<article><h1>{words} head</h1><div>Share this story</div>{extra}<p>{words} body</p></article>"

    pages = [page("A"), page("B", "<blockquote>quote</blockquote>"), page("C")]
    assert text_of(*pages) == "A head\nA body"
    assert text_of(pages[1], pages[0], pages[2]) == "B head\nquote\nB body"
    assert text_of(pages[0], pages[0], pages[0]) == "A head\nShare this story\nA body"


def test_text_of_one_page_is_no_template():
    def page(words, extra=""):
        return f"<article><h1>{words}</h1>{extra}<h2></h2><p>{words} body</p></article>"

    odd = page("A", "bare text").replace("<h2>", "<h2>Only here")
    others = [page(w) for w in "BCD"]
    assert text_of(odd, *others) == "A\nbare text\nOnly here\nA body"
    assert text_of(others[0], others[1], odd, others[2]) == "B\nB body"
    host = H.expression(H.parse(others[0]))
    for other in (others[1], odd, others[2]):
        host = H.align(host, H.expression(H.parse(other)))
    assert H.Wrapper(json.loads(json.dumps(host))).text(H.parse(odd)) == "A\nbare text\nOnly here\nA body"


def test_alignment_makes_optional_and_repeated_groups():
    a = H.expression(H.parse("<article><h1>x</h1><p>1<p>2<p>3</article>"))
    b = H.expression(H.parse("<article><h1>y</h1><figure>f</figure><p>1</article>"))
    for merged in (H.align(a, b), H.align(b, a)):
        h1, figure, p = merged[H._PARTS][0][H._PARTS]
        assert (h1[H._TEXT], h1[H._FLAGS], h1[H._PAGES]) == ("", 0, 2)
        assert figure[H._KEY] == "figure" and figure[H._FLAGS] == H.OPTIONAL
        assert p[H._FLAGS] == H.REPEATED and p[H._TEXT] == ""


def test_page_without_the_marked_article_is_read_without():
    pages = [f"<article><p>{w}</article>" for w in "abcd"]
    assert text_of("<body><p>plain</p><nav>n</nav></body>", *pages) == "plain"


def test_the_surest_mark_counts():
    page = (
        '<body class="no-sidebar post"><div id="content"><p>intro</p><main><p>lead</p><article><header>By me</header>'
        '<p>body</p></article></main></div><div class="content-sidebar"><p>side</p></div></body>'
    )
    assert text_of(page) == "By me\nbody"
    assert text_of(page.replace("article", "div")) == "lead\nBy me\nbody"
    assert text_of(page.replace("article", "div").replace("main", "div")) == "intro\nlead\nBy me\nbody"


def test_names_do_not_take_the_article_away():
    article = "<article><p>body of it</article>"
    for page in (
        f'<div class="content-sidebar-wrap"><main>{article}</main></div>',
        '<main class="has-sidebar"><p>body of it</main>',
        f'<div id="page" class="no-sidebar">{article}</div>',
        '<article class="post share-enabled"><p>body of it</article>',
        '<section id="social-policy"><p>body of it</section>',
        f'<div class="search-banner"><div class="promo">{article}</div></div>',
    ):
        assert text_of(page + '<div class="sidebar"><p>side</div>') == "body of it", page
    # Beside and within an article names count as before.
    page = '<article><p>body of it<div class="related">more and more and more</div></article>'
    assert text_of(page + '<div class="comments"><article class="comment"><p>nice</article></div>') == "body of it"
    page = '<div class="post"><p>body of the post</div><div id="comments"><article><p>nice</article></div>'
    assert text_of(page) == "body of the post"


def test_odd_markup_does_not_break():
    for page in ("", None, "<", "<p", "a < b <p>c", "<!-- open", "<script>x", "</p></div>text", "<a href='>'>q</a>", "<p>" * 500, "<div>" * 300 + "x"):
        assert isinstance(text_of(page), str)
    assert text_of("a < b <p>c") == "a < b\nc"
    assert text_of("<a href='>'>q</a>x") == "qx"


def test_rows(spark):
    rows = [
        (1, "http://H.example/a", "<article><p>A a</article>", "t", 1),
        (2, "https://u:p@h.example:80/b", "<article><p>B</article>", "t", 1),
        (2, "https://h.example/b", "<article><p>B</article>", "t", 1),
        (3, None, "<p>no host</p>", "t", 1),
        (4, "http://x", None, "t", 1),
        (None, "http://h.example", "", "t", 1),
        (5, "nonsense", "<article>" + "<p>word</p>" * 40_000 + "</article>", "t", 1),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host int")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in H.extract_main_text(pages).collect()}
    assert got[1, "http://H.example/a"] == ("A a", 3) and got[3, None] == ("no host", 7)
    assert got[4, "http://x"] == ("", 0) and got[None, "http://h.example"] == ("", 0)
    assert got[5, "nonsense"][1] == 40_000 * 5 - 1
    assert H.extract_main_text(pages).count() == 7
    assert H.extract_main_text(pages.limit(0)).count() == 0


def test_pages_give_their_documents(spark):
    """Each page of the given table holds one document's lines; compare with the documents."""
    folder = "/root/testdata/sf0.01"
    known = set()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        lines = [" ".join(x.split()) for x in (r.text or "").split("\n")]
        known.add("\n".join(x for x in lines if x))
    got = queries.op1_html_wrappers(spark, folder).collect()
    assert len(got) == spark.read.parquet(f"{folder}/pages.parquet").count()
    # The first line is the page's heading.
    assert sum(r.text.split("\n", 1)[-1] in known for r in got) >= 0.99 * len(got)
