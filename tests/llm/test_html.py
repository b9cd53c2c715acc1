"""Operator 7 against a plain extraction of the tables' pages, and on hand-made templates."""

import html
import re

from millrace.llm import html_text

SCHEMA = "page_id long, url string, html string, text string, host int, fixed string"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, "y") for i, u, h in rows], SCHEMA)


def texts(df):
    return {r.page_id: r.text for r in df.collect()}


def test_pages_of_the_table(spark, sf):
    got = texts(html_text.op7_html_extraction(spark, sf))
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        plain = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)>", "\n", body))
        assert got[r.page_id] == "\n".join(t for t in (" ".join(html.unescape(x).split()) for x in plain.split("\n")) if t)


def test_parts_left_out(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><a>Menu</a></nav><div class="cookie-notice">We use cookies</div>
    <article class="post"><h1>Head &amp; line</h1><p>One  <b>bold</b>
    two<p>Three &copy; &#233;<aside>Side</aside><div class="ad">Buy</div><form><label>Mail</label><input></form><script>var a = "<p>no</p>";</script>
    <!-- <p>hidden</p> --><ul><li>a<li>b</ul><section id="comments"><p>First!</p></section></article><div id="sidebar">S</div><footer>Foot</footer>"""
    got = texts(html_text.extract(pages_of(spark, [(1, "http://a.b/c", page), (2, None, None), (3, "http://a.b/", ""), (None, "http://a.b", "plain text"), (4, "http://c.d/x", "<p>a<p>b <i>c</i>")])))
    assert got == {1: "Head & line\nOne bold two\nThree © é\na\nb", 2: "", 3: "", None: "plain text", 4: "a\nb c"}


def test_template_without_an_article(spark):
    """Fixed texts that share their vector with tags go; the container with most text stays."""
    page = "<html><body><div class='wrap'><div class='bar'>Welcome to the site</div><div class='text'><p>{0} alpha beta gamma delta<p>more of {0} here</div><div class='end'>All told</div></div></body></html>"
    rows = [(k, f"http://h.example/{k}", page.format(f"story{k}")) for k in range(30)]
    assert texts(html_text.extract(pages_of(spark, rows)))[7] == "story7 alpha beta gamma delta\nmore of story7 here"


def test_copies_on_a_host_stay(spark):
    rows = [(k, f"http://h.example/{k}", "<body><article><p>same words on each page</p></article></body>") for k in range(40)] + [(99, "http://h.example/z", "x " * 100_000)]
    got = texts(html_text.extract(pages_of(spark, rows)))
    assert got[3] == "same words on each page" and len(got[99]) == 199_999
    assert html_text.extract(pages_of(spark, rows).limit(0)).count() == 0


def test_repeated_rows(spark):
    rows = [(1, "http://a/", "<p>x</p>")] * 3
    assert [r.text for r in html_text.extract(pages_of(spark, rows)).collect()] == ["x"] * 3


def story(k):
    return f"Story {k} tells of alpha{k} and beta{k} at some length, as no other page does."


def test_containers_differ_by_page(spark):
    """Ids of their own, two layouts on one host, sibling parts, lists beside paragraphs, no host: every page keeps its text."""
    rows, want = [], {}
    for k in range(30):
        body = (
            f"<div id='post-{k}'><p>{story(k)}</p></div>",
            f"<table><tr><td>{story(k)}</td></tr></table>",
            f"<div class=w><div class=a><p>{story(k)}</p></div><div class=b><p>End {k}.</p></div></div>",
            f"<div class=l><p>Intro {k}.</p><ul><li>{story(k)}</li></ul></div>",
        )[k % 4]
        rows.append((k, None if k > 20 else f"http://h.example/{k}", f"<html><body>{body}</body></html>"))
        want[k] = (story(k), story(k), f"{story(k)}\nEnd {k}.", f"Intro {k}.\n{story(k)}")[k % 4]
    assert texts(html_text.extract(pages_of(spark, rows))) == want


def test_copies_with_tags_of_their_own_stay(spark):
    """Copies that hold a table, also with another date on each, among 30 other pages; with and without <article>."""
    for name in ("article", "div"):
        rows = [(k, f"http://h.example/{k}", f"<body><{name}><p>{story(k)}</p></{name}></body>") for k in range(30)]
        copy = f"<body><{name}><p>Day {{}}</p><h3>A head</h3><p>{story('copied')}</p><table><tr><td>cell</td></tr></table></{name}></body>"
        rows += [(k, f"http://h.example/{k}", copy.format(k)) for k in range(100, 108)]
        got = texts(html_text.extract(pages_of(spark, rows)))
        assert got[103] == f"Day 103\nA head\n{story('copied')}\ncell" and got[3] == story(3)


def test_words_around_an_article(spark):
    """Words of boilerplate around an article, or in names of another meaning, don't drop it; comments still go."""
    page = "<body><div class='{}'><nav>Menu</nav><article><p>{}</p><div class='share-price'>Up 3</div></article><section class='comments'><article>First!</article></section></div></body>"
    names = ["layout has-sidebar", "social-policy", "page-with-header", "sidebar", "plain"]
    rows = [(k, f"http://h{k}.example/", page.format(c, story(k))) for k, c in enumerate(names)]
    assert texts(html_text.extract(pages_of(spark, rows))) == {k: f"{story(k)}\nUp 3" for k in range(len(names))}


def test_notice_inside_articles_on_hosts_of_any_size(spark):
    for n in (19, 20):
        rows = [(k, f"http://h.example/{k}", f"<body><article><p>{story(k)}</p><div class=x>Written by the desk</div></article></body>") for k in range(n)]
        assert texts(html_text.extract(pages_of(spark, rows))) == {k: story(k) for k in range(n)}


def test_template_of_the_table(spark, sf):
    """Its hosts' tags make classes that nest; bars are menus and the article isn't."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = html_text.templates(pages).collect()
    assert found
    for r in found:
        paths = {t.path for t in r.tags}
        t = html_text.Template([tuple(x) for x in r.tags], r.fixed)
        article = next(p for p in paths if p.endswith("/article"))
        assert t.around(article).endswith("/body") and article in t.children[t.around(article)]
        assert t.slot(f"{article}/p/no/such") == f"{article}/p"
        assert any("/nav" in m for m in t.menus) and not t.is_menu(article)


def test_menus_by_the_template(spark):
    """A menu without any telling name, in the same element as the story: only the template tells it."""
    page = "<body><div class=q><ul><li><a href=a>{0}</a><li><a href=b>Other {0}</a></ul><h1>Head {0}</h1><p>{1} <a href=c>link {0}</a></p></div></body>"
    rows = [(k, f"http://h.example/{k}", page.format(k, story(k))) for k in range(12)]
    assert texts(html_text.extract(pages_of(spark, rows))) == {k: f"Head {k}\n{story(k)} link {k}" for k in range(12)}
    alone = html_text.main_text(rows[3][2])
    assert alone == f"3\nOther 3\nHead 3\n{story(3)} link 3"


def test_repeated_rows_change_no_class(spark):
    """30 pages of a host share a paragraph on a third of them: rows twice, or three times, give what single rows give."""
    rows = []
    for k in range(30):
        more = "<p>A shared paragraph of real text</p>" if k % 3 == 0 else ""
        rows.append((k, f"http://h.example/{k}", f"<body><div class=a><div class=b>Fixed words</div><p>{story(k)}</p>{more}</div></body>"))
    once = texts(html_text.extract(pages_of(spark, rows)))
    assert once == {k: story(k) + ("\nA shared paragraph of real text" if k % 3 == 0 else "") for k in range(30)}
    for times in (2, 3):
        got = html_text.extract(pages_of(spark, rows * times)).collect()
        assert len(got) == 30 * times and all(r.text == once[r.page_id] for r in got)


def test_templates_beyond_the_broadcast(spark):
    rows = [(k, f"http://h{0 if k % 3 else k}.example/{k}", f"<body><div><div class=x>Fixed words</div><p>{story(k)}</p></div></body>") for k in range(60)]
    rows += [(100 + k, f"http://i{k % 4}.example/{k}", f"<body><div><div class=x>Fixed {k % 4}</div><p>{story(k)}</p></div></body>") for k in range(40)]
    want = texts(html_text.extract(pages_of(spark, rows)))
    assert want[1] == story(1) and want[107] == story(7)
    assert texts(html_text.extract(pages_of(spark, rows), most_broadcast=0)) == want


def test_pages_out_of_the_templates_order(spark):
    """A page with its parts the other way round is read by itself."""
    page = "<body><div class=a><p>{0}</p></div><div class=m><a>{1}</a></div></body>"
    rows = [(k, f"http://h.example/{k}", page.format(story(k), k)) for k in range(20)]
    rows.append((50, "http://h.example/50", f"<body><div class=m><a>50</a></div><div class=a><p>{story(50)}</p></div></body>"))
    got = texts(html_text.extract(pages_of(spark, rows)))
    assert got[3] == story(3) and got[50] == story(50)
