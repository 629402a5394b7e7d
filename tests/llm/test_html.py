import os

import pytest

from feltgrid.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var x="</p><p>no</p>";</script></head><body>
<header><p>Site name</p></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<!-- note <p>no</p> --><div class="ad">Buy now</div><div id="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p>One <b>bold<br>line {n}<p>Two&nbsp;&lt;x&gt; a  b
c</p><div class="advert">Buy</div><table><tr><td>1<td>2<tr><td>3</table><form><p>Name</p><input></form>
<section class="comments"><p>First!</p></section><p hidden>no</p><p style="display: none">no</p></article>
<aside>Side</aside><footer>&copy; site</footer><script>unclosed"""


def text_of(source):
    """The page's text when every declared branch is weak."""
    weak = html.parse(source).declared
    return html.main_text(source, weak, weak)


def test_blocks_of_an_untidy_page():
    assert text_of(PAGE.replace("{n}", "7")) == "Title & more One bold line 7 Two <x> a b c 1 2 3"


def test_parser_survives_anything():
    for source in ("", "<", "<<<", "</p>", "<p", '<a href="x', "<!--", "<p>a</div>b", "&#0;&#x110000;&bogus;", "<b><i>x</b>y</i>z", "<script>", "a<br>b" * 3000, "<div>" * 3000 + "x"):
        html.main_text(source, set(), set())
    assert html.main_text("a<br>b", set(), set()) == "a b"
    assert html.main_text("x<b>y</b>z<p>w", set(), set()) == "xyz w"
    assert html.main_text("1 < 2 <p>3 > 2", set(), set()) == "1 < 2 3 > 2"


def pages(n, host="h.example"):
    """Pages whose boilerplate nothing but its repetition gives away."""
    return [
        (i, f"http://{host}/{i}", f"<body><div class='top'><span>Our site</span></div><div class='x'><p>Story {i} begins.</p><p>And {i * 7} ends.</p></div>"
            f"<div class='foot'>Call us at once</div></body>", "own host")
        for i in range(n)
    ]


def test_repeated_branches_go_and_stories_stay(spark):
    df = spark.createDataFrame(pages(30), "page_id long, url string, html string, host string")
    found = {r.page_id: (r.text, r.n_chars) for r in html.extract(df).collect()}
    for i in range(30):
        want = f"Story {i} begins. And {i * 7} ends."
        assert found[i] == (want, len(want))


def test_awkward_rows(spark):
    rows = [(1, None, None, "x"), (2, "no host", "", "x"), (None, "http://h/1", "<p>a</p>", "x"), (3, "http://h/2", "<p>b</p>", None), (3, "http://h/2", "<p>b</p>", None),
            (4, "http://h/3", "<article>" + "<p>word " * 20_000 + "</article>", "x")]
    found = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()
    assert len(found) == 6
    text = {r.page_id: r.text for r in found}
    assert text[1] == "" and text[2] == "" and text[None] == "a" and text[3] == "b" and text[4] == " ".join(["word"] * 20_000)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_one_template_on_every_page_is_kept_as_a_last_resort(spark):
    rows = [(i, f"http://same/{i}", "<body><div><p>All pages say this.</p></div></body>") for i in range(10)]
    found = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in found} == {"All pages say this."}


def test_text_beside_article_elements_is_kept():
    page = "<body class='has-sidebar'><div class='story'><p>The story.</p></div><article class='comments-open'><p>A teaser.</p></article><div class='sidebar-2'>Ads</div></body>"
    assert text_of(page) == "The story. A teaser."
    assert text_of("<html class='nav'><body id='search'><main class='related'><p>All of it.</p></main></body></html>") == "All of it."


def test_teasers_in_articles_do_not_hide_stories(spark):
    rows = [(i, u, h.replace("</body>", "<article><p>Read more here.</p></article></body>"), o) for i, u, h, o in pages(30)]
    found = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert found == {i: f"Story {i} begins. And {i * 7} ends." for i in range(30)}


def test_copies_of_a_page_are_one_page_of_the_tree(spark):
    rows = pages(30)
    rows += [(1_000 + i, f"http://h.example/copy/{i}", rows[3][2], "own host") for i in range(400)]
    found = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert len(found) == 430 and found[1_000] == found[3]
    assert all(found[i] == f"Story {i} begins. And {i * 7} ends." for i in range(30))


def test_reader_comments_and_listed_branches_go(spark):
    extra = ("<div class='comment-list'><p>Reader {i} says {j}.</p></div><div class='share-buttons'>Share {i}</div>"
             "<ul class='nav-list'><li>Go {i}</li></ul><div class='ad-container'>Buy {j} now</div><div class='has-sidebar'><p>Also {j}.</p></div>")
    rows = [(i, u, h.replace("<div class='foot'>", extra.format(i=i, j=i * 31) + "<div class='foot'>"), o) for i, u, h, o in pages(30)]
    found = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert found == {i: f"Story {i} begins. And {i * 7} ends. Also {i * 31}." for i in range(30)}


def test_near_copies_do_not_switch_the_tree_off(spark):
    rows = pages(30)
    rows += [(1_000 + i, f"http://h.example/copy/{i}", rows[3][2].replace("<body>", f"<body><!-- {i} -->"), "own host") for i in range(400)]
    found = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert len(found) == 430 and all(found[i] == f"Story {i} begins. And {i * 7} ends." for i in range(30)) and found[1_399] == found[3]


GIVEN = "/root/testdata/sf0.1/pages.parquet"


@pytest.mark.skipif(not os.path.exists(GIVEN), reason="given pages not present")
def test_the_tree_alone_removes_adverts_from_the_given_pages(spark):
    """Class words switched off: the texts stay the same, so the importance of ``div.ad`` removes it."""
    given = spark.read.parquet(GIVEN)
    heeded = {r.page_id: r.text for r in html.extract(given).collect()}
    alone = {r.page_id: r.text for r in html.extract(given, evidence=False).collect()}
    assert alone == heeded
