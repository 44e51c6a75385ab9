from __future__ import annotations

import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from policyscan.llm.extraction import Page, SiteTemplates, templates, with_main_text

from .tables import PAGE

FULL = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page with-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<main><article id=story><header><h1>The  title</h1></header><p>First &amp; <b>bold</b><br>line<p>Second &lt;p&gt; a &copy b
<script>var x = "</p>";</script><div class="ad">Buy</div><ul><li>one<li>two</ul><table><tr><td>a<td>b</table>
<form><p>Name<input></form><aside>Beside</aside><section id="comments"><p>I agree</p></section>
<footer>Tags</footer></article><article class="comment"><p>A reader</p></article></main>
<div role="complementary">More</div><p hidden>secret</p><footer>&copy; site</footer></body></html>"""


def test_the_article_without_what_surrounds_it():
    assert Page(FULL).text().split("\n\n") == ["The title", "First & bold line", "Second <p> a © b", "one", "two", "a b"]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain  text", "plain text"),
        ("<p>a<p>b", "a\n\nb"),
        ("<p>a<!-- x <p> --> b</p>", "a b"),
        ("<p>1 < 2 & 3 > 2</p>", "1 < 2 & 3 > 2"),
        ("<p>cut <b", "cut"),
        ("<div>a<p>b</p>c</div>", "a\n\nb\n\nc"),
        ("<p>a&nbsp;&nbsp;b&#x41;&#66;&unknown;</p>", "a bAB&unknown;"),
        ("<script>no</script><p>yes</p><textarea>no", "yes"),
        ("<p title='a>b' class=\"x\">t</p>", "t"),
        ("</p></div>x", "x"),
        ("<head><title>no</title><body>yes", "yes"),
        ("<nav>only menu</nav>", ""),
        ("<article></article><p>rest</p>", "rest"),
        ('<p class="head-line">kept</p><span class="ad">gone</span>', "kept"),
        ("<div style='display: none'>gone</div><p>kept</p>", "kept"),
        ("<p>" + "x" * 300_000, "x" * 300_000),
        ("<div>" * 3000 + "deep", "deep"),
        ("<a '" * 3000, ""),
    ],
)
def test_pages(html, text):
    assert Page(html).text() == text


STORY = "<article><h1>Title</h1><p>The story</p></article>"


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "with-comments", "page-widget", "sidebar-left", "main widget"])
def test_names_of_what_is_around_the_article_do_not_remove_it(name):
    beside = '<div class="sidebar"><p>A text beside that is longer</p></div><div class="site-footer">End</div>'
    for attribute in ("class", "id"):
        assert Page(f'<div {attribute}="{name}">{STORY}{beside}</div>').text() == "Title\n\nThe story"
        assert Page(f'<div {attribute}="{name}"><main><p>The story</p></main>{beside}</div>').text() == "The story"
    prose = "".join(f"<p>Line {i} of the story</p>" for i in range(9))
    assert Page(f'<div class="{name}">{prose}{beside}</div>').text().split("\n\n")[:9] == [f"Line {i} of the story" for i in range(9)]


def test_names_within_an_article():
    html = """<article><h2 id="related-work">Related work</h2><section id="comments-on-method"><p>On the method</p></section>
<p class="notice">Notice this</p><p>See <a class="social">them</a>, <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p>
<div class="related-posts"><p>gone</p></div><section id="comments"><p>gone, however long this comment of a reader is, and it is long,
longer than all that the article itself has to say about its own subject, be it the method or the related work.</p></section></article>"""
    assert Page(html).text() == "Related work\n\nOn the method\n\nNotice this\n\nSee them, x=1"


def test_articles_in_asides_do_not_replace_the_text():
    prose = "<p>" + "A long story. " * 20 + "</p>"
    story = ("A long story. " * 20).strip()
    card = "<article><p>card</p></article>"
    assert Page(f'<article>{prose}</article><div class="widget">{card}</div>').text() == story
    assert Page(f'<main>{prose}<div class="related-posts">{card}</div></main>').text() == story
    assert Page(f'<main>{prose}<section class="comments">{card}</section></main>').text() == story
    assert Page(f'<div>{prose}</div><div class="related">{card}</div>').text() == story
    assert Page(f'<div>{prose}</div><div class="widget">{card}</div>').text() == f"{story}\n\ncard"
    assert Page(f'<div>{prose}</div><ol class="comment-list"><li><article class="comment-body">{prose}{prose}</article></ol>').text() == story


def site(spark, n=12, extra=()):
    rows = [
        (i, "http://a.org/%d" % i, f'<div><p>Welcome to our site</p></div><div><p>Story {i} of many</p><p>A line on all</p></div>')
        for i in range(n)
    ]
    rows += [(100 + i, "https://b.org:80/x", f"<article><p>A line on all</p><div><p>Share {i // 99}</p></div><p>Own {i}</p></article>") for i in range(9)]
    return spark.createDataFrame([*rows, *extra], PAGE)


def test_subtrees_that_recur_on_a_host_are_deleted(spark):
    found = {r.page_id: r.text for r in with_main_text(site(spark)).collect()}
    assert all(found[i] == f"Story {i} of many" for i in range(12))
    # Prose of an article stays, other subtrees in it go.
    assert all(found[100 + i] == f"A line on all\n\nOwn {i}" for i in range(9))


def test_copies_of_a_page_are_no_template(spark):
    copies = [(500 + i, "http://c.org/", "<div><p>The same story</p></div>") for i in range(30)]
    near = [(600 + i, "http://d.org/", "<p>Alone</p>" + " " * i) for i in range(30)]
    found = {r.page_id: r.text for r in with_main_text(site(spark, extra=copies + near)).collect()}
    assert all(found[500 + i] == "The same story" for i in range(30))
    # A page that would lose all its text keeps it.
    assert all(found[600 + i] == "Alone" for i in range(30))


def test_near_copies_of_a_page_are_no_template(spark):
    body = "<h2>Title</h2><div><p>The same story</p></div><ul><li>one<li>two</ul><table><tr><td>a<td>b</table>"
    text = "Title\n\nThe same story\n\none\n\ntwo\n\na b"
    kinds = {"e.org": f"<article>{body}<p>End</p></article>", "f.org": f"<main>{body}<p>End</p></main>", "g.org": f"<div>{body}<p>End</p></div>"}
    rows = []
    for host, html in kinds.items():
        for i in range(30):
            rows.append((i, f"http://{host}/{i}", f"<script>track({i});</script><nav>{i}</nav><!-- ad {i} -->{html}<!-- {i} -->"))
        # Other pages of the host share a template.
        rows += [(100 + i, f"http://{host}/{i}", f"<div><b>Template</b></div><div><i>Page {i}</i></div>") for i in range(9)]
    found = {(r.url.split("/")[2], r.page_id): r.text for r in with_main_text(spark.createDataFrame(rows, PAGE)).collect()}
    assert all(found[host, i] == f"{text}\n\nEnd" for host in kinds for i in range(30))
    assert all(found[host, 100 + i] == f"Page {i}" for host in kinds for i in range(9))


def test_few_pages_make_no_template(spark):
    df = site(spark, n=4)
    assert templates(df).where("host = 'a.org'").isEmpty()
    assert templates(df, SiteTemplates(pages=4)).where("host = 'a.org'").count() > 0
    shuffled = with_main_text(site(spark), SiteTemplates(broadcast=0))
    assert {tuple(r) for r in shuffled.collect()} == {tuple(r) for r in with_main_text(site(spark)).collect()}


def test_nulls_and_clashing_columns(spark):
    rows = [(1, None, "<p>a</p>"), (None, "http://x.org", None), (2, "no url", ""), (2, "no url", "")]
    df = spark.createDataFrame(rows, PAGE).withColumn("_host", F.lit("h")).withColumn("text", F.lit(3)).withColumn("_TEMPLATES", F.lit(1))
    found = with_main_text(df)
    assert found.columns == df.columns
    assert sorted((str(r.page_id), r.text, r._host) for r in found.collect()) == [("1", "a", "h"), ("2", "", "h"), ("2", "", "h"), ("None", "", "h")]
    assert with_main_text(df.limit(0)).count() == 0


def test_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in with_main_text(pages).collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.DOTALL)[1].replace("<br>", " ")
        blocks = [" ".join(unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b)


@pytest.mark.parametrize("role", ["role='main'", 'role="main"', "role=main", 'ROLE = "Main"', 'class="x" role=" main "', "role='region main'"])
def test_the_main_role_is_an_attribute(role):
    html = f"<body><div>Menu text</div><div {role}><p>The story.</p></div><div>After it</div></body>"
    assert Page(html).text() == "The story."
    assert Page("<div data-role='main'><p>a</p></div><p>b</p>").text() == "a\n\nb"


@pytest.mark.parametrize(
    "html, text",
    [
        ("<i>" * 200_000 + "x" + "</b>" * 200_000, "x"),
        ("<button>" + "<i>" * 100_000 + "<div>x</div>" * 100_000, None),
        ("<div class='sidebar'>" * 50_000 + "x" + "</div>" * 50_000 + "<p>rest of it</p>", "rest of it"),
        ("<i>" * 100_000 + "<article>x</article>" * 50_000, None),
        ("<p>" * 200_000 + "x", "x"),
        ("<li>" * 200_000 + "x" + "</ul>" * 200_000, "x"),
        ("<div role=main class=widget>" + "<section id=widget>" * 50_000 + "<p>x</p>", None),
    ],
    ids=["stray", "scoped", "named", "articles", "paragraphs", "items", "nested-main"],
)
def test_deep_pages_take_seconds(html, text):
    import time

    start = time.process_time()
    found = Page(html).text()
    assert time.process_time() - start < 20
    assert text is None or found == text
