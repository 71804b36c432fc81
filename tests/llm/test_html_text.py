"""The page reader against a plain reading of all test pages, marked containers, and hostile pages."""

import html
import re
import time

import pytest
from oracle import DATA

from handbill.llm import queries
from handbill.llm.html_text import main_text

PROSE = "".join(f"<p>Paragraph {i}, which is long enough, I think, to count as real prose of the page.</p>" for i in range(5))
ARTICLE = f"<h1>Title</h1>{PROSE}"
BEFORE, AFTER = "<body><header><p>Site name</p></header><nav><a href=/>home</a></nav>", "<footer>About us, and more.</footer></body>"
LINES = ["Title", *re.findall("<p>(.*?)</p>", PROSE)]


def plain_reading(page):
    """The blocks of a page that holds its article in one article element: cut at each block's tags, decode, trim."""
    inner = re.search(r"(?s)<article>(.*?)</article>", page or "")
    if inner is None:
        return ""
    parts = re.split(r"</?(?:h1|p|div|ul|ol|li|blockquote|section)[^>]*>", inner[1])
    lines = (" ".join(html.unescape(re.sub(r"<[^>]+>", lambda m: " " if m[0].startswith("<br") else "", x)).split()) for x in parts)
    return "\n".join(x for x in lines if x)


@pytest.mark.skipif(not DATA.is_dir(), reason="the test tables are not here")
def test_registered_query_agrees_with_a_plain_reading_of_all_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = queries.op6_html_text(spark, str(DATA)).collect()
    assert len(got) == len(pages)
    for r in got:
        want = plain_reading(pages[r.page_id].html)
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want, len(want))


@pytest.mark.parametrize(
    "container",
    [
        '<div class="content has-sidebar">%s</div>', '<div class="post comment-open">%s</div>', '<section class="social-science">%s</section>', "<form action=go>%s</form>",
        "<form><div>%s</div><input name=q></form>", '<div class="sidebar">%s</div>', '<div id="comments">%s</div>', '<div class="widget"><article>%s</article></div>', "<main>%s</main>",
        '<span class="advert">%s</span>',
    ],
)
def test_marks_of_a_container_that_holds_the_article_are_dropped(container):
    assert main_text(BEFORE + container % ARTICLE + AFTER).split("\n") == LINES


@pytest.mark.parametrize(
    "other",
    [
        "<aside><p>Sidebar text, of some length, and more.</p></aside>", '<div class="ad-slot-2"><p>Buy now, cheap, today, and for ever.</p></div>', '<div class="comments-area"><article class="comment-body"><p>Me too, I say, and so on.</p></article></div>',
        "<form><p>Sign up, get mail, be happy.</p></form>", '<div role="alert"><p>We are moving, soon, to a new place.</p></div>', '<div hidden><p>Not shown, to anyone, at all.</p></div>', '<div style="DISPLAY : none">no</div>',
        '<ul><li><a href=1>one</a></li><li><a href=2>two</a></li><li><a href=3>three</a></li></ul>', '<div class="cookieConsent">We use cookies, many of them.</div>', "<script>var a = '<p>no</p>';</script>",
    ],
)
def test_what_is_no_article_goes(other):
    for page in (f"<article>{ARTICLE}{other}</article>", f"{other}<article>{ARTICLE}</article>", f"<div>{ARTICLE}</div>{other}"):
        assert main_text(BEFORE + page + AFTER).split("\n") == LINES


def test_nothing_of_an_article_is_dropped():
    long = "word word, " * 30
    body = f"<h1>Title</h1><p>Short lead.</p><div class=body><p>{long}</p></div><div><ul><li>a</li><li><a href=x>b</a></li></ul></div><table><tr><td>1<td>2</table><p>End note.</p>"
    want = ["Title", "Short lead.", long.strip(), "a", "b", "1 2", "End note."]
    assert main_text(f"{BEFORE}<article>{body}</article>{AFTER}").split("\n") == want
    assert main_text(f"{BEFORE}<main><div>{body}</div></main>{AFTER}").split("\n") == want


LINKS = "<ul><li><a href=1>Alpha</a></li><li><a href=2>Beta</a></li><li><a href=3>Gamma</a></li></ul>"


def test_lists_of_links_that_the_article_introduces_stay():
    page = f"{BEFORE}<article>{ARTICLE}<h2>Further reading</h2>{LINKS}</article>{AFTER}"
    assert main_text(page).split("\n") == [*LINES, "Further reading", "Alpha", "Beta", "Gamma"]
    titles = "".join(f"<li><a href={i}>A title of a source, number {i}, in full</a></li>" for i in range(4))
    assert main_text(f"{BEFORE}<article>{ARTICLE}<ul>{titles}</ul></article>{AFTER}").split("\n")[len(LINES) :] == [f"A title of a source, number {i}, in full" for i in range(4)]


def test_all_articles_of_a_main_element_stay():
    other = "<article><h2>Second</h2><p>Short, but an article of its own.</p></article>"
    comments = '<section class="user-comments"><article><p>Me too, I say, and so on.</p></article></section>'
    assert main_text(f"{BEFORE}<main><article>{ARTICLE}</article>{other}{comments}</main>{AFTER}").split("\n") == [*LINES, "Second", "Short, but an article of its own."]


def test_short_parts_beside_the_best_container_stay():
    page = f"{BEFORE}<div class=head><h1>Headline</h1></div><div class=d><div class=s1>{PROSE}</div><div class=s2><p>Short para.</p></div></div>{AFTER}"
    assert main_text(page).split("\n")[-6:] == [*LINES[1:], "Short para."]
    page = f"{BEFORE}<div class=head><h1>Headline</h1></div><div class=s1>{PROSE}</div><div class=s2><div><p>Short para.</p></div></div>{AFTER}"
    assert main_text(page).split("\n") == ["Headline", *LINES[1:], "Short para."]


@pytest.mark.parametrize("name", ["user-comments", "reader-comments", "blogComments", "google-ad", "article-ad", "adbox", "ad_units", "related-posts", "top-nav-2024", "post-pagination"])
def test_marked_parts_go_whatever_words_stand_beside(name):
    other = f'<div class="{name}"><p>Me too, I say, and so on, at length.</p></div>'
    for page in (f"<article>{ARTICLE}{other}</article>", f"<div>{ARTICLE}</div>{other}", f"<div>{ARTICLE}{other}</div>", f"<main>{other}{ARTICLE}</main>"):
        assert main_text(BEFORE + page + AFTER).split("\n") == LINES
    # The same name around all of the article is no mark.
    assert main_text(f'<div class="{name}">{ARTICLE}</div>').split("\n") == LINES


@pytest.mark.parametrize("name", ["address", "adoption-story", "advice", "navigator-review", "menurka", "commentary", "social-science", "has-sidebar"])
def test_names_that_only_look_like_marks(name):
    assert main_text(f'{BEFORE}<main>{ARTICLE}<div class="{name}"><p>A part of the article, of some length.</p></div></main>{AFTER}').split("\n") == [*LINES, "A part of the article, of some length."]


def test_marks_within_a_line():
    assert main_text('<p>Some text <span class="advert">BUY <b>NOW</b></span>and <span hidden>no <span>no</span> no</span>more.</p><p>B</p>') == "Some text and more.\nB"


@pytest.mark.parametrize(
    "page",
    ["<a " * 300_000, "</div" * 200_000, "<div>x" * 150_000, '<a title="x>' * 80_000, "<center>a" * 100_000 + "<li>" * 50_000, "</script " * 100_000, "<!--" * 200_000, "<span hidden>" * 80_000, "<ul>" * 60_000 + "<li>b</li>" * 60_000, "&lt" * 300_000],
)
def test_hostile_pages_take_seconds(page):
    began = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - began < 20
