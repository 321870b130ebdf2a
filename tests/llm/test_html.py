"""The tag scanner against the standard library's, pages that are cut in odd ways, and markup made to hurt."""

import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import pytest

from cartlens.llm import html_text


class Plain(HTMLParser):
    """Tags and text as the standard library reads them."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.seen = []

    def handle_starttag(self, tag, attrs):
        self.seen.append((tag, False, dict(reversed([(k, v or "") for k, v in attrs]))))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.seen.append((tag, True, {}))


def test_markup_equals_the_standard_library():
    """Random well-formed tags, quoted and unquoted attributes, comments and scripts."""
    draw = random.Random(4)
    parts = [
        "<p>", "</p>", "<div class='a b' id=x>", "</div>", "text ", "a &amp; b", "<br/>", "<!-- <p> -->", "<script>if (a < b) '</p>'</script>",
        '<a href="x>y" title=it\'s data-hidden>', "</a>", "<IMG SRC=a ALT=''>", "<li hidden>", "</LI >", "<!DOCTYPE html>", "<style>p > a</style>", "x < y ",
    ]
    for _ in range(500):
        page = "".join(draw.choices(parts, k=draw.randrange(20)))
        plain = Plain()
        plain.feed(page)
        plain.close()
        mine = [(tag, closing, {} if closing else found) for _, tag, closing, found in html_text.markup(page) if tag]
        assert mine == plain.seen, page


@pytest.mark.parametrize(("page", "text"), [
    ("<html><head><title>t</title><body><p>one two three", "one two three"),
    ("<html><head><meta charset=x>Text at once <b>bold</b>", "Text at once bold"),
    ("<p data-hidden='false' class=overflow-hidden>kept</p><p hidden>gone</p>", "kept"),
    ("<p title=it's>one two don't</p><p>x", "one two don't\nx"),
    ("<article><p class='notice-period'>The period</p><p class='social-media-report'>Report</p><div class='post-ad-block'>buy</div>"
     "<div class='author-comment-list user'>first!</div></article>", "The period\nReport"),
    ("a < b and c <3 <p>d", "a < b and c <3\nd"), ("<p>a<!-->b--><!-- c", "ab-->"), ("<p>x<br>y &lt;z&gt; &#233;</p>", "x y <z> é"),
    (None, ""), ("", ""), ("<p>  </p>", ""),
])
def test_pages(page, text):
    assert html_text.extract(page, None) == text


def test_end_tags_that_may_be_left_out():
    page = "<ul><li>a<li>b</ul><dl><dt>c<dd>d</dl><table><tr><td>e<td>f<tr><td>g</table><p>h<p>i"
    assert [text for _, text, _ in html_text.blocks(page)] == list("abcdefghi")


MILLION = 1_000_000
HARD = [
    "<div ", "<a title=it's>", '<div class="', "<b>", "<div>", "<li><div><b><li>", "<", "<!--", "<!-->x", "</x>", "<title>", "<title></titlex>",
    "<!x", '<nav class="ad">', "<table><tr><td>x", "<p>x", "<a b='", "<a b=c ", "&amp;", "<p class=x-y-z>t", "<script>", "</", "<ul><li>a",
]


@pytest.mark.parametrize("unit", HARD)
def test_a_million_characters_of_any_markup(unit):
    start = time.process_time()
    html_text.extract("<b>" * 600 + unit * (MILLION // len(unit)), None)
    html_text.votes(unit * (MILLION // len(unit)))
    assert time.process_time() - start < 10


def brute(page, path):
    """All blocks below the path, found again by plain comparison of the parts of paths."""
    want = path.split("/")
    return "\n".join(text for p, text, _ in html_text.blocks(page) if p.split("/")[: len(want)] == want)


def test_extraction_by_path_equals_brute_force(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(60).collect()]
    for page in pages:
        found = html_text.blocks(page)
        for path in {p for p, _, _ in found}:
            lifted = html_text.lifted(found, path)
            assert path == lifted or path.startswith(f"{lifted}/")
            own = brute(page, lifted)
            running = sum(max(0, len(t) - 3 * n) for _, t, n in html_text._inside(found, lifted))
            if 2 * running >= html_text._running(found):
                assert html_text.extract(page, path) == own


def test_hosts_vote_like_a_plain_count(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    votes = {}
    for r in df.collect():
        host = re.match(r"[a-z]+://([^/:?#]*)", r["url"] or "")
        if host:
            votes.setdefault(host[1].lower(), Counter()).update(dict(html_text.votes(r["html"])))
    expected = {h: max(c, key=lambda p: (c[p], p)) for h, c in votes.items() if c}
    assert {r["host"]: r["path"] for r in html_text.host_paths(df).collect()} == expected


def test_repeated_pages_and_clashing_columns(spark):
    page = "<body><nav>menu</nav><div class=story><p>" + "words of an article " * 20 + "</p></div></body>"
    rows = [(1, "http://a.org/1", page), (1, "http://a.org/1", page), (2, None, page), (3, "no url", None), (None, "http://a.org/2", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "1 AS path", "2 AS row", "'y' AS _page", "3 AS rejected")
    found = html_text.main_texts(df).collect()
    assert Counter((r["row"]["page_id"], r["main_text"]) for r in found) == {
        (1, ("words of an article " * 20).strip()): 2, (2, ("words of an article " * 20).strip()): 1, (3, ""): 1, (None, ""): 1,
    }
    assert all(r["row"]["path"] == 1 and r["row"]["host"] == "x" for r in found)
