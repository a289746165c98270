import html
import re

import pytest

from tests.llm.conftest import SMALL
from vetrina.llm import extract_html as h


def text_of(page, templates=frozenset()):
    root = h.parse(page)
    h.digest(root)
    return h.main_text(root, templates)


@pytest.mark.parametrize("page, want", [
    ("", ""), ("plain  text\n x", "plain text x"), ("<p>a<p>b", "a b"), ("<div>a<b>b</b>c<br>d</div>", "abc d"),
    ("<p>x &amp; y&nbsp;&lt;z &#233; &eacute;&hellip;</p>", "x & y <z é é…"), ("<p>1 < 2 &bogus; <3</p>", "1 < 2 &bogus; <3"),
    ('<p title="a>b">q</p><script>if (a<b) "</p>"</script>z<!-- c --><!-- open', "q z"),
    ('un"quoted <a href="x>text</a> more <p>tail', 'un"quoted text more tail'), ("text <a", "text"), ("text <", "text <"),
    ("<body><nav>menu</nav><article><h1>T</h1><p>body</p><div class='ad'>buy</div></article><footer>f</footer>", "T body"),
    ("<article><header><h1>T</h1></header><p>b</p><section id=comments><article class=comment><p>nice</p></article></section><form>x</form></article>", "T b"),
    ("<div class='has-sidebar'><main><p>one</p></main><div id='side-bar' class='sidebar'>s</div></div><div class='cookie-notice'>c</div>", "one"),
    ("<form action=x><h1>All</h1><p>in a form</p></form>", "All in a form"), ("<div hidden>x</div><p style='display: none'>y</p>z", "z"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("<ARTICLE><P>Up</P></ARTICLE>x", "Up"), ("<article></article><p>outside</p>", "outside"),
    ("<p><b>A<p>B</b> c<li>d</p>e", "A B c d e"), ("<textarea>t</textarea><p>x</p><style>p{}", "x")])
def test_pages(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", '<a "' * 50_000, "<" * 100_000, "<!--" * 50_000, "<p>" * 100_000, "<b>" * 30_000 + "</i>" * 30_000, "&" * 100_000])
def test_hostile_pages_take_linear_time(page):
    text_of(page)


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", None) for r in rows], "page_id long, url string, html string, host int, row_key string, gone int")


def run(spark, rows, **options):
    got = h.extract(pages(spark, rows), **options).collect()
    assert all(r.n_chars == len(r.text) for r in got)
    return sorted(((r.page_id, r.text) for r in got), key=str)


def test_templates_go_and_content_stays(spark):
    rows = [(i, f"https://a.example/{i}", f"<div><p>Welcome to our shop</p></div><div><p>story number {i} is here</p></div>") for i in range(8)]
    rows += [(100 + i, "https://b.example/x", "<div><p>Welcome to our shop</p></div>") for i in range(2)]  # too few there
    rows += [(200 + i, "https://c.example/copy", "<div><p>the same article in many copies</p></div>") for i in range(30)]  # one content
    rows += [(300 + i, f"//D.example:80/{i}", f"<article><p>licence line</p><p>{i}</p><div>share me</div></article>") for i in range(6)]
    want = [(i, f"story number {i} is here") for i in range(8)] + [(100 + i, "Welcome to our shop") for i in range(2)]
    want += [(200 + i, "the same article in many copies") for i in range(30)] + [(300 + i, f"licence line {i}") for i in range(6)]
    assert run(spark, rows) == sorted(want, key=str)


def test_edges(spark):
    rows = [(1, None, None), (2, "", ""), (None, "https://x.example", "<p>a</p>"), (3, "no host", "<p>b</p>"), (3, "no host", "<p>b</p>"),
            (4, None, "<p>" + "long " * 100_000)]
    assert run(spark, rows) == sorted([(1, ""), (2, ""), (None, "a"), (3, "b"), (3, "b"), (4, ("long " * 100_000).strip())], key=str)
    assert run(spark, []) == []


def test_small_table(spark):
    got = {r.page_id: r.text for r in h.query(spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        plain = re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", article))
        assert got[r.page_id] == " ".join(html.unescape(plain).split())


def neutral(i, host="n.example"):
    """A page whose chrome has neutral tags and names."""
    return (i, f"https://{host}/{i}", f"<div class=x1><div class=y><p>Start here, then go there</p></div><div class=z>Story {i}<p>tells of {i} things</p></div>"
            f"<div class=q>Read on <a href=/{i % 3}>part {i % 3}</a></div><section><p>All of us wish you well</p></section></div>")


def brute(rows, min_pages):
    """Which texts remain where blocks (given as their plain texts) that recur on ``min_pages`` contents go."""
    def blocks(i):
        return ["Start here, then go there", f"Story {i}", f"tells of {i} things", f"Read on part {i % 3}", "All of us wish you well"]

    count = {}
    for i in {r[0] for r in rows}:
        for b in blocks(i):
            count[b] = count.get(b, 0) + 1
    return sorted(((r[0], " ".join(b for b in blocks(r[0]) if count[b] < min_pages)) for r in rows), key=str)


@pytest.mark.parametrize("packed", [1 << 20, -1])
def test_neutral_chrome_goes_by_templates_alone(spark, packed):
    rows = [neutral(i) for i in range(40)] + [neutral(i) for i in range(5)]
    got = run(spark, rows, packed=packed)
    assert got == brute(rows, h.MIN_PAGES) and all(t == f"Story {i} tells of {i} things" for i, t in got)
    few = [neutral(i, "few.example") for i in range(4)]
    assert run(spark, few, packed=packed) == brute(few, h.MIN_PAGES)


def test_a_template_goes_however_large_the_host(spark):
    rows = [(i, f"https://big.example/{i}", f"<div>{'<div>now and then</div>' if i < 6 else ''}<p>page {i}</p></div>") for i in range(1500)]
    assert run(spark, rows) == sorted([(i, f"page {i}") for i in range(1500)], key=str)


@pytest.mark.parametrize("page, want", [
    ("<nav>" + "<b>" * 400 + "x</nav><p>Body text</p>", "Body text"), ("<p>" + "<i>" * 50 + "a<p>b", "a b"),
    ("<article><p>one</p></article><article><p>" + "two " * 50 + "</p></article><article class=teaser>no</article>", "one " + "two " * 49 + "two"),
    ('<article><section class="search-results-study"><p>a</p></section><p class="notice-period">b</p><div class="share-price">c</div><div class="share">d</div></article>', "a b c"),
    ('<div class="login-howto">how to</div><div class="site-header">h</div><div id="cookieBanner">c</div>', "how to"),
    ('<article><div class="site-header">h</div><div class="social-share">s</div></article>', "h")])
def test_names_and_depth(page, want):
    assert text_of(page) == want
