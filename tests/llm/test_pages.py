"""Main text of pages: held-out generated layouts, the test data, and broken markup."""

import html
import random
import re

from quillgraph.llm import htmltext
from quillgraph.llm.common import table


def test_held_out_layouts():
    extract, r = htmltext.Extractor(htmltext.trained()), random.Random(501)
    right = sum(extract(page) == "\n".join(main) for page, main in (htmltext.labelled_page(r) for _ in range(200)))
    assert right >= 180


def test_pages_of_the_test_data(spark):
    for r in htmltext.query(table(spark, "/root/testdata/sf0.01", "pages")).join(table(spark, "/root/testdata/sf0.01", "pages"), ["page_id", "url"]).collect():
        inside = re.sub(r"</?b>|<br>", " ", re.search(r"<article>(.*?)</article>", r.html, re.DOTALL)[1])
        want = "\n".join(s for s in (" ".join(html.unescape(x).split()) for x in re.split(r"<[^>]*>", inside)) if s)
        assert r.text == want and r.n_chars == len(want)


def test_parts_of_a_page():
    page = """<html><head><title>no</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
    <div class="cookie-notice"><p>We use cookies &amp; more.</p></div><main><article><h1>A &lt;title&gt;</h1><p>First <b>bold</b>
    line&nbsp;here.<p>Second &#233; line.<div class="ad">Buy this now.</div><script>var a = "<p>x</p>";</script><!-- <p>hidden</p> --><p>Third line.</p></article></main>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href=1>One</a></ul></aside><section class="comments"><p>Nice post, thanks for it.</p></section><form><p>Subscribe</p><input></form><footer>&copy; 2020 Me</footer></body></html>"""
    assert htmltext.Extractor(htmltext.trained())(page) == "A <title>\nFirst bold line here.\nSecond é line.\nThird line."


def test_broken_markup_does_not_fail(pages):
    odd = [None, "", "plain text", "<", "<<<>>>", "<p", "<p>a<p>b</div></div>", "<script>never ends <p>x", "<!-- never ends", "<a href='x>y", "&#xFFFFFFFF; &bogus;", "<div>" * 3000 + "x", "<b>" * 2000, "x" * 100_000, "<title>t</title><body>y", "<head><p>z</body>"]
    found = htmltext.query(pages([(i, None, h) for i, h in enumerate(odd)] + [(None, None, None), (1, None, "")])).collect()
    assert len(found) == len(odd) + 2 and all(r.n_chars == len(r.text) for r in found)
    assert htmltext.query(pages([])).count() == 0
