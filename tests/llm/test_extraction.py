"""Main text of pages."""

import math
import random
import re
import time

from tests.llm.conftest import words
from tidemark.llm.extraction import FLOOR, extract_pages, main_text, measure, parse

PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header class="site-header">Site <a href=/>Home</a></header><div id="cookie-notice">We use cookies</div>
<div class="wrap"><div class="sidebar"><ul><li><a href=x>One</a></li></ul></div><div class="content"><h1>Title &amp; more</h1><p>First para with <a href=x>a link</a> and text that goes on for some time.</p>
<div class="section"><p>Second paragraph, which is longer and has many words in it, to be dense.</p><p>Third&nbsp;one<br>with &#x27;break&#39;</p></div><form>Subscribe <input type=text></form><div class="ad-box">Buy!</div></div></div>
<section id="comments"><p>Great article! I liked it a lot and I want to say much more about it here in this long comment so that it is dense.</p></section><aside>Related</aside><footer>(c) 2024</footer></body></html>"""


def test_page_without_article_element():
    assert main_text(PAGE) == "Title & more\n\nFirst para with a link and text that goes on for some time.\n\nSecond paragraph, which is longer and has many words in it, to be dense.\n\nThird one with 'break'"


def test_article_element_keeps_short_blocks_and_drops_noise():
    page = '<body><nav><ul><li><a href="/a">menu</a></ul></nav><article><h1>Hi</h1><p>a<p>b &lt;c&gt;<script>var t="</p>";</script><!-- x --><div class="ad">buy</div><ul><li>one<li>two</ul></article><footer>f</footer>'
    assert main_text(page) == "Hi\n\na\n\nb <c>\n\none\n\ntwo"


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<script>x</script>") == ""
    assert main_text("plain &lt;b&gt; text") == "plain <b> text"
    assert main_text("<p>a<p>b") == "a\n\nb"
    assert main_text("<div><div>Only <b>bold</b> here</div></div>") == "Only bold here"
    assert main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>") == "deep"
    assert main_text("<article><div class=ad>x</article><p>") == ""


LONG = "A paragraph of the article that goes on for a good while and has many words in it."


def test_noise_words_in_other_names_and_values_cut_nothing():
    for attribute in ('style="overflow:hidden"', 'data-hidden="0"', 'title="hidden gems"', "class='layout with-sidebar'", 'class="has-comments"', 'id="share-prices"', 'class="content notice-board"'):
        assert main_text(f"<body><div {attribute}><h2>Head</h2><p>{LONG}</p><p>{LONG}</p></div></body>") == f"Head\n\n{LONG}\n\n{LONG}", attribute
    assert main_text(f'<article><p>{LONG} See <a href="/hidden-gems">the gems</a>.</p></article>') == f"{LONG} See the gems."


def test_noise_names_cut_unless_they_hold_the_article():
    for name in ("promo", "content notice", "page-header"):
        body = f'<div class="{name}"><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><div class="ad-box"><p>Buy</p></div></div>'
        assert main_text(f"<body>{body}<div><p>Short.</p></div></body>").startswith(f"Head\n\n{LONG}\n\n{LONG}") and "Buy" not in main_text(body), name
        assert main_text(f'<body><div class="{name}"><article><p>{LONG}</p></article></div></body>') == LONG
        assert main_text(f'<body><div class="{name}"><p>{LONG}</p><p>{LONG}</p></div><p>Short.</p></body>').startswith(f"{LONG}\n\n{LONG}")
        assert main_text(f'<body><div class="{name}">{LONG}</div></body>') == LONG
    for name in ("sidebar", "ad-box", "site-header", "comments2", "cookie-notice", "related_items"):
        for noise in (f'<div class="{name}" hidden2=x><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>', f"<div id='{name}'>{LONG}</div>", f"<div hidden><p>{LONG}</p></div>"):
            assert main_text(f"<body><article><h1>Head</h1><p>Brief.</p>{noise}</article>{noise}</body>") == "Head\n\nBrief.", name
            assert "Brief." in main_text(f"<body><div><h1>Head</h1><p>Brief and to the point it is.</p><p>Brief.</p></div>{noise}</body>")


def test_all_of_the_content_container_stays_in_page_order():
    section = f"<div class=section><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>"
    beside = '<p>Oslo, May 2.</p>Bare text <b>in</b> a <a href=/x>row</a> of words.{}<blockquote>&quot;No.&quot;</blockquote>Last words.<ul><li><a href=/a>More</a></li><li><a href=/b>stories</a></li></ul><a href=/c>Next page</a>'
    want = f'Oslo, May 2.\n\nBare text in a row of words.\n\n{LONG}\n\n{LONG}\n\n{LONG}\n\n"No."\n\nLast words.'
    for top in ("<h1>Head</h1>", "<h2>Head</h2>"):
        assert main_text(f"<body><div class=page><div><span>Site</span></div><div class=content>{top}{beside.format(section)}</div><div>(c) 2024</div></div></body>") == f"Head\n\n{want}"
    assert main_text(f"<body><div>Site</div><div class=content>{beside.format(section)}</div><div>(c)</div></body>") == want
    inner = f"<div class=inner>{beside.format(section)}</div>"
    assert main_text(f"<body><div class=content><h1>Head</h1>{inner}<p>End.</p></div><div>(c)</div></body>") == f"Head\n\n{want}\n\nEnd."


def test_forms_headers_and_marked_elements_are_weighed():
    article = f"<h1>Head</h1><p>{LONG}</p><p>{LONG}</p>"
    want = f"Head\n\n{LONG}\n\n{LONG}"
    assert main_text(f'<body><form id="aspnetForm"><div class=content>{article}</div><select><option>x</select></form></body>') == want
    assert main_text(f'<body><div id="page" class="site right-sidebar"><article>{article}</article></div></body>') == want
    assert main_text(f'<body><div class="layout with-sidebar"><div class="post">{article}</div></div><div>Other small</div></body>') == want
    assert main_text(f'<body><div class="post comments-open">{article}</div><div>Other small</div></body>') == want
    assert main_text(f"<body><header><p>{LONG}</p></header><article><header><h1>Head</h1></header><p>{LONG}</p><form>Mail <input></form></article></body>") == f"Head\n\n{LONG}"
    comment = f'<article class="comment-body"><p>{LONG} {LONG}</p></article>'
    assert main_text(f"<body><main>{article}{comment}{comment}</main></body>") == want
    assert main_text(f"<body><div><article><p>{LONG}</p></article><article><p>{LONG}</p></article></div></body>") == f"{LONG}\n\n{LONG}"
    assert main_text(f"<body><main><article>{article}</article><div><a href=/a>One</a> <a href=/b>Two</a></div></main></body>") == want


COMMENT = '<div class="c"><span>Ann</span><p>{0}</p></div>'


def test_readers_comments_adverts_and_boxes_go_whatever_their_names():
    article = f"<h1>Head</h1><p>{LONG}</p><p>{LONG}</p>"
    want = f"Head\n\n{LONG}\n\n{LONG}"
    comments = COMMENT.format(LONG) * 4
    for name in ('class="user-comments"', 'class="commentlist"', 'class="reader-comments"', 'class="c-comments-block"', 'id="commentsSection"', 'class="story-comments-list"'):
        for box in (f"<div {name}>{comments}</div>", f"<section {name}><h3>4 Comments</h3><ol><li>{LONG}</li><li>{LONG}</li></ol></section>"):
            assert main_text(f"<body><article>{article}{box}</article></body>") == want, name
            assert main_text(f"<body><article>{article}</article>{box}</body>") == want, name
            assert main_text(f"<body><div class=content>{article}{box}</div><div>(c)</div></body>") == want, name
            assert main_text(f"<body><div class=content>{article}</div>{box}</body>") == want, name
    for name in ("ad-slot-wide", "newsletter-signup-module", "cookie-policy-banner", "related-articles", "mid-article-ad", "article__sponsor-note"):
        box = f'<div class="{name}"><p>Some words that no reader of the article wants to read.</p></div>'
        assert main_text(f"<body><article><h1>Head</h1><p>{LONG}</p>{box}<p>{LONG}</p></article></body>") == want, name
        assert main_text(f"<body><div class=content><h1>Head</h1><p>{LONG}</p>{box}<p>{LONG}</p></div><div>(c)</div></body>") == want, name


def test_hints_cut_nothing_of_the_article():
    for name in ("commentary", "ad-free-content", "subscriber-only", "with-comments", "share-prices", "story-alert-level", "post comments-open", "has-related"):
        assert main_text(f'<body><article><h1>Head</h1><div class="{name}"><p>{LONG}</p><p>{LONG}</p></div></article></body>') == f"Head\n\n{LONG}\n\n{LONG}", name
    assert main_text(f'<body><article><h1>Head</h1><p>{LONG}</p><div class="share-prices"><p>Oil 80, gold 2300.</p></div></article></body>') == f"Head\n\n{LONG}\n\nOil 80, gold 2300."


def test_comments_told_by_their_form_alone():
    entry = '<div class="x1"><b class="user">Ann</b> <time>1 May</time><p>I like this.</p></div>'
    article = f"<h1>Head</h1><div class=t><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>"
    want = f"Head\n\n{LONG}\n\n{LONG}\n\n{LONG}"
    assert main_text(f"<body><div class=content>{article}{entry * 3}</div></body>") == want
    assert main_text(f"<body><div class=content>{article}<div class=q>{entry * 3}</div></div></body>") == want
    live = f'<div class="e"><time>10:00</time><p>{LONG}</p></div>'
    assert main_text(f"<body><article><h1>Head</h1>{live * 3}</article></body>").count(LONG) == 3


def test_hostile_pages_take_linear_time():
    n = 100_000
    for page in ("<div>" * n + "</span>" * n, "<span>" * n + "<li>" * n, "<li><div>" + "<span>" * n + "<li>" * n, "<nav>" + "<div>" * n + "</span>" * n, "<p>" + "<b>" * n + "<div>" * 10 + "</i>" * n, "<td>" * n + "</tr>" * n):
        began = time.process_time()
        parse(page)
        assert time.process_time() - began < 3, page[:20]


def test_unquoted_apostrophes_and_signs_in_values():
    assert main_text(f"<body><p title=it's>First {LONG}</p><p title=\"a > b\" class='x>y'>Second {LONG}</p></body>") == f"First {LONG}\n\nSecond {LONG}"
    assert main_text("<p title='open>text</p>") == "text"


def plain_density(n, body) -> float:
    """The composite density by its formula, counting over the subtree each time."""
    def count(n, linked=False):
        chars = tags = link_chars = link_tags = 0
        for c in n.children:
            if isinstance(c, str):
                chars += len(c.strip())
                link_chars += len(c.strip()) * linked
            else:
                inner = count(c, linked or c.tag == "a")
                counts = c.tag != "cut"
                chars, tags, link_chars, link_tags = chars + inner[0], tags + inner[1] + counts, link_chars + inner[2], link_tags + inner[3] + (counts and (linked or c.tag == "a"))
        return chars, tags, link_chars, link_tags

    c, t, lc, lt = count(n, n.tag == "a")
    bc, _, blc, _ = count(body)
    if not c:
        return 0.0
    base = max(math.log(math.log(c / max(c - lc, 1) * lc + blc / max(bc, 1) * c + math.e)), FLOOR)
    return c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1) + 1) / base


def test_density_equals_the_formula_and_the_densest_is_found():
    r = random.Random(4)

    def grow(depth):
        if depth == 0 or r.random() < 0.2:
            return words(r, r.randint(0, 30))
        tag = r.choice(["div", "section", "p", "a", "span", "ul"])
        return f"<{tag}>" + "".join(grow(depth - 1) for _ in range(r.randint(1, 4))) + f"</{tag}>"

    for _ in range(40):
        root = parse("<body>" + "".join(grow(5) for _ in range(4)) + "</body>")
        order = measure(root)
        assert all(abs(n.density - plain_density(n, root)) <= 1e-9 * max(1, n.density) for n in order)
        assert all(abs(n.total - sum(plain_density(c, root) for c in n.children if not isinstance(c, str))) <= 1e-6 * max(1, n.total) for n in order)


def test_rows(spark):
    rows = [(1, None, None, "t"), (2, "u", "<p>" + "wörd " * 50_000 + "</p>", "t"), (2, "u", "<p>x</p>", None), (None, "u", "<p>x</p>", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = sorted(((r.page_id or 0, len(r.text), r.n_chars) for r in extract_pages(pages).collect()))
    assert out == [(0, 1, 1), (1, 0, 0), (2, 1, 1), (2, 249_999, 249_999)]
    assert extract_pages(pages.limit(0)).collect() == []


def test_pages_whose_article_has_no_element(spark, sf_dir):
    """The given pages with their article element renamed: density alone finds the same text."""
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect() if r.html]
    assert len(pages) > 20 and all(main_text(p) and main_text(re.sub(r"<(/?)article\b", r"<\1div", p)) == main_text(p) for p in pages)
