"""HTML extraction on pages that are deep, broken or unusual, and on a set of labelled pages."""

import re
import time

import pytest

from runledger.llm.html_text import boilerplate, main_text, read


@pytest.mark.parametrize(
    "page",
    ["<div>" * 100_000 + "x", '<a "' * 100_000, "<a b=\"'" * 50_000 + ">", "<b>" * 50_000 + "</i>" * 50_000, "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000, "<li><table>" + "<div>" * 50_000 + "</li>" * 50_000,
     "</script" * 50_000 + "<script>", "<" * 200_000, "<p a=\"" * 30_000, "<p><b>" * 40_000, "<a " * 100_000, "<p " + "a=" * 100_000 + ">", "<div>x" * 50_000, "&" * 200_000, "<!--" * 50_000],
    ids=["deep", "stray quotes", "mixed quotes", "inline ends", "ends beyond a block", "ends beyond a table", "raw ends", "less-than", "open values", "open inline", "open tags", "attributes", "deep text", "ampersands", "comments"],
)
def test_time_follows_length(page):
    began = time.process_time()
    main_text(page, None)
    assert time.process_time() - began < 15


def test_paths_are_stored_by_step():
    p = read("<div class=a>" * 20_000 + "<p>x")
    assert len(p.steps) == 20_002 and p.path(3) == ">div.a" * 3 and p.at(">div.a>div.a") == 2 and p.at(">div.b") is None
    assert main_text("<div><p>one two three four</p></div><div class='x>y'>z</div>", ">div.xy") == "z"


def test_broken_quotes_lose_no_text():
    assert main_text('<article><p title="5" tall">one</p><p a="x>two</p><p>three</p></article>', None) == "one two three"
    assert main_text('<article><p>one</p><p a=">two</p><p>three</p></article>', None) == "one two three"
    assert main_text("<article><p>a < b <c> d</p></article><di", None) == "a < b d"


def test_a_form_that_frames_the_page_is_kept():
    text = "<h1>Title</h1><p>" + "some words of a body " * 20 + "</p>"
    want = "Title " + ("some words of a body " * 20).strip()
    assert main_text(f"<body><form action=a><div class=wrap><article>{text}</article></div><button>go</button><select><option>x</select></form></body>", None) == want
    assert main_text(f"<body><form action=a><div>{text}</div></form></body>", None) == want
    assert main_text(f"<body><div><article>{text}<form><p>Your mail</p><input></form></article></div></body>", None) == want
    assert main_text("<body><div><p>Short.</p><form><p>a long form that asks for many things at once</p></form></div></body>", None) == "Short."


@pytest.mark.parametrize("name", ["ad", "ads-top", "ad-slot", "adSlot2", "advert-x", "cookie-notice", "cookie-law-info", "comments", "comment-list", "comment-body", "site-search", "related-posts", "share-buttons", "newsletter-box", "widget_area", "nav", "main-nav", "breadcrumb-trail", "sidebar-left", "page-footer", "social-links"])
def test_names_of_boilerplate(name):
    assert boilerplate(name, True) and main_text(f"<article><p>kept</p><div class='{name}'>gone</div></article>", None) == "kept"


@pytest.mark.parametrize("name", ["ad-hoc", "search-results", "alert-systems", "social-history", "menu-planning", "commentary", "adversary", "entry-header", "no-sidebar", "with-comments", "notice-of-hearing", "reply-to-the-king", "tagset", "headline", "content", "post-17"])
def test_names_of_content(name):
    assert not boilerplate(name, True) and main_text(f"<article><div class='{name}'>kept</div><p>too</p></article>", None) == "kept too"


def test_formulas_and_tables_are_text():
    assert main_text("<article><p>so <math><mi>E</mi><mo>=</mo><mi>m</mi></math></p><table><tr><td>1<td>2</table></article>", None) == "so E=m 1 2"


BODY = "<h1>The harbour</h1><p>Boats came in &amp; went out all day.</p><p>By night the quay was empty,<br>and only the lamps were left.</p><ul><li>rope</li><li>tar</li></ul><blockquote>Who goes there?</blockquote><pre>a  b\nc</pre><h2>Later</h2><p>Rain fell on <em>every</em> roof of the town for a week.</p>"
WANT = "The harbour Boats came in & went out all day. By night the quay was empty, and only the lamps were left. rope tar Who goes there? a b c Later Rain fell on every roof of the town for a week."
LINKS = "".join(f"<li><a href=/{k}>Link number {k}</a></li>" for k in range(12))
LABELLED = {
    "article": f"<body><nav><ul>{LINKS}</ul></nav><article>{BODY}</article><footer>&copy; all rights</footer></body>",
    "main": f"<body><header><a href=/>Home</a></header><main>{BODY}</main><aside><p>Read also</p></aside></body>",
    "divs": f"<body><div id=header>Site</div><div id=menu><ul>{LINKS}</ul></div><div id=content>{BODY}</div><div id=sidebar><p>Archives</p></div><div id=footer>Imprint</div></body>",
    "tables": f"<table><tr><td class=nav><a href=/>x</a></td><td>{BODY}</td><td class=ads>Buy</td></tr></table>",
    "roles": f"<div role=banner>Site</div><div role=navigation>{LINKS}</div><div role=main>{BODY}</div><div role=contentinfo>Imprint</div>",
    "hidden": f"<article>{BODY}<p hidden>no</p><p style='display: none'>no</p><div aria-hidden=true>no</div></article><noscript>Turn it on</noscript>",
    "comments": f"<article>{BODY}</article><section id=comments><h2>3 comments</h2><div class=comment><p>I was there when it rained and I can say that it was far worse than this piece wants to make us believe, honestly.</p></div></section>",
    "forms": f"<form id=f><div class=page><main>{BODY}</main></div><input type=submit></form><form class=login><p>User</p></form>",
    "no tags closed": f"<nav><a href=/>x</a></nav><article>{BODY.replace('</p>', '').replace('</li>', '')}",
    "scripts": f"<script>if (1 < 2) document.write('<p>no</p>')</script><style>p > a {{}}</style><article>{BODY}<script>x()</script></article>",
    "notices": f"<div class='cookie-banner'><p>We use cookies</p></div><div class=alert>Sale!</div><article>{BODY}<div class='newsletter-signup'>Join us</div></article>",
    "wrapped": f"<div class='layout has-sidebar'><div class='inner'><div class='post'><div class=entry-content>{BODY}</div><div class=post-tags><a>t</a></div></div><div class=sidebar>{LINKS}</div></div></div>",
}


@pytest.mark.parametrize("name", LABELLED)
def test_labelled_pages(name):
    got, want = (re.findall(r"\w+", x) for x in (main_text(LABELLED[name], None), WANT))
    both = sum(min(got.count(x), want.count(x)) for x in set(want))
    assert both >= 0.97 * len(want) and both >= 0.97 * len(got), main_text(LABELLED[name], None)


def test_votes_of_a_host_and_ties(spark):
    from runledger.llm.html_text import extract_pages, host_paths

    a, b = "<div class=a><p>one two three four five</p></div>", "<div class=b><p>one two three four five</p></div>"
    rows = [(1, "http://h.org/1", a), (2, "http://h.org/2", b), (3, "http://g.org/1", b + a)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    assert {(r.host, r.path) for r in host_paths(df).collect()} == {("h.org", ">div.a"), ("g.org", ">div.b")}
    assert {r.page_id: r.text for r in extract_pages(df).collect()} == {1: "one two three four five", 2: "one two three four five", 3: "one two three four five"}
