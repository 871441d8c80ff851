import re
import time

import pyarrow.parquet as pq
import pytest

from foliospark.llm import html_extract as H

BODY = "This is a paragraph of the body and it has a good number of the words that are in the list of stop words, so that it is long enough to be seen as good by the rules that we use for it in this test, and it goes on for a while so as to be over the limit."
DENSE = "Quartz feldspar mica granite basalt gneiss schist marble slate limestone dolomite gypsum halite pyrite."


def test_articles_beside_the_body_do_not_replace_it():
    teaser = "<article><h3><a href=x>Another thing that we wrote</a></h3><p>In short.</p></article>"
    page = f'<body><div class=text><p>{BODY}</p><p>{BODY}</p></div><section class="more-stories">{teaser * 3}</section></body>'
    assert H.extract(page) == f"{BODY} {BODY}"
    assert H.extract(f"<main><p>{BODY}</p></main><div><p>{BODY}</p></div>") == f"{BODY} {BODY}"


def test_words_decide_outside_and_neighbours_inside_an_article():
    assert H.extract(f"<article><p>{BODY}</p><p>{DENSE}</p></article><div><p>{DENSE}</p></div>") == f"{BODY} {DENSE}"
    links = "<p><a href=x>Quartz feldspar mica granite</a></p>"
    assert H.extract(f"<article><p>{BODY}</p><section>{links}<p>{DENSE}</p>{links}</section></article>") == BODY
    assert H.extract(f"<nav>{BODY}</nav><article><p>{DENSE}</p></article><footer>{BODY}</footer>") == DENSE


def test_dropped_elements_end_where_they_end():
    for markup in ("<video-js id=a></video-js>", "<button-group>", '<svg width="1"/>', "<math/>", "<canvas />", "<object>", "<button>", "<svg>", "<video src=x>", "<select>"):
        assert H.extract(f"<article><p>one</p>{markup}<p>two</p></article><footer>three</footer>") == "one two", markup
    for name in ("svg", "button", "script", "SELECT", "title"):
        assert H.extract(f"<article><p>one</p><{name} a='b'>x</{name} ><p>two</p></article>") == "one two", name
    for name in ("script", "style", "template"):
        assert H.extract(f"<article><p>one</p><{name}>x<p>two</p></article>") == "one", name
    assert len(H.extract("<article>" + "<button>a" * 50000)) == 99999


def test_copyright_signs_and_formulas_are_kept():
    assert H.extract(f"<article><p>{BODY} &copy;</p><p>Photo \xa9 the writer</p></article>") == f"{BODY} \xa9 Photo \xa9 the writer"
    assert H.extract(f"<div><p>{BODY} &copy;</p><p>\xa9 2020 All rights</p></div>") == f"{BODY} \xa9"
    assert H.extract(f"<article><p>{BODY} So <math><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow></math> holds.</p></article>") == f"{BODY} So x=2 holds."


@pytest.mark.parametrize("markup", ["<a " * 300_000, '<p title="' * 100_000, "<div>" * 100_000, "<div>x" * 100_000, "</section>" * 200_000, "<svg>" * 100_000, "<!--" * 100_000, "<" * 200_000, "<a href='x\" " * 50_000, "<div><section></b></p>x" * 50_000])
def test_hostile_markup_takes_a_time_in_proportion(markup):
    began = time.process_time()
    H.extract(markup)
    assert time.process_time() - began < 10


def test_words_decide_where_no_element_is_named_article(monkeypatch):
    """The pages of a table, each with one article, as they are and with that element's name taken away."""
    pages = [x or "" for x in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()]
    bare = [re.sub(r"(</?)(article|main)\b", r"\1div", x) for x in pages]
    whole = [H.extract(x) for x in pages]
    assert sum(H.extract(x) == y for x, y in zip(bare, whole, strict=True)) > 0.95 * len(pages)
    monkeypatch.setattr(H, "STOP_WORDS", frozenset())
    assert sum(H.extract(x) == y for x, y in zip(bare, whole, strict=True)) < 0.05 * len(pages)


def test_quotes_and_comments():
    assert H.extract(f'<article><p title="a > b">{BODY}</p><p data-x=\'<p>\'>one</p><!-- <p>two</p> --><?php x ?><p class="c>three</p></article>') == f"{BODY} one three"
    assert H.extract(f"<article><p>{BODY} 1 < 2 <3</p></article>") == f"{BODY} 1 < 2 <3"


RUSSIAN = "Съешь же ещё этих мягких французских булок, да выпей чаю, а потом расскажи нам обо всём, что видел. " * 2


@pytest.mark.parametrize(("page", "want"), [
    (f'<nav>menu</nav><article class="post category-social tag-legal type-banner"><p>{BODY}</p></article>', BODY),
    (f'<main id="comment"><p>{BODY}</p></main><footer>x</footer>', BODY),
    (f'<article><p>{BODY}</p><div class="legal-text share-price"><p>{BODY} more</p></div></article>', f"{BODY} {BODY} more"),
    (f'<form id="aspnetForm"><div class="nav">x y</div><div><h1>Title</h1><p>{BODY}</p><p>{BODY}</p></div></form>', f"Title {BODY} {BODY}"),
    (f'<div class="social-layout with-sidebar"><main><p>{BODY}</p></main></div>', BODY),
    (f"<nav><a href=x>Меню</a></nav><div><p>{RUSSIAN}</p><p>{RUSSIAN}</p></div><footer>Подвал</footer>", f"{RUSSIAN.strip()} {RUSSIAN.strip()}"),
    (f"<article><p>{RUSSIAN}</p></article>", RUSSIAN.strip()),
])
def test_names_do_not_take_articles_away(page, want):
    assert H.extract(f"<html><body>{page}</body></html>") == want


@pytest.mark.parametrize("name", ["comment-list", "commentsArea", "site-footer", "main-nav", "share-buttons", "social-links", "related-posts", "newsletter-signup", "sidebar", "side-bar", "cookie-notice", "ad", "ad-slot", "google-ads", "post-comments", "breadcrumbs", "skip-link", "sponsored-box", "navbar"])
def test_names_of_other_parts_bar(name):
    assert H.extract(f'<body><article><h1>Title</h1><p>{BODY}</p></article><div class="x {name}"><p>{BODY} other</p></div></body>') == f"Title {BODY}"


def test_comments_stay_out_however_long_and_marked_up():
    comment = f'<article class="comment" id="div-comment-7"><p>{BODY} said one</p></article>'
    assert H.extract(f'<body><div class="content"><h1>T</h1><p>{BODY}</p></div><section id="comments">{comment * 5}</section></body>') == f"T {BODY}"
    assert H.extract(f'<body><article><h1>T</h1><p>{BODY}</p></article><ol class="comment-list"><li>{comment}</li></ol></body>') == f"T {BODY}"
    assert H.extract(f'<form class="search"><p>{BODY}</p></form><div><p>{BODY} {BODY}</p></div>') == f"{BODY} {BODY}"


def test_pages_without_an_article_are_seldom_lost():
    pages = [x or "" for x in pq.read_table("/root/testdata/sf0.1/pages.parquet").column("html").to_pylist()]
    bare = [H.extract(re.sub(r"(</?)(article|main)\b", r"\1div", x)) for x in pages]
    assert sum(not x for x in bare) < 0.01 * len(pages)
