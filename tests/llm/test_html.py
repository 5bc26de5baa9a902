"""Main text of pages: labelled pages, broken mark-up, tables with nulls."""

import time

import pytest

from gradewell.llm import html as H
from gradewell.llm.labelled_blocks import KEPT, LABELLED_PAGES


@pytest.mark.parametrize("page", LABELLED_PAGES)
def test_labelled_pages(page):
    blocks = H.blocks_of(page)
    kept = H.main_text(page).split("\n") if H.main_text(page) else []
    wrong = [b.text for b in blocks if b.text.endswith(KEPT) != (b.text in kept)]
    assert len(wrong) <= 1


CASES = [
    (None, ""), ("", ""), ("<p></p>", ""), ("<script>var a='<p>no</p>';</script>", ""),
    ("<article><h1>T &amp; U</h1><p>One\n  two&nbsp;three<br>four</p><p>Last &#233;&lt;b&gt;</article>", "T & U\nOne two three four\nLast é<b>"),
    ("<nav><a href='/x>y'>Menu</a></nav><article><p>Text of the page stands here.</p></article><footer>&copy; 2020</footer>", "Text of the page stands here."),
    ("<article><p>Kept.</p><!-- <p>not</p> --><style>p{}</style><p>Too.", "Kept.\nToo."),
    ("<article><p>A</p><div class='comments'><p>A reader wrote many words here about all the things that matter.</p></div></article>", "A"),
    ("<body><aside>Side words that go on for quite a while, to look like text</aside><main><p>Main words.</p></main><div hidden>Hidden words of a page that nobody sees at all</div>", "Main words."),
    ("<article><header><h1>Head</h1></header><p>Body of it.</p><form><p>Write to us about this and that, and more.</p></form></article>", "Head\nBody of it."),
    ("<html><head><title>T</title><body><article><p>No end of the head.</p><ol class=commentlist><li>First reader, who liked all of it very much.</ol></article>", "No end of the head."),
    ("<ARTICLE><P CLASS=x>Upper</P></ARTICLE>", "Upper"),
]
SILENT_CASES = [
    ("<article><p>Before it.</p><svg viewBox='0 0 1 1' class=\"i>\"/><p>After it.</p><svg><text>no</text></svg><p>Last one.</p></article>", "Before it.\nAfter it.\nLast one."),
    ("<article><p>Before it.</p><math/><p>After it.</p></article>", "Before it.\nAfter it."),
    ("<article><p>Before it.</p><video src=a /><object data=b /><canvas /><audio src=c /><p>After it.</p></article>", "Before it.\nAfter it."),
    ("<article><p>Before it.</p><video-player src=a></video-player><object-list></object-list><template-part/><p>After it.</p></article>", "Before it.\nAfter it."),
    ("<article><p>Before it.</p><video src='a/b'>no <b>player</b></video><script src=x/>var a;</script><p>After it.</p></article>", "Before it.\nAfter it."),
    ("<article><p>Before it.</p><video src=a /><p>No video here.</p></video><p>After it.</p></article>", "Before it.\nAfter it."),
    ("<article><p <b>Unended tag.</b></p><p>After it.</p></article>", "Unended tag.\nAfter it."),
]
PROSE = "The river rose for three days before the water reached the lower fields and the road to the mill."
FORM_CASES = [
    (f"<body><form id=aspnetForm><h1>The flood</h1><p>{PROSE}</p><p>{PROSE}</p></form></body>", f"The flood\n{PROSE}\n{PROSE}"),
    (f"<body><form id=f1><nav><a href=/>Home</a></nav><p>{PROSE}</p><p>{PROSE}</p></form></body>", f"{PROSE}\n{PROSE}"),
    (f"<body><p>{PROSE}</p><p>{PROSE}</p><form action=/go><p>{PROSE}</p></form></body>", f"{PROSE}\n{PROSE}"),
    (f"<body><form class=login-form><p>{PROSE}</p></form></body>", ""),
]


@pytest.mark.parametrize(("page", "text"), FORM_CASES)
def test_form_around_the_page(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize("piece", ["<span ", "<span>", "</span x", "<!", "</", "<a href='", "<div><span>", "</div>", "<canvas/>", "<script ", "<svg ", "<form><p>x", "<!--", "<p title=\"", "<a \"x\" '"])
def test_broken_pages_take_linear_time(piece):
    start = time.time()
    H.main_text("<article><p>Kept.</p></article>" + piece * (1_000_000 // len(piece)))
    assert time.time() - start < 15


@pytest.mark.parametrize(("page", "text"), CASES)
def test_pages(page, text):
    assert H.main_text(page) == text


WRAPPED = "<article><h1>Head of it</h1><p>The text of the article has some words.</p></article>"
WRAPPED_TEXT = "Head of it\nThe text of the article has some words."
NAMED = [
    *[(f"<div class='{name}'>{WRAPPED}</div>", WRAPPED_TEXT) for name in ("content-sidebar-wrap", "page-with-sidebar", "sidebar", "layout header-footer-grid", "comments-open")],
    (f"<form id=aspnet><div class=main-menu-wrap>{WRAPPED.replace('article>', 'main>')}</div></form>", WRAPPED_TEXT),
    *[(WRAPPED.replace("<p>", f"<section {named}><p>").replace("</p>", "</p></section>"), WRAPPED_TEXT)
      for named in ("id=discussion", "class=discussion", "id=legal", "class=legal", "id=search", "id=commentary", "class=commentary", "id=feedback-section")],
    ("<div class=content-sidebar-wrap><div><p>Plain words of a page without any article at all.</p></div></div>", "Plain words of a page without any article at all."),
    ("<article class='featured promo'><p>Text of the page stands here.</p></article>", "Text of the page stands here."),
    (f"{WRAPPED}<section id=comments><article class=comment-body><p>A reader wrote many words here about all the things that matter.</p></article></section>", WRAPPED_TEXT),
    (f"{WRAPPED}<aside><article><p>A teaser of another page with some words in it.</p></article></aside>", WRAPPED_TEXT),
    (f"{WRAPPED}<div hidden><article><p>Words that nobody sees at all on this page.</p></article></div>", WRAPPED_TEXT),
    (f"<div class=ad-slot>Buy one now, and get another one for free until the end of the week.</div>{WRAPPED}<div class='nav-container'>Some words of a bar that stands on every page of it</div>", WRAPPED_TEXT),
]


@pytest.mark.parametrize(("page", "text"), NAMED)
def test_names_of_wrappers_and_sections(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize(("page", "text"), SILENT_CASES)
def test_silent_elements_end(page, text):
    assert H.main_text(page) == text


def test_long_page_is_read_whole():
    page = "<nav><a href=/>x</a></nav><article>" + "".join(f"<p>Paragraph number {i} of the long page.</p>" for i in range(20_000)) + "</article>"
    assert H.main_text(page).count("\n") == 19_999


def test_table(spark):
    rows = [(None if i == 1 else i % 5, "u", page, "t") for i, (page, _) in enumerate(CASES)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, text string")
    out = H.extract_main_text(pages).collect()
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in out] == [(r[0], t, len(t)) for r, (_, t) in zip(rows, CASES)]
    assert H.extract_main_text(pages.limit(0)).count() == 0
