"""Main texts of pages whose names and wrappers mislead."""

import time

import pytest

from trialgrid.llm.html_extract import main_text

LONG = "This is a long paragraph, with commas, and more text to count, really. " * 5
ARTICLE = f"<h1>Head</h1><p>{LONG}</p><p>Second one, which is long enough, as well, to be counted here.</p><p>Short.</p>"
EXPECTED = f"Head\n\n{LONG.strip()}\n\nSecond one, which is long enough, as well, to be counted here.\n\nShort."


@pytest.mark.parametrize("name", ["layout has-sidebar", "content with-sidebar", "no-sidebar", "page-search", "social-science", "post-content legal", "alert-free"])
def test_names_do_not_delete_the_article(name):
    assert main_text(f'<body><nav><a href=x>Menu</a></nav><div class="{name}">{ARTICLE}</div><footer>Foot</footer></body>') == EXPECTED


def test_wrappers_and_quotes():
    assert main_text(f"<body><form action=x><nav><a href=q>Menu</a></nav>{ARTICLE}</form></body>") == EXPECTED
    assert main_text(f"<body><p class=don't>Intro.</p><article>{ARTICLE}</article><p>Out</body>") == EXPECTED
    assert main_text(f"<article><header><h1>Head</h1></header>{ARTICLE[13:]}<footer>Tagged</footer></article>") == EXPECTED
    assert main_text(f"<a title='>' href=/x/><body><article>{ARTICLE}</article>") == EXPECTED


def test_all_containers_are_kept():
    two = "<main><section><h2>T</h2><p>" + "a, b, " + "word " * 40 + "</p></section><section>" + "<p>long, paragraph of the text, and so on and on it goes.</p>" * 6 + "</section></main>"
    assert main_text(two).startswith("T\n\na, b, word") and main_text(two).count("\n\n") == 7
    lists = "<body><div><p>" + "long text, " * 30 + "</p></div><div><p>Short one.</p></div><ul><li>a</li><li>b</li></ul><table><tr><td>1<td>2</table></body>"
    assert main_text(lists).endswith("\n\nShort one.\n\na\n\nb\n\n1\n\n2")


def test_other_parts_go():
    comments = "<div class=comments>" + "<p>I think, as a reader, that this is wrong, quite wrong.</p>" * 30 + "</div>"
    assert main_text(f"<article><p>A short, sweet article of one sentence only.</p></article>{comments}") == "A short, sweet article of one sentence only."
    aside = "<div class=sidebar><p>" + "Side text, " * 10 + "</p></div>"
    assert main_text(f"<body>{aside}<div>{ARTICLE}</div>{comments}<ul><li><a href=a>One</a><li><a href=b>Two</a></ul></body>") == EXPECTED
    assert main_text("<div class=ad>Buy this now, as it is cheap, today.</div><article><h1>A title</h1><p>Few words.</article>") == "A title\n\nFew words."


@pytest.mark.parametrize("body", ["<span></b>", "<span>", "<div>", "<p><b>x", "<table><i></div>", "<li>", '<a b="', "<"])
def test_time_is_linear(body):
    started = time.time()
    main_text(body * 100_000)
    assert time.time() - started < 10


INSIDE = {
    '<div class="section-header"><h2>The second part</h2></div>': "The second part",
    '<section class="related-work"><p>Others have found the same, in part.</p><p>We differ in the end.</p></section>': "Others have found the same, in part.\n\nWe differ in the end.",
    '<p class="promotion">Her promotion came in the spring.</p>': "Her promotion came in the spring.",
    '<p class="reply">So they said in reply.</p>': "So they said in reply.",
    "<aside><p>A word in passing, which belongs here.</p></aside>": "A word in passing, which belongs here.",
    '<div class="foot-notes"><p>1. As told above.</p></div>': "1. As told above.",
    "<menu><li>First open it.</li><li>Then close it.</li></menu>": "First open it.\n\nThen close it.",
    "<p>Here <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds <svg><path d='M0'/></svg>still.</p>": "Here x=2 holds still.",
}
OUTSIDE = [
    '<div class="comments"><p>First! I never read so good a thing, and I read a lot.</p></div>', '<div class="ad">Buy this now, and more of it.</div>',
    '<aside class="related-posts"><p>More of this kind, and of that.</p></aside>', '<nav><a href="/">Home</a></nav>', "<form><p>Your name, please</p></form>",
    '<div class="tags"><a href="/a">One tag</a> <a href="/b">Other tag</a></div>', "<aside><ul><li><a href='/c'>See the other page</a></li></ul></aside>", "<footer>All rights</footer>",
]


def test_names_inside_the_article():
    """Parts of an article stay whatever they are called; what is not of it goes, by its whole name, its tag, or its links."""
    first, last = "It began like this, on a day in May, and nobody knew.", "So it ended, as all things do, with a word."
    for inside, text in INSIDE.items():
        page = f'<html><body><div class="menu"><a href="/">Home</a></div><article><h1>Title</h1><p>{first}</p>{inside}<p>{last}</p></article></body></html>'
        assert main_text(page) == "\n\n".join(["Title", first, text, last]), inside
    for part in OUTSIDE:
        page = f"<html><body><article><h1>Title</h1><p>{first}</p><p>{last}</p>{part}</article></body></html>"
        assert main_text(page) == "\n\n".join(["Title", first, last]), part


def test_a_page_without_scripts():
    assert main_text("<html><body><noscript><p>All there is, for those without scripts.</p></noscript></body></html>") == "All there is, for those without scripts."
    assert main_text("<body><article><p>The text, all of it, is here.</p></article><noscript><p>Turn it on.</p></noscript></body>") == "The text, all of it, is here."
