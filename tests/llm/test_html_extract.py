"""Main text of hand-made pages, and edges."""

import pytest

from citewerk.llm.html_extract import extract, furniture_words, main_text

PAGES = {
    "template": (
        "<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script></head><body>"
        "<nav><a href=x>Home</a></nav><div class='ad'>Buy</div><article><h1>Head</h1>"
        "<p><b>One &amp; two<br><p>Three\n  four</p><p>x.</p></article><footer>&copy; z",
        "Head\n\nOne & two\n\nThree four\n\nx.",
    ),
    "no article element": (
        "<body><div id=menu><a href=a>A</a><a href=b>B</a></div><div><h1>Head</h1>"
        + "".join(f"<p>A long paragraph number {i} that says a lot about nothing.</p>" for i in range(4))
        + "</div><div><a href=c>next</a> <a href=d>last</a></div></body>",
        "Head\n\n" + "\n\n".join(f"A long paragraph number {i} that says a lot about nothing." for i in range(4)),
    ),
    "comments and forms": (
        "<main><section><p>First text of the page.</p></section><form><p>Your name</p></form>"
        "<article class='comment'>Nice!</article><section id='comments'><p>So true.</p></section>"
        "<div class='cookie-notice'>We bake.</div><p hidden>no</p><p>Last &eacute;&#33;</p></main>",
        "First text of the page.\n\nLast é!",
    ),
    "lists and tables": (
        "<article><ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table><pre> f\n g</pre></article>",
        "a\n\nb\n\nc\n\nd\n\ne\n\nf g",
    ),
    "broken": ("<article><p title='a > b'>x</i></p></div><p>y<", "x\n\ny<"),
    "plain": (" only\ttext ", "only text"),
    "comment only": ("<!-- never ends", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, wanted = PAGES[name]
    assert main_text(page) == wanted


def test_deep_and_long():
    assert main_text("<div>" * 30_000 + "x") == "x"
    long = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    assert main_text(long).count("word") == 20_000


def test_table(spark):
    rows = [(1, None, "a", 2), (2, "", "a", 2), (2, "<p>é</p>", None, 3), (2, "<p>é</p>", None, 3)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int")
    found = extract(pages, ["page_id", "text"])
    assert found.columns == ["page_id", "text", "text_", "n_chars"]
    got = sorted((r.page_id, r.text_, r.n_chars) for r in found.collect())
    assert got == [(1, "", 0), (2, "", 0), (2, "é", 1), (2, "é", 1)]
    assert extract(pages.limit(0), ["page_id"]).count() == 0


def paragraphs(name, n=4):
    return [f"A long paragraph {name} {i} that says a lot about nothing." for i in range(n)]


def marked_up(blocks):
    return "".join(f"<p>{b}</p>" for b in blocks)


def test_several_articles():
    parts = [paragraphs("of part one", 6), paragraphs("of part two"), paragraphs("of part three")]
    page = "<main>" + "".join(f"<article>{marked_up(p)}</article>" for p in parts) + "</main>"
    assert main_text(page) == "\n\n".join(sum(parts, []))
    nested = f"<article>{marked_up(parts[0])}<article>{marked_up(parts[1])}</article></article>"
    assert main_text(nested) == "\n\n".join(parts[0] + parts[1])


def test_text_beside_an_article():
    inside, beside = paragraphs("inside", 6), paragraphs("beside")
    links = "<ul>" + "".join(f"<li><a href=x{i}>More {i}</a></li>" for i in range(9)) + "</ul>"
    page = f"<body>{links}<article>{marked_up(inside)}</article><div>{marked_up(beside)}</div>{links}</body>"
    assert main_text(page) == "\n\n".join(inside + beside)


def test_layout_classes_are_no_furniture():
    text = paragraphs("of the page")
    wanted = "\n\n".join(text)
    names = "content has-sidebar|col with-sidebar|no-comments|page-with-menu|search-results|share-price|related-work"
    for name in names.split("|"):
        assert main_text(f"<body><nav>n</nav><div class='{name}'>{marked_up(text)}</div></body>") == wanted, name
        assert main_text(f"<div id='{name.split()[-1]}'>{marked_up(text)}</div>") == wanted, name
    # names that hold the content are no furniture, whatever they say
    for name in ("sidebar", "site-footer", "comments"):
        assert main_text(f"<body><div class={name}>{marked_up(text)}</div></body>") == wanted, name
        assert main_text(f"<body><div class={name}><article>{marked_up(text)}</article></div></body>") == wanted, name


def test_known_compounds_are_furniture():
    text, more = paragraphs("of the page"), paragraphs("of no use", 9)
    for name in "site-footer cookie-banner comment-list main-nav sidebar-2 ad_slot related-posts page-header".split():
        assert furniture_words("div", f" class='x {name}'", False), name
    for name in ("site-footer", "cookie-banner", "comments", "comment-list", "newsletter box"):
        page = f"<body><article>{marked_up(text)}</article><div class='{name}'>{marked_up(more)}</div></body>"
        assert main_text(page) == "\n\n".join(text), name
    replies = f"<div id=comments>{marked_up(more)}<article>{marked_up(more)}</article></div>"
    assert main_text(f"<div class=post>{marked_up(text)}</div>{replies}") == "\n\n".join(text)
    assert main_text(f"<article>{marked_up(text)}</article>{replies}") == "\n\n".join(text)
