"""Main text of pages: layouts, broken markup, edge cases."""

import pytest

from regimecast.llm import html_text as H

LONG = "A paragraph of the article that has quite a few words to read, and then some more of them."

CASES = {
    "plain": ("just text &amp; more", "just text & more"),
    "furniture": (
        f"<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>"
        f"<div class='cookie-notice'>We use cookies here, and {LONG}</div><article><h1>Head</h1><p>{LONG}<p>{LONG}</article>"
        f"<aside><p>{LONG}</p></aside><div id=comments><p>{LONG}</p></div><form><label>x</label></form><footer>f</footer></body>",
        f"Head\n{LONG}\n{LONG}",
    ),
    "inside": (
        f"<main><p>{LONG}</p><div class=ad>Buy {LONG}</div><script>var t='</p>';</script><ul><li>one<li>two</ul><p>{LONG}</main>",
        f"{LONG}\none\ntwo\n{LONG}",
    ),
    "inline": (f"<article><p><b>Bold</b>ly <i>go</i> {LONG}<br>next &eacute;&#x41;\n\n line</article>", f"Boldly go {LONG}\nnext éA line"),
    "links": (
        f"<div><ul>{''.join(f'<li><a href={i}>link number {i}</a></li>' for i in range(30))}</ul></div><div><p>{LONG}</p><p>{LONG}</p></div>",
        f"{LONG}\n{LONG}",
    ),
    "hidden": (f"<article><p>{LONG}</p><p style='display: none'>no</p><p hidden>no</p><p>{LONG}</article>", f"{LONG}\n{LONG}"),
    "comment": (f"<article><p>{LONG}<!-- <p>gone</p> --></p></article><!-- open {LONG}", LONG),
}


@pytest.mark.parametrize("name", CASES)
def test_layouts(name):
    page, want = CASES[name]
    assert H.main_text(page) == want


@pytest.mark.parametrize("page", ["<" * 20_000, '<a "' * 5_000, "<b>" * 3_000 + "x", "<p" * 5_000, "&#xffffffff;&bad;", "</p></div>", "<a href='"])
def test_broken_markup_ends(page):
    assert isinstance(H.main_text(page), str)


def test_frames(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", f"<p>{LONG}"), (3, "u", f"<p>{LONG}"), (3, "u", f"<p>{LONG}")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = {(r["page_id"], r["text"], r["n_chars"]) for r in H.op3_html_extract(pages).collect()}
    assert out == {(1, "", 0), (2, "", 0), (None, LONG, len(LONG)), (3, LONG, len(LONG))}
    clash = H.extract(pages.selectExpr("*", "1 AS text", "2 AS _fields"))
    assert clash.columns == ["page_id", "url", "html", "_fields", "text"]
    assert H.op3_html_extract(pages.limit(0)).collect() == []


def test_density_prefers_text_over_links():
    tree = H.parse(f"<div><a href=1>{LONG}</a></div><div><p>{LONG}</p></div>")
    density, _ = H.densities(tree)
    linked, plain = tree.tags.index("a"), tree.tags.index("p")
    assert density[linked] < density[plain]


SIDE = f"<div class=sidebar><p>{LONG} no</p></div>"
KEPT = {
    "values": (f"<article><p style='overflow:hidden'>{LONG}<p title='The hidden cost'>{LONG}<p><a href='/hidden-figures'>see</a> {LONG}</article>", 3),
    "main": (f"<div class='content-sidebar-wrap'><main><p>{LONG}</main>{SIDE}</div>", 1),
    "article": (f"<div class='with-sidebar'><article><p>{LONG}<p>{LONG}</article>{SIDE}</div>", 2),
    "words": (f"<div class='post tags-news comments-open'><p>{LONG}<p>{LONG}</div><div class=comments><p>{LONG} no</div><p>short</p>", 2),
    "teasers": (f"<article><p>{LONG}<p>{LONG}</article><div class=related><article><p>{LONG} no</article></div>", 2),
    "leaf": (f"<div><a href=1>one</a> <a href=2>two</a></div><div>{LONG}<br>{LONG}</div><footer>no</footer>", 2),
}


@pytest.mark.parametrize("name", KEPT)
def test_hints_do_not_cut_the_article(name):
    page, times = KEPT[name]
    text = H.main_text(page)
    assert text.count(LONG) == times and " no" not in text


def test_math_and_labels_of_an_article_stay():
    page = f"<article><p>Let <math><mi>x</mi></math> be. {LONG}</p><p><label>Note</label> {LONG}</p></article><label>no</label>"
    assert H.main_text(page) == f"Let x be. {LONG}\nNote {LONG}"


def test_own_text_counts():
    """A block without child blocks can be the one of the largest sum."""
    tree = H.parse(f"<div><p>a</p></div><div>{LONG} {LONG}</div>")
    density, total = H.densities(tree)
    leaf = max(i for i, t in enumerate(tree.tags) if t == "div")
    assert total[leaf] == density[leaf] > 0


def test_long_attributes_and_deep_nesting_take_linear_time():
    import time

    body = "<p>" + "The article stands here, with words enough. " * 8 + "</p>"
    want = H.main_text(f"<article>{body}</article>")
    assert want
    quoted = f'<article title="{"a > b <i> " * 20_000}">{body}</article>'
    deep = "<div>" * 100_000 + f"<article>{body}</article>" + "</div>" * 100_000
    inline = f"<article>{body}</article>" + "<span>" * 50_000 + "</b></section>" * 50_000
    for page in (quoted, deep, inline):
        began = time.process_time()
        assert H.main_text(page) == want
        assert time.process_time() - began < 5


def test_quotes_that_never_close():
    import time

    body = "<p>" + "The article stands here, with words enough. " * 8 + "</p>"
    began = time.process_time()
    text = H.main_text(f"<article>{body}</article>" + "<b class='x>y</b>\n<i>" * 20_001)
    assert "The article stands here" in text and time.process_time() - began < 10
